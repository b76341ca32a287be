"""What the tests of the operators share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHES = ("m_size", "m_row", "q_row", "q_entropy", "l_row", "l_own", "s_row", "s_id", "fp", "h", "line", "line_id", "kept", "anchor", "size", "n")
SYLLABLES = "an be ch de el en er es ge he in is ka la le ma me ne no on or ou ra re ri sch st ta te th ti to un ver wa".split()


def prose(words: int, seed: int) -> str:
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(words)]
    for k in range(9, words, 10):
        out[k] += rnd.choice([".", ",", ".\n"])
    return " ".join(out)


def rows(texts) -> list[tuple]:
    return [(k, t, ("en", "de")[k % 2], ("web", "book", "code")[k % 3], len(t or "")) for k, t in enumerate(texts, 1)]


def table(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    body = prose(80, 1)
    data = [
        (1, None, None, None, None), (2, "", "en", "web", 0), (3, " \n\t \n", "en", None, 5), (4, prose(60_000, 2), "en", "web", 9),
        (5, body, "en", "web", 1), (6, body, None, "book", 1), (7, body + "x", "de", "web", 1), (7, body + "x", "de", "web", 1),
        (None, body, "en", "web", 1), (None, None, None, None, None), (8, "a b", "en", "web", 3), (9, "éİß 😀 \x00 z", "en", "web", 3),
        (10, "x" * 200_000, "en", "web", 3), (11, "same line here\n" * 40, "de", "book", 3),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    return df.selectExpr("*", *[f"'c{k}' AS `{c}`" for k, c in enumerate(CLASHES)])


def components(n: int, pairs) -> list[int]:
    """The least member of each one's component."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]
