"""SimHash against all pairs."""

import random

import xxhash

from quernel.llm import simhash

from .helpers import WORD, components, prose, table


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in [None, "", "A", "a B", "x\ty\nz", "É é É q", prose(50, 3), prose(50, 3).upper(), "a a a a a a"]:
        assert simhash.fingerprint(t) == brute(t)


def test_components_equal_all_pairs(spark):
    rnd, texts = random.Random(5), []
    for k in range(60):
        words = prose(rnd.choice([3, 40, 300]), k).split()
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    prints = [brute(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = components(len(texts), pairs)
    got = {r.doc_id - 1: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert [got[k].component_id - 1 for k in range(len(texts))] == want
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]


def test_links_of_planted_fingerprints(spark):
    """Chains of one to four flipped bits anywhere, hot anchors split into many parts."""
    rnd, prints = random.Random(6), [0]
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(12):
            prints.append(x)
            for bit in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << bit
    base = rnd.getrandbits(64)
    prints += [base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)]
    prints = sorted(set(prints))
    want = components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    at = {p: k for k, p in enumerate(signed)}
    for chunk in (4096, 3):
        edges = [(at[r.a], at[r.b]) for r in simhash.links(df, chunk=chunk).collect()]
        assert components(len(prints), edges) == want
        assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in edges)


def test_one_of_each_group_stays(spark):
    body = prose(300, 9)
    got = simhash.deduplicated(table(spark, [body, body + " end", prose(300, 10), body])).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_different_texts_under_one_id_both_stay(spark):
    from .helpers import SCHEMA

    a, b = prose(200, 20), prose(200, 21)
    data = [(1, a, "en", "web", 1), (1, b, "en", "web", 1), (1, b, "en", "web", 1), (2, a + " x", "en", "web", 1), (3, b, "de", "book", 2)]
    got = simhash.deduplicated(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, a), (1, b)])
