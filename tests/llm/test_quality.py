"""Quality rules: base figures against brute force, the model's sums, and verdicts on planted texts."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np

from quernel.llm import quality

from .helpers import WORD, prose, table


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    inside = {k + d for k, g in enumerate(grams) if g in twice for d in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_base_figures(spark):
    rnd = random.Random(4)
    texts = [None, "", "\n\n", "a", "a b c a b c", "x\nx\n\nx \ny", "#*$ %&|<>", "\x0b\x0c\r\x1c", "é😀 é😀 é😀 é😀", prose(3000, 1)]
    texts += ["".join(rnd.choice("ab \n#\té") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    got = {r.doc_id: r for r in quality.quality(table(spark, texts)).collect()}
    for k, t in enumerate(texts, 1):
        r, want = got[k], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def folded(text):
    """Capitals, digits and signs are one symbol each; three line feeds lead."""
    out = []
    for c in text:
        c = c if ord(c) < 65536 else chr(0xE000 + ord(c) % 6400)  # private use
        kind = unicodedata.category(c)
        out.append("A" if kind in ("Lu", "Lt") else "0" if kind[0] == "N" else "#" if kind[0] == "S" or c in "#%&*@\\/_" else c)
    return "\n\n\n" + "".join(out)


def brute_model(texts):
    """The probability of the last character of a 4-gram, by the definition of modified Kneser-Ney."""
    tables = {4: Counter(f[k : k + 4] for f in map(folded, texts) for k in range(len(f) - 3))}
    for m in (3, 2, 1):
        tables[m] = Counter(g[1:] for g in tables[m + 1])

    def discounts(m):
        n = [max(1, sum(c == r for c in tables[m].values())) for r in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(r - (r + 1) * y * n[r] / n[r - 1], 0.05), r - 0.05) for r in (1, 2, 3)]

    cut = {m: discounts(m) for m in tables}
    followers = {m: {} for m in tables}
    for m, t in tables.items():
        for g, c in t.items():
            followers[m].setdefault(g[:-1], []).append(c)
    less = lambda m, c: cut[m][min(c, 3) - 1]

    def p(g):
        m = len(g)
        below = p(g[1:]) if m > 1 else 1 / 65536
        after = followers[m].get(g[:-1])
        if not after:
            return below
        c, total = tables[m].get(g, 0), sum(after)
        return (c - less(m, c) if c else 0) / total + sum(less(m, x) for x in after) / total * below

    return p, tables


def brute_entropy(p, text):
    f = folded(text)
    return -sum(math.log(p(f[k : k + 4])) for k in range(len(f) - 3)) / max(1, len(text))


def _median(values):
    cells = sorted(math.floor(v * quality.CELLS) for v in values)
    return (cells[(len(cells) + 1) // 2 - 1] + 0.5) / quality.CELLS


def brute_kept(rows):
    """Verdicts of (language, entropy, words) by the definition of the bands."""
    centre = {t: _median([e for x, e, _ in rows if x == t]) for t, _, _ in rows}
    off = [(t, abs(e - centre[t]) * n**0.5) for t, e, n in rows]
    common, reach = 1.4826 * _median([o for _, o in off]), {}
    for t in centre:
        own = [o for x, o in off if x == t]
        s, n = 1.4826 * _median(own), len(own)
        drawn = ((n * s * s + quality.PRIOR * common * common) / (n + quality.PRIOR)) ** 0.5
        reach[t] = quality.REACH * max(drawn, common / 2) * (1 + quality.PRIOR / n) ** 0.5
    return [o <= reach[t] for t, o in off]


def test_entropies_and_verdicts_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = [prose(rnd.randint(60, 120), k) for k in range(24)] + [prose(90, 90).upper(), " | ".join(prose(80, 91).split()), "жук ёж 漢字 😀 Ǆ " * 5 + prose(60, 92), "", None]
    p, tables = brute_model([t or "" for t in texts])
    for m in (1, 2, 3):
        for g in list(tables[m])[:40]:
            assert abs(sum(p(g + c) for c in tables[1]) + p(g + "\x01") * (65536 - len(tables[1])) - 1) < 1e-9
    got = {r.doc_id: r for r in quality.quality(table(spark, texts)).collect()}
    for k, t in enumerate(texts, 1):
        assert abs(got[k].entropy - brute_entropy(p, t or "")) < 1e-5
    sound = [r for r in got.values() if not r.base_failed]
    want = brute_kept([(r.lang, r.entropy, r.n_words) for r in sound])
    assert [r.kept for r in sound] == want and not all(want) and sum(want) > 20
    cut = {r.doc_id: r for r in quality.quality(table(spark, texts), shard=100).collect()}  # many shards
    assert all(abs(cut[k].entropy - got[k].entropy) < 1e-9 and cut[k].kept == got[k].kept for k in got)


def test_each_table_has_its_own_model(spark):
    one, two = [prose(100, k) for k in range(6)], ["abcd " * 100 + prose(20, k) for k in range(6)]
    for texts in (one, two, one, two, one, two):
        p, _ = brute_model(texts)
        for r in quality.quality(table(spark, texts)).collect():
            assert abs(r.entropy - brute_entropy(p, texts[r.doc_id - 1])) < 1e-5


def test_hash_is_that_of_the_engine(spark):
    values = np.array([0, 1, -1, 1 << 40, -(1 << 63)], np.int64)
    want = [r.h for r in spark.createDataFrame([(int(v),) for v in values], "g long").selectExpr("xxhash64(g) AS h").collect()]
    assert quality._hash(values.view(np.uint64)).view(np.int64).tolist() == want


def test_the_model_grows_with_the_texts(spark):
    sizes = [quality.train(table(spark, [prose(200, k) for k in range(n)] + [chr(0x4E00 + k) * 3 for k in range(n)])).count() for n in (10, 40)]
    assert sizes[1] > 1.5 * sizes[0]


def test_noise_goes_and_prose_stays(spark):
    rnd = random.Random(7)
    noise = ["".join(rnd.choice("qxzjkwv7#%~^@") + " " * (rnd.random() < 0.2) for _ in range(900)) for _ in range(3)]
    texts = [prose(rnd.randint(60, 300), k) for k in range(300)] + noise
    got = {r.doc_id: r for r in quality.quality(table(spark, texts)).collect()}
    assert all(got[k].kept for k in range(1, 301)) and not any(got[k].kept for k in range(301, 304))
    assert quality.filtered(table(spark, texts)).count() == 300


def _figures(spark, rows):
    return {r.q_tongue: r for r in quality.bands(spark.createDataFrame(rows, "q_tongue string, q_entropy double, q_n_words long")).collect()}


def _inside(band, entropy, words):
    return abs(entropy - band.q_centre) * words**0.5 <= band.q_reach


def test_much_junk_does_not_widen_a_band(spark):
    rnd = random.Random(8)
    good = [(rnd.randint(50, 500)) for _ in range(700)]
    sound = [("=es", 2.2 + rnd.gauss(0, 0.3) / n**0.5, n) for n in good]
    junk = [("=es", 2.2 + rnd.choice([-0.2, 0.2]) + rnd.gauss(0, 0.01), 250) for _ in range(300)]
    band = _figures(spark, sound + junk)["=es"]
    assert sum(_inside(band, e, n) for _, e, n in sound) >= 0.99 * len(sound)
    assert sum(_inside(band, e, n) for _, e, n in junk) <= 0.05 * len(junk)


def test_rare_languages_have_bands_of_their_own(spark):
    rnd = random.Random(9)
    rows = [("=en", 2.0 + rnd.gauss(0, 0.02), 200) for _ in range(2000)]
    sizes = (1, 2, 5, 50, 99, 100, 101)
    rows += [(f"={n}", 3.5 + rnd.gauss(0, 0.02), 200) for n in sizes for _ in range(n)]
    found = _figures(spark, rows)
    assert all(abs(found[f"={n}"].q_centre - 3.5) < 0.08 for n in sizes)
    assert all(_inside(found[t], e, n) for t, e, n in rows if t != "=en")
    assert all(not _inside(found[f"={n}"], 2.0, 200) for n in sizes)
    assert abs(found["=99"].q_reach / found["=100"].q_reach - 1) < 0.5
