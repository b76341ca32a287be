"""Line dedup against all pairs."""

import random

import corpus_pipeline
from quernel.llm import line_dedup
from quernel.llm.common import components as spark_components
from quernel.llm.common import saved

from .helpers import components, prose, table


def full_shingles(line):
    return {line[k : k + 8] for k in range(max(1, len(line) - 7))}


def corpus():
    rnd, lines = random.Random(3), []
    for k in range(40):
        words = prose(rnd.choice([12, 30, 60]), k).replace("\n", " ").split()
        lines.append(" ".join(words))
        for _ in range(rnd.randint(0, 6)):
            own = list(words)
            for _ in range(rnd.randint(1, 3)):
                own[rnd.randrange(len(own))] = prose(1, rnd.randint(0, 999))
            lines.append(" ".join(own))
    shared = prose(40, 77).replace("\n", " ")  # a passage that lines share without being near
    lines += [shared + " " + prose(40, 500 + k).replace("\n", " ") for k in range(20)]
    rnd.shuffle(lines)
    return ["\n".join(lines[k : k + 7] + ["short", ""]) for k in range(0, len(lines), 7)] + [lines[0]]


def test_classes_equal_all_pairs(spark):
    texts = corpus()
    where, distinct = [], {}
    for d, t in enumerate(texts, 1):
        for n, line in enumerate(t.split("\n")):
            if len(line) >= 10:
                where.append((d, n, distinct.setdefault(line, len(distinct))))
    sets = [full_shingles(x) for x in distinct]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])]
    want = components(len(sets), pairs)
    rows = line_dedup.decided(table(spark, texts)).collect()
    assert len(rows) == len(where)
    got = {(r.doc_id, r.line_no): r for r in rows}
    own: dict[int, int] = {}
    for d, n, x in where:
        own[x] = got[d, n].class_id
        assert own[x] == got[d, n].class_id
    # no class joins what is apart, and of the near pairs hardly one is missed
    assert all(own[a] != own[b] or want[a] == want[b] for a in own for b in own)
    assert sum(own[a] == own[b] for a, b in pairs) >= 0.98 * len(pairs) and len(pairs) > 50
    for c in set(own.values()):
        stays = [(d, n) for (d, n), r in got.items() if r.class_id == c and r.kept]
        assert stays == [min(k for k, r in got.items() if r.class_id == c)]


def test_texts_lose_those_lines_only(spark):
    texts = ["first line here\nshort\nsecond line here", "second line here\nshort\n\nthird line here", "second line here"]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    assert got == {1: texts[0], 2: "short\n\nthird line here", 3: ""}


def test_every_position_is_compared(spark):
    rnd = random.Random(9)
    r = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    lower, han = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这为之大来以个中上们"
    lines = [f"https://{r(lower, 9)}.org/{r(lower, 30)}" for _ in range(20)]  # one prefix
    lines += ["以下是全部内容的" + r(han, 40) for _ in range(20)] + ["/srv/data/" + r("0123456789abcdef", 40) for _ in range(20)]
    lines += ["Andththwhes.", "Andththwhes,", "\u3000" * 12, "😀" * 9 + "abc", "x y z w v u"]
    for base in (lines[0] + r(lower, 60), lines[20] + r(han, 60), r(lower + "é😀", 100), prose(40, 5).replace("\n", " ")):
        lines.append(base)
        for _ in range(6):  # near ones: one character is another
            at = rnd.randrange(len(base))
            lines.append(base[:at] + "Q" + base[at + 1 :])
    rnd.shuffle(lines)
    sets = [full_shingles(x) for x in lines]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(len(lines), pairs)
    got = {r.doc_id: r.class_id for r in line_dedup.decided(table(spark, lines)).collect()}
    own = [got[k] for k in range(1, len(lines) + 1)]
    assert len(set(lines)) == len(lines)
    assert all(own[a] != own[b] or want[a] == want[b] for a in range(len(own)) for b in range(a))
    assert sum(own[a] == own[b] for a, b in pairs) >= 0.98 * len(pairs) and len(pairs) > 40


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 199)] + [(300, k) for k in range(301, 400)] + [(rnd.randrange(500, 900), rnd.randrange(500, 900)) for _ in range(150)] + [(7, 7)]
    want = components(1000, edges)
    got = {r.id: r.root for r in spark_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}


def grouped(spark):
    """A document a line, the near pairs that share a band, and their components."""
    rnd, lines = random.Random(5), set()
    for k, size in enumerate([150, 150] + [3, 6, 12] * 20):  # two groups that take large buckets, and small ones
        base = prose(45, 900 + k).replace("\n", " ")
        for _ in range(size):  # of one group, hardly nearer than the bound and often below
            own = list(base)
            for at in rnd.sample(range(len(own)), rnd.randint(2, 5)):
                own[at] = rnd.choice("QXZJ")
            lines.add("".join(own))
    lines = sorted(lines)
    sets = [full_shingles(x) for x in lines]
    docs = table(spark, lines)
    names = {r.line: (r.key_a, r.key_b) for r in line_dedup.occurrences(docs).select("line", *line_dedup._key()).collect()}
    bands = {(r.key_a, r.key_b): set(r.bands) for r in line_dedup.signatures(docs).collect()}
    bands = [bands[names[x]] for x in lines]
    near = lambda a, b: bands[a] & bands[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    pairs = [(a, b) for a in range(len(lines)) for b in range(a) if near(a, b)]
    want = components(len(lines), pairs)
    return docs, pairs, want


def test_every_near_pair_of_a_bucket_is_linked(spark):
    docs, pairs, want = grouped(spark)
    got = {r.doc_id: r.class_id for r in line_dedup.decided(docs).collect()}
    own = [got[k] for k in range(1, len(want) + 1)]
    assert len(pairs) > 500 and len(set(want)) > 60
    assert [own.index(x) for x in own] == [want.index(x) for x in want]


def test_the_pipeline_keeps_one_line_of_a_component(spark):
    docs, _, want = grouped(spark)
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, None).collect() if r.text}
    assert left == {want.index(x) + 1 for x in want}


def generated(many):
    """Pairs of lines of similarity 0.8 to 0.84: one goes on, or both are cut."""
    rnd, out = random.Random(6), []
    r = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))
    while len(out) < many:
        n = rnd.choice([rnd.randint(20, 400), rnd.randint(800, 1500)])
        a, k = r(n), int((n - 7) * 0.111)
        b = rnd.choice([a + r(int((n - 7) * 0.25)), a[k:] + r(k)])
        x, y = full_shingles(a), full_shingles(b)
        if 0.8 <= len(x & y) / len(x | y) < 0.84:
            out.append((a, b))
    return out


def test_hardly_any_near_pair_shares_no_band(spark):
    pairs = generated(3000)
    docs = table(spark, [x for p in pairs for x in p])
    bands = {r.doc: set(r.bands) for r in line_dedup.signatures(docs).select("doc", "bands").collect()}
    assert sum(not bands[2 * k + 1] & bands[2 * k + 2] for k in range(len(pairs))) <= 6


def test_exact_pairs_need_no_band(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BANDS", line_dedup.BANDS[:2])
    pairs = generated(60)
    docs = table(spark, [x for p in pairs for x in p])
    for exact in (False, True):
        got = {r.doc_id: r.class_id for r in line_dedup.decided(docs, exact=exact).collect()}
        linked = [got[2 * k + 1] == got[2 * k + 2] for k in range(len(pairs))]
        assert all(linked) == exact and len(set(got.values())) == 2 * len(pairs) - sum(linked)
    left = [r.doc_id for r in line_dedup.line_dedup(docs, exact=True).collect() if r.text]
    assert sorted(left) == [2 * k + 1 for k in range(len(pairs))]


def test_lines_with_one_passage_do_not_meet(spark, monkeypatch):
    """300 lines, 15 in 100 of each its own: all pairs share a passage, and hardly any is near."""
    rnd, passage = random.Random(8), prose(60, 31).replace("\n", " ")
    own = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = [passage + own(len(passage) * 18 // 100) for _ in range(300)]
    lines += [x[:-1] + "Q" for x in lines[:40]] + [passage + x[-len(passage) // 10 :] for x in lines[40:60]]
    sets = [full_shingles(x) for x in lines]
    pairs = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    met = []
    meeting = line_dedup._meeting
    monkeypatch.setattr(line_dedup, "_meeting", lambda known: met.append(meeting(known).collect()) or meeting(known))
    rows = saved(spark.createDataFrame(list(enumerate(lines)), "line_id long, line string"), "sets")
    got = line_dedup._by_shingles(rows.selectExpr("line_id", "line_id AS root"), rows).collect()
    assert pairs <= {(r.a, r.b) for r in got} and len(pairs) >= 40
    assert len(met[0]) < 10_000 < 300 * 299 // 2
