"""Mixing: sizes, targets, flow, and what each document gives."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernel.llm import mixing

from .helpers import WORD, prose, table


def test_targets_reshare_what_is_over():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200.0, "b": pytest.approx(500 / 3), "c": pytest.approx(250 / 3)}
    assert mixing.targets({None: 50, "z": 50}) == {"z": 100.0, None: 50.0}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_flow_repeats_nothing_before_all_was_taken():
    given = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150.0, "b": 40.0})
    assert sum(given.values()) == 190 and all(n <= {("b",): 10}.get(p, 100) for p, n in given.items())
    assert mixing.route({("a",): 10}, {"a": 20.0}) == {("a",): 20}


def test_sources_come_near_their_targets(spark):
    rnd = random.Random(2)
    texts = [prose(rnd.randint(1, 120), k) for k in range(400)]
    df = table(spark, texts).withColumn("source", F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("source")))
    run = lambda d: sorted(tuple(r) for r in mixing.mixed(d).select("m_row.doc_id", "m_row.source", "m_size", "m_source_size", "m_target", "m_taken").collect())
    got = run(df)
    assert got == run(df.repartition(7))
    taken, size = Counter(), Counter()
    for doc, source, n, _, _, t in got:
        assert n == len(WORD.findall(texts[doc - 1])) and t in (0, n, 2 * n)
        taken[source] += t
        size[source] += n
    want = mixing.targets(dict(size))
    assert sum(want.values()) == pytest.approx(1.5 * sum(size.values()))
    for _, source, _, whole, target, _ in got:
        assert whole == size[source] and target == pytest.approx(want[source])
        assert abs(taken[source] - target) <= 0.01 * target + 5
    assert mixing.repeated(df).count() == sum(t // n for _, _, n, _, _, t in got if n)


def test_taken_words_equal_brute_force(spark):
    """The drawing by the definition: whole times, then level by level what still fits in hash order."""
    rnd = random.Random(6)
    texts = [prose(rnd.randint(0, 90), k) for k in range(300)] + [None, ""]
    df = table(spark, texts)
    ranks = [F.pmod(F.xxhash64(F.lit(mixing.SEED + k), F.col("doc_id")), F.lit(mixing.CELLS)) for k in range(mixing.LEVELS)]
    docs = {r.doc_id: (r.source, len(WORD.findall(texts[r.doc_id - 1] or "")), r.ranks) for r in df.select("doc_id", "source", F.array(*ranks).alias("ranks")).collect()}
    size = Counter()
    for source, n, _ in docs.values():
        size[source] += n
    want = {}
    for source, target in mixing.targets(dict(size)).items():
        own = {d: (n, r) for d, (s, n, r) in docs.items() if s == source}
        whole, rest = divmod(round(target), size[source])
        more: set = set()
        for level in range(mixing.LEVELS):
            cells: Counter = Counter()
            open_ = [d for d, (n, _) in own.items() if 0 < n <= rest and d not in more]
            for d in open_:
                cells[own[d][1][level]] += own[d][0]
            upto, edge = 0, -1
            for cell in sorted(cells):
                if upto + cells[cell] > rest:
                    break
                upto, edge = upto + cells[cell], cell
            more |= {d for d in open_ if own[d][1][level] <= edge}
            rest -= upto
        want |= {d: n * (whole + (d in more)) for d, (n, _) in own.items()}
    got = {r.doc_id: r.taken for r in mixing.mixed(df, carry=["doc_id"]).selectExpr("m_row.doc_id", "m_taken AS taken").collect()}
    assert got == want
    assert got == {r.doc_id: r.taken for r in mixing.mixed(df).selectExpr("m_row.doc_id", "m_taken AS taken").collect()}


def test_too_many_combinations_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PATTERNS", 2)
    with pytest.raises(ValueError, match="combinations"):
        mixing.mixed(table(spark, ["a", "b", "c"]))


def test_overlapping_sources(spark):
    df = table(spark, [prose(20, k) for k in range(60)])
    out = mixing.mixed(df, member=F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))).collect()
    assert {tuple(r.m_pattern) for r in out} == {("x",), ("x", "y")} and all(r.m_taken <= 2 * r.m_size for r in out)
