"""The pipeline's stages, each against what it got."""

import corpus_pipeline
from quernel.llm import quality

from .helpers import WORD
from .test_simhash import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) in (4, 5)

    ruled = stages["quality_rules"](spark, docs, SF)
    assert {r.doc_id for r in ruled.collect()} == kept and ruled.columns == docs.columns
    lines = stages["line_dedup"](spark, ruled, SF)
    before = {r.doc_id: r.text for r in ruled.collect()}
    after = {r.doc_id: r.text for r in lines.collect()}
    assert set(after) == set(before) and lines.columns == docs.columns
    for k, t in after.items():  # lines only go, in order
        rest = iter((before[k] or "").split("\n"))
        assert not t or all(any(x == y for y in rest) for x in t.split("\n"))

    stays = stages["simhash"](spark, lines, SF)
    prints = {k: brute(t) for k, t in after.items()}
    ids = {r.doc_id for r in stays.collect()}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    assert not any(near(a, b) for a in ids for b in ids if a < b)
    assert all(any(near(k, o) for o in prints if o != k) for k in set(prints) - ids)

    mix = stages["mixing"](spark, stays, SF)
    words = lambda df: sum(len(WORD.findall(r.text or "")) for r in df.collect())
    assert mix.columns == docs.columns and abs(words(mix) - 1.5 * words(stays)) <= 0.1 * words(stays)
    packed = stages["packing"](spark, mix, SF)
    assert packed.where("start = 0").count() == mix.count() and packed.where("length > 4096").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "start", "length"} <= set(out.columns)
