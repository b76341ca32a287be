"""A training corpus in five stages, each written as Parquet and read again by the next.

Quality rules drop documents; line dedup takes repeated lines out of their texts; of each group
of SimHash near-duplicates one document stays; documents are mixed to their sources' targets,
some more than once; packing returns the pieces that fill the training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import line_dedup, mixing, packing, quality, simhash
from quernel.llm.common import dropped, saved, table

#: Words that a packing worker remembers: fewer than by default, beside the memory that earlier stages left in use.
WORDS = 200_000
STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: quality.filtered(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: line_dedup.line_dedup(docs)),
    ("simhash", lambda spark, docs, sf_dir: simhash.deduplicated(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.repeated(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack(docs, remembered=WORDS)),
]

#: The quality model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = saved(docs, name)
            if before is not None:
                dropped(before)  # the stage after it has been written
            before = docs
    return docs
