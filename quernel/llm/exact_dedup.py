"""Exact deduplication by an extendible-hash index on shared files (native).

Texts are equal when their UTF-8 bytes are; null counts as the empty text.  Of equal
texts the row with the largest doc_id stays.

The directory maps the first bits of a text's 64-bit hash to a bucket.  It starts as one slot
with one bucket; an overfull bucket splits in two, and where a bucket gets deeper than the
directory, the directory doubles.  Copies are combined within every input split before anything
moves.  Then each text goes through the directory to its bucket and with that to the
bucket's owner: a task that has a range of buckets, sorts its texts by hash and bytes and walks
through them.  Texts of one hash form a chain, in which every text is compared with the one
before, byte by byte; a run of equal ones is an entry of the index, with its copies counted and
the doc_id that stays.  The written index answers for every row.

Null doc_ids take part in the counts and never stay unless a whole group has none (its
``keep_id`` is null, nothing in it is kept).  Rows that repeat doc_id and text together are
one document: all of them carry the same verdict.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, looked_up, partitions, saved, table

#: The histogram of hashes that the directory grows over has 2 ** FINEST cells.
FINEST = 16
#: Distinct hashes that a bucket holds before it splits; owners sort and spill, so this is no limit of memory.
CAPACITY = 4096


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _cell(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - FINEST)


def capacity_for(total: int, capacity: int = CAPACITY) -> int:
    """The capacity itself, or as much as lets buckets of ``total`` hashes stay well above one cell."""
    return max(capacity, -(-total // (1 << (FINEST - 3))))


def directory(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[int, list[tuple[int, int]]]:
    """The directory's depth, and for each of its 2 ** depth slots its bucket: (first cell, bucket's depth).

    A bucket that is one cell does not split.
    """
    sums = [0]
    for cell in range(1 << FINEST):
        sums.append(sums[-1] + histogram.get(cell, 0))
    depth, slots, overfull = 0, [(0, 0)], [(0, 0)]
    while overfull:
        bucket = first, own = overfull.pop()
        wide = 1 << (FINEST - own)
        if own == FINEST or sums[first + wide] - sums[first] <= capacity:
            continue
        if own == depth:  # no slot of its own for either half
            depth, slots = depth + 1, [b for b in slots for _ in (0, 1)]
        halves = (first, own + 1), (first + wide // 2, own + 1)
        at = first >> (FINEST - depth)
        many = 1 << (depth - own)
        assert slots[at] == bucket
        slots[at : at + many] = [halves[0]] * (many // 2) + [halves[1]] * (many // 2)
        overfull += halves
    return depth, slots


def build_index(docs: DataFrame, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The index as written: bucket, depth, h, chain, text_sha256, keep_id, group_size.

    ``hashed`` gives a text's hash; a poor one only makes chains longer.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", hashed(_text()).alias("h"), _text().alias("text"), F.spark_partition_id().alias("part"))
    found = docs.select(hashed(_text()).alias("h")).distinct().groupBy(_cell(F.col("h")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.cell: r.n for r in found.collect()}  # 2 ** FINEST cells at most
    depth, slots = directory(histogram, capacity_for(sum(histogram.values()), capacity))
    owners = partitions(spark)
    ranks = {b: k for k, b in enumerate(sorted(set(slots)))}
    # the first bits of the hash as a number; every owner has a range of buckets
    table_ = spark.createDataFrame([(k, b[0], b[1], ranks[b] * owners // len(ranks)) for k, b in enumerate(slots)], "slot long, bucket long, depth int, owner int")
    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    combined = rows.groupBy("part", "h", "text").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    routed = combined.withColumn("slot", slot).join(F.broadcast(table_), "slot").repartition(owners, "owner")
    chain = Window.partitionBy("owner", "bucket", "h").orderBy("text")
    fresh = F.coalesce((F.lag("text").over(chain) != F.col("text")).cast("int"), F.lit(0))
    walked = routed.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    # only the number in the chain names a text from here on
    walked = walked.select("owner", "bucket", "depth", "h", "chain", F.sha2("text", 256).alias("text_sha256"), "top", "n")
    entries = walked.groupBy("owner", "bucket", "depth", "h", "chain").agg(F.max("text_sha256").alias("text_sha256"), F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    return saved(entries.drop("owner"), "index")


def chains(index: DataFrame) -> DataFrame:
    """Hashes that more than one text has, with the texts' SHA-256 in the order of the chain."""
    found = index.groupBy("bucket", "h").agg(F.transform(F.sort_array(F.collect_list(F.struct("chain", "text_sha256"))), lambda x: x["text_sha256"]).alias("chain"))
    return found.where(F.size("chain") > 1)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Hashes that only one row has need no look into the index.
    """
    rows = docs.select("doc_id", hashed(_text()).alias("h"), F.sha2(_text(), 256).alias("text_sha256"))
    index = build_index(docs, capacity, hashed)
    # two 64-bit numbers stand for the digest in the lookup
    shared = index.where("group_size > 1").select("h", F.xxhash64("text_sha256").alias("d"), "keep_id", "group_size")
    shared = saved(shared, "shared")
    dropped(index)
    out = looked_up(rows.withColumn("d", F.xxhash64("text_sha256")), shared, ["h", "d"], "group_size")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"), "text_sha256",
    )


def query(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, false) AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
