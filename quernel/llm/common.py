"""What the operators share: reading tables, the shared folder, lookups, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers each (some 50 bytes as a hash table) that may be sent to every executor.
SENT = 1_000_000
#: For tables written to a local folder: without checksum files, each of which has Hadoop start a further ``chmod`` and so
#: fork the executor.  Other stores do not read these options.
_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Spark's own setting by which a query's shuffle files go when it has ended, not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key is hot when one row in so many has it; that many keys can be hot at most.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, read by Spark whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine takes a folder of its own; on a cluster no
    folder can be guessed, and that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='quernel-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there.

    A lost executor costs no recomputation of what came before, and rows keep their
    order within files, so that ids derived from file positions stay as they are.  What was shuffled
    on the way is deleted at once: nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.options(**_LOCAL).parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch, column: int, rows: int = 500) -> Iterator:
    """Parts of an Arrow batch with the texts of a column, so that few are held as Python strings at once."""
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        yield part, part.column(column).to_pylist()


def freeing(batches: Iterator) -> Iterator:
    """The batches; after the last one the worker, which goes on to other tasks, gives unused memory back."""
    yield from batches
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], weight: str | None = None, length: str | None = None) -> DataFrame:
    """``rows`` with the other columns of ``found`` (saved, one row a key), null for keys not in it.

    Up to SENT keys (or, with ``length``, numbers in the lists that it counts) are sent to all executors.  Beyond that both sides are dealt by key, but
    hot keys (``weight`` says how many rows have one) are sent and their rows dealt by the whole
    row, so that none of them fills a task.
    """
    size = found.agg(F.count(F.lit(1)) + (F.sum(length) if length else F.lit(0))).first()[0] or 0
    if size <= SENT:
        return rows.join(F.broadcast(found), keys, "left")
    if weight is None:
        return rows.join(found, keys, "left")
    bar = found.agg(F.sum(weight)).first()[0] // HOT
    rest = [c for c in found.columns if c not in keys]
    few = found.where(F.col(weight) > bar).select(*keys, F.struct(*rest).alias("few_"))
    many = found.where(F.col(weight) <= bar).select(*[F.col(k).alias(f"many_{k}") for k in keys], F.struct(*rest).alias("many_"))
    out = rows.join(F.broadcast(few), keys, "left")
    dealt = F.when(F.col("few_").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*rows.columns))
    out = out.withColumn("deal_", dealt)
    on = F.col("deal_") == F.col(f"many_{keys[0]}")
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"many_{k}"))
    return out.join(many, on, "left").select(*rows.columns, *[F.coalesce(f"few_.{c}", f"many_.{c}").alias(c) for c in rest])


def components(edges: DataFrame, rounds: int = 80) -> DataFrame:
    """Connected components of ``edges (a long, b long)`` as ``(id, root)``, saved.

    Distributed union-find by alternating large stars (neighbours above a node move to the
    least neighbour) and small stars (those below do); each keeps components as they are,
    and what is left when nothing moves is one star around the smallest id of each.  The
    number of edges never grows.  Minima are combined before the shuffle, and the lookup of a
    node's minimum deals the edges of a hub over all tasks, so no group is held by one.  Ids
    without an edge to another are not returned.
    """
    stars = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = _sum(stars)
    for _ in range(rounds):
        if not before[0]:
            break
        both = stars.union(stars.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("w"))
        if before[0] > SENT:
            least = saved(least, "least")
        large = _minimum(both.where("v > u"), least, "u", before[0]).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "stars")
        least2 = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("w"))
        if before[0] > SENT:
            least2 = saved(least2, "least")
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = _minimum(large, least2, "a", before[0]).select(F.explode(pairs).alias("e"))
        new = saved(small.select("e.a", "e.b").where("a <> b").distinct(), "stars")
        dropped(stars, large, *([least, least2] if before[0] > SENT else []))
        stars, now = new, _sum(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: edges still move after the last round")
    members = stars.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = saved(members.union(members.select(F.col("root").alias("id"), "root").distinct()), "roots")
    dropped(stars)
    return out


def _minimum(rows: DataFrame, least: DataFrame, key: str, edges: int) -> DataFrame:
    """Each edge with its node's minimum ``m``; there are no more nodes than twice the edges."""
    if edges <= SENT:
        return rows.join(F.broadcast(least), key)
    return looked_up(rows, least, [key], "w")


def _sum(stars: DataFrame) -> tuple:
    """A checksum of a set of edges."""
    return tuple(stars.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(pmod(xxhash64(b, a), 1000003))")).first())
