"""Packing by power-of-two decomposition.

A document of n tokens (its text's ids, then the closing id 2) is cut into the pieces of
n's binary form: as many of ``limit`` tokens as fit, then one piece for each set bit of the
rest, longest first.  Every piece is a sequence by itself, so no sequence crosses documents
and, all lengths being powers of two, none is padded.  Sequences of one length form a
bucket, from which batches of equal shape are drawn.

A null or empty text gives the closing id alone (one piece of length 1); repeated rows are
separate documents; a null doc_id is carried through; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, table
from .vocab import REMEMBERED

LIMIT = 4096
CLOSING = 2


def pieces(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` tokens."""
    out, at = [], 0
    while n - at >= limit:
        out.append((at, limit))
        at += limit
    bit = limit >> 1
    while at < n:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def _cut(batches: Iterator, tokenizer: str, limit: int, with_ids: bool, remembered: int) -> Iterator:
    import zlib

    import pyarrow as pa

    from .vocab import word_ids

    words, close = word_ids(tokenizer, remembered), CLOSING.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            cols: list[list] = [[] for _ in names]
            for doc, ids in zip(part.column(0).to_pylist(), words.batch(part.column(1).to_pylist()), strict=True):
                ids += close
                n = len(ids) // 4
                for start, length in pieces(n, limit):
                    own = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (doc, start, length, zlib.crc32(own), n, own)[: len(names)], strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
    if remembered < REMEMBERED:  # memory is short: the worker's next task may be another stage's
        word_ids.cache_clear()


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset, bucket.

    One pass without a shuffle.  ``sequence_id`` derives from the piece's place in its input
    split, which a rerun of a lost task finds again.  ``limit`` must be a power of two.
    ``remembered`` words are kept in a worker's memory, some 200 bytes each, and with fewer than by
    default only until a task ends; results do not depend on it.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(lambda it: freeing(_cut(it, tokenizer, limit, with_ids, remembered)), schema)
    # the place of a row within its split; Spark keeps it for tasks that run again
    return rows.withColumns({
        "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
        "bucket": F.log2("length").cast("int"),
    })


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences, one folder for each length, long buckets over many files."""
    packed.write.partitionBy("bucket").parquet(path)


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
