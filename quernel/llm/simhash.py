"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are linked at three or fewer differing bits.  Of the two halves of
such a pair one differs in at most one bit.  Each half is covered by the perfect Hamming code
of length 31 (covering radius 1) and one bit more: its codewords are the anchors.  A
fingerprint goes home to the one anchor within the covering radius of its half, and a copy of
it to every anchor within radius plus threshold, 1 + 1; so of a pair within the threshold each
finds the other at its home.  At each anchor homes are compared with copies, all 64 bits.

Equal fingerprints are one node, however many rows share them.  An anchor with many homes is
split over tasks.  A task passes on only edges that join what it had not joined before, so a
dense group sends about one edge a member and loses no link.

Texts: null counts as empty; without words the fingerprint is zero and is linked like any
other.  Fewer words than a shingle make one shingle.  Repeated rows share a component; rows
with a null doc_id count as members but give no component its name (null if it has no other).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dropped, freeing, looked_up, partitions, saved, slices, table

WIDTH = 3
SEED = 42
#: Differing bits at which fingerprints still link; the halves' anchors suit up to this.
THRESHOLD = 3
#: Homes of an anchor that one task compares with the copies there.
CHUNK = 4096
#: Pairs compared at once.
BLOCK = 1 << 21


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles, repeats counted, as an unsigned number."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < WIDTH:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip((end - size)[: n - WIDTH + 1].tolist(), end[WIDTH - 1 :].tolist(), strict=True)]
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def _prints(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        fp = np.array([fingerprint(t) for _, texts in slices(batch, 1) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(fp)], ["doc_id", "key_a", "key_b", "fp"])


def _key() -> list[Column]:
    """128 bits that name a text."""
    own = F.coalesce("text", F.lit(""))
    return [F.xxhash64(own).alias("key_a"), F.xxhash64(F.lit(7), own).alias("key_b")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the text's key and fp (signed 64 bits), a row each; one pass, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", *_key())
    return rows.mapInArrow(lambda it: freeing(_prints(it)), "doc_id long, key_a long, key_b long, fp long")


def _syndrome(half):
    """The position (1 to 31) whose flip gives a codeword, or 0: xor of the set positions."""
    import numpy as np

    s = np.zeros(half.shape, np.int64)
    for bit in range(31):
        s ^= np.where((half >> np.int64(bit)) & 1, bit + 1, 0)
    return s


def _codeword(half):
    import numpy as np

    s = _syndrome(half)
    return half ^ np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)


def _replicas(batches: Iterator) -> Iterator:
    """(anchor, role, fp): role 0 at home, 1 at the other anchors in reach."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for lo in range(0, batch.num_rows, 20_000):
            fp = batch.column(0).slice(lo, 20_000).to_numpy(zero_copy_only=False)
            for side in (0, 1):
                half = (fp >> np.int64(32 * side)) & np.int64(0xFFFFFFFF)
                near = np.stack([half, *(half ^ np.int64(1 << bit) for bit in range(32))])
                # 31 bits in the code, the 32nd beside it; the anchors of all halves one flip away
                keys = (_codeword(near & np.int64(0x7FFFFFFF)) | (near & np.int64(0x80000000))) | np.int64(side << 32)
                keys = np.sort(keys[1:], axis=0), keys[0]
                fresh = np.vstack([np.ones((1, len(fp)), bool), keys[0][1:] != keys[0][:-1]])
                at = np.nonzero(fresh)
                anchor = np.concatenate([keys[1], keys[1], keys[0][at]])
                role = np.concatenate([np.zeros(len(fp), np.int8), np.ones(len(fp) + len(at[0]), np.int8)])
                own = np.concatenate([fp, fp, fp[at[1]]])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(role), pa.array(own)], ["anchor", "role", "fp"])


def _compare(batches: Iterator, threshold: int) -> Iterator:
    """Edges between homes and copies of the same (anchor, part); rows come sorted by these and role."""
    import numpy as np
    import pyarrow as pa

    held = None  # homes of the group that the last batch ended in
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        anchor, part, role, fp = cols
        new = np.empty(len(fp), bool)
        new[0] = True
        new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        homes = np.add.reduceat((role == 0).astype(np.int64), start)
        last = slice(start[-1], start[-1] + homes[-1])
        held = [c[last].copy() for c in cols] if homes[-1] else None
        copies = np.flatnonzero(role == 1)
        width = homes[group[copies]]
        copies, width = copies[width > 0], width[width > 0]
        ends, parent, out = np.cumsum(width), {}, ([], [])

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        at = 0
        while at < len(copies):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            w = width[at:upto]
            mine = np.repeat(copies[at:upto], w)
            step = np.arange(len(mine)) - np.repeat(np.cumsum(w) - w, w)
            theirs = start[group[mine]] + step
            a, b = fp[mine], fp[theirs]
            hit = np.flatnonzero((np.bitwise_count((a ^ b).view(np.uint64)) <= threshold) & (a != b))
            for x, y in zip(a[hit].tolist(), b[hit].tolist(), strict=True):
                if (p := root(x)) != (q := root(y)):
                    parent[p] = q
                    out[0].append(x)
                    out[1].append(y)
            at = upto
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])


def links(classes: DataFrame, threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect all of ``classes (fp)`` within ``threshold`` bits of each other."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors cover up to three differing bits")
    spark = classes.sparkSession
    rows = classes.select("fp").mapInArrow(_replicas, "anchor long, role byte, fp long")
    hot = classes.select("fp").mapInArrow(_homes, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    hot = saved(hot.select("anchor", F.ceil(F.col("n") / chunk).cast("int").alias("parts")), "hot")
    rows = rows.join(hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # homes are dealt over the parts, copies go to each
    own = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("anchor", F.explode(own).alias("part"), "role", "fp")
    rows = rows.repartition(partitions(spark), "anchor", "part").sortWithinPartitions("anchor", "part", "role")
    return rows.mapInArrow(lambda it: freeing(_compare(it, threshold)), "a long, b long")


def _homes(batches: Iterator) -> Iterator:
    for batch in _replicas(batches):
        yield batch.filter(_is_home(batch)).select(["anchor"])


def _is_home(batch):
    import pyarrow.compute as pc

    return pc.equal(batch.column(1), 0)


def _members(docs: DataFrame, threshold: int, chunk: int) -> DataFrame:
    """doc_id, the text's key, fp, the component's ``root`` (a fingerprint) and its least doc_id, a row each."""
    prints = saved(fingerprints(docs), "prints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "classes")
    found = components(links(classes, threshold, chunk))
    named = looked_up(classes, found.withColumnRenamed("id", "fp"), ["fp"]).withColumn("root", F.coalesce("root", "fp"))
    named = saved(named, "named")
    least = saved(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps")), "least")
    names = saved(looked_up(named.select("fp", "root", "rows"), least, ["root"], "fps").drop("fps"), "names")
    dropped(classes, found, named, least)
    return looked_up(prints, names, ["fp"], "rows").drop("rows")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    out = _members(docs, threshold, chunk)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the least doc_id stays.

    Where several rows of a component have this doc_id, the one whose text has the least hash
    stays, and of equal rows one.  Different texts under one doc_id are different documents.
    Rows without a doc_id cannot be named and stay as they are.  Those that go are looked up;
    those that stay are not shuffled.
    """
    key = ["s_id", "key_a", "key_b"]
    rows = saved(_members(docs, THRESHOLD, CHUNK).where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "s_id"), "members")
    groups = saved(rows.groupBy("root", *key).agg(F.max("component_id").alias("component_id"), F.count(F.lit(1)).alias("copies")), "groups")
    keep = groups.where("s_id = component_id").groupBy("root").agg(F.min(F.struct(*key)).alias("keep"))
    keep = keep.select(*[F.col(f"keep.{k}").alias(k) for k in key], F.lit(True).alias("stays"))
    # what a row's key must be looked up for: it goes, or only one of its copies stays
    marked = groups.join(keep, key, "left").withColumn("stays", F.coalesce("stays", F.lit(False))).where("NOT stays OR copies > 1")
    marked = saved(marked.select(*key, "copies", "stays"), "marked")
    dropped(rows, groups)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("s_row"), F.col("doc_id").cast("long").alias("s_id"), *_key())
    found = looked_up(row, marked, key, "copies")
    one = Window.partitionBy(*key).orderBy(F.xxhash64("s_row"))
    copies = found.where("stays").withColumn("s_no", F.row_number().over(one)).where("s_no = 1")
    return found.where("stays IS NULL").select("s_row.*").union(copies.select("s_row.*"))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
