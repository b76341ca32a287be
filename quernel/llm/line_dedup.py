"""Line dedup by MinHash: near-equal lines form components, one line of each stays (native).

A line is what stands between line feeds; lines of fewer than MIN_CHARS characters are left
alone.  Equal lines are one node, told apart by two independent 64-bit hashes (for 10 ** 12
different lines the odds of any confusion are below 10 ** -14).  A line's set are the SHINGLE characters from every
position of it; lines are near when the Jaccard similarity of their sets is SIMILAR or more.

Signatures.  The hash of every shingle falls into one of BINS equal ranges, and the least hash of
each range is a minimum (one permutation, binned); an empty range takes the minimum of the next
one.  A range's minimum mostly lies near its lower end, so that of a long line only the part of
each range where DENSE hashes are expected is looked at.  BANDS take four minima each: neighbours
(in a short line these are the same shingle more often than not) and four that lie apart.  Of 60,000
generated pairs of similarity 0.80 to 0.84 (tails, cuts, other characters, short and long lines) 22
shared no band.  Such a pair is left out where no other line links its two, unless ``exact`` is asked for.

Verification.  Every two lines that share a band's bucket are compared, unless they are linked
already.  First each line is compared with the bucket's centre, the member with the most copies,
and in a bucket of more than FEW with its neighbour in an order by its other bands; most groups
are components after that, and no pairs within them are listed.  In the buckets that still hold
lines of several components, all pairs of different components follow: up to FEW members they
are listed; members of larger ones are paired by rare shingles (prefix filter: sets in one order of
shingles, the rarest first, share one of their first 1 - SIMILAR if they are near), which leaves out
no near pair either.  So the components are those of all near pairs that share a band.  With
``exact`` the prefix filter pairs all lines there are, whatever bands they share, and the components are
those of all near pairs; every shingle of every line is then listed and shuffled.
Comparisons are exact, by 64-bit hashes of all shingles of the two lines (odds of any confusion in a pair
of 1,000 characters: 10 ** -13), unless bitmaps of their shingles already prove two lines apart.

The line that stays is the first one of its component in the document with the least doc_id (of
different texts under this doc_id, in the one with the least hash).  Rows with equal doc_id and
text are decided alike; a null doc_id comes after all others; null texts have no lines; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dropped, looked_up, saved, table

MIN_CHARS = 10
SHINGLE = 8
SIMILAR = 0.8
BINS, DENSE = 32, 3
#: Which minima make a band: eight rows of neighbours, and twice eight of one out of every quarter.
BANDS = [[4 * k + j for j in range(4)] for k in range(BINS // 4)] + [[BINS // 4 * j + (k + turn * j) % (BINS // 4) for j in range(4)] for turn in (0, 1) for k in range(BINS // 4)]
#: 64-bit words of the bitmap of a line; a power of two.
WORDS = 32
#: Members of a bucket that one task puts in order, about.
PART = 4096
#: Members of a bucket of which pairs are listed; beyond that rare shingles pair them.
FEW = 32
_LAST = (1 << 63) - 1
KEY = ["key_a", "key_b"]
# Lists are unfolded by the outer form throughout: for the plain one the optimizer infers a filter
# that lists everything a second time.


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, line of every line that takes part."""
    # the hash in a step of its own: beside the generator it would be computed for every line
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    lines = rows.select("doc_id", "text_hash", F.posexplode_outer(F.split(F.col("text"), "\n", -1)).alias("line_no", "line"))
    return lines.where(F.length("line") >= MIN_CHARS)


def _key() -> list[Column]:
    """128 bits that name a line; the constant in front makes the second hash another function."""
    return [F.xxhash64("line").alias("key_a"), F.xxhash64(F.lit(7), F.col("line")).alias("key_b")]


def _doc() -> Column:
    return F.coalesce("doc_id", F.lit(_LAST)).alias("doc")


def signatures(docs: DataFrame) -> DataFrame:
    """key_a, key_b, copies, the least ``doc`` and the ``bands`` of every different line.

    One shuffle of fixed-width rows: shingles and copies of a line are both reduced before it.
    UTF-16 makes every character two bytes (those beyond 65,535 count as two characters here), so
    that cutting a shingle does not walk the line.
    """
    wide = occurrences(docs).select(_doc(), *_key(), F.encode("line", "UTF-16BE").alias("wide"))
    wide = wide.withColumn("last", F.expr(f"CAST(length(wide) - {2 * SHINGLE - 1} AS INT)"))
    wide = wide.withColumn("room", F.expr(f"CAST({1 << 32}D * least(1D, {2 * BINS * DENSE}D / (last + 1)) AS BIGINT)"))
    spread = wide.select("doc", *KEY, "wide", "room", F.explode_outer(F.expr("sequence(1, last, 2)")).alias("i"))
    # 63 bits; the upper 32 of them, times BINS, are the range (above) and the place in it (below)
    hashed = spread.select("doc", *KEY, "room", "i", F.expr(f"shiftrightunsigned(xxhash64(substring(wide, i, {2 * SHINGLE})), 1)").alias("h"))
    at = f"(shiftrightunsigned(h, 31) * {BINS}L)"
    # the first shingle always counts, so that no line is lost and copies can be counted by it
    near = hashed.where(f"i = 1 OR ({at} & {(1 << 32) - 1}L) < room").withColumn("bin", F.expr(f"shiftright({at}, 32)"))
    mins = [F.min(F.expr(f"IF(bin = {k}, h, CAST(NULL AS BIGINT))")).alias(f"m{k}") for k in range(BINS)]
    out = near.groupBy(*KEY).agg(F.min("doc").alias("doc"), F.sum(F.expr("IF(i = 1, 1L, 0L)")).alias("copies"), *mins)
    # an empty range takes the next one's; step by step, so that the compiled code stays small
    out = out.withColumn(f"f{BINS}", F.coalesce(*[f"m{k}" for k in range(BINS)]))
    for k in reversed(range(BINS)):
        out = out.withColumn(f"f{k}", F.coalesce(f"m{k}", f"f{k + 1}"))
    return out.select(*KEY, "doc", "copies", F.array(*[F.xxhash64(F.lit(k), *[f"f{m}" for m in band]) for k, band in enumerate(BANDS)]).alias("bands"))


def _numbered(signed: DataFrame) -> DataFrame:
    """With ``line_id``, unique once it is written; the more copies, the lower."""
    rank = F.lit(31) - F.least(F.floor(F.log2("copies")), F.lit(31))
    return signed.withColumn("line_id", F.shiftleft(rank.cast("long"), 57).bitwiseOR(F.monotonically_increasing_id()))


def _set(line: str) -> str:
    """Hashes of the line's shingles, repeats included; UTF-32 makes every character four bytes."""
    at = f"sequence(1, length(w) - {4 * SHINGLE - 1}, 4)"
    return f"transform(array(encode({line}, 'UTF-32')), w -> transform({at}, i -> xxhash64(substring(w, i, {4 * SHINGLE}))))[0]"


def _unproven() -> Column:
    """Whether bitmaps (n_a, b0_a, ... of one line, n_b, b0_b, ... of the other) leave it open that two lines are near.

    A bit in which they differ stands for a shingle that only one of the lines has, and near sets
    differ in (1 - SIMILAR) / (1 + SIMILAR) of their sizes' sum at most.
    """
    differ = " + ".join(f"bit_count(b{w}_a ^ b{w}_b)" for w in range(WORDS))
    return F.expr(f"{differ} <= {(1 - SIMILAR) / (1 + SIMILAR)}D * (n_a + n_b) + 1e-6D")


def _beside(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` with the columns of ``rows (line_id, ...)`` for both lines, marked _a and _b."""
    for k in "ab":
        pairs = pairs.join(_sided(rows, k).withColumnRenamed(f"line_id_{k}", k), k)
    return pairs


def _open(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) that bitmaps do not prove apart."""
    return _beside(pairs, maps).where(_unproven()).select("a", "b")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    # each side's shingles are listed once, outside the inner function
    share = "size(array_intersect(z.x, z.y)) / size(array_union(z.x, z.y))"
    similar = f"transform(array(named_struct('x', {_set('line_a')}, 'y', {_set('line_b')})), z -> {share})[0]"
    return _beside(pairs, sets).where(f"{similar} >= {SIMILAR}D - 1e-9D").select("a", "b")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """line_id and line of each line of ``wanted (key_a, key_b, doc, line_id)`` (saved)."""
    rows = occurrences(docs).select(_doc(), *_key(), "line")
    # a line is read from the document that it stays in
    rows = looked_up(rows, wanted.select(*KEY, F.col("doc").alias("own"), "line_id"), KEY).where("doc = own")
    return saved(rows.groupBy("line_id").agg(F.any_value("line").alias("line")), "sets")


def _maps(sets: DataFrame) -> DataFrame:
    """line_id, the number ``n`` of positions, and a bitmap of the shingles in WORDS columns (saved)."""
    wide = sets.select("line_id", F.encode("line", "UTF-32").alias("wide"))
    spread = wide.select("line_id", "wide", F.explode_outer(F.expr(f"sequence(1, length(wide) - {4 * SHINGLE - 1}, 4)")).alias("i"))
    hashed = spread.select("line_id", F.expr(f"xxhash64(substring(wide, i, {4 * SHINGLE}))").alias("h"))
    bits = hashed.select("line_id", F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit"), F.expr(f"shiftrightunsigned(h, 6) & {WORDS - 1}").alias("word"))
    words = [F.expr(f"bit_or(IF(word = {w}, bit, 0L))").alias(f"b{w}") for w in range(WORDS)]
    return saved(bits.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), *words), "maps")


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns])


def _candidates(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a bucket: each with the centre, the least line_id, and in a large bucket with the one before it in order.

    Members are in order by what other bands say, so that those with most bands in common stand
    side by side.  A large bucket is dealt by the first of these, at about PART members a task.
    """
    centres = saved(members.groupBy("bucket").agg(F.min("line_id").alias("centre"), F.count(F.lit(1)).alias("m")), "centres")
    rows = looked_up(members, centres, ["bucket"], "m").where("m > 1")
    large = rows.where(F.col("m") > FEW).withColumn("part", F.pmod(F.col("next"), F.ceil(F.col("m") / PART)))
    before = F.lag("line_id").over(Window.partitionBy("bucket", "part").orderBy("next", "after", "line_id"))
    both = rows.select("line_id", F.col("centre").alias("other")).union(large.select("line_id", before.alias("other"))).where("other <> line_id")
    out = saved(both.select(F.least("line_id", "other").alias("a"), F.greatest("line_id", "other").alias("b")).distinct(), "pairs")
    dropped(centres)
    return out


def _apart(members: DataFrame, roots: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that may be near and lie in different components of ``roots``, of every bucket that has some, without ``pairs`` (saved)."""
    rows = looked_up(members.select("bucket", "line_id"), roots.withColumnRenamed("id", "line_id"), ["line_id"])
    rows = saved(rows.withColumn("root", F.coalesce("root", "line_id")), "rooted")
    mixed = saved(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").drop("lo", "hi"), "mixed")
    left = saved(looked_up(rows, mixed, ["bucket"], "m").where("m IS NOT NULL"), "left")
    few = left.where(F.col("m") <= FEW).drop("m")
    few = _sided(few, "a").join(_sided(few, "b"), F.expr("bucket_a = bucket_b AND line_id_a < line_id_b AND root_a <> root_b"))
    few = few.select(F.col("line_id_a").alias("a"), F.col("line_id_b").alias("b"))
    many = saved(left.where(F.col("m") > FEW).select("line_id", "root").distinct(), "many")
    out = few
    if not many.isEmpty():
        out = few.union(_by_shingles(many, sets))
    out = saved(out.distinct().join(pairs, ["a", "b"], "left_anti"), "apart")
    dropped(rows, mixed, left, many)
    return out


def _anywhere(signed: DataFrame, roots: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Like ``_apart``, of all lines instead of those of a bucket (saved)."""
    rows = looked_up(signed.select("line_id"), roots.withColumnRenamed("id", "line_id"), ["line_id"])
    rows = saved(rows.withColumn("root", F.coalesce("root", "line_id")), "rooted")
    out = saved(_by_shingles(rows, sets).join(pairs, ["a", "b"], "left_anti"), "apart")
    dropped(rows)
    return out


def _by_shingles(lines: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``lines (line_id, root)`` of different roots, all that are near among them.

    Near sets share SIMILAR of each, so in one order of all shingles they share one of the first
    n - SIMILAR * n + 1 of each, and among two sets of known sizes in fewer: of equal sizes, in the
    first ninth.  The rarest come first.  In the list of a shingle only members that
    are not of its most frequent root are joined with the others.
    """
    least = SIMILAR - 1e-9
    listed = sets.join(lines, "line_id").select("line_id", "root", F.explode_outer(F.expr(f"array_distinct({_set('line')})")).alias("h"))
    listed = saved(listed, "listed")
    lists = saved(listed.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")), "lists")
    line = Window.partitionBy("line_id")
    first = looked_up(listed, lists, ["h"], "m").withColumn("n", F.count(F.lit(1)).over(line)).withColumn("place", F.row_number().over(line.orderBy("m", "h")))
    first = first.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1).where("lo <> hi")
    first = saved(first.select("h", "line_id", "root", "n", "place"), "first")
    most = first.groupBy("h", "root").agg(F.count(F.lit(1)).alias("w")).groupBy("h").agg(F.max_by("root", "w").alias("most"), F.sum("w").alias("m"))
    most = saved(most, "most")
    known = saved(looked_up(first, most, ["h"], "m").drop("m"), "known")
    out = saved(_meeting(known).distinct(), "shingled")
    dropped(listed, lists, first, most, known)
    return out


def _meeting(known: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a shingle of ``known (h, line_id, root, n, place, most)`` early enough to be near; one row a shingle."""
    # of a pair outside the most frequent root the one with the lower line_id looks for the other
    near = "h_a = h_b AND root_a <> root_b AND (root_b = most_b OR line_id_a < line_id_b)"
    # sets of these sizes share so many if they are near, and the first one shared has all of them from its place on, in both
    share = f"{(SIMILAR - 1e-9) / (1 + SIMILAR - 1e-9)}D * (n_a + n_b) - 1e-6D"
    near += f" AND n_a - place_a + 1 >= {share} AND n_b - place_b + 1 >= {share}"
    both = _sided(known.where("root <> most"), "a").join(_sided(known, "b"), F.expr(near))
    return both.select(F.least("line_id_a", "line_id_b").alias("a"), F.greatest("line_id_a", "line_id_b").alias("b"))


def classes(docs: DataFrame, exact: bool = False) -> DataFrame:
    """key_a, key_b, copies, root, class_id and keep_doc of every line that has a copy or a near line (saved).

    With ``exact`` near pairs that share no band are found too.
    """
    signed = saved(_numbered(signatures(docs)), "signed")
    keys = signed.select("line_id", "bands", F.posexplode_outer("bands").alias("k", "bucket"))
    other = [F.get("bands", (F.col("k") + d) % len(BANDS)).alias(n) for d, n in ((1, "next"), (2, "after"))]
    keys = keys.select("line_id", "bucket", *other)
    shared = saved(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    members = saved(looked_up(keys, shared, ["bucket"], "m").where("m IS NOT NULL").select("bucket", "line_id", "next", "after"), "members")
    wanted = saved((signed if exact else members).select("line_id").distinct().withColumn("one", F.lit(1)), "wanted")
    named = looked_up(signed.select("line_id", *KEY, "doc"), wanted, ["line_id"]).where("one IS NOT NULL").drop("one")
    named = saved(named, "named")
    sets = _texts(docs, named)
    maps = _maps(sets)
    pairs = _candidates(members)
    near = saved(_near(_open(pairs, maps), sets), "near")
    first = components(near)
    apart = _anywhere(signed, first, sets, pairs) if exact else _apart(members, first, sets, pairs)
    late = saved(_near(_open(apart, maps), sets), "near")
    roots = components(first.select(F.col("id").alias("a"), F.col("root").alias("b")).union(late))
    every = looked_up(signed.select("line_id", *KEY, "doc", "copies"), roots.withColumnRenamed("id", "line_id"), ["line_id"])
    every = saved(every.where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "line_id")), "every")
    keep = saved(every.groupBy("root").agg(F.min("doc").alias("keep_doc"), F.min("key_a").alias("class_id"), F.count(F.lit(1)).alias("w")), "keep")
    out = saved(looked_up(every.select(*KEY, "copies", "root"), keep, ["root"], "w").drop("w"), "classes")
    dropped(signed, shared, members, wanted, named, sets, maps, pairs, near, first, apart, late, roots, every, keep)
    return out


def decided(docs: DataFrame, exact: bool = False) -> DataFrame:
    """One row per line that takes part: doc_id, text_hash, line_no, class_id, keep_doc_id, kept (saved).

    ``class_id`` is the least hash of the lines of a class; keep_doc_id is the document whose line stays.
    """
    found = classes(docs, exact)
    rows = occurrences(docs).select("doc_id", _doc(), "text_hash", "line_no", *_key())
    rows = saved(looked_up(rows, found, KEY, "copies").drop("key_b", "copies"), "lines")
    # only lines of the document that keeps the class can stay: one document's for each class
    own = rows.where("doc = keep_doc")
    first = saved(own.groupBy("root").agg(F.min(F.struct("text_hash", "line_no")).alias("first")), "first")
    own = looked_up(own, first, ["root"]).withColumn("kept", F.col("first") == F.struct("text_hash", "line_no")).drop("first")
    rest = rows.where("keep_doc IS NULL OR doc <> keep_doc").withColumn("kept", F.col("keep_doc").isNull())
    alone = F.col("keep_doc").isNull()
    keep = F.when(alone, F.col("doc_id")).when(F.col("keep_doc") != _LAST, F.col("keep_doc"))
    out = own.unionByName(rest).select("doc_id", "text_hash", "line_no", F.coalesce("class_id", "key_a").alias("class_id"), keep.alias("keep_doc_id"), "kept")
    out = saved(out, "decided")
    dropped(found, rows, first)
    return out


def line_dedup(docs: DataFrame, exact: bool = False) -> DataFrame:
    """The rows and columns of ``docs``, their texts without the lines that do not stay."""
    gone = decided(docs, exact).where("NOT kept").select(_doc().alias("l_doc"), F.col("text_hash").alias("l_hash"), "line_no")
    gone = saved(gone.groupBy("l_doc", "l_hash").agg(F.sort_array(F.collect_set("line_no")).alias("l_gone")).withColumn("l_many", F.size("l_gone")), "gone")
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("l_row"), F.col("text").alias("l_own"), _doc().alias("l_doc"), F.xxhash64("text").alias("l_hash"))
    rows = looked_up(rows, gone, ["l_doc", "l_hash"], length="l_many")
    left = F.expr("transform(array(split(l_own, '\n', -1)), l -> array_join(transform(array_except(sequence(0, size(l) - 1), l_gone), i -> l[i]), '\n'))[0]")
    text = F.when(F.col("l_gone").isNull(), F.col("l_own")).otherwise(left)
    return rows.select(*[text.alias("text") if c == "text" else F.col("l_row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir):
    out = decided(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "class_id", "keep_doc_id", "kept")
