"""Quality rules: character n-gram perplexity under a modified Kneser-Ney model, in bands.

Spark counts the 4-grams of the characters of every whole text and estimates a modified Kneser-Ney model from them by
aggregations and joins: three discounts an order, continuation counts below the top, each order
interpolated with the one below.  The model grows with the corpus and is never gathered whole.
It is stored as hash arrays in ascending order beside their log probabilities, cut by the first
bits of the hash into shards of about SHARD entries (12 bytes each in a worker).  Texts are rated
against one shard after the other, so what is broadcast at a time has a bound; a place in the
array is found from the hash's leading bits.  The sums of the passes are added by text.

A character has 16 bits (those beyond 65,535 share private-use codes).  Capitals are one symbol
to the model, and so are digits and signs, as is usual for perplexity filters: a text full of
these is then too easy to predict, where a model that has seen such texts too would take it for
prose.  All other characters of all scripts are themselves.

Every language gets a lower and an upper band for the mean negative log probability a
character, from histograms over all its documents that pass the base rules: its median, and
REACH robust standard deviations (from the median absolute deviation) to both sides.  A mean over
few words varies more, so deviations are scaled by the root of the number of words.  Repetitive
junk lies below, noise above.  No language is judged by the centre of others: the spread of one with few
documents is drawn towards the common one (as if by PRIOR more documents) and its band is wider
by the root of 1 + PRIOR / n, which goes over smoothly into that of a frequent language.

Null texts have no words (base_failed); a null language is one of its own; repeated rows are
rated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, freeing, looked_up, saved, slices, table

ORDER, BITS = 4, 16
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
#: The customary cut of a modified z-score.
REACH = 3.5
PRIOR = 10
#: Histogram cells per unit (nat a character).
CELLS = 500
#: Characters that are worked on at once, unless one text is longer.
AT_ONCE = 1 << 18
#: Entries of the model that are broadcast at a time.
SHARD = 1 << 22
#: Different n-grams that a counting task holds before it passes them on.
HELD = 1 << 21
#: Cost of an n-gram that the model does not have (it was counted on other texts): one code of all.
UNSEEN = BITS * math.log(2)
KEY = ["q_key_a", "q_key_b"]


@functools.cache
def _symbols():
    """What the model reads for each of 65,536 code points: capitals as "A", digits as "0", signs as "#", else the character."""
    import unicodedata

    import numpy as np

    out = np.arange(1 << 16, dtype=np.uint16)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        folded = "A" if kind in ("Lu", "Lt") else "0" if kind[0] == "N" else "#" if kind[0] == "S" or chr(c) in "#%&*@\\/_" else chr(c)
        out[c] = ord(folded)
    return out


class Block:
    """Some texts as one array of code points, each after three line feeds."""

    def __init__(self, texts: list[str]):
        import numpy as np

        lead = ORDER - 1
        self.codes = np.frombuffer("".join("\n\n\n" + t for t in texts).encode("utf-32-le") + b"\n\0\0\0", "<u4")
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n, self.size = len(texts), size
        self.begin = np.cumsum(size + lead) - size  # of each text's own characters
        self.end = self.begin + size

    def grams(self):
        """For each own character: it and the three before it, packed, the eldest uppermost."""
        import numpy as np

        k = _symbols()[np.where(self.codes < 65536, self.codes, 0xE000 + self.codes % 6400)].astype(np.uint64)
        g = k.copy()
        for d in range(1, ORDER):
            g[d:] |= k[:-d] << np.uint64(BITS * d)
        own = np.ones(len(g), bool)
        for d in range(1, ORDER):
            own[self.begin - d] = False
        own[-1] = False
        return g[own]

    def base(self) -> dict:
        """The base figures of each text."""
        import numpy as np

        u8, n, c = np.uint64, self.n, self.codes
        white = (c == 32) | ((c >= 9) & (c <= 13))
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1  # words and gaps take turns; a gap is first and last
        first, after = edge[::2], edge[1::2]
        doc = np.searchsorted(self.begin, first, "right") - 1
        words = np.bincount(doc, minlength=n)
        chars = np.bincount(doc, weights=after - first, minlength=n).astype(np.int64)
        mark = np.flatnonzero(np.isin(c, [ord(x) for x in SYMBOLS]) if n else np.zeros(0, bool))
        symbols = np.bincount(np.searchsorted(self.begin, mark, "right") - 1, minlength=n)
        power, inverse = _powers(len(c))
        sums = np.zeros(len(c) + 1, u8)
        np.cumsum(_mix(c.astype(u8)) * power, out=sums[1:])
        hashed = lambda a, b: _mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(u8))
        w = hashed(first, after)
        inside = doc[2:] == doc[:-2] if len(w) > 2 else np.zeros(0, bool)
        repeated = np.zeros(n, np.int64)
        if len(w) > 2:
            key = _mix(w[:-2] + _mix(w[1:-1] + _mix(w[2:] + doc[2:].astype(u8))))
            s = np.sort(key[inside])
            twice = np.unique(s[1:][s[1:] == s[:-1]])
            if len(twice):
                at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
                hit = np.flatnonzero((twice[at] == key) & inside)
                found = np.zeros(len(w), bool)
                for d in range(3):
                    found[hit + d] = True
                repeated = np.bincount(doc[found], minlength=n)
        feed = np.flatnonzero(c == 10)
        start = np.concatenate([[0], feed[:-1] + 1])
        full = np.searchsorted(first, feed) > np.searchsorted(first, start)
        start, feed = start[full], feed[full]
        line_doc = np.searchsorted(self.begin, feed, "right") - 1
        # a text's first line starts with the text
        start = np.maximum(start, self.begin[line_doc])
        key = _mix(hashed(start, feed) + line_doc.astype(u8))
        order = np.argsort(key, kind="stable")
        again = order[1:][key[order][1:] == key[order][:-1]]
        lines = np.bincount(line_doc[again], minlength=n)
        return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated}


_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_known_powers: list = []


def _powers(n: int):
    """Powers of an odd base and of its inverse modulo 2 ** 64: a text's hash then moves with it."""
    import numpy as np

    if not _known_powers or len(_known_powers[0]) < n + 1:
        size = max(n + 1, AT_ONCE + (1 << 17))
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _known_powers[:] = both
    return _known_powers[0][:n], _known_powers[1]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int, Block]]:
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= AT_ONCE):
            size += len(texts[upto] or "")
            upto += 1
        yield at, upto, Block([t or "" for t in texts[at:upto]])
        at = upto


def _grams(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def out():
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(counts[at : at + 100_000])], ["g", "c"])

    def merged():
        both = np.concatenate([k for k, _ in new])
        whole, inverse = np.unique(both, return_inverse=True)
        return whole, np.bincount(inverse, np.concatenate([c for _, c in new]), len(whole)).astype(np.int64)

    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new = [(keys, counts)]
    for batch in batches:
        for _, texts in slices(batch, 0):
            for _, _, block in blocks(texts):
                new.append(np.unique(block.grams(), return_counts=True))
                # what came since is as much as what was there: each n-gram is merged few times
                if sum(len(k) for k, _ in new[1:]) > max(1 << 19, len(new[0][0])):
                    keys, counts = merged()
                    if len(keys) > HELD:
                        yield from out()
                        keys, counts = keys[:0], counts[:0]
                    new = [(keys, counts)]
    keys, counts = merged()
    yield from out()


def count_grams(docs: DataFrame) -> DataFrame:
    """How often each packed 4-gram occurs in all texts: g long, c long."""
    return docs.select("text").mapInArrow(lambda it: freeing(_grams(it)), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def kneser_ney(counted: DataFrame) -> DataFrame:
    """g, p: the probability of each 4-gram's last character after the three before it (saved).

    ``counted`` (saved) has g and c.  Below the top a count is the number of different
    characters that come before.  Joins are by context and by the gram of the order below: no
    key has more rows than there are characters.
    """
    orders = {ORDER: counted}
    for m in range(ORDER - 1, 0, -1):
        lower = orders[m + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << (BITS * m)) - 1)).alias("g"))
        orders[m] = saved(lower.agg(F.count(F.lit(1)).alias("c")), f"order{m}")
    below = None
    for m in range(1, ORDER + 1):
        of = orders[m].agg(*[F.sum(F.when(F.col("c") == r, 1).otherwise(0)) for r in (1, 2, 3, 4)]).first()
        n = [max(1, x or 0) for x in of]
        y = n[0] / (n[0] + 2 * n[1])
        cut = [min(max(r - (r + 1) * y * n[r] / n[r - 1], 0.05), r - 0.05) for r in (1, 2, 3)]
        less = F.when(F.col("c") == 1, cut[0]).when(F.col("c") == 2, cut[1]).otherwise(cut[2])
        rows = orders[m].select("g", "c", less.alias("less"), F.shiftrightunsigned("g", BITS).alias("context"))
        sums = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("less").alias("freed"))
        rows = rows.join(sums, "context")
        if below is None:
            rows = rows.withColumn("q", F.lit(1.0 / (1 << BITS)))
        else:
            rows = rows.withColumn("suffix", F.col("g").bitwiseAND(F.lit((1 << (BITS * (m - 1))) - 1)))
            rows = rows.join(below.select(F.col("g").alias("suffix"), F.col("p").alias("q")), "suffix")
        now = saved(rows.select("g", ((F.col("c") - F.col("less")) / F.col("total") + F.col("freed") / F.col("total") * F.col("q")).alias("p")), "model")
        dropped(*([below] if below is not None else []), *([orders[m]] if m < ORDER else []))
        below = now
    return below


def _hash(g):
    """What Spark's xxhash64 gives for a long: one to one, so no two n-grams share a hash."""
    import numpy as np

    u = np.uint64
    a, b, c = u(0x9E3779B185EBCA87), u(0xC2B2AE3D27D4EB4F), u(0x165667B19E3779F9)
    turn = lambda x, n: (x << u(n)) | (x >> u(64 - n))
    h = turn((turn(g * b, 31) * a) ^ u(42 + 0x27D4EB2F165667C5 + 8), 27) * a + u(0x85EBCA77C2B2AE63)
    h = (h ^ (h >> u(33))) * b
    h = (h ^ (h >> u(29))) * c
    return h ^ (h >> u(32))


class Arrays:
    """Hashes in ascending order beside log probabilities, and where each leading part starts."""

    def __init__(self, hashes, logp):
        import numpy as np

        order = np.argsort(hashes)
        self.hashes, self.logp = hashes[order], logp[order]
        self.shift = np.uint64(64 - max(1, math.ceil(math.log2(len(hashes) + 1))))
        self.start = np.searchsorted(self.hashes >> self.shift, np.arange((1 << int(64 - self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, q):
        """For each hash of ``q`` the place in the arrays, or -1."""
        import numpy as np

        part = (q >> self.shift).astype(np.int64)
        at, end = self.start[part], self.start[part + 1]
        out = np.full(len(q), -1, np.int32)
        live = np.flatnonzero(at < end)
        at, end, q = at[live], end[live], q[live]
        while len(live):
            same = self.hashes[at] == q
            out[live[same]] = at[same]
            on = np.flatnonzero(~same & (at + 1 < end))
            live, at, end, q = live[on], at[on] + 1, end[on], q[on]
        return out


_held: dict = {}


class _Shared:
    """A broadcast shard of the model; a worker holds the arrays of the last one, by a name of its own."""

    def __init__(self, spark, hashes, logp, number: int, bits: int):
        self.sent = spark.sparkContext.broadcast((hashes, logp))
        self.id = uuid.uuid4().hex  # an address may come again while workers still keep what they made of the last
        self.number, self.bits = number, bits

    def arrays(self) -> Arrays:
        if self.id not in _held:
            _held.clear()
            _held[self.id] = Arrays(*self.sent.value)
        return _held[self.id]

    def sums(self, block: Block):
        """Of each text of a block the sum of log p over its n-grams in this shard."""
        import numpy as np

        own = self.arrays()
        h = _hash(block.grams())
        found = own.find(h)
        value = np.where(found >= 0, own.logp[found], np.float32(0)) if len(own.logp) else np.zeros(len(h), np.float32)
        mine = (h >> np.uint64(64 - self.bits)) == self.number if self.bits else np.ones(len(h), bool)
        value[(found < 0) & mine] = -UNSEEN
        total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
        upto = np.cumsum(block.size)
        return total[upto] - total[upto - block.size]


def train(docs: DataFrame) -> DataFrame:
    """h, logp of all 4-grams of all texts (saved)."""
    counted = saved(count_grams(docs), "grams")
    p = kneser_ney(counted)
    model = saved(p.select(F.xxhash64("g").alias("h"), F.log("p").cast("float").alias("logp")), "hashed")
    dropped(counted, p)
    return model


def _shards(model: DataFrame, size: int) -> Iterator[_Shared]:
    import numpy as np

    bits = max(0, math.ceil(math.log2(max(1, model.count()) / size)))
    for k in range(1 << bits):
        part = model.where(F.shiftrightunsigned("h", 64 - bits) == k) if bits else model
        rows = part.toArrow()
        yield _Shared(model.sparkSession, rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy(), k, bits)


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _rate(batches: Iterator, shard: _Shared, base: bool) -> Iterator:
    """The columns before the text, base figures and characters if wanted, and the sum of log p."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        last = batch.num_columns - 1
        for part, texts in slices(batch, last):
            found: dict[str, list] = {x: [] for x in ((*FIGURES, "chars") if base else ())} | {"sum": []}
            for _, _, block in blocks(texts):
                if base:
                    for k, v in block.base().items():
                        found[k].append(v)
                    found["chars"].append(block.size)
                found["sum"].append(shard.sums(block))
            cols = [pa.array(np.concatenate(v).astype(np.int64 if x != "sum" else np.float64)) for x, v in found.items()]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(last)), *cols], [*batch.schema.names[:last], *(f"q_{x}" for x in found)])


def _key() -> list[Column]:
    """128 bits that name a text."""
    own = F.coalesce("text", F.lit(""))
    return [F.xxhash64(own).alias(KEY[0]), F.xxhash64(F.lit(7), own).alias(KEY[1])]


def rated(docs: DataFrame, model: DataFrame, carry: list[str], shard: int = SHARD) -> DataFrame:
    """``q_row`` (a struct of the ``carry`` columns), the text's key, base figures, ``q_entropy``, ``q_base_failed`` (saved).

    Carried columns stay inside the struct, so that their names clash with nothing.
    """
    first, more = None, []
    for own in _shards(model, shard):
        if first is None:
            rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("q_row"), *_key(), "text")
            kind = rows.schema["q_row"].dataType.simpleString()
            schema = ", ".join([f"q_row {kind}", *[f"{k} long" for k in KEY], *[f"q_{x} long" for x in (*FIGURES, "chars")], "q_sum double"])
            first = saved(rows.mapInArrow(lambda it, own=own: freeing(_rate(it, own, True)), schema), "rated")
        else:
            rows = docs.select(*_key(), "text").mapInArrow(lambda it, own=own: freeing(_rate(it, own, False)), ", ".join([*[f"{k} long" for k in KEY], "q_sum double"]))
            more.append(saved(rows.groupBy(*KEY).agg(F.max("q_sum").alias("part"), F.count(F.lit(1)).alias("w")), "part"))
        own.sent.unpersist()
    rows = first
    if more:
        parts = more[0]
        for x in more[1:]:
            parts = parts.union(x)
        parts = saved(parts.groupBy(*KEY).agg(F.sum("part").alias("part"), F.max("w").alias("w")), "parts")
        rows = looked_up(first, parts, KEY, "w").withColumn("q_sum", F.col("q_sum") + F.col("part")).drop("part", "w")
        rows = saved(rows, "rated")
        dropped(first, parts, *more)
    few = (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEATED * F.col("q_n_words"))
    return rows.withColumn("q_entropy", -F.col("q_sum") / F.greatest("q_chars", F.lit(1))).withColumn("q_base_failed", few)


def _medians(values: DataFrame) -> DataFrame:
    """``q_tongue, q_mid, q_n``: the median of ``q_tongue, q_value`` by histogram, and the number of rows."""
    cell = F.floor(F.col("q_value") * CELLS).cast("int").alias("cell")
    counts = saved(values.select("q_tongue", cell).groupBy("q_tongue", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    counts = counts.union(counts.groupBy(F.lit("*").alias("q_tongue"), "cell").agg(F.sum("n").alias("n")))
    run = "sum(n) OVER (PARTITION BY q_tongue ORDER BY cell)"
    ranked = counts.selectExpr("q_tongue", "cell", f"{run} AS upto", "sum(n) OVER (PARTITION BY q_tongue) AS total")
    mid = F.min(F.when(2 * F.col("upto") >= F.col("total"), (F.col("cell") + 0.5) / CELLS))
    return ranked.groupBy("q_tongue").agg(mid.alias("q_mid"), F.max("total").alias("q_n"))


def _off(centre: str):
    """How far a row is from its language's centre, for its number of words."""
    return F.abs(F.col("q_entropy") - F.col(centre)) * F.sqrt("q_n_words")


def bands(figures: DataFrame) -> DataFrame:
    """``q_tongue, q_centre, q_reach`` from rows of ``q_tongue, q_entropy, q_n_words``."""
    figures = saved(figures, "figures")
    centres = saved(_medians(figures.withColumnRenamed("q_entropy", "q_value")).where("q_tongue <> '*'").select("q_tongue", F.col("q_mid").alias("q_centre")), "centres")
    off = figures.join(F.broadcast(centres), "q_tongue").select("q_tongue", _off("q_centre").alias("q_value"))
    spreads = saved(_medians(off).withColumn("q_spread", 1.4826 * F.col("q_mid")), "spreads")
    every = spreads.where("q_tongue = '*'").select(F.col("q_spread").alias("q_every"))
    n, own, common = F.col("q_n"), F.col("q_spread"), F.col("q_every")
    drawn = F.sqrt((n * own * own + PRIOR * common * common) / (n + PRIOR))
    # half the common spread at least: many copies of a text are no measure of a language
    reach = REACH * F.greatest(drawn, common / 2) * F.sqrt(1 + PRIOR / n)
    return saved(centres.join(spreads, "q_tongue").crossJoin(every).select("q_tongue", "q_centre", reach.alias("q_reach")), "bands")


def _tongue():
    """The language as a key: null has one of its own, and none is '*'."""
    return F.coalesce(F.concat(F.lit("="), F.col("q_row.lang")), F.lit("?"))


def _judged(docs: DataFrame, carry: list[str], shard: int = SHARD) -> DataFrame:
    """``q_row``, key, figures, ``q_base_failed`` and the verdict ``q_kept`` of every row.

    Two passes read the texts (more if the model has several shards) and none shuffles them.
    """
    model = train(docs)
    rows = rated(docs, model, carry, shard).withColumn("q_tongue", _tongue())
    dropped(model)
    found = bands(rows.where("NOT q_base_failed").select("q_tongue", "q_entropy", "q_n_words"))
    rows = rows.join(F.broadcast(found), "q_tongue", "left")  # one row a language
    # a language without a band has no sound document
    return rows.withColumn("q_kept", ~F.col("q_base_failed") & F.coalesce(_off("q_centre") <= F.col("q_reach"), F.lit(False)))


def quality(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per row: doc_id, lang, base figures, base_failed, kept, entropy."""
    out = _judged(docs, ["doc_id", "lang"], shard)
    names = [*FIGURES, "base_failed", "kept", "entropy"]
    return out.select("q_row.doc_id", "q_row.lang", *[F.col(f"q_{x}").alias(x) for x in names])


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, as they were.

    A verdict depends on text and language alone, so the rejected pairs of both are looked up
    by hash, and rows are read once more without leaving the JVM.
    """
    out = _judged(docs, ["lang"]).where("NOT q_kept").groupBy("q_tongue", *KEY).agg(F.count(F.lit(1)).alias("q_many"))
    # the language joins the hash, so that the key is of numbers only
    gone = saved(out.select(F.xxhash64("q_tongue").alias("q_lang"), *KEY, "q_many"), "rejected")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row")
    rows = docs.select(row, *_key()).withColumn("q_lang", F.xxhash64(_tongue()))
    return looked_up(rows, gone, ["q_lang", *KEY], "q_many").where("q_many IS NULL").select("q_row.*")


def query(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).drop("lang")
