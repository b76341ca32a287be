"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control (native).

Everything is SQL functions.  The base kinds (assign, access, hex) are patterns.  The method
adds ``random`` spans: runs of 20 and more letters, digits and ``+/_-`` that touch no base
span, and

* are not unlike a random string of their inferred encoding (digits, hex, one-case letters,
  base32 and base36 of either case, letters, base58, base62, base64): the
  chi-squared test for a uniform alphabet (Wilson and Hilferty's normal form) and the test of
  the serial correlation of neighbours both leave them with p of ALPHA or more, and
* are unlike writing: in words, names and numbers characters of a kind (digit, upper, lower,
  other) stand together, so that the next character is of another kind at no more than one place
  in four.  The runs test gives the probability of as many changes as there are, or more.  Where
a string is of one kind this says nothing: of one-case letters, no more than RARE are of those
that writing seldom has; of digits, in numbers that are written half of the neighbours at least
are equal or one apart.  Base32 and base36 of one case take the runs and the letters together
(Stouffer, the letters
weighing twice).

The first two tests have randomness as their hypothesis, so that they can only veto; a small p
there speaks against a secret and cannot be combined with one that speaks for it.  The p-values
of the second kind go through Benjamini and Hochberg's procedure at level FDR in
strata of encoding and length class (powers of two), so that the many short candidates do not
set the bar of the few long ones.  It works on a histogram of -log10 p with rounded-up p-values,
exactly summed over all documents; its rows are bounded by strata times cells.

Null texts are empty and have no spans; a row that repeats is scanned again; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"  # runs of 32 and more: those that are dropped need not be found
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Kind: pattern, group whose length counts, least length.
BASE = {"assign": (ASSIGN, 1, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32)}
KINDS = (*BASE, "random")
#: What a text with a match that is long enough contains, quick to look for.
HINT = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}", "random": RANDOM}
ALPHA = 1e-3
FDR = 0.01
#: How often writing changes the kind of character, at most.
CHANGES = 0.25
#: The part of letters that are of SELDOM in writing, at most.
SELDOM, RARE = "fjkqvwxyz", 0.15
CELLS = 400  # of -log10 p, four to a unit


def _sums(array: str) -> str:
    """Running sums of a long array: each adds up to 64 numbers of every level of a tree of block sums."""
    total = lambda x: f"aggregate({x}, 0L, (s, v) -> s + v)"
    blocks = lambda x: f"transform(IF(size({x}) = 0, array(0), sequence(0, (size({x}) - 1) div 64)), j -> {total(f'slice({x}, j * 64 + 1, 64)')})"
    part = lambda x, at: f"{total(f'slice({x}, ({at}) div 64 * 64 + 1, ({at}) % 64)')}"
    # the first i + 1 numbers: what is left over in each level, and all of the last one that is complete
    one = f"{part('a', 'i + 1')} + {part('b', '(i + 1) div 64')} + {part('c', '(i + 1) div 4096')} + {total('slice(d, 1, (i + 1) div 262144)')}"
    inner = f"transform(sequence(0, size(a) - 1), i -> {one})"
    for name, under in (("d", "c"), ("c", "b"), ("b", "a")):
        inner = f"transform(array({blocks(under)}), {name} -> {inner})[0]"
    return f"transform(array({array}), a -> IF(size(a) = 0, array(0L), {inner}))[0]"


def _spans(kind: str, pattern: str, group: int, least: int) -> Column:
    """(kind number, start, end, token) of every match of the text that is long enough."""
    p = "r'" + pattern.replace("'", "\\x27") + "'"
    gaps = f"transform(split(text, {p}, -1), x -> CAST(length(x) AS BIGINT))"
    found = f"regexp_extract_all(text, {p}, 0)"
    counted = f"transform(regexp_extract_all(text, {p}, {group}), x -> length(x))"
    step = f"zip_with({gaps}, concat(array(0L), transform(m, x -> CAST(length(x) AS BIGINT))), (g, l) -> g + l)"
    each = f"transform(m, (x, i) -> named_struct('kind', {KINDS.index(kind)}, 'start', s[i], 'end', s[i] + length(x), 'token', x, 'n', c[i]))"
    inner = f"transform(array({counted}), c -> transform(array({_sums(step)}), s -> {each})[0])[0]"
    every = f"transform(array({found}), m -> {inner})[0]"
    hint = "r'" + HINT[kind].replace("'", "\\x27") + "'"
    none = "CAST(array() AS array<struct<kind: int, start: bigint, end: bigint, token: string, n: int>>)"
    return F.expr(f"IF(text RLIKE {hint}, filter({every}, x -> x.n >= {least}), {none})")


def _tail(z: str) -> str:
    """P(Z > z) of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    q = f"(exp(-({z}) * ({z}) / 2) * 0.3989422804 * {t} * (0.31938153 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"IF({z} >= 0, {q}, 1 - {q})"


def _tested(token: str) -> str:
    """Of one token: (encoding, length class, p of the runs test or null if it is no candidate)."""
    body = f"regexp_replace({token}, '=+$', '')"
    code = "CASE WHEN t RLIKE '^[0-9]+$' THEN 10 WHEN t RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 16 WHEN t RLIKE '^([a-z]+|[A-Z]+)$' THEN 26 WHEN t RLIKE '^([A-Z2-7]+|[a-z2-7]+)$' THEN 32 WHEN t RLIKE '^([a-z0-9]+|[A-Z0-9]+)$' THEN 36 WHEN t RLIKE '^[A-Za-z]+$' THEN 52 WHEN t RLIKE '^[1-9A-HJ-NP-Za-km-z]+$' THEN 58 WHEN t RLIKE '^[A-Za-z0-9]+$' THEN 62 ELSE 64 END"
    squares = "aggregate(array_distinct(split(t, '')), 0D, (s, c) -> s + pow(length(t) - length(replace(t, c, '')), 2))"
    # chi-squared over the alphabet, as a standard normal
    chi = f"(({squares}) * k / length(t) - length(t))"
    z1 = f"(pow(greatest({chi}, 0) / (k - 1), 1/3D) - (1 - 2D / (9 * (k - 1)))) / sqrt(2D / (9 * (k - 1)))"
    codes = "transform(split(t, ''), x -> CAST(ascii(x) AS DOUBLE))"
    mean = "aggregate(v, 0D, (s, x) -> s + x) / size(v)"
    top = "aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (x, y) -> (x - m) * (y - m)), 0D, (s, x) -> s + x)"
    low = "greatest(aggregate(v, 0D, (s, x) -> s + (x - m) * (x - m)), 1e-9D)"
    z2 = f"transform(array({codes}), v -> transform(array({mean}), m -> ({top} / {low} + 1D / size(v)) * sqrt(size(v)))[0])[0]"
    runs = "length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[0-9]+', '0'), '[a-z]+', 'a'), '[A-Z]+', 'A'), '[+/_-]+', '-'))"
    # as many changes or more, with continuity
    z3 = f"(({runs}) - 1.5D - {CHANGES}D * (length(t) - 1)) / sqrt({CHANGES * (1 - CHANGES)}D * (length(t) - 1))"
    letters = "length(regexp_replace(t, '[^A-Za-z]', ''))"
    seldom = f"length(regexp_replace(lower(t), '[^{SELDOM}]', ''))"
    z4 = f"({seldom} - 0.5D - {RARE}D * {letters}) / sqrt({RARE * (1 - RARE)}D * greatest({letters}, 1))"
    beside = "aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (x, y) -> IF(abs(x - y) <= 1, 1D, 0D)), 0D, (s, x) -> s + x)"
    z5 = f"transform(array({codes}), v -> (0.5D * (size(v) - 1) - {beside} - 0.5D) / sqrt(0.25D * (size(v) - 1)))[0]"
    unlike = f"CASE WHEN k = 10 THEN {z5} WHEN k = 26 THEN {z4} WHEN k IN (32, 36) THEN ({z3} + 2 * {z4}) / sqrt(5D) ELSE {z3} END"
    fits = f"{_tail('z[0]')} >= {ALPHA}D AND 2 * {_tail('abs(z[1])')} >= {ALPHA}D"
    p = f"IF({fits}, {_tail('z[2]')}, CAST(NULL AS DOUBLE))"
    tests = f"transform(array(array({z1}, {z2}, {unlike})), z -> named_struct('code', k, 'class', CAST(floor(log2(length(t))) AS INT), 'p', {p}))[0]"
    return f"transform(array({body}), t -> transform(array({code}), k -> {tests})[0])[0]"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` spans and ``cands``: candidates outside them with their tests."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = [_spans(k, *BASE[k]) for k in BASE]
    rows = rows.select("doc_id", F.concat(*found).alias("base"), _spans("random", RANDOM, 0, 20).alias("long_"))
    free = "filter(long_, x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end))"
    tested = f"transform({free}, x -> named_struct('start', x.start, 'end', x.end, 'test', {_tested('x.token')}))"
    return rows.select(
        "doc_id",
        F.expr("array_sort(transform(base, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end)))").alias("base"),
        F.expr(f"filter({tested}, x -> x.test.p IS NOT NULL)").alias("cands"),
    )


def bars(rows: DataFrame, fdr: float = FDR) -> dict[tuple[int, int], int]:
    """By stratum the lowest cell of -log10 p that Benjamini and Hochberg's procedure accepts."""
    each = rows.select(F.explode("cands.test").alias("t")).select("t.code", "t.class", F.least(F.floor(-4 * F.log10(F.greatest("t.p", F.lit(1e-99)))), F.lit(CELLS)).cast("int").alias("cell"))
    cells = each.groupBy("code", "class", "cell").agg(F.count(F.lit(1)).alias("n"))
    run = "sum(n) OVER (PARTITION BY code, class ORDER BY cell DESC)"
    ranked = cells.selectExpr("code", "class", "cell", f"{run} AS better", "sum(n) OVER (PARTITION BY code, class) AS m")
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("cell") / 4) <= fdr * F.col("better") / F.col("m"))
    return {(r.code, r["class"]): r.cell for r in passed.groupBy("code", "class").agg(F.min("cell").alias("cell")).collect()}


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    rows = saved(scanned(docs), "scanned")
    bar = bars(rows, fdr)
    accept = " OR ".join(f"(x.test.code = {code} AND x.test.class = {size} AND floor(-4 * log10(greatest(x.test.p, 1e-99D))) >= {cell})" for (code, size), cell in sorted(bar.items()))
    added = F.expr(f"transform(filter(cands, x -> {accept or 'false'}), x -> named_struct('start', x.start, 'kind', {KINDS.index('random')}, 'end', x.end))")
    rows = rows.withColumn("added", added)
    named = f"array({', '.join(repr(k) for k in KINDS)})"
    joined = lambda a: F.expr(f"array_join(transform({a}, x -> concat({named}[x.kind], ':', x.start, ':', x.end)), ',')")
    count = lambda a, k: F.expr(f"CAST(size(filter({a}, x -> x.kind = {k})) AS BIGINT)")
    return rows.select(
        "doc_id", *[count("base", k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("array_sort(concat(base, added))").alias("spans"),
        count("added", 3).alias("n_random"),
    )


def query(spark, sf_dir):
    return secrets(table(spark, sf_dir, "documents"))
