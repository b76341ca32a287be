"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to (their pattern) before anything
is decided, so the flow network has a node per pattern and one per source, whatever the number
of documents.  From the start to a pattern leads one arc per repetition, each as wide as the
pattern's size and dearer than the last (convex costs: no document is repeated before all
documents it competes with were taken once); from a pattern to each of its sources leads an
open arc; from a source to the end one as wide as its target.  The cheapest flow that meets
the targets says how many words each pattern gives.  Within a pattern documents are ordered by
a seeded hash: all are taken the whole number of times, the first of them once more as long as
the rest holds out.  A histogram over the hash finds that place without sorting; what is then
left goes to documents that still fit, in a new order, and so on for LEVELS orders.

Null texts have size 0 and are taken 0 times; a null source is a source, ordered last; rows
that repeat are separate rows of equal hash and are taken alike; an empty table gives an
empty result.  Only patterns and their sizes are gathered on the driver, PATTERNS at most: where
membership has more combinations, as a source for every host would, that is an error and
calls for a coarser ``member``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, saved, table

SHARE = 1.5
MOST = 2
SEED = 20
#: Cells of the histogram over the seeded hash.
CELLS = 4096
#: Combinations of sources for which the driver solves the flow.
PATTERNS = 10_000
#: Orders in which documents are drawn, each for what the one before left.
LEVELS = 5


def size_of(text: Column) -> Column:
    """The number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """What each source should give: by weight, none above ``most`` times its size."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in names if s in open_ and unit * weight[s] > most * sizes[s]]
        if not over:
            return {s: out[s] if s in out else unit * weight[s] for s in names}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return {s: out[s] for s in names}


def min_cost_flow(arcs: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of a greatest flow of least cost.

    Successive shortest paths with potentials; costs are not negative.
    """
    graph: dict[int, list[int]] = {}
    to, room, cost = [], [], []
    for a, b, c, w in arcs:
        for x, y, r, k in ((a, b, c, w), (b, a, 0, -w)):
            graph.setdefault(x, []).append(len(to))
            graph.setdefault(y, [])
            to.append(y)
            room.append(r)
            cost.append(k)
    height = dict.fromkeys(graph, 0)
    while True:
        far, came, heap = {start: 0}, {}, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph.get(x, ()):
                if room[e] > 0 and (n := d + cost[e] + height[x] - height[to[e]]) < far.get(to[e], 1 << 62):
                    far[to[e]], came[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if end not in far:
            return [room[2 * k + 1] for k in range(len(arcs))]
        top = max(far.values())
        for x in height:
            height[x] += far.get(x, top)
        path, x = [], end
        while x != start:
            path.append(came[x])
            x = to[came[x] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step


def route(patterns: dict[tuple, int], goal: dict[str | None, float], most: int = MOST) -> dict[tuple, int]:
    """Words that each pattern (a tuple of sources) gives, of at most ``most`` times its size."""
    node = {s: 2 + k for k, s in enumerate(goal)}
    arcs, own = [], {}
    for k, (p, n) in enumerate(patterns.items()):
        at = 2 + len(node) + k
        own[p] = range(len(arcs), len(arcs) + most)
        arcs += [(0, at, n, r) for r in range(most)]
        arcs += [(at, node[s], most * n, 0) for s in p]
    arcs += [(node[s], 1, round(g), 0) for s, g in goal.items()]
    flow = min_cost_flow(arcs, 0, 1)
    return {p: sum(flow[e] for e in at) for p, at in own.items()}


def mixed(docs: DataFrame, member: Column | None = None, size: Column | None = None, weights=(5, 2, 1), share: float = SHARE, most: int = MOST, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """``m_row`` (a struct of the row), m_size, m_pattern, m_source_size, m_target, m_taken, m_times.

    ``member`` is an array of the sources that a row belongs to (by default its ``source``
    alone); m_source_size and m_target are those of the first.  All is decided on a narrow
    table of sizes.  With ``carry`` the row has these columns alone and comes from that table, else
    texts are read once more for the result.
    """
    spark = docs.sparkSession
    member = F.array("source") if member is None else F.array_sort(F.array_distinct(member))
    own = [F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("m_row"), (size_of(F.col("text")) if size is None else size).alias("m_size"), member.alias("m_pattern")]
    rows = docs.select("doc_id", *own)
    ranks = [F.pmod(F.xxhash64(F.lit(seed + k), F.col("doc_id")), F.lit(CELLS)).cast("int").alias(f"m_rank{k}") for k in range(LEVELS)]
    thin = saved(rows.select(*(["doc_id", "m_row"] if carry else []), "m_size", "m_pattern", *ranks), "sizes")
    sums = thin.groupBy("m_pattern").agg(F.sum("m_size").alias("n")).limit(PATTERNS + 1).collect()
    if len(sums) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} combinations of sources")
    patterns = {tuple(r.m_pattern): int(r.n) for r in sums}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, weights, share, most)
    given = route(patterns, goal, most)
    plan = {}
    for k, (p, n) in enumerate(sorted(patterns.items(), key=lambda x: str(x[0]))):
        whole = given[p] // n if n else 0
        plan[k] = [k, list(p), int(whole), sizes.get(p[0] if p else None, 0), float(goal.get(p[0] if p else None, 0.0)), [int(given[p] - whole * n)], []]
    for level in range(LEVELS):
        if all(x[5][-1] == 0 for x in plan.values()):
            break
        table_ = thin.join(F.broadcast(_plans(spark, plan)), F.col("m_pattern").eqNullSafe(F.col("p")))
        open_ = table_.where(~_once_more() & (F.col("m_size") <= F.element_at("m_rests", -1)) & (F.col("m_size") > 0))
        cells = open_.groupBy("m_id", F.col(f"m_rank{level}").alias("cell")).agg(F.sum("m_size").alias("n"), F.first(F.element_at("m_rests", -1)).alias("rest"))
        run = cells.selectExpr("m_id", "cell", "rest", "sum(n) OVER (PARTITION BY m_id ORDER BY cell) AS upto").where("upto <= rest")
        found = {r.m_id: r for r in run.groupBy("m_id").agg(F.max("cell").alias("cell"), F.max("upto").alias("upto")).collect()}
        for k, x in plan.items():
            x[6].append(found[k].cell if k in found else -1)
            x[5].append(x[5][-1] - (found[k].upto if k in found else 0))
    rows = (thin if carry else rows.select("*", *ranks)).join(F.broadcast(_plans(spark, plan)), F.col("m_pattern").eqNullSafe(F.col("p"))).drop("p")
    rows = rows.withColumn("m_times", F.col("m_whole") + _once_more().cast("long")).withColumn("m_taken", F.col("m_times") * F.col("m_size"))
    return rows.select("m_row", "m_size", "m_pattern", "m_source_size", "m_target", "m_taken", "m_times")


def _plans(spark, plan: dict) -> DataFrame:
    """A row per pattern, PATTERNS at most, so that it may be sent to all tasks: texts stay where they are."""
    names = ("m_id int", "p array<string>", "m_whole long", "m_source_size long", "m_target double", "m_rests array<long>", "m_edges array<int>")
    return spark.createDataFrame([tuple(x) for x in plan.values()], ", ".join(names))


def _once_more() -> Column:
    """Whether a level took the row: small enough for what was left, and early enough in its order."""
    at = lambda name, k: F.get(F.col(name), F.lit(k))
    hit = F.lit(False)
    for k in range(LEVELS):
        took = (F.col("m_size") <= at("m_rests", k)) & (F.col("m_size") > 0) & (F.col(f"m_rank{k}") <= at("m_edges", k))
        hit = hit | F.coalesce(took, F.lit(False))
    return hit


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    out = mixed(docs, **how).where("m_times > 0")
    return out.select("m_row", F.explode(F.expr("sequence(1L, m_times)"))).select("m_row.*")


def query(spark, sf_dir):
    out = mixed(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("m_row.doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), F.col("m_taken").alias("taken"))
