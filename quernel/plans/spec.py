"""The specification of a query: what the engine compiles, prints as SQL, or stores as JSON.

It is no relational algebra; that is Catalyst's.  A Branch is one aggregation over one fact; a
Stitch puts aggregations of one group side by side; a QuerySpec combines them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class DimJoin:
    """A LEFT JOIN to a dimension table; its columns get the names ``prefix::column``."""

    dimension: str
    left_key: str
    right_key: str
    prefix: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Branch:
    """fact, LEFT JOINs, WHERE, GROUP BY keys with measures, then the outputs in order.

    ``keys`` and ``measures`` are (name, SQL) and (name, aggregation, SQL); ``outputs`` are
    (name, SQL over keys, measures and literals).
    """

    group: str
    dataset: str
    joins: tuple[DimJoin, ...] = ()
    filters: tuple[str, ...] = ()
    keys: tuple[tuple[str, str], ...] = ()
    measures: tuple[tuple[str, str, str], ...] = ()
    outputs: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Stitch:
    """Branches of one group with the same keys, joined on all of these with nulls equal.

    Without keys the one-row results stand side by side.
    """

    parts: tuple[Branch, ...]
    keys: tuple[str, ...]
    measures: tuple[str, ...]
    outputs: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class QuerySpec:
    """``combine``: single, union, union_sum (SUM of ``sums`` by the other outputs) or values."""

    model: str
    combine: str
    parts: tuple[Branch | Stitch, ...]
    outputs: tuple[str, ...]
    sort: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    values: tuple[tuple, ...] = ()
    notes: tuple[str, ...] = field(default=())

    @property
    def branches(self) -> list[Branch]:
        return [b for p in self.parts for b in (p.parts if isinstance(p, Stitch) else (p,))]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    def explain(self) -> str:
        """An indented tree, parents first."""
        lines: list[str] = []

        def add(depth: int, text: str) -> None:
            lines.append("  " * depth + text)

        if self.sort:
            add(0, f"Sort: {', '.join(self.sort)} ASC NULLS LAST")
        depth = bool(self.sort)
        if self.combine == "values":
            add(depth, f"Values: {len(self.values)} rows of {', '.join(self.outputs)}")
            return "\n".join(lines)
        if self.combine == "union_sum" and len(self.parts) > 1:
            add(depth, f"Aggregate: keys=[{', '.join(o for o in self.outputs if o not in self.sums)}], sum=[{', '.join(self.sums)}]")
            depth += 1
        if len(self.parts) > 1:
            add(depth, "Union")
            depth += 1
        for p in self.parts:
            at = depth
            if isinstance(p, Stitch):
                add(at, f"Project: {', '.join(n for n, _ in p.outputs)}")
                add(at + 1, f"Join: {'Full on ' + ', '.join(p.keys) if p.keys else 'Cross'}")
                at += 2
            for b in p.parts if isinstance(p, Stitch) else (p,):
                add(at, f"Project: {', '.join(n for n, _ in b.outputs)}")
                add(at + 1, f"Aggregate: keys=[{', '.join(n for n, _ in b.keys)}], measures=[{', '.join(f'{f}({e}) AS {n}' for n, f, e in b.measures)}]")
                k = at + 2
                if b.filters:
                    add(k, f"Filter: {' AND '.join(b.filters)}")
                    k += 1
                for j in reversed(b.joins):
                    add(k, f"Join: Left {j.dimension} on {j.left_key} = {j.right_key}")
                    k += 1
                add(k, f"Scan: {b.dataset}")
        return "\n".join(lines)
