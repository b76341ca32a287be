"""A QuerySpec as Spark SQL text that runs as it stands."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.expressions import ident, literal
from .spec import Branch, QuerySpec, Stitch

#: Gives a name that SQL can use for a dataset (group, name) or, with group None, a dimension.
TableName = Callable[["str | None", str], str]


def aggregate(how: str, expr: str) -> str:
    return f"count(DISTINCT {expr})" if how == "count_distinct" else f"{how}({expr})"


def _list(pairs) -> str:
    return ", ".join(f"{sql} AS {ident(name)}" for name, sql in pairs)


def branch_sql(b: Branch, name: TableName) -> str:
    text = f"FROM {name(b.group, b.dataset)}"
    for j in b.joins:
        key = ident(f"{j.prefix}::__key")
        cols = [(f"{j.prefix}::{c}", ident(c)) for c in j.columns]
        text += f" LEFT JOIN (SELECT {_list([(f'{j.prefix}::__key', ident(j.right_key)), *cols])} FROM {name(None, j.dimension)}) ON {ident(j.left_key)} = {key}"
    if b.filters:
        text += " WHERE " + " AND ".join(b.filters)
    inner = [*b.keys, *((n, aggregate(f, e)) for n, f, e in b.measures)] or [("m::rows", "count(1)")]
    if b.keys:
        text += " GROUP BY " + ", ".join(sql for _, sql in b.keys)
    return f"SELECT {_list(b.outputs)} FROM (SELECT {_list(inner)} {text})"


def stitch_sql(s: Stitch, name: TableName) -> str:
    text, seen = f"({branch_sql(s.parts[0], name)}) AS t0", ["t0"]
    for k, b in enumerate(s.parts[1:], 1):
        if not s.keys:
            text += f" CROSS JOIN ({branch_sql(b, name)}) AS t{k}"
        else:
            before = lambda key: f"coalesce({', '.join(f'{t}.{ident(key)}' for t in seen)})"  # noqa: B023, E731
            on = " AND ".join(f"{before(key)} <=> t{k}.{ident(key)}" for key in s.keys)
            text += f" FULL OUTER JOIN ({branch_sql(b, name)}) AS t{k} ON {on}"
        seen.append(f"t{k}")
    keys = [(key, f"coalesce({', '.join(f'{t}.{ident(key)}' for t in seen)})") for key in s.keys]
    return f"SELECT {_list(s.outputs)} FROM (SELECT {_list([*keys, *((f'm::{m}', ident(f'm::{m}')) for m in s.measures)])} FROM {text})"


def spec_sql(spec: QuerySpec, name: TableName) -> str:
    order = f" ORDER BY {', '.join(f'{ident(p)} ASC NULLS LAST' for p in spec.sort)}" if spec.sort else ""
    if spec.combine == "values":
        rows = [f"SELECT {_list(zip(spec.outputs, map(literal, row), strict=True))}" for row in spec.values]
        if not rows:
            nothing = ((o, literal(None, t)) for o, t in zip(spec.outputs, spec.types, strict=True))
            return f"SELECT {_list(nothing)} WHERE FALSE"
        return f"SELECT * FROM ({' UNION ALL '.join(rows)}){order}"
    parts = [stitch_sql(p, name) if isinstance(p, Stitch) else branch_sql(p, name) for p in spec.parts]
    text = " UNION ALL ".join(f"({p})" for p in parts) if len(parts) > 1 else parts[0]
    if spec.combine == "empty":
        return f"SELECT * FROM ({text}) WHERE FALSE"
    if spec.combine == "union_sum":
        keys = [o for o in spec.outputs if o not in spec.sums]
        chosen = ", ".join([*map(ident, keys), *(f"sum({ident(m)}) AS {ident(m)}" for m in spec.sums)])
        text = f"SELECT {chosen} FROM ({text})" + (f" GROUP BY {', '.join(map(ident, keys))}" if keys else "")
    return f"SELECT * FROM ({text}){order}"
