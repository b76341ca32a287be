"""What a caller asks for."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import InvalidQuery
from ..functions.expressions import literal

#: Operator spellings and the SQL for them.
OPERATORS = {"eq": "=", "=": "=", "neq": "<>", "!=": "<>", "lt": "<", "<": "<", "lte": "<=", "<=": "<=", "gt": ">", ">": ">", "gte": ">=", ">=": ">=", "in": "IN"}


@dataclass(frozen=True)
class Filter:
    """A condition on one attribute; without an operator a list means IN and a scalar equality."""

    field: str
    value: object
    operator: str | None = None

    def sql(self, left: str) -> str:
        op = OPERATORS.get((self.operator or ("in" if isinstance(self.value, list | tuple) else "eq")).lower())
        if op is None:
            raise InvalidQuery(f"unknown filter operator {self.operator!r}")
        if op == "IN":
            values = self.value if isinstance(self.value, list | tuple) else [self.value]
            return f"({left} IN ({', '.join(map(_scalar, values))}))" if values else "FALSE"
        return f"({left} {op} {_scalar(self.value)})"


def _scalar(value) -> str:
    return literal(None if isinstance(value, dict | list | tuple) else value)


@dataclass(frozen=True)
class QueryRequest:
    """Attributes for rows and columns (both are grouped by), metrics, and filters, all of which hold."""

    model: str
    rows: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()

    @property
    def paths(self) -> list[str]:
        return list(dict.fromkeys([*self.rows, *self.columns]))

    @classmethod
    def of(cls, request: QueryRequest | dict) -> QueryRequest:
        """From a mapping as it comes as JSON; ``dimensions`` is accepted and means nothing."""
        if isinstance(request, cls):
            return request
        if unknown := set(request) - {"model", "rows", "columns", "metrics", "filter", "filters", "dimensions"}:
            raise InvalidQuery(f"unknown fields in the request: {sorted(unknown)}")
        filters = request.get("filter") or request.get("filters") or []
        filters = filters if isinstance(filters, list | tuple) else [filters]
        made = [f if isinstance(f, Filter) else Filter(f["field"], f.get("value"), f.get("operator")) for f in filters]
        get = lambda k: tuple(request.get(k) or ())
        return cls(request["model"], get("rows"), get("columns"), get("metrics"), tuple(made))
