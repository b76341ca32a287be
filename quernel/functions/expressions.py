"""Measure, condition and metric expressions of the model, turned into Spark SQL text.

The text goes both into DataFrame columns (``F.expr``) and into emitted SQL, so the two cannot
differ.  Names are bound by a callback, which knows what a name stands for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from ..errors import ParseError

Bind = Callable[[str], str]
ARITHMETIC = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}
COMPARISON = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
NO_NUMBER = "CAST(NULL AS DOUBLE)"
GROUP_NAME = "datasetGroup.name"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value, kind: str = "string") -> str:
    """A value as SQL; None is a NULL of type ``kind``."""
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value) if -(1 << 31) <= value < 1 << 31 else f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise ParseError(f"not a literal: {value!r}")


def _node(expr) -> tuple[str, object]:
    if not isinstance(expr, dict) or len(expr) != 1:
        raise ParseError(f"an expression has one operator: {expr!r}")
    return next(iter(expr.items()))


def _binary(op: str, args: list[str]) -> str:
    """Two operands; more are ignored and missing ones are NULL, as the model language has it."""
    a, b = [*args, NO_NUMBER, NO_NUMBER][:2]
    if op == "divide":
        return f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
    return f"({a} {ARITHMETIC[op]} {b})"


def measure_sql(expr, bind: Bind) -> str:
    """A row-level expression; a bare string names a column."""
    if isinstance(expr, bool):
        raise ParseError("a bare boolean is no expression; write {literal: true}")
    if isinstance(expr, str):
        return bind(expr)
    if isinstance(expr, int | float):
        return literal(expr)
    op, value = _node(expr)
    if op == "column":
        return bind(value)
    if op == "literal":
        return literal(value)
    if op in ARITHMETIC:
        return _binary(op, [measure_sql(x, bind) for x in value])
    if op == "case":
        return _case(value, lambda x: measure_sql(x, bind), lambda c: condition_sql(c, bind))
    raise ParseError(f"unknown measure operator {op!r}")


def _case(case: dict, part: Bind, test: Bind) -> str:
    whens = " ".join(f"WHEN {test(w['condition'])} THEN {part(w['then'])}" for w in case["when"])
    other = f" ELSE {part(case['else'])}" if case.get("else") is not None else ""
    return f"CASE {whens}{other} END"


def condition_sql(cond, bind: Bind) -> str:
    op, value = _node(cond)
    if op in COMPARISON:
        if len(value) != 2:
            raise ParseError(f"{op} takes two operands")
        a, b = (measure_sql(x, bind) for x in value)
        return f"({a} {COMPARISON[op]} {b})"
    if op in ("and", "or"):
        parts = [condition_sql(c, bind) for c in value]
        if not parts:
            return "TRUE" if op == "and" else "FALSE"
        return f"({f' {op.upper()} '.join(parts)})" if len(parts) > 1 else parts[0]
    if op == "is_null":
        return f"({bind(value)} IS NULL)"
    if op == "is_not_null":
        return f"({bind(value)} IS NOT NULL)"
    raise ParseError(f"unknown condition {op!r}")


def columns_of(expr) -> Iterator[str]:
    """The column names in a measure expression."""
    found: list[str] = []
    measure_sql(expr, lambda name: found.append(name) or ident(name))
    return iter(dict.fromkeys(found))


def metric_sql(expr, bind: Bind) -> str:
    """An expression over aggregated measures; a bare string names a measure."""
    if isinstance(expr, str):
        return bind(expr)
    if isinstance(expr, int | float) and not isinstance(expr, bool):
        return literal(float(expr))
    op, value = _node(expr)
    if op == "measure":
        return bind(value)
    if op == "literal":
        return literal(float(value))
    if op in ARITHMETIC:
        return _binary(op, [metric_sql(x, bind) for x in value])
    if op == "case":
        raise ParseError("a CASE in a metric chooses by datasetGroup.name, at the top only")
    raise ParseError(f"unknown metric operator {op!r}")


def measures_of(expr) -> list[str]:
    """The measures a metric expression needs, each once, all branches of a CASE included."""
    if isinstance(expr, dict) and "case" in expr:
        case = expr["case"]
        parts = [w["then"] for w in case["when"]] + ([case["else"]] if case.get("else") is not None else [])
        return list(dict.fromkeys(m for p in parts for m in measures_of(p)))
    found: list[str] = []
    metric_sql(expr, lambda name: found.append(name) or name)
    return list(dict.fromkeys(found))


def group_choices(expr) -> list[tuple[str, str]] | None:
    """(dataset group, measure) of a metric that chooses by group; None for any other metric."""
    if not (isinstance(expr, dict) and "case" in expr):
        return None
    whens = expr["case"]["when"]
    if not any(GROUP_NAME in args for w in whens for args in w["condition"].values()):
        return None
    out = []
    for w in whens:
        op, args = _node(w["condition"])
        then = w["then"]["measure"] if isinstance(w["then"], dict) and "measure" in w["then"] else w["then"]
        if op == "eq" and len(args) == 2 and GROUP_NAME in args and isinstance(then, str):
            out += [(a, then) for a in args if a != GROUP_NAME and isinstance(a, str)]
    return out
