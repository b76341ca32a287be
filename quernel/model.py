"""The semantic model: what is declared in YAML, as plain dataclasses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from .errors import ModelIoError, ModelNotFound, ParseError, YamlError
from .functions.expressions import columns_of, group_choices, measures_of
from .types import parse_type

VIRTUAL = "_dataset"
AGGREGATIONS = {
    "sum": "sum", "avg": "avg", "average": "avg", "count": "count", "min": "min", "minimum": "min", "max": "max", "maximum": "max",
    "count_distinct": "count_distinct", "countdistinct": "count_distinct", "count-distinct": "count_distinct", "distinct": "count_distinct",
}


@dataclass(frozen=True)
class Source:
    """Where rows lie: a Parquet path (a template) or a catalog table."""

    kind: str
    place: str


@dataclass(frozen=True)
class Join:
    left_key: str
    right_key: str
    right_alias: str | None = None


@dataclass(frozen=True)
class Attribute:
    name: str
    column: str
    type: str = "string"
    label: str | None = None
    description: str | None = None
    examples: tuple = ()


@dataclass(frozen=True)
class Dimension:
    name: str
    attributes: tuple[Attribute, ...] = ()
    virtual: bool = False
    source: Source | None = None
    table: str | None = None
    alias: str | None = None
    label: str | None = None
    description: str | None = None

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    def key_attribute(self, join: Join) -> Attribute | None:
        """The attribute that is the join's right key, if any is."""
        return next((a for a in self.attributes if a.column == join.right_key), None)


@dataclass(frozen=True)
class GroupDimension:
    """A group's use of a dimension; without a join its columns are the fact's."""

    name: str
    join: Join | None = None
    attributes: tuple[Attribute, ...] | None = None
    label: str | None = None

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes or () if a.name == name), None)


@dataclass(frozen=True)
class Measure:
    name: str
    aggregation: str
    expr: object
    type: str
    label: str | None = None
    description: str | None = None
    synonyms: tuple = ()
    hidden: bool = False
    format: str | None = None
    data_filter: object = None


@dataclass(frozen=True)
class Metric:
    name: str
    expr: object
    type: str = "double"
    label: str | None = None
    description: str | None = None
    synonyms: tuple = ()
    hidden: bool = False
    format: str | None = None

    @property
    def choices(self) -> list[tuple[str, str]] | None:
        """For a metric across groups: (group, measure) pairs."""
        return group_choices(self.expr)

    @property
    def measures(self) -> list[str]:
        return measures_of(self.expr)


@dataclass(frozen=True)
class Dataset:
    name: str
    source: Source | None
    dimensions: dict[str, tuple[str, ...]]
    measures: tuple[str, ...]
    uuid: str | None = None
    partition: str | None = None
    properties: dict = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)
    label: str | None = None
    description: str | None = None

    @property
    def attribute_count(self) -> int:
        """How fine the dataset is: fewer attributes are more aggregated."""
        return sum(map(len, self.dimensions.values()))


@dataclass(frozen=True)
class DatasetGroup:
    name: str
    dimensions: tuple[GroupDimension, ...]
    measures: tuple[Measure, ...]
    datasets: tuple[Dataset, ...]
    label: str | None = None
    description: str | None = None
    partition_label: str | None = None

    def dimension(self, name: str) -> GroupDimension | None:
        return next((d for d in self.dimensions if d.name == name), None)

    def measure(self, name: str) -> Measure | None:
        return next((m for m in self.measures if m.name == name), None)

    @property
    def partitioned(self) -> bool:
        return any(d.partition is not None for d in self.datasets)


@dataclass(frozen=True)
class SemanticModel:
    name: str
    dataset_groups: tuple[DatasetGroup, ...]
    dimensions: tuple[Dimension, ...] = ()
    metrics: tuple[Metric, ...] = ()
    namespace: str | None = None
    data_filter: object = None

    def dimension(self, name: str) -> Dimension | None:
        return next((d for d in self.dimensions if d.name == name), None)

    def group(self, name: str) -> DatasetGroup | None:
        return next((g for g in self.dataset_groups if g.name == name), None)

    def metric(self, name: str) -> Metric | None:
        return next((m for m in self.metrics if m.name == name), None)

    def is_virtual(self, dimension: str) -> bool:
        found = self.dimension(dimension)
        return dimension == VIRTUAL or (found is not None and found.virtual)

    def is_conformed(self, paths: list[str]) -> bool:
        """Whether all paths have two parts and name dimensions of the model itself."""
        return bool(paths) and all(len(p.split(".")) == 2 and self.dimension(p.split(".")[0]) for p in paths)


@dataclass(frozen=True)
class Schema:
    models: tuple[SemanticModel, ...]

    def model(self, name: str) -> SemanticModel:
        found = next((m for m in self.models if m.name == name), None)
        if found is None:
            raise ModelNotFound(f"no model {name!r}; there are {[m.name for m in self.models]}")
        return found

    def datasets(self) -> list[str]:
        """The names of all tables, facts and dimensions, sorted."""
        facts = {d.name for m in self.models for g in m.dataset_groups for d in g.datasets}
        return sorted(facts | {d.table for m in self.models for d in m.dimensions if d.table})


# --- reading


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


_FREE = {"properties", "dimensions", "expr"}  # below these, keys of maps are data


def _keys(node, free: bool = False):
    """The document with camelCase keys written in snake_case."""
    if isinstance(node, list):
        return [_keys(x) for x in node]
    if not isinstance(node, dict):
        return node
    if free:
        return node
    return {_snake(k): _keys(v, _snake(k) in _FREE and isinstance(v, dict)) for k, v in node.items()}


def load(path: str | Path) -> Schema:
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise ModelIoError(str(e)) from e
    return loads(text)


def loads(text: str) -> Schema:
    """The schema in a YAML text."""
    try:
        doc = _keys(yaml.safe_load(text))
    except yaml.YAMLError as e:
        raise YamlError(str(e)) from e
    try:
        schema = Schema(tuple(_model(m) for m in doc["semantic_models"]))
    except (KeyError, TypeError, AttributeError, ValueError) as e:
        raise YamlError(f"not a model: {type(e).__name__} {e}") from e
    for m in schema.models:
        check_names(m)
    return schema


def check_names(m: SemanticModel) -> None:
    """Paths are split at dots, so what they name must not hold any."""
    names = [g.name for g in m.dataset_groups] + [d.name for d in m.dimensions] + [a.name for d in m.dimensions for a in d.attributes]
    names += [d.name for g in m.dataset_groups for d in g.dimensions] + [a.name for g in m.dataset_groups for d in g.dimensions for a in d.attributes or ()]
    if bad := [n for n in names if "." in n]:
        raise ParseError(f"names of groups, dimensions and attributes hold no dots: {bad}")


def problems(schema: Schema) -> list[str]:
    """References that lead nowhere; an empty list for a sound schema."""
    out = []
    for m in schema.models:
        for g in m.dataset_groups:
            for d in g.dimensions:
                if d.join and not m.dimension(d.name):
                    out.append(f"{m.name}.{g.name}: joined dimension {d.name} is not declared in the model")
            for x in g.datasets:
                out += [f"{m.name}.{g.name}.{x.name}: no measure {k}" for k in x.measures if not g.measure(k)]
                for dim, attrs in x.dimensions.items():
                    own, shared = g.dimension(dim), m.dimension(dim)
                    if own is None and not m.is_virtual(dim):
                        out.append(f"{m.name}.{g.name}.{x.name}: no dimension {dim}")
                    elif own is not None and not m.is_virtual(dim):
                        out += [f"{m.name}.{g.name}.{x.name}: no attribute {dim}.{a}" for a in attrs if not own.attribute(a) and not (shared and shared.attribute(a))]
        known = {x.name for g in m.dataset_groups for x in g.measures}
        out += [f"{m.name}: metric {x.name} needs unknown measure {k}" for x in m.metrics for k in x.measures if k not in known]
    return out


def _source(s: dict | None) -> Source | None:
    if s is None:
        return None
    if s["type"] == "parquet":
        return Source("parquet", s["path"])
    if s["type"] == "iceberg":
        return Source("iceberg", s["table"])
    raise ParseError(f"unknown source type {s['type']!r}")


def _attribute(a: dict) -> Attribute:
    return Attribute(a["name"], a.get("column") or a["name"], parse_type(a.get("type", "string")), a.get("label"), a.get("description"), tuple(a.get("examples") or ()))


def _attributes(xs) -> tuple[Attribute, ...]:
    return tuple(_attribute(a) for a in xs or ())


def _dimension(d: dict) -> Dimension:
    return Dimension(d["name"], _attributes(d.get("attributes")), bool(d.get("virtual", False)), _source(d.get("source")), d.get("table"), d.get("alias"), d.get("label"), d.get("description"))


def _group_dimension(d: dict) -> GroupDimension:
    join = d.get("join")
    own = None if d.get("attributes") is None else _attributes(d["attributes"])
    return GroupDimension(d["name"], Join(join["left_key"], join["right_key"], join.get("right_alias")) if join else None, own, d.get("label"))


def _measure(m: dict) -> Measure:
    how = AGGREGATIONS.get(str(m["aggregation"]).lower())
    if how is None:
        raise ParseError(f"unknown aggregation {m['aggregation']!r}")
    list(columns_of(m["expr"]))  # raises where the expression is none
    default = "i64" if how in ("count", "count_distinct") else "f64"
    return Measure(m["name"], how, m["expr"], parse_type(m.get("type", default)), m.get("label"), m.get("description"), tuple(m.get("synonyms") or ()), bool(m.get("hidden", False)), m.get("format"), m.get("data_filter"))


def _metric(m: dict) -> Metric:
    out = Metric(m["name"], m["expr"], parse_type(m.get("type", "f64")), m.get("label"), m.get("description"), tuple(m.get("synonyms") or ()), bool(m.get("hidden", False)), m.get("format"))
    if out.choices is None:
        _ = out.measures
    return out


def _dataset(d: dict) -> Dataset:
    dims = {k: tuple(v or ()) for k, v in (d.get("dimensions") or {}).items()}
    columns = {c["name"]: parse_type(c.get("type", "string")) for c in d.get("columns") or ()}
    partition = d.get("partition")
    return Dataset(
        d.get("name") or d["dataset"], _source(d.get("source")), dims, tuple(d.get("measures") or ()), d.get("uuid"),
        None if partition is None else str(partition), dict(d.get("properties") or {}), columns, d.get("label"), d.get("description"),
    )


def _group(g: dict) -> DatasetGroup:
    return DatasetGroup(
        g["name"], tuple(_group_dimension(d) for d in g.get("dimensions") or ()), tuple(_measure(m) for m in g.get("measures") or ()),
        tuple(_dataset(d) for d in g["datasets"]), g.get("label"), g.get("description"), g.get("partition_label"),
    )


def _model(m: dict) -> SemanticModel:
    # "dimensions" of a model is a list; only a dataset's is a map of names
    dims = m.get("dimensions") or []
    return SemanticModel(m["name"], tuple(_group(g) for g in m["dataset_groups"]), tuple(_dimension(d) for d in dims), tuple(_metric(x) for x in m.get("metrics") or ()), m.get("namespace"), m.get("data_filter"))
