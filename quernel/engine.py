"""The entry point: a model, a catalog, and requests answered with DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import Dataset, DatasetGroup, Schema, load, loads, problems
from .operators import compile_spec
from .plans import QueryRequest, QuerySpec
from .plans.router import Planner
from .plans.sql import spec_sql
from .sources import Catalog


class Engine:
    """Answers requests over the models of a schema.

    ``tables`` are DataFrames (or functions that give one) by dataset or dimension-table name; what
    is not among them is read from its declared source.
    """

    def __init__(self, spark: SparkSession, schema: Schema | str, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self.spark = spark
        self.schema = schema if isinstance(schema, Schema) else (loads(schema) if "\n" in schema else load(schema))
        self.catalog = Catalog(spark, tables)

    def plan(self, request: QueryRequest | dict) -> QuerySpec:
        """The specification: no table is read beyond its schema."""
        request = QueryRequest.of(request)
        model = self.schema.model(request.model)

        def columns(group: DatasetGroup, dataset: Dataset) -> set[str]:
            return set(self.catalog.fact(model, group, dataset).columns)

        return Planner(model, request, columns).plan()

    def _table(self, spec: QuerySpec):
        model = self.schema.model(spec.model)

        def table(group: str | None, name: str) -> DataFrame:
            if group is None:
                return self.catalog.dimension(model, model.dimension(name))
            own = model.group(group)
            return self.catalog.fact(model, own, next(d for d in own.datasets if d.name == name))

        return table

    def query(self, request: QueryRequest | dict, ordered: bool = True) -> DataFrame:
        spec = self.plan(request)
        return compile_spec(self.spark, spec, self._table(spec), ordered)

    def sql(self, request: QueryRequest | dict) -> str:
        """The request as Spark SQL; the tables it names become temporary views."""
        spec = self.plan(request)
        table = self._table(spec)
        return spec_sql(spec, lambda group, name: self.catalog.view(f"{spec.model}_{group or 'dim'}_{name}", table(group, name)))

    def explain(self, request: QueryRequest | dict) -> str:
        return self.plan(request).explain()

    def problems(self) -> list[str]:
        return problems(self.schema)

    def describe(self) -> DataFrame:
        """What can be asked for, for user interfaces: a row per model, group, dataset, dimension, attribute, measure, metric."""
        rows = []

        def add(model, kind, name, x=None, type_=None, **more):
            get = lambda k: getattr(x, k, None)
            many = lambda k: json.dumps(list(get(k) or ()))
            rows.append((model, kind, name, type_, get("label"), get("description"), many("synonyms"), many("examples"), bool(get("hidden")), get("format"), json.dumps(more, sort_keys=True, default=str)))

        for m in self.schema.models:
            add(m.name, "model", m.name, namespace=m.namespace, data_filter=m.data_filter)
            for d in m.dimensions:
                add(m.name, "dimension", d.name, d, virtual=d.virtual, table=d.table)
                for a in d.attributes:
                    add(m.name, "attribute", f"{d.name}.{a.name}", a, a.type)
            for g in m.dataset_groups:
                add(m.name, "group", g.name, g, partition_label=g.partition_label)
                for d in g.dimensions:
                    for a in d.attributes or ():
                        add(m.name, "attribute", f"{g.name}.{d.name}.{a.name}", a, a.type)
                for x in g.measures:
                    add(m.name, "measure", f"{g.name}.{x.name}", x, x.type, aggregation=x.aggregation, data_filter=x.data_filter)
                for x in g.datasets:
                    add(m.name, "dataset", f"{g.name}/{x.name}", x, partition=x.partition, uuid=x.uuid, attributes=x.attribute_count)
            for x in m.metrics:
                add(m.name, "metric", x.name, x, x.type)
        kinds = "model string, kind string, name string, type string, label string, description string, synonyms string, examples string, hidden boolean, format string, more string"
        return self.spark.createDataFrame(rows, kinds)
