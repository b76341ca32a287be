"""Names of tables to DataFrames: what the host registered, or what the source says."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import SourceError
from ..functions.expressions import ident
from ..model import Dataset, DatasetGroup, Dimension, SemanticModel
from .templates import dataset_place, dimension_place


class Catalog:
    """Resolves facts and dimension tables.

    A registered table comes first, under the dataset's or the dimension table's name: a DataFrame,
    or a function that gives one and is called when the table is first asked for.  Otherwise a Parquet source is read from its path and an Iceberg source is a table of the
    session's catalog.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self.spark, self._tables = spark, dict(tables or {})
        self._read: dict[tuple[str, str], DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        self._tables[name] = df

    def registered(self, name: str | None) -> DataFrame | None:
        found = self._tables.get(name)
        if callable(found):
            found = self._tables[name] = found()
        return found

    def _open(self, kind: str, place: str) -> DataFrame:
        if (kind, place) not in self._read:
            self._read[kind, place] = self.spark.read.parquet(place) if kind == "parquet" else self.spark.table(place)
        return self._read[kind, place]

    def fact(self, model: SemanticModel, group: DatasetGroup, dataset: Dataset) -> DataFrame:
        if (own := self.registered(dataset.name)) is not None:
            return own
        if dataset.source is None:
            raise SourceError(f"dataset {dataset.name} is not registered and has no source")
        return self._open(dataset.source.kind, dataset_place(model, group, dataset))

    def dimension(self, model: SemanticModel, dimension: Dimension) -> DataFrame:
        for name in (dimension.table, dimension.name):
            if (own := self.registered(name)) is not None:
                return own
        if dimension.source is not None:
            return self._open(dimension.source.kind, dimension_place(model, dimension))
        raise SourceError(f"dimension {dimension.name} is not registered and has no source")

    def view(self, name: str, df: DataFrame) -> str:
        """A name for ``df`` in SQL text: a temporary view."""
        safe = "quernel_" + re.sub(r"\W", "_", name)
        df.createOrReplaceTempView(safe)
        return ident(safe)
