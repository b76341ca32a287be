"""Variables in the places of sources: ``{model.name}`` and the like."""

from __future__ import annotations

import re

from ..errors import SourceError
from ..model import Dataset, DatasetGroup, Dimension, SemanticModel

_VARIABLE = re.compile(r"\{([^{}]*)\}")


def fill(template: str, known: dict[str, str | None]) -> str:
    """``template`` with its variables put in; one without a value or unknown is an error."""

    def value(m: re.Match) -> str:
        name = m[1].strip()
        if name not in known:
            raise SourceError(f"unknown variable {m[0]} in {template!r}")
        if known[name] is None:
            raise SourceError(f"{m[0]} is used in {template!r} but not set")
        return known[name]

    return _VARIABLE.sub(value, template)


def dataset_place(model: SemanticModel, group: DatasetGroup, dataset: Dataset) -> str:
    """The dataset's path or table, resolved."""
    known = {"model.name": model.name, "model.namespace": model.namespace, "datasetGroup.name": group.name, "dataset.name": dataset.name, "dataset.uuid": dataset.uuid}
    return fill(dataset.source.place, known)


def resolve_dimension_template(template: str, model: str, namespace: str | None, dimension: str, table: str | None) -> str:
    known = {"model.name": model, "model.namespace": namespace, "dimension.name": dimension, "dimension.table": table}
    return fill(template, known)


def dimension_place(model: SemanticModel, dimension: Dimension) -> str:
    return resolve_dimension_template(dimension.source.place, model.name, model.namespace, dimension.name, dimension.table)
