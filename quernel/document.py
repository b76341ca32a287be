"""The shape of a model's YAML document as JSON Schema, for editors and other tools.

It describes the snake_case spelling; the reader takes camelCase as well.  References between
names are beyond a schema: ``Engine.problems`` checks them.
"""

from __future__ import annotations

from .model import AGGREGATIONS

TEXT, FLAG, TEXTS = {"type": "string"}, {"type": "boolean"}, {"type": "array", "items": {"type": "string"}}
ABOUT = {"label": TEXT, "description": TEXT}


def _ref(name: str) -> dict:
    return {"$ref": f"#/$defs/{name}"}


def _list(name: str) -> dict:
    return {"type": "array", "items": _ref(name)}


def _record(required: str, **fields: dict) -> dict:
    return {"type": "object", "required": required.split(), "properties": fields, "additionalProperties": False}


def json_schema() -> dict:
    """JSON Schema (draft 2020-12) of a model document."""
    figure = {"name": TEXT, "expr": _ref("expression"), "type": TEXT, **ABOUT, "synonyms": TEXTS, "hidden": FLAG, "format": TEXT}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        **_record("semantic_models", semantic_models=_list("model")),
        "$defs": {
            "model": _record("name dataset_groups", name=TEXT, namespace=TEXT, data_filter={}, dimensions=_list("dimension"), dataset_groups=_list("group"), metrics=_list("metric"), **ABOUT),
            "dimension": _record("name", name=TEXT, virtual=FLAG, source=_ref("source"), table=TEXT, alias=TEXT, attributes=_list("attribute"), **ABOUT),
            "attribute": _record("name", name=TEXT, column=TEXT, type=TEXT, examples={"type": "array"}, **ABOUT),
            "group": _record("name datasets", name=TEXT, partition_label=TEXT, dimensions=_list("group_dimension"), measures=_list("measure"), datasets=_list("dataset"), **ABOUT),
            "group_dimension": _record("name", name=TEXT, join=_ref("join"), attributes=_list("attribute"), **ABOUT),
            "join": _record("left_key right_key", left_key=TEXT, right_key=TEXT, right_alias=TEXT),
            "measure": _record("name aggregation expr", aggregation={"enum": sorted(AGGREGATIONS)}, data_filter={}, **figure),
            "metric": _record("name expr", **figure),
            "dataset": {
                **_record(
                    "", name=TEXT, dataset=TEXT, source=_ref("source"), uuid=TEXT, partition={"type": ["string", "number"]}, measures=TEXTS,
                    dimensions={"type": "object", "additionalProperties": TEXTS}, properties={"type": "object"}, columns=_list("column"), **ABOUT,
                ),
                "anyOf": [{"required": ["name"]}, {"required": ["dataset"]}],
            },
            "column": _record("name", name=TEXT, type=TEXT),
            "source": {"oneOf": [_record("type path", type={"const": "parquet"}, path=TEXT), _record("type table", type={"const": "iceberg"}, table=TEXT)]},
            "expression": {"description": "a column or measure, a literal, raw SQL, or an operator with its operands", "type": ["string", "number", "boolean", "object", "array", "null"]},
        },
    }
