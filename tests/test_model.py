"""Reading models: types, names, sources, templates, errors.  No Spark."""

import json

import pytest

from quernel import errors
from quernel.model import load, loads, problems
from quernel.registry import schema
from quernel.sources.templates import dataset_place, fill, resolve_dimension_template
from quernel.types import is_numeric, parse_type

TEXT = """
semantic_models:
  - name: m
    namespace: ns
    dimensions:
      - {name: dates, table: d, attributes: [{name: date, column: id, type: i32}, {name: year, type: int}]}
    datasetGroups:
      - name: g
        dimensions:
          - {name: dates, join: {leftKey: date_id, rightKey: id}}
          - {name: kind, attributes: [{name: kind}]}
        measures: [{name: n, aggregation: COUNT, expr: id}, {name: s, aggregation: average, expr: {add: [a, 1]}, hidden: true, synonyms: [x]}]
        datasets:
          - {dataset: f, uuid: u1, source: {type: parquet, path: "/x/{model.namespace}/{datasetGroup.name}/{dataset.uuid}"}, dimensions: {dates: [date, year], kind: [kind]}, measures: [n, s], properties: {camelCase: 1}}
    metrics: [{name: n, expr: n}, {name: r, expr: {divide: [s, {measure: n}]}}]
"""


def test_reads_both_spellings():
    m = loads(TEXT).model("m")
    g = m.group("g")
    assert g.dimension("dates").join.left_key == "date_id" and g.datasets[0].name == "f"
    assert g.measure("n").aggregation == "count" and g.measure("s").aggregation == "avg" and g.measure("s").hidden
    assert g.measure("n").type == "bigint" and g.measure("s").type == "double"
    assert g.datasets[0].attribute_count == 3 and g.datasets[0].properties == {"camelCase": 1}
    assert m.dimension("dates").key_attribute(g.dimension("dates").join).name == "date"
    assert m.is_conformed(["dates.year"]) and not m.is_conformed(["g.dates.year"]) and not m.is_conformed([])
    assert sorted(m.metric("r").measures) == ["n", "s"] and m.metric("n").choices is None
    assert loads(TEXT).datasets() == ["d", "f"] and problems(loads(TEXT)) == []


@pytest.mark.parametrize(("text", "want"), [("i8", "tinyint"), ("I16", "smallint"), ("integer", "int"), ("long", "bigint"), ("f32", "float"), ("double", "double"), ("bool", "boolean"), ("text", "string"), ("date", "date"), ("datetime", "timestamp_ntz"), ("decimal(10, 2)", "decimal(10,2)")])
def test_types(text, want):
    assert parse_type(text) == want
    assert is_numeric(want) == (want not in ("boolean", "string", "date", "timestamp_ntz"))


@pytest.mark.parametrize("text", ["uuid", "decimal(0,0)", "decimal(39,1)", "decimal(5,6)", "decimal(x)", ""])
def test_bad_types(text):
    with pytest.raises(errors.ParseError):
        parse_type(text)


@pytest.mark.parametrize("text", ["a: [", "x: 1", "semantic_models: [{name: m}]", TEXT.replace("COUNT", "median"), TEXT.replace("type: parquet", "type: csv"), TEXT.replace("name: kind}", "name: a.b}")])
def test_bad_models(text):
    with pytest.raises(errors.ParseError):
        loads(text)


def test_no_file():
    with pytest.raises(errors.ModelIoError):
        load("/nowhere.yaml")
    with pytest.raises(errors.ModelNotFound):
        loads(TEXT).model("other")


def test_problems_are_named():
    bad = TEXT.replace("measures: [n, s]", "measures: [n, zz]").replace("kind: [kind]", "kinds: [kind]").replace("{measure: n}", "{measure: q}")
    assert len(problems(loads(bad))) == 3
    assert problems(schema()) == []


def test_templates():
    m = loads(TEXT).model("m")
    assert dataset_place(m, m.group("g"), m.group("g").datasets[0]) == "/x/ns/g/u1"
    assert resolve_dimension_template("{model.name}/{dimension.table}/{dimension.name}", "m", None, "dates", "d") == "m/d/dates"
    for template in ("{model.namespace}", "{other}", "{dataset.name}"):
        with pytest.raises(errors.SourceError):
            resolve_dimension_template(template, "m", None, "dates", "d")
    assert fill("plain", {}) == "plain"


KINDS = {"string": str, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def faults(node, rule, root, at="$"):
    """What a document has against a schema, as far as this repository's schema goes."""
    if "$ref" in rule:
        rule = root["$defs"][rule["$ref"].rsplit("/", 1)[1]]
    if "oneOf" in rule:
        found = [faults(node, r, root, at) for r in rule["oneOf"]]
        return [] if sum(not f for f in found) == 1 else found[0]
    kinds = rule.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    out = [f"{at}: not {kinds}"] if kinds and not any(isinstance(node, KINDS[k]) for k in kinds) else []
    if ("const" in rule and node != rule["const"]) or ("enum" in rule and node not in rule["enum"]):
        out.append(f"{at}: {node!r}")
    if isinstance(node, dict) and "properties" in rule:
        out += [f"{at}: no {k}" for k in rule["required"] if k not in node] + [f"{at}.{k}: unknown" for k in node if k not in rule["properties"]]
        for k, v in node.items():
            out += faults(v, rule["properties"].get(k, {}), root, f"{at}.{k}")
    if isinstance(node, list):
        for n, v in enumerate(node):
            out += faults(v, rule.get("items", {}), root, f"{at}[{n}]")
    return out


def test_documents_follow_the_schema():
    from pathlib import Path

    import yaml

    import quernel
    from quernel.document import json_schema

    root = json_schema()
    json.loads(json.dumps(root))
    doc = yaml.safe_load((Path(quernel.__file__).parent / "models" / "tpch.yaml").read_text())
    assert faults(doc, root, root) == []
    doc["semantic_models"][0]["dataset_groups"][0]["measures"][0]["aggregation"] = "median"
    doc["semantic_models"][0]["colour"] = 1
    del doc["semantic_models"][1]["name"]
    assert len(faults(doc, root, root)) == 3
