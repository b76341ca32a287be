"""Routes, selection and errors on specifications; and values in awkward cases."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from quernel import errors
from quernel.engine import Engine
from quernel.plans.request import Filter, QueryRequest
from quernel.functions.expressions import literal
from quernel.plans.router import plan
from quernel.plans.selector import diagnosis, select_datasets, select_for_join
from quernel.registry import engine, schema
from quernel.streaming import stream

SF = "/root/testdata/sf0.001"
MODEL = """
semantic_models:
  - name: m
    dimensions:
      - {name: d, table: dim, attributes: [{name: key, column: id, type: i32}, {name: label, column: name}]}
      - {name: dates, attributes: [{name: year, type: i32}]}
      - {name: _dataset, virtual: true, attributes: [{name: partition}, {name: datasetGroup}, {name: uuid}]}
    dataset_groups:
      - name: a
        dimensions: [{name: d, join: {left_key: k, right_key: id}}, {name: dates, attributes: [{name: year, type: i32}]}, {name: _dataset}]
        measures: [{name: x, aggregation: sum, expr: v}, {name: n, aggregation: count, expr: v}, {name: odd, aggregation: sum, expr: my-col}]
        datasets:
          - {name: fact, source: {type: parquet, path: none}, dimensions: {d: [key, label], dates: [year], _dataset: [datasetGroup, uuid]}, measures: [x, n, odd]}
      - name: b
        dimensions: [{name: dates, attributes: [{name: year, type: i32}]}, {name: _dataset}]
        measures: [{name: y, aggregation: avg, expr: v}]
        datasets:
          - {name: p1, partition: "1", source: {type: parquet, path: none}, dimensions: {dates: [year], _dataset: [partition, datasetGroup]}, measures: [y]}
          - {name: p2, partition: "2", source: {type: parquet, path: none}, dimensions: {dates: [year], _dataset: [partition, datasetGroup]}, measures: [y]}
    metrics:
      - {name: x, expr: x}
      - {name: odd, expr: odd}
      - {name: y, expr: y}
      - {name: ratio, expr: {divide: [x, {subtract: [n, n]}]}}
      - {name: both, expr: {case: {when: [{condition: {eq: [datasetGroup.name, a]}, then: x}, {condition: {eq: [datasetGroup.name, b]}, then: y}]}}}
"""


@pytest.fixture(scope="module")
def own(spark):
    fact = spark.createDataFrame([(1, 2020, 1.0, 5.0), (1, 2020, 2.0, None), (2, 2021, 4.0, 1.0), (None, None, 8.0, 1.0), (9, 2020, 16.0, 1.0)], "k int, year int, v double, `my-col` double")
    dim = spark.createDataFrame([(1, "one"), (2, "two"), (2, "two again")], "id int, name string")
    p1 = spark.createDataFrame([(2020, 1.0), (2020, 3.0)], "year int, v double")
    return Engine(spark, MODEL, {"fact": fact, "dim": dim, "p1": p1, "p2": spark.createDataFrame([], "year int, v double")})


def got(engine, **request):
    return [tuple(r) for r in engine.query({"model": "m", **request}).collect()]


def test_unmatched_and_duplicate_keys(own):
    """No match groups under NULL, last; duplicate dimension keys multiply, as a left join does."""
    assert got(own, rows=["d.label"], metrics=["x"]) == [("one", 3.0), ("two", 4.0), ("two again", 4.0), (None, 24.0)]


def test_null_keys_and_odd_names(own):
    assert got(own, rows=["a.dates.year"], metrics=["odd"]) == [(2020, 6.0), (2021, 1.0), (None, 1.0)]


def test_zero_divisor_is_null(own):
    assert got(own, rows=["a.dates.year"], metrics=["ratio"]) == [(2020, None), (2021, None), (None, None)]


def test_empty_partition_and_pruning(own):
    assert got(own, rows=["b.dates.year", "_dataset.partition"], metrics=["y"]) == [(2020, "1", 2.0)]
    pruned = {"rows": ["_dataset.partition"], "metrics": ["y"], "filter": [{"field": "_dataset.partition", "value": "2"}]}
    assert len(own.plan({"model": "m", **pruned}).branches) == 1
    assert got(own, **{**pruned, "filter": [{"field": "_dataset.partition", "value": "3"}]}) == []


def test_cross_metric_warns_of_averages(own):
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert got(own, rows=["dates.year"], metrics=["both"]) == [(2020, 21.0), (2021, 4.0), (None, 8.0)]
    assert any("y" in str(w.message) for w in said)


def test_filters(own):
    year = lambda op, v: got(own, rows=["a.dates.year"], metrics=["x"], filter=[{"field": "a.dates.year", "operator": op, "value": v}])
    assert year("=", 2021) == year(None, 2021) == year("in", 2021) == year(">", 2020) == year("neq", 2020) == [(2021, 4.0)]
    assert year(None, [2020, 2021]) == year("lte", 2021) == [(2020, 19.0), (2021, 4.0)]
    assert year("in", []) == []
    text = got(own, rows=["d.label"], metrics=["x"], filter={"field": "d.label", "value": "o'ne"})
    assert text == []


@pytest.mark.parametrize(("request_", "error"), [
    ({"model": "zz", "metrics": ["x"]}, errors.ModelNotFound), ({"model": "m"}, errors.EmptyQuery), ({"model": "m", "metrics": ["zz"]}, errors.MetricNotFound),
    ({"model": "m", "rows": ["year"], "metrics": ["x"]}, errors.InvalidAttributeFormat), ({"model": "m", "rows": ["a.b.c.d"], "metrics": ["x"]}, errors.InvalidAttributeFormat),
    ({"model": "m", "rows": ["a.zz.year"], "metrics": ["x"]}, errors.QuernelError), ({"model": "m", "rows": ["zz.dates.year"], "metrics": ["x"]}, errors.QuernelError),
    ({"model": "m", "rows": ["a.dates.year"], "metrics": ["x"], "filter": [{"field": "a.dates.year", "operator": "like", "value": 1}]}, errors.InvalidQuery),
    ({"model": "m", "rows": ["dates.year"], "metrics": ["both", "x"]}, errors.InvalidQuery), ({"model": "m", "colums": []}, errors.InvalidQuery),
    ({"model": "m", "rows": ["a.dates.year", "_dataset.uuid"], "metrics": ["x"]}, errors.MetaAttributeNotSet),
])
def test_errors(own, request_, error):
    with pytest.raises(error):
        own.query(request_).collect()


def test_ambiguous_groups_and_diagnosis():
    """Both groups have years and n: without a name neither is chosen; what no dataset has is named."""
    shop = schema().model("shop")
    with pytest.raises(errors.AmbiguousDatasetGroup, match="ord.*li"):
        select_datasets(shop, ["dates.year"], ["n"])
    assert [(g.name, d.name) for g, d in select_datasets(shop, ["li.dates.year"], ["n"])] == [("li", "li")]
    with pytest.raises(errors.NoFeasibleDataset) as said:
        select_datasets(shop, ["status.status", "flags.returnflag"], ["n"])
    assert "ord.ord lacks flags.returnflag" in str(said.value) and "li.li lacks status.status" in str(said.value)
    assert "ord.ord lacks price" in diagnosis(shop, ["dates.year"], ["price"])
    with pytest.raises(errors.AmbiguousDatasetGroup):
        select_for_join(shop, ["ord.dates.year", "li.dates.year"], ["n"])


def test_partitions_are_all_chosen():
    own = select_datasets(schema().model("parted"), ["priority.priority"], ["sales"])
    assert [d.name for _, d in own] == ["ord_F", "ord_O", "ord_P"]


def test_literals(spark):
    """JSON values of every kind come back from the SQL that they are written as."""
    values = [None, True, False, 1.5, -3, 10**12, "o'x", "back\\slash", ""]
    row = spark.sql("SELECT " + ", ".join(literal(v) for v in values)).first()
    assert list(row) == values


def test_routes():
    how = lambda model, **r: plan(schema(), {"model": model, **r})
    assert how("levels", rows=["dates.year"], metrics=["sales"]).branches[0].dataset == "ord_year"
    assert how("levels", rows=["dates.year", "status.status"], metrics=["sales"]).branches[0].dataset == "ord_year_status"
    spec = how("sales", rows=["parts.brand"], metrics=["revenue"])
    assert (spec.combine, len(spec.branches), len(spec.branches[0].joins)) == ("single", 1, 1)
    assert len(how("flat", rows=["parts.brand"], metrics=["revenue"]).branches[0].joins) == 0
    assert json.loads(spec.to_json())["combine"] == "single" and "parts.brand" in spec.explain()


def test_pushdown_and_pruning(spark):
    """Filters and needed columns reach the scan, and nothing else is read."""
    df = engine(spark, SF).query({"model": "sales", "rows": ["flags.returnflag"], "metrics": ["quantity"], "filter": [{"field": "flags.linestatus", "value": "O"}]})
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linestatus,O)" in text
    assert text.count("FileScan") == 1 and "l_extendedprice" not in text.split("ReadSchema")[1]


def test_request_forms():
    r = QueryRequest.of({"model": "m", "rows": ["a.b"], "columns": ["a.b", "c.d"], "metrics": None, "dimensions": ["x"], "filter": {"field": "a.b", "value": 1}})
    assert r.paths == ["a.b", "c.d"] and r.filters == (Filter("a.b", 1),)


def test_stream(spark, tmp_path):
    spark.range(10).select((F.col("id") % 2).cast("int").alias("year"), F.col("id").cast("double").alias("v"), F.lit(1).alias("k")).write.parquet(str(tmp_path / "in"))
    facts = spark.readStream.schema("year int, v double, k int").parquet(str(tmp_path / "in"))
    q = stream(Engine(spark, MODEL, {"fact": facts}), {"model": "m", "rows": ["a.dates.year"], "metrics": ["x"]}, "streamed", str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("streamed").collect())) == [(0, 20.0), (1, 25.0)]


def test_stream_into_a_sink(spark, tmp_path):
    spark.range(10).select((F.col("id") % 2).cast("int").alias("year"), F.col("id").cast("double").alias("v"), F.lit(1).alias("k")).write.parquet(str(tmp_path / "in"))
    facts = spark.readStream.schema("year int, v double, k int").parquet(str(tmp_path / "in"))
    write = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out"))
    q = stream(Engine(spark, MODEL, {"fact": facts}), {"model": "m", "rows": ["a.dates.year"], "metrics": ["x"]}, "sunk", str(tmp_path / "c"), write)
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(0, 20.0), (1, 25.0)]
