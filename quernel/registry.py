"""Queries over the TPC-H-like tables, one or more for every operator, and the same in DuckDB's SQL.

The models in ``models/tpch.yaml`` express no functions, so years and pre-aggregates are columns
of views that ``tables`` derives.  Sums of doubles depend on their order; both sides round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .model import Schema, load
from .operators.combine import join_counts, union_all

DIGITS = 2


@cache
def schema() -> Schema:
    return load(Path(__file__).parent / "models" / "tpch.yaml")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """Facts and dimension tables by the names that the models use.

    Stitches need keys that one side lacks, so two of the pre-aggregates leave rows out by
    definition: ``ord_summary`` has no pending orders (status P), ``ord_top`` none up to 1993.
    Queries read all of the tables that they are defined over; a table is opened when asked for.
    """
    read = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    li = cache(lambda: read("lineitem").withColumn("ship_year", F.year("l_shipdate")))
    orders = cache(lambda: read("orders").withColumn("order_year", F.year("o_orderdate")))
    brands = lambda: read("part").select("p_partkey", F.col("p_brand").alias("brand"))
    by = lambda df, keys, measure: df.groupBy(*keys).agg(measure)
    year, status, detail = ["order_year"], ["order_year", "o_orderstatus"], ["order_year", "o_orderstatus", "o_orderpriority"]
    return {
        "part": lambda: read("part"), "supplier": lambda: read("supplier"), "li": li,
        "ord": lambda: orders().withColumn("s", F.col("o_totalprice")),
        "li_flat": lambda: li().join(brands(), F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey"),
        "ord_year": lambda: by(orders(), year, F.sum("o_totalprice").alias("s")),
        "ord_year_status": lambda: by(orders(), status, F.sum("o_totalprice").alias("s")),
        **{f"ord_{x}": lambda x=x: orders().where(F.col("o_orderstatus") == x) for x in "FOP"},
        "ord_summary": lambda: by(orders().where("o_orderstatus <> 'P'"), status, F.sum("o_totalprice").alias("total")),
        "ord_detail": lambda: by(orders(), detail, F.count("o_orderkey").alias("orders")),
        "ord_top": lambda: by(orders().where("order_year > 1993"), detail, F.max("o_totalprice").alias("dearest")),
    }


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, schema(), tables(spark, sf_dir))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(df[f"`{c}`"], DIGITS).alias(c) if t == "double" else df[f"`{c}`"] for c, t in df.dtypes))


def ask(spark: SparkSession, sf_dir: str, request: dict) -> DataFrame:
    return rounded(engine(spark, sf_dir).query(request))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Derived tables in the SQL texts.
VIEWS = {
    "LI": "(SELECT *, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem)",
    "ORD": "(SELECT *, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders)",
}
VIEWS["SUMMARY"] = f"(SELECT order_year, o_orderstatus, SUM(o_totalprice) AS total FROM {VIEWS['ORD']} WHERE o_orderstatus <> 'P' GROUP BY 1, 2)"
VIEWS["DETAIL"] = f"(SELECT order_year, o_orderstatus, o_orderpriority, COUNT(o_orderkey) AS orders FROM {VIEWS['ORD']} GROUP BY 1, 2, 3)"
VIEWS["TOP"] = f"(SELECT order_year, o_orderstatus, o_orderpriority, MAX(o_totalprice) AS dearest FROM {VIEWS['ORD']} WHERE order_year > 1993 GROUP BY 1, 2, 3)"


def with_views(sql: str) -> str:
    for name, text in VIEWS.items():
        sql = sql.replace("{" + name + "}", text)
    return sql


def add(name: str, model: str, sql: str, **request) -> None:
    QUERIES[name] = partial(ask, request={"model": model, **request})
    ORACLE_SQL[name] = with_views(sql)


def grouped(key: str, path: str, *measures: str, where: str = "", frm: str = "{LI}") -> str:
    """SELECT key AS path, measures ... GROUP BY key."""
    return f'SELECT {key} AS "{path}", {", ".join(measures)} FROM {frm} t{" WHERE " + where if where else ""} GROUP BY {key}'


R = "ROUND(SUM({}), 2) AS {}"
PART = "{LI} t LEFT JOIN part ON l_partkey = p_partkey"

# --- scans, joins, grouping
add("star_one_dim", "sales", f'SELECT p_brand AS "parts.brand", ROUND(SUM(l_extendedprice), 2) AS revenue FROM {PART} GROUP BY 1', rows=["parts.brand"], metrics=["revenue"])
add("star_two_dims", "sales", f'SELECT p_brand AS "parts.brand", s_nationkey AS "suppliers.nation", ROUND(SUM(l_extendedprice), 2) AS revenue FROM {PART} LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2', rows=["parts.brand", "suppliers.nation"], metrics=["revenue"])
add("denorm_dim", "flat", f'SELECT p_brand AS "parts.brand", ROUND(SUM(l_extendedprice), 2) AS revenue FROM {PART} GROUP BY 1', rows=["parts.brand"], metrics=["revenue"])
add("mixed_dims", "flat", 'SELECT s_nationkey AS "suppliers.nation", l_returnflag AS "flags.returnflag", ROUND(SUM(l_extendedprice), 2) AS revenue FROM {LI} t LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2', rows=["suppliers.nation", "flags.returnflag"], metrics=["revenue"])
add("dims_only", "sales", 'SELECT DISTINCT p_brand AS "parts.brand", l_returnflag AS "flags.returnflag" FROM ' + PART, rows=["parts.brand", "flags.returnflag"])
add("global_agg", "sales", "SELECT ROUND(SUM(l_extendedprice), 2) AS revenue, COUNT(l_orderkey) AS lines FROM lineitem", metrics=["revenue", "lines"])
add("rows_and_columns", "sales", 'SELECT l_returnflag AS "flags.returnflag", ship_year AS "ship.year", ROUND(SUM(l_extendedprice), 2) AS revenue FROM {LI} t GROUP BY 1, 2', rows=["flags.returnflag"], columns=["ship.year"], metrics=["revenue"])
add("dim_key", "sales", f'SELECT p_partkey AS "parts.part", ROUND(SUM(l_quantity), 2) AS quantity FROM {PART} GROUP BY 1', rows=["parts.part"], metrics=["quantity"])

# --- aggregates and measure expressions
for _name, _metric, _sql in [
    ("agg_sum", "revenue", R.format("l_extendedprice", "revenue")),
    ("agg_avg", "average_price", "ROUND(AVG(l_extendedprice), 2) AS average_price"),
    ("agg_count", "lines", "COUNT(l_orderkey) AS lines"),
    ("agg_count_distinct", "orders", "COUNT(DISTINCT l_orderkey) AS orders"),
    ("agg_min", "least", "ROUND(MIN(l_extendedprice), 2) AS least"),
    ("agg_max", "most", "ROUND(MAX(l_extendedprice), 2) AS most"),
    ("measure_add", "taxed", R.format("l_extendedprice + l_tax", "taxed")),
    ("measure_sub", "reduced", R.format("l_extendedprice - l_discount", "reduced")),
    ("measure_mul", "rebate", R.format("l_extendedprice * l_discount", "rebate")),
    ("measure_div", "unit", R.format("l_extendedprice / NULLIF(l_quantity, 0)", "unit")),
    ("measure_literal", "ones", "CAST(SUM(1) AS BIGINT) AS ones"),
    ("measure_case", "big", R.format("CASE WHEN l_quantity > 30 THEN l_extendedprice ELSE 0 END", "big")),
    ("measure_case_and", "big_returned", R.format("CASE WHEN l_quantity >= 10 AND l_returnflag = 'R' THEN l_extendedprice ELSE 0 END", "big_returned")),
    ("measure_case_or", "odd_ones", "CAST(SUM(CASE WHEN l_quantity < 5 OR l_discount <= 0.01 THEN 1 WHEN l_linestatus <> 'O' THEN 2 ELSE 0 END) AS BIGINT) AS odd_ones"),
    ("measure_case_null", "known", "CAST(SUM(CASE WHEN l_tax IS NULL THEN 0 WHEN l_discount IS NOT NULL THEN 1 END) AS BIGINT) AS known"),
    ("measure_raw_sql", "net", R.format("l_extendedprice * (1 - l_discount)", "net")),
    ("metric_add", "sum_of_two", "ROUND(SUM(l_extendedprice) + SUM(l_quantity), 2) AS sum_of_two"),
    ("metric_sub", "profit", "ROUND(SUM(l_extendedprice) - SUM(l_extendedprice * l_discount), 2) AS profit"),
    ("metric_mul", "doubled", "ROUND(SUM(l_extendedprice) * 2, 2) AS doubled"),
    ("metric_div", "unit_price", "ROUND(SUM(l_extendedprice) / NULLIF(SUM(l_quantity), 0), 2) AS unit_price"),
    ("metric_nested", "margin", "ROUND((SUM(l_extendedprice) - SUM(l_extendedprice * l_discount)) / NULLIF(SUM(l_extendedprice), 0), 2) AS margin"),
    ("metric_passthrough", "quantity", R.format("l_quantity", "quantity")),
]:
    add(_name, "sales", grouped("l_returnflag", "flags.returnflag", _sql), rows=["flags.returnflag"], metrics=[_metric])

add("agg_four", "sales", grouped("l_returnflag", "flags.returnflag", "COUNT(DISTINCT l_orderkey) AS orders", "ROUND(AVG(l_extendedprice), 2) AS average_price", "ROUND(MIN(l_extendedprice), 2) AS least", "ROUND(MAX(l_extendedprice), 2) AS most"), rows=["flags.returnflag"], metrics=["orders", "average_price", "least", "most"])

# --- filters
for _name, _op, _value, _where in [
    ("filter_eq", None, 5, "p_size = 5"), ("filter_neq", "neq", 5, "p_size <> 5"), ("filter_lt", "lt", 10, "p_size < 10"), ("filter_lte", "<=", 10, "p_size <= 10"),
    ("filter_gt", "gt", 40, "p_size > 40"), ("filter_gte", ">=", 40, "p_size >= 40"), ("filter_in", None, [1, 2, 3], "p_size IN (1, 2, 3)"), ("filter_in_scalar", "in", 7, "p_size IN (7)"),
]:
    _filter = {"field": "parts.size", "value": _value} | ({"operator": _op} if _op else {})
    add(_name, "sales", f'SELECT p_brand AS "parts.brand", ROUND(SUM(l_quantity), 2) AS quantity FROM {PART} WHERE {_where} GROUP BY 1', rows=["parts.brand"], metrics=["quantity"], filter=[_filter])
add("filter_and", "sales", f'SELECT p_brand AS "parts.brand", COUNT(l_orderkey) AS lines FROM {PART} WHERE p_size > 10 AND l_returnflag = \'R\' AND ship_year IN (1995, 1996) GROUP BY 1', rows=["parts.brand"], metrics=["lines"], filter=[{"field": "parts.size", "operator": "gt", "value": 10}, {"field": "flags.returnflag", "value": "R"}, {"field": "ship.year", "value": [1995, 1996]}])
add("filter_unprojected_dim", "sales", grouped("l_linestatus", "flags.linestatus", "COUNT(l_orderkey) AS lines", where="p_type LIKE '%' AND s_nationkey < 12", frm="{LI} u LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey").replace(" t WHERE p_type LIKE '%' AND", " WHERE"), rows=["flags.linestatus"], metrics=["lines"], filter=[{"field": "suppliers.nation", "operator": "lt", "value": 12}])
add("filter_date", "sales", grouped("l_returnflag", "flags.returnflag", "COUNT(l_orderkey) AS lines", where="l_shipdate >= TIMESTAMP '1996-01-01'"), rows=["flags.returnflag"], metrics=["lines"], filter=[{"field": "ship.date", "operator": "gte", "value": "1996-01-01"}])
add("filter_denormalized", "flat", f'SELECT l_returnflag AS "flags.returnflag", ROUND(SUM(l_extendedprice), 2) AS revenue FROM {PART} WHERE p_brand <> \'Brand#11\' GROUP BY 1', rows=["flags.returnflag"], metrics=["revenue"], filter=[{"field": "parts.brand", "operator": "!=", "value": "Brand#11"}])

# --- aggregate awareness
add("agg_aware_year", "levels", grouped("order_year", "dates.year", R.format("o_totalprice", "sales"), frm="{ORD}"), rows=["dates.year"], metrics=["sales"])
add("agg_aware_year_status", "levels", 'SELECT order_year AS "dates.year", o_orderstatus AS "status.status", ROUND(SUM(o_totalprice), 2) AS sales FROM {ORD} t GROUP BY 1, 2', rows=["dates.year", "status.status"], metrics=["sales"])
add("agg_aware_detail", "levels", 'SELECT order_year AS "dates.year", o_orderpriority AS "priority.priority", ROUND(SUM(o_totalprice), 2) AS sales FROM {ORD} t GROUP BY 1, 2', rows=["dates.year", "priority.priority"], metrics=["sales"])

# --- metadata
add("meta_group", "sales", 'SELECT l_returnflag AS "flags.returnflag", \'li\' AS "_dataset.datasetGroup", COUNT(l_orderkey) AS lines FROM lineitem GROUP BY 1', rows=["flags.returnflag", "_dataset.datasetGroup"], metrics=["lines"])
add("meta_model_namespace", "sales", "SELECT 'sales' AS \"_dataset.model\", 'shop-7' AS \"_dataset.namespace\", COUNT(l_orderkey) AS lines FROM lineitem", rows=["_dataset.model", "_dataset.namespace"], metrics=["lines"])
add("meta_uuid_properties", "sales", "SELECT '5f0c-77' AS \"_dataset.uuid\", 'sales team' AS \"_dataset.owner\", COUNT(l_orderkey) AS lines FROM lineitem", rows=["_dataset.uuid", "_dataset.owner"], metrics=["lines"])
add("meta_null", "sales", "SELECT CAST(NULL AS VARCHAR) AS \"_dataset.region\", COUNT(l_orderkey) AS lines FROM lineitem", rows=["_dataset.region"], metrics=["lines"])
add("virtual_only", "shop", "SELECT 'ord' AS \"_dataset.datasetGroup\" UNION ALL SELECT 'li'", rows=["_dataset.datasetGroup"])
add("virtual_conformed_metric", "shop", "SELECT 'ord' AS \"_dataset.datasetGroup\", COUNT(o_orderkey) AS n FROM orders UNION ALL SELECT 'li', COUNT(l_orderkey) FROM lineitem", rows=["_dataset.datasetGroup"], metrics=["n"])
add("virtual_only_partition", "parted", "SELECT 'ord' AS \"_dataset.datasetGroup\", p AS \"_dataset.partition\" FROM (VALUES ('F'), ('O'), ('P')) v(p) UNION ALL SELECT 'li', NULL", rows=["_dataset.datasetGroup", "_dataset.partition"])

# --- unions
_BY_PART = " UNION ALL ".join(f"SELECT order_year AS \"dates.year\", '{x}' AS \"_dataset.partition\", ROUND(SUM(o_totalprice), 2) AS sales FROM {{ORD}} t WHERE o_orderstatus = '{x}' GROUP BY 1" for x in "FOP")
add("partition_union", "parted", _BY_PART, rows=["dates.year", "_dataset.partition"], metrics=["sales"])
add("partition_union_detail", "parted", " UNION ALL ".join(f"SELECT o_orderpriority AS \"priority.priority\", ROUND(SUM(o_totalprice), 2) AS sales FROM orders WHERE o_orderstatus = '{x}' GROUP BY 1" for x in "FOP"), rows=["priority.priority"], metrics=["sales"])
add("partition_conformed_no_metrics", "parted", " UNION ALL ".join([*(f"SELECT DISTINCT order_year AS \"dates.year\", '{x}' AS \"_dataset.partition\" FROM {{ORD}} t WHERE o_orderstatus = '{x}'" for x in "FOP"), "SELECT DISTINCT ship_year, NULL FROM {LI} t"]), rows=["dates.year", "_dataset.partition"])
add("partition_pruned", "parted", "SELECT 'O' AS \"_dataset.partition\", ROUND(SUM(o_totalprice), 2) AS sales FROM orders WHERE o_orderstatus = 'O'", rows=["_dataset.partition"], metrics=["sales"], filter=[{"field": "_dataset.partition", "value": "O"}])
add("partition_all_pruned", "parted", "SELECT order_year AS \"dates.year\", ROUND(SUM(o_totalprice), 2) AS sales FROM {ORD} t WHERE FALSE GROUP BY 1", rows=["dates.year"], metrics=["sales"], filter=[{"field": "_dataset.partition", "value": "X"}])
add("conformed_union", "shop", 'SELECT order_year AS "dates.year", COUNT(o_orderkey) AS n FROM {ORD} t GROUP BY 1 UNION ALL SELECT ship_year, COUNT(l_orderkey) FROM {LI} t GROUP BY 1', rows=["dates.year"], metrics=["n"])
add("conformed_single_group", "shop", grouped("order_year", "dates.year", "ROUND(SUM(o_totalprice), 2) AS only_orders", frm="{ORD}"), rows=["dates.year"], metrics=["only_orders"])
add("conformed_meta", "shop", "SELECT order_year AS \"dates.year\", 'ord' AS \"_dataset.datasetGroup\", 'shop-7' AS \"_dataset.namespace\", COUNT(o_orderkey) AS n FROM {ORD} t GROUP BY 1 UNION ALL SELECT ship_year, 'li', NULL, COUNT(l_orderkey) FROM {LI} t GROUP BY 1", rows=["dates.year", "_dataset.datasetGroup", "_dataset.namespace"], metrics=["n"])
add("conformed_filter", "shop", 'SELECT order_year AS "dates.year", COUNT(o_orderkey) AS n FROM {ORD} t WHERE order_year > 1995 GROUP BY 1 UNION ALL SELECT ship_year, COUNT(l_orderkey) FROM {LI} t WHERE ship_year > 1995 GROUP BY 1', rows=["dates.year"], metrics=["n"], filter=[{"field": "dates.year", "operator": "gt", "value": 1995}])
add("qualified_single", "shop", grouped("order_year", "ord.dates.year", "COUNT(o_orderkey) AS n", frm="{ORD}"), rows=["ord.dates.year"], metrics=["n"])
add("qualified_multi", "shop", 'SELECT order_year AS "ord.dates.year", CAST(NULL AS INTEGER) AS "li.dates.year", COUNT(o_orderkey) AS n FROM {ORD} t GROUP BY 1 UNION ALL SELECT NULL, ship_year, COUNT(l_orderkey) FROM {LI} t GROUP BY 2', rows=["ord.dates.year", "li.dates.year"], metrics=["n"])
add("qualified_meta", "shop", "SELECT o_orderstatus AS \"ord.status.status\", CAST(NULL AS VARCHAR) AS \"li.flags.returnflag\", 'ord' AS \"_dataset.datasetGroup\", COUNT(o_orderkey) AS n FROM orders GROUP BY 1 UNION ALL SELECT NULL, l_returnflag, 'li', COUNT(l_orderkey) FROM lineitem GROUP BY 2", rows=["ord.status.status", "li.flags.returnflag", "_dataset.datasetGroup"], metrics=["n"])

# --- metrics across groups
_BOTH = "(SELECT order_year AS y, 'ord' AS g, SUM(o_totalprice) AS m FROM {ORD} t GROUP BY 1 UNION ALL SELECT ship_year, 'li', SUM(l_extendedprice) FROM {LI} t GROUP BY 1) u"
add("cross_metric", "shop", f'SELECT y AS "dates.year", ROUND(SUM(m), 2) AS amount FROM {_BOTH} GROUP BY 1', rows=["dates.year"], metrics=["amount"])
add("cross_metric_meta", "shop", f'SELECT y AS "dates.year", g AS "_dataset.datasetGroup", ROUND(SUM(m), 2) AS amount FROM {_BOTH} GROUP BY 1, 2', rows=["dates.year", "_dataset.datasetGroup"], metrics=["amount"])
add("cross_metric_filter", "shop", f'SELECT y AS "dates.year", ROUND(SUM(m), 2) AS amount FROM {_BOTH} WHERE y < 1996 GROUP BY 1', rows=["dates.year"], metrics=["amount"], filter=[{"field": "dates.year", "operator": "lt", "value": 1996}])
add("cross_metric_partitioned", "parted", f'SELECT y AS "dates.year", ROUND(SUM(m), 2) AS amount FROM {_BOTH} GROUP BY 1', rows=["dates.year"], metrics=["amount"])
add("cross_metrics_multi", "shop", 'SELECT y AS "dates.year", ROUND(SUM(a), 2) AS amount, ROUND(SUM(b), 2) AS qty FROM (SELECT order_year AS y, SUM(o_totalprice) AS a, CAST(NULL AS DOUBLE) AS b FROM {ORD} t GROUP BY 1 UNION ALL SELECT ship_year, SUM(l_extendedprice), SUM(l_quantity) FROM {LI} t GROUP BY 1) u GROUP BY 1', rows=["dates.year"], metrics=["amount", "qty"])
add("cross_qualified", "shop", 'SELECT a AS "ord.dates.year", b AS "li.dates.year", ROUND(SUM(m), 2) AS amount FROM (SELECT order_year AS a, CAST(NULL AS INTEGER) AS b, SUM(o_totalprice) AS m FROM {ORD} t GROUP BY 1 UNION ALL SELECT NULL, ship_year, SUM(l_extendedprice) FROM {LI} t GROUP BY 2) u GROUP BY 1, 2', rows=["ord.dates.year", "li.dates.year"], metrics=["amount"])

# --- measures spread over datasets
_JOIN = "a FULL JOIN (SELECT order_year AS y, o_orderstatus AS s, SUM(orders) AS n FROM {DETAIL} t GROUP BY 1, 2) b ON a.y IS NOT DISTINCT FROM b.y AND a.s IS NOT DISTINCT FROM b.s"
_TWO = "(SELECT order_year AS y, o_orderstatus AS s, SUM(total) AS sales FROM {SUMMARY} t GROUP BY 1, 2) " + _JOIN
_KEYS = 'COALESCE(a.y, b.y) AS "dates.year", COALESCE(a.s, b.s) AS "status.status"'
add("multi_dataset_join", "split", 'SELECT COALESCE(a.y, b.y) AS "dates.year", ROUND(a.sales, 2) AS sales, CAST(b.n AS BIGINT) AS n FROM (SELECT order_year AS y, SUM(total) AS sales FROM {SUMMARY} t GROUP BY 1) a FULL JOIN (SELECT order_year AS y, SUM(orders) AS n FROM {DETAIL} t GROUP BY 1) b ON a.y IS NOT DISTINCT FROM b.y', rows=["dates.year"], metrics=["sales", "n"])
add("multi_dataset_join_two_keys", "split", f"SELECT {_KEYS}, ROUND(a.sales, 2) AS sales, CAST(b.n AS BIGINT) AS n FROM {_TWO}", rows=["dates.year", "status.status"], metrics=["sales", "n"])
add("multi_dataset_join_three", "split", f"SELECT COALESCE(x.y, c.y) AS \"dates.year\", COALESCE(x.s, c.s) AS \"status.status\", ROUND(x.sales, 2) AS sales, CAST(x.n AS BIGINT) AS n, ROUND(c.d, 2) AS dear FROM (SELECT COALESCE(a.y, b.y) AS y, COALESCE(a.s, b.s) AS s, a.sales, b.n FROM {_TWO}) x FULL JOIN (SELECT order_year AS y, o_orderstatus AS s, MAX(dearest) AS d FROM {{TOP}} t GROUP BY 1, 2) c ON x.y IS NOT DISTINCT FROM c.y AND x.s IS NOT DISTINCT FROM c.s", rows=["dates.year", "status.status"], metrics=["sales", "n", "dear"])
add("multi_dataset_scalar", "split", "SELECT ROUND(a.sales, 2) AS sales, CAST(b.n AS BIGINT) AS n FROM (SELECT SUM(total) AS sales FROM {SUMMARY} t) a CROSS JOIN (SELECT SUM(orders) AS n FROM {DETAIL} t) b", metrics=["sales", "n"])
add("multi_dataset_virtual", "split", "SELECT 'ord' AS \"_dataset.datasetGroup\", ROUND(a.sales, 2) AS sales, CAST(b.n AS BIGINT) AS n FROM (SELECT SUM(total) AS sales FROM {SUMMARY} t) a CROSS JOIN (SELECT SUM(orders) AS n FROM {DETAIL} t) b", rows=["_dataset.datasetGroup"], metrics=["sales", "n"])
add("multi_dataset_derived_metric", "split", f"SELECT {_KEYS}, ROUND(CAST(a.sales AS DOUBLE) / NULLIF(CAST(b.n AS DOUBLE), 0), 2) AS average FROM {_TWO}", rows=["dates.year", "status.status"], metrics=["average"])
add("cross_multi_dataset", "split", f"SELECT {_KEYS}, ROUND(a.sales, 2) AS worth, CAST(b.n AS BIGINT) AS number FROM {_TWO}", rows=["dates.year", "status.status"], metrics=["worth", "number"])


# --- other ways in and out
def src_iceberg_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources named in the session's catalog, as Iceberg tables are."""
    for name in ("part", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"quernel_lake_{name}")
    return rounded(Engine(spark, schema()).query({"model": "lake", "rows": ["parts.brand"], "metrics": ["quantity"]}))


def src_parquet_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet source whose path is a template."""
    text = f"""
semantic_models:
  - name: orders
    dataset_groups:
      - name: g
        dimensions: [{{name: status, attributes: [{{name: status, column: o_orderstatus}}]}}]
        measures: [{{name: n, aggregation: count, expr: o_orderkey}}]
        datasets: [{{name: o, source: {{type: parquet, path: "{sf_dir}/{{model.name}}.parquet"}}, dimensions: {{status: [status]}}, measures: [n]}}]
    metrics: [{{name: n, expr: n}}]
"""
    return Engine(spark, text).query({"model": "orders", "rows": ["status.status"], "metrics": ["n"]})


def emitted(spark: SparkSession, sf_dir: str, request: dict) -> DataFrame:
    """The SQL text that a request gives, run."""
    return rounded(spark.sql(engine(spark, sf_dir).sql(request)))


def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without a match in the dimension group under NULL, which sorts last."""
    own = engine(spark, sf_dir)
    own.catalog.register("part", own.catalog.registered("part").where("p_size < 20"))
    return rounded(own.query({"model": "sales", "rows": ["parts.brand"], "metrics": ["quantity"]}))


def describe_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).describe().where("model = 'levels'").select("model", "kind", "name", "type")


def join_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the four join types over two whole tables: nations start at 0 and end at 24, sizes of parts run from 1 to 50."""
    supplier, part = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("supplier", "part"))
    counts = [join_counts(supplier, part, "s_nationkey", "p_size", how, "s_suppkey", "p_name").select(F.lit(how).alias("how"), "*") for how in ("inner", "left", "right", "full")]
    return union_all(counts)


#: Requests whose emitted SQL is run: every combiner, and the query of which the SQL for DuckDB is taken.
ROUNDTRIPS = {
    "sql_values": "virtual_only", "sql_left_join": "star_two_dims", "sql_filter": "filter_and", "sql_union": "conformed_union", "sql_partitions": "partition_union",
    "sql_union_sum": "cross_metrics_multi", "sql_cross": "multi_dataset_scalar", "sql_full_three": "multi_dataset_join_three", "sql_nothing": "partition_all_pruned",
}
for _name, _of in ROUNDTRIPS.items():
    QUERIES[_name] = partial(emitted, **QUERIES[_of].keywords)
    ORACLE_SQL[_name] = ORACLE_SQL[_of]
QUERIES["sql_roundtrip"] = partial(emitted, request={"model": "split", "rows": ["dates.year", "status.status"], "metrics": ["sales", "n", "average"], "filter": [{"field": "dates.year", "operator": "gt", "value": 1993}]})


for _query in (src_iceberg_view, src_parquet_template, sort_nulls_last, describe_model, join_types):
    QUERIES[_query.__name__] = _query
ORACLE_SQL["src_iceberg_view"] = 'SELECT p_brand AS "parts.brand", ROUND(SUM(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1'
ORACLE_SQL["src_parquet_template"] = 'SELECT o_orderstatus AS "status.status", COUNT(o_orderkey) AS n FROM orders GROUP BY 1'
ORACLE_SQL["sql_roundtrip"] = with_views(f"SELECT {_KEYS}, ROUND(a.sales, 2) AS sales, CAST(b.n AS BIGINT) AS n, ROUND(CAST(a.sales AS DOUBLE) / NULLIF(CAST(b.n AS DOUBLE), 0), 2) AS average FROM {_TWO} WHERE COALESCE(a.y, b.y) > 1993")
ORACLE_SQL["sort_nulls_last"] = 'SELECT p_brand AS "parts.brand", ROUND(SUM(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 20) p ON l_partkey = p_partkey GROUP BY 1'
ORACLE_SQL["describe_model"] = """
SELECT 'levels' AS model, kind, name, type FROM (VALUES
  ('model', 'levels', NULL), ('group', 'ord', NULL), ('attribute', 'ord.dates.year', 'int'), ('attribute', 'ord.dates.day', 'timestamp_ntz'),
  ('attribute', 'ord.status.status', 'string'), ('attribute', 'ord.priority.priority', 'string'), ('measure', 'ord.sales', 'double'),
  ('dataset', 'ord/ord', NULL), ('dataset', 'ord/ord_year_status', NULL), ('dataset', 'ord/ord_year', NULL), ('metric', 'sales', 'double')
) v(kind, name, type)"""
ORACLE_SQL["join_types"] = " UNION ALL ".join(
    f"SELECT '{how}' AS how, COUNT(*) AS n, COUNT(s_suppkey) AS left_rows, COUNT(p_name) AS right_rows FROM supplier {how.upper()} JOIN part ON s_nationkey = p_size" for how in ("inner", "left", "right", "full")
)
