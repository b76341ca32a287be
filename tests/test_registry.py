"""Every registered query of the engine against the same in DuckDB's SQL, over whole tables."""

import math

import duckdb
import pytest

from quernel.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    norm = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted((tuple(map(norm, r)) for r in rows), key=str)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def joined_rows(df):
    """The most rows that a join of ``df``'s plan gave, once it has run."""
    df.collect()
    seen, most = [df._jdf.queryExecution().executedPlan()], []
    while seen:
        node = seen.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            seen.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            seen.append(node.plan())
        else:
            seen += [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in kind:
            most.append(node.metrics().apply("numOutputRows").value())
    return max(most)


def test_join_types_with_few_keys(spark, tmp_path):
    """Many rows a key, rows without a key or a counted value, keys of one side only: counts equal SQL's, and no pair becomes a row."""
    con = duckdb.connect()
    for name, columns, rows in [
        ("supplier", "s_suppkey bigint, s_nationkey int", [(k if k % 7 else None, k % 5 if k % 11 else None) for k in range(600)]),
        ("part", "p_name string, p_size int", [(f"p{k}" if k % 3 else None, k % 4 + 2 if k % 13 else None) for k in range(800)]),
    ]:
        for part, kept in (("all", rows), ("none", [])):
            spark.createDataFrame(kept, columns).coalesce(1).write.parquet(str(tmp_path / part / f"{name}.parquet"))
    for supplier, part in [("all", "all"), ("none", "all"), ("all", "none"), ("none", "none")]:
        place = tmp_path / f"{supplier}_{part}"
        place.mkdir()
        for name, of in (("supplier", supplier), ("part", part)):
            (place / f"{name}.parquet").symlink_to(tmp_path / of / f"{name}.parquet")
            con.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{place}/{name}.parquet/*.parquet'")
        df = QUERIES["join_types"](spark, str(place))
        assert plain(df.collect()) == plain(con.sql(ORACLE_SQL["join_types"]).fetchall())
        if (supplier, part) == ("all", "all"):
            assert joined_rows(df) <= 5 + 4 + 2  # keys of both sides and the two that are null


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_join_counts_are_those_of_join(spark, how):
    """Keys of different types, NaN and both zeros, the same names on both sides."""
    from quernel.operators.combine import join, join_counts

    nan = float("nan")
    a = spark.createDataFrame([(0.0, 1), (-0.0, None), (nan, 3), (nan, 4), (2.0, None), (None, 6), (7.0, 8)], "`k.x` double, v int")
    b = spark.createDataFrame([("0", "a"), ("-0.0", None), ("NaN", "c"), ("2", "d"), ("2.0", "e"), (None, None), ("9", "f")], "`k.x` string, v string")
    for left, right in ((a, b), (b, a), (a, spark.createDataFrame(a.collect()[:5], a.schema))):
        rows = [(r[1] is not None, r[3] is not None) for r in join(left, right, "k.x", "k.x", how).collect()]
        assert tuple(join_counts(left, right, "k.x", "k.x", how, "v", "v").first()) == (len(rows), sum(x for x, _ in rows), sum(y for _, y in rows))
    with pytest.raises(ValueError, match="outer space"):
        join_counts(a, b, "k.x", "k.x", "outer space", "v", "v")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["parts.brand", "revenue"]
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())


def test_entry_without_the_operators(spark, monkeypatch):
    """The folders of the operators and the pipeline over them may be gone."""
    import __spark_entry__ as e

    monkeypatch.setattr(e, "_found", lambda module: False)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE_SQL)
