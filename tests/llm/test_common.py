"""Lookups with few and with many keys, hot ones among them; saved tables."""

import os
import random
import time

import pytest

from quernel.llm import common

from .helpers import components


@pytest.mark.parametrize("sent", [1000, 1])
def test_lookups(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "SENT", sent)
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, rnd.randrange(40), None]), rnd.randrange(3), k) for k in range(600)]
    left = spark.createDataFrame(rows, "a long, b long, n long")
    known = {(a, b): a * 10 + b for a in range(20) for b in range(2)}
    weight = {k: sum((a, b) == k for a, b, _ in rows) for k in known}
    found = common.saved(spark.createDataFrame([(*k, v, weight[k]) for k, v in known.items()], "a long, b long, v long, w long"), "found")
    want = sorted(((a, b, n, known.get((a, b))) for a, b, n in rows), key=str)
    for more in ({"weight": "w"}, {}, {"length": "w"}):
        got = common.looked_up(left, found, ["a", "b"], **more).select("a", "b", "n", "v").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_components_of_many_edges(spark, monkeypatch):
    """The way for more edges than may be sent gives the same, hubs included."""
    monkeypatch.setattr(common, "SENT", 10)
    rnd = random.Random(2)
    edges = [(0, k) for k in range(1, 150)] + [(k, k + 1) for k in range(200, 260)] + [(rnd.randrange(300, 500), rnd.randrange(300, 500)) for _ in range(90)]
    want = components(500, edges)
    got = {r.id: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want[x] for a, b in edges if a != b for x in (a, b)}


def test_saved_tables_have_no_checksum_files(spark):
    df = common.saved(spark.range(50), "numbers")
    names = os.listdir(df._saved_at.removeprefix("file://"))
    assert any(x.endswith(".parquet") for x in names) and not any(x.endswith(".crc") for x in names)
    assert sorted(r.id for r in df.collect()) == list(range(50))
    common.dropped(df)


def test_saved_tables_leave_no_shuffle_files(spark):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {x for d in dirs for _, _, names in os.walk(d) for x in names if x.startswith("shuffle_")}
    before = files()
    rows = spark.range(5000).selectExpr("id % 700 AS k").groupBy("k").count()  # held on to, so that no garbage is collected
    df = common.saved(rows, "numbers")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before
    assert df.count() == rows.count() == 700 and spark.conf.get(common._TIDY) == "false"
    common.dropped(df)


def test_dropped_tables_are_gone(spark):
    df = common.saved(spark.range(5), "numbers")
    assert df.count() == 5
    common.dropped(df)
    with pytest.raises(Exception, match="(?i)not.*exist|FileNotFound|PATH_NOT_FOUND"):
        spark.read.parquet(df._saved_at).count()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())
