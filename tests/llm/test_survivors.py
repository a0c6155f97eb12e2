import os

import pytest
from pyspark.sql import functions as F

from platewright.llm import catalog
from platewright.llm.survivorship import by_order, discover, is_filled
from tests.util import SMALL, database, empty_tables, rows

SCHEMA = "id bigint, g string, a string, b string, src string, trust int, conf double, at timestamp"
ORDER = [("trust", True), ("conf", True), ("at", True)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at")).withColumn("value", F.lit("clash")).withColumn("group_id", F.lit(-1))


def test_order_nulls_ties_repeats(spark):
    t0, t1 = "2024-01-01 00:00:00", "2024-01-01 00:00:00.000001"
    df = frame(spark, [
        (1, "x", "low", None, "s", 1, 0.9, t0), (2, "x", "n/a", "B", "s", 5, 0.9, t0), (3, "x", "tie", " ", "s", 3, None, t1), (4, "x", "later", "?", "s", 3, 0.1, t0), (5, "x", "later2", "?", "s", 3, 0.1, t1), (6, "x", "later3", "", "s", 3, 0.1, t1),
        (7, None, "one", None, None, None, None, None), (8, None, "two", None, None, None, None, None), (9, "z", " ", "unknown", "s", 1, 1.0, t0),
    ])
    got = {r.g: r for r in by_order(df, ["g"], ["a", "b"], "id", ORDER).collect()}
    assert (got["x"].group_id, got["x"].n_rows, got["x"].a_id, got["x"].b_id) == (1, 6, 5, 2)
    assert (got[None].a, got[None].a_id, got[None].b_id) == ("one", 7, None)
    assert got["z"].a is None and got["z"].b_id is None
    assert by_order(df.limit(0), ["g"], ["a"], "id", ORDER).count() == 0


def test_filled(spark):
    texts = [None, "", " ", " ", "​", "-", "?", "N/A", " Unknown ", "not given", "Eocene", "0"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(is_filled(F.col("t"))).collect()
    assert [r[0] for r in got] == [False] * 10 + [True, True]


def test_truth_discovery_trusts_who_is_right(spark):
    """Two copying liars are as many as the honest in some groups; elsewhere they're found out."""
    data, k = [], 0
    for g in range(60):
        claims = {"good": "t", "ok": "t", "fair": "t" if g % 4 else "f1", "bad": f"w{g}", "bad2": f"v{g}"}
        if g < 10:
            claims = {"good": "t", "ok": "t", "bad": "w", "bad2": "w"}
        for src, v in claims.items():
            k += 1
            data.append((k, str(g), v, None, src, 1, 1.0, None))
    df = frame(spark, data + [(9999, "10", "t", None, "good", 1, 1.0, None), (10000, "70", None, None, "good", 1, 1.0, None), (10001, "71", "only", None, None, 1, 1.0, None)])
    winners, sources = discover(df, ["g"], ["a", "b"], "id", "src")
    got = {r.g: r for r in winners.collect()}
    reliability = {r.src: r.reliability for r in sources.collect()}
    assert reliability["good"] > reliability["bad"] and reliability["fair"] > reliability["bad"]
    assert sum(got[str(g)].value == "t" for g in range(60)) == 60
    assert "70" not in got and got["71"].value == "only" and all(0 < r.support <= 1.0000001 for r in got.values())
    assert discover(df.limit(0), ["g"], ["a"], "id", "src")[0].count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert rows(catalog.queries()[name](spark, SMALL).toPandas()) == rows(database(SMALL).execute(catalog.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_queries_on_small_and_empty_tables(spark, tmp_path):
    nothing = empty_tables(spark, SMALL, str(tmp_path))
    for name, q in catalog.queries().items():
        if name.endswith(("_found", "_ids", "_pack", "_fill")):
            assert q(spark, SMALL).count() > 0, name
            assert q(spark, nothing).count() == 0, name
