"""Every query with SQL against DuckDB on the smallest tables; the rest run."""

import os

import pytest

from platewright import catalog
from tests.util import SMALL, database, empty_tables, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    mine, theirs = QUERIES[name](spark, SMALL).toPandas(), con.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return empty_tables(spark, SMALL, str(tmp_path_factory.mktemp("empty")))


@pytest.mark.parametrize("name", ["p1_found", "p1_units", "p6_found", "match_panels_heuristic", "nms_boxes", "taxon_lexicon_match", "kg_edges", "tei_captions", "iou_eval_prf"])
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() <= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
