"""Every query against its SQL on the smallest tables, by the driver's own kind of comparison."""

import glob
import math
import os

import duckdb
import pytest

from configlens.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(frame):
    cell = lambda x: "NULL" if x is None or x != x else repr(round(x, 9)) if isinstance(x, float) and not math.isnan(x) else str(x)
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, sf_dir, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_have_rows(spark, sf_dir, name):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_statuses_are_not_all_alike(spark, sf_dir):
    for name, column in (("snapshot_compare", "status"), ("host_status", "status"), ("host_catalog", "severity"), ("telemetry_evaluation", "status"), ("retention", "drop_reason")):
        assert QUERIES[name](spark, sf_dir.replace("0.001", "0.01")).select(column).distinct().count() >= 2, name
