"""The contract: every registered query runs on the smallest tables and its columns are those of its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from mergewell import catalog

DATA = "/root/testdata/sf0.001"


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted(map(str, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["q_email_norm", "q_skill_norm", "q_date_norm", "q_url_key", "q_match_first_rule", "q_components", "q_merge_lists", "q_provenance", "q_project_omit", "q_resume_first_hit"])
def test_query_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
