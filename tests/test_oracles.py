"""Every query against its DuckDB SQL on the same Parquet files."""

import os

import duckdb
import pandas as pd
import pytest

from photonlake.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(pdf):
    def text(v):
        if isinstance(v, bool):
            return str(v)
        if v is None or v is pd.NA or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    columns = sorted(pdf.columns)
    return sorted(tuple(text(v) for v in r) for r in pdf[columns].itertuples(index=False, name=None)), columns


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got, want = rows(catalogue.QUERIES[name](spark, DATA).toPandas()), rows(duck.sql(catalogue.ORACLES[name]).df())
    assert got[1] == want[1]
    assert got[0] == want[0]


def test_upsert_rows_where_ids_reach_the_added_ones(spark, tmp_path):
    """From a million events on, ids of stored rows (1000050: untouched, 1000100: updated) are also ids of added ones."""
    e = [(0, 1.5), (50, 2.5), (100, 3.5), (101, None), (1_000_000, 4.5), (1_000_050, 5.5), (1_000_050, 5.5), (1_000_100, 6.5), (1_000_151, 7.5), (None, 8.5)]
    spark.createDataFrame(e, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = rows(con.sql(catalogue.ORACLES["upsert_rows"]).df())
    assert len(want[0]) == 17
    assert rows(catalogue.QUERIES["upsert_rows"](spark, str(tmp_path)).toPandas()) == want


def test_every_query_has_sql_or_a_plain_version():
    from tests import test_plain_versions

    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) <= set(test_plain_versions.PLAIN)
