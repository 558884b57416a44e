"""Every query with SQL against DuckDB on the smallest tables; all others run and keep their schema."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from fixwave import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu" or df[c].map(lambda v: isinstance(v, (float, np.floating))).any():
            df[c] = pd.to_numeric(df[c]).astype(float).round(6)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v is pd.NaT else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, sf, name):
    ours, theirs = registry.queries()[name](spark, sf).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(normal(ours), normal(theirs), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.count() >= 0 and df.columns


def test_scans_are_pruned_and_filtered(spark, sf, capsys):
    registry.queries()["j_four_way"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "o_orderdate" in plan and "PushedFilters: [IsNotNull(o_orderdate)" in plan and "o_comment" not in plan


def test_range_joins_are_equi_joins(spark, sf, capsys):
    for name in ("j_range_pairs", "j_window_interval", "j_near_pairs"):
        registry.queries()[name](spark, sf).explain("formatted")
    assert "NestedLoop" not in (plan := capsys.readouterr().out) and "CartesianProduct" not in plan


def test_difference_of_keys_takes_all_orders(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (1, 2, 3, 3, 4)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 2), (7, 4), (8, 4), (15, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.k for r in registry.queries()["u_except"](spark, str(tmp_path)).collect()) == [1, 3]
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(registry.oracle_sql()["u_except"]).fetchall()) == [(1,), (3,)]
