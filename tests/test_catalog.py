"""Every query with an oracle equals DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from fusegrid.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    duck.sql(f"CREATE OR REPLACE TABLE want AS {catalog.ORACLES[name]}")
    duck.register("got", got)
    columns = sorted(duck.sql("SELECT * FROM want").columns)
    assert columns == sorted(got.column_names)
    k = ", ".join(f'"{c}"' for c in columns)
    assert not duck.sql(f"SELECT {k} FROM want EXCEPT ALL SELECT {k} FROM got").fetchall()
    assert not duck.sql(f"SELECT {k} FROM got EXCEPT ALL SELECT {k} FROM want").fetchall()
    assert got.num_rows


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count()


def test_flagship_has_no_product_and_no_python(spark):
    plan = catalog.QUERIES[catalog.FLAGSHIP](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_scans_read_only_what_they_use(spark):
    plan = catalog.QUERIES["voxel_antijoin"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
