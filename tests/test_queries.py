"""Registered queries on tables made by hand, against their SQL."""

import datetime

import duckdb
import pytest

import __spark_entry__ as driver


@pytest.fixture
def sparse(spark, tmp_path):
    """One order: a cell of the grid is filled, with little."""
    spark.createDataFrame([(0, 3)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 0, datetime.datetime(1996, 5, 4), "2-HIGH", 12.5)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def by_sql(folder: str, name: str, *tables: str) -> list[tuple]:
    with duckdb.connect() as c:
        for t in tables:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        return sorted(c.execute(driver.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name, n", [("grid_neighbors_6", 2162), ("voxel_to_mm", 420)])
def test_cells_with_little_or_nothing_are_in_the_result(spark, sparse, name, n):
    found = sorted(map(tuple, driver.queries()[name](spark, sparse).collect()))
    assert len(found) == n and found == by_sql(sparse, name, "orders", "customer")


@pytest.mark.parametrize("name", ["perm_verify", "perm_within_blocks"])
def test_exchanges_are_ranked_by_parts_and_not_broadcast(spark, tmp_path, name):
    spark.createDataFrame([(7 * k % 500, k % 3, float(k % 5 - 2)) for k in range(500)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    found = driver.queries()[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert "Broadcast" not in plan and windows and all("part#" in line for line in windows)
    assert sorted(map(tuple, found.collect())) == by_sql(str(tmp_path), name, "customer")
