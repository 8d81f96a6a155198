"""Queries on scenes over tables that hold each customer and order four times: like rows meet once, results are those of the SQL."""

import duckdb
import oracle
import pytest

from furrow.checks import contract
from furrow.operators import scenes as S

SF = "/root/testdata/sf0.001"
TIMES = 4
# a multiple of every period of keys in boxes and seasons, so that copies are alike
SHIFT = 52560


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Folder and connection: customers and orders repeated with shifted keys."""
    folder, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for name, keys in {"customer": ["c_custkey"], "orders": ["o_custkey", "o_orderkey"]}.items():
        moved = ", ".join(f"({k} + i * {SHIFT})::BIGINT AS {k}" for k in keys)
        con.execute(f"COPY (SELECT t.* REPLACE ({moved}) FROM '{SF}/{name}.parquet' t, range({TIMES}) r(i)) TO '{folder}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.fixture()
def met(monkeypatch):
    """What each join on buckets of scenes gave."""
    made, real = [], S.bucket_join
    monkeypatch.setattr(S, "bucket_join", lambda *a: made.append(real(*a)) or made[-1])
    return made


def test_selection_sink(spark, copies, met):
    name, (folder, con) = "K7_selection_sink", copies
    query = contract.queries()[name]
    oracle.compare(spark, con, folder, name, query, contract.oracle_sql()[name])
    query(spark, SF)
    assert met[0].count() == met[1].count() > 0


def test_area_scene_join(spark, copies, met):
    name, (folder, con) = "J4_area_scene_join", copies
    query = contract.queries()[name]
    assert oracle.compare(spark, con, folder, name, query, contract.oracle_sql()[name]) == TIMES ** 2 * query(spark, SF).count()
    assert met[0].count() == met[1].count() > 0


def test_pairs_are_not_rounded(spark, copies):
    """Whatever is rounded is rounded before the joins, once a scene and not once a pair."""
    plan = contract.queries()["J4_area_scene_join"](spark, copies[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan[:plan.index("Join ")]


def test_nodata_of_copies(spark, copies):
    name, (folder, con) = "A11_nodata_percent", copies
    query = contract.queries()[name]
    assert oracle.compare(spark, con, folder, name, query, contract.oracle_sql()[name]) == TIMES ** 2 * query(spark, SF).count()


def test_shares_are_rounded_before_copies_are_joined_on(spark, copies):
    plan = contract.queries()["A11_nodata_percent"](spark, copies[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan and "round(" not in plan[:plan.index("Join ")]


def test_pairs_are_made_by_many_tasks(spark, copies):
    """Few bytes make many pairs, so tasks of the last join are not merged by their bytes."""
    made = contract.queries()["A11_nodata_percent"](spark, copies[0]).rdd.getNumPartitions()
    assert made >= 8 * spark.sparkContext.defaultParallelism
