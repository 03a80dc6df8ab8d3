import importlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stationspark import registry, registry_sql
from stationspark.sources import derived, ingest

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_flagship(spark):
    assert entry.entry(spark).count() > 1000


def test_rounds_as_the_sql_does(spark):
    values = [v / n * 9 / 5 + 32 for n in (128, 640) for v in range(-n, n)] + [-1.0000005, 2.5e-7, 0.4999995, 1e300, float("inf")]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::double, 6)", [v]).fetchall()[0][0] for v in values]
    got = spark.createDataFrame(list(enumerate(values)), "k int, v double").select("k", registry.six_places(F.col("v")).alias("v")).collect()
    assert [r.v for r in sorted(got)] == want


def _tied(folder, small):
    """Shipments of which each stands three times with its order, line number, device and time, but other readings; the SQL's
    table has the first of the three alone, as its ORDER BY leaves open which of them it takes."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    copies = f"SELECT l.* REPLACE (l_partkey + 96 * k AS l_partkey, l_suppkey + 4 * k AS l_suppkey, (l_quantity + k * 7) % 50 AS l_quantity) FROM '{small}/lineitem.parquet' l, (SELECT unnest([2, 0, 1]) AS k)"
    con.sql(f"COPY ({copies}) TO '{folder}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    same = "l_suppkey % 4, l_shipdate, (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 96, l_orderkey, l_linenumber"
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet', file_row_number = true) QUALIFY row_number() OVER (PARTITION BY {same} ORDER BY file_row_number) = 1")
    return con


def test_of_tied_shipments_the_first_in_the_file_wins(spark, small, tmp_path):
    con = _tied(tmp_path, small)
    raw = derived.ship_raw(spark, str(tmp_path))
    moved = raw.repartition(5, "wind_dir").sortWithinPartitions(F.desc("wind_dir"))
    got = ingest.append_observations(None, moved, derived.SHIP_ORDER).select("device_id", "epoch", "wind_dir", "battery_v", "air_temp_c")
    want = con.sql(registry_sql._SHIP + " SELECT device_id, epoch, wind_dir, battery_v, air_temp_c FROM obs").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["comfort_formulas", "compass", "export_us", "sensor_health", "wind_rose", "wind_stats"])
def test_tied_shipments_as_in_the_sql(spark, small, tmp_path, name):
    con = _tied(tmp_path, small)
    expected = con.sql(SQL[name])
    columns, rows = expected.columns, expected.fetchall()
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    shown = lambda row: tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(map(shown, got)) == sorted(map(shown, rows))


def _lacking(folder, small, lacks):
    """Shipments of which some lack a column (``lacks``: by name, SQL that says which rows may); none are tied in their order."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    less = ", ".join(f"CASE WHEN NOT ({may}) OR hash('{c}', l_orderkey, l_partkey, l_suppkey) % 20 <> 0 THEN {c} END AS {c}" for c, may in lacks.items())
    same = "l_suppkey % 4, l_shipdate + INTERVAL 1 SECOND * ((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 96 * 900 + l_linenumber), l_orderkey, l_linenumber"
    rows = f"SELECT * FROM (SELECT * REPLACE ({less}) FROM '{small}/lineitem.parquet') QUALIFY row_number() OVER (PARTITION BY {same} ORDER BY l_partkey, l_suppkey, l_quantity, l_shipdate) = 1"
    con.sql(f"COPY ({rows}) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return con


def _equals(spark, con, folder, name):
    expected = con.sql(SQL[name])
    columns, rows = expected.columns, expected.fetchall()
    got = QUERIES[name](spark, str(folder)).select(*columns).collect()
    shown = lambda row: tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)
    return sorted(map(shown, got)) == sorted(map(shown, rows))


def test_bucketed_days_keeps_rows_that_lack_a_part_of_their_key(spark, small, tmp_path):
    # Rows without an order and rows without a time or device for another cause are of different devices here.
    con = _lacking(tmp_path, small, {"l_orderkey": "l_suppkey % 4 < 2", "l_shipdate": "l_suppkey % 4 > 1", "l_suppkey": "l_suppkey % 4 > 1"})
    assert _equals(spark, con, tmp_path, "bucketed_days")


@pytest.mark.parametrize("name", ["compass", "export_us", "sensor_health", "wind_rose"])
def test_rows_without_an_order_come_last(spark, small, tmp_path, name):
    # All rows of a device without a time meet in one key, and some of them lack their order too.
    con = _lacking(tmp_path, small, {"l_orderkey": "true", "l_linenumber": "true", "l_shipdate": "true", "l_partkey": "true"})
    assert _equals(spark, con, tmp_path, name)


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert importlib.import_module("stationspark.registry").queries().keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(importlib.import_module("stationspark.registry").oracle_sql()))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in re.findall(r"\b(lineitem|events|nation|supplier)\b", SQL[name]):
        con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    expected = con.sql(SQL[name])
    columns, rows = expected.columns, expected.fetchall()
    got = QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(columns)
    shown = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    # Rounding to six places may fall either way; five places do not show it.
    assert sorted(tuple(map(shown, r)) for r in rows) == sorted(tuple(shown(r[c]) if not isinstance(r[c], float) else f"{r[c]:.5f}" for c in columns) for r in got.collect())


def test_append_is_held_against_stored_rows(spark, small):
    plan = QUERIES["append_first_wins"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Union" in plan


def test_plans(spark, small):
    plan = QUERIES["daily_summary"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and not re.search("Python|Arrow", plan)
    for name in ("all_gaps", "rank_days_gust", "rain_stats", "pressure_stats"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name
    assert "WindowGroupLimit" in QUERIES["rank_days_gust"](spark, small)._jdf.queryExecution().executedPlan().toString()
