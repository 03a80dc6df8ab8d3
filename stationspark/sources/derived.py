"""Observations derived from the given tables, and a distributed generator for scale runs.

Expressions are SQL that Spark and other engines read alike, apart from the epoch of a date or time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationspark.schema import SENSORS, align_schema

from .ingest import append_observations

_H = "(l_orderkey*7919 + l_partkey*104729 + l_linenumber*31)"
_NO_WIND, _NO_SUN = "l_suppkey % 17 = 0", "l_suppkey % 29 = 0"

#: Sensor columns made of shipments: dense, several years, four devices.
SHIP = {
    "wind_lull": f"case when {_NO_WIND} then cast(null as double) else cast({_H} % 80 as double)/10.0e0 end",
    "wind_avg": f"case when {_NO_WIND} then cast(null as double) else cast({_H} % 240 as double)/10.0e0 * case when {_H} % 5 = 0 then 0.01e0 else 1.0e0 end end",
    "wind_gust": f"case when l_suppkey % 23 = 0 then cast(null as double) else cast({_H} % 400 as double)/10.0e0 end",
    "wind_dir": "case when l_suppkey % 19 = 0 then cast(null as double) else cast((l_partkey*7) % 3600 as double)/10.0e0 end",
    "wind_interval": "cast(3 as double)",
    "pressure_mb": f"case when {_H} % 13 = 0 then cast(null as double) else 980.0e0 + cast((l_orderkey + l_partkey) % 600 as double)/10.0e0 end",
    "air_temp_c": f"case when {_H} % 7 = 0 then cast(null as double) else l_quantity - 12.0e0 end",
    "humidity": f"case when {_H} % 11 = 0 then cast(null as double) else cast({_H} % 101 as double) end",
    "illuminance_lux": f"case when {_NO_SUN} then cast(null as double) else cast((l_partkey*53) % 110000 as double) end",
    "uv": f"case when {_NO_SUN} then cast(null as double) else cast(l_partkey % 120 as double)/10.0e0 end",
    "solar_wm2": f"case when {_NO_SUN} then cast(null as double) else cast((l_partkey*11) % 1000 as double) end",
    "rain_mm": f"case when {_H} % 9 = 0 then cast(null as double) when {_H} % 100 < 97 then 0.0e0 else cast(l_partkey % 120 as double)/10.0e0 end",
    "precip_type": f"cast({_H} % 4 as double)",
    "strike_dist_km": f"case when {_H} % 50 = 0 then cast(l_partkey % 40 as double) end",
    "strike_count": f"case when {_H} % 8 = 0 then cast(null as double) when {_H} % 50 = 0 then cast(1 + l_partkey % 9 as double) else 0.0e0 end",
    "battery_v": "2.3e0 + cast(l_partkey % 50 as double)/100.0e0",
    "report_interval_min": "case when l_linenumber = 6 then cast(null as double) when l_linenumber = 5 then 0.0e0 else cast(l_linenumber as double) end",
}
#: Sensor columns made of events: a month, sparse, one sensor a row, many devices.
EVENTS = {
    "air_temp_c": "case when event_type = 'view' then value/10.0e0 - 9.0e0 end",
    "wind_avg": "case when event_type = 'click' then value/25.0e0 end",
    "rain_mm": "case when event_type = 'purchase' then value/50.0e0 end",
    "strike_count": "case when event_type = 'error' then cast(floor(value/100.0e0) as double) end",
    "pressure_mb": "case when event_type = 'signup' then 980.0e0 + value/10.0e0 end",
}
ZONES = {1: "UTC", 2: "America/Los_Angeles", 3: "Asia/Kathmandu", 4: "Australia/Lord_Howe"}


def ship_rows(ship_epoch: str) -> list[str]:
    """Select list over lineitem; ``ship_epoch`` is the engine's epoch of l_shipdate."""
    return ["l_suppkey % 4 + 1 as device_id", f"{ship_epoch} + {_H} % 96 * 900 + l_linenumber as epoch", *[f"{x} as {c}" for c, x in SHIP.items()], "'rest' as source", "l_orderkey as seq_a", "l_linenumber as seq_b"]


def event_rows(epoch: str) -> list[str]:
    return ["user_id as device_id", f"{epoch} as epoch", *[f"{EVENTS.get(s, 'cast(null as double)')} as {s}" for s in SENSORS], "'rest' as source", "event_id as seq_a"]


#: Order of arrival of shipments. Lines may share order and line number; then the row that stands first in the file came first.
SHIP_ORDER = ["seq_a", "seq_b", "seq_file", "seq_row"]


def ship_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows, with repeated keys, and their order of arrival (SHIP_ORDER)."""
    place = ["xxhash64(_metadata.file_name) as seq_file", "_metadata.row_index as seq_row"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*ship_rows("unix_seconds(cast(l_shipdate as timestamp))"), *place)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("device_id", "epoch")})


def event_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*event_rows("unix_seconds(cast(ts as timestamp))"))
    return rows.withColumns({c: F.col(c).cast("long") for c in ("device_id", "epoch")})


def obs_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_schema(append_observations(None, ship_raw(spark, sf_dir), SHIP_ORDER))


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_schema(append_observations(None, event_raw(spark, sf_dir), ["seq_a"]))


def device_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The devices' zones and, from nation, names."""
    zones = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = nation.where(F.col("n_nationkey").isin(*ZONES)).select(F.col("n_nationkey").cast("long").alias("device_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("station_id"))
    return rows.withColumn("tz", F.element_at(zones, F.col("device_id").cast("int")))


def synth_observations(spark: SparkSession, n_devices: int, minutes: int, start_epoch: int = 1_672_531_200) -> DataFrame:
    """Minute rows of many devices by formula: seasonal and daily waves, turning wind, rain every 997th minute."""
    n, k = F.col("id") % minutes, (F.col("id") / minutes).cast("long")
    day, year = 2 * 3.141592653589793 / 1440, 2 * 3.141592653589793 / 525_600
    rows = spark.range(n_devices * minutes).select((k + 1).alias("device_id"), (start_epoch + n * 60).alias("epoch"), n.alias("n"))
    m = F.col("n")
    return align_schema(rows.withColumns({
        "air_temp_c": 12 + 10 * F.sin(m * year) + 6 * F.sin(m * day), "humidity": 60 + 25 * F.cos(m * day),
        "wind_avg": 3 + 2 * F.sin(m * day * 3), "wind_gust": 5 + 4 * F.abs(F.sin(m * day * 5)), "wind_lull": F.lit(0.4),
        "wind_dir": (m * 7 % 360).cast("double"), "pressure_mb": 1013 + 8 * F.sin(m * day / 5), "solar_wm2": F.greatest(F.lit(0.0), 900 * F.sin(m * day)),
        "uv": F.greatest(F.lit(0.0), 9 * F.sin(m * day)), "illuminance_lux": F.greatest(F.lit(0.0), 90_000 * F.sin(m * day)),
        "rain_mm": F.when(m % 997 == 0, 0.6).otherwise(0.0), "strike_count": F.when(m % 4999 == 0, 1.0).otherwise(0.0),
        "strike_dist_km": F.when(m % 4999 == 0, 9.0), "battery_v": F.lit(2.6), "report_interval_min": F.lit(1.0), "source": F.lit("rest"),
    }))
