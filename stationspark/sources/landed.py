"""Landed responses made of the given tables, in the shapes that the weather service sends them, for queries over sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived, ingest
from .shared import shared_path

DAY0 = 1_704_067_200
#: A row of another device that closes every window of a stream before it.
LAST_DEVICE, LAST_EPOCH = 999_999_999, 4_000_000_000


def _zone(key: Column) -> Column:
    zones = F.create_map(*[F.lit(x) for kv in derived.ZONES.items() for x in kv])
    return F.element_at(zones, (key % 4 + 1).cast("int"))


def observation_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of landed observation files made of events: a response per device and UTC day, devices counted from 1."""
    obs = derived.obs_events(spark, sf_dir)
    wire = F.array(F.col("epoch").cast("double"), *[F.col(c) for c in ingest.WIRE])
    rows = obs.groupBy((F.col("device_id") + 1).alias("device_id"), F.expr("epoch div 86400").alias("day")).agg(F.sort_array(F.collect_list(wire)).alias("obs"))
    rows = rows.select("device_id", F.lit("obs_st").alias("type"), F.struct(F.lit(0).alias("status_code")).alias("status"), "obs")
    last = F.array(F.lit(float(LAST_EPOCH)), *[F.lit(None).cast("double") for _ in ingest.WIRE])
    end = spark.range(1).select(F.lit(LAST_DEVICE).cast("long").alias("device_id"), F.lit("obs_st").alias("type"), F.struct(F.lit(0).alias("status_code")).alias("status"), F.array(last).alias("obs"))
    path = shared_path(spark, "landed")
    rows.unionByName(end).write.json(path)
    return path


def station_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station lists made of suppliers: eight devices a station, sixteen stations an account; some lie out of bounds."""
    k = F.col("s_suppkey").cast("long")
    devices = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.floor(k / 8).alias("station"), F.struct(k.alias("device_id"), F.when(k % 3 == 1, "ST").otherwise("HB").alias("device_type"), F.col("s_name").alias("serial_number")).alias("device")
    )
    stations = devices.groupBy("station").agg(F.sort_array(F.collect_list("device")).alias("devices"))  # eight
    s = F.col("station")
    one = F.struct(
        s.alias("station_id"), F.concat(F.lit("Station "), s.cast("string")).alias("name"), (s * 37 % 200 - 95).cast("double").alias("latitude"), (s * 31 % 360 - 180).cast("double").alias("longitude"),
        F.when(s % 5 != 0, _zone(s)).alias("timezone"), F.struct(F.when(s % 4 != 3, (s * 13 % 3000).cast("double")).alias("elevation")).alias("station_meta"), "devices",
    )
    return stations.groupBy(F.floor(s / 16).alias("account")).agg(F.sort_array(F.collect_list(one)).alias("stations")).select(F.col("stations").cast(ingest.STATIONS.split(" ", 1)[1]).alias("stations"))


def forecast_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast per supplier as station: twelve days and thirty hours."""
    k = F.col("s_suppkey").cast("long")
    d = lambda x: x.cast("double")
    now = F.struct(
        (DAY0 + k * 61).alias("time"), F.lit("Clear").alias("conditions"), d(k % 40 - 5).alias("air_temperature"), d(k % 101).alias("relative_humidity"), d(k % 17).alias("wind_avg"),
        d(k * 23 % 360).alias("wind_direction"), d(1000 + k % 30).alias("sea_level_pressure"),
    )
    daily = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct((DAY0 + i * 86_400).cast("long").alias("day_start_local"), F.concat(F.lit("Day "), i.cast("string")).alias("conditions"), d((k * 7 + i * 3) % 40).alias("air_temp_high"), d((k * 7 + i * 3) % 40 - 8).alias("air_temp_low"), d(k * i % 100).alias("precip_probability")))
    hourly = F.transform(
        F.sequence(F.lit(0), F.lit(29)),
        lambda i: F.struct(
            (DAY0 + i * 3600).cast("long").alias("time"), F.lit("Cloudy").alias("conditions"), d((k + i) % 35).alias("air_temperature"), d((k * 3 + i) % 101).alias("relative_humidity"), d((k + i) % 11).alias("wind_avg"),
            d((k + i * 5) % 30).alias("wind_gust"), d(k * i * 11 % 360).alias("wind_direction"), d(i * 7 % 100).alias("precip_probability"), d(i % 4).alias("precip"),
        ),
    )
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select(k.alias("station_id"), F.when(k % 5 != 0, _zone(k)).alias("timezone"), now.alias("current_conditions"), F.struct(daily.alias("daily"), hourly.alias("hourly")).alias("forecast"))


def station_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows of stations made of events: each user a station, the event's number the place in its response."""
    v, kind = F.col("value"), F.col("event_type")
    of = lambda name, x: F.when(kind == name, x)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("long").alias("station_id"), F.col("event_id").cast("long").alias("pos"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("timestamp"),
        (v / 10 - 9).alias("air_temperature"), (v % 101).alias("relative_humidity"), of("click", v / 25).alias("wind_avg"), (v / 20).alias("wind_gust"), (v * 7 % 360).alias("wind_direction"),
        of("signup", 980 + v / 10).alias("sea_level_pressure"), (970 + v / 10).alias("station_pressure"), of("purchase", v / 50).alias("precip_accum_local_day"), of("error", v / 10).alias("lightning_strike_last_distance"),
    )
