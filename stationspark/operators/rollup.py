"""The shared intermediates: quarter-hour partials of every device, and local days made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationspark.functions.calendar import local_day

QUARTER_S = 900
CALM_MPS = 0.5

#: How partials of equal name are merged further up.
_SUMS = [
    "temp_sum", "temp_n", "hum_sum", "hum_n", "wind_sum", "wind_n", "calm_n", "rain_sum", "rain_n", "strikes", "strike_n",
    "pressure_sum", "pressure_n", "solar_mj", "hot_t", "hot_h", "hot_n", "cold_t", "cold_w", "cold_n", "obs",
]
_MAXES = ["temp_max", "wind_max", "gust_max", "pressure_max", "solar_max", "uv_max", "lux_max"]
_MINS = ["temp_min", "pressure_min", "closest_km"]


def _both(value: Column, other: Column) -> Column:
    return F.when(other.isNotNull(), value)


def quarter_aggregates() -> list[Column]:
    """The partials of a quarter hour, for batches and streams alike."""
    c = F.col
    paired_h = c("air_temp_c").isNotNull() & c("humidity").isNotNull()
    paired_w = c("air_temp_c").isNotNull() & c("wind_avg").isNotNull()
    usable = (c("report_interval_min") > 0) & (c("report_interval_min") <= 1440)
    return [
        F.min("air_temp_c").alias("temp_min"), F.max("air_temp_c").alias("temp_max"),
        F.sum("air_temp_c").alias("temp_sum"), F.count("air_temp_c").alias("temp_n"),
        F.sum("humidity").alias("hum_sum"), F.count("humidity").alias("hum_n"),
        F.sum("wind_avg").alias("wind_sum"), F.count("wind_avg").alias("wind_n"), F.max("wind_avg").alias("wind_max"),
        F.max("wind_gust").alias("gust_max"), F.count_if(c("wind_avg") < CALM_MPS).alias("calm_n"),
        F.sum("rain_mm").alias("rain_sum"), F.count("rain_mm").alias("rain_n"),
        F.sum("strike_count").alias("strikes"), F.count("strike_count").alias("strike_n"),
        F.min(F.when((c("strike_count") > 0) & (c("strike_dist_km") > 0), c("strike_dist_km"))).alias("closest_km"),
        F.sum("pressure_mb").alias("pressure_sum"), F.count("pressure_mb").alias("pressure_n"),
        F.min("pressure_mb").alias("pressure_min"), F.max("pressure_mb").alias("pressure_max"),
        F.sum(F.when(usable, c("solar_wm2") * c("report_interval_min") * 60 / 1e6)).alias("solar_mj"),
        F.max("solar_wm2").alias("solar_max"), F.max("uv").alias("uv_max"), F.max("illuminance_lux").alias("lux_max"),
        F.sum(F.when(paired_h, c("air_temp_c"))).alias("hot_t"), F.sum(F.when(paired_h, c("humidity"))).alias("hot_h"),
        F.count_if(paired_h).alias("hot_n"),
        F.sum(F.when(paired_w, c("air_temp_c"))).alias("cold_t"), F.sum(F.when(paired_w, c("wind_avg"))).alias("cold_w"),
        F.count_if(paired_w).alias("cold_n"),
        F.count("*").alias("obs"),
    ]


def quarter_rollup(obs: DataFrame) -> DataFrame:
    """device_id, bucket (epoch div 900) and all partials, by one hash aggregate with map-side combine."""
    return obs.groupBy("device_id", F.expr(f"epoch div {QUARTER_S}").alias("bucket")).agg(*quarter_aggregates())


def merged_quarters(partials: DataFrame) -> DataFrame:
    """One row per device and quarter hour from partials of any number of its parts, such as late rows that came by themselves."""
    return partials.groupBy("device_id", "bucket").agg(*merge_partials()).select(*partials.columns)


def merge_partials() -> list[Column]:
    return [F.sum(c).alias(c) for c in _SUMS] + [F.max(c).alias(c) for c in _MAXES] + [F.min(c).alias(c) for c in _MINS]


def with_zone(df: DataFrame, devices: DataFrame | None) -> DataFrame:
    """``df`` plus tz: each device's zone, UTC where none is known. ``devices`` None: UTC for all, without a join."""
    if devices is None:
        return df.withColumn("tz", F.lit("UTC"))
    zones = devices.select("device_id", "tz").dropDuplicates(["device_id"])
    return df.join(zones, "device_id", "left").withColumn("tz", F.coalesce("tz", F.lit("UTC")))


def day_rollup(quarter: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """device_id, day and merged partials; a bucket's start decides its local day."""
    rows = with_zone(quarter, devices)
    day = local_day(F.col("bucket") * QUARTER_S, F.col("tz")).alias("day")
    return rows.groupBy("device_id", day).agg(*merge_partials())


def days_of(obs: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    return day_rollup(quarter_rollup(obs), devices)
