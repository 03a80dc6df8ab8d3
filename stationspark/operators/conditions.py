"""Joins that put answers together: current conditions, station info, archive status, the full report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationspark.functions.calendar import local_day, local_timestamp, within
from stationspark.functions.units import c_to_f, compass, dew_point_c, feels_like_f, km_to_mile, mb_to_inhg, mps_to_mph
from stationspark.sources.shared import written

from .asof import GAP_S, coverage, gaps, latest, pressure_tendency
from .calendar import period_summary
from .climate import temperature_spells, temperature_trend
from .rollup import day_rollup, quarter_rollup, with_zone
from .sensors import comfort_stats, lightning_stats, pressure_stats, rain_stats, records, solar_stats, wind_stats

FRESH_S = 3600


def devices_of_station(obs_devices: DataFrame, device_dim: DataFrame, station_id: int) -> DataFrame:
    """The archive's devices that belong to a station; devices that no station is known for match none."""
    return obs_devices.join(device_dim.where(F.col("station_id") == station_id), "device_id", "left_semi")


def conditions_archive(obs: DataFrame, daily: DataFrame, as_of_epoch: int, devices: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """Each device's newest row in US units with what is derived from it, its age, rain so far today and pressure trend.

    Rain counts only if the last day is today; the trend only if its reading is at or under an hour before the newest row.
    With ``zones`` (an archive's zone map) only each device's last months are read.
    """
    now = with_zone(latest(obs, zones), devices)
    t, rh, w = F.col("air_temp_c"), F.col("humidity"), F.col("wind_avg")
    rain = daily.groupBy("device_id").agg(F.max(F.struct("day", "rain_in")).alias("last_day"))
    trend = pressure_tendency(obs, zones=zones).select("device_id", F.col("at_epoch").alias("trend_epoch"), "change_mb_per_3h", "category")
    rows = now.join(rain, "device_id", "left").join(trend, "device_id", "left")
    today = F.col("last_day.day") == local_day(F.lit(as_of_epoch), F.col("tz"))
    fits = (F.col("trend_epoch") <= F.col("epoch")) & (F.col("epoch") - F.col("trend_epoch") < FRESH_S)
    return rows.select(
        "device_id", F.col("epoch").alias("at_epoch"), (as_of_epoch - F.col("epoch")).alias("age_s"), c_to_f(t).alias("temp_f"), rh.alias("humidity"),
        c_to_f(dew_point_c(t, rh)).alias("dew_point_f"), feels_like_f(t, rh, w).alias("feels_like_f"), mps_to_mph(w).alias("wind_mph"),
        mps_to_mph(F.col("wind_gust")).alias("gust_mph"), compass(F.col("wind_dir")).alias("wind_from"), mb_to_inhg(F.col("pressure_mb")).alias("pressure_inhg"),
        "solar_wm2", "uv", km_to_mile(F.col("strike_dist_km")).alias("strike_miles"), F.when(today, F.col("last_day.rain_in")).alias("rain_today_in"),
        F.when(fits, F.col("change_mb_per_3h")).alias("change_mb_per_3h"), F.when(fits, F.col("category")).alias("pressure_trend"),
    )


def conditions(live: DataFrame, archive: DataFrame, device_dim: DataFrame) -> DataFrame:
    """Live conditions of stations where there are any, else those of the archive; live ones get a matching archive's trend."""
    known = archive.join(device_dim.select("device_id", "station_id").dropDuplicates(["device_id"]), "device_id", "left")
    both = live.withColumn("live", F.lit(True)).alias("l").join(known.alias("a"), "station_id", "full_outer")
    shared = [c for c in live.columns if c in archive.columns]
    chosen = [F.when(F.col("l.live"), F.col(f"l.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in shared]
    return both.select("station_id", F.col("a.device_id").alias("device_id"), F.when(F.col("l.live"), "live").otherwise("archive").alias("source"), *chosen, F.col("a.pressure_trend").alias("pressure_trend"))


def station_info(device_dim: DataFrame, cover: DataFrame) -> DataFrame:
    """Stations and their devices with what the archive has of each."""
    return device_dim.join(cover, "device_id", "left").withColumn("obs", F.coalesce("obs", F.lit(0).cast("long")))


def archive_status(obs: DataFrame, as_of_epoch: int, devices: DataFrame | None = None) -> DataFrame:
    """Per device: rows, first and last time, span, age, freshness, and up to ten gaps of over an hour."""
    found = with_zone(gaps(obs, GAP_S, 10), devices)
    local = lambda c: F.date_format(local_timestamp(F.col(c), F.col("tz")), "yyyy-MM-dd HH:mm:ss")
    each = F.struct("rank", "start_epoch", "end_epoch", "seconds", local("start_epoch").alias("start_local"), local("end_epoch").alias("end_local"))
    listed = found.groupBy("device_id").agg(F.sort_array(F.collect_list(each)).alias("gaps"))  # ten at most
    age = as_of_epoch - F.col("last_epoch")
    status = coverage(obs).withColumn("span_days", (F.col("last_epoch") - F.col("first_epoch")) / 86_400).withColumn("age_s", age).withColumn("fresh", (age >= 0) & (age < FRESH_S))
    return status.join(listed, "device_id", "left").withColumn("gaps", F.coalesce("gaps", F.array().cast(listed.schema["gaps"].dataType)))


def stats_report(obs: DataFrame, start_epoch: int | None = None, end_epoch: int | None = None, devices: DataFrame | None = None) -> DataFrame:
    """One nested row per device: coverage, records and trend of all time; rain, wind, lightning, solar, comfort, spells, pressure of a range.

    Quarter hours and days are written once (a job of its own) and read by all parts, so observations are scanned for the
    rollups, the records and the coverage alone.
    """
    quarter = written(quarter_rollup(obs), "quarter")
    day = written(day_rollup(quarter, devices), "day")
    part_quarter, part = quarter, day
    if start_epoch is not None or end_epoch is not None:
        part_quarter = written(quarter_rollup(within(obs, start_epoch, end_epoch)), "part-quarter")
        part = written(day_rollup(part_quarter, devices), "part-day")
    parts = {
        "records": records(obs, day, quarter), "trend": temperature_trend(period_summary(day)), "rain": rain_stats(part), "wind": wind_stats(part),
        "lightning": lightning_stats(part), "solar": solar_stats(part), "comfort": comfort_stats(part_quarter, devices),
        "spells": temperature_spells(part), "pressure": pressure_stats(part),
    }
    cover = coverage(obs)
    out = cover.select("device_id", F.struct(*[c for c in cover.columns if c != "device_id"]).alias("coverage"))
    for name, df in parts.items():
        out = out.join(df.select("device_id", F.struct(*[c for c in df.columns if c != "device_id"]).alias(name)), "device_id", "left")
    return out


