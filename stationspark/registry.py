"""Registered queries over the given tables, and DuckDB SQL with equal results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationspark import registry_sources, registry_sql
from stationspark.functions import units as U
from stationspark.functions.calendar import local_day, local_hour, within
from stationspark.operators import asof, calendar, climate, conditions, sensors, series
from stationspark.operators.rollup import day_rollup, quarter_rollup
from stationspark.plans.adhoc import recipe
from stationspark.sources import derived
from stationspark.sources.archive import export_frame
from stationspark.sources.ingest import append_observations, validate_observations
from stationspark.registry_sql import AS_OF, DATE, DAY, RANGE, WINDOW, YEAR

Query = Callable[[SparkSession, str], DataFrame]


def six_places(c: Column) -> Column:
    """A double to six places by its own value, as the SQL's engine rounds; Spark would round the shortest decimal that names it."""
    scaled = c * 1e6
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 1e6).otherwise(c) + F.lit(0.0)


def finish(df: DataFrame) -> DataFrame:
    """Doubles to six places (engines add in different orders), whole numbers as long."""
    kinds = {T.DoubleType(): six_places, T.FloatType(): lambda c: six_places(c.cast("double")), T.IntegerType(): lambda c: c.cast("long"), T.ShortType(): lambda c: c.cast("long")}
    return df.select(*[kinds[f.dataType](F.col(f"`{f.name}`")).alias(f.name) if f.dataType in kinds else F.col(f"`{f.name}`") for f in df.schema])


def _obs(s, d):
    return derived.obs_ship(s, d)


def _quarter(s, d):
    return quarter_rollup(_obs(s, d))


def _day(s, d):
    return day_rollup(_quarter(s, d))


def _months(s, d):
    return calendar.period_summary(_day(s, d), "month")


def _daily(s, d):
    return calendar.daily_summary(_day(s, d))


def _both_rollups(use):
    """A query over quarter and obs that are one scan's."""

    def run(s, d):
        obs = _obs(s, d)
        quarter = quarter_rollup(obs)
        return use(obs, quarter, day_rollup(quarter))

    return run


def _events(use) -> Query:
    return lambda s, d: use(derived.obs_events(s, d))


def _append(s, d):
    # The first half of the orders is stored; the batch replays the later half of that and goes on from there.
    raw, order = derived.ship_raw(s, d), derived.SHIP_ORDER
    half = (raw.agg(F.max("seq_a")).first()[0] or 0) // 2
    stored = append_observations(None, raw.where(F.col("seq_a") <= half), order)
    rows = stored.unionByName(append_observations(stored, raw.where(F.col("seq_a") > half // 2), order))
    return rows.groupBy("device_id").agg(F.count("*").alias("obs"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.sum("wind_gust").alias("gusts"))


def _validate(s, d):
    # Readings over a stricter bound stand for invalid ones: a negative direction and a gust out of range.
    raw = derived.ship_raw(s, d).withColumn("wind_gust", F.when(F.col("wind_gust") > 39, 400.0).otherwise(F.col("wind_gust")))
    good, bad = validate_observations(raw.withColumn("strike_count", F.when(F.col("strike_count") == 7, 7.5).otherwise(F.col("strike_count"))), "quarantine")
    good = good.groupBy("device_id").agg(F.count("*").alias("good"))
    bad = bad.groupBy("device_id").agg(F.count("*").alias("bad"), F.count_if(F.array_contains("reason", "wind_gust")).alias("bad_gust"), F.count_if(F.array_contains("reason", "strike_count")).alias("bad_strikes"))
    return good.join(bad, "device_id", "full_outer")


def _comfort(s, d):
    t, rh, w = F.col("air_temp_c"), F.col("humidity"), F.col("wind_avg")
    rows = _obs(s, d)
    return rows.select(
        "device_id", "epoch", U.c_to_f(U.dew_point_c(t, rh)).alias("dew_point_f"), U.heat_index_f(U.c_to_f(t), rh).alias("heat_index_f"), U.wind_chill_f(U.c_to_f(t), U.mps_to_mph(w)).alias("wind_chill_f"),
        U.apparent_temp_f(U.c_to_f(t), rh, U.mps_to_mph(w)).alias("apparent_temp_f"),
    )


def _tz_days(s, d):
    devices = derived.device_dim(s, d)
    return calendar.daily_summary(day_rollup(_quarter(s, d), devices))


def _tz_hours(s, d):
    rows = _obs(s, d).join(F.broadcast(derived.device_dim(s, d).select("device_id", "tz")), "device_id")
    return rows.groupBy("device_id", local_day(F.col("epoch"), F.col("tz")).alias("day"), local_hour(F.col("epoch"), F.col("tz")).alias("hour")).agg(F.count("*").alias("obs"))


def _auto(obs):
    bounds = asof.coverage(obs).select("device_id", F.col("first_epoch").alias("start_epoch"), F.col("last_epoch").alias("end_epoch"))
    return series.series_auto(obs, bounds, 100).select("device_id", "bucket_s", "coarsened", "bucket_epoch", "temp_c", "rain_mm", "obs")


def _labels(obs):
    found = obs.groupBy("device_id", local_day(F.col("epoch"), F.lit("UTC")).alias("day")).agg(F.count("*").alias("obs"), F.count("rain_mm").alias("reads"), F.sum("rain_mm").alias("total"))
    return found.select("device_id", "day", U.coverage_label(F.col("reads"), F.col("obs")).alias("rain_coverage"), U.known_total(F.col("reads"), F.col("total")).alias("rain_mm"))


def _status(obs):
    rows = conditions.archive_status(obs, AS_OF)
    return rows.select("device_id", "obs", "first_epoch", "last_epoch", "span_days", "age_s", "fresh", F.size("gaps").alias("n_gaps"), F.get("gaps", F.lit(0))["seconds"].alias("largest_gap_s"))


def _profile(obs):
    rows = calendar.day_profile(obs, DAY)
    return rows.select("device_id", "bucket_epoch", "temp_c", "rain_mm", "obs", "rain_readings")


def _event_zones(obs):
    zones = F.create_map(*[F.lit(x) for kv in derived.ZONES.items() for x in kv])
    return obs.select("device_id").distinct().withColumn("tz", F.element_at(zones, (F.col("device_id") % 4 + 1).cast("int")))


def _profile_tz(obs):
    rows = calendar.day_profile(obs, DAY, _event_zones(obs))
    return rows.select("device_id", "bucket_epoch", "temp_c", "rain_mm", "obs", "rain_readings")


def _semi(s, d):
    obs = derived.obs_events(s, d)
    dim = derived.device_dim(s, d)
    return conditions.devices_of_station(asof.device_ids(obs), dim, 1)


def _info(s, d):
    found = conditions.station_info(derived.device_dim(s, d), asof.coverage(_obs(s, d)))
    return found.select("device_id", "station_id", "name", "tz", "obs", "first_epoch", "last_epoch")


def _normalised(s, d):
    return calendar.normalise_metric(_months(s, d).select("device_id", "period", "temp_avg_f"), "temp_avg_f", ["device_id"])


def queries() -> dict[str, Query]:
    ship: dict[str, Query] = {
        "append_first_wins": _append,
        "validate_counts": _validate,
        "export_us": lambda s, d: export_frame(_obs(s, d), "us", True),
        "coverage": lambda s, d: asof.coverage(_obs(s, d)),
        "daily_summary": _daily,
        "daily_summary_tz": _tz_days,
        "local_hours_tz": _tz_hours,
        "hourly_climatology": lambda s, d: calendar.hourly_climatology(_quarter(s, d)),
        "period_summary_month": _months,
        "period_summary_year": lambda s, d: calendar.period_summary(_day(s, d), "year"),
        "monthly_normals": lambda s, d: calendar.monthly_normals(_months(s, d)),
        "this_day": lambda s, d: calendar.this_day(_day(s, d), *DATE),
        "this_day_records": lambda s, d: calendar.this_day_records(calendar.this_day(_day(s, d), *DATE)),
        "records": _both_rollups(lambda obs, quarter, day: sensors.records(obs, day, quarter)),
        "rain_stats": lambda s, d: sensors.rain_stats(_day(s, d)),
        "wind_stats": lambda s, d: sensors.wind_stats(_day(s, d)),
        "wind_rose": lambda s, d: sensors.wind_rose(_obs(s, d)),
        "solar_stats": lambda s, d: sensors.solar_stats(_day(s, d)),
        "lightning_stats": lambda s, d: sensors.lightning_stats(_day(s, d)),
        "pressure_stats": lambda s, d: sensors.pressure_stats(_day(s, d)),
        "pressure_swings": lambda s, d: sensors.daily_mean_swings(_day(s, d)),
        "comfort_stats": lambda s, d: sensors.comfort_stats(_quarter(s, d)),
        "sensor_health": lambda s, d: sensors.sensor_health(_obs(s, d)),
        "degree_days": lambda s, d: climate.degree_days(_day(s, d)),
        "climate_indices": lambda s, d: climate.climate_indices(_day(s, d)),
        "temperature_spells": lambda s, d: climate.temperature_spells(_day(s, d)),
        "temperature_trend": lambda s, d: climate.temperature_trend(_months(s, d)),
        "month_anomalies": lambda s, d: climate.month_anomalies(_months(s, d)),
        "view_summary_week": lambda s, d: calendar.view_summary(_daily(s, d), "week"),
        "view_summary_month": lambda s, d: calendar.view_summary(_daily(s, d), "month"),
        "view_summary_year": lambda s, d: calendar.view_summary(_daily(s, d), "year"),
        "rank_days_gust": lambda s, d: calendar.rank_days(_daily(s, d), "gust_max_mph", 10),
        "calendar_grid": lambda s, d: calendar.calendar_grid(_daily(s, d).select("device_id", "day", "temp_max_f", "rain_in"), f"{YEAR}-01-01", f"{YEAR}-12-31"),
        "month_strip": lambda s, d: calendar.month_strip(_months(s, d), YEAR),
        "normalise_metric": _normalised,
        "conditions_archive": _both_rollups(lambda obs, quarter, day: conditions.conditions_archive(obs, calendar.daily_summary(day), 1_004_918_400)),
        "station_info": _info,
        "comfort_formulas": _comfort,
        "feels_like": lambda s, d: _obs(s, d).select("device_id", "epoch", U.feels_like_f(F.col("air_temp_c"), F.col("humidity"), F.col("wind_avg")).alias("feels_like_f")),
        "compass": lambda s, d: _obs(s, d).groupBy("device_id", U.compass(F.col("wind_dir")).alias("direction")).agg(F.count("*").alias("obs")),
        "stats_report": lambda s, d: conditions.stats_report(_obs(s, d)),
        "recipe_rain_coverage": lambda s, d: recipe(s, _obs(s, d), "rain_coverage_by_month"),
        "recipe_top_gust_days": lambda s, d: recipe(s, _obs(s, d), "top_gust_days"),
        "recipe_latest_temperatures": lambda s, d: recipe(s, _obs(s, d), "latest_temperatures"),
    }
    events: dict[str, Query] = {
        "latest": _events(lambda o: asof.latest(o).select("device_id", "epoch", "air_temp_c", "wind_avg", "rain_mm", "strike_count", "pressure_mb")),
        "watermark": _events(asof.watermark),
        "gaps": _events(asof.gaps),
        "all_gaps": _events(asof.all_gaps),
        "pressure_tendency": _events(lambda o: asof.pressure_tendency(o, 24 * 3600)),
        "series_hourly": _events(lambda o: series.series(o, 3600)),
        "series_auto": _events(_auto),
        "day_profile": _events(_profile),
        "day_profile_tz": _events(_profile_tz),
        "archive_status": _events(_status),
        "missing_windows": _events(lambda o: asof.missing_windows(o, *WINDOW)),
        "range_scan": _events(lambda o: within(o, RANGE[0] + 86_400, RANGE[0] + 5 * 86_400).select("device_id", "epoch", "air_temp_c", "rain_mm")),
        "coverage_labels": _events(_labels),
        "station_semi_join": _semi,
    }
    return {k: (lambda s, d, f=f: finish(f(s, d))) for k, f in {**ship, **events, **registry_sources.queries()}.items()}


def oracle_sql() -> dict[str, str]:
    return registry_sql.oracle_sql() | registry_sources.oracle_sql()
