"""Queries over sources, the archive and streams, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationspark import registry_sql as R
from stationspark.functions import units as U
from stationspark.functions.calendar import resolve_days, resolve_range, within_ranges
from stationspark.operators import asof, calendar, conditions, series
from stationspark.operators.rollup import day_rollup, days_of
from stationspark.plans.adhoc import search_sorted
from stationspark.sources import archive, derived, ingest, landed
from stationspark.sources.shared import shared_path
from stationspark.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
READINGS = ["air_temp_c", "wind_avg", "rain_mm", "strike_count", "pressure_mb"]
SPAN = (R.RANGE[0] + 86_400, R.RANGE[0] + 20 * 86_400)
DATES = ("1995-03-10", "1995-04-02")
LAST_DAY = "1996-10-30"
_SHORT = "yyyy-MM-dd HH:mm:ss"


def _archived(spark: SparkSession, sf_dir: str) -> str:
    """Events' observations as an archive of two writes, the later half of the month first."""
    path, obs = shared_path(spark, "archive"), derived.obs_events(spark, sf_dir)
    middle = R.RANGE[0] + 15 * 86_400
    archive.write_obs(obs.where(F.col("epoch") >= middle), path)
    archive.write_obs(obs.where(F.col("epoch") < middle), path)
    return path


def _zoned(use: Callable) -> Query:
    def run(s, d):
        path = _archived(s, d)
        return use(archive.read_months(s, path), archive.zone_map(s, path))

    return run


def _range(s, d):
    return archive.read_obs(s, _archived(s, d), *SPAN).select("device_id", "epoch", *READINGS)


def _bucketed(s, d):
    path, name, raw = shared_path(s, "bucketed"), "bucketed_" + shared_path(s, "t").rsplit("-", 1)[1], derived.ship_raw(s, d)
    half = (raw.agg(F.max("seq_a")).first()[0] or 0) // 2
    archive.write_bucketed(ingest.append_observations(None, raw.where(F.col("seq_a") <= half), derived.SHIP_ORDER), name, path)
    later = F.coalesce(F.col("seq_a") > half // 2, F.lit(True))  # rows without an order's number come last
    archive.append_bucketed(s, name, path, raw.where(later), derived.SHIP_ORDER)
    days = days_of(archive.open_bucketed(s, name, path))
    return calendar.daily_summary(days)


def _checked(s, d):
    seen = archive.ingest_observations(derived.obs_events(s, d).withColumn("device_id", F.col("device_id") + 1), shared_path(s, "checked"), *R.RANGE)
    return s.createDataFrame([(seen["rows"], seen["first_epoch"], seen["last_epoch"])], "rows long, first_epoch long, last_epoch long")


def _metadata(s, d):
    rows = archive.archive_observations(derived.obs_ship(s, d), 800_000_000, 850_000_000)
    return rows.select("device_id", "epoch", "wind_interval", "precip_type", "report_interval_min", "source", "battery_v")


def _by_range(s, d):
    bounds = resolve_range(derived.device_dim(s, d), *DATES, R.AS_OF)
    return within_ranges(derived.obs_ship(s, d), bounds).select("device_id", "epoch", "air_temp_c")


def _by_days(s, d):
    return within_ranges(derived.obs_ship(s, d), resolve_days(derived.device_dim(s, d), 30, LAST_DAY, R.AS_OF)).select("device_id", "epoch", "rain_mm")


def _wire(s, d):
    rows = ingest.read_observation_responses(s, landed.observation_files(s, d))
    return rows.where(F.col("device_id") != landed.LAST_DEVICE).select("device_id", F.col("epoch").cast("long").alias("epoch"), *READINGS, "source", "bad")


def _stations(s, d):
    return ingest.flatten_stations(landed.station_responses(s, d))


def _picked(s, d):
    rows = _stations(s, d).withColumn("account", F.floor(F.col("station_id") / 16))
    return ingest.pick_device(rows, "account").select("account", "station_id", "device_id", "device_type")


def _forecast(k: int) -> Query:
    def run(s, d):
        rows = ingest.flatten_forecast(landed.forecast_responses(s, d))[k]
        return rows.withColumn("local_time", F.date_format("local_time", _SHORT)) if "local_time" in rows.columns else rows

    return run


def _forecast_summary(s, d):
    _, daily, hourly = ingest.flatten_forecast(landed.forecast_responses(s, d))
    return ingest.forecast_summary(daily, hourly)


def _live(s, d):
    return ingest.conditions_live(ingest.latest_station_observation(landed.station_rows(s, d)))


def _merged(s, d):
    obs = derived.obs_events(s, d)
    stored = conditions.conditions_archive(obs, calendar.daily_summary(days_of(obs)), R.AS_OF)
    # Stations are the devices' own numbers; every fifth device is of none, every third station has no live row.
    dim = asof.device_ids(obs).where("device_id % 5 <> 0").withColumn("station_id", F.col("device_id"))
    return conditions.conditions(_live(s, d).where("station_id % 3 <> 0"), stored, dim).drop("at_epoch")


def _searched(s, d):
    obs = derived.obs_events(s, d)
    found = obs.groupBy("device_id", F.to_date(F.timestamp_seconds("epoch")).alias("day")).agg(F.count("*").alias("obs"), F.count("rain_mm").alias("reads"))
    rows = found.select("device_id", "day", U.coverage_label(F.col("reads"), F.col("obs")).alias("rain_coverage"), F.when(F.col("reads") > 0, F.col("reads")).alias("reads"))
    return search_sorted(rows, "PART", "reads", True, 5, 60)


def _coarsened(obs):
    bounds = asof.coverage(obs).select("device_id", F.col("first_epoch").alias("start_epoch"), F.col("last_epoch").alias("end_epoch"))
    return series.series_auto(obs, bounds, bucket_s=60).select("device_id", "bucket_s", "coarsened", "bucket_epoch", "temp_c", "obs")


def _zero_floored(s, d):
    months = calendar.period_summary(days_of(derived.obs_ship(s, d)), "month")
    return calendar.normalise_metric(months.select("device_id", "period", "rain_in"), "rain_in", ["device_id"], zero_floored=True)


def _report(s, d):
    rows = conditions.stats_report(derived.obs_ship(s, d))
    parts = [f for f in rows.schema if f.name != "device_id"]
    return rows.select("device_id", *[F.col(f"{p.name}.`{f.name}`").alias(f"{p.name}_{f.name}") for p in parts for f in p.dataType])


# -- streams: all that has landed, to a table -------------------------------------------------------------------------------


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _drained(use: Callable[[DataFrame], DataFrame]) -> Query:
    """What a stream over the landed files has written once it has gone through them."""

    def run(s, d):
        out = use(streams.stream_observations(s, landed.observation_files(s, d), 100_000))
        path = shared_path(s, "streamed")
        with _state_store(s):
            sink = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", shared_path(s, "checkpoint"))
            sink.trigger(availableNow=True).start().awaitTermination()
        return s.read.schema(out.schema).parquet(path).where(F.col("device_id") != landed.LAST_DEVICE)

    return run


def _streamed_days(s, d):
    files, path = landed.observation_files(s, d), shared_path(s, "partials")
    streams.store_partials(streams.stream_observations(s, files, 100_000), path, shared_path(s, "checkpoint")).awaitTermination()
    return calendar.daily_summary(day_rollup(streams.stored_quarters(s, path))).where(F.col("device_id") != landed.LAST_DEVICE)


def _synced_days(s, d):
    stored, rollups = shared_path(s, "archive"), shared_path(s, "days")
    streams.sync_archive(s, landed.observation_files(s, d), stored, rollups, shared_path(s, "checkpoint")).awaitTermination()
    return calendar.daily_summary(s.read.parquet(rollups).drop("device_bucket")).where(F.col("device_id") != landed.LAST_DEVICE)


def queries() -> dict[str, Query]:
    return {
        "archive_range": _range,
        "archive_latest": _zoned(lambda obs, zones: asof.latest(obs, zones).select("device_id", "epoch", *READINGS)),
        "archive_pressure_tendency": _zoned(lambda obs, zones: asof.pressure_tendency(obs, 24 * 3600, zones)),
        "archive_zone_map": _zoned(lambda obs, zones: zones),
        "archive_metadata": _metadata,
        "bucketed_days": _bucketed,
        "checked_ingest": _checked,
        "range_by_device": _by_range,
        "days_by_device": _by_days,
        "wire_rows": _wire,
        "station_devices": _stations,
        "picked_devices": _picked,
        "forecast_current": _forecast(0),
        "forecast_daily": _forecast(1),
        "forecast_hourly": _forecast(2),
        "forecast_summary": _forecast_summary,
        "conditions_live": _live,
        "conditions_merged": _merged,
        "search_page": _searched,
        "series_coarsened": lambda s, d: _coarsened(derived.obs_events(s, d)),
        "normalise_zero_floored": _zero_floored,
        "stats_report_flat": _report,
        "stream_series_hourly": _drained(lambda obs: streams.stream_series(obs, 3600)),
        "stream_quarters": _drained(streams.stream_quarter_rollup),
        "stream_sessions": _drained(streams.stream_sessions),
        "stream_gaps": _drained(streams.stream_gaps),
        "stream_deduped": _drained(lambda obs: streams.stream_dedupe(obs).select("device_id", "epoch", *READINGS)),
        "stream_partial_days": _streamed_days,
        "synced_days": _synced_days,
    }


def oracle_sql() -> dict[str, str]:
    r, hg, f, mph, inch = R._r, R._hg, R._f, R._mph, R._in
    given = R.oracle_sql()
    readings = ", ".join(f"{r(c)} AS {c}" for c in READINGS)
    zone = lambda k: f"CASE {' '.join(f'''WHEN {k} % 4 = {z - 1} THEN '{name}' ''' for z, name in derived.ZONES.items())} END"
    local = lambda e, tz: f"strftime(to_timestamp({e}) AT TIME ZONE {tz}, '%Y-%m-%d %H:%M:%S')"
    days = lambda first, last: f"cast(epoch(timezone(tz, timestamp '{first} 00:00:00')) AS bigint) AND cast(epoch(timezone(tz, timestamp '{last} 00:00:00' + INTERVAL 1 DAY)) AS bigint) - 1"
    one_on = R._EVENTS.replace("user_id as device_id", "user_id + 1 as device_id")
    day_on = one_on + f", day AS (SELECT device_id, {R._UTC.format('epoch - epoch % 900')} AS day, {R._PARTS} FROM obs GROUP BY 1, 2) SELECT device_id, day, {R._DAILY_OUT} FROM day"
    gap = "steps AS (SELECT device_id, lag(epoch) OVER (PARTITION BY device_id ORDER BY epoch) AS start_epoch, epoch AS end_epoch FROM obs)"
    stations = f"""WITH d AS (SELECT cast(s_suppkey AS bigint) AS device_id, CASE WHEN s_suppkey % 3 = 1 THEN 'ST' ELSE 'HB' END AS device_type, s_name AS serial_number, cast(s_suppkey // 8 AS bigint) AS station_id, s_suppkey % 8 AS device_pos FROM supplier),
s AS (SELECT station_id, 'Station ' || station_id AS name, cast(station_id * 37 % 200 - 95 AS double) AS latitude, cast(station_id * 31 % 360 - 180 AS double) AS longitude, coalesce(CASE WHEN station_id % 5 <> 0 THEN {zone('station_id')} END, 'UTC') AS tz, CASE WHEN station_id % 4 <> 3 THEN cast(station_id * 13 % 3000 AS double) END AS elevation, station_id % 16 AS station_pos FROM (SELECT DISTINCT station_id FROM d)),
dim AS (SELECT s.*, d.device_id, d.device_type, d.serial_number, d.device_pos FROM s JOIN d USING (station_id) WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)"""
    base = f"WITH k AS (SELECT cast(s_suppkey AS bigint) AS k, coalesce(CASE WHEN s_suppkey % 5 <> 0 THEN {zone('s_suppkey')} END, 'UTC') AS tz FROM supplier)"
    daily = base + f", daily AS (SELECT k AS station_id, i AS pos, cast(to_timestamp({landed.DAY0} + i * 86400) AT TIME ZONE tz AS date) AS day, 'Day ' || i AS conditions, {r(f('cast((k * 7 + i * 3) % 40 AS double)'))} AS high_f, {r(f('cast((k * 7 + i * 3) % 40 - 8 AS double)'))} AS low_f, cast(k * i % 100 AS double) AS precip_probability FROM k, range(10) t(i))"
    hourly = f"hourly AS (SELECT k AS station_id, i AS pos, {local(f'{landed.DAY0} + i * 3600', 'tz')} AS local_time, 'Cloudy' AS conditions, {r(f('cast((k + i) % 35 AS double)'))} AS temp_f, cast((k * 3 + i) % 101 AS double) AS humidity, {r(mph('cast((k + i) % 11 AS double)'))} AS wind_mph, {r(mph('cast((k + i * 5) % 30 AS double)'))} AS gust_mph, {R._DIRECTION.format('cast(k * i * 11 % 360 AS double)')} AS wind_from, cast(i * 7 % 100 AS double) AS precip_probability, {r(inch('cast(i % 4 AS double)'))} AS precip_in FROM k, range(24) t(i))"
    live = f"""WITH e AS (SELECT user_id AS station_id, event_id AS pos, cast(floor(epoch(ts)) AS bigint) // 3600 AS at_epoch, value AS v, event_type AS kind FROM events), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY at_epoch DESC, pos) AS place FROM e) WHERE place = 1),
x AS (SELECT station_id, at_epoch, v / 10 - 9 AS c, {f('v / 10 - 9')} AS t, v % 101 AS h, CASE WHEN kind = 'click' THEN {mph('v / 25')} END AS w, {mph('v / 20')} AS gust, v * 7 % 360 AS dir, CASE WHEN kind = 'signup' THEN 980 + v / 10 ELSE 970 + v / 10 END AS p, CASE WHEN kind = 'purchase' THEN v / 50 END AS rain, CASE WHEN kind = 'error' THEN v / 10 END AS strike FROM n)
SELECT station_id, at_epoch, {r('t')} AS temp_f, {r('h')} AS humidity, {r(f(R._DEW))} AS dew_point_f, {r(f'CASE WHEN t >= 80 THEN {R._HEAT} WHEN t <= 50 THEN {R._CHILL} ELSE t END')} AS feels_like_f, {r('w')} AS wind_mph, {r('gust')} AS gust_mph, {R._DIRECTION.format('dir')} AS wind_from, {r(hg('p'))} AS pressure_inhg, {r(inch('rain'))} AS rain_today_in, round(strike / {U.KM_PER_MILE}, 6) AS last_strike_miles FROM x"""
    event_daily = R._EVENTS + f", day AS (SELECT device_id, {R._UTC.format('epoch - epoch % 900')} AS day, {R._PARTS} FROM obs GROUP BY 1, 2), daily AS (SELECT device_id, day, {R._f('tmin')} AS lo, {R._f('tmax')} AS hi, CASE WHEN rn > 0 THEN {inch('rsum')} END AS rain, {mph('gmax')} AS gust, n FROM day)"
    stored = R.conditions_sql(event_daily, R.AS_OF, "2024-01-31")
    shared = ["temp_f", "humidity", "dew_point_f", "feels_like_f", "wind_mph", "gust_mph", "wind_from", "pressure_inhg", "rain_today_in"]
    chosen = ", ".join(f"CASE WHEN l.live THEN l.{c} ELSE a.{c} END AS {c}" for c in shared)
    report = " ".join(f"LEFT JOIN (SELECT device_id, COLUMNS(* EXCLUDE (device_id)) AS '{part}_\\0' FROM ({given[q]})) USING (device_id)" for part, q in {"records": "records", "trend": "temperature_trend", "rain": "rain_stats", "wind": "wind_stats", "lightning": "lightning_stats", "solar": "solar_stats", "comfort": "comfort_stats", "spells": "temperature_spells", "pressure": "pressure_stats"}.items())
    quarter_names = {"tmin": "temp_min", "tmax": "temp_max", "tsum": "temp_sum", "tn": "temp_n", "hsum": "hum_sum", "hn": "hum_n", "wsum": "wind_sum", "wn": "wind_n", "wmax": "wind_max", "gmax": "gust_max", "calm": "calm_n", "rsum": "rain_sum", "rn": "rain_n", "ssum": "strikes", "sn": "strike_n", "close": "closest_km", "psum": "pressure_sum", "pn": "pressure_n", "pmin": "pressure_min", "pmax": "pressure_max", "mj": "solar_mj", "smax": "solar_max", "uvmax": "uv_max", "lmax": "lux_max", "n": "obs"}
    whole = {"tn", "hn", "wn", "calm", "rn", "sn", "pn", "n"}
    both_h, both_w = "air_temp_c IS NOT NULL AND humidity IS NOT NULL", "air_temp_c IS NOT NULL AND wind_avg IS NOT NULL"
    paired = f"sum(air_temp_c) FILTER ({both_h}) AS hot_t, sum(humidity) FILTER ({both_h}) AS hot_h, count(*) FILTER ({both_h}) AS hot_n, sum(air_temp_c) FILTER ({both_w}) AS cold_t, sum(wind_avg) FILTER ({both_w}) AS cold_w, count(*) FILTER ({both_w}) AS cold_n"
    quarters = ", ".join(f"{c if c in whole else r(c)} AS {name}" for c, name in quarter_names.items())
    return {
        "archive_range": R._EVENTS + f" SELECT device_id, epoch, {readings} FROM obs WHERE epoch BETWEEN {SPAN[0]} AND {SPAN[1]}",
        "archive_latest": given["latest"],
        "archive_pressure_tendency": given["pressure_tendency"],
        "archive_zone_map": R._EVENTS + " SELECT device_id, cast(strftime(to_timestamp(epoch) AT TIME ZONE 'UTC', '%Y%m') AS bigint) AS obs_month, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM obs GROUP BY 1, 2",
        "archive_metadata": R._SHIP + f" SELECT device_id, epoch, wind_interval, precip_type, report_interval_min, source, {r('battery_v')} AS battery_v FROM obs WHERE epoch BETWEEN 800000000 AND 850000000",
        "bucketed_days": given["daily_summary"],
        "checked_ingest": R._EVENTS + " SELECT count(*) AS rows, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM obs",
        "range_by_device": R._SHIP + f", {R._ZONED} SELECT o.device_id, epoch, {r('air_temp_c')} AS air_temp_c FROM obs o JOIN zones z ON z.device_id = o.device_id WHERE epoch BETWEEN {days(*DATES)}",
        "days_by_device": R._SHIP + f", {R._ZONED} SELECT o.device_id, epoch, {r('rain_mm')} AS rain_mm FROM obs o JOIN zones z ON z.device_id = o.device_id WHERE epoch BETWEEN {days('1996-10-01', LAST_DAY)}",
        "wire_rows": one_on + f" SELECT device_id, epoch, {readings}, source, cast(NULL AS varchar) AS bad FROM obs",
        "station_devices": stations + " SELECT * FROM dim",
        "picked_devices": stations + " SELECT station_id // 16 AS account, station_id, device_id, device_type FROM (SELECT *, row_number() OVER (PARTITION BY station_id // 16 ORDER BY device_type <> 'ST', station_pos, device_pos) AS place FROM dim) WHERE place = 1",
        "forecast_current": base + f" SELECT k AS station_id, {local(f'{landed.DAY0} + k * 61', 'tz')} AS local_time, 'Clear' AS conditions, {r(f('cast(k % 40 - 5 AS double)'))} AS temp_f, cast(k % 101 AS double) AS humidity, {r(mph('cast(k % 17 AS double)'))} AS wind_mph, {R._DIRECTION.format('cast(k * 23 % 360 AS double)')} AS wind_from, {r(hg('cast(1000 + k % 30 AS double)'))} AS pressure_inhg FROM k",
        "forecast_daily": daily + " SELECT * FROM daily",
        "forecast_hourly": base + f", {hourly} SELECT * FROM hourly",
        "forecast_summary": daily + f", {hourly}, a AS (SELECT station_id, max(high_f) AS high_f, min(low_f) AS low_f, max(precip_probability) AS day_precip_probability, count(*) AS n_days FROM daily GROUP BY 1), b AS (SELECT station_id, max(gust_mph) AS gust_mph, max(precip_probability) AS hour_precip_probability, count(*) AS n_hours FROM hourly GROUP BY 1) SELECT * FROM a FULL JOIN b USING (station_id)",
        "conditions_live": live,
        "conditions_merged": f"WITH l AS (SELECT *, true AS live FROM ({live}) WHERE station_id % 3 <> 0), a AS (SELECT *, CASE WHEN device_id % 5 <> 0 THEN device_id END AS station_id FROM ({stored})) SELECT coalesce(l.station_id, a.station_id) AS station_id, a.device_id, CASE WHEN l.live THEN 'live' ELSE 'archive' END AS source, {chosen}, a.pressure_trend FROM l FULL JOIN a ON l.station_id = a.station_id",
        "search_page": R._EVENTS + f", c AS (SELECT device_id, {R._UTC.format('epoch')} AS day, CASE WHEN count(rain_mm) = 0 THEN 'missing' WHEN count(rain_mm) < count(*) THEN 'partial' ELSE 'complete' END AS rain_coverage, nullif(count(rain_mm), 0) AS reads FROM obs GROUP BY 1, 2) SELECT * FROM c WHERE contains(rain_coverage, 'part') ORDER BY reads DESC NULLS LAST, device_id, day LIMIT 60 OFFSET 5",
        "series_coarsened": R._EVENTS + f""", c AS (SELECT device_id, min(epoch) AS a, max(epoch) AS z FROM obs GROUP BY 1), w AS (SELECT device_id, min(k * 60) AS bucket_s FROM (SELECT device_id, a, z, unnest(range(1, 1000)) AS k FROM c) WHERE z // (k * 60) - a // (k * 60) + 1 <= 2000 GROUP BY 1)
SELECT device_id, bucket_s, bucket_s > 60 AS coarsened, epoch // bucket_s * bucket_s AS bucket_epoch, {r('avg(air_temp_c)')} AS temp_c, count(*) AS obs FROM obs JOIN w USING (device_id) GROUP BY 1, 2, 4""",
        "normalise_zero_floored": R._MONTHS + f" SELECT device_id, period, {r('rain')} AS rain_in, {r('CASE WHEN max(rain) OVER g > 0 THEN rain / max(rain) OVER g WHEN rain IS NOT NULL THEN 0.0 END')} AS scaled FROM months WINDOW g AS (PARTITION BY device_id)",
        "stats_report_flat": f"SELECT * FROM (SELECT device_id, COLUMNS(* EXCLUDE (device_id)) AS 'coverage_\\0' FROM ({given['coverage']})) {report}",
        "stream_series_hourly": one_on + f", b AS (SELECT device_id, epoch // 3600 * 3600 AS bucket_epoch, {R._BUCKETS} FROM obs GROUP BY 1, 2) SELECT device_id, bucket_epoch, {R._BUCKETS_OUT} FROM b",
        "stream_quarters": one_on + f", q AS (SELECT device_id, epoch // 900 AS bucket, {R._PARTS}, {paired} FROM obs GROUP BY 1, 2) SELECT device_id, bucket, {quarters}, {r('hot_t')} AS hot_t, {r('hot_h')} AS hot_h, hot_n, {r('cold_t')} AS cold_t, {r('cold_w')} AS cold_w, cold_n FROM q",
        "stream_sessions": one_on + f", {gap}, n AS (SELECT device_id, end_epoch AS epoch, sum(CASE WHEN start_epoch IS NULL OR end_epoch - start_epoch >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY end_epoch) AS k FROM steps) SELECT device_id, min(epoch) AS first_epoch, max(epoch) AS last_epoch, count(*) AS obs FROM n GROUP BY device_id, k",
        "stream_gaps": one_on + f", {gap} SELECT device_id, start_epoch, end_epoch, end_epoch - start_epoch AS seconds FROM steps WHERE end_epoch - start_epoch > 3600",
        "stream_deduped": one_on + f" SELECT device_id, epoch, {readings} FROM obs",
        "stream_partial_days": day_on,
        "synced_days": day_on,
    }
