"""Landed JSON of the weather service: observations, stations, forecasts, current conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationspark.functions.calendar import local_timestamp
from stationspark.functions.units import c_to_f, compass, dew_point_c, feels_like_f, km_to_mile, mb_to_inhg, mm_to_inch, mps_to_mph
from stationspark.schema import BOUNDS, LAST_EPOCH, align_schema

RESPONSE = "device_id bigint, type string, status struct<status_code:int>, obs array<array<double>>, requested_device_id bigint"
#: Fields of a wire row at most; those past the known ones are derived by the service.
MOST_FIELDS = 22
# The sensor at each place of a wire row, from place 1 on (place 0 is the epoch).
WIRE = [
    "wind_lull", "wind_avg", "wind_gust", "wind_dir", "wind_interval", "pressure_mb", "air_temp_c", "humidity", "illuminance_lux",
    "uv", "solar_wm2", "rain_mm", "precip_type", "strike_dist_km", "strike_count", "battery_v", "report_interval_min",
]


def _out_of_range(row: Column) -> Column:
    """Whether a wire row breaks a range, by one pass over the array.

    The check looks at the array only: as conditions on the columns made of it, their copies would multiply when the
    optimizer derives what holds for those columns.
    """
    by_name = {name: (float(low), float(high), whole) for name, low, high, whole in BOUNDS}
    limits = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(w).alias("whole")) for a, b, w in [(1.0, float(LAST_EPOCH), True), *(by_name[s] for s in WIRE)]])
    wrong = lambda v, b: F.isnan(v) | (v < b["low"]) | (v > b["high"]) | (b["whole"] & (F.floor(v) != v))
    return F.exists(F.zip_with(F.slice(row, 1, len(WIRE) + 1), limits, lambda v, b: F.coalesce(wrong(v, b), F.lit(False))), lambda x: x)


def observation_rows(responses: DataFrame, ranges: bool = False) -> DataFrame:
    """Wire responses to one row per inner array: device_id, epoch (double as sent), sensors, source, bad.

    Short rows are padded with null. ``bad`` says why a row or its whole response is not to be taken, else it is null: another
    type, a status other than 0, no obs key, another device than was asked for, an empty or overlong row, no epoch; with
    ``ranges`` also a reading out of range. Where responses have a column ``arrival``, rows get it with their place behind it.
    """
    device = F.coalesce("requested_device_id", "device_id") if "requested_device_id" in responses.columns else F.col("device_id")
    envelope = (
        F.when(F.col("type") != "obs_st", "type")
        .when(F.col("status.status_code") != 0, "status")
        .when(F.col("obs").isNull(), "no observations")
        .when(F.col("device_id") != device, "device")
    )
    rows = responses.select(device.alias("device_id"), envelope.alias("envelope"), F.posexplode_outer("obs").alias("place", "row"), F.col("obs").isNull().alias("none"), *(["arrival"] if "arrival" in responses.columns else []))
    rows = rows.where(F.col("row").isNotNull() | F.col("none") | F.col("envelope").isNotNull())
    size = F.size("row")
    bad = F.coalesce(F.col("envelope"), F.when(size == 0, "empty row").when(size > MOST_FIELDS, "overlong row").when(F.get("row", F.lit(0)).isNull(), "no epoch"))
    if ranges:
        bad = F.coalesce(bad, F.when(F.coalesce(F.col("device_id") <= 0, F.lit(True)), "device_id").when(_out_of_range(F.col("row")), "range"))
    sensors = [F.get("row", F.lit(k + 1)).alias(s) for k, s in enumerate(WIRE)]
    return rows.select("device_id", F.get("row", F.lit(0)).alias("epoch"), *sensors, F.lit("rest").alias("source"), bad.alias("bad"), *([F.struct("arrival.*", "place").alias("arrival")] if "arrival" in responses.columns else []))


def read_observation_responses(spark: SparkSession, path: str) -> DataFrame:
    return observation_rows(spark.read.schema(RESPONSE).json(path))


def reasons(df: DataFrame) -> Column:
    """What is wrong with an observation row, as an array of words; empty for a good one. Null readings pass."""

    def check(name: str, low: float, high: float, whole: bool) -> Column:
        v = F.col(name).cast("double")
        wrong = F.isnan(v) | (v < low) | (v > high)
        return F.when(wrong | (F.floor(v) != v) if whole else wrong, name)

    e = F.col("epoch").cast("double")
    # A null epoch is wrong as well; comparisons with it are null, so it is asked for first.
    epoch = F.when(F.col("epoch").isNull() | F.isnan(e) | (e < 1) | (e > LAST_EPOCH) | (F.floor(e) != e), "epoch")
    device = F.when(F.col("device_id").isNull() | (F.col("device_id") <= 0), "device_id")
    wire = [F.col("bad")] if "bad" in df.columns else []
    return F.array_compact(F.array(*wire, device, epoch, *[check(*b) for b in BOUNDS]))


def validate_observations(raw: DataFrame, policy: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows within all ranges in the archive's types, and the others with ``reason``.

    "fail" is all or nothing: one bad row raises, by one aggregate over the batch. "quarantine" keeps both parts.
    """
    if policy not in ("fail", "quarantine"):
        raise ValueError(policy)
    marked = raw.withColumn("reason", reasons(raw))
    bad = marked.where(F.size("reason") > 0)
    if policy == "fail":
        found = bad.select(F.col("device_id"), "reason").head()
        if found:
            raise ValueError(f"observations of device {found[0]} are not valid: {', '.join(found[1])}")
    return align_schema(marked.where(F.size("reason") == 0)), bad


def clip_to_window(raw: DataFrame, start_epoch: int, end_epoch: int) -> DataFrame:
    """``raw``, or an error if any row lies outside the window that was asked for."""
    if not raw.where(~F.col("epoch").between(start_epoch, end_epoch)).isEmpty():
        raise ValueError("a row lies outside the requested window")
    return raw


def first_rows(batch: DataFrame, order: list[str]) -> DataFrame:
    """One row per (device_id, epoch): the first by arrival; a row of which a part of that is not known comes last there."""
    w = Window.partitionBy("device_id", "epoch").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return batch.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")


def append_observations(stored: DataFrame | None, batch: DataFrame, order: list[str]) -> DataFrame:
    """The rows of ``batch`` that are new: the first per key, and none whose key is stored. Writing them again adds nothing.

    A key that lacks its device or time is a key as well. Such rows, which only data that was not validated holds, meet the
    stored ones of their kind by themselves, so that the others' join keeps to plain equality and to stored buckets.
    """
    new = first_rows(batch, order)
    if stored is None:
        return new
    keys = stored.select("device_id", "epoch")
    lacking = F.col("device_id").isNull() | F.col("epoch").isNull()
    known = keys.where(lacking).toDF("__device", "__epoch")
    same = F.col("device_id").eqNullSafe(F.col("__device")) & F.col("epoch").eqNullSafe(F.col("__epoch"))
    whole = new.where(~lacking).join(keys, ["device_id", "epoch"], "left_anti")
    return whole.unionByName(new.where(lacking).join(known, same, "left_anti"))


STATIONS = (
    "stations array<struct<station_id:bigint,name:string,latitude:double,longitude:double,timezone:string,"
    "station_meta:struct<elevation:double>,devices:array<struct<device_id:bigint,device_type:string,serial_number:string>>>>"
)


def flatten_stations(responses: DataFrame) -> DataFrame:
    """Station × device rows with their places in the response; stations out of bounds are dropped."""
    rows = responses.select(F.posexplode("stations").alias("station_pos", "s")).select("station_pos", "s.*")
    fine = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & F.coalesce(F.col("station_meta.elevation").between(-500, 10_000), F.lit(True))
    rows = rows.where(fine).select("*", F.posexplode_outer("devices").alias("device_pos", "d"))
    return rows.select(
        "station_id", "name", "latitude", "longitude", F.coalesce("timezone", F.lit("UTC")).alias("tz"), F.col("station_meta.elevation").alias("elevation"),
        F.col("d.device_id").alias("device_id"), F.col("d.device_type").alias("device_type"), F.col("d.serial_number").alias("serial_number"), "station_pos", "device_pos",
    )


def pick_device(device_dim: DataFrame, account: str | None = None) -> DataFrame:
    """Per account the first outdoor sensor in station order, else the first device of any kind."""
    by = [F.col(account)] if account else [F.lit(0)]
    order = Window.partitionBy(*by).orderBy(F.coalesce(F.col("device_type") != "ST", F.lit(True)), "station_pos", "device_pos")
    return device_dim.where(F.col("device_id").isNotNull()).withColumn("__first", F.row_number().over(order)).where("__first = 1").drop("__first")


FORECAST = (
    "station_id bigint, timezone string, current_conditions struct<time:bigint,conditions:string,air_temperature:double,"
    "relative_humidity:double,wind_avg:double,wind_direction:double,sea_level_pressure:double>, forecast struct<"
    "daily:array<struct<day_start_local:bigint,conditions:string,air_temp_high:double,air_temp_low:double,precip_probability:double>>,"
    "hourly:array<struct<time:bigint,conditions:string,air_temperature:double,relative_humidity:double,wind_avg:double,"
    "wind_gust:double,wind_direction:double,precip_probability:double,precip:double>>>"
)
MOST_HOURS, MOST_DAYS = 240, 10


def flatten_forecast(responses: DataFrame, hours: int = 24, days: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current, daily, hourly) rows in US units with local times and compass labels."""
    hours, days = min(hours, MOST_HOURS), min(days, MOST_DAYS)
    tz = F.coalesce("timezone", F.lit("UTC"))
    c = "current_conditions."
    current = responses.select(
        "station_id", local_timestamp(F.col(c + "time"), tz).alias("local_time"), F.col(c + "conditions").alias("conditions"),
        c_to_f(F.col(c + "air_temperature")).alias("temp_f"), F.col(c + "relative_humidity").alias("humidity"),
        mps_to_mph(F.col(c + "wind_avg")).alias("wind_mph"), compass(F.col(c + "wind_direction")).alias("wind_from"),
        mb_to_inhg(F.col(c + "sea_level_pressure")).alias("pressure_inhg"),
    )
    daily = responses.select("station_id", tz.alias("tz"), F.posexplode("forecast.daily").alias("pos", "d")).where(F.col("pos") < days)
    daily = daily.select(
        "station_id", "pos", F.to_date(local_timestamp(F.col("d.day_start_local"), F.col("tz"))).alias("day"), F.col("d.conditions").alias("conditions"),
        c_to_f(F.col("d.air_temp_high")).alias("high_f"), c_to_f(F.col("d.air_temp_low")).alias("low_f"), F.col("d.precip_probability").alias("precip_probability"),
    )
    hourly = responses.select("station_id", tz.alias("tz"), F.posexplode("forecast.hourly").alias("pos", "h")).where(F.col("pos") < hours)
    hourly = hourly.select(
        "station_id", "pos", local_timestamp(F.col("h.time"), F.col("tz")).alias("local_time"), F.col("h.conditions").alias("conditions"),
        c_to_f(F.col("h.air_temperature")).alias("temp_f"), F.col("h.relative_humidity").alias("humidity"), mps_to_mph(F.col("h.wind_avg")).alias("wind_mph"),
        mps_to_mph(F.col("h.wind_gust")).alias("gust_mph"), compass(F.col("h.wind_direction")).alias("wind_from"),
        F.col("h.precip_probability").alias("precip_probability"), mm_to_inch(F.col("h.precip")).alias("precip_in"),
    )
    return current, daily, hourly


def forecast_summary(daily: DataFrame, hourly: DataFrame) -> DataFrame:
    by_day = daily.groupBy("station_id").agg(F.max("high_f").alias("high_f"), F.min("low_f").alias("low_f"), F.max("precip_probability").alias("day_precip_probability"), F.count("*").alias("n_days"))
    by_hour = hourly.groupBy("station_id").agg(F.max("gust_mph").alias("gust_mph"), F.max("precip_probability").alias("hour_precip_probability"), F.count("*").alias("n_hours"))
    return by_day.join(by_hour, "station_id", "full_outer")


def latest_station_observation(rows: DataFrame) -> DataFrame:
    """Per station the row with the newest timestamp; the first of a response (``pos``) wins ties."""
    order = F.struct(F.col("timestamp"), -F.col("pos"))
    return rows.where(F.col("timestamp").isNotNull()).groupBy("station_id").agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def conditions_live(latest: DataFrame) -> DataFrame:
    """Current conditions of stations in US units; pressure at sea level, else at the station."""
    t, rh, w = F.col("air_temperature"), F.col("relative_humidity"), F.col("wind_avg")
    return latest.select(
        "station_id", F.col("timestamp").alias("at_epoch"), c_to_f(t).alias("temp_f"), rh.alias("humidity"), c_to_f(dew_point_c(t, rh)).alias("dew_point_f"),
        feels_like_f(t, rh, w).alias("feels_like_f"), mps_to_mph(w).alias("wind_mph"), mps_to_mph(F.col("wind_gust")).alias("gust_mph"), compass(F.col("wind_direction")).alias("wind_from"),
        mb_to_inhg(F.coalesce("sea_level_pressure", "station_pressure")).alias("pressure_inhg"), mm_to_inch(F.col("precip_accum_local_day")).alias("rain_today_in"),
        km_to_mile(F.col("lightning_strike_last_distance")).alias("last_strike_miles"),
    )


