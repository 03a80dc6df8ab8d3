"""Statistics by sensor over a range of days, one row per device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationspark.functions.calendar import local_day
from stationspark.functions.units import (
    COMPASS,
    c_to_f,
    dew_point_c,
    heat_index_f,
    km_to_mile,
    known_total,
    mb_to_inhg,
    mm_to_inch,
    mps_to_mph,
    sector,
    sector_name,
    wind_chill_f,
)

from .calendar import RAINY_MM, arg_least, arg_most, day_number, settled
from .rollup import CALM_MPS, QUARTER_S, quarter_rollup, with_zone
from .spells import spells, with_spell

STALE_S = 3600
CONTINUOUS = ["air_temp_c", "humidity", "pressure_mb", "wind_avg", "uv", "solar_wm2", "illuminance_lux"]


def _date(number: Column) -> Column:
    return F.date_from_unix_date(number.cast("int"))


def _top_day(found: str) -> Column:
    return _date(-F.col(f"{found}.k"))


#: All-time extremes: name, sensor, the quarter's column, how they are found, conversion, unit.
_RECORDS = [
    ("hottest", "air_temp_c", "temp_max", F.max, c_to_f, "f"), ("coldest", "air_temp_c", "temp_min", F.min, c_to_f, "f"),
    ("peak_gust", "wind_gust", "gust_max", F.max, mps_to_mph, "mph"), ("lowest_pressure", "pressure_mb", "pressure_min", F.min, mb_to_inhg, "inhg"),
    ("peak_solar", "solar_wm2", "solar_max", F.max, None, "wm2"), ("peak_uv", "uv", "uv_max", F.max, None, "index"),
]


def records(obs: DataFrame, day: DataFrame, quarter: DataFrame | None = None) -> DataFrame:
    """All-time extremes with their times, total strikes, wettest day; the earliest time wins ties.

    The extremes are those of the quarter hours. Of the quarters that hold one the earliest is taken, at most six a device,
    and only their rows are looked at again for the time. All aggregates are of numbers, by hash.
    """
    quarter = quarter_rollup(obs) if quarter is None else quarter
    totals = [F.sum("strikes").alias("strikes"), F.sum("strike_n").alias("strike_n")]
    tops = quarter.groupBy("device_id").agg(*[how(q).alias(n) for n, _, q, how, _, _ in _RECORDS], *totals)
    values = tops.select("device_id", *[n for n, *_ in _RECORDS])
    holding = [F.min(F.when(F.col(q) == F.col(n), F.col("bucket"))).alias(f"{n}_at") for n, _, q, *_ in _RECORDS]
    firsts = quarter.select("device_id", "bucket", *{q: 0 for _, _, q, *_ in _RECORDS}).join(values, "device_id").groupBy("device_id", *values.columns[1:]).agg(*holding)
    places = F.array_distinct(F.array_compact(F.array(*[F.col(f"{n}_at") for n, *_ in _RECORDS])))
    wanted = firsts.withColumn("bucket", F.explode(places))
    rows = obs.select("device_id", "epoch", F.expr(f"epoch div {QUARTER_S}").alias("bucket"), *{c: 0 for _, c, *_ in _RECORDS})
    rows = rows.join(wanted, ["device_id", "bucket"])
    times = rows.groupBy("device_id").agg(*[F.min(F.when((F.col("bucket") == F.col(f"{n}_at")) & (F.col(c) == F.col(n)), F.col("epoch"))).alias(f"{n}_epoch") for n, c, *_ in _RECORDS])
    columns = [x for n, *_, convert, unit in _RECORDS for x in ((convert or (lambda v: v))(F.col(n)).alias(f"{n}_{unit}"), F.col(f"{n}_epoch"))]
    wet = day.groupBy("device_id").agg(_wettest().alias("wet"))
    wet = wet.select("device_id", mm_to_inch(F.col("wet.v")).alias("wettest_day_in"), _top_day("wet").alias("wettest_day"))
    found = tops.join(times, "device_id", "left").select("device_id", *columns, known_total(F.col("strike_n"), F.col("strikes")).alias("total_strikes"))
    return found.join(wet, "device_id", "left")


def _wettest() -> Column:
    return arg_most(F.when(F.col("rain_sum") > 0, settled(F.col("rain_sum"))), day_number())


def rain_stats(day: DataFrame) -> DataFrame:
    """Rain with its coverage, wettest day, and the longest dry and wet spells; days without a reading break both."""
    rainy = (F.col("rain_n") > 0) & (F.col("rain_sum") >= RAINY_MM)
    found = day.groupBy("device_id").agg(
        F.sum("obs").alias("observations"),
        F.sum("rain_n").alias("rain_readings"),
        F.sum(F.when(F.col("rain_n") > 0, mm_to_inch(F.col("rain_sum")))).alias("total_in"),
        F.count("*").alias("days_observed"),
        F.count_if(rainy).alias("rainy_days"),
        _wettest().alias("wet"),
    )
    found = found.withColumn("wettest_day_in", mm_to_inch(F.col("wet.v"))).withColumn("wettest_day", _top_day("wet")).drop("wet")
    found = with_spell(found, spells(day, (F.col("rain_n") > 0) & (F.col("rain_sum") < RAINY_MM), "dry_spell"), "dry_spell")
    return with_spell(found, spells(day, rainy, "wet_spell"), "wet_spell")


def wind_stats(day: DataFrame) -> DataFrame:
    """Mean wind over samples, extremes with their days, windiest day by its mean, share of calm samples."""
    d = day_number()
    found = day.groupBy("device_id").agg(
        F.sum("wind_n").alias("n"), F.sum("wind_sum").alias("sum"), F.sum("calm_n").alias("calm"),
        arg_most(F.col("wind_max"), d).alias("sustained"), arg_most(F.col("gust_max"), d).alias("gust"),
        arg_most(F.try_divide("wind_sum", "wind_n"), d).alias("windiest"),
    )
    return found.select(
        "device_id",
        F.col("n").alias("wind_readings"),
        mps_to_mph(F.try_divide("sum", "n")).alias("mean_mph"),
        mps_to_mph(F.col("sustained.v")).alias("max_sustained_mph"), _top_day("sustained").alias("max_sustained_day"),
        mps_to_mph(F.col("gust.v")).alias("peak_gust_mph"), _top_day("gust").alias("peak_gust_day"),
        mps_to_mph(F.col("windiest.v")).alias("windiest_mean_mph"), _top_day("windiest").alias("windiest_day"),
        F.try_divide(100.0 * F.col("calm"), F.col("n")).alias("calm_pct"),
    )


def wind_rose(obs: DataFrame) -> DataFrame:
    """Sixteen rows per device: count, share of samples with direction that are not calm, mean speed, peak gust; calm share.

    The calm share is of all samples with a speed. Sectors and calm come from one aggregate over one scan.
    """
    windy = F.col("wind_avg") >= CALM_MPS
    place = F.when(windy & F.col("wind_dir").isNotNull(), sector(F.col("wind_dir")))
    parts = obs.where(F.col("wind_avg").isNotNull()).groupBy("device_id", place.alias("sector")).agg(
        F.count("*").alias("n"), F.avg("wind_avg").alias("mean"), F.max("wind_gust").alias("gust"), F.count_if(F.col("wind_avg") < CALM_MPS).alias("calm")
    )
    by_sector = F.map_from_entries(F.collect_list(F.when(F.col("sector").isNotNull(), F.struct("sector", F.struct("n", "mean", "gust")))))
    device = parts.groupBy("device_id").agg(F.sum("n").alias("obs"), F.sum("calm").alias("calm"), F.sum(F.when(F.col("sector").isNotNull(), F.col("n"))).alias("placed"), by_sector.alias("by"))
    rows = device.withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(len(COMPASS) - 1)))).withColumn("s", F.try_element_at("by", F.col("sector")))
    return rows.select(
        "device_id",
        "sector",
        sector_name(F.col("sector")).alias("direction"),
        F.coalesce("s.n", F.lit(0).cast("long")).alias("count"),
        F.coalesce(F.try_divide(100.0 * F.col("s.n"), F.col("placed")), F.lit(0.0)).alias("pct"),
        mps_to_mph(F.col("s.mean")).alias("mean_mph"),
        mps_to_mph(F.col("s.gust")).alias("gust_max_mph"),
        (100.0 * F.col("calm") / F.col("obs")).alias("calm_pct"),
        "obs",
    )


def solar_stats(day: DataFrame) -> DataFrame:
    """Energy from samples with a usable interval, peaks with their days, sunniest day (which may have none)."""
    d = day_number()
    found = day.groupBy("device_id").agg(
        F.sum("solar_mj").alias("total_mj"), F.avg("solar_mj").alias("mean_daily_mj"), F.count("*").alias("days_observed"),
        arg_most(F.col("solar_mj"), d).alias("sunny"), arg_most(F.col("solar_max"), d).alias("solar"),
        arg_most(F.col("uv_max"), d).alias("uv"), arg_most(F.col("lux_max"), d).alias("lux"),
    )
    return found.select(
        "device_id", "days_observed", "total_mj", "mean_daily_mj",
        F.col("sunny.v").alias("sunniest_mj"), _top_day("sunny").alias("sunniest_day"),
        F.col("solar.v").alias("peak_solar_wm2"), _top_day("solar").alias("peak_solar_day"),
        F.col("uv.v").alias("peak_uv"), _top_day("uv").alias("peak_uv_day"),
        F.col("lux.v").alias("peak_lux"), _top_day("lux").alias("peak_lux_day"),
    )


def lightning_stats(day: DataFrame) -> DataFrame:
    """Strikes, storm days, busiest day, closest strike, and the longest spell of days known to be free of strikes."""
    stormy, d = F.col("strikes") > 0, day_number()
    found = day.groupBy("device_id").agg(
        known_total(F.sum("strike_n"), F.sum("strikes")).alias("total_strikes"), F.count_if(stormy).alias("storm_days"),
        F.min(F.when(stormy, F.col("day"))).alias("first_storm_day"), F.max(F.when(stormy, F.col("day"))).alias("last_storm_day"),
        arg_most(F.when(stormy, F.col("strikes")), d).alias("busy"), arg_least(F.col("closest_km"), d).alias("close"),
        F.count("*").alias("days_observed"),
    )
    found = found.withColumns({
        "busiest_strikes": F.col("busy.v"), "busiest_day": _top_day("busy"),
        "closest_miles": km_to_mile(F.col("close.v")), "closest_day": _date(F.col("close.k")),
    }).drop("busy", "close")
    return with_spell(found, spells(day, (F.col("strike_n") > 0) & (F.col("strikes") == 0), "storm_free"), "storm_free")


def daily_mean_swings(day: DataFrame) -> DataFrame:
    """Per device the largest fall and rise of the daily mean pressure between consecutive calendar days with readings."""
    order = Window.partitionBy("device_id").orderBy("day")
    means = day.where("pressure_n > 0").select("device_id", "day", (F.col("pressure_sum") / F.col("pressure_n")).alias("mean"))
    steps = means.withColumn("change", F.col("mean") - F.lag("mean").over(order)).withColumn("before", F.lag("day").over(order))
    steps = steps.where(F.datediff("day", "before") == 1)
    d, change = day_number(), F.col("change")
    found = steps.groupBy("device_id").agg(arg_least(F.when(change < 0, change), d).alias("fall"), arg_most(F.when(change > 0, change), d).alias("rise"))
    return found.select(
        "device_id",
        mb_to_inhg(F.col("fall.v")).alias("largest_fall_inhg"), _date(F.col("fall.k")).alias("largest_fall_day"),
        mb_to_inhg(F.col("rise.v")).alias("largest_rise_inhg"), _top_day("rise").alias("largest_rise_day"),
    )


def pressure_stats(day: DataFrame) -> DataFrame:
    """Mean over samples, extremes with their days, and the largest swings from day to day."""
    d = day_number()
    found = day.groupBy("device_id").agg(
        F.try_divide(F.sum("pressure_sum"), F.sum("pressure_n")).alias("mean"), F.count("*").alias("days_observed"),
        arg_least(F.col("pressure_min"), d).alias("low"), arg_most(F.col("pressure_max"), d).alias("high"),
    )
    found = found.select(
        "device_id", "days_observed", mb_to_inhg(F.col("mean")).alias("mean_inhg"),
        mb_to_inhg(F.col("low.v")).alias("lowest_inhg"), _date(F.col("low.k")).alias("lowest_day"),
        mb_to_inhg(F.col("high.v")).alias("highest_inhg"), _top_day("high").alias("highest_day"),
    )
    return found.join(daily_mean_swings(day), "device_id", "left")


def comfort_stats(quarter: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Hottest and coldest feels-like and muggiest dew point with their days, from quarter hours of paired samples.

    Heat comes from pairs of temperature and humidity, chill from pairs of temperature and wind, mild air from all
    temperatures; a quarter hour may give several candidates. Days without a temperature do not count.
    """
    rows = with_zone(quarter.where("temp_n > 0"), devices).withColumn("day", local_day(F.col("bucket") * QUARTER_S, F.col("tz")))
    hot, hum = c_to_f(F.try_divide("hot_t", "hot_n")), F.try_divide("hot_h", "hot_n")
    cold, wind = c_to_f(F.try_divide("cold_t", "cold_n")), mps_to_mph(F.try_divide("cold_w", "cold_n"))
    mild = c_to_f(F.col("temp_sum") / F.col("temp_n"))
    candidates = [F.when(hot >= 80, heat_index_f(hot, hum)), F.when(cold <= 50, wind_chill_f(cold, wind)), F.when((mild > 50) & (mild < 80), mild)]
    dew = c_to_f(dew_point_c(F.try_divide("hot_t", "hot_n"), hum))
    d = day_number()
    rows = rows.select("device_id", "day", F.greatest(*candidates).alias("most"), F.least(*candidates).alias("least"), dew.alias("dew"))
    found = rows.groupBy("device_id").agg(
        F.count_distinct("day").alias("days_observed"), arg_most(F.col("most"), d).alias("hot"), arg_least(F.col("least"), d).alias("cold"), arg_most(F.col("dew"), d).alias("muggy")
    )
    return found.select(
        "device_id", "days_observed",
        F.col("hot.v").alias("hottest_feels_like_f"), _top_day("hot").alias("hottest_feels_like_day"),
        F.col("cold.v").alias("coldest_feels_like_f"), _date(F.col("cold.k")).alias("coldest_feels_like_day"),
        F.col("muggy.v").alias("muggiest_dew_point_f"), _top_day("muggy").alias("muggiest_day"),
    )


def sensor_health(obs: DataFrame) -> DataFrame:
    """Seven rows per device, one a continuous sensor: readings, coverage, last reading, whether it fell silent; battery range.

    Stale: its last reading is over an hour older than the device's newest row. A sensor that never reported is not stale.
    """
    found = obs.groupBy("device_id").agg(
        F.count("*").alias("obs"), F.max("epoch").alias("newest"), F.min("battery_v").alias("battery_min_v"), F.max("battery_v").alias("battery_max_v"),
        *[F.count(s).alias(f"{s}_n") for s in CONTINUOUS], *[F.max(F.when(F.col(s).isNotNull(), F.col("epoch"))).alias(f"{s}_last") for s in CONTINUOUS],
    )
    sensors = F.explode(F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(f"{s}_n").alias("readings"), F.col(f"{s}_last").alias("last_epoch")) for s in CONTINUOUS]))
    rows = found.select("device_id", "obs", "newest", "battery_min_v", "battery_max_v", sensors.alias("s")).select("*", "s.*")
    return rows.select(
        "device_id", "sensor", "readings", (100.0 * F.col("readings") / F.col("obs")).alias("coverage_pct"), "last_epoch",
        F.coalesce(F.col("last_epoch") < F.col("newest") - STALE_S, F.lit(False)).alias("stale"), "battery_min_v", "battery_max_v",
    )
