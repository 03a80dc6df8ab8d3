"""Summaries by local day, hour, month and year, and calendar spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationspark.functions.calendar import day_end, day_start, local_hour
from stationspark.functions.units import c_to_f, known_total, mm_to_inch, mps_to_mph

from .rollup import QUARTER_S, merge_partials, with_zone

RAINY_MM = 0.254
#: Rain of a shown day that counts as rainy, in inches.
RAINY_IN = 0.01


def _rain_in(reads: str = "rain_n", total: str = "rain_sum") -> Column:
    return known_total(F.col(reads), mm_to_inch(F.col(total)))


def _ratio(total: str, count: str) -> Column:
    return F.try_divide(F.col(total), F.col(count))


def daily_summary(day: DataFrame) -> DataFrame:
    """Per device and local day: temperatures, rain (null without a reading) with its readings, peak gust, observations."""
    return day.select(
        "device_id",
        "day",
        c_to_f(F.col("temp_min")).alias("temp_min_f"),
        c_to_f(F.col("temp_max")).alias("temp_max_f"),
        c_to_f(_ratio("temp_sum", "temp_n")).alias("temp_avg_f"),
        _rain_in().alias("rain_in"),
        F.col("rain_n").alias("rain_readings"),
        mps_to_mph(F.col("gust_max")).alias("gust_max_mph"),
        "obs",
    )


def hourly_climatology(quarter: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Per device and local hour over all days; means over all samples, hours never seen are absent."""
    hour = local_hour(F.col("bucket") * QUARTER_S, F.col("tz")).alias("hour")
    merged = with_zone(quarter, devices).groupBy("device_id", hour).agg(*merge_partials())
    return merged.select(
        "device_id",
        "hour",
        c_to_f(_ratio("temp_sum", "temp_n")).alias("temp_avg_f"),
        c_to_f(F.col("temp_min")).alias("temp_min_f"),
        c_to_f(F.col("temp_max")).alias("temp_max_f"),
        _ratio("hum_sum", "hum_n").alias("humidity_avg"),
        mps_to_mph(_ratio("wind_sum", "wind_n")).alias("wind_avg_mph"),
        mps_to_mph(F.col("gust_max")).alias("gust_max_mph"),
        "obs",
    )


def period_summary(day: DataFrame, period: str = "month") -> DataFrame:
    """Per device and month (yyyy-MM) or year (yyyy): the mean is weighted by samples, rain sums before it is converted."""
    shape = {"month": "yyyy-MM", "year": "yyyy"}[period]
    rainy = F.count_if((F.col("rain_n") > 0) & (F.col("rain_sum") >= RAINY_MM)).alias("rainy_days")
    merged = day.groupBy("device_id", F.date_format("day", shape).alias("period")).agg(*merge_partials(), F.count("*").alias("days_observed"), rainy)
    return merged.select(
        "device_id",
        "period",
        c_to_f(F.col("temp_min")).alias("temp_min_f"),
        c_to_f(F.col("temp_max")).alias("temp_max_f"),
        c_to_f(_ratio("temp_sum", "temp_n")).alias("temp_avg_f"),
        _rain_in().alias("rain_in"),
        mps_to_mph(F.col("gust_max")).alias("gust_max_mph"),
        "days_observed",
        "rainy_days",
        "obs",
        F.col("rain_n").alias("rain_readings"),
    )


def monthly_normals(months: DataFrame) -> DataFrame:
    """Per device and calendar month: means over years, each quantity over the years that have it."""
    rain = F.col("rain_in").isNotNull()
    return months.groupBy("device_id", F.substring("period", 6, 2).cast("int").alias("month")).agg(
        F.count("*").alias("years"),
        F.avg("temp_avg_f").alias("temp_avg_f"),
        F.avg("temp_min_f").alias("temp_min_f"),
        F.avg("temp_max_f").alias("temp_max_f"),
        F.count_if(rain).alias("rain_years"),
        F.avg("rain_in").alias("rain_in"),
        F.avg(F.when(rain, F.col("rainy_days"))).alias("rainy_days"),
    )


def this_day(day: DataFrame, month: int, dom: int) -> DataFrame:
    """One row per device and year that has this local date; 29 February only in leap years."""
    found = daily_summary(day.where((F.month("day") == month) & (F.dayofmonth("day") == dom)))
    return found.withColumn("year", F.year("day")).drop("day")


def arg_most(value: Column, key: Column) -> Column:
    """Aggregate to the highest value's (v, -k) with the smallest key on ties; rows without a value don't count."""
    return F.max(F.when(value.isNotNull(), F.struct(value.alias("v"), (-key).alias("k"))))


def arg_least(value: Column, key: Column) -> Column:
    return F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), key.alias("k"))))


def settled(total: Column) -> Column:
    """A total of readings to nine places, to compare it with others: equal ones may differ in the last place by the order of adding."""
    return F.round(total, 9)


def day_number(day: str | Column = "day") -> Column:
    return F.unix_date(F.col(day) if isinstance(day, str) else day)


def this_day_records(years: DataFrame) -> DataFrame:
    """Per device the record high, low and wettest year of one date; the earliest year wins ties, measured zero counts."""
    year = F.col("year")
    found = years.groupBy("device_id").agg(
        arg_most(F.col("temp_max_f"), year).alias("high"), arg_least(F.col("temp_min_f"), year).alias("low"), arg_most(settled(F.col("rain_in")), year).alias("wet")
    )
    return found.select(
        "device_id",
        F.col("high.v").alias("record_high_f"), (-F.col("high.k")).alias("record_high_year"),
        F.col("low.v").alias("record_low_f"), F.col("low.k").alias("record_low_year"),
        F.col("wet.v").alias("wettest_in"), (-F.col("wet.k")).alias("wettest_year"),
    )


def view_summary(daily: DataFrame, period: str = "week") -> DataFrame:
    """Week (from Monday), month or year of daily rows: extremes, rain known or null, days observed of the period's days."""
    start = F.to_date(F.date_trunc(period, F.col("day"))).alias("period_start")
    end = {"week": lambda s: F.date_add(s, 7), "month": lambda s: F.add_months(s, 1), "year": lambda s: F.add_months(s, 12)}[period]
    found = daily.groupBy("device_id", start).agg(
        F.max("temp_max_f").alias("high_f"),
        F.min("temp_min_f").alias("low_f"),
        F.max("gust_max_mph").alias("gust_max_mph"),
        F.sum("rain_in").alias("rain_in"),
        F.count_if(F.col("rain_in") >= RAINY_IN).alias("rainy_days"),
        F.count("*").alias("observed_days"),
    )
    return found.withColumn("calendar_days", F.datediff(end(F.col("period_start")), F.col("period_start")))


def calendar_grid(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Every calendar day of every device between two dates; unobserved days are null."""
    days = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias("day")
    return daily.select("device_id").distinct().select("device_id", days).join(daily, ["device_id", "day"], "left")


def month_strip(months: DataFrame, year: int) -> DataFrame:
    """The twelve months of a year for every device, with mean temperature and rain where there are any."""
    spine = months.select("device_id").distinct().select("device_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    spine = spine.withColumn("period", F.format_string("%04d-%02d", F.lit(year), F.col("month")))
    return spine.join(months.select("device_id", "period", "temp_avg_f", "rain_in"), ["device_id", "period"], "left")


def day_profile(obs: DataFrame, day: str, devices: DataFrame | None = None, step_s: int = 1800) -> DataFrame:
    """The half hours of a local day (46 to 51 of them) for every device; rain without a reading is null.

    Half hours are counted from the epoch, so where a day begins at a quarter of one, the first and the last reach beyond it.
    """
    from .series import series

    date, zone = F.to_date(F.lit(day)), F.col("tz")
    bounds = with_zone(obs.select("device_id").distinct(), devices)
    bounds = bounds.withColumn("first", F.floor(day_start(date, zone) / step_s) * step_s).withColumn("last", day_end(date, zone))
    low, high = F.unix_date(date).cast("long") * 86_400 - 86_400, F.unix_date(date).cast("long") * 86_400 + 2 * 86_400
    found = series(obs.where((F.col("epoch") >= low) & (F.col("epoch") < high)), step_s)
    spine = bounds.select("device_id", F.explode(F.sequence("first", "last", F.lit(step_s).cast("long"))).alias("bucket_epoch"))
    joined = spine.join(found, ["device_id", "bucket_epoch"], "left")
    return joined.withColumn("rain_mm", known_total(F.col("rain_readings"), F.col("rain_mm")))


def rank_days(daily: DataFrame, metric: str, k: int = 10) -> DataFrame:
    """Each device's k highest days by a metric; missing values last, earlier days first on ties."""
    order = Window.partitionBy("device_id").orderBy(F.desc_nulls_last(metric), "day")
    return daily.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("device_id", "rank", "day", metric)


def normalise_metric(df: DataFrame, metric: str, by: list[str], zero_floored: bool = False) -> DataFrame:
    """``metric`` scaled to 0..1 within each group; a flat series is 0.5, quantities may be scaled from zero instead."""
    w, v = Window.partitionBy(*by), F.col(metric)
    low, high = (F.lit(0.0) if zero_floored else F.min(v).over(w)), F.max(v).over(w)
    flat = F.when(v.isNotNull(), F.lit(0.0 if zero_floored else 0.5))
    return df.withColumn("scaled", F.when(high > low, (v - low) / (high - low)).otherwise(flat))
