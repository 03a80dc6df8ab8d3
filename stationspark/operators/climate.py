"""Degree days, threshold days, temperature spells and the seasonal trend."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationspark.functions.units import c_to_f

from .calendar import arg_least, arg_most, monthly_normals
from .spells import spells, with_spell

# Default thresholds in degrees Fahrenheit.
DEGREE_BASES = {"heating": 65.0, "cooling": 65.0, "growing": 50.0, "growing_cap": 86.0}
INDEX_THRESHOLDS = {"frost": 32.0, "ice": 32.0, "summer": 77.0, "hot": 90.0, "tropical": 68.0}
SPELL_THRESHOLDS = {"heat": 90.0, "cold": 32.0}


def _temperature(value: float, what: str = "threshold") -> float:
    """What is given must be a temperature that can occur."""
    if not math.isfinite(value) or not -200 <= value <= 300:
        raise ValueError(f"{what} {value} is not a temperature")
    return value


def _threshold(value: float, default: float) -> float:
    """0 stands for the default."""
    return _temperature(value) or default


def _extremes(day: DataFrame) -> DataFrame:
    """Days that have both extremes, in degrees Fahrenheit."""
    both = day.where(F.col("temp_min").isNotNull() & F.col("temp_max").isNotNull())
    return both.select("device_id", "day", c_to_f(F.col("temp_min")).alias("low"), c_to_f(F.col("temp_max")).alias("high"))


def _total_and(rows: DataFrame, period: Column, *aggregates: Column) -> DataFrame:
    """Aggregates per device over everything (period "total") and per period, by one pass of grouping sets."""
    rows = rows.withColumn("period", period)
    sets = rows.groupingSets([["device_id"], ["device_id", "period"]], "device_id", "period")
    return sets.agg(*aggregates).withColumn("period", F.coalesce("period", F.lit("total")))


def degree_days(day: DataFrame, heating: float = 65.0, cooling: float = 65.0, growing: float = 50.0, cap: float = 86.0) -> DataFrame:
    """Heating, cooling and growing degree days of each device: in total and per month. A cap of 0 or less is none."""
    for what, value in {"heating base": heating, "cooling base": cooling, "growing base": growing, "growing cap": cap}.items():
        _temperature(value, what)
    if 0 < cap < growing:
        raise ValueError("the growing cap lies below the growing base")
    mean = (F.col("high") + F.col("low")) / 2
    warm = F.least(F.col("high"), F.lit(cap)) if cap > 0 else F.col("high")
    grown = (warm + F.greatest(F.col("low"), F.lit(growing))) / 2 - growing
    none = F.lit(0.0)
    return _total_and(
        _extremes(day),
        F.date_format("day", "yyyy-MM"),
        F.sum(F.greatest(heating - mean, none)).alias("hdd"),
        F.sum(F.greatest(mean - cooling, none)).alias("cdd"),
        F.sum(F.greatest(grown, none)).alias("gdd"),
        F.count("*").alias("days_used"),
    )


def climate_indices(day: DataFrame, frost: float = 0, ice: float = 0, summer: float = 0, hot: float = 0, tropical: float = 0) -> DataFrame:
    """Counts of frost, ice, summer, hot and tropical days of each device: in total and per year."""
    at = {k: _threshold(v, INDEX_THRESHOLDS[k]) for k, v in {"frost": frost, "ice": ice, "summer": summer, "hot": hot, "tropical": tropical}.items()}
    return _total_and(
        _extremes(day),
        F.date_format("day", "yyyy"),
        F.count_if(F.col("low") < at["frost"]).alias("frost_days"),
        F.count_if(F.col("high") < at["ice"]).alias("ice_days"),
        F.count_if(F.col("high") >= at["summer"]).alias("summer_days"),
        F.count_if(F.col("high") >= at["hot"]).alias("hot_days"),
        F.count_if(F.col("low") >= at["tropical"]).alias("tropical_nights"),
        F.count("*").alias("days_used"),
    )


def temperature_spells(day: DataFrame, heat: float = 0, cold: float = 0) -> DataFrame:
    """Longest heat wave and cold snap of each device, independent of each other, and its days observed."""
    rows = day.select("device_id", "day", c_to_f(F.col("temp_min")).alias("low"), c_to_f(F.col("temp_max")).alias("high"))
    found = rows.groupBy("device_id").agg(F.count("*").alias("days_observed"))
    found = with_spell(found, spells(rows, F.col("high") >= _threshold(heat, SPELL_THRESHOLDS["heat"]), "heat_wave"), "heat_wave")
    return with_spell(found, spells(rows, F.col("low") <= _threshold(cold, SPELL_THRESHOLDS["cold"]), "cold_snap"), "cold_snap")


def month_anomalies(months: DataFrame, normals: DataFrame | None = None) -> DataFrame:
    """Every month with a mean temperature against its calendar month's normal."""
    normals = monthly_normals(months) if normals is None else normals
    rows = months.where(F.col("temp_avg_f").isNotNull()).select("device_id", "period", "temp_avg_f", F.substring("period", 6, 2).cast("int").alias("month"))
    joined = rows.join(normals.select("device_id", "month", F.col("temp_avg_f").alias("normal_f")), ["device_id", "month"])
    return joined.withColumn("anomaly_f", F.col("temp_avg_f") - F.col("normal_f"))


def temperature_trend(months: DataFrame) -> DataFrame:
    """Least-squares slope per decade with an intercept for each calendar month, every month weighing the same.

    Years and temperatures count from their calendar month's first sample, so constant months give exactly zero. Without a
    calendar month in two years there is no slope; without variance in temperature there is no R squared.
    """
    rows = months.where(F.col("temp_avg_f").isNotNull()).select(
        "device_id", "period", F.col("temp_avg_f").alias("t"), F.substring("period", 1, 4).cast("int").alias("year"), F.substring("period", 6, 2).cast("int").alias("month")
    )
    first = rows.groupBy("device_id", "month").agg(F.min(F.struct("year", "t")).alias("first"))
    offsets = rows.join(first, ["device_id", "month"]).withColumn("x", F.col("year") - F.col("first.year")).withColumn("y", F.col("t") - F.col("first.t"))
    # Sums of squares about each group's mean, from sums of small offsets.
    groups = offsets.groupBy("device_id", "month").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.max(F.abs("y")).alias("moved"),
    )
    centred = groups.select(
        "device_id",
        (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")).alias("xx"),
        F.when(F.col("moved") > 0, F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")).otherwise(0.0).alias("xy"),
        F.when((F.col("moved") > 0) & (F.col("n") > 1), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")).otherwise(0.0).alias("yy"),
    )
    fit = centred.groupBy("device_id").agg(F.sum("xx").alias("xx"), F.sum("xy").alias("xy"), F.sum("yy").alias("yy"))
    number = F.col("year") * 12 + F.col("month")
    anomalies = month_anomalies(months).withColumn("year", F.substring("period", 1, 4).cast("int"))
    seen = anomalies.groupBy("device_id").agg(
        F.count_distinct("year").alias("years"), F.count("*").alias("months_used"), F.min("period").alias("first_month"), F.max("period").alias("last_month"),
        arg_most(F.col("anomaly_f"), number).alias("warm"), arg_least(F.col("anomaly_f"), number).alias("cold"),
    )
    as_month = lambda k: F.format_string("%04d-%02d", F.floor((k - 1) / 12).cast("int"), F.pmod(k - 1, F.lit(12)) + 1)
    slope = F.when(F.col("xx") > 0, F.col("xy") / F.col("xx") * 10)
    r2 = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("xy") * F.col("xy"), F.col("xx") * F.col("yy")))))
    return seen.join(fit, "device_id").select(
        "device_id", "years", "months_used", "first_month", "last_month", slope.alias("slope_per_decade_f"), r2.alias("r_squared"),
        F.col("warm.v").alias("warmest_anomaly_f"), as_month(-F.col("warm.k")).alias("warmest_month"),
        F.col("cold.v").alias("coldest_anomaly_f"), as_month(F.col("cold.k")).alias("coldest_month"),
    )
