"""Longest runs of consecutive calendar days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spells(day: DataFrame, predicate: Column, name: str) -> DataFrame:
    """Per device the longest run of consecutive days for which ``predicate`` is true: {name}_days, _start, _end.

    A day that is missing, or for which the predicate is null, breaks a run; the earliest of equally long runs wins. Devices
    without such a day are absent. Works on day rows, of which a device has at most 366 a year.
    """
    good = day.where(predicate).select("device_id", "day")
    order = Window.partitionBy("device_id").orderBy("day")
    runs = good.withColumn("island", F.date_sub("day", F.row_number().over(order)))
    runs = runs.groupBy("device_id", "island").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))
    best = runs.groupBy("device_id").agg(F.max(F.struct("n", (-F.unix_date("first")).alias("k"), "first", "last")).alias("run"))
    return best.select("device_id", F.col("run.n").alias(f"{name}_days"), F.col("run.first").alias(f"{name}_start"), F.col("run.last").alias(f"{name}_end"))


def with_spell(stats: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``stats`` plus a spell; devices without one have 0 days and null dates."""
    return stats.join(found, "device_id", "left").withColumn(f"{name}_days", F.coalesce(f"{name}_days", F.lit(0).cast("long")))
