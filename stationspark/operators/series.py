"""Downsampled series in epoch-aligned buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_POINTS = 2000
LEAST_POINTS = 24
MINUTE_S = 60


def bucket_aggregates() -> list[Column]:
    """Totals are 0 where nothing was read; the counts beside them tell that from a measured zero."""
    return [
        F.avg("air_temp_c").alias("temp_c"), F.min("air_temp_c").alias("temp_min_c"), F.max("air_temp_c").alias("temp_max_c"),
        F.avg("humidity").alias("humidity"), F.avg("pressure_mb").alias("pressure_mb"), F.avg("wind_avg").alias("wind_avg"),
        F.max("wind_gust").alias("gust_max"), F.coalesce(F.sum("rain_mm"), F.lit(0.0)).alias("rain_mm"), F.max("uv").alias("uv_max"),
        F.avg("solar_wm2").alias("solar_wm2"), F.coalesce(F.sum("strike_count"), F.lit(0.0)).alias("strikes"),
        F.count("*").alias("obs"), F.count("rain_mm").alias("rain_readings"), F.count("strike_count").alias("lightning_readings"),
    ]


def series(obs: DataFrame, bucket_s: int = MINUTE_S) -> DataFrame:
    """Per device and bucket of ``bucket_s`` seconds (60 or more); buckets without rows are absent."""
    if bucket_s < MINUTE_S:
        raise ValueError("buckets must be of 60 seconds or more")
    return obs.groupBy("device_id", F.expr(f"epoch div {bucket_s} * {bucket_s}").alias("bucket_epoch")).agg(*bucket_aggregates())


def width_for(start: Column, end: Column, points: int) -> Column:
    """The smallest whole-minute width that gives at most ``points`` aligned buckets over an inclusive range.

    A width w gives end // w - start // w + 1 buckets; none over (end - start) / (points - 1) needs to be tried.
    """
    if not LEAST_POINTS <= points <= MOST_POINTS:
        raise ValueError(f"points must lie between {LEAST_POINTS} and {MOST_POINTS}")
    minutes = lambda x: F.ceil(x / MINUTE_S).cast("long")
    least = F.greatest(minutes((end - start) / points), F.lit(1).cast("long"))
    most = F.greatest(minutes((end - start) / (points - 1)), least) + 1
    widths = F.transform(F.sequence(least, most), lambda m: m * MINUTE_S)
    fits = F.filter(widths, lambda w: F.floor(end / w) - F.floor(start / w) + 1 <= points)
    return F.array_min(fits)


def series_auto(obs: DataFrame, bounds: DataFrame, max_points: int = 288, bucket_s: int | None = None) -> DataFrame:
    """``series`` with a width for each device: the finest that fits its range (``bounds``: device_id, start_epoch, end_epoch).

    An explicit width that would give over 2000 points is widened until it fits and flagged coarsened.
    """
    start, end = F.col("start_epoch"), F.col("end_epoch")
    if bucket_s is None:
        bounds = bounds.withColumn("bucket_s", width_for(start, end, max_points)).withColumn("coarsened", F.lit(False))
    else:
        widest = width_for(start, end, MOST_POINTS)
        bounds = bounds.withColumn("bucket_s", F.greatest(F.lit(bucket_s).cast("long"), widest)).withColumn("coarsened", F.col("bucket_s") > bucket_s)
    rows = obs.join(bounds, "device_id").where(F.col("epoch").between(start, end))
    rows = rows.withColumn("bucket_epoch", F.expr("epoch div bucket_s * bucket_s"))
    return rows.groupBy("device_id", "bucket_s", "coarsened", "bucket_epoch").agg(*bucket_aggregates())
