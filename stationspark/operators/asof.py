"""Coverage, gaps, newest rows and the nearest-reading pressure tendency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationspark.functions.units import mb_to_inhg
from stationspark.schema import month_of

GAP_S, MOST_GAPS = 3600, 1000
TENDENCY_S, LONGEST_TENDENCY_S = 3 * 3600, 24 * 3600


def coverage(obs: DataFrame) -> DataFrame:
    return obs.groupBy("device_id").agg(F.count("*").alias("obs"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))


def device_ids(obs: DataFrame) -> DataFrame:
    return obs.select("device_id").distinct()


def watermark(obs: DataFrame) -> DataFrame:
    return obs.groupBy("device_id").agg(F.max("epoch").alias("watermark"))


def latest(obs: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """The newest row of each device, by two hash aggregates: its time first, then what the row of that time holds.

    With ``zones`` (an archive's zone map; ``obs`` then has obs_month) only each device's last month is looked at. Rows of one
    device and time, which an archive does not have, count as one, by the greatest value of each column.
    """
    rest = [c for c in obs.columns if c not in ("device_id", "epoch", "obs_month")]
    rows = obs if zones is None else recent(obs, zones, 1)
    newest = rows.groupBy("device_id").agg(F.max("epoch").alias("epoch"))
    doubles = [f.name for f in obs.schema if f.name in rest and f.dataType.typeName() in ("double", "long", "integer")]
    found = rows.join(newest, ["device_id", "epoch"], "left_semi")
    values = found.groupBy("device_id", "epoch").agg(*[F.max(c).alias(c) for c in doubles])
    texts = [c for c in rest if c not in doubles]
    if texts:  # not of a fixed width, so they are aggregated by themselves, over one row a device
        values = values.join(found.groupBy("device_id", "epoch").agg(*[F.max(c).alias(c) for c in texts]), ["device_id", "epoch"])
    return values.select("device_id", "epoch", *rest)


def recent(obs: DataFrame, zones: DataFrame, months: int) -> DataFrame:
    """Rows of each device's last ``months`` stored months; the scan reads no other month's files."""
    place = F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("obs_month")))
    kept = zones.groupBy("device_id", "obs_month").agg(F.max("last_epoch").alias("last_epoch")).withColumn("__place", place).where(F.col("__place") <= months)
    return obs.join(kept.select("device_id", "obs_month"), ["device_id", "obs_month"], "left_semi")


def all_gaps(obs: DataFrame, min_seconds: int = GAP_S) -> DataFrame:
    """Every pair of neighbouring rows of a device over ``min_seconds`` apart: start_epoch, end_epoch, seconds.

    Neighbours are found within a device's month, and months are joined by their first and last rows, so no task sorts a
    device's whole history.
    """
    rows = obs.select("device_id", "epoch", month_of(F.col("epoch")).alias("month"))
    inside = rows.withColumn("before", F.lag("epoch").over(Window.partitionBy("device_id", "month").orderBy("epoch")))
    edges = rows.groupBy("device_id", "month").agg(F.min("epoch").alias("epoch"), F.max("epoch").alias("last"))
    across = edges.withColumn("before", F.lag("last").over(Window.partitionBy("device_id").orderBy("month")))
    pairs = inside.select("device_id", "before", "epoch").unionByName(across.select("device_id", "before", "epoch"))
    seconds = F.col("epoch") - F.col("before")
    return pairs.where(seconds > min_seconds).select("device_id", F.col("before").alias("start_epoch"), F.col("epoch").alias("end_epoch"), seconds.alias("seconds"))


def gaps(obs: DataFrame, min_seconds: int = GAP_S, limit: int = 10) -> DataFrame:
    """Each device's largest gaps with their rank; of equal ones the earlier first."""
    if not 1 <= limit <= MOST_GAPS:
        raise ValueError(f"limit must lie between 1 and {MOST_GAPS}")
    order = Window.partitionBy("device_id").orderBy(F.desc("seconds"), "start_epoch")
    return all_gaps(obs, min_seconds).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def tendency_words(mb_per_3h: Column) -> Column:
    found = F.when(mb_per_3h >= 2, "rising rapidly").when(mb_per_3h >= 0.5, "rising").when(mb_per_3h <= -2, "falling rapidly").when(mb_per_3h <= -0.5, "falling")
    return found.otherwise("steady")


def pressure_tendency(obs: DataFrame, window_s: int = TENDENCY_S, zones: DataFrame | None = None) -> DataFrame:
    """Change from the reading nearest to ``window_s`` before a device's newest pressure; no row where no reading qualifies.

    Readings count from half the window on (rounded up); of two equally near the older one. It is an as-of join by buckets of
    the window: a device's wanted time meets the readings of its own bucket and of those beside it, by hash join and hash
    aggregates; the nearest reading lies there, unless none does. For devices without an answer the newest older one is
    looked for among all their readings. With ``zones`` (an archive's zone map; ``obs`` then has obs_month) the first step reads
    each device's last two months; devices without a pressure there go the second way.
    """
    window_s = window_s if window_s > 0 else TENDENCY_S
    if window_s > LONGEST_TENDENCY_S:
        raise ValueError("the window exceeds 24 hours")
    least_span = max(1, (window_s + 1) // 2)
    every = obs.where(F.col("pressure_mb").isNotNull())
    near_rows = (every if zones is None else recent(every, zones, 2)).select("device_id", "epoch", "pressure_mb")
    every = every.select("device_id", "epoch", "pressure_mb")
    e = F.col("epoch")

    def newest(rows: DataFrame) -> DataFrame:
        now = rows.groupBy("device_id").agg(F.max("epoch").alias("now"), F.max_by("pressure_mb", "epoch").alias("now_mb"))
        return now.withColumn("target", F.col("now") - window_s)

    def nearest(met: DataFrame) -> DataFrame:
        before, after = e <= F.col("target"), (e > F.col("target")) & (e <= F.col("now") - least_span)
        times = [F.max(F.when(before, e)).alias("before"), F.min(F.when(after, e)).alias("after")]
        values = [F.max_by("pressure_mb", F.when(before, e)).alias("before_mb"), F.min_by("pressure_mb", F.when(after, e)).alias("after_mb")]
        found = met.groupBy("device_id", "now", "now_mb", "target").agg(*times, *values)
        nearer = F.col("before").isNull() | (F.col("after") - F.col("target") < F.col("target") - F.col("before"))
        past = lambda b, a: F.when(nearer, F.col(a)).otherwise(F.col(b))
        return found.select("device_id", "now", "now_mb", past("before", "after").alias("past"), past("before_mb", "after_mb").alias("past_mb")).where("past is not null")

    now = newest(near_rows)
    bucket = F.expr(f"epoch div {window_s}")
    places = F.explode(F.array(*[F.expr(f"target div {window_s}") + k for k in (-1, 0, 1)]))
    close = nearest(near_rows.withColumn("place", bucket).join(now.withColumn("place", places), ["device_id", "place"]))
    left = every.join(close, "device_id", "left_anti")  # devices without an answer: a few rows or none
    far = nearest(left.join(newest(left), "device_id"))
    found = close.unionByName(far)
    hours = (F.col("now") - F.col("past")) / 3600
    change = F.col("now_mb") - F.col("past_mb")
    rate = change / hours * 3
    return found.select(
        "device_id", F.col("now").alias("at_epoch"), mb_to_inhg(F.col("now_mb")).alias("current_inhg"), hours.alias("window_hours"),
        mb_to_inhg(change).alias("change_inhg"), rate.alias("change_mb_per_3h"), tendency_words(rate).alias("category"),
    )


def missing_windows(obs: DataFrame, start_epoch: int, end_epoch: int, min_seconds: int = GAP_S, max_window_s: int = 5 * 86_400, devices: DataFrame | None = None) -> DataFrame:
    """Contiguous windows of at most five days that cover what a device lacks of a range: gaps, and what lies before and after.

    Known devices (``devices``, by default all of ``obs`` at any time) are the spine: what a device's rows cover is taken from its
    whole range, so one without a row in it lacks all of it.
    """
    rows = obs.where(F.col("epoch").between(start_epoch, end_epoch))
    spine = device_ids(obs if devices is None else devices).join(coverage(rows), "device_id", "left")
    low, high = F.lit(start_epoch).cast("long"), F.lit(end_epoch).cast("long")
    first, last = F.col("first_epoch"), F.col("last_epoch")
    hole = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    outer = F.when(first.isNull(), F.array(hole(low, high))).otherwise(
        F.array_compact(F.array(F.when(first - low > min_seconds, hole(low, first - 1)), F.when(high - last > min_seconds, hole(last + 1, high))))
    )
    inner = all_gaps(rows, min_seconds).select("device_id", (F.col("start_epoch") + 1).alias("a"), (F.col("end_epoch") - 1).alias("b"))
    holes = spine.select("device_id", F.inline(outer)).unionByName(inner)
    cut = holes.withColumn("start_epoch", F.explode(F.sequence("a", "b", F.lit(max_window_s).cast("long"))))
    return cut.select("device_id", "start_epoch", F.least(F.col("start_epoch") + max_window_s - 1, "b").alias("end_epoch"))
