"""Local calendar fields, and ranges of local days as epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest range that is answered: a hundred leap years.
LONGEST_S = 100 * 366 * 86_400


def local_timestamp(epoch: Column, tz: Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(epoch), tz)


def local_day(epoch: Column, tz: Column) -> Column:
    return F.to_date(local_timestamp(epoch, tz))


def local_hour(epoch: Column, tz: Column) -> Column:
    return F.hour(local_timestamp(epoch, tz))


def day_start(day: Column, tz: Column) -> Column:
    """The epoch at which a local day begins; days of 23 and 25 hours come out right."""
    return F.unix_seconds(F.to_utc_timestamp(day.cast("timestamp"), tz))


def day_end(day: Column, tz: Column) -> Column:
    return day_start(F.date_add(day, 1), tz) - 1


def resolve_range(devices: DataFrame, start: str | None, end: str | None, as_of_epoch: int, default_days: int = 7) -> DataFrame:
    """``devices`` (with tz) plus inclusive start_epoch and end_epoch of local dates.

    Without an end it is the local day of ``as_of_epoch``; without a start it is ``default_days`` days up to today. An end by
    itself that lies before that start asks for the one day. A start after the end is an error.
    """
    if start and end and start > end:
        raise ValueError(f"start {start} is after end {end}")
    tz = F.col("tz")
    today = local_day(F.lit(as_of_epoch), tz)
    last = F.to_date(F.lit(end)) if end else today
    usual = F.date_sub(today, default_days - 1)
    first = F.to_date(F.lit(start)) if start else F.least(usual, last)
    return devices.withColumn("start_epoch", day_start(first, tz)).withColumn("end_epoch", day_end(last, tz))


def resolve_days(devices: DataFrame, days: int, end: str | None, as_of_epoch: int) -> DataFrame:
    """``days`` whole local days (1 to 366; 0: a week) that end with ``end`` or the local day of ``as_of_epoch``."""
    if not 0 <= days <= 366:
        raise ValueError("days must lie between 0 and 366")
    tz = F.col("tz")
    last = F.to_date(F.lit(end)) if end else local_day(F.lit(as_of_epoch), tz)
    first = F.date_sub(last, (days or 7) - 1)
    return devices.withColumn("start_epoch", day_start(first, tz)).withColumn("end_epoch", day_end(last, tz))


#: Bounds that are sent to all tasks at most (32 bytes each); more are joined by shuffling both sides.
MOST_BOUNDS = 1 << 18


def within_ranges(obs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of ``obs`` in their own device's range; ``bounds`` has device_id, start_epoch and end_epoch, as the functions above give.

    A range join by months: a bound stands once for each UTC month that it touches, and meets the rows of its device and month.
    Where ``obs`` has obs_month, as an archive does, months that no bound touches are not read (they are pruned when the bounds
    are known). Bounds are counted before they are broadcast. Several ranges of a device must not overlap, else rows repeat.
    """
    month = lambda e: F.year(F.timestamp_seconds(e)) * 100 + F.month(F.timestamp_seconds(e))
    first = lambda e: F.trunc(F.to_date(F.timestamp_seconds(e)), "month")
    months = F.explode(F.sequence(first(F.col("start_epoch")), first(F.col("end_epoch")), F.expr("interval 1 month")))
    ranges = bounds.where("end_epoch >= start_epoch").select("device_id", "start_epoch", "end_epoch", months.alias("__month"))
    ranges = ranges.select("device_id", "start_epoch", "end_epoch", (F.year("__month") * 100 + F.month("__month")).alias("obs_month"))
    if ranges.limit(MOST_BOUNDS + 1).count() <= MOST_BOUNDS:
        ranges = F.broadcast(ranges)
    rows = obs if "obs_month" in obs.columns else obs.withColumn("obs_month", month(F.col("epoch")))
    met = rows.join(ranges, ["device_id", "obs_month"]).where(F.col("epoch").between(F.col("start_epoch"), F.col("end_epoch")))
    return met.select(*[c for c in obs.columns])


def within(obs: DataFrame, start_epoch: int | None, end_epoch: int | None) -> DataFrame:
    """Rows of an inclusive range, checked as the engine's ranges are: not negative, ordered, at most a century."""
    if start_epoch is None and end_epoch is None:
        return obs
    low, high = start_epoch or 0, LAST if end_epoch is None else end_epoch
    if low < 0 or high < low or end_epoch is not None and high - low > LONGEST_S:
        raise ValueError(f"bad range {low}..{high}")
    return obs.where(F.col("epoch").between(low, high))


LAST = 253_402_300_799
