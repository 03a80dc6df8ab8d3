"""The Parquet archive of observations, its scans and its exports."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stationspark.functions.calendar import local_timestamp, within
from stationspark.functions.units import c_to_f, km_to_mile, mb_to_inhg, mm_to_inch, mps_to_mph
from stationspark.operators.rollup import with_zone
from stationspark.schema import LAST_EPOCH, OBS, PRESENTED, align_schema, month_of

from .ingest import append_observations, reasons
from .shared import written

MOST_SOURCE_BYTES = 1024


#: Rows of a Parquet page at most: about a day of minutes, so that a scan skips the other days of a device.
PAGE_ROWS = 1440
#: Where an archive's zone map lies in its folder; scans of the archive do not see it.
ZONES = "_zones"
#: Devices that a scan names to the reader at most.
MOST_NAMED = 1000


def _dealt(obs: DataFrame) -> DataFrame:
    rows = align_schema(obs).withColumn("obs_month", month_of(F.col("epoch")))
    return rows.repartition("obs_month", "device_id").sortWithinPartitions("device_id", "epoch")


def write_obs(obs: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the archive, partitioned by UTC month; rows of a month are dealt by device so files stay few and sorted.

    The zone map is written as well: a row for each device and month with its least and greatest epoch. It is written first,
    so it never lacks what is stored; a write that fails behind it only leaves it too wide until it is done again.
    """
    rows = align_schema(obs).withColumn("obs_month", month_of(F.col("epoch")))
    zones = rows.groupBy("device_id", "obs_month").agg(F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))
    if mode == "overwrite":  # the folder goes with its zone map
        _dealt(obs).write.mode(mode).option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("obs_month").parquet(path)
        zones.write.mode(mode).parquet(f"{path}/{ZONES}")
        return
    zones.write.mode(mode).parquet(f"{path}/{ZONES}")
    _dealt(obs).write.mode(mode).option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("obs_month").parquet(path)


def zone_map(spark: SparkSession, path: str) -> DataFrame:
    """device_id, obs_month, first_epoch, last_epoch of an archive: what all its writes have told, merged."""
    told = spark.read.parquet(f"{path}/{ZONES}")
    return told.groupBy("device_id", "obs_month").agg(F.min("first_epoch").alias("first_epoch"), F.max("last_epoch").alias("last_epoch"))


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """The whole archive with obs_month, by which joins with a zone map or with ranges skip months."""
    stored = spark.read.parquet(path)
    there = set(stored.columns)
    return stored.select(*[(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in OBS], "obs_month")


def read_obs(spark: SparkSession, path: str, start_epoch: int | None = None, end_epoch: int | None = None, devices: list[int] | None = None) -> DataFrame:
    """A range of the archive: months are pruned as partitions, epochs and devices are pushed to the scan."""
    df = within(spark.read.parquet(path), start_epoch, end_epoch)
    if start_epoch is not None:
        df = df.where(F.col("obs_month") >= month_of(F.lit(start_epoch)))
    if end_epoch is not None:
        df = df.where(F.col("obs_month") <= month_of(F.lit(end_epoch)))
    if devices is not None:
        df = df.where(F.col("device_id").isin(devices))
    return align_schema(df)


def read_spans(spark: SparkSession, path: str, spans: list[tuple[int, int]], devices: list[int] | None = None) -> DataFrame:
    """Rows of the archive in any of some inclusive spans of epochs: their months are pruned, spans and devices pushed to the scan."""
    any_of = lambda conditions: reduce(or_, conditions, F.lit(False))
    months = any_of([F.col("obs_month").between(month_of(F.lit(a)), month_of(F.lit(b))) for a, b in spans])
    rows = spark.read.parquet(path).where(months & any_of([F.col("epoch").between(a, b) for a, b in spans]))
    if devices is not None:
        rows = rows.where(F.col("device_id").isin(devices))
    return align_schema(rows)


def ingest_observations(raw: DataFrame, path: str, start_epoch: int | None = None, end_epoch: int | None = None) -> dict[str, int]:
    """Check raw rows and store them as a batch's own table in one pass, all or none: a bad row, or one outside the window, fails it.

    The checks stand in the write's own plan, so the input is read once, and what a failed write has begun is taken back by
    the committer: nothing can be read of it. Doing it again replaces the table. Returns what the pass has observed: rows and
    their least and greatest epoch (null if there are none). From there ``append_observations`` and ``write_obs`` go on.
    """
    problems = reasons(raw)
    if start_epoch is not None or end_epoch is not None:
        low, high = start_epoch or 0, LAST_EPOCH if end_epoch is None else end_epoch
        problems = F.array_compact(F.array_append(problems, F.when(~F.col("epoch").between(low, high), "outside the window")))
    said = F.concat(F.lit("observations of device "), F.coalesce(F.col("device_id").cast("string"), F.lit("null")), F.lit(" are not valid: "), F.array_join(problems, ", "))
    checked = raw.withColumn("device_id", F.when(F.size(problems) > 0, F.raise_error(said).cast("long")).otherwise(F.col("device_id").cast("long")))
    seen = Observation()
    rows = align_schema(checked).observe(seen, F.count("*").alias("rows"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))
    rows.write.mode("overwrite").parquet(path)
    return seen.get


# -- an archive as a bucketed table ---------------------------------------------------------------------------------------

DEVICE_BUCKETS = 64


def write_bucketed(obs: DataFrame, name: str, path: str, buckets: int = DEVICE_BUCKETS, mode: str = "append") -> None:
    """Write to a table at ``path`` partitioned by UTC month and bucketed by device, sorted by device and time.

    Rollups by device and joins on (device, time) read it as it is dealt, without a shuffle of the stored side.
    """
    rows = align_schema(obs).withColumn("obs_month", month_of(F.col("epoch")))
    rows = rows.repartition(F.col("obs_month"), F.pmod(F.hash("device_id"), F.lit(buckets)))  # one file for each month and bucket
    rows.write.mode(mode).option("path", path).partitionBy("obs_month").bucketBy(buckets, "device_id").sortBy("device_id", "epoch").saveAsTable(name)


def open_bucketed(spark: SparkSession, name: str, path: str, buckets: int = DEVICE_BUCKETS) -> DataFrame:
    """The table that ``write_bucketed`` has left at ``path``, also in a session that does not know it yet."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OBS)
        place = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}, obs_month int) USING parquet PARTITIONED BY (obs_month) CLUSTERED BY (device_id) SORTED BY (device_id, epoch) INTO {buckets} BUCKETS LOCATION '{place}'")
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


@contextmanager
def joins_by_bucket(spark: SparkSession) -> Iterator[None]:
    """While it lasts, joins on (device, time) may use that a side is dealt by device alone."""
    key, before = "spark.sql.requireAllClusterKeysForCoPartition", None
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def append_bucketed(spark: SparkSession, name: str, path: str, batch: DataFrame, order: list[str], buckets: int = DEVICE_BUCKETS) -> int:
    """Store what is new of ``batch`` (first row of a key by ``order`` wins, stored rows first of all) and say how many rows that is.

    The batch is dealt by device to meet the stored rows where they lie; of those only the batch's months are read.
    """
    rows = batch.withColumn("obs_month", month_of(F.col("epoch")))
    months = [r[0] for r in rows.select("obs_month").distinct().collect()]  # a few numbers, and null for rows without a time
    there = F.col("obs_month").isin([m for m in months if m is not None])
    stored = open_bucketed(spark, name, path, buckets).where(there | F.col("obs_month").isNull() if None in months else there)
    seen = Observation()
    with joins_by_bucket(spark):
        new = written(align_schema(append_observations(stored, batch, order)).observe(seen, F.count("*").alias("rows")), "new-rows")
    write_bucketed(new, name, path, buckets)
    return seen.get["rows"]


def archive_observations(obs: DataFrame, start_epoch: int, end_epoch: int) -> DataFrame:
    """A range with all metadata; a source of over 1024 bytes is an error when its row is read."""
    rows = within(align_schema(obs), start_epoch, end_epoch)
    too_long = F.octet_length("source") > MOST_SOURCE_BYTES
    return rows.withColumn("source", F.when(too_long, F.raise_error(F.lit("a source exceeds 1024 bytes")).cast("string")).otherwise(F.col("source")))


# Exported US columns as (sensor, exported name, conversion).
_US = [
    ("wind_lull", "wind_lull_mph", mps_to_mph), ("wind_avg", "wind_avg_mph", mps_to_mph), ("wind_gust", "wind_gust_mph", mps_to_mph),
    ("wind_dir", "wind_dir", None), ("pressure_mb", "pressure_inhg", mb_to_inhg), ("air_temp_c", "air_temp_f", c_to_f),
    ("humidity", "humidity", None), ("illuminance_lux", "illuminance_lux", None), ("uv", "uv", None), ("solar_wm2", "solar_wm2", None),
    ("rain_mm", "rain_in", mm_to_inch), ("strike_dist_km", "strike_dist_mi", km_to_mile), ("strike_count", "strike_count", None),
    ("battery_v", "battery_v", None),
]


def export_frame(obs: DataFrame, units: str = "si", metadata: bool = False, devices: DataFrame | None = None) -> DataFrame:
    """epoch, local time, sensors in stable order, on request metadata. US values are converted and rounded to four places.

    Metadata are as stored. The time is RFC 3339 with the device's zone offset.
    """
    rows = with_zone(align_schema(obs), devices)
    local = local_timestamp(F.col("epoch"), F.col("tz"))
    shift = F.unix_seconds(local) - F.col("epoch")
    ahead = F.abs(shift)
    offset = F.when(shift == 0, "Z").otherwise(F.format_string("%s%02d:%02d", F.when(shift < 0, "-").otherwise("+"), F.floor(ahead / 3600), F.floor(ahead % 3600 / 60)))
    time = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset).alias("time")
    if units == "us":
        sensors = [F.round(how(F.col(c)) if how else F.col(c), 4).alias(name) for c, name, how in _US]
    else:
        sensors = [F.col(c) for c in PRESENTED]
    more = ["device_id", "report_interval_min", F.col("wind_interval").alias("wind_interval_s"), "precip_type", "source"] if metadata else []
    return rows.select("epoch", time, *sensors, *more)


def write_csv(frame: DataFrame, path: str) -> None:
    """Header and rows; null is an empty cell."""
    frame.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def write_jsonl(frame: DataFrame, path: str) -> None:
    """One object per line; null keys are left out."""
    frame.write.mode("overwrite").option("ignoreNullFields", True).json(path)
