"""Streams over landed observation files: resumable ingest, windows, sessions, gaps, silent sensors, newest rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stationspark.functions.calendar import day_end, day_start, local_day
from stationspark.operators.asof import GAP_S
from stationspark.operators.rollup import QUARTER_S, days_of, merged_quarters, quarter_aggregates, quarter_rollup, with_zone
from stationspark.operators.sensors import CONTINUOUS, STALE_S
from stationspark.operators.series import bucket_aggregates
from stationspark.schema import OBS, align_schema, month_of
from stationspark.sources.archive import MOST_NAMED, read_spans, write_obs
from stationspark.sources.ingest import RESPONSE, append_observations, observation_rows
from stationspark.sources.shared import written

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_observations(spark: SparkSession, path: str, files_per_trigger: int = 1000, arrival: bool = False) -> DataFrame:
    """Valid rows of landed response files as they come; the checkpoint is the cursor, so a restart goes on where it stopped.

    With ``arrival`` rows have a column of that name: the file's time and name, the place of its part, and the row's place in its response.
    """
    raw = spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    if arrival:
        file = [F.col(f"_metadata.{c}") for c in ("file_modification_time", "file_path", "file_block_start")]
        raw = raw.select("*", F.struct(*file).alias("arrival"))
    rows = observation_rows(raw, ranges=True).where("bad is null")
    if not arrival:
        return timed(align_schema(rows))
    return timed(rows.select(*[F.col(f.name).cast(f.dataType) for f in OBS], "arrival"))


def timed(obs: DataFrame) -> DataFrame:
    return obs.withColumn("ts", F.timestamp_seconds("epoch"))


def stream_dedupe(obs: DataFrame, late: str = "1 day") -> DataFrame:
    """Replayed rows once, within the watermark."""
    return obs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["device_id", "epoch"])


def stream_quarter_rollup(obs: DataFrame, late: str = "1 hour") -> DataFrame:
    """The batch rollup's partials of each quarter hour, emitted once its quarter is closed; ``day_rollup`` takes them as they are."""
    found = obs.withWatermark("ts", late).groupBy(F.window("ts", f"{QUARTER_S} seconds"), "device_id").agg(*quarter_aggregates())
    rest = [c for c in found.columns if c not in ("window", "device_id")]
    return found.select("device_id", F.expr(f"unix_seconds(window.start) div {QUARTER_S}").alias("bucket"), *rest)


def store_partials(obs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Partials of each micro-batch's rows as a table of their own parts, however late the rows are; available rows, then it ends.

    Partials merge, so a late row is a part more of its quarter hour and nothing stored is read or written again. A batch that
    is done once more replaces its own part. Rows must come once: ``stream_dedupe`` or ``append_observations`` goes before.
    """

    def batch(df: DataFrame, number: int) -> None:
        parts = quarter_rollup(df).withColumn("part", F.lit(number).cast("long"))
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return obs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def stored_quarters(spark: SparkSession, path: str) -> DataFrame:
    """The quarter hours that ``store_partials`` has left, parts merged: what the batch rollup gives over all rows so far."""
    return merged_quarters(spark.read.parquet(path).drop("part"))


def stream_series(obs: DataFrame, bucket_s: int, late: str = "1 hour") -> DataFrame:
    """Fixed buckets aligned to the epoch, as the batch series has them."""
    window = F.window("ts", f"{bucket_s} seconds")
    found = obs.withWatermark("ts", late).groupBy(window, "device_id").agg(*bucket_aggregates())
    return found.withColumn("bucket_epoch", F.unix_seconds("window.start")).drop("window")


def stream_sessions(obs: DataFrame, gap_s: int = GAP_S, late: str = "1 hour") -> DataFrame:
    """Runs of observations without a gap of ``gap_s`` seconds or more.

    Spark's session window still takes in a row at its very end, so it ends a microsecond before a gap of ``gap_s``.
    """
    found = obs.withWatermark("ts", late).groupBy(F.session_window("ts", f"{gap_s * 1_000_000 - 1} microseconds"), "device_id")
    return found.agg(F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.count("*").alias("obs")).drop("session_window")


def stream_conditions(obs: DataFrame) -> DataFrame:
    """The newest row of each device (update mode)."""
    rest = [c for c in obs.columns if c not in ("device_id", "ts")]
    return obs.groupBy("device_id").agg(F.max_by(F.struct(*rest), "epoch").alias("row")).select("device_id", "row.*")


class _Gaps(StatefulProcessor):
    """Keeps a device's newest epoch; a row that comes later than the limit after it is a gap."""

    def __init__(self, min_seconds: int):
        self.min_seconds = min_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "epoch long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        epochs = sorted(e for pdf in rows for e in pdf["epoch"].tolist())
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for e in epochs:
            if last is not None and e - last > self.min_seconds:
                out.append((key[0], last, e, e - last))
            last = e if last is None else max(last, e)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["device_id", "start_epoch", "end_epoch", "seconds"]).astype("int64")

    def close(self) -> None:
        pass


def stream_gaps(obs: DataFrame, min_seconds: int = GAP_S) -> DataFrame:
    """A gap as soon as the row after it comes. The state is one number per device (RocksDB store)."""
    rows = obs.select("device_id", "epoch").groupBy("device_id")
    return rows.transformWithStateInPandas(_Gaps(min_seconds), "device_id long, start_epoch long, end_epoch long, seconds long", "Append", "None")


class _Silent(StatefulProcessor):
    """Keeps each sensor's newest epoch; tells once when a sensor falls over the limit behind its device's newest row, or behind
    the watermark, which other devices move on, so a device that stops is told without a later row of its own."""

    def __init__(self, stale_s: int):
        self.stale_s = stale_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "sensor string", "epoch long, told boolean")

    def _told(self, device: int, seen: dict[str, tuple[int, bool]], now: int) -> pd.DataFrame:
        """What is silent at ``now``; the timer is set to when the next sensor would be."""
        out, newest = [], seen[""][0]
        for s, (epoch, told) in seen.items():
            if s and not told and epoch < now - self.stale_s:
                out.append((device, s, epoch, newest))
                seen[s] = (epoch, True)
        for s, value in seen.items():
            self.seen.updateValue((s,), value)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        left = [epoch for s, (epoch, told) in seen.items() if s and not told]
        if left:
            self.handle.registerTimer((min(left) + self.stale_s + 1) * 1000)
        return pd.DataFrame(out, columns=["device_id", "sensor", "last_epoch", "newest_epoch"])

    def _state(self) -> dict[str, tuple[int, bool]]:
        return {k[0]: (v[0], v[1]) for k, v in self.seen.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self._state()
        newest = seen.get("", (0, False))[0]
        for pdf in rows:
            newest = max(newest, int(pdf["epoch"].max()))
            for s in CONTINUOUS:
                there = pdf.loc[pdf[s].notna(), "epoch"]
                if len(there) and int(there.max()) > seen.get(s, (0, False))[0]:
                    seen[s] = (int(there.max()), False)
        seen[""] = (newest, False)
        yield self._told(key[0], seen, newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = self._state()
        yield self._told(key[0], seen, max(seen[""][0], expiredTimerInfo.getExpiryTimeInMs() // 1000))

    def close(self) -> None:
        pass


def stream_stale_sensors(obs: DataFrame, stale_s: int = STALE_S, late: str = "10 minutes") -> DataFrame:
    """Sensors that fell silent: behind their device's newest row, or, with the whole device, behind the watermark.

    The watermark stays ``late`` behind the newest row of all devices. A sensor that never reported is not stale; one that
    reports again can be told again.
    """
    rows = obs.select("device_id", "epoch", "ts", *CONTINUOUS).withWatermark("ts", late).groupBy("device_id")
    return rows.transformWithStateInPandas(_Silent(stale_s), "device_id long, sensor string, last_epoch long, newest_epoch long", "Append", "EventTime")


#: Buckets of devices that a day of rollups has.
ROLLUP_BUCKETS = 16
#: Spans of epochs that a scan is given at most; more are joined across their narrowest gaps.
MOST_SPANS = 32


def touched_days(rows: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """The change set of some rows: device_id, local day (of the quarter hour's start), and the epochs whose rows make up that day."""
    start = F.col("epoch") - F.col("epoch") % QUARTER_S
    days = with_zone(rows.select("device_id", "epoch"), devices).select("device_id", local_day(start, F.col("tz")).alias("day"), "tz").distinct()
    up = lambda e: F.ceil(e / QUARTER_S) * QUARTER_S
    low, high = up(day_start(F.col("day"), F.col("tz"))), up(day_end(F.col("day"), F.col("tz"))) - 1
    return days.select("device_id", "day", low.alias("low"), high.alias("high"))


def reread(spark: SparkSession, archive: str, touched: DataFrame) -> DataFrame:
    """The archive's rows of the change set's days and devices: spans of days and, if few, devices are given to the scan.

    The driver gets one row a day that was touched, and at most MOST_NAMED + 1 devices.
    """
    spans: list[list[int]] = []
    for r in touched.groupBy("day").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("low").collect():
        if spans and r["low"] <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], r["high"])
        else:
            spans.append([r["low"], r["high"]])
    while len(spans) > MOST_SPANS:
        k = min(range(len(spans) - 1), key=lambda k: spans[k + 1][0] - spans[k][1])
        spans[k : k + 2] = [[spans[k][0], max(spans[k][1], spans[k + 1][1])]]
    named = [r[0] for r in touched.select("device_id").distinct().limit(MOST_NAMED + 1).collect()]
    return read_spans(spark, archive, [tuple(s) for s in spans], named if len(named) <= MOST_NAMED else None)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # it does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def refresh_days(spark: SparkSession, archive: str, rollups: str, touched: DataFrame, devices: DataFrame | None = None) -> None:
    """Day rollups made anew for a change set, and for nothing else.

    The table is partitioned by day and bucket of devices. Of a partition that is touched the rows of other devices and days
    are kept as they stand; the touched ones come from the archive's rows of those days alone.
    """
    touched = written(touched, "touched-days")
    keys = touched.select("device_id", "day")
    bucket = F.pmod(F.hash("device_id"), F.lit(ROLLUP_BUCKETS)).alias("device_bucket")
    days = days_of(reread(spark, archive, touched), devices).join(keys, ["device_id", "day"], "left_semi").select("*", bucket)
    old = _stored(spark, rollups)
    if old is not None:
        places = keys.select("day", bucket).distinct()
        kept = old.join(places, ["day", "device_bucket"], "left_semi").join(keys, ["device_id", "day"], "left_anti")
        days = days.unionByName(kept.select(*days.columns))
    days = written(days, "refreshed-days")  # whole before a partition of the table is replaced
    days.repartition("day", "device_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "device_bucket").parquet(rollups)


def sync_archive(spark: SparkSession, landed: str, archive: str, rollups: str, checkpoint: str, devices: DataFrame | None = None, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """One bounded catch-up: new files are appended with the row of a key that arrived first winning, and only touched days are rolled up anew.

    However late a row comes, it is stored and its device's day is recomputed; nothing is dropped for being late. A batch reads
    the keys of its months, and of the archive's rows those of the touched devices' touched days. Day rollups are a table
    partitioned by day and bucket of devices, overwritten by partition.
    """

    def batch(df: DataFrame, number: int) -> None:
        # Within a part of a file rows are numbered as they stand in it, before anything moves them.
        rows = df.drop("ts").withColumn("line", F.monotonically_increasing_id()).withColumn("obs_month", month_of(F.col("epoch"))).persist()
        months = sorted(r[0] for r in rows.select("obs_month").distinct().collect())  # a few numbers
        if months:
            there = _stored(spark, archive)
            known = None if there is None else there.where(F.col("obs_month").isin(months))
            new = append_observations(known, rows, [*[f"arrival.file_{c}" for c in ("modification_time", "path", "block_start")], "line"])
            write_obs(written(new.drop("arrival", "line"), "new-rows"), archive)
            # Of all the batch's rows, also those that a run before this one has stored without getting to their days.
            refresh_days(spark, archive, rollups, touched_days(rows, devices), devices)
        rows.unpersist()
        if then:
            then(df)

    source = stream_observations(spark, landed, arrival=True)
    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
