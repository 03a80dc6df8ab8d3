import json
import os

import pytest
from pyspark.sql import functions as F

from stationspark.functions import calendar
from stationspark.operators import asof, rollup, series
from stationspark.operators.sensors import CONTINUOUS
from stationspark.plans import adhoc
from stationspark.schema import BOUNDS, align_schema
from stationspark.sources import archive, derived, ingest
from stationspark.streaming import streams

from .helpers import ZONES, day_epoch, obs

E = 1_700_000_000


def wire(epoch, temp=20.0, rain=0.0):
    return [epoch, 0.1, 1.0, 2.0, 90, 3, 1010.0, temp, 50, 1000, 1.0, 100, rain, 0, 0, 0, 2.6, 1]


def land(path, name, *responses):
    path.mkdir(exist_ok=True)
    file = path / f"{name}.json"
    file.write_text("".join(json.dumps(r) + "\n" for r in responses))
    os.utime(file, (E + 10 * len(list(path.iterdir())),) * 2)  # files come in the order of their times


def test_wire_rows(spark, tmp_path):
    fine = {"device_id": 5, "type": "obs_st", "status": {"status_code": 0}, "obs": [wire(E), [E + 60, None, 1.0], wire(E + 120) + [1, 2, 3, 4]]}
    bad = [{"device_id": 5, "type": "obs_air", "obs": [wire(E)]}, {"device_id": 5, "type": "obs_st", "status": {"status_code": 404}, "obs": []}, {"device_id": 5, "type": "obs_st"}, {"device_id": 5, "type": "obs_st", "obs": [[], [None, 1.0], wire(E) + [1, 2, 3, 4, 5]]}, {"device_id": 5, "requested_device_id": 6, "type": "obs_st", "obs": [wire(E)]}]
    land(tmp_path / "in", "a", fine, *bad)
    rows = ingest.read_observation_responses(spark, str(tmp_path / "in"))
    good, wrong = ingest.validate_observations(rows, "quarantine")
    got = good.orderBy("epoch").collect()
    assert [r.epoch for r in got] == [E, E + 60, E + 120] and got[1].air_temp_c is None and got[1].wind_avg == 1
    assert sorted(r.bad for r in wrong.collect()) == ["device", "empty row", "no epoch", "no observations", "overlong row", "status", "type"]
    with pytest.raises(ValueError):
        ingest.validate_observations(rows, "fail")


def test_ranges(spark):
    for name, low, high, whole in BOUNDS:
        values = [low, high, None, low - 1, high + 1, float("nan")] + [0.5] * whole
        df = align_schema(spark.createDataFrame([(1, E + k, None if v is None else float(v)) for k, v in enumerate(values)], f"device_id long, epoch long, {name} double"))
        good, bad = ingest.validate_observations(df, "quarantine")
        assert sorted(r.epoch - E for r in good.collect()) == [0, 1, 2] and all(r.reason == [name] for r in bad.collect())
    with pytest.raises(ValueError):
        ingest.clip_to_window(obs(spark, [{"epoch": E}]), E + 1, E + 2)


def test_first_row_wins(spark):
    batch = spark.createDataFrame([(1, 10, 1.0, 2), (1, 10, 2.0, 1), (1, 11, 3.0, 3), (2, 10, 4.0, 4)], "device_id long, epoch long, v double, seq int")
    stored = spark.createDataFrame([(2, 10)], "device_id long, epoch long")
    new = ingest.append_observations(stored, batch, ["seq"])
    assert sorted((r.device_id, r.epoch, r.v) for r in new.collect()) == [(1, 10, 2.0), (1, 11, 3.0)]
    assert ingest.append_observations(new, batch, ["seq"]).join(stored, ["device_id", "epoch"], "left_anti").count() == 0


def test_archive_scan_and_exports(spark, tmp_path):
    rows = obs(spark, [{"epoch": day_epoch(d), "temp": k, "device": 1 + k % 2} for k, d in enumerate(["2024-01-31", "2024-02-01", "2024-02-15", "2024-03-01"])])
    path = str(tmp_path / "archive")
    archive.write_obs(rows, path)
    part = archive.read_obs(spark, path, day_epoch("2024-02-01", 0), day_epoch("2024-02-28"), devices=[1])
    assert [r.air_temp_c for r in part.collect()] == [2]
    plan = part.select("air_temp_c")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(obs_month" in plan and "GreaterThanOrEqual(epoch" in plan and "humidity" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError):
        archive.read_obs(spark, path, 10, 5)
    zones = spark.createDataFrame([(1, "Asia/Kathmandu")], ZONES)
    us = archive.export_frame(obs(spark, [{"epoch": E, "temp": 21.12345, "rain": 1}]), "us", True, zones)
    row = us.first()
    assert row.time == "2023-11-15T03:58:20+05:45" and row.air_temp_f == 70.0222 and row.rain_in == 0.0394 and us.columns[:3] == ["epoch", "time", "wind_lull_mph"]
    archive.write_csv(us, str(tmp_path / "csv"))
    archive.write_jsonl(us, str(tmp_path / "jsonl"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.splitlines()[0].startswith("epoch,time,wind_lull_mph") and ",,," in text
    (line,) = "".join(p.read_text() for p in (tmp_path / "jsonl").glob("*.json")).splitlines()
    assert "wind_gust_mph" not in json.loads(line)
    long = obs(spark, [{"epoch": E}]).withColumn("source", F.repeat(F.lit("x"), 1025))
    with pytest.raises(Exception, match="1024"):
        archive.archive_observations(long, 0, E).collect()


def test_stations_forecast_live(spark):
    stations = {"stations": [{"station_id": 1, "name": "a", "latitude": 10.0, "longitude": 20.0, "timezone": "UTC", "station_meta": {"elevation": 5.0}, "devices": [{"device_id": 1, "device_type": "HB"}, {"device_id": 2, "device_type": "ST"}]}, {"station_id": 2, "name": "b", "latitude": 99.0, "longitude": 0.0, "devices": []}]}
    read = lambda schema, *rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
    dim = ingest.flatten_stations(read(ingest.STATIONS, stations))
    assert dim.count() == 2 and ingest.pick_device(dim).first().device_id == 2
    forecast = {"station_id": 1, "timezone": "UTC", "current_conditions": {"time": E, "air_temperature": 10.0, "wind_direction": 90.0}, "forecast": {"daily": [{"day_start_local": E + k * 86_400, "air_temp_high": 20.0 + k, "air_temp_low": 1.0 - k, "precip_probability": 10.0 * k} for k in range(12)], "hourly": [{"time": E + k * 3600, "wind_gust": 1.0 * k, "precip_probability": 5.0} for k in range(300)]}}
    now, daily, hourly = ingest.flatten_forecast(read(ingest.FORECAST, forecast), hours=500)
    assert now.first().wind_from == "E" and daily.count() == 10 and hourly.count() == 240
    total = ingest.forecast_summary(daily, hourly).first()
    assert (total.day_precip_probability, total.n_hours) == (90, 240)
    rows = spark.createDataFrame([(1, 0, 5, 1.0), (1, 1, 9, 2.0), (1, 2, 9, 3.0)], "station_id long, pos int, timestamp long, v double")
    assert ingest.latest_station_observation(rows).first().v == 2
    names = ["air_temperature", "relative_humidity", "wind_avg", "wind_gust", "wind_direction", "sea_level_pressure", "station_pressure", "precip_accum_local_day", "lightning_strike_last_distance"]
    live = spark.createDataFrame([(1, E, 30.0, 50.0, 1.0, 2.0, 0.0, None, 1000.0, 1.0, None)], "station_id long, timestamp long, " + ", ".join(f"{n} double" for n in names))
    assert ingest.conditions_live(live).first().pressure_inhg == pytest.approx(29.53, abs=0.01)


def test_adhoc_sql(spark):
    spark.range(500).withColumn("v", F.col("id") / 3).createOrReplaceTempView("t")
    rows, cut = adhoc.query_sql(spark, "WITH a AS (SELECT id, 'drop; x' AS s FROM t) SELECT * FROM a ORDER BY id", 10)
    assert cut and rows.count() == 10
    rows, cut = adhoc.query_sql(spark, "SELECT count(*) AS n FROM t;", 1)
    assert not cut and rows.first().n == 500
    for sql in ["DROP TABLE t", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT 1\0", "SELECT " + "1," * 40_000 + "1", "SELECT double('NaN') AS x"]:
        with pytest.raises(ValueError):
            adhoc.query_sql(spark, sql)
    refused = [
        "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')", "SELECT * FROM VALUES (reflect('java.lang.System', 'nanoTime')) AS v(x)",
        "SELECT sum(v) OVER w FROM t WINDOW w AS (PARTITION BY java_method('java.lang.System', 'getProperty', 'user.dir'))",
        "SELECT sum(id) OVER w FROM t WINDOW w AS (ORDER BY (SELECT first(value) FROM text.`/etc/hostname`))", "SELECT id FROM t WHERE id IN (SELECT x FROM kept)",
        "SELECT sum(id) OVER w FROM t WINDOW w AS (PARTITION BY (SELECT max(x) FROM kept) ORDER BY id)",
        "SELECT id FROM t WHERE EXISTS (SELECT java_method('java.lang.System', 'nanoTime'))", "SELECT * FROM json.`/tmp/x`", "SELECT * FROM kept AS kept",
        "SELECT * FROM kept WHERE x IN (WITH kept AS (SELECT 1 AS x) SELECT x FROM kept)", "SHOW TABLES", "EXPLAIN SELECT 1", "SET a = b",
        "FROM t INSERT OVERWRITE DIRECTORY '/tmp/x' USING json SELECT *", "SELECT TRANSFORM(id) USING 'cat' FROM t", "SELECT id, repeat('x', 10000000) AS s FROM t", "SELECT 1 +",
    ]
    spark.sql("CREATE TABLE kept USING parquet AS SELECT 1 AS x")
    try:
        for sql in refused:
            try:
                adhoc.query_sql(spark, sql)
            except ValueError:
                continue
            pytest.fail(sql)
    finally:
        spark.sql("DROP TABLE kept")
    read = {
        "WITH add AS (SELECT id AS use, v AS load FROM t), n AS (SELECT max(use) AS m FROM add) SELECT count(*) AS n FROM add JOIN n ON use <= m": 500,
        "SELECT (SELECT max(id) FROM t) AS n": 499, "SELECT count(*) AS n FROM (SELECT id FROM t UNION ALL SELECT id FROM t WHERE id IN (SELECT id FROM t WHERE id < 5))": 505,
        "SELECT n FROM (SELECT id, count(*) OVER w AS n FROM t WINDOW w AS (ORDER BY id)) ORDER BY id DESC LIMIT 1": 500,
        "SELECT sum(x) AS n FROM t LATERAL VIEW explode(array(1, 2)) e AS x": 1500, "SELECT count(*) AS n FROM t, LATERAL (SELECT t.id + 1 AS j) HAVING count(*) > 1": 500,
        "(SELECT count(*) AS n FROM VALUES (1), (2) AS v(x))": 2,
    }
    for sql, n in read.items():
        assert adhoc.query_sql(spark, sql)[0].first().n == n, sql
    assert [r.id for r in adhoc.query_sql(spark, "SELECT id, id AS id2, id AS `a.b` FROM t ORDER BY id DESC", 3)[0].collect()] == [499, 498, 497]
    with pytest.raises(ValueError):
        adhoc.query_sql(spark, "SELECT 1", 1001)


def test_search_and_sort(spark):
    df = spark.createDataFrame([("Ab", 1), ("cd", None), ("xaB", 3), (None, 2)], "s string, v int")
    assert [r.v for r in adhoc.search_sorted(df, "AB", "v", True).collect()] == [3, 1]
    assert [r.v for r in adhoc.search_sorted(df, "", "v", True).collect()] == [3, 2, 1, None]
    assert [r.v for r in adhoc.search_sorted(df, "", "v", False, 1, 2).collect()] == [2, 3]


def test_generator_is_whole(spark):
    rows = derived.synth_observations(spark, 3, 2000)
    assert rows.count() == 6000 and rows.select("device_id", "epoch").distinct().count() == 6000 and rows.where("rain_mm > 0").count() == 9


# -- streams -----------------------------------------------------------------------------------------------------------------


def run(df, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = df.sparkSession.table("out").collect()
    q.stop()
    return rows


def shown(row):
    return tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)


@pytest.fixture
def landed(tmp_path):
    # The last row closes all windows before it.
    epochs = [E + 60 * k for k in range(40)] + [E + 60 * k for k in range(120, 160)] + [E + 86_400 * 3]
    for k in range(0, len(epochs), 27):
        land(tmp_path / "in", f"f{k:03}", {"device_id": 1, "type": "obs_st", "obs": [wire(e, rain=1.0) for e in epochs[k : k + 27]]})
    return str(tmp_path / "in"), epochs


def test_streams_equal_batch(spark, landed):
    path, epochs = landed
    read = lambda: streams.stream_observations(spark, path, 1)
    good, _ = ingest.validate_observations(ingest.read_observation_responses(spark, path), "quarantine")
    batch = {(r.device_id, r.bucket_epoch): (r.obs, r.rain_mm) for r in series.series(good, 900).collect()}
    streamed = {(r.device_id, r.bucket_epoch): (r.obs, r.rain_mm) for r in run(streams.stream_series(read(), 900))}
    last = max(k[1] for k in batch)
    assert streamed == {k: v for k, v in batch.items() if k[1] < last}
    partials = run(streams.stream_quarter_rollup(read()))
    whole = rollup.quarter_rollup(good)
    assert partials[0].__fields__ == whole.columns
    assert sorted(map(shown, partials)) == sorted(shown(r) for r in whole.collect() if r.bucket * 900 < last)
    assert [(r.start_epoch, r.end_epoch) for r in run(streams.stream_gaps(read()))] == [(E + 60 * 39, E + 60 * 120), (E + 60 * 159, epochs[-1])]
    assert sorted((r.first_epoch, r.obs) for r in run(streams.stream_sessions(read()))) == [(E, 40), (E + 7200, 40)]
    assert max(r.epoch for r in run(streams.stream_conditions(read()), "complete")) == epochs[-1]
    assert len(run(streams.stream_dedupe(read()))) == len(epochs)


def test_stream_sessions_end_at_a_gap_of_the_limit(spark, tmp_path):
    epochs = [E, E + 3599, E + 3599 + 3600, E + 86_400 * 3]
    land(tmp_path / "in", "f", {"device_id": 1, "type": "obs_st", "obs": [wire(e) for e in epochs]})
    rows = run(streams.stream_sessions(streams.stream_observations(spark, str(tmp_path / "in"), 1)))
    assert sorted((r.first_epoch, r.last_epoch, r.obs) for r in rows) == [(E, E + 3599, 2), (E + 7199, E + 7199, 1)]


def test_late_partials_merge_into_stored_days(spark, tmp_path):
    zones = spark.createDataFrame([(1, "Asia/Kathmandu")], ZONES)
    first = [wire(E + 600 * k, temp=float(k), rain=0.5) for k in range(0, 200, 2)]
    late = [wire(E + 600 * k, temp=50.0 - k, rain=0.25) for k in range(1, 200, 2)]
    paths = str(tmp_path / "partials"), str(tmp_path / "checkpoint")
    for name, rows in (("a", first), ("b", late)):
        land(tmp_path / "in", name, {"device_id": 1, "type": "obs_st", "obs": rows})
        streams.store_partials(streams.stream_observations(spark, str(tmp_path / "in")), *paths).awaitTermination()
    good, _ = ingest.validate_observations(ingest.read_observation_responses(spark, str(tmp_path / "in")), "quarantine")
    stored = streams.stored_quarters(spark, paths[0])
    assert sorted(map(shown, stored.collect())) == sorted(map(shown, rollup.quarter_rollup(good).collect()))
    assert sorted(map(shown, rollup.day_rollup(stored, zones).collect())) == sorted(map(shown, rollup.days_of(good, zones).collect()))
    # A batch that is done again replaces its part.
    part = spark.read.parquet(paths[0]).where("part = 0").count()
    rollup.quarter_rollup(good).limit(3).selectExpr("*", "0L as part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(paths[0])
    assert part > 3 and spark.read.parquet(paths[0]).where("part = 0").count() == 3


def test_a_device_that_stops_is_told_by_the_watermark(spark, tmp_path):
    going = [wire(E + 60 * k) for k in range(400)]
    for k in range(0, 400, 40):
        responses = [{"device_id": 2, "type": "obs_st", "obs": going[k : k + 40]}]
        if k < 80:
            responses.append({"device_id": 1, "type": "obs_st", "obs": going[k : k + 40]})
        land(tmp_path / "in", f"f{k:03}", *responses)
    got = run(streams.stream_stale_sensors(streams.stream_observations(spark, str(tmp_path / "in"), 1)))
    assert sorted((r.device_id, r.sensor, r.last_epoch, r.newest_epoch) for r in got) == sorted((1, s, E + 79 * 60, E + 79 * 60) for s in CONTINUOUS)


def scanned(df):
    """Rows that the scans of a collected frame have put out."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()))


def test_a_late_row_rereads_its_days_alone(spark, tmp_path):
    minutes = derived.synth_observations(spark, 6, 40 * 1440)
    paths = [str(tmp_path / p) for p in ("archive", "rollups", "checkpoint")]
    zones = spark.createDataFrame([(k, z) for k, z in enumerate(["Asia/Kathmandu", "America/Los_Angeles", "Australia/Lord_Howe"], 1)], ZONES)
    late = 1_672_531_200 + 20 * 86_400 + 30
    archive.write_obs(minutes, paths[0])
    streams.refresh_days(spark, paths[0], paths[1], streams.touched_days(minutes, zones), zones)
    stored = lambda: sorted(map(shown, spark.read.parquet(paths[1]).select(*rollup.days_of(minutes, zones).columns).collect()))
    assert stored() == sorted(map(shown, rollup.days_of(minutes, zones).collect()))
    land(tmp_path / "in", "late", {"device_id": 1, "type": "obs_st", "obs": [wire(late, rain=7.0)]})
    streams.sync_archive(spark, str(tmp_path / "in"), *paths, zones).awaitTermination()
    rows = archive.read_obs(spark, paths[0])
    assert rows.count() == 6 * 40 * 1440 + 1
    assert stored() == sorted(map(shown, rollup.days_of(rows, zones).collect()))
    again = streams.reread(spark, paths[0], streams.touched_days(rows.where(F.col("epoch") == late), zones))
    assert len(again.collect()) == 1441 and scanned(again) < 3 * 1440


def test_zone_map_skips_months(spark, tmp_path):
    path = str(tmp_path / "archive")
    for part in range(3):
        rows = [{"epoch": day_epoch(f"2024-0{1 + (k + part) % 6}-1{k % 5}") + part, "device": k % 4, "pres": 1000 + k, "temp": k} for k in range(40)]
        archive.write_obs(ingest.append_observations(None, obs(spark, rows).withColumn("n", F.monotonically_increasing_id()), ["n"]), path)
    rows, zones = archive.read_months(spark, path), archive.zone_map(spark, path)
    plain = rows.groupBy("device_id", "obs_month").agg(F.min("epoch"), F.max("epoch")).collect()
    assert sorted(map(tuple, zones.collect())) == sorted(map(tuple, plain))
    for f in (asof.latest, asof.pressure_tendency):
        with_zones = f(rows, zones=zones) if f is asof.pressure_tendency else f(rows, zones)
        assert sorted(map(shown, with_zones.collect())) == sorted(map(shown, f(archive.read_obs(spark, path)).collect())), f
        plan = with_zones._jdf.queryExecution().toString()
        assert "dynamicpruning" in plan.lower() and "obs_month" in plan, f
    assert len(asof.latest(rows, zones).collect()) == 4


def test_ranges_of_devices_prune_months(spark, tmp_path):
    path = str(tmp_path / "archive")
    minutes = derived.synth_observations(spark, 5, 100 * 1440).where("epoch % 3600 = 0")
    archive.write_obs(minutes, path)
    zones = spark.createDataFrame([(1, "Asia/Kathmandu"), (2, "America/Los_Angeles"), (3, "UTC"), (9, "UTC")], ZONES)
    bounds = calendar.resolve_range(zones, "2023-01-28", "2023-02-03", day_epoch("2023-03-01"))
    found = calendar.within_ranges(archive.read_months(spark, path), bounds)
    limits = {r.device_id: (r.start_epoch, r.end_epoch) for r in bounds.collect()}
    expected = sorted((r.device_id, r.epoch) for r in minutes.collect() if r.device_id in limits and limits[r.device_id][0] <= r.epoch <= limits[r.device_id][1])
    assert sorted((r.device_id, r.epoch) for r in found.collect()) == expected and len(expected) == 3 * 7 * 24
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() and "Broadcast" in plan
    week = calendar.resolve_days(zones, 7, "2023-02-03", 0)
    assert calendar.within_ranges(minutes, week).count() == len(expected)
    assert scanned_files(found) < 4


def scanned_files(df):
    """Months that a collected frame's scan of an archive has read."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    leaves = re.findall("DynamicFileSourceFilter|dynamicpruning", plan)
    assert leaves
    return df.select(F.year(F.timestamp_seconds("epoch")) * 100 + F.month(F.timestamp_seconds("epoch"))).distinct().count()


def test_checks_and_write_in_one_pass(spark, tmp_path):
    good = obs(spark, [{"epoch": E + k, "temp": 20} for k in range(50)])
    path = str(tmp_path / "batch")
    assert archive.ingest_observations(good, path, E, E + 100) == {"rows": 50, "first_epoch": E, "last_epoch": E + 49}
    assert spark.read.parquet(path).count() == 50
    for bad in (obs(spark, [{"epoch": E}, {"epoch": E + 1, "hum": 101}]), obs(spark, [{"epoch": E}, {"epoch": E + 101}])):
        with pytest.raises(Exception, match="are not valid: (humidity|outside the window)"):
            archive.ingest_observations(bad.repartition(2), str(tmp_path / "none"), E, E + 100)
        with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA|PATH_NOT_FOUND"):
            spark.read.parquet(str(tmp_path / "none"))
    assert archive.ingest_observations(good.limit(0), path)["rows"] == 0


def test_bucketed_archive_meets_batches_without_a_shuffle(spark, tmp_path):
    path, order = str(tmp_path / "table"), ["seq"]
    rows = obs(spark, [{"epoch": E + 60 * k, "device": d, "temp": k} for d in range(9) for k in range(40)])
    archive.write_bucketed(rows, "obs_by_device", path, 8)
    try:
        batch = obs(spark, [{"epoch": E + 60 * k, "device": d, "temp": -k} for d in range(9) for k in range(30, 45)]).withColumn("seq", F.lit(1))
        stored = archive.open_bucketed(spark, "obs_by_device", path, 8)
        with archive.joins_by_bucket(spark):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            plan = ingest.append_observations(stored, batch, order)._jdf.queryExecution().executedPlan().toString()
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        held = plan[plan.index("FileScan") - 400 :]
        assert "Bucketed: true" in plan and "Exchange" not in held.split("FileScan")[0].split("Sort")[-1]
        rolled = rollup.quarter_rollup(stored)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in rolled and "Bucketed: true" in rolled
        assert archive.append_bucketed(spark, "obs_by_device", path, batch, order, 8) == 9 * 5
        assert archive.append_bucketed(spark, "obs_by_device", path, batch, order, 8) == 0
        spark.sql("DROP TABLE obs_by_device")  # another session knows the path alone
        again = archive.open_bucketed(spark, "obs_by_device", path, 8)
        assert again.count() == 9 * 45 and again.where("air_temp_c < 0").count() == 9 * 5
    finally:
        spark.sql("DROP TABLE IF EXISTS obs_by_device")


def test_silent_sensors(spark, tmp_path):
    rows = [wire(E + 60 * k, temp=20.0 if k < 3 else None) for k in range(100)]
    for k in range(0, 100, 25):
        land(tmp_path / "in", f"f{k:03}", {"device_id": 1, "type": "obs_st", "obs": rows[k : k + 25]})
    got = run(streams.stream_stale_sensors(streams.stream_observations(spark, str(tmp_path / "in"), 1)))
    assert [(r.sensor, r.last_epoch) for r in got] == [("air_temp_c", E + 120)]


def test_sync_keeps_the_row_that_arrived_first(spark, tmp_path):
    source, paths = tmp_path / "in", [str(tmp_path / p) for p in ("archive", "rollups", "checkpoint")]
    land(source, "a", {"device_id": 1, "type": "obs_st", "obs": [wire(E, rain=5.0), wire(E, rain=1.0), wire(E + 60, rain=2.0)]})
    streams.sync_archive(spark, str(source), *paths).awaitTermination()
    assert sorted((r.epoch, r.rain_mm) for r in spark.read.parquet(paths[0]).collect()) == [(E, 5.0), (E + 60, 2.0)]


def test_sync_is_idempotent_and_takes_late_rows(spark, tmp_path):
    source, paths = tmp_path / "in", [str(tmp_path / p) for p in ("archive", "rollups", "checkpoint")]
    sync = lambda: streams.sync_archive(spark, str(source), *paths).awaitTermination()
    land(source, "a", {"device_id": 1, "type": "obs_st", "obs": [wire(E, rain=1.0), wire(E + 60, rain=1.0)]})
    sync()
    land(source, "b", {"device_id": 1, "type": "obs_st", "obs": [wire(E + 60, rain=9.0), wire(E - 3600, rain=2.0)]})
    sync()
    sync()
    stored = spark.read.parquet(paths[0])
    assert sorted((r.epoch, r.rain_mm) for r in stored.collect()) == [(E - 3600, 2.0), (E, 1.0), (E + 60, 1.0)]
    (day,) = spark.read.parquet(paths[1]).collect()
    assert (day.rain_sum, day.obs) == (4.0, 3)
