import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from stationspark.functions import units as U
from stationspark.functions.calendar import day_end, day_start, resolve_days, resolve_range
from stationspark.operators import asof, calendar, climate, conditions, sensors, series
from stationspark.operators.rollup import day_rollup, days_of, quarter_rollup
from stationspark.operators.spells import spells

from .helpers import ZONES, day_epoch, obs

D = dt.date


def one(df):
    (row,) = df.collect()
    return row


# -- scalars ---------------------------------------------------------------------------------------------------------------


def test_formulas(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert value(U.c_to_f(lit(100.0))) == 212 and value(U.mm_to_inch(lit(25.4))) == 1
    for degrees, name in [(0.0, "N"), (11.25, "NNE"), (348.75, "N"), (-90.0, "W"), (725.0, "N"), (180.0, "S")]:
        assert value(U.compass(lit(degrees))) == name
    assert value(U.dew_point_c(lit(20.0), lit(0.0))) is None
    assert value(U.dew_point_c(lit(20.0), lit(100.0))) == pytest.approx(20)
    assert value(U.heat_index_f(lit(79.0), lit(90.0))) == 79
    assert value(U.heat_index_f(lit(90.0), lit(70.0))) == pytest.approx(105.92, abs=0.1)
    assert value(U.heat_index_f(lit(95.0), lit(5.0))) < value(U.heat_index_f(lit(95.0), lit(14.0)))
    assert value(U.wind_chill_f(lit(0.0), lit(15.0))) == pytest.approx(-19.4, abs=0.1)
    assert value(U.wind_chill_f(lit(40.0), lit(3.0))) == 40
    none = lit(None).cast("double")
    assert value(U.apparent_temp_f(lit(90.0), none, lit(1.0))) is None
    assert value(U.apparent_temp_f(lit(65.0), none, none)) == 65
    assert value(U.coverage_label(lit(0), lit(3))) == "missing" and value(U.coverage_label(lit(2), lit(3))) == "partial"


def test_local_days_with_clock_changes(spark):
    df = spark.createDataFrame([(1, "America/New_York")], ZONES)
    for text, hours in [("2025-03-09", 23), ("2025-11-02", 25), ("2025-06-01", 24)]:
        row = one(df.select(day_start(F.lit(text).cast("date"), F.col("tz")).alias("a"), day_end(F.lit(text).cast("date"), F.col("tz")).alias("b")))
        assert row.b - row.a + 1 == hours * 3600
    as_of = day_epoch("2025-06-10")
    week = one(resolve_days(df, 7, None, as_of))
    assert week.end_epoch - week.start_epoch + 1 == 7 * 86_400
    alone = one(resolve_range(df, None, "2025-01-05", as_of))
    assert alone.end_epoch - alone.start_epoch + 1 == 86_400
    with pytest.raises(ValueError):
        resolve_range(df, "2025-02-01", "2025-01-01", as_of)


# -- days and periods --------------------------------------------------------------------------------------------------------


def test_null_is_not_zero(spark):
    rows = obs(spark, [{"epoch": day_epoch("2024-05-01"), "temp": 10}, {"epoch": day_epoch("2024-05-02"), "rain": 0}, {"epoch": day_epoch("2024-05-03"), "rain": 25.4}])
    got = {r.day.day: r for r in calendar.daily_summary(days_of(rows)).collect()}
    assert (got[1].rain_in, got[1].rain_readings, got[1].temp_max_f) == (None, 0, 50)
    assert (got[2].rain_in, got[2].rain_readings, got[2].temp_max_f) == (0, 1, None)
    assert got[3].rain_in == 1


def test_month_summary_and_normals(spark):
    rows = obs(spark, [
        {"epoch": day_epoch("2024-03-01"), "temp": 10, "rain": 12.7}, {"epoch": day_epoch("2024-03-02"), "temp": 20, "rain": 0.1}, {"epoch": day_epoch("2024-04-01"), "temp": 5},
        {"epoch": day_epoch("2023-03-05"), "temp": 30},
    ])
    months = calendar.period_summary(days_of(rows))
    march = months.where("period = '2024-03'").first()
    assert (march.days_observed, march.rainy_days, march.obs) == (2, 1, 2) and march.temp_avg_f == pytest.approx(59)
    normal = calendar.monthly_normals(months).where("month = 3").first()
    assert (normal.years, normal.rain_years, normal.rainy_days) == (2, 1, 1.0) and normal.temp_avg_f == pytest.approx((59 + 86) / 2)


def test_this_day(spark):
    rows = obs(spark, [{"epoch": day_epoch(f"{y}-05-15"), "temp": t, "rain": r} for y, t, r in [(2022, 20, 25.4), (2023, 27, None), (2024, 27, 0)]] + [{"epoch": day_epoch("2023-05-16"), "temp": 40}])
    years = calendar.this_day(days_of(rows), 5, 15)
    assert sorted(r.year for r in years.collect()) == [2022, 2023, 2024]
    best = one(calendar.this_day_records(years))
    assert (best.record_high_year, best.record_low_year, best.wettest_year, best.wettest_in) == (2023, 2022, 2022, 1)
    leap = obs(spark, [{"epoch": day_epoch("2024-02-29"), "temp": 1}, {"epoch": day_epoch("2023-03-01"), "temp": 1}])
    assert calendar.this_day(days_of(leap), 2, 29).count() == 1


def test_equal_totals_tie_whatever_the_order_of_adding(spark):
    parts = [("2022-05-15", 0, 0.3)] + [("2023-05-15", h, 0.1) for h in range(3)]  # 0.1 three times is a little more than 0.3
    day = days_of(obs(spark, [{"epoch": day_epoch(d, h), "rain": r} for d, h, r in parts]))
    assert one(calendar.this_day_records(calendar.this_day(day, 5, 15))).wettest_year == 2022
    assert one(sensors.rain_stats(day)).wettest_day == D(2022, 5, 15)


def test_zones_decide_the_day(spark):
    rows = obs(spark, [{"epoch": day_epoch("2024-07-01", 2), "rain": 1}, {"epoch": day_epoch("2024-07-01", 12), "rain": 2}])
    zones = spark.createDataFrame([(1, "America/Los_Angeles")], ZONES)
    assert {r.day: r.rain_readings for r in calendar.daily_summary(days_of(rows, zones)).collect()} == {D(2024, 6, 30): 1, D(2024, 7, 1): 1}


def test_spines(spark):
    rows = obs(spark, [{"epoch": day_epoch("2024-01-01"), "rain": 5.08, "temp": 1}, {"epoch": day_epoch("2024-01-03"), "temp": 3}])
    daily = calendar.daily_summary(days_of(rows))
    assert calendar.calendar_grid(daily, "2024-01-01", "2024-01-31").count() == 31
    assert calendar.month_strip(calendar.period_summary(days_of(rows)), 2024).count() == 12
    week = one(calendar.view_summary(daily, "week"))
    assert (week.period_start, week.observed_days, week.calendar_days, week.rainy_days) == (D(2024, 1, 1), 2, 7, 1)
    month = one(calendar.view_summary(daily, "month"))
    assert month.calendar_days == 31
    zones = spark.createDataFrame([(1, "America/New_York")], ZONES)
    for text, n in [("2025-03-09", 46), ("2025-11-02", 50), ("2024-01-01", 48)]:
        assert calendar.day_profile(rows, text, zones).count() == n
    quarter = calendar.day_profile(rows, "2024-01-01", spark.createDataFrame([(1, "Asia/Kathmandu")], ZONES)).orderBy("bucket_epoch").collect()
    assert len(quarter) == 49 and [r.temp_c for r in quarter if r.temp_c is not None] == [1.0]  # both edges, from 18:00 UTC on
    flat = calendar.normalise_metric(daily, "temp_avg_f", ["device_id"]).orderBy("day").collect()
    assert [r.scaled for r in flat] == [0, 1]


# -- spells and sensors ------------------------------------------------------------------------------------------------------


def test_spells_break_on_missing_and_unknown_days(spark):
    rain = {"2024-06-01": 0, "2024-06-02": 0, "2024-06-03": 0.1, "2024-06-04": 5, "2024-06-05": 9, "2024-06-07": 0, "2024-06-08": None, "2024-06-09": 0}
    rows = obs(spark, [{"epoch": day_epoch(d), "rain": r, "temp": 1} for d, r in rain.items()])
    r = one(sensors.rain_stats(days_of(rows)))
    assert (r.dry_spell_days, r.dry_spell_start, r.dry_spell_end) == (3, D(2024, 6, 1), D(2024, 6, 3))
    assert (r.wet_spell_days, r.wet_spell_start, r.wettest_day, r.rain_readings, r.observations) == (2, D(2024, 6, 4), D(2024, 6, 5), 7, 8)


def test_spells_are_the_longest_runs(spark):
    rng = random.Random(5)
    days = sorted(rng.sample(range(200), 120))
    good = {k for k in days if rng.random() < 0.7}
    df = spark.createDataFrame([(1, D(2024, 1, 1) + dt.timedelta(k), k in good) for k in days], "device_id long, day date, good boolean")
    best = (0, 0)
    for k in sorted(good):
        n = 0
        while k + n in good:
            n += 1
        best = max(best, (n, -k))
    row = one(spells(df, F.col("good"), "x"))
    assert (row.x_days, row.x_start) == (best[0], D(2024, 1, 1) + dt.timedelta(-best[1]))


def test_lightning(spark):
    rows = [{"epoch": day_epoch(f"2024-07-0{d}"), "strikes": s, "dist": km} for d, s, km in [(1, 0, None), (2, 0, 9), (3, 5, 8), (4, 12, 3), (6, 0, None), (7, 0, None), (8, 0, None)]]
    r = one(sensors.lightning_stats(days_of(obs(spark, rows))))
    assert (r.total_strikes, r.storm_days, r.busiest_day, r.closest_day) == (17, 2, D(2024, 7, 4), D(2024, 7, 4))
    assert r.closest_miles == pytest.approx(3 / 1.609344) and (r.storm_free_days, r.storm_free_start) == (3, D(2024, 7, 6))


def test_wind_rose(spark):
    e = day_epoch("2024-01-01")
    rows = [{"epoch": e + k, "wind": 2, "dir": d, "gust": 4} for k, d in enumerate([0, 2, 358, 90])] + [{"epoch": e + 9, "wind": 0.1, "dir": 180}]
    got = {r.direction: r for r in sensors.wind_rose(obs(spark, rows)).collect()}
    assert len(got) == 16 and (got["N"]["count"], got["N"].pct, got["E"]["count"], got["S"]["count"]) == (3, 75, 1, 0) and got["N"].calm_pct == pytest.approx(20)
    odd = [{"epoch": e, "wind": 1, "dir": None}, {"epoch": e + 1, "wind": None, "dir": 90}, {"epoch": e + 2, "wind": 0.2, "dir": 1}, {"epoch": e + 3, "wind": 3, "dir": -270.0}]
    got = {r.direction: r for r in sensors.wind_rose(obs(spark, odd)).collect()}
    assert (got["E"].pct, got["E"].obs) == (100, 3) and got["E"].calm_pct == pytest.approx(100 / 3)


def test_solar_uses_usable_intervals(spark):
    e = day_epoch("2024-01-01")
    rows = [{"epoch": e, "solar": 100, "interval": 1}, {"epoch": e + 60, "solar": 200, "interval": 5}, {"epoch": e + 120, "solar": 900}, {"epoch": e + 180, "solar": 800, "interval": 0}]
    r = one(sensors.solar_stats(days_of(obs(spark, rows))))
    assert r.total_mj == pytest.approx(0.066) and r.peak_solar_wm2 == 900


def test_pressure_swings(spark):
    p = {"2024-01-01": 1000, "2024-01-02": 990, "2024-01-04": 1030, "2024-01-05": 1032, "2024-01-06": None, "2024-01-07": 900}
    r = one(sensors.pressure_stats(days_of(obs(spark, [{"epoch": day_epoch(d), "pres": v, "temp": 1} for d, v in p.items()]))))
    assert (r.largest_fall_day, r.largest_rise_day, r.days_observed) == (D(2024, 1, 2), D(2024, 1, 5), 6)
    assert r.largest_fall_inhg == pytest.approx(-10 * U.INHG_PER_MB) and r.lowest_day == D(2024, 1, 7)


def test_comfort_pairs(spark):
    e = 1_700_000_100
    stats = lambda rows: one(sensors.comfort_stats(quarter_rollup(obs(spark, [{"epoch": e + k, **r} for k, r in enumerate(rows)]))))
    unpaired = stats([{"temp": 40}, {"hum": 90}])
    assert (unpaired.hottest_feels_like_f, unpaired.coldest_feels_like_f, unpaired.muggiest_dew_point_f) == (None, None, None)
    mild = stats([{"temp": 20}])
    assert mild.hottest_feels_like_f == mild.coldest_feels_like_f == 68
    both = stats([{"temp": 35, "hum": 60}, {"temp": -10, "wind": 10}])
    assert both.hottest_feels_like_f > 95 and both.coldest_feels_like_f < 14


def test_health_and_records(spark):
    e = day_epoch("2024-01-01")
    rows = obs(spark, [{"epoch": e, "temp": 5, "uv": 1, "battery": 2.4, "strikes": 2}, {"epoch": e + 7200, "temp": 5, "gust": 3, "battery": 2.6}, {"epoch": e + 7300, "gust": 3}])
    health = {r.sensor: r for r in sensors.sensor_health(rows).collect()}
    assert (health["uv"].stale, health["air_temp_c"].stale, health["humidity"].stale, health["humidity"].last_epoch) == (True, False, False, None)
    assert health["air_temp_c"].coverage_pct == pytest.approx(200 / 3) and health["uv"].battery_max_v == 2.6
    r = one(sensors.records(rows, days_of(rows)))
    assert (r.hottest_epoch, r.peak_gust_epoch, r.total_strikes, r.wettest_day) == (e, e + 7200, 2, None)


# -- climate ---------------------------------------------------------------------------------------------------------------


def test_degree_days_and_indices(spark):
    rows = obs(spark, [{"epoch": day_epoch(d, h), "temp": t} for d, h, t in [("2024-01-15", 6, 0), ("2024-01-15", 14, 10), ("2024-07-15", 6, 20), ("2024-07-15", 14, 30), ("2024-08-01", 6, -5)]])
    total = climate.degree_days(days_of(rows)).where("period = 'total'").first()
    assert (total.hdd, total.cdd, total.gdd, total.days_used) == (pytest.approx(24 + 65 - 23), 12, pytest.approx(27), 3)
    with pytest.raises(ValueError):
        climate.degree_days(days_of(rows), growing=60, cap=50)
    for wrong in ({"heating": math.nan}, {"cooling": math.inf}, {"growing": -201}, {"cap": 301}, {"cap": math.nan}):
        with pytest.raises(ValueError, match="is not a temperature"):
            climate.degree_days(days_of(rows), **wrong)
    index = climate.climate_indices(days_of(rows)).where("period = '2024'").first()
    assert (index.frost_days, index.ice_days, index.summer_days, index.hot_days, index.tropical_nights) == (1, 1, 1, 0, 1)
    with pytest.raises(ValueError):
        climate.climate_indices(days_of(rows), hot=math.inf)
    spell = one(climate.temperature_spells(days_of(rows), heat=86))
    assert (spell.heat_wave_days, spell.cold_snap_days, spell.cold_snap_start, spell.days_observed) == (1, 1, D(2024, 1, 15), 3)


def test_trend(spark):
    months = lambda rows: spark.createDataFrame([(1, p, t) for p, t in rows], "device_id long, period string, temp_avg_f double").selectExpr("*", "cast(null as double) temp_min_f", "cast(null as double) temp_max_f", "cast(null as double) rain_in", "0L rainy_days")
    up = one(climate.temperature_trend(months([("2020-01", 32.0), ("2021-01", 35.6), ("2021-12", 122.0)])))
    assert up.slope_per_decade_f == pytest.approx(36) and up.r_squared == pytest.approx(1) and (up.years, up.months_used) == (2, 3)
    assert (up.warmest_month, up.coldest_month) == ("2021-01", "2020-01")
    flat = one(climate.temperature_trend(months([(f"{y}-03", 41.3) for y in range(2000, 2010)])))
    assert (flat.slope_per_decade_f, flat.r_squared) == (0, None)
    once = one(climate.temperature_trend(months([("2020-01", 1.0), ("2020-02", 2.0)])))
    assert (once.slope_per_decade_f, once.months_used) == (None, 2)


# -- series, gaps, as-of -------------------------------------------------------------------------------------------------------


def test_series(spark):
    rows = obs(spark, [{"epoch": 1_700_000_040 + 60 * k, "temp": k, "rain": 1 if k != 2 else None} for k in range(6)])
    got = series.series(rows, 180).orderBy("bucket_epoch").collect()
    assert all(r.bucket_epoch % 180 == 0 for r in got) and sum(r.obs for r in got) == 6 and sum(r.rain_mm for r in got) == 5
    with pytest.raises(ValueError):
        series.series(rows, 59)


def test_widths_are_the_finest_that_fit(spark):
    rng = random.Random(1)
    bounds = [(k, a := rng.randrange(10**9), a + rng.randrange(10**rng.randrange(3, 10))) for k in range(60)]
    df = spark.createDataFrame(bounds, "device_id long, start_epoch long, end_epoch long")
    for points in (24, 288, 2000):
        for r in df.withColumn("w", series.width_for(F.col("start_epoch"), F.col("end_epoch"), points)).collect():
            fits = lambda w, r=r, points=points: r.end_epoch // w - r.start_epoch // w + 1 <= points
            assert r.w % 60 == 0 and fits(r.w) and not any(fits(w) for w in range(max(60, r.w - 600), r.w, 60))
    rows = obs(spark, [{"epoch": 1000, "device": 1}, {"epoch": 10**7, "device": 1}])
    wide = series.series_auto(rows, spark.createDataFrame([(1, 0, 10**7)], "device_id long, start_epoch long, end_epoch long"), bucket_s=60).first()
    assert wide.coarsened and wide.bucket_s > 60


def test_gaps_across_months(spark):
    assert [(r.start_epoch, r.end_epoch, r.seconds) for r in asof.gaps(obs(spark, [{"epoch": e} for e in (1000, 1060, 1120, 50_000, 50_060)])).collect()] == [(1120, 50_000, 48_880)]
    rng = random.Random(7)
    epochs = {d: sorted(rng.sample(range(1_700_000_000, 1_720_000_000), 400)) for d in (1, 2)}
    rows = obs(spark, [{"epoch": e, "device": d} for d, es in epochs.items() for e in es])
    plain = {(d, a, b, b - a) for d, es in epochs.items() for a, b in zip(es, es[1:]) if b - a > 3600}
    assert {tuple(r) for r in asof.all_gaps(rows).collect()} == plain


@pytest.mark.parametrize("seed", range(6))
def test_pressure_tendency_is_brute_force(spark, seed):
    rng = random.Random(seed)
    data = {d: {1_700_000_000 + rng.randrange(0, 30_000): rng.choice([None, 1000 + rng.randrange(20)]) for _ in range(rng.randrange(1, 12))} for d in range(8)}
    window = rng.choice([3600, 10_800, 10_801, 1])
    got = {r.device_id: r for r in asof.pressure_tendency(obs(spark, [{"epoch": e, "pres": p, "device": d, "temp": 1} for d, es in data.items() for e, p in es.items()]), window).collect()}
    for d, es in data.items():
        known = {e: p for e, p in es.items() if p is not None}
        now = max(known, default=0)
        able = [e for e in known if now - e >= max(1, (window + 1) // 2)]
        if not able:
            assert d not in got
            continue
        past = min(able, key=lambda e: (abs(e - (now - window)), e))
        assert got[d].window_hours == pytest.approx((now - past) / 3600) and got[d].change_mb_per_3h == pytest.approx((known[now] - known[past]) / ((now - past) / 3600) * 3)


def test_tendency_words(spark):
    e = 1_700_000_000
    r = one(asof.pressure_tendency(obs(spark, [{"epoch": e, "pres": 1018}, {"epoch": e + 10_800, "pres": 1012}])))
    assert (r.change_mb_per_3h, r.category) == (-6, "falling rapidly")


def test_missing_windows(spark):
    rows = obs(spark, [{"epoch": e} for e in (1_000_000, 1_000_060, 3_000_000)])
    got = sorted(tuple(r)[1:] for r in asof.missing_windows(rows, 900_000, 3_000_100).collect())
    assert got[0] == (900_000, 999_999) and all(b - a < 5 * 86_400 for a, b in got)
    assert [a for a, _ in got[2:]] == [b + 1 for _, b in got[1:-1]] and got[-1][1] == 2_999_999


def test_windows_of_devices_without_rows(spark):
    rows = obs(spark, [{"epoch": 1_000_000, "device": 1}, {"epoch": 5_000_000, "device": 2}])
    got = sorted(map(tuple, asof.missing_windows(rows, 900_000, 1_000_100, max_window_s=60_000).collect()))
    assert got == [(1, 900_000, 959_999), (1, 960_000, 999_999), (2, 900_000, 959_999), (2, 960_000, 1_000_100)]
    known = spark.createDataFrame([(3,)], "device_id long")
    assert [tuple(r) for r in asof.missing_windows(rows, 900_000, 1_000_100, devices=known).collect()] == [(3, 900_000, 1_000_100)]


def test_no_sort_of_raw_rows(spark):
    rows = obs(spark, [{"epoch": day_epoch("2024-01-01") + 60 * k, "temp": k % 7, "pres": 1000 + k % 5, "gust": k % 3} for k in range(200)])
    for df in (asof.latest(rows), asof.pressure_tendency(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "Window" not in plan
        # The text column alone is not of a fixed width: it is aggregated over the newest rows.
        assert plan.count("SortAggregate") <= (2 if "source" in df.columns else 0)
    quarter = quarter_rollup(rows)
    found = sensors.records(rows, day_rollup(quarter), quarter)
    parts = found._jdf.queryExecution().executedPlan().toString().split("SortAggregate")
    assert all("rain_sum" in p.split("\n")[0] for p in parts[1:]), [p.split("\n")[0] for p in parts[1:]]  # the wettest day, over days


# -- joins -----------------------------------------------------------------------------------------------------------------


def test_conditions_and_report(spark):
    e = day_epoch("2024-05-05")
    rows = obs(spark, [{"epoch": e - 10_800, "pres": 1000}, {"epoch": e, "temp": 30, "hum": 70, "wind": 2, "dir": 90, "pres": 1001, "rain": 25.4}])
    day = days_of(rows)
    now = one(conditions.conditions_archive(rows, calendar.daily_summary(day), e + 600))
    assert (now.age_s, now.wind_from, now.rain_today_in, now.pressure_trend) == (600, "E", 1, "rising") and now.feels_like_f > 86
    later = one(conditions.conditions_archive(rows, calendar.daily_summary(day), e + 90_000))
    assert later.rain_today_in is None
    status = one(conditions.archive_status(rows, e + 60))
    assert status.fresh and len(status.gaps) == 1 and status.gaps[0].seconds == 10_800
    report = one(conditions.stats_report(rows, e - 20_000, e))
    assert report.coverage.obs == 2 and report.rain.total_in == 1 and report.wind.wind_readings == 1
    live = spark.createDataFrame([(7, 99.0)], "station_id long, temp_f double")
    dim = spark.createDataFrame([(1, 7), (2, 8)], "device_id long, station_id long")
    both = one(conditions.conditions(live, conditions.conditions_archive(rows, calendar.daily_summary(day), e), dim))
    assert (both.source, both.temp_f, both.pressure_trend) == ("live", 99, "rising")
    assert conditions.devices_of_station(asof.device_ids(rows), dim, 8).count() == 0
