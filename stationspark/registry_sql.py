"""The registered queries in DuckDB's SQL, and the parts that they are made of."""

from __future__ import annotations

from collections.abc import Callable

from stationspark.functions import units as U
from stationspark.schema import SENSORS
from stationspark.sources import derived

YEAR, DATE = 1998, (7, 15)
AS_OF = 1_706_659_200  # a day after the last event
DAY = "2024-01-15"
RANGE = (1_704_067_200, 1_706_659_199)
WINDOW = (1_703_980_800, 1_704_124_800)  # from a day before the first event; many devices have no row in it


def _f(c: str) -> str:
    return f"(({c}) * 9 / 5 + 32)"


def _mph(c: str) -> str:
    return f"(({c}) * {U.MPH_PER_MPS})"


def _hg(c: str) -> str:
    return f"(({c}) * {U.INHG_PER_MB})"


def _in(c: str) -> str:
    return f"(({c}) / {U.MM_PER_INCH})"


def _r(c: str) -> str:
    return f"round({c}, 6)"


def _top(value: str, key: str = "day") -> tuple[str, str]:
    return f"max({value})", f"first({key} ORDER BY {value} DESC, {key}) FILTER ({value} IS NOT NULL)"


def _low(value: str, key: str = "day") -> tuple[str, str]:
    return f"min({value})", f"first({key} ORDER BY {value}, {key}) FILTER ({value} IS NOT NULL)"


_SHIP = "WITH raw AS (SELECT " + ", ".join(derived.ship_rows("cast(epoch(l_shipdate) as bigint)")) + """ FROM lineitem),
obs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY device_id, epoch ORDER BY seq_a, seq_b) AS rn FROM raw) WHERE rn = 1)"""
_EVENTS = "WITH raw AS (SELECT " + ", ".join(derived.event_rows("cast(floor(epoch(ts)) as bigint)")) + """ FROM events),
obs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY device_id, epoch ORDER BY seq_a) AS rn FROM raw) WHERE rn = 1)"""
_UTC = "cast(to_timestamp({}) AT TIME ZONE 'UTC' AS date)"
_PARTS = """min(air_temp_c) AS tmin, max(air_temp_c) AS tmax, sum(air_temp_c) AS tsum, count(air_temp_c) AS tn, sum(humidity) AS hsum, count(humidity) AS hn,
sum(wind_avg) AS wsum, count(wind_avg) AS wn, max(wind_avg) AS wmax, max(wind_gust) AS gmax, count(*) FILTER (wind_avg < 0.5) AS calm,
sum(rain_mm) AS rsum, count(rain_mm) AS rn, sum(strike_count) AS ssum, count(strike_count) AS sn,
min(strike_dist_km) FILTER (strike_count > 0 AND strike_dist_km > 0) AS close, sum(pressure_mb) AS psum, count(pressure_mb) AS pn,
min(pressure_mb) AS pmin, max(pressure_mb) AS pmax, sum(solar_wm2 * report_interval_min * 60 / 1e6) FILTER (report_interval_min > 0 AND report_interval_min <= 1440) AS mj,
max(solar_wm2) AS smax, max(uv) AS uvmax, max(illuminance_lux) AS lmax, count(*) AS n"""
_DAY = _SHIP + f", day AS (SELECT device_id, {_UTC.format('epoch - epoch % 900')} AS day, {_PARTS} FROM obs GROUP BY 1, 2)"
_RAIN = f"CASE WHEN rn > 0 THEN {_r(_in('rsum'))} END AS rain_in"
_PERIOD = """SELECT device_id, strftime(day, '{shape}') AS period, min(tmin) AS tmin, max(tmax) AS tmax, sum(tsum) / nullif(sum(tn), 0) AS tavg, sum(rsum) AS rsum, cast(sum(rn) AS bigint) AS rn,
max(gmax) AS gmax, count(*) AS days_observed, count(*) FILTER (rn > 0 AND rsum >= 0.254) AS rainy_days, cast(sum(n) AS bigint) AS n FROM day GROUP BY 1, 2"""
_PERIOD_OUT = f"""SELECT device_id, period, {_r(_f('tmin'))} AS temp_min_f, {_r(_f('tmax'))} AS temp_max_f, {_r(_f('tavg'))} AS temp_avg_f, {_RAIN}, {_r(_mph('gmax'))} AS gust_max_mph,
days_observed, rainy_days, n AS obs, rn AS rain_readings"""
_MONTHS = _DAY + f", m AS ({_PERIOD.format(shape='%Y-%m')}), months AS (SELECT device_id, period, cast(left(period, 4) AS int) AS year, cast(right(period, 2) AS int) AS month, {_f('tavg')} AS tavg, {_f('tmin')} AS tmin, {_f('tmax')} AS tmax, CASE WHEN rn > 0 THEN {_in('rsum')} END AS rain, rainy_days FROM m)"
_DAILY_OUT = f"{_r(_f('tmin'))} AS temp_min_f, {_r(_f('tmax'))} AS temp_max_f, {_r(_f('tsum / nullif(tn, 0)'))} AS temp_avg_f, {_RAIN}, rn AS rain_readings, {_r(_mph('gmax'))} AS gust_max_mph, n AS obs"
_DAILY = _DAY + f", daily AS (SELECT device_id, day, {_f('tmin')} AS lo, {_f('tmax')} AS hi, CASE WHEN rn > 0 THEN {_in('rsum')} END AS rain, {_mph('gmax')} AS gust, n FROM day)"


def _spell(name: str, condition: str, source: str = "day") -> str:
    return f"""{name}_run AS (SELECT device_id, count(*) AS len, min(day) AS a, max(day) AS b FROM (SELECT device_id, day, day - cast(row_number() OVER (PARTITION BY device_id ORDER BY day) AS int) AS g FROM {source} WHERE {condition}) GROUP BY device_id, g),
{name} AS (SELECT device_id, max(len) AS {name}_days, first(a ORDER BY len DESC, a) AS {name}_start, first(b ORDER BY len DESC, a) AS {name}_end FROM {name}_run GROUP BY 1)"""


def _spell_out(*names: str) -> tuple[str, str]:
    return ", ".join(f"coalesce({n}_days, 0) AS {n}_days, {n}_start, {n}_end" for n in names), " ".join(f"LEFT JOIN {n} USING (device_id)" for n in names)


_HI = "(-42.379 + 2.04901523*t + 10.14333127*h - 0.22475541*t*h - 0.00683783*t*t - 0.05481717*h*h + 0.00122874*t*t*h + 0.00085282*t*h*h - 0.00000199*t*t*h*h)"
_HEAT = f"""CASE WHEN t IS NULL OR h IS NULL THEN NULL WHEN t < 80 OR h < 0 THEN t WHEN (0.5*(t + 61 + (t-68)*1.2 + h*0.094) + t)/2 < 80 THEN t
WHEN h < 13 AND t <= 112 THEN {_HI} - (13-h)/4*sqrt((17-abs(t-95))/17) WHEN h > 85 AND t <= 87 THEN {_HI} + (h-85)/10*((87-t)/5) ELSE {_HI} END"""
_CHILL = "CASE WHEN t IS NULL OR w IS NULL THEN NULL WHEN t > 50 OR w <= 3 THEN t ELSE 35.74 + 0.6215*t - 35.75*pow(w, 0.16) + 0.4275*t*pow(w, 0.16) END"
_DEW = "CASE WHEN h > 0 THEN 243.12*(ln(h/100) + 17.62*c/(243.12+c)) / (17.62 - (ln(h/100) + 17.62*c/(243.12+c))) END"


def _swings() -> str:
    return f"""means AS (SELECT device_id, day, psum/pn AS m FROM day WHERE pn > 0),
steps AS (SELECT * FROM (SELECT device_id, day, m - lag(m) OVER w AS d, day - lag(day) OVER w AS gap FROM means WINDOW w AS (PARTITION BY device_id ORDER BY day)) WHERE gap = 1),
swings AS (SELECT device_id, {_r(_hg("min(d) FILTER (d < 0)"))} AS largest_fall_inhg, first(day ORDER BY d, day) FILTER (d < 0) AS largest_fall_day, {_r(_hg("max(d) FILTER (d > 0)"))} AS largest_rise_inhg, first(day ORDER BY d DESC, day) FILTER (d > 0) AS largest_rise_day FROM steps GROUP BY 1)"""


def _pairs(found: dict[str, tuple[str, str]], convert: dict[str, Callable[[str], str]], names: dict[str, tuple[str, str]]) -> str:
    return ", ".join(f"{_r(convert.get(k, lambda x: x)(v))} AS {names[k][0]}, {at} AS {names[k][1]}" for k, (v, at) in found.items())


_BUCKETS = """avg(air_temp_c) AS temp_c, min(air_temp_c) AS temp_min_c, max(air_temp_c) AS temp_max_c, avg(humidity) AS humidity, avg(pressure_mb) AS pressure_mb, avg(wind_avg) AS wind_avg,
max(wind_gust) AS gust_max, coalesce(sum(rain_mm), 0) AS rain_mm, max(uv) AS uv_max, avg(solar_wm2) AS solar_wm2, coalesce(sum(strike_count), 0) AS strikes, count(*) AS obs, count(rain_mm) AS rain_readings, count(strike_count) AS lightning_readings"""
_BUCKETS_OUT = ", ".join(_r(c) + f" AS {c}" for c in ["temp_c", "temp_min_c", "temp_max_c", "humidity", "pressure_mb", "wind_avg", "gust_max", "rain_mm", "uv_max", "solar_wm2", "strikes"]) + ", obs, rain_readings, lightning_readings"
_GAPS = _EVENTS + ", steps AS (SELECT device_id, lag(epoch) OVER (PARTITION BY device_id ORDER BY epoch) AS start_epoch, epoch AS end_epoch FROM obs), gap AS (SELECT *, end_epoch - start_epoch AS seconds FROM steps WHERE end_epoch - start_epoch > 3600)"
_TENDENCY = """newest AS (SELECT device_id, max(epoch) AS now, arg_max(pressure_mb, epoch) AS mb FROM obs WHERE pressure_mb IS NOT NULL GROUP BY 1),
near AS (SELECT n.device_id, now, mb, epoch, pressure_mb, row_number() OVER (PARTITION BY n.device_id ORDER BY abs(epoch - (now - {w})), epoch) AS place FROM newest n JOIN obs o ON o.device_id = n.device_id AND pressure_mb IS NOT NULL AND epoch <= now - {half}),
trend AS (SELECT device_id, now AS at_epoch, mb, (now - epoch) / 3600 AS hours, mb - pressure_mb AS change, (mb - pressure_mb) / ((now - epoch) / 3600) * 3 AS rate FROM near WHERE place = 1)"""
_WORDS = "CASE WHEN rate >= 2 THEN 'rising rapidly' WHEN rate >= 0.5 THEN 'rising' WHEN rate <= -2 THEN 'falling rapidly' WHEN rate <= -0.5 THEN 'falling' ELSE 'steady' END"
_DIRECTION = "list_extract([" + ", ".join(f"'{c}'" for c in U.COMPASS) + "], cast(floor(({0} % 360 + 360) % 360 / 22.5 + 0.5) AS int) % 16 + 1)"
_ZONED = "zones AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in derived.ZONES.items()) + ") AS z(device_id, tz))"


def conditions_sql(daily: str, as_of: int, today: str) -> str:
    """Current conditions from an archive; ``daily`` has the observations and their days."""
    return daily + f""", {_TENDENCY.format(w=10800, half=5400)}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY epoch DESC) AS k FROM obs) WHERE k = 1), last AS (SELECT device_id, max(day) AS d, arg_max(coalesce(rain, -1), day) AS rain FROM daily GROUP BY 1),
v AS (SELECT n.device_id, n.epoch, {as_of} - n.epoch AS age_s, air_temp_c AS c, {_f('air_temp_c')} AS t, humidity AS h, {_mph('wind_avg')} AS w, wind_gust, wind_dir, pressure_mb, solar_wm2, uv, strike_dist_km, CASE WHEN last.d = date '{today}' AND last.rain >= 0 THEN last.rain END AS rain, CASE WHEN at_epoch <= n.epoch AND n.epoch - at_epoch < 3600 THEN rate END AS rate FROM n LEFT JOIN last USING (device_id) LEFT JOIN trend USING (device_id))
SELECT device_id, epoch AS at_epoch, age_s, {_r('t')} AS temp_f, {_r('h')} AS humidity, {_r(_f(_DEW))} AS dew_point_f, {_r(f'CASE WHEN t >= 80 THEN {_HEAT} WHEN t <= 50 THEN {_CHILL} ELSE t END')} AS feels_like_f, {_r('w')} AS wind_mph, {_r(_mph('wind_gust'))} AS gust_mph, {_DIRECTION.format('wind_dir')} AS wind_from, {_r(_hg('pressure_mb'))} AS pressure_inhg, {_r('solar_wm2')} AS solar_wm2, {_r('uv')} AS uv, round(strike_dist_km / {U.KM_PER_MILE}, 6) AS strike_miles, {_r('rain')} AS rain_today_in, {_r('rate')} AS change_mb_per_3h, CASE WHEN rate IS NOT NULL THEN {_WORDS} END AS pressure_trend FROM v"""


def oracle_sql() -> dict[str, str]:
    dry, wet = "rn > 0 AND rsum < 0.254", "rn > 0 AND rsum >= 0.254"
    rain_cols, rain_joins = _spell_out("dry_spell", "wet_spell")
    free_cols, free_joins = _spell_out("storm_free")
    temp_cols, temp_joins = _spell_out("heat_wave", "cold_snap")
    names = {k: (f"{k}_{u}", f"{k}_epoch") for k, u in {"hottest": "f", "coldest": "f", "peak_gust": "mph", "lowest_pressure": "inhg", "peak_solar": "wm2", "peak_uv": "index"}.items()}
    extremes = _pairs(
        {"hottest": _top("air_temp_c", "epoch"), "coldest": _low("air_temp_c", "epoch"), "peak_gust": _top("wind_gust", "epoch"), "lowest_pressure": _low("pressure_mb", "epoch"), "peak_solar": _top("solar_wm2", "epoch"), "peak_uv": _top("uv", "epoch")},
        {"hottest": _f, "coldest": _f, "peak_gust": _mph, "lowest_pressure": _hg}, names,
    )
    quarter = _SHIP + """, q AS (SELECT device_id, cast(to_timestamp(epoch - epoch % 900) AT TIME ZONE 'UTC' AS date) AS day, avg(air_temp_c) AS t, avg(air_temp_c) FILTER (humidity IS NOT NULL) AS th, avg(humidity) FILTER (air_temp_c IS NOT NULL) AS hh,
avg(air_temp_c) FILTER (wind_avg IS NOT NULL) AS tw, avg(wind_avg) FILTER (air_temp_c IS NOT NULL) AS ww FROM obs GROUP BY device_id, epoch // 900, day HAVING count(air_temp_c) > 0)"""

    def with_names(expression: str, **columns: str) -> str:
        """A formula over t, h, w or c with other expressions in their place, by a correlated derived table."""
        inner = ", ".join(f"{v} AS {k}" for k, v in columns.items())
        return f"(SELECT {expression} FROM (SELECT {inner}))"

    dates = [("sunniest", "mj", "sunniest_mj", "sunniest_day"), ("solar", "smax", "peak_solar_wm2", "peak_solar_day"), ("uv", "uvmax", "peak_uv", "peak_uv_day"), ("lux", "lmax", "peak_lux", "peak_lux_day")]
    health = ["air_temp_c", "humidity", "pressure_mb", "wind_avg", "uv", "solar_wm2", "illuminance_lux"]
    us = {"wind_lull": ("wind_lull_mph", _mph), "wind_avg": ("wind_avg_mph", _mph), "wind_gust": ("wind_gust_mph", _mph), "pressure_mb": ("pressure_inhg", _hg), "air_temp_c": ("air_temp_f", _f), "rain_mm": ("rain_in", _in), "strike_dist_km": ("strike_dist_mi", lambda c: f"({c} / {U.KM_PER_MILE})")}
    shown = [s for s in SENSORS if s not in ("wind_interval", "precip_type", "report_interval_min")]
    exported = ", ".join(f"round({us[s][1](s) if s in us else s}, 4) AS {us[s][0] if s in us else s}" for s in shown)
    return {
        "append_first_wins": _SHIP + f" SELECT device_id, count(*) AS obs, min(epoch) AS first_epoch, max(epoch) AS last_epoch, {_r('sum(wind_gust)')} AS gusts FROM obs GROUP BY 1",
        "validate_counts": _SHIP + " SELECT device_id, count(*) FILTER (NOT g AND NOT s) AS good, count(*) FILTER (g OR s) AS bad, count(*) FILTER (g) AS bad_gust, count(*) FILTER (s) AS bad_strikes FROM (SELECT device_id, coalesce(wind_gust > 39, false) AS g, coalesce(strike_count = 7, false) AS s FROM raw) GROUP BY 1",
        "export_us": _SHIP + f" SELECT epoch, strftime(to_timestamp(epoch) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || 'Z' AS time, {exported}, device_id, report_interval_min, wind_interval AS wind_interval_s, precip_type, source FROM obs",
        "coverage": _SHIP + " SELECT device_id, count(*) AS obs, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM obs GROUP BY 1",
        "daily_summary": _DAY + f" SELECT device_id, day, {_DAILY_OUT} FROM day",
        "daily_summary_tz": _SHIP + f", {_ZONED}, day AS (SELECT o.device_id, cast(to_timestamp(epoch - epoch % 900) AT TIME ZONE tz AS date) AS day, {_PARTS} FROM obs o JOIN zones z ON z.device_id = o.device_id GROUP BY 1, 2) SELECT device_id, day, {_DAILY_OUT} FROM day",
        "local_hours_tz": _SHIP + f", {_ZONED} SELECT o.device_id, cast(to_timestamp(epoch) AT TIME ZONE tz AS date) AS day, hour(to_timestamp(epoch) AT TIME ZONE tz) AS hour, count(*) AS obs FROM obs o JOIN zones z ON z.device_id = o.device_id GROUP BY 1, 2, 3",
        "hourly_climatology": _SHIP + f", h AS (SELECT device_id, (epoch % 86400) // 3600 AS hour, {_PARTS} FROM obs GROUP BY 1, 2) SELECT device_id, hour, {_r(_f('tsum / nullif(tn, 0)'))} AS temp_avg_f, {_r(_f('tmin'))} AS temp_min_f, {_r(_f('tmax'))} AS temp_max_f, {_r('hsum / nullif(hn, 0)')} AS humidity_avg, {_r(_mph('wsum / nullif(wn, 0)'))} AS wind_avg_mph, {_r(_mph('gmax'))} AS gust_max_mph, n AS obs FROM h",
        "period_summary_month": _DAY + f", m AS ({_PERIOD.format(shape='%Y-%m')}) {_PERIOD_OUT} FROM m",
        "period_summary_year": _DAY + f", m AS ({_PERIOD.format(shape='%Y')}) {_PERIOD_OUT} FROM m",
        "monthly_normals": _MONTHS + f" SELECT device_id, month, count(*) AS years, {_r('avg(tavg)')} AS temp_avg_f, {_r('avg(tmin)')} AS temp_min_f, {_r('avg(tmax)')} AS temp_max_f, count(rain) AS rain_years, {_r('avg(rain)')} AS rain_in, {_r('avg(rainy_days) FILTER (rain IS NOT NULL)')} AS rainy_days FROM months GROUP BY 1, 2",
        "this_day": _DAY + f" SELECT device_id, year(day) AS year, {_DAILY_OUT} FROM day WHERE month(day) = {DATE[0]} AND day(day) = {DATE[1]}",
        "this_day_records": _DAILY + f", y AS (SELECT device_id, year(day) AS year, lo, hi, rain FROM daily WHERE month(day) = {DATE[0]} AND day(day) = {DATE[1]}) SELECT device_id, " + _pairs({"h": _top("hi", "year"), "l": _low("lo", "year"), "w": _top("rain", "year")}, {}, {"h": ("record_high_f", "record_high_year"), "l": ("record_low_f", "record_low_year"), "w": ("wettest_in", "wettest_year")}) + " FROM y GROUP BY 1",
        "records": _DAY + f", e AS (SELECT device_id, {extremes}, {_r('sum(strike_count)')} AS total_strikes FROM obs GROUP BY 1), wet AS (SELECT device_id, {_r(_in('max(rsum) FILTER (rsum > 0)'))} AS wettest_day_in, first(day ORDER BY rsum DESC, day) FILTER (rsum > 0) AS wettest_day FROM day GROUP BY 1) SELECT * FROM e LEFT JOIN wet USING (device_id)",
        "rain_stats": _DAY + f", {_spell('dry_spell', dry)}, {_spell('wet_spell', wet)}, s AS (SELECT device_id, cast(sum(n) AS bigint) AS observations, cast(sum(rn) AS bigint) AS rain_readings, {_r('sum(' + _in('rsum') + ') FILTER (rn > 0)')} AS total_in, count(*) AS days_observed, count(*) FILTER ({wet}) AS rainy_days, {_r(_in('max(rsum) FILTER (rsum > 0)'))} AS wettest_day_in, first(day ORDER BY rsum DESC, day) FILTER (rsum > 0) AS wettest_day FROM day GROUP BY 1) SELECT s.*, {rain_cols} FROM s {rain_joins}",
        "wind_stats": _DAY + f" SELECT device_id, cast(sum(wn) AS bigint) AS wind_readings, {_r(_mph('sum(wsum) / nullif(sum(wn), 0)'))} AS mean_mph, " + _pairs({"s": _top("wmax"), "g": _top("gmax"), "w": _top("wsum / nullif(wn, 0)")}, {"s": _mph, "g": _mph, "w": _mph}, {"s": ("max_sustained_mph", "max_sustained_day"), "g": ("peak_gust_mph", "peak_gust_day"), "w": ("windiest_mean_mph", "windiest_day")}) + f", {_r('100.0e0 * sum(calm) / nullif(sum(wn), 0)')} AS calm_pct FROM day GROUP BY 1",
        "wind_rose": _SHIP + f""", dev AS (SELECT device_id, count(*) AS obs, count(*) FILTER (wind_avg < 0.5) AS calm, count(*) FILTER (wind_avg >= 0.5 AND wind_dir IS NOT NULL) AS placed FROM obs WHERE wind_avg IS NOT NULL GROUP BY 1),
s AS (SELECT device_id, cast(floor(((wind_dir % 360) + 360) % 360 / 22.5 + 0.5) AS int) % 16 AS sector, count(*) AS n, avg(wind_avg) AS mean, max(wind_gust) AS gust FROM obs WHERE wind_avg >= 0.5 AND wind_dir IS NOT NULL GROUP BY 1, 2)
SELECT dev.device_id, k.sector, list_extract([{', '.join(f"'{c}'" for c in U.COMPASS)}], k.sector + 1) AS direction, coalesce(s.n, 0) AS count, {_r('coalesce(100.0e0 * s.n / placed, 0)')} AS pct, {_r(_mph('s.mean'))} AS mean_mph, {_r(_mph('s.gust'))} AS gust_max_mph, {_r('100.0e0 * calm / obs')} AS calm_pct, obs
FROM dev CROSS JOIN (SELECT cast(unnest(range(16)) AS int) AS sector) k LEFT JOIN s ON s.device_id = dev.device_id AND s.sector = k.sector""",
        "solar_stats": _DAY + f" SELECT device_id, count(*) AS days_observed, {_r('sum(mj)')} AS total_mj, {_r('avg(mj)')} AS mean_daily_mj, " + _pairs({k: _top(c) for k, c, *_ in dates}, {}, {k: (a, b) for k, _, a, b in dates}) + " FROM day GROUP BY 1",
        "lightning_stats": _DAY + f", {_spell('storm_free', 'sn > 0 AND ssum = 0')}, s AS (SELECT device_id, CASE WHEN sum(sn) > 0 THEN {_r('sum(ssum)')} END AS total_strikes, count(*) FILTER (ssum > 0) AS storm_days, min(day) FILTER (ssum > 0) AS first_storm_day, max(day) FILTER (ssum > 0) AS last_storm_day, count(*) AS days_observed, {_r('max(ssum) FILTER (ssum > 0)')} AS busiest_strikes, first(day ORDER BY ssum DESC, day) FILTER (ssum > 0) AS busiest_day, round(min(close) / {U.KM_PER_MILE}, 6) AS closest_miles, {_low('close')[1]} AS closest_day FROM day GROUP BY 1) SELECT s.*, {free_cols} FROM s {free_joins}",
        "pressure_swings": _DAY + f", {_swings()} SELECT * FROM swings",
        "pressure_stats": _DAY + f", {_swings()}, s AS (SELECT device_id, count(*) AS days_observed, {_r(_hg('sum(psum) / nullif(sum(pn), 0)'))} AS mean_inhg, " + _pairs({"l": _low("pmin"), "h": _top("pmax")}, {"l": _hg, "h": _hg}, {"l": ("lowest_inhg", "lowest_day"), "h": ("highest_inhg", "highest_day")}) + " FROM day GROUP BY 1) SELECT * FROM s LEFT JOIN swings USING (device_id)",
        "comfort_stats": quarter + f""", p AS (SELECT device_id, day, CASE WHEN {_f('th')} >= 80 THEN {with_names(_HEAT, t=_f('th'), h='hh')} END AS hot, CASE WHEN {_f('tw')} <= 50 THEN {with_names(_CHILL, t=_f('tw'), w=_mph('ww'))} END AS cold,
CASE WHEN {_f('t')} > 50 AND {_f('t')} < 80 THEN {_f('t')} END AS mild, {_f(with_names(_DEW, c='th', h='hh'))} AS dew FROM q), r AS (SELECT device_id, day, greatest(hot, cold, mild) AS most, least(hot, cold, mild) AS least, dew FROM p)
SELECT device_id, count(DISTINCT day) AS days_observed, """ + _pairs({"h": _top("most"), "c": _low("least"), "m": _top("dew")}, {}, {"h": ("hottest_feels_like_f", "hottest_feels_like_day"), "c": ("coldest_feels_like_f", "coldest_feels_like_day"), "m": ("muggiest_dew_point_f", "muggiest_day")}) + " FROM r GROUP BY 1",
        "sensor_health": _SHIP + ", a AS (SELECT device_id, count(*) AS obs, max(epoch) AS newest, min(battery_v) AS lo, max(battery_v) AS hi FROM obs GROUP BY 1) " + " UNION ALL ".join(f"SELECT a.device_id, '{s}' AS sensor, count({s}) AS readings, {_r(f'100.0e0 * count({s}) / any_value(a.obs)')} AS coverage_pct, max(epoch) FILTER ({s} IS NOT NULL) AS last_epoch, coalesce(max(epoch) FILTER ({s} IS NOT NULL) < any_value(newest) - 3600, false) AS stale, {_r('any_value(lo)')} AS battery_min_v, {_r('any_value(hi)')} AS battery_max_v FROM obs JOIN a USING (device_id) GROUP BY a.device_id" for s in health),
        "degree_days": _DAILY + f" SELECT device_id, coalesce(period, 'total') AS period, {_r('sum(greatest(65 - mean, 0))')} AS hdd, {_r('sum(greatest(mean - 65, 0))')} AS cdd, {_r('sum(greatest((least(hi, 86) + greatest(lo, 50)) / 2 - 50, 0))')} AS gdd, count(*) AS days_used FROM (SELECT *, (hi + lo) / 2 AS mean, strftime(day, '%Y-%m') AS period FROM daily WHERE lo IS NOT NULL) GROUP BY GROUPING SETS ((device_id), (device_id, period))",
        "climate_indices": _DAILY + " SELECT device_id, coalesce(period, 'total') AS period, count(*) FILTER (lo < 32) AS frost_days, count(*) FILTER (hi < 32) AS ice_days, count(*) FILTER (hi >= 77) AS summer_days, count(*) FILTER (hi >= 90) AS hot_days, count(*) FILTER (lo >= 68) AS tropical_nights, count(*) AS days_used FROM (SELECT *, strftime(day, '%Y') AS period FROM daily WHERE lo IS NOT NULL) GROUP BY GROUPING SETS ((device_id), (device_id, period))",
        "temperature_spells": _DAILY + f", {_spell('heat_wave', 'hi >= 90', 'daily')}, {_spell('cold_snap', 'lo <= 32', 'daily')}, s AS (SELECT device_id, count(*) AS days_observed FROM daily GROUP BY 1) SELECT s.*, {temp_cols} FROM s {temp_joins}",
        "temperature_trend": _MONTHS + f""", t AS (SELECT * FROM months WHERE tavg IS NOT NULL), f AS (SELECT *, year - min(year) OVER g AS x, tavg - first_value(tavg) OVER (PARTITION BY device_id, month ORDER BY year) AS y, tavg - avg(tavg) OVER g AS anom FROM t WINDOW g AS (PARTITION BY device_id, month)),
c AS (SELECT *, x - avg(x) OVER g AS cx, y - avg(y) OVER g AS cy FROM f WINDOW g AS (PARTITION BY device_id, month))
SELECT device_id, count(DISTINCT year) AS years, count(*) AS months_used, min(period) AS first_month, max(period) AS last_month, {_r('sum(cx*cy) / nullif(sum(cx*cx), 0) * 10')} AS slope_per_decade_f, {_r('sum(cx*cy) * sum(cx*cy) / nullif(sum(cx*cx) * sum(cy*cy), 0)')} AS r_squared, """ + _pairs({"w": _top("anom", "period"), "c": _low("anom", "period")}, {}, {"w": ("warmest_anomaly_f", "warmest_month"), "c": ("coldest_anomaly_f", "coldest_month")}) + " FROM c GROUP BY 1",
        "month_anomalies": _MONTHS + f" SELECT device_id, period, month, {_r('tavg')} AS temp_avg_f, {_r('avg(tavg) OVER g')} AS normal_f, {_r('tavg - avg(tavg) OVER g')} AS anomaly_f FROM months WHERE tavg IS NOT NULL WINDOW g AS (PARTITION BY device_id, month)",
        "view_summary_week": _DAILY + f" SELECT device_id, cast(date_trunc('week', day) AS date) AS period_start, {_r('max(hi)')} AS high_f, {_r('min(lo)')} AS low_f, {_r('max(gust)')} AS gust_max_mph, {_r('sum(rain)')} AS rain_in, count(*) FILTER (rain >= 0.01) AS rainy_days, count(*) AS observed_days, 7 AS calendar_days FROM daily GROUP BY 1, 2",
        "view_summary_month": _DAILY + f" SELECT device_id, cast(date_trunc('month', day) AS date) AS period_start, {_r('max(hi)')} AS high_f, {_r('min(lo)')} AS low_f, {_r('max(gust)')} AS gust_max_mph, {_r('sum(rain)')} AS rain_in, count(*) FILTER (rain >= 0.01) AS rainy_days, count(*) AS observed_days, date_diff('day', cast(date_trunc('month', min(day)) AS date), cast(date_trunc('month', min(day)) + INTERVAL 1 MONTH AS date)) AS calendar_days FROM daily GROUP BY 1, 2",
        "view_summary_year": _DAILY + f" SELECT device_id, cast(date_trunc('year', day) AS date) AS period_start, {_r('max(hi)')} AS high_f, {_r('min(lo)')} AS low_f, {_r('max(gust)')} AS gust_max_mph, {_r('sum(rain)')} AS rain_in, count(*) FILTER (rain >= 0.01) AS rainy_days, count(*) AS observed_days, date_diff('day', cast(date_trunc('year', min(day)) AS date), cast(date_trunc('year', min(day)) + INTERVAL 1 YEAR AS date)) AS calendar_days FROM daily GROUP BY 1, 2",
        "rank_days_gust": _DAILY + f" SELECT device_id, rank, day, {_r('gust')} AS gust_max_mph FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY gust DESC NULLS LAST, day) AS rank FROM daily) WHERE rank <= 10",
        "calendar_grid": _DAILY + f" SELECT v.device_id, v.day, {_r('hi')} AS temp_max_f, {_r('rain')} AS rain_in FROM (SELECT device_id, cast(unnest(generate_series(date '{YEAR}-01-01', date '{YEAR}-12-31', interval 1 day)) AS date) AS day FROM (SELECT DISTINCT device_id FROM daily)) v LEFT JOIN daily USING (device_id, day)",
        "month_strip": _MONTHS + f" SELECT v.device_id, v.month, '{YEAR}-' || lpad(cast(v.month AS varchar), 2, '0') AS period, {_r('tavg')} AS temp_avg_f, {_r('rain')} AS rain_in FROM (SELECT device_id, unnest(range(1, 13)) AS month FROM (SELECT DISTINCT device_id FROM months)) v LEFT JOIN months m ON m.device_id = v.device_id AND m.month = v.month AND m.year = {YEAR}",
        "normalise_metric": _MONTHS + f" SELECT device_id, period, {_r('tavg')} AS temp_avg_f, {_r('CASE WHEN max(tavg) OVER g > min(tavg) OVER g THEN (tavg - min(tavg) OVER g) / (max(tavg) OVER g - min(tavg) OVER g) WHEN tavg IS NOT NULL THEN 0.5 END')} AS scaled FROM months WINDOW g AS (PARTITION BY device_id)",
        "conditions_archive": conditions_sql(_DAILY, 1_004_918_400, "2001-11-05"),
        "station_info": _SHIP + f", {_ZONED} SELECT z.device_id, any_value(n_regionkey) AS station_id, any_value(n_name) AS name, any_value(tz) AS tz, count(epoch) AS obs, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM zones z JOIN nation ON n_nationkey = z.device_id LEFT JOIN obs o ON o.device_id = z.device_id GROUP BY 1",
        "comfort_formulas": _SHIP + f", v AS (SELECT device_id, epoch, air_temp_c AS c, {_f('air_temp_c')} AS t, humidity AS h, {_mph('wind_avg')} AS w FROM obs) SELECT device_id, epoch, {_r(_f(_DEW))} AS dew_point_f, {_r(_HEAT)} AS heat_index_f, {_r(_CHILL)} AS wind_chill_f, {_r(f'CASE WHEN t >= 80 THEN {_HEAT} WHEN t <= 50 THEN {_CHILL} ELSE t END')} AS apparent_temp_f FROM v",
        "feels_like": _SHIP + f", v AS (SELECT device_id, epoch, {_f('air_temp_c')} AS t, humidity AS h, {_mph('wind_avg')} AS w FROM obs) SELECT device_id, epoch, {_r(f'CASE WHEN t >= 80 THEN {_HEAT} WHEN t <= 50 THEN {_CHILL} ELSE t END')} AS feels_like_f FROM v",
        "compass": _SHIP + f" SELECT device_id, {_DIRECTION.format('wind_dir')} AS direction, count(*) AS obs FROM obs GROUP BY 1, 2",
        "recipe_rain_coverage": _SHIP + f" SELECT device_id, strftime(to_timestamp(epoch) AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS stored_rows, count(rain_mm) AS rain_readings, {_r('sum(rain_mm)')} AS rain_mm, round(sum(rain_mm) / 25.4, 3) AS rain_in FROM obs GROUP BY 1, 2",
        "recipe_top_gust_days": _SHIP + f", g AS (SELECT device_id, {_UTC.format('epoch')} AS utc_day, round(max(wind_gust) * 2.2369362921, 1) AS peak_gust_mph, round(avg(wind_avg) * 2.2369362921, 1) AS mean_wind_mph, count(wind_gust) AS gust_readings, count(wind_avg) AS wind_readings FROM obs GROUP BY 1, 2 HAVING count(wind_gust) > 0) SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY peak_gust_mph DESC, utc_day) AS k FROM g) WHERE k <= 5",
        "recipe_latest_temperatures": _SHIP + " SELECT device_id, epoch, air_temp_c FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY epoch DESC) AS k FROM obs WHERE air_temp_c IS NOT NULL) WHERE k <= 10",
        "latest": _EVENTS + f" SELECT device_id, epoch, {', '.join(f'{_r(c)} AS {c}' for c in ['air_temp_c', 'wind_avg', 'rain_mm', 'strike_count', 'pressure_mb'])} FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY epoch DESC) AS k FROM obs) WHERE k = 1",
        "watermark": _EVENTS + " SELECT device_id, max(epoch) AS watermark FROM obs GROUP BY 1",
        "gaps": _GAPS + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seconds DESC, start_epoch) AS rank FROM gap) WHERE rank <= 10",
        "all_gaps": _GAPS + " SELECT * FROM gap",
        "pressure_tendency": _EVENTS + f", {_TENDENCY.format(w=86400, half=43200)} SELECT device_id, at_epoch, {_r(_hg('mb'))} AS current_inhg, {_r('hours')} AS window_hours, {_r(_hg('change'))} AS change_inhg, {_r('rate')} AS change_mb_per_3h, {_WORDS} AS category FROM trend",
        "series_hourly": _EVENTS + f", b AS (SELECT device_id, epoch // 3600 * 3600 AS bucket_epoch, {_BUCKETS} FROM obs GROUP BY 1, 2) SELECT device_id, bucket_epoch, {_BUCKETS_OUT} FROM b",
        "series_auto": _EVENTS + f""", c AS (SELECT device_id, min(epoch) AS a, max(epoch) AS z FROM obs GROUP BY 1), w AS (SELECT device_id, min(k * 60) AS bucket_s FROM (SELECT device_id, a, z, unnest(range(1, 1000)) AS k FROM c) WHERE z // (k * 60) - a // (k * 60) + 1 <= 100 GROUP BY 1)
SELECT device_id, bucket_s, false AS coarsened, epoch // bucket_s * bucket_s AS bucket_epoch, {_r('avg(air_temp_c)')} AS temp_c, {_r('coalesce(sum(rain_mm), 0)')} AS rain_mm, count(*) AS obs FROM obs JOIN w USING (device_id) GROUP BY 1, 2, 4""",
        "day_profile": _EVENTS + f""", b AS (SELECT device_id, epoch // 1800 * 1800 AS bucket_epoch, {_BUCKETS} FROM obs GROUP BY 1, 2), v AS (SELECT device_id, unnest(range(cast(epoch(date '{DAY}') AS bigint), cast(epoch(date '{DAY}') AS bigint) + 86400, 1800)) AS bucket_epoch FROM (SELECT DISTINCT device_id FROM obs))
SELECT device_id, bucket_epoch, {_r('temp_c')} AS temp_c, CASE WHEN rain_readings > 0 THEN {_r('rain_mm')} END AS rain_mm, obs, rain_readings FROM v LEFT JOIN b USING (device_id, bucket_epoch)""",
        "day_profile_tz": _EVENTS + f""", {_ZONED}, b AS (SELECT device_id, epoch // 1800 * 1800 AS bucket_epoch, {_BUCKETS} FROM obs GROUP BY 1, 2),
d AS (SELECT o.device_id, cast(epoch(timezone(z.tz, timestamp '{DAY} 00:00:00')) AS bigint) AS a, cast(epoch(timezone(z.tz, timestamp '{DAY} 00:00:00' + INTERVAL 1 DAY)) AS bigint) AS e FROM (SELECT DISTINCT device_id FROM obs) o JOIN zones z ON z.device_id = o.device_id % 4 + 1),
v AS (SELECT device_id, unnest(range(a // 1800 * 1800, e, 1800)) AS bucket_epoch FROM d)
SELECT device_id, bucket_epoch, {_r('temp_c')} AS temp_c, CASE WHEN rain_readings > 0 THEN {_r('rain_mm')} END AS rain_mm, obs, rain_readings FROM v LEFT JOIN b USING (device_id, bucket_epoch)""",
        "archive_status": _GAPS + f", c AS (SELECT device_id, count(*) AS obs, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM obs GROUP BY 1), g AS (SELECT device_id, least(count(*), 10) AS n_gaps, max(seconds) AS largest_gap_s FROM gap GROUP BY 1) SELECT device_id, obs, first_epoch, last_epoch, {_r('(last_epoch - first_epoch) / 86400')} AS span_days, {AS_OF} - last_epoch AS age_s, {AS_OF} - last_epoch >= 0 AND {AS_OF} - last_epoch < 3600 AS fresh, coalesce(n_gaps, 0) AS n_gaps, largest_gap_s FROM c LEFT JOIN g USING (device_id)",
        "missing_windows": _EVENTS + f""", o AS (SELECT * FROM obs WHERE epoch BETWEEN {WINDOW[0]} AND {WINDOW[1]}), c AS (SELECT v.device_id, min(epoch) AS a, max(epoch) AS z FROM (SELECT DISTINCT device_id FROM obs) v LEFT JOIN o USING (device_id) GROUP BY 1), s AS (SELECT device_id, lag(epoch) OVER (PARTITION BY device_id ORDER BY epoch) AS a, epoch AS b FROM o),
h AS (SELECT device_id, {WINDOW[0]} AS a, {WINDOW[1]} AS b FROM c WHERE a IS NULL UNION ALL SELECT device_id, {WINDOW[0]}, a - 1 FROM c WHERE a - {WINDOW[0]} > 3600 UNION ALL SELECT device_id, z + 1, {WINDOW[1]} FROM c WHERE {WINDOW[1]} - z > 3600 UNION ALL SELECT device_id, a + 1, b - 1 FROM s WHERE b - a > 3600)
SELECT device_id, start_epoch, least(start_epoch + 431999, b) AS end_epoch FROM (SELECT device_id, b, unnest(range(a, b + 1, 432000)) AS start_epoch FROM h)""",
        "range_scan": _EVENTS + f" SELECT device_id, epoch, {_r('air_temp_c')} AS air_temp_c, {_r('rain_mm')} AS rain_mm FROM obs WHERE epoch BETWEEN {RANGE[0] + 86400} AND {RANGE[0] + 5 * 86400}",
        "coverage_labels": _EVENTS + f" SELECT device_id, {_UTC.format('epoch')} AS day, CASE WHEN count(rain_mm) = 0 THEN 'missing' WHEN count(rain_mm) < count(*) THEN 'partial' ELSE 'complete' END AS rain_coverage, {_r('sum(rain_mm)')} AS rain_mm FROM obs GROUP BY 1, 2",
        "station_semi_join": _EVENTS + f", {_ZONED} SELECT DISTINCT device_id FROM obs WHERE device_id IN (SELECT z.device_id FROM zones z JOIN nation ON n_nationkey = z.device_id WHERE n_regionkey = 1)",
    }
