"""Hand-made observation rows."""

from pyspark.sql import types as T

from stationspark.schema import OBS, SENSORS

KEYS = {"temp": "air_temp_c", "wind": "wind_avg", "gust": "wind_gust", "dir": "wind_dir", "rain": "rain_mm", "strikes": "strike_count", "dist": "strike_dist_km", "solar": "solar_wm2", "uv": "uv", "lux": "illuminance_lux", "hum": "humidity", "pres": "pressure_mb", "interval": "report_interval_min", "battery": "battery_v"}


def obs(spark, rows, device=1):
    """Rows as dicts with epoch and any of KEYS; what is left out is missing."""
    out = []
    for r in rows:
        named = {KEYS[k]: float(v) for k, v in r.items() if k in KEYS and v is not None}
        out.append((r.get("device", device), int(r["epoch"]), *[named.get(s) for s in SENSORS], "rest"))
    return spark.createDataFrame(out, OBS)


def day_epoch(text, hour=12):
    import datetime as dt

    d = dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)
    return int(d.timestamp()) + hour * 3600


ZONES = T.StructType([T.StructField("device_id", T.LongType()), T.StructField("tz", T.StringType())])
