"""The observation schema, its accepted ranges and the archive's derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sensor column, accepted low, accepted high, whole numbers only; in stored order.
BOUNDS = [
    ("wind_lull", 0, 200, False),
    ("wind_avg", 0, 200, False),
    ("wind_gust", 0, 200, False),
    ("wind_dir", 0, 360, False),
    ("wind_interval", 0, 3600, False),
    ("pressure_mb", 0, 2000, False),
    ("air_temp_c", -150, 150, False),
    ("humidity", 0, 100, False),
    ("illuminance_lux", 0, 10_000_000, False),
    ("uv", 0, 100, False),
    ("solar_wm2", 0, 5000, False),
    ("rain_mm", 0, 10_000, False),
    ("precip_type", 0, 3, True),
    ("strike_dist_km", 0, 1000, False),
    ("strike_count", 0, 1_000_000, True),
    ("battery_v", 0, 20, False),
    ("report_interval_min", 0, 1440, False),
]
LAST_EPOCH = 253_402_300_799
SENSORS = [name for name, *_ in BOUNDS]
#: What an observation shows by default; the rest is metadata.
METADATA = ["wind_interval", "precip_type", "report_interval_min"]
PRESENTED = [s for s in SENSORS if s not in METADATA]

OBS = T.StructType(
    [T.StructField("device_id", T.LongType()), T.StructField("epoch", T.LongType())]
    + [T.StructField(s, T.DoubleType()) for s in SENSORS]
    + [T.StructField("source", T.StringType())]
)


def align_schema(df: DataFrame) -> DataFrame:
    """``df`` with exactly the observation columns; absent ones are null, present ones are cast."""
    there = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in OBS])


def month_of(epoch: Column) -> Column:
    """UTC month as yyyymm: the archive's partition column."""
    ts = F.timestamp_seconds(epoch)
    return F.year(ts) * 100 + F.month(ts)
