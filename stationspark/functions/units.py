"""Unit conversions and derived weather quantities. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion factors and compass points.
MPH_PER_MPS = 2.2369362920544
INHG_PER_MB = 0.02952998057228486
MM_PER_INCH = 25.4
KM_PER_MILE = 1.609344
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def c_to_f(c: Column) -> Column:
    return c * 9 / 5 + 32


def mps_to_mph(v: Column) -> Column:
    return v * MPH_PER_MPS


def mb_to_inhg(p: Column) -> Column:
    return p * INHG_PER_MB


def mm_to_inch(r: Column) -> Column:
    return r / MM_PER_INCH


def km_to_mile(d: Column) -> Column:
    return d / KM_PER_MILE


def sector(degrees: Column) -> Column:
    """0 to 15 of the sixteen compass sectors; any heading is wrapped into one turn first."""
    return (F.floor(F.pmod(degrees, F.lit(360.0)) / 22.5 + 0.5) % 16).cast("int")


def sector_name(number: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, COMPASS)), number + 1)


def compass(degrees: Column) -> Column:
    return sector_name(sector(degrees))


def dew_point_c(temp_c: Column, humidity: Column) -> Column:
    """Magnus form; not defined without moisture."""
    g = F.log(F.when(humidity > 0, humidity) / 100) + 17.62 * temp_c / (243.12 + temp_c)
    return 243.12 * g / (17.62 - g)


def heat_index_f(t: Column, rh: Column) -> Column:
    """Rothfusz regression with its dry and humid corrections, where the simple form reaches 80 degrees."""
    simple = 0.5 * (t + 61 + (t - 68) * 1.2 + rh * 0.094)
    # The published regression.
    full = (
        -42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 0.00683783 * t * t - 0.05481717 * rh * rh
        + 0.00122874 * t * t * rh + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh
    )
    dry = (13 - rh) / 4 * F.sqrt((17 - F.abs(t - 95)) / 17)
    humid = (rh - 85) / 10 * ((87 - t) / 5)
    corrected = F.when((rh < 13) & t.between(80, 112), full - dry).when((rh > 85) & t.between(80, 87), full + humid).otherwise(full)
    found = F.when((t < 80) | (rh < 0), t).when((simple + t) / 2 < 80, t).otherwise(corrected)
    return F.when(t.isNotNull() & rh.isNotNull(), found)


def wind_chill_f(t: Column, mph: Column) -> Column:
    v = F.pow(F.greatest(mph, F.lit(0.0)), F.lit(0.16))
    found = F.when((t > 50) | (mph <= 3), t).otherwise(35.74 + 0.6215 * t - 35.75 * v + 0.4275 * t * v)
    return F.when(t.isNotNull() & mph.isNotNull(), found)


def apparent_temp_f(t: Column, rh: Column, mph: Column) -> Column:
    """What each band needs must be there: humidity from 80 degrees up, wind from 50 down, neither between."""
    return F.when(t >= 80, heat_index_f(t, rh)).when(t <= 50, wind_chill_f(t, mph)).otherwise(t)


def feels_like_f(temp_c: Column, humidity: Column, wind_mps: Column) -> Column:
    return apparent_temp_f(c_to_f(temp_c), humidity, mps_to_mph(wind_mps))


def known_total(reads: Column, total: Column) -> Column:
    """A total where there was a reading, else null: missing is not zero."""
    return F.when(reads > 0, total)


def coverage_label(reads: Column, observations: Column) -> Column:
    return F.when(reads == 0, "missing").when(reads < observations, "partial").otherwise("complete")
