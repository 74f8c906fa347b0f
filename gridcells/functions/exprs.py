"""Scalar maths of the grid fields as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_378_137.0


def heat_index_c(temp_c: Column, humidity: Column) -> Column:
    """NWS heat index in Celsius: the simple form, the full regression where its
    mean with the temperature reaches 80 F, and the two humidity adjustments."""
    t, r = temp_c * 9 / 5 + 32, humidity
    simple = 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + r * 0.094)
    full = (
        -42.379 + 2.04901523 * t + 10.14333127 * r - 0.22475541 * t * r - 6.83783e-3 * t * t
        - 5.481717e-2 * r * r + 1.22874e-3 * t * t * r + 8.5282e-4 * t * r * r - 1.99e-6 * t * t * r * r
    )
    dry = (13 - r) / 4 * F.sqrt(F.greatest((17 - F.abs(t - 95.0)) / 17, F.lit(0.0)))
    wet = (r - 85) / 10 * ((87 - t) / 5)
    full = full - F.when((r < 13) & t.between(80, 112), dry).otherwise(0.0) + F.when((r > 85) & t.between(80, 87), wet).otherwise(0.0)
    f = F.when((simple + t) / 2 >= 80, full).otherwise(simple)
    return (f - 32) * 5 / 9


def fire_weather_index(temp_c: Column, humidity: Column, wind_ms: Column) -> Column:
    """Fosberg fire weather index, 0 to 100."""
    t, h, u = temp_c * 9 / 5 + 32, clip(humidity, 0.0, 100.0), wind_ms * 2.23694
    moisture = (
        F.when(h < 10, 0.03229 + 0.281073 * h - 0.000578 * h * t)
        .when(h < 50, 2.22749 + 0.160107 * h - 0.01478 * t)
        .otherwise(21.0606 + 0.005565 * h * h - 0.00035 * h * t - 0.483199 * h)
    )
    m = clip(moisture, 0.0, 30.0) / 30
    eta = 1 - 2 * m + 1.5 * m * m - 0.5 * m * m * m
    return clip(eta * F.sqrt(1 + u * u) / 0.3002, 0.0, 100.0)


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def quantise(x: Column, low: float, step: float) -> Column:
    """Steps above ``low`` clipped to 0..254; 255 for no data."""
    return F.when(x.isNull() | F.isnan(x), 255).otherwise(F.greatest(F.least(F.rint((x - low) / step), F.lit(254.0)), F.lit(0.0))).cast("int")


def quantise_sqrt(x: Column, scale: float = 16.0) -> Column:
    q = F.greatest(F.least(F.rint(scale * F.sqrt(F.greatest(x, F.lit(0.0)))), F.lit(254.0)), F.lit(0.0))
    return F.when(x.isNull() | F.isnan(x), 255).otherwise(q).cast("int")


def pack_nibbles(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("int"), 4).bitwiseOR(low.cast("int"))


def high_nibble(x: Column) -> Column:
    return F.shiftright(x, 4)


def low_nibble(x: Column) -> Column:
    return x.bitwiseAND(15)


def dequantise_signed_square(e: Column) -> Column:
    return F.signum(e) * F.pow(e / 127.5, F.lit(2.0))


def normalised_difference(a: Column, b: Column, offset: float = 0.0, floor: float = 1.0) -> Column:
    """(a - b) / (a + b) of positive bands, after an offset, floored."""
    fixed = lambda x: F.greatest(x - offset, F.lit(floor))
    return F.when((a > 0) & (b > 0), (fixed(a) - fixed(b)) / (fixed(a) + fixed(b)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def index_year(k: Column, base: int = 2016) -> Column:
    return F.when(k > 0, base + F.floor((k - 1) / 2)).cast("int")


def index_date(k: Column, base: int = 2016) -> Column:
    """First day of the half year that a date index names."""
    return F.when(k > 0, F.make_date(index_year(k, base), F.when(k % 2 == 1, 1).otherwise(7), F.lit(1)))


def units_since(value: Column, unit: str, base: str) -> Column:
    seconds = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[unit]
    return F.timestamp_seconds(F.unix_timestamp(F.lit(base).cast("timestamp")) + (value * seconds).cast("long"))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EARTH_M, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * EARTH_M


def web_mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_M), F.degrees(2 * F.atan(F.exp(y / EARTH_M)) - math.pi / 2)


def tile_index(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n)
    return x.cast("int"), y.cast("int")


def lambert_conic(lon: Column, lat: Column, lon0: float, lat0: float, lat1: float, lat2: float, radius: float = 6_370_000.0) -> tuple[Column, Column]:
    """Spherical Lambert conformal conic forward."""
    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    t = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(p1) if p1 == p2 else math.log(math.cos(p1) / math.cos(p2)) / math.log(t(p2) / t(p1))
    f = math.cos(p1) * t(p1) ** n / n
    rho = radius * f / F.pow(F.tan(math.pi / 4 + F.radians(lat) / 2), F.lit(n))
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), radius * f / t(p0) ** n - rho * F.cos(theta)


def lambert_conic_inverse(x: Column, y: Column, lon0: float, lat0: float, lat1: float, lat2: float, radius: float = 6_370_000.0) -> tuple[Column, Column]:
    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    t = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(p1) if p1 == p2 else math.log(math.cos(p1) / math.cos(p2)) / math.log(t(p2) / t(p1))
    f = math.cos(p1) * t(p1) ** n / n
    top = radius * f / t(p0) ** n - y
    rho = F.sqrt(x * x + top * top) * (1 if n > 0 else -1)
    return lon0 + F.degrees(F.atan2(x, top) / n), F.degrees(2 * F.atan(F.pow(radius * f / rho, F.lit(1 / n))) - math.pi / 2)


def albers(lon: Column, lat: Column, lon0: float, lat0: float, lat1: float, lat2: float, radius: float = 6_370_997.0) -> tuple[Column, Column]:
    """Spherical Albers equal-area conic forward."""
    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    rho = radius / n * F.sqrt(c - 2 * n * F.sin(F.radians(lat)))
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), radius / n * math.sqrt(c - 2 * n * math.sin(p0)) - rho * F.cos(theta)


def pixel_centre(index: Column, origin: float, step: float) -> Column:
    """Centre coordinate of a row or column; the step may be negative."""
    return origin + (index + 0.5) * step


def pixel_of(x: Column, origin: float, step: float) -> Column:
    return F.floor((x - origin) / step).cast("long")


def planar_distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def equirect_m(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    return F.hypot((lat1 - lat0) * 111_000.0, (lon1 - lon0) * 111_000.0 * F.cos(F.radians(lat0)))


def sigmoid(x: Column) -> Column:
    """Of x within -40 and 40, like in the SQL: a null, which both bounds pass over, counts as -40."""
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-40.0)), F.lit(40.0))))


def stretch(x: Column, low: Column, high: Column) -> Column:
    """0..1 between two bounds; null where they coincide."""
    return clip(F.try_divide(x - low, high - low), 0.0, 1.0)


def case_bins(x: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step (in descending order) that x reaches."""
    return reduce(lambda acc, s: acc.when(x >= s[0], s[1]), steps[1:], F.when(x >= steps[0][0], steps[0][1])).otherwise(otherwise)
