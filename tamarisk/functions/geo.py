"""Map projection as column arithmetic.

WGS 84 to a UTM zone by the transverse Mercator series of Snyder, "Map Projections: A Working
Manual" (USGS Professional Paper 1395), equations 8-9 to 8-13. Good to less than a metre
inside the zone.
"""

from __future__ import annotations

from math import radians

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarisk.functions.numeric import col

#: Ellipsoid of WGS 84 and the UTM scale (fixed values).
AXIS, ECC2, SCALE, EASTING = 6378137.0, 0.0066943799901413165, 0.9996, 500000.0


def utm(lat: Column | str, lon: Column | str, zone: int = 43) -> tuple[Column, Column]:
    """Easting and northing in metres (northern hemisphere)."""
    e2, ep2 = ECC2, ECC2 / (1 - ECC2)
    phi = F.radians(col(lat))
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(AXIS) / F.sqrt(1 - e2 * sin * sin)
    t, c = tan * tan, ep2 * cos * cos
    a = cos * (F.radians(col(lon)) - radians(6 * zone - 183))
    m = AXIS * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    a2 = a * a
    x = a + (1 - t + c) * a2 * a / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a2 * a2 * a / 120
    y = a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a2 * a2 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a2 * a2 * a2 / 720
    return SCALE * n * x + EASTING, SCALE * (m + n * tan * y)


def utm_sql(lat: str, lon: str, zone: int = 43) -> tuple[str, str]:
    """The same series as SQL text, for engines that check it."""
    e2, ep2 = ECC2, ECC2 / (1 - ECC2)
    phi = f"radians({lat})"
    n = f"({AXIS!r} / sqrt(1 - {e2!r} * sin({phi}) * sin({phi})))"
    t, c = f"(tan({phi}) * tan({phi}))", f"({ep2!r} * cos({phi}) * cos({phi}))"
    a = f"(cos({phi}) * (radians({lon}) - {radians(6 * zone - 183)!r}))"
    m = (
        f"({AXIS!r} * ({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r} * {phi} - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r} * sin(2 * {phi})"
        f" + {15 * e2**2 / 256 + 45 * e2**3 / 1024!r} * sin(4 * {phi}) - {35 * e2**3 / 3072!r} * sin(6 * {phi})))"
    )
    x = f"({a} + (1 - {t} + {c}) * power({a}, 3) / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - {58 * ep2!r}) * power({a}, 5) / 120)"
    y = (
        f"(power({a}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * power({a}, 4) / 24"
        f" + (61 - 58 * {t} + {t} * {t} + 600 * {c} - {330 * ep2!r}) * power({a}, 6) / 720)"
    )
    return f"({SCALE!r} * {n} * {x} + {EASTING!r})", f"({SCALE!r} * ({m} + {n} * tan({phi}) * {y}))"


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def km_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6,371 km (haversine)."""
    half = lambda a, b: F.sin((F.radians(a) - F.radians(b)) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))
