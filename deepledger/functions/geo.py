"""Geodesy as column expressions; null in, null out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from deepledger.functions.constants import DEGREE_M, EARTH_RADIUS_M, WGS84_A, WGS84_F


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 540, F.lit(360.0)) - 180


def heading(value: Column) -> Column:
    """Degrees in [0, 360); NaN and infinities become null."""
    return F.when(finite(value).isNotNull(), F.pmod(value, F.lit(360.0)))


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def sphere_destination(lat: Column, lon: Column, bearing: Column, distance: Column) -> Column:
    """struct(lat, lon) reached on the sphere."""
    d, b, p = distance / EARTH_RADIUS_M, F.radians(bearing), F.radians(lat)
    s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b)
    out_lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))
    out_lon = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * s)
    return F.struct(F.degrees(out_lat).alias("lat"), wrap_longitude(F.degrees(out_lon)).alias("lon"))


def towfish(lat: Column, lon: Column, bearing: Column, forward: Column, starboard: Column) -> Column:
    """struct(lat, lon) of a towed body from the vessel's: `forward` metres along the heading, then `starboard` metres to its right.

    Null without a heading or with neither offset; a missing one of the two counts as none.
    """
    moved = lambda at, angle, by: F.when(F.coalesce(by, F.lit(0.0)) != 0, sphere_destination(at["lat"], at["lon"], angle, by)).otherwise(at)
    ahead = moved(F.struct(lat.alias("lat"), lon.alias("lon")), bearing, forward)
    aside = moved(ahead, F.pmod(bearing + 90.0, F.lit(360.0)), starboard)
    return F.when(bearing.isNotNull() & (forward.isNotNull() | starboard.isNotNull()), aside)


def geodesic_ends(lat: np.ndarray, lon: np.ndarray, bearing: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes reached on the WGS84 ellipsoid; the start for distances not above 0.

    The arc comes from the distance by the reverted series of the geodesic to the fourth order, so nothing is iterated; errors
    are far below a millimetre.
    """
    f, turn = WGS84_F, np.radians(bearing)
    u = np.arctan((1 - f) * np.tan(np.radians(lat)))
    su, cu, st, ct = np.sin(u), np.cos(u), np.sin(turn), np.cos(turn)
    sine, start = cu * st, np.arctan2(su, cu * ct)
    square = 1 - sine * sine
    root = np.sqrt(1 + f * (2 - f) / (1 - f) ** 2 * square)
    e = (root - 1) / (root + 1)
    e2 = e * e
    to = (e * (-0.5 + 3 / 16 * e2), e2 * (-1 / 16 + e2 / 32), -e * e2 / 48, -5 / 512 * e2 * e2)
    back = (e * (0.5 - 9 / 32 * e2), e2 * (5 / 16 - 37 / 96 * e2), 29 / 96 * e * e2, 539 / 1536 * e2 * e2)
    series = lambda x, terms: sum((t * np.sin(2 * i * x) for i, t in enumerate(terms, 1)), x)
    arc = series(series(start, to) + distance * (1 - e) / (WGS84_A * (1 - f) * (1 + e2 / 4 + e2 * e2 / 64)), back) - start
    sa, ca, middle, k = np.sin(arc), np.cos(arc), np.cos(2 * start + arc), f / 16 * square * (4 + f * (4 - 3 * square))
    x, y = su * sa - cu * ca * ct, su * ca + cu * sa * ct
    turned = np.arctan2(sa * st, cu * ca - su * sa * ct)
    lost = (1 - k) * f * sine * (arc + k * sa * (middle + k * ca * (2 * middle * middle - 1)))
    out_lat = np.degrees(np.arctan2(y, (1 - f) * np.sqrt(sine * sine + x * x)))
    out_lon = np.mod(lon + np.degrees(turned - lost) + 540, 360.0) - 180
    return np.where(distance <= 0, lat, out_lat), np.where(distance <= 0, lon, out_lon)


PLACE = StructType([StructField("lat", DoubleType()), StructField("lon", DoubleType())])


def doubles(column: pa.Array) -> np.ndarray:
    """The values of an Arrow column, NaN where they are null."""
    return column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


@F.arrow_udf(PLACE)
def _ends(lat: pa.Array, lon: pa.Array, bearing: pa.Array, distance: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x) for x in geodesic_ends(*map(doubles, (lat, lon, bearing, distance)))], names=["lat", "lon"])


def geodesic(rows: DataFrame, name: str, lat: Column, lon: Column, bearing: Column, distance: Column) -> DataFrame:
    """rows with `name`: struct(lat, lon) reached on the WGS84 ellipsoid, batch by batch of Arrow columns.

    As expressions its steps make a method that is longer than the JVM compiles.
    """
    known = lat.isNotNull() & lon.isNotNull() & bearing.isNotNull() & distance.isNotNull()
    return rows.withColumn(name, F.when(known, _ends(lat, lon, bearing, distance)))


def ground_range(slant: Column, altitude: Column) -> Column:
    return F.when(altitude <= 0, slant).otherwise(F.sqrt(F.greatest(F.lit(0.0), slant * slant - altitude * altitude)))


def row_slant(row: Column, height: Column, full_range: Column) -> Column:
    """Slant range at an image row: its share of the range, between 0 and all of it."""
    return full_range * F.when(height <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), row / (height - 1))))


def ring(lat: Column, lon: Column, major: Column, minor: Column, rotation: Column, corners: int = 36) -> Column:
    """Closed ring of [lon, lat] around an ellipse with half axes in metres and the major one `rotation` degrees from east."""
    metres = DEGREE_M

    def corner(i: Column) -> Column:
        t, r = F.radians(F.pmod(i, F.lit(corners)) * (360.0 / corners)), F.radians(rotation)
        east = major * F.cos(t) * F.cos(r) - minor * F.sin(t) * F.sin(r)
        north = major * F.cos(t) * F.sin(r) + minor * F.sin(t) * F.cos(r)
        return F.array(F.round(lon + east / (metres * F.cos(F.radians(lat))), 7), F.round(lat + north / metres, 7))

    return F.transform(F.sequence(F.lit(0), F.lit(corners)), corner)


def utm_inverse(easting: Column, northing: Column, zone: Column, south: Column) -> Column:
    """struct(lat, lon) of UTM metres, by the transverse Mercator series in the third flattening."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    xi0, eta0 = (northing - F.when(south, 1e7).otherwise(0.0)) / (0.9996 * radius), (easting - 500000.0) / (0.9996 * radius)
    terms = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    xi, eta = xi0, eta0
    for k, beta in enumerate(terms, 1):
        xi = xi - beta * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta - beta * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for k, delta in enumerate((2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15), 1):
        lat = lat + delta * F.sin(2 * k * chi)
    return F.struct(F.degrees(lat).alias("lat"), (zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))).alias("lon"))
