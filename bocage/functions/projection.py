"""Longitude/latitude (EPSG:4326) to Lambert-93 (EPSG:2154) as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import _col, set_srid, srid_of

# Public definition of EPSG:2154 (two-parallel Lambert conic on GRS80).
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
PARALLEL_1, PARALLEL_2 = math.radians(44.0), math.radians(49.0)
LAT_0, LON_0 = math.radians(46.5), math.radians(3.0)
EASTING_0, NORTHING_0 = 700000.0, 6600000.0

_F = 1.0 / INVERSE_FLATTENING
ECC = math.sqrt(2 * _F - _F * _F)


def _iso(lat: float) -> float:
    s = ECC * math.sin(lat)
    return math.log(math.tan(math.pi / 4 + lat / 2) * ((1 - s) / (1 + s)) ** (ECC / 2))


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (ECC * math.sin(lat)) ** 2)


CONE = math.log(_m(PARALLEL_1) / _m(PARALLEL_2)) / (_iso(PARALLEL_2) - _iso(PARALLEL_1))
SCALE = SEMI_MAJOR * _m(PARALLEL_1) * math.exp(CONE * _iso(PARALLEL_1)) / CONE
RHO_0 = SCALE * math.exp(-CONE * _iso(LAT_0))


def lambert93(lon, lat) -> Column:
    """struct<x, y> in metres for degrees."""
    lam, phi = F.radians(_col(lon)), F.radians(_col(lat))
    s = ECC * F.sin(phi)
    iso = F.ln(F.tan(math.pi / 4 + phi / 2) * F.pow((1 - s) / (1 + s), F.lit(ECC / 2)))
    rho = SCALE * F.exp(-CONE * iso)
    turn = CONE * (lam - LON_0)
    return F.struct(
        (EASTING_0 + rho * F.sin(turn)).alias("x"),
        (NORTHING_0 + RHO_0 - rho * F.cos(turn)).alias("y"),
    )


def to_lambert93(points: DataFrame) -> DataFrame:
    """Reproject the ``x``/``y`` columns of a point layer labelled 4326."""
    srid = srid_of(points)
    if srid == 2154:
        return points
    if srid != 4326:
        raise ValueError(f"only 4326 can be reprojected to 2154, layer is labelled {srid}")
    keep = [c for c in points.columns if c not in ("x", "y")]
    moved = points.select(*keep, lambert93("x", "y").alias("_p")).select(
        *keep, F.col("_p.x").alias("x"), F.col("_p.y").alias("y")
    )
    return set_srid(moved, 2154)
