"""Distances, angles and dihedrals of points given as struct<x,y,z> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column | str, y: Column | str, z: Column | str) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.struct(c(x).alias("x"), c(y).alias("y"), c(z).alias("z"))


def minus(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return point(
        a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"],
    )


def distance2(a: Column, b: Column) -> Column:
    d = minus(a, b)
    return dot(d, d)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance2(a, b))


def _clamped_acos(c: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def angle(a: Column, b: Column, c: Column) -> Column:
    """Angle at ``b`` in degrees; 0 when an arm has no length."""
    u, v = minus(a, b), minus(c, b)
    n = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(n == 0, F.lit(0.0)).otherwise(_clamped_acos(dot(u, v) / n))


def dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed torsion in degrees; 0 when the points do not define one."""
    b1, b2, b3 = minus(b, a), minus(c, b), minus(d, c)
    n2 = cross(b2, b3)
    across = F.sqrt(dot(b2, b2)) * dot(b1, n2)
    return F.degrees(F.atan2(across + F.lit(0.0), dot(cross(b1, b2), n2)))
