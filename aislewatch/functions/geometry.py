"""Floor geometry as column expressions. Null or non-finite positions are never inside anything."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(*cols: Column) -> Column:
    """True where every column holds a finite number."""
    ok = F.lit(True)
    for c in cols:
        ok &= F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return ok


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def view_ray(u: Column, v: Column, cam: Column) -> tuple[Column, Column, Column]:
    """The levelled viewing ray (right, down, ahead) of a pixel; ``cam`` is a struct of fx, fy, cx, cy, height, pitch, roll."""
    rx, ry = (u - cam["cx"]) / cam["fx"], (v - cam["cy"]) / cam["fy"]
    cp, sp, cr, sr = F.cos(cam["pitch"]), F.sin(cam["pitch"]), F.cos(cam["roll"]), F.sin(cam["roll"])
    x, y = cr * rx - sr * ry, sr * rx + cr * ry
    return x, cp * y + sp, cp - sp * y


def pixel_to_ground(u: Column, v: Column, cam: Column) -> Column:
    """struct(x, z) in metres of the floor point under a pixel; null fields at or above the horizon."""
    x, y, z = view_ray(u, v, cam)
    t = F.when(y > 1e-9, cam["height"] / y)
    return F.struct((x * t).alias("x"), (z * t).alias("z"))


def ground_to_pixel(x: Column, z: Column, cam: Column) -> Column:
    """struct(u, v, depth) of a floor point; null fields behind the camera."""
    return raised_to_pixel(x, z, F.lit(0.0), cam)


def raised_to_pixel(x: Column, z: Column, up: Column, cam: Column) -> Column:
    """struct(u, v, depth) of a point ``up`` metres over the floor."""
    cp, sp, cr, sr = F.cos(cam["pitch"]), F.sin(cam["pitch"]), F.cos(cam["roll"]), F.sin(cam["roll"])
    y = cam["height"] - up
    down, ahead = cp * y - sp * z, sp * y + cp * z
    right, low = cr * x + sr * down, -sr * x + cr * down
    d = F.when(ahead > 1e-9, ahead)
    return F.struct((cam["fx"] * right / d + cam["cx"]).alias("u"), (cam["fy"] * low / d + cam["cy"]).alias("v"), d.alias("depth"))


def height_above_floor(v: Column, x: Column, z: Column, cam: Column) -> Column:
    """Metres over the floor of pixel row ``v`` for something that stands at (x, z), for a camera without roll; null if degenerate."""
    t = (v - cam["cy"]) / cam["fy"]
    cp, sp = F.cos(cam["pitch"]), F.sin(cam["pitch"])
    den = cp - t * sp
    return F.when(F.abs(den) > 1e-9, cam["height"] - z * (t * cp + sp) / den)


def pixel_row_at_height(up: Column, x: Column, z: Column, cam: Column) -> Column:
    return raised_to_pixel(x, z, up, cam)["v"]


def horizon_row(fy: Column, cy: Column, pitch: Column) -> Column:
    """The pixel row of the horizon in the middle column; positive pitch looks down."""
    return cy - fy * F.tan(pitch)


def pose_refusal(row: Column, height_px: Column) -> Column:
    """Why a pose with its horizon at ``row`` can't be used for floor positions; null if it can."""
    return F.when(row >= height_px, "horizon below the picture").when(row >= 0, "horizon in the picture")


def undistort(u: Column, v: Column, k1: Column, centre_u: Column, centre_v: Column, radius: Column) -> Column:
    """struct(u, v): the division model, centre + c / (1 + k1 r^2) with r in units of ``radius``."""
    du, dv = u - centre_u, v - centre_v
    s = 1 + k1 * (du * du + dv * dv) / (radius * radius)
    return F.struct((centre_u + du / s).alias("u"), (centre_v + dv / s).alias("v"))


def distort(u: Column, v: Column, k1: Column, centre_u: Column, centre_v: Column, radius: Column) -> Column:
    """The exact inverse of :func:`undistort`; null fields where no pixel maps there."""
    du, dv = u - centre_u, v - centre_v
    r2 = (du * du + dv * dv) / (radius * radius)
    q = 1 - 4 * k1 * r2
    s = F.when(q >= 0, 2 / (1 + F.sqrt(q)))
    return F.struct((centre_u + du * s).alias("u"), (centre_v + dv * s).alias("v"))


def undistort_equidistant(u: Column, v: Column, f: Column, cu: Column, cv: Column) -> Column:
    """struct(u, v): fisheye angle r / f to a pinhole radius f tan(r / f); null from a right angle on."""
    r = F.hypot(u - cu, v - cv)
    s = F.when(r < 1e-12, F.lit(1.0)).when(r / f < math.pi / 2, f * F.tan(r / f) / r)
    return F.struct((cu + (u - cu) * s).alias("u"), (cv + (v - cv) * s).alias("v"))


def distort_equidistant(u: Column, v: Column, f: Column, cu: Column, cv: Column) -> Column:
    r = F.hypot(u - cu, v - cv)
    s = F.when(r < 1e-12, F.lit(1.0)).otherwise(f * F.atan(r / f) / r)
    return F.struct((cu + (u - cu) * s).alias("u"), (cv + (v - cv) * s).alias("v"))


def camera_from_vfov(vfov_deg: Column, width: Column, height_px: Column) -> Column:
    """struct(fx, fy, cx, cy) of square pixels from the vertical field of view."""
    f = height_px / 2 / F.tan(F.radians(vfov_deg) / 2)
    return F.struct(f.alias("fx"), f.alias("fy"), (width / 2).alias("cx"), (height_px / 2).alias("cy"))


def scaled_camera(cam: Column, sx: Column, sy: Column) -> Column:
    return F.struct((cam["fx"] * sx).alias("fx"), (cam["fy"] * sy).alias("fy"), (cam["cx"] * sx).alias("cx"), (cam["cy"] * sy).alias("cy"))


def _edges(polygon: Column) -> Column:
    """The polygon's edges (a, b), the last one back to its first corner."""
    return F.zip_with(polygon, F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def point_in_polygon(x: Column, z: Column, polygon: Column) -> Column:
    """Even-odd rule over ``polygon``, array<struct<x, z>> of three corners or more; an error with fewer."""
    crossed = F.aggregate(
        _edges(polygon), F.lit(False),
        lambda odd, e: odd != (((e["a"]["z"] > z) != (e["b"]["z"] > z)) & F.coalesce(x < (e["b"]["x"] - e["a"]["x"]) * (z - e["a"]["z"]) / F.nullif(e["b"]["z"] - e["a"]["z"], F.lit(0.0)) + e["a"]["x"], F.lit(False))))
    return F.when(F.size(polygon) < 3, F.raise_error(F.lit("a zone needs three corners or more"))).otherwise(finite(x, z) & F.coalesce(crossed, F.lit(False)))


def polygon_area(polygon: Column) -> Column:
    """Signed area, positive for corners in anticlockwise order of (x, z)."""
    return F.aggregate(_edges(polygon), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["z"] - e["b"]["x"] * e["a"]["z"])) / 2


def side(ax: Column, az: Column, bx: Column, bz: Column, px: Column, pz: Column) -> Column:
    """Sign of the cross product: on which side of the line a -> b the point lies."""
    return F.signum((bx - ax) * (pz - az) - (bz - az) * (px - ax))


def segments_cross(a: tuple, b: tuple, p: tuple, q: tuple) -> Column:
    """Whether segments a-b and p-q cross properly; touching or collinear ones don't. Points are (x, z) pairs of columns."""
    s = [side(*a, *b, *p), side(*a, *b, *q), side(*p, *q, *a), side(*p, *q, *b)]
    return (s[0] * s[1] == -1) & (s[2] * s[3] == -1)
