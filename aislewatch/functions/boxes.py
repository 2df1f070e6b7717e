"""Pixel boxes x0, y0, x1, y1 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def foot(b: Box) -> tuple[Column, Column]:
    """The middle of the lower edge."""
    return (b[0] + b[2]) / 2, b[3]


def centre_form(b: Box) -> tuple[Column, Column, Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def corner_form(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def from_letterbox(b: Box, scale: Column, pad_x: Column, pad_y: Column) -> Box:
    """A box of a scaled and padded picture in the pixels of its source."""
    return (b[0] - pad_x) / scale, (b[1] - pad_y) / scale, (b[2] - pad_x) / scale, (b[3] - pad_y) / scale


def usable_crop(b: Box, width: Column, height: Column, margin: float = 3.0, least_height: float = 64.0) -> Column:
    """Whether a box keeps clear of the picture's edge and is tall enough to look at."""
    return (b[0] > margin) & (b[1] > margin) & (b[2] < width - margin) & (b[3] < height - margin) & (b[3] - b[1] >= least_height)


def undistort_box(b: Box, k1: Column, width: Column, height: Column) -> Column:
    """struct(x0, y0, x1, y1): the upright box around the two undistorted corners, for a lens centred in the picture whose
    radius is half its diagonal."""
    from aislewatch.functions.geometry import undistort

    p, q = (undistort(b[i], b[j], k1, width / 2, height / 2, F.hypot(width, height) / 2) for i, j in ((0, 1), (2, 3)))
    sides = (F.least(p["u"], q["u"]), F.least(p["v"], q["v"]), F.greatest(p["u"], q["u"]), F.greatest(p["v"], q["v"]))
    return F.struct(*[s.alias(n) for s, n in zip(sides, ("x0", "y0", "x1", "y1"), strict=True)])
