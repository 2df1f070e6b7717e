"""Boxes that overlap, frame by frame, without all pairs of a frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

CORNERS = ["x0", "y0", "x1", "y1"]
CELLS = 1 << 20  # pairs that are valued at once


def areas(b: np.ndarray) -> np.ndarray:
    return np.maximum(b[:, 2] - b[:, 0], 0.0) * np.maximum(b[:, 3] - b[:, 1], 0.0)


def iou_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of ``a`` with every box of ``b``, as :func:`aislewatch.functions.boxes.iou` has it."""
    both = np.minimum(a[:, None, 2], b[None, :, 2])
    both -= np.maximum(a[:, None, 0], b[None, :, 0])
    np.maximum(both, 0.0, out=both)
    high = np.minimum(a[:, None, 3], b[None, :, 3])
    high -= np.maximum(a[:, None, 1], b[None, :, 1])
    both *= np.maximum(high, 0.0, out=high)
    np.add(areas(a)[:, None], areas(b)[None, :], out=high)
    high -= both
    return np.divide(both, high, out=np.zeros_like(both), where=high > 0)


def close_pairs(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, IoU) of all pairs with an IoU of ``least`` (over 0) or more.

    Boxes are taken by their left edge, some at a time, and meet those whose left edges lie where an overlap is possible; CELLS pairs are valued at once.
    """
    parts = list(_close(a, b, least))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _close(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    oa, ob = (np.argsort(x[:, 0], kind="stable")[: np.count_nonzero(x[:, 0] == x[:, 0])] for x in (a, b))
    a, b = a[oa], b[ob]
    if not len(a) or not len(b):
        return
    wide = np.nanmax(b[:, 2] - b[:, 0])
    low = np.searchsorted(b[:, 0], a[:, 0] - wide - 1e-9 * (1 + np.abs(a[:, 0]) + abs(wide)), "left")
    high = np.searchsorted(b[:, 0], np.maximum.accumulate(np.nan_to_num(a[:, 2], nan=-np.inf)), "right")
    at = 0
    while at < len(a):
        to = min(len(a), at + max(1, min(256, CELLS // max(1, int(high[at] - low[at])))))
        lo, hi = int(low[at]), int(high[to - 1])
        if hi > lo:
            found = iou_table(a[at:to], b[lo:hi])
            i, j = np.nonzero(found >= least)
            if len(i):
                yield oa[at + i], ob[lo + j], found[i, j]
        at = to


def box_array(t: pa.Table) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy().astype(float) for c in CORNERS])


def same_keys(a: pa.Table, b: pa.Table, on: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of ``a`` and of ``b`` of each value of ``on`` that both have."""
    both = pd.concat([a.select(on).to_pandas(), b.select(on).to_pandas()], ignore_index=True)
    code = both.groupby(on, sort=False).ngroup().to_numpy()
    ca, cb = code[: a.num_rows], code[a.num_rows :]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    for k in np.intersect1d(ca, cb):
        if k >= 0:
            yield oa[slice(*np.searchsorted(ca[oa], [k, k + 1]))], ob[slice(*np.searchsorted(cb[ob], [k, k + 1]))]


def nearest_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance) of the row of ``b`` whose corners are nearest, by the sum of their distances, to each row of ``a``; ties: the first.

    The nearest of a few rows with about the same left edge bounds how far away left edges have to be looked at.
    """
    ob = np.argsort(b[:, 0], kind="stable")
    b = b[ob]
    rows, best, gaps = np.argsort(a[:, 0], kind="stable"), np.zeros(len(a), np.int64), np.zeros(len(a))
    gap = lambda x, y: sum(np.abs(x[..., c] - y[..., c]) for c in range(4))
    known = lambda x: np.where(np.isnan(x), np.inf, x)
    some = np.clip(np.searchsorted(b[:, 0], a[rows, 0])[:, None] + np.arange(-8, 8), 0, len(b) - 1)
    bound = np.concatenate([known(gap(a[r][:, None], b[k])).min(axis=1) for r, k in zip(np.array_split(rows, len(rows) // 4096 + 1), np.array_split(some, len(rows) // 4096 + 1), strict=True)])
    left = a[rows, 0]
    slack = 1e-9 * (1 + np.abs(left) + np.where(np.isinf(bound), 0, bound))
    open_ = np.isinf(bound) | np.isnan(left)
    low = np.where(open_, 0, np.searchsorted(b[:, 0], left - bound - slack, "left"))
    high = np.where(open_, len(b), np.searchsorted(b[:, 0], left + bound + slack, "right"))
    at = 0
    while at < len(rows):
        to = min(len(rows), at + max(1, min(256, CELLS // max(1, int(high[at] - low[at])))))
        lo, hi = int(low[at:to].min()), int(high[at:to].max())
        while to > at + 1 and (to - at) * (hi - lo) > 2 * CELLS:
            to = at + (to - at) // 2
            lo, hi = int(low[at:to].min()), int(high[at:to].max())
        found = known(gap(a[rows[at:to]][:, None], b[lo:hi][None]))
        least = found.min(axis=1)
        best[rows[at:to]] = np.where(found == least[:, None], ob[lo:hi], len(b)).min(axis=1)
        gaps[rows[at:to]] = least
        at = to
    return np.arange(len(a)), best, gaps


def _frame_pairs(a: DataFrame, b: DataFrame, pairs, value: str, on: list[str], left: list[str], right: list[str], first: str | None = None, frames: int = 16) -> DataFrame:
    """(on, left, right, value) of the rows that ``pairs`` names of boxes with the same ``on``; a task gets ``frames`` frames of a camera, rows of ``b`` in the order of ``first``."""
    kind = dict(a.dtypes) | {c: t for c, t in b.dtypes if c in right}
    schema = ", ".join(f"`{c}` {kind[c]}" for c in [*on, *left, *right]) + f", {value} double"
    deal = F.floor(F.col("frame_index") / frames).alias("_b")
    nothing = to_arrow_schema(StructType([*a.select(*on, *left).schema, *b.select(*right).schema, StructField(value, DoubleType())])).empty_table()

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:  # a side without rows has no columns either
            return nothing
        y = y.rename_columns([c.removeprefix("y:") for c in y.column_names])
        y = y.sort_by(first) if first else y
        bx, by, parts = box_array(x), box_array(y), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for p, q in same_keys(x, y, on):
            i, j, v = pairs(bx[p], by[q])
            parts.append((p[i], q[j], v))
        i, j, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        out = x.select([*on, *left]).take(pa.array(i))
        for c in right:
            out = out.append_column(c, y.column(c).take(pa.array(j)))
        return out.append_column(value, pa.array(v))

    # tables may be made of one and the same, whose columns a cogroup tells apart by new names only
    dealt = [d.select(F.col("camera_id").alias(f"{name}camera_id"), deal.alias(f"{name}_b"), *(F.col(c).alias(f"{name}{c}") for c in dict.fromkeys([*on, *own, *CORNERS]) if c != "camera_id")).groupBy(f"{name}camera_id", f"{name}_b") for d, own, name in ((a, left, ""), (b, right, "y:"))]
    return dealt[0].cogroup(dealt[1]).applyInArrow(meet, schema)


def overlapping(a: DataFrame, b: DataFrame, least: float, on: list[str], left: list[str], right: list[str]) -> DataFrame:
    """(on, left, right, iou): pairs of boxes (x0, y0, x1, y1) of two tables with the same ``on`` (camera_id, frame_index and more) and an IoU of ``least`` (over 0) or
    more, with the columns ``left`` of the one and ``right`` of the other."""
    if least <= 0:
        raise ValueError("boxes that don't overlap aren't found")
    return _frame_pairs(a, b, lambda x, y: close_pairs(x, y, least), "iou", on, left, right)


def nearest(a: DataFrame, b: DataFrame, on: list[str], left: list[str], right: list[str], first: str) -> DataFrame:
    """(on, left, right, gap): for each box of ``a`` that of ``b`` with the same ``on`` whose corners are nearest; ties: the smallest ``first``."""
    return _frame_pairs(a, b, nearest_rows, "gap", on, left, right, first)
