"""Regions of label maps: connected components of runs and cells, hotspots, static plates, flips near edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewatch.operators.audits import CELL
from aislewatch.operators.components import connected_components
from aislewatch.operators.tracks import suppress


def whole_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, y, x_start, x_end): runs of one row that overlap or touch are one; empty ones go."""
    w = Window.partitionBy(*keys, "y").orderBy("x_start", "x_end")
    upto = F.max("x_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.where("x_end > x_start").select(*keys, "y", "x_start", "x_end").withColumn("_new", F.coalesce((F.col("x_start") > upto).cast("int"), F.lit(1)))
    grouped = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "y", "_g").agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end")).drop("_g")


def _band_labels(t: pa.Table, diagonal: bool) -> pa.Table:
    """Adds ``label``: the number of the first run, in the order of rows, that runs of this band reach over neighbouring rows."""
    t = t.sort_by([("y", "ascending"), ("x_start", "ascending")])
    y, lo, hi = (t.column(c).to_numpy() for c in ("y", "x_start", "x_end"))
    root = np.arange(len(y))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    stops = np.append(first[1:], len(y))
    slack = 1 if diagonal else 0
    for r in range(1, len(first)):
        if y[first[r]] != y[first[r - 1]] + 1:
            continue
        above = slice(first[r - 1], stops[r - 1])
        for i in range(first[r], stops[r]):
            # runs of the row above, which don't overlap each other, that reach into this one
            j0, j1 = np.searchsorted(hi[above], lo[i] - slack, "right"), np.searchsorted(lo[above], hi[i] + slack, "left")
            for j in range(above.start + j0, above.start + j1):
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    at = np.fromiter(map(top, range(len(y))), np.int64, len(y))
    return t.append_column("ly", pa.array(y[at])).append_column("lx", pa.array(lo[at]))


def connected_regions(runs: DataFrame, *keys: str, least_area: int = 1, diagonal: bool = False, band: int = 256) -> DataFrame:
    """(keys, x0, y0, x1, y1, area): the tight box and area of each connected region of run-length rows (y, x_start, x_end; ends are open).

    Runs of neighbouring rows are connected where they share a column, with ``diagonal`` also where they meet at a corner. A task
    unites the runs of ``band`` rows of an image; what meets at the seams of bands is united by a join, so that no image has to fit
    a task. Runs that overlap count their pixels once. Regions under ``least_area`` pixels go.
    """
    whole = whole_runs(runs, *keys).select(*keys, *(F.col(c).cast("long").alias(c) for c in ("y", "x_start", "x_end"))).withColumn("_band", F.floor(F.col("y") / band))
    schema = ", ".join(f"`{c}` {k}" for c, k in whole.dtypes) + ", ly long, lx long"
    found = whole.groupBy(*keys, "_band").applyInArrow(lambda t: _band_labels(t, diagonal), schema).withColumn("_label", F.struct("ly", "lx")).checkpoint()
    seam = F.pmod(F.col("y"), F.lit(band))
    low = found.where(seam == band - 1).select(*keys, (F.col("y") + 1).alias("y"), F.col("x_start").alias("_s"), F.col("x_end").alias("_e"), F.col("_label").alias("a"))
    high = found.where(seam == 0).select(*keys, "y", "x_start", "x_end", F.col("_label").alias("b"))
    slack = 1 if diagonal else 0
    meets = low.join(high, [*keys, "y"]).where((F.col("_s") < F.col("x_end") + slack) & (F.col("x_start") < F.col("_e") + slack))
    joined = connected_components(meets.select(*keys, "a", "b"), *keys).withColumnRenamed("node", "_label")
    out = found.join(joined, [*keys, "_label"], "left").withColumn("_region", F.coalesce("component", "_label"))
    boxes = out.groupBy(*keys, "_region").agg(F.min("x_start").alias("x0"), F.min("y").alias("y0"), F.max("x_end").alias("x1"), (F.max("y") + 1).alias("y1"), F.sum(F.col("x_end") - F.col("x_start")).alias("area"))
    return boxes.where(F.col("area") >= least_area).drop("_region")


# ---- hotspots of boxes that are hardly believed


def hotspots(det: DataFrame, cell: float = 64.0, strong: float = 0.5, candidate: float = 0.35, low_score: float = 0.35, least: float = 0.5) -> DataFrame:
    """(camera_id, cx, cy, frames, share, tier): cells in which, after suppression, centres of boxes under ``low_score`` lie, the share of the camera's frames in
    which one does, and "strong", "candidate" or null by that share. A frame counts if it has any box."""
    frames = det.groupBy("camera_id").agg(F.countDistinct("frame_index").alias("_n"))
    kept = suppress(det, least).where(F.col("score") < low_score)
    at = lambda lo, hi: F.floor((F.col(lo) + F.col(hi)) / 2 / cell)
    c = kept.groupBy("camera_id", at("x0", "x1").alias("cx"), at("y0", "y1").alias("cy")).agg(F.countDistinct("frame_index").alias("frames"))
    share = F.col("frames") / F.col("_n")
    return c.join(frames, "camera_id").select("camera_id", "cx", "cy", "frames", share.alias("share"), F.when(share > strong, "strong").when(share > candidate, "candidate").alias("tier"))


def hotspot_regions(cells: DataFrame, cell: int = 64, width: int = 1920, height: int = 1080) -> DataFrame:
    """(camera_id, tier, x0, y0, x1, y1, share, cells): hot cells of one tier that touch, corners included, as one rectangle, which is
    padded by half a cell and cut at the picture; ``share`` is the largest of any cell in the rectangle before it is padded.

    Cells look at four of their eight neighbours, so that each pair meets once; a loop of joins unites them.
    """
    hot = cells.where("tier IS NOT NULL").select("camera_id", "tier", "cx", "cy")
    here = F.struct("cy", "cx")
    beside = F.explode(F.array(*(F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)))))
    looks = hot.select("camera_id", "tier", here.alias("a"), beside.alias("n")).select("camera_id", "tier", "a", "n.cx", "n.cy")
    edges = looks.join(hot.withColumn("b", here), ["camera_id", "tier", "cx", "cy"]).select("camera_id", "tier", "a", "b")
    comps = connected_components(edges, "camera_id", "tier").withColumn("cx", F.col("node.cx")).withColumn("cy", F.col("node.cy")).drop("node")
    region = hot.join(comps, ["camera_id", "tier", "cx", "cy"], "left").withColumn("component", F.coalesce("component", here))
    box = region.groupBy("camera_id", "tier", "component").agg(F.min("cx").alias("l"), F.min("cy").alias("t"), F.max("cx").alias("r"), F.max("cy").alias("b"), F.count("*").alias("cells"))
    inside = cells.select("camera_id", F.col("cx").alias("_x"), F.col("cy").alias("_y"), "share")
    most = box.join(inside, "camera_id").where("_x BETWEEN l AND r AND _y BETWEEN t AND b").groupBy("camera_id", "tier", "component").agg(F.max("share").alias("share"))
    pad = cell // 2
    low = lambda c: F.greatest(F.lit(0), F.col(c) * cell - pad)
    high = lambda c, most_: F.least(F.lit(most_), (F.col(c) + 1) * cell + pad)
    return box.join(most, ["camera_id", "tier", "component"]).select("camera_id", "tier", low("l").alias("x0"), low("t").alias("y0"), high("r", width).alias("x1"), high("b", height).alias("y1"), "share", "cells")


def union_area(boxes: DataFrame, *keys: str) -> DataFrame:
    """(keys, area): the area that rectangles (x0, y0, x1, y1) of the same keys cover together.

    A sweep over x: between two neighbouring edges the rectangles that reach across are intervals of y, whose union is summed.
    """
    w = Window.partitionBy(*keys).orderBy("x0")
    edges = boxes.select(*keys, F.col("x0")).unionByName(boxes.select(*keys, F.col("x1").alias("x0"))).distinct().withColumn("_to", F.lead("x0").over(w)).where("_to IS NOT NULL")
    strips = edges.withColumnRenamed("x0", "_from").join(boxes.select(*keys, "x0", "y0", "x1", "y1"), [*keys]).where("x0 <= _from AND x1 >= _to")
    s = Window.partitionBy(*keys, "_from").orderBy("y0", "y1")
    upto = F.coalesce(F.max("y1").over(s.rowsBetween(Window.unboundedPreceding, -1)), F.col("y0"))
    new = F.greatest(F.col("y1") - F.greatest("y0", upto), F.lit(0))
    return strips.withColumn("_h", new).groupBy(*keys).agg(F.sum((F.col("_to") - F.col("_from")) * F.col("_h")).alias("area"))


def hotspot_cover(det: DataFrame, regions: DataFrame, low_score: float = 0.35, least: float = 0.5, tiers: tuple[str, ...] = ("strong", "candidate")) -> DataFrame:
    """(camera_id, regions, area, boxes, covered): for each camera of ``det`` its regions of the accepted ``tiers``, the area that they cover together, its
    boxes under ``low_score`` after suppression, and those of them whose centre lies in a region. A camera has few regions."""
    taken = regions.where(F.col("tier").isin(*tiers))
    per = taken.groupBy("camera_id").agg(F.count("*").alias("regions")).join(union_area(taken, "camera_id"), "camera_id")
    kept = suppress(det, least).where(F.col("score") < low_score).select("camera_id", "det_id", ((F.col("x0") + F.col("x1")) / 2).alias("_u"), ((F.col("y0") + F.col("y1")) / 2).alias("_v"))
    hit = kept.join(taken.select("camera_id", "x0", "y0", "x1", "y1"), "camera_id").where("_u >= x0 AND _u < x1 AND _v >= y0 AND _v < y1").groupBy("camera_id").agg(F.countDistinct("det_id").alias("covered"))
    every = det.select("camera_id").distinct().join(kept.groupBy("camera_id").agg(F.count("*").alias("boxes")), "camera_id", "left")
    return every.join(per, "camera_id", "left").join(hit, "camera_id", "left").select("camera_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("regions", "area", "boxes", "covered")))


# ---- flips of label cells by zone


def ball(radius: int) -> list[tuple[int, int]]:
    """Offsets of up to ``radius`` steps over edges."""
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if abs(dy) + abs(dx) <= radius]


def cell_flips(cells: DataFrame, within: int = 3) -> DataFrame:
    """(camera_id, cell_y, cell_x, from_class, pairs, flips, bounced, evaluable) of label cells: changes from a class between neighbouring observations, those that
    return within ``within`` further ones, and those of which that can be said: a change that didn't return before the end came sooner is left out."""
    w = Window.partitionBy(*CELL).orderBy("frame_index")
    ahead = F.collect_list("class_id").over(w.rowsBetween(1, within))
    c = cells.withColumns({"from_class": F.lag("class_id").over(w), "_a": ahead}).where("from_class IS NOT NULL")
    flip = F.col("class_id") != F.col("from_class")
    back = F.array_contains("_a", F.col("from_class"))
    n = lambda x: F.sum(x.cast("long"))
    return c.groupBy(*CELL, "from_class").agg(F.count("*").alias("pairs"), n(flip).alias("flips"), n(flip & back).alias("bounced"), n(flip & (back | (F.size("_a") == within))).alias("evaluable"))


def boundary_cells(modal: DataFrame, radius: int = 1) -> DataFrame:
    """(camera_id, cell_y, cell_x, region, place) for each class ``region`` of a map (class_id of each cell): "band" where cells within ``radius`` steps are
    partly of the class and partly not (cells outside the map are not), "interior" where all are. A stencil join on the grid."""
    offsets = F.explode(F.array(*(F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy, dx in ball(radius))))
    seen = modal.select("camera_id", "cell_y", "cell_x", F.col("class_id").alias("region"), offsets.alias("o")).select("camera_id", (F.col("cell_y") + F.col("o.y")).alias("cell_y"), (F.col("cell_x") + F.col("o.x")).alias("cell_x"), "region")
    n = seen.groupBy(*CELL, "region").agg(F.count("*").alias("_n")).join(modal.select(*CELL), CELL)
    return n.select(*CELL, "region", F.when(F.col("_n") == len(ball(radius)), "interior").otherwise("band").alias("place"))


def flip_report(cells: DataFrame, static: DataFrame, modal: DataFrame, within: int = 3, radius: int = 1) -> DataFrame:
    """(camera_id, subject, class_id, zone, cells, pairs, flips, bounced, evaluable) of label cells inside and outside the ``static`` cells.

    ``subject``: "all" cells (class null), changes "from" a class, and cells in the "band" around a class's region of the ``modal`` map or in its
    "interior" (see :func:`boundary_cells`). ``zone``: "static", "moving" or "all". Rates are quotients of the columns.
    """
    flips = cell_flips(cells, within)
    zone = static.select(*CELL).distinct().withColumn("_z", F.lit("static"))
    per_class = flips.join(zone, CELL, "left").withColumn("zone", F.explode(F.array(F.coalesce("_z", F.lit("moving")), F.lit("all")))).drop("_z")
    sums = [F.sum(c).alias(c) for c in ("pairs", "flips", "bounced", "evaluable")]
    per_cell = per_class.groupBy(*CELL, "zone").agg(*sums)
    none = F.lit(None).cast("long")
    rows = [
        per_cell.groupBy("camera_id", F.lit("all").alias("subject"), none.alias("class_id"), "zone").agg(F.count("*").alias("cells"), *sums),
        per_class.groupBy("camera_id", F.lit("from").alias("subject"), F.col("from_class").cast("long").alias("class_id"), "zone").agg(F.count("*").alias("cells"), *sums),
        boundary_cells(modal, radius).join(per_cell, CELL).groupBy("camera_id", F.col("place").alias("subject"), F.col("region").cast("long").alias("class_id"), "zone").agg(F.count("*").alias("cells"), *sums),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# ---- static plates


def static_plate(runs: DataFrame, share: float = 0.9, slot: Column | str = "slot") -> DataFrame:
    """(camera_id, slot, y, x_start, x_end): where runs (camera_id, frame_index, y, x_start, x_end) of at least ``share`` of the frames of a camera and slot lie.

    A sweep over the edges of a row's runs: each start adds a frame, each end takes one, and stretches with enough are joined.
    """
    rows = runs.withColumn("slot", F.col(slot) if isinstance(slot, str) else slot)
    key = ["camera_id", "slot"]
    n = rows.groupBy(*key).agg(F.countDistinct("frame_index").alias("_n"))
    one = whole_runs(rows, *key, "frame_index")
    edge = one.select(*key, "y", F.col("x_start").alias("x"), F.lit(1).alias("d")).unionByName(one.select(*key, "y", F.col("x_end").alias("x"), F.lit(-1).alias("d")))
    w = Window.partitionBy(*key, "y").orderBy("x")
    at = edge.groupBy(*key, "y", "x").agg(F.sum("d").alias("d")).withColumns({"_c": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_to": F.lead("x").over(w)})
    covered = at.join(n, key).where((F.col("_c") >= F.col("_n") * share) & F.col("_to").isNotNull()).select(*key, "y", F.col("x").alias("x_start"), F.col("_to").alias("x_end"))
    return whole_runs(covered, *key)


def plate_shares(boxes: DataFrame, plate: DataFrame, slots: DataFrame, scale: float = 1.0, width: int = 1 << 20, height: int = 1 << 20, band: int = 64) -> DataFrame:
    """``boxes`` (det_id, camera_id, slot, x0..y1) with ``share``, the part of a box's pixels on its slot's plate that are static, and ``plate_pixels``, how
    many there are; both null where ``slots`` (camera_id, slot) has no plate.

    A plate is ``scale`` times as large as the picture, ``width`` x ``height`` pixels; a box covers the plate's pixels that it touches, one at least.
    Boxes meet the rows of the plate by bands.
    """
    def edges(lo: str, hi: str, most: int) -> tuple[Column, Column]:
        a = F.greatest(F.floor(F.col(lo) * scale), F.lit(0))
        return a, F.least(F.greatest(F.ceil(F.col(hi) * scale), a + 1), F.lit(most))

    (px0, px1), (py0, py1) = edges("x0", "x1", width), edges("y0", "y1", height)
    b = boxes.join(slots.select("camera_id", "slot").distinct().withColumn("_has", F.lit(True)), ["camera_id", "slot"], "left")
    b = b.withColumns({"_l": px0, "_r": px1, "_t": py0, "_b": py1})
    asks = b.where("_has AND _b > _t").select("det_id", "camera_id", "slot", "_l", "_r", "_t", "_b").withColumn("_k", F.explode(F.sequence(F.floor(F.col("_t") / band), F.floor((F.col("_b") - 1) / band))))
    hit = asks.join(plate.withColumn("_k", F.floor(F.col("y") / band)), ["camera_id", "slot", "_k"]).where("y >= _t AND y < _b")
    part = hit.groupBy("det_id").agg(F.sum(F.greatest(F.least("_r", "x_end") - F.greatest("_l", "x_start"), F.lit(0))).alias("_s"))
    pixels = F.greatest((F.col("_r") - F.col("_l")) * (F.col("_b") - F.col("_t")), F.lit(0)).cast("long")
    out = b.join(part, "det_id", "left").withColumns({"plate_pixels": F.when(F.col("_has"), pixels)})
    return out.withColumn("share", F.when(F.col("_has"), F.when(pixels > 0, F.coalesce("_s", F.lit(0)) / pixels).otherwise(0.0))).drop("_has", "_l", "_r", "_t", "_b", "_s")
