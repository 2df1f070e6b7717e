"""Dwell, heat, visits and journeys from observations (camera_id, track_id, frame_index, score, x_m, z_m)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewatch.functions.geometry import finite
from aislewatch.operators.events import in_zones
from aislewatch.operators.runs import TRACK


def dwell_table(obs: DataFrame, fps: float = 5.0) -> DataFrame:
    """Per track: first and last frame, frames observed, seconds from first to last, frames without a row, and whether the camera's last frame cuts it off."""
    t = obs.groupBy(*TRACK).agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count("*").alias("observed_frames"))
    end = obs.groupBy("camera_id").agg(F.max("frame_index").alias("_end"))
    span = F.col("last_frame") - F.col("first_frame") + 1
    return t.join(end, "camera_id").select(*TRACK, "first_frame", "last_frame", "observed_frames", (span / F.lit(float(fps))).alias("dwell_s"), (span - F.col("observed_frames")).alias("coasted"), (F.col("last_frame") >= F.col("_end")).alias("truncated"))


def flow_summary(dwell: DataFrame) -> DataFrame:
    """Per camera: tracks, complete tracks, and the median and 90th percentile of the complete ones' dwell."""
    whole = F.when(~F.col("truncated"), F.col("dwell_s"))
    return dwell.groupBy("camera_id").agg(F.count("*").alias("tracks"), F.count(whole).alias("complete"), F.percentile(whole, 0.5).alias("median_s"), F.percentile(whole, 0.9).alias("p90_s"))


def ground_map(obs: DataFrame, cell: float = 0.25) -> DataFrame:
    """(camera_id, cell_x, cell_z, x, z, n): observations per floor cell from the camera's smallest coordinates on; the last cell takes the far edge."""
    p = obs.where(finite(F.col("x_m"), F.col("z_m")))
    box = p.groupBy("camera_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("x_m", "z_m") for f, n in ((F.min, "lo"), (F.max, "hi"))])

    def index(c: str) -> Column:
        most = F.greatest(F.ceil((F.col(f"{c}_hi") - F.col(f"{c}_lo")) / cell), F.lit(1)) - 1
        return F.least(F.floor((F.col(c) - F.col(f"{c}_lo")) / cell), most)

    cells = p.join(box, "camera_id").select("camera_id", index("x_m").alias("cell_x"), index("z_m").alias("cell_z"), "x_m_lo", "z_m_lo")
    out = cells.groupBy("camera_id", "cell_x", "cell_z").agg(F.count("*").alias("n"), F.first("x_m_lo").alias("x0"), F.first("z_m_lo").alias("z0"))
    return out.select("camera_id", "cell_x", "cell_z", (F.col("x0") + (F.col("cell_x") + 0.5) * cell).alias("x"), (F.col("z0") + (F.col("cell_z") + 0.5) * cell).alias("z"), "n")


def visited_area(cells: DataFrame, cell: float = 0.25) -> DataFrame:
    return cells.groupBy("camera_id").agg((F.count("*") * cell * cell).alias("visited_m2"))


def busiest_cells(cells: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` fullest cells of each camera; ties by cell."""
    w = Window.partitionBy("camera_id").orderBy(F.desc("n"), "cell_x", "cell_z")
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def heat_cells(obs: DataFrame, fps: float = 5.0, cell: float = 0.25) -> DataFrame:
    """(camera_id, cell_x, cell_z, seconds, tracks) on the floor's own grid."""
    p = obs.where(finite(F.col("x_m"), F.col("z_m")))
    return p.groupBy("camera_id", F.floor(F.col("x_m") / cell).alias("cell_x"), F.floor(F.col("z_m") / cell).alias("cell_z")).agg((F.count("*") / F.lit(float(fps))).alias("seconds"), F.countDistinct("track_id").alias("tracks"))


def heat_normalised(cells: DataFrame, value: str = "seconds", sigma: float = 1.5, reach: int = 6) -> DataFrame:
    """Cells blurred by a Gaussian (two passes of a table of offsets), cut at the 99th percentile of the occupied ones, as 0 to 1.

    The map ends at the camera's outermost occupied cells and is mirrored there.
    """
    weights = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)}
    kernel = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / sum(weights.values())).alias("g")) for d, w in weights.items()]))
    box = cells.groupBy("camera_id").agg(F.min("cell_x").alias("cell_x_lo"), F.max("cell_x").alias("cell_x_hi"), F.min("cell_z").alias("cell_z_lo"), F.max("cell_z").alias("cell_z_hi"))
    out = cells.select("camera_id", "cell_x", "cell_z", F.col(value).cast("double").alias("v"))
    for axis in ("cell_x", "cell_z"):
        lo, hi = F.col(f"{axis}_lo"), F.col(f"{axis}_hi")
        spread = out.withColumn("_k", kernel).select("*", "_k.d", "_k.g").drop("_k").join(box, "camera_id").withColumn("_at", F.explode(_mirror_sources(F.col(axis), F.col("d"), lo, hi)))
        out = spread.groupBy("camera_id", *[F.col("_at").alias(axis) if c == axis else F.col(c) for c in ("cell_x", "cell_z")]).agg(F.sum(F.col("v") * F.col("g")).alias("v"))
    top = out.where("v > 0").groupBy("camera_id").agg(F.percentile("v", 0.99).alias("_top"))
    return out.join(top, "camera_id").select("camera_id", "cell_x", "cell_z", F.least(F.col("v") / F.col("_top"), F.lit(1.0)).alias("heat"))


def _mirror_sources(cell: Column, d: Column, lo: Column, hi: Column) -> Column:
    """The cells of lo to hi whose neighbour at offset ``d``, mirrored at the map's edges again and again, is ``cell``."""
    n, at = hi - lo + 1, cell - lo
    turns = F.sequence(-F.floor(F.abs(d) / n) - 1, F.floor(F.abs(d) / n) + 1)
    straight = F.transform(turns, lambda k: at - d + 2 * n * k)
    turned = F.transform(turns, lambda k: -1 - at - d + 2 * n * k)
    inside = F.filter(F.concat(straight, turned), lambda i: (i >= 0) & (i < n))
    return F.transform(inside, lambda i: i + lo)


def busiest_zone(obs: DataFrame, cell: float = 0.25, half: float = 0.5) -> DataFrame:
    """Per camera a square around the middle of its fullest cell, with the share of observations in that cell."""
    p = obs.where(finite(F.col("x_m"), F.col("z_m")))
    c = p.groupBy("camera_id", F.floor(F.col("x_m") / cell).alias("cx"), F.floor(F.col("z_m") / cell).alias("cz")).agg(F.count("*").alias("n"))
    best = c.groupBy("camera_id").agg(F.max(F.struct("n", (-F.col("cx")).alias("cx"), (-F.col("cz")).alias("cz"))).alias("m"), F.sum("n").alias("t"))
    x, z = (-F.col("m.cx") + 0.5) * cell, (-F.col("m.cz") + 0.5) * cell
    return best.select("camera_id", (x - half).alias("x_lo"), (x + half).alias("x_hi"), (z - half).alias("z_lo"), (z + half).alias("z_hi"), F.col("m.n").alias("n"), (F.col("m.n") / F.col("t")).alias("share"))


def visits(obs: DataFrame, zones: DataFrame, fps: float | None = 5.0, min_seconds: float = 1.0) -> DataFrame:
    """Stays in zones, where a spell outside shorter than ``min_seconds`` does not end a visit, nor do frames without a row.

    A spell is timed over its own rows, positions that aren't measured included. Without ``fps`` spells have no length
    and each ends a visit. Visits shorter than ``min_seconds`` are dropped. ``observed`` counts all rows of the track in the visit.
    """
    key = [*TRACK, "zone"]
    rows = in_zones(obs, zones)
    w = Window.partitionBy(*key).orderBy("frame_index")
    rows = rows.withColumn("_k", F.sum(F.col("inside").cast("int")).over(w))
    out = F.when(~F.col("inside"), F.col("frame_index"))
    spell = rows.where("_k > 0").groupBy(*key, "_k").agg(F.min(F.when(F.col("inside"), F.col("frame_index"))).alias("frame"), F.min(out).alias("o0"), F.max(out).alias("o1"), F.count(out).alias("n_out"))
    v = Window.partitionBy(*key).orderBy("frame")
    spell = spell.withColumns({"p0": F.lag("o0").over(v), "p1": F.lag("o1").over(v), "pn": F.lag("n_out").over(v)})
    long = F.lit(True) if not fps or not min_seconds else (F.col("p1") - F.col("p0") + 1) / F.lit(float(fps or 1)) >= min_seconds
    spell = spell.withColumn("_new", F.coalesce(F.col("pn") > 0, F.lit(False)) & long)
    spell = spell.withColumn("_v", F.sum(F.col("_new").cast("int")).over(v))
    seconds = (F.col("frame_end") - F.col("frame_start") + 1) / F.lit(float(fps)) if fps else F.lit(None).cast("double")
    got = spell.groupBy(*key, "_v").agg(F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"), F.sum(1 + F.when(F.col("_new") | F.col("pn").isNull(), 0).otherwise(F.col("pn"))).alias("observed"))
    got = got.withColumns({"span": F.col("frame_end") - F.col("frame_start") + 1, "seconds": seconds})
    return got.where(F.col("seconds").isNull() | (F.col("seconds") >= min_seconds)).drop("_v")


def journeys(obs: DataFrame, zones: DataFrame, fps: float | None = 5.0, min_seconds: float = 1.0) -> DataFrame:
    """Per track: span, metres walked between measured positions, seconds, median score, visits and the route of zones."""
    w = Window.partitionBy(*TRACK).orderBy("frame_index")
    m = obs.where(finite(F.col("x_m"), F.col("z_m")))
    step = F.hypot(F.col("x_m") - F.lag("x_m").over(w), F.col("z_m") - F.lag("z_m").over(w))
    path = m.withColumn("_s", step).groupBy(*TRACK).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("path_m"))
    base = obs.groupBy(*TRACK).agg(F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"), F.count("*").alias("observed"), F.median("score").alias("score_p50"))
    seconds = (F.col("frame_end") - F.col("frame_start") + 1) / F.lit(float(fps)) if fps else F.lit(None).cast("double")
    v = visits(obs, zones, fps, min_seconds).groupBy(*TRACK).agg(F.sort_array(F.collect_list(F.struct("frame_start", "zone", "frame_end", "span", "observed", "seconds"))).alias("visits"))
    out = base.withColumn("seconds", seconds).join(path, TRACK, "left").join(v, TRACK, "left")
    empty = F.array().cast("array<struct<frame_start: bigint, zone: string, frame_end: bigint, span: bigint, observed: bigint, seconds: double>>")
    return out.withColumns({"path_m": F.coalesce("path_m", F.lit(0.0)), "visits": F.coalesce("visits", empty)}).withColumn("route", F.transform("visits", lambda x: x["zone"]))


def transitions(journey: DataFrame) -> DataFrame:
    """(camera_id, from_zone, to_zone, n): neighbouring zones of routes."""
    pair = F.zip_with(F.slice("route", 1, F.greatest(F.size("route") - 1, F.lit(0))), F.slice("route", 2, F.size("route")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return journey.where(F.size("route") > 1).select("camera_id", F.explode(pair).alias("p")).groupBy("camera_id", F.col("p.a").alias("from_zone"), F.col("p.b").alias("to_zone")).agg(F.count("*").alias("n"))


def time_in(visit: DataFrame) -> DataFrame:
    """Seconds per track and zone; null where any visit's is."""
    return visit.groupBy(*TRACK, "zone").agg(F.when(F.count("seconds") == F.count("*"), F.sum("seconds")).alias("seconds"))


def zone_totals(visit: DataFrame) -> DataFrame:
    return visit.groupBy("camera_id", "zone").agg(F.count("*").alias("visits"), F.sum("seconds").alias("seconds"), F.countDistinct("track_id").alias("tracks"))


def tracks_in_no_zone(obs: DataFrame, visit: DataFrame) -> DataFrame:
    return obs.select(*TRACK).distinct().join(visit.select(*TRACK).distinct(), TRACK, "left_anti").groupBy("camera_id").agg(F.count("*").alias("tracks"))


def velocity(obs: DataFrame, fps: float | None = 5.0) -> DataFrame:
    """Floor velocity from each observation and the one before; null for the first, without a clock, or off the floor."""
    w = Window.partitionBy(*TRACK).orderBy("frame_index")
    dt = (F.col("frame_index") - F.lag("frame_index").over(w)) / F.lit(float(fps)) if fps else F.lit(None).cast("double")
    ok = finite(F.col("x_m"), F.col("z_m"), F.lag("x_m").over(w), F.lag("z_m").over(w))
    per = lambda c: F.when(ok & (dt > 0), (F.col(c) - F.lag(c).over(w)) / dt)
    return obs.withColumns({"vx": per("x_m"), "vz": per("z_m")})


def world_rows(obs: DataFrame, fps: float | None = 5.0, space: str = "camera_floor") -> DataFrame:
    """One row per observed object and frame on the floor: position, velocity, heading, basis; refusals are null."""
    v = velocity(obs, fps)
    here = finite(F.col("x_m"), F.col("z_m"))
    return v.select("camera_id", F.lit(space).alias("space"), "frame_index", (F.col("frame_index") / F.lit(float(fps)) if fps else F.lit(None).cast("double")).alias("time_s"), "track_id", F.col("class_name").alias("name"), F.when(here, F.col("x_m")).alias("x_m"), F.when(here, F.col("z_m")).alias("z_m"), "vx", "vz", F.when(F.hypot("vx", "vz") > 0, F.atan2("vx", "vz")).alias("yaw"), here.alias("observed"), "score")


def track_lengths(obs: DataFrame) -> DataFrame:
    """Per camera: tracks, median and greatest number of observations; speed in pixels between neighbouring frames, median and 90th percentile."""
    w = Window.partitionBy(*TRACK).orderBy("frame_index")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    s = obs.withColumn("_d", F.when(F.col("frame_index") - F.lag("frame_index").over(w) == 1, F.sqrt((cx - F.lag(cx).over(w)) ** 2 + (cy - F.lag(cy).over(w)) ** 2)))
    t = s.groupBy(*TRACK).agg(F.count("*").alias("_n"))
    speed = s.groupBy("camera_id").agg(F.percentile("_d", 0.5).alias("speed_p50"), F.percentile("_d", 0.9).alias("speed_p90"))
    return t.groupBy("camera_id").agg(F.count("*").alias("tracks"), F.percentile("_n", 0.5).alias("median_length"), F.max("_n").alias("longest")).join(speed, "camera_id")
