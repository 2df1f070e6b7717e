"""Camera files, their zones and lines, and floor positions of boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewatch.functions.boxes import box, foot
from aislewatch.functions.geometry import finite, pixel_to_ground, point_in_polygon, undistort, view_ray

# The format of camera files.
WRITTEN_VERSION = 3
READABLE_VERSIONS = (1, 2, 3)
ZONE_KINDS = ("entrance_line", "till", "display", "premium_shelf", "stockroom_door", "forbidden", "walkable")
MASK_IGNORE = 255
SCHEMA = """schema_version INT, camera_id STRING, image_size_px ARRAY<INT>, camera STRUCT<fx: DOUBLE, fy: DOUBLE, cx: DOUBLE, cy: DOUBLE>,
plane STRUCT<height_m: DOUBLE, pitch: DOUBLE, roll: DOUBLE>, lens STRUCT<k1: DOUBLE, centre_px: ARRAY<DOUBLE>, radius_px: DOUBLE>,
zones ARRAY<STRUCT<name: STRING, kind: STRING, points_m: ARRAY<ARRAY<DOUBLE>>>>, shelf_rois_px ARRAY<ARRAY<DOUBLE>>,
false_positive_polygons_px ARRAY<ARRAY<ARRAY<DOUBLE>>>, mask_files MAP<STRING, STRING>, mask_ignore INT, plate_file STRING, plate_sha256 STRING,
commissioned_at STRING, teachers MAP<STRING, STRING>"""


def read_cameras(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Camera files (one JSON object each, or one a line) with ``problems``, all that is wrong with each; nothing is dropped."""
    df = spark.read.schema(SCHEMA).option("multiLine", not lines).json(path)
    return df.withColumn("problems", camera_problems())


def usable(cameras: DataFrame) -> DataFrame:
    """Cameras without problems."""
    return cameras.where(F.size("problems") == 0)


def write_cameras(cameras: DataFrame, path: str) -> None:
    """Writes camera rows as JSON objects of the present version, one a line."""
    cameras.drop("problems").withColumn("schema_version", F.lit(WRITTEN_VERSION)).write.mode("overwrite").json(path)


def camera_problems() -> Column:
    """The names of all checks that a camera row fails."""
    w, h = F.get("image_size_px", F.lit(0)), F.get("image_size_px", F.lit(1))
    cam, plane, lens = F.col("camera"), F.col("plane"), F.col("lens")
    zones = F.coalesce("zones", F.expr("CAST(array() AS ARRAY<STRUCT<name: STRING, kind: STRING, points_m: ARRAY<ARRAY<DOUBLE>>>>)"))
    rois = F.coalesce("shelf_rois_px", F.expr("CAST(array() AS ARRAY<ARRAY<DOUBLE>>)"))
    half = F.hypot(w, h) / 2
    positive = lambda c: finite(c) & (c > 0)
    inside = lambda r: (r[0] >= 0) & (r[0] < r[2]) & (r[2] <= w) & (r[1] >= 0) & (r[1] < r[3]) & (r[3] <= h)
    checks = {
        "schema_version": F.col("schema_version").isin(*READABLE_VERSIONS),
        "image_size_px": (w > 0) & (h > 0),
        "fx": positive(cam["fx"]),
        "fy": positive(cam["fy"]),
        "height_m": positive(plane["height_m"]),
        "pitch": (plane["pitch"] > -math.pi / 2) & (plane["pitch"] < math.pi / 2),
        "zone kind": ~F.exists(zones, lambda z: ~z["kind"].isin(*ZONE_KINDS)),
        "zone points": ~F.exists(zones, lambda z: F.size(z["points_m"]) < F.when(z["kind"] == "entrance_line", 2).otherwise(3)),
        "shelf_rois_px": ~F.exists(rois, lambda r: ~F.coalesce(inside(r), F.lit(False))),
        "principal point": ~((w > 0) & (h > 0)) | (cam["cx"].between(0.25 * w, 0.75 * w) & cam["cy"].between(0.25 * h, 0.75 * h)),
        "lens k1": lens.isNull() | ((lens["k1"] > -1) & (lens["k1"] < 1)),
        "lens centre": lens.isNull() | (lens["centre_px"][0].between(0, w) & lens["centre_px"][1].between(0, h)),
        "lens radius": lens.isNull() | (half <= 0) | lens["radius_px"].between(0.5 * half, 1.5 * half),
        "mask_ignore": F.coalesce("mask_ignore", F.lit(MASK_IGNORE)) == MASK_IGNORE,
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def _corners(points: Column, x: str = "x", z: str = "z") -> Column:
    return F.transform(points, lambda p: F.struct(p[0].alias(x), p[1].alias(z)))


def zones_of(cameras: DataFrame, *kinds: str) -> DataFrame:
    """(camera_id, zone, kind, polygon) of the cameras' polygons, of some kinds or all; entrance lines are not among them.
    Policy (limits, times) isn't in camera files."""
    z = cameras.select("camera_id", F.explode("zones").alias("z")).where("z.kind <> 'entrance_line'")
    if kinds:
        z = z.where(F.col("z.kind").isin(*kinds))
    return z.select("camera_id", F.col("z.name").alias("zone"), F.col("z.kind").alias("kind"), _corners(F.col("z.points_m")).alias("polygon"))


def lines_of(cameras: DataFrame) -> DataFrame:
    """(camera_id, line, ax, az, bx, bz) of entrance lines; one that hasn't two points is an error."""
    z = cameras.select("camera_id", F.explode("zones").alias("z")).where("z.kind = 'entrance_line'")
    points = F.when(F.size("z.points_m") == 2, F.col("z.points_m")).otherwise(F.raise_error(F.concat(F.lit("an entrance line has two points: "), F.col("z.name"))))
    return z.select("camera_id", F.col("z.name").alias("line"), points.alias("p")).select("camera_id", "line", *[F.col("p")[k][c].alias(n) for k, c, n in ((0, 0, "ax"), (0, 1, "az"), (1, 0, "bx"), (1, 1, "bz"))])


def walkable_bounds(cameras: DataFrame, margin: float = 2.0) -> DataFrame:
    """(camera_id, x_lo, x_hi, z_lo, z_hi): the box around a camera's walkable zones with a margin, never behind the camera;
    24 x 14 m ahead without any."""
    w = zones_of(cameras, "walkable").select("camera_id", F.explode("polygon").alias("p")).groupBy("camera_id").agg(F.min("p.x").alias("a"), F.max("p.x").alias("b"), F.min("p.z").alias("c"), F.max("p.z").alias("d"))
    j = cameras.select("camera_id").join(w, "camera_id", "left")
    bounds = {"x_lo": (F.col("a") - margin, -12.0), "x_hi": (F.col("b") + margin, 12.0), "z_lo": (F.greatest(F.lit(0.0), F.col("c") - margin), 0.0), "z_hi": (F.col("d") + margin, 14.0)}
    return j.select("camera_id", *[F.coalesce(v, F.lit(other)).alias(c) for c, (v, other) in bounds.items()])


def in_walkable(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """``points`` (camera_id, x_m, z_m, ...) with ``walkable``: whether any walkable zone of the camera holds them."""
    polygons = zones_of(cameras, "walkable").groupBy("camera_id").agg(F.collect_list("polygon").alias("_polygons"))
    hit = F.exists("_polygons", lambda p: point_in_polygon(F.col("x_m"), F.col("z_m"), p))
    return points.join(polygons, "camera_id", "left").withColumn("walkable", F.coalesce(hit, F.lit(False))).drop("_polygons")


def in_fp_zone(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """``points`` (camera_id, u, v, ...) with ``vetoed``: whether any false-positive polygon of the camera holds the pixel."""
    polygons = cameras.select("camera_id", F.transform("false_positive_polygons_px", lambda p: _corners(p)).alias("_polygons"))
    hit = F.exists("_polygons", lambda p: point_in_polygon(F.col("u"), F.col("v"), p))
    return points.join(polygons, "camera_id", "left").withColumn("vetoed", F.coalesce(hit, F.lit(False))).drop("_polygons")


def as_struct(cameras: DataFrame) -> DataFrame:
    """(camera_id, camera, lens): intrinsics and plane as the struct that geometry functions take; cameras with problems are left out."""
    fields = [F.col(f"camera.{c}").alias(c) for c in ("fx", "fy", "cx", "cy")] + [F.col("plane.height_m").alias("height"), F.col("plane.pitch").alias("pitch"), F.col("plane.roll").alias("roll")]
    return usable(cameras).select("camera_id", F.struct(*fields).alias("camera"), "lens")


def floor_positions(boxes: DataFrame, cameras: DataFrame) -> DataFrame:
    """Boxes in undistorted pixels with x_m, z_m under the middle of their lower edge; null at or above the horizon."""
    j = boxes.join(cameras, "camera_id")
    return j.withColumn("_g", pixel_to_ground(*foot(box()), F.col("camera"))).withColumns({"x_m": F.col("_g.x"), "z_m": F.col("_g.z")}).drop("_g", "camera")


def box_extents(boxes: DataFrame, cameras: DataFrame) -> DataFrame:
    """Boxes with width_m, between the floor points of the two lower corners, and height_m, of the upper edge over the
    lower one's distance; null where the box can't be placed."""
    b, cam = box(), F.col("camera")
    left, right = pixel_to_ground(b[0], b[3], cam), pixel_to_ground(b[2], b[3], cam)
    _, down, ahead = view_ray((b[0] + b[2]) / 2, b[1], cam)
    height = cam["height"] - (left["z"] + right["z"]) / 2 / F.nullif(ahead, F.lit(0.0)) * down
    j = boxes.join(cameras, "camera_id")
    return j.withColumns({"width_m": F.abs(right["x"] - left["x"]), "height_m": F.when(finite(height) & (height > 0), height)}).drop("camera")


def ground_points(points: DataFrame, cameras: DataFrame, above_horizon: str) -> DataFrame:
    """Pixels (camera_id, u, v, ...) as floor metres x_m, z_m, the lens undone where the camera has one.

    ``above_horizon`` has to be chosen: "drop" leaves points without a floor position out (masks), "raise" makes one an
    error (hand-drawn corners).
    """
    if above_horizon not in ("drop", "raise"):
        raise ValueError("above_horizon is 'drop' or 'raise'")
    lens = F.col("lens")
    plain = undistort(F.col("u"), F.col("v"), lens["k1"], lens["centre_px"][0], lens["centre_px"][1], lens["radius_px"])
    straight = F.when(lens.isNull(), F.struct(F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))).otherwise(plain)
    j = points.join(as_struct(cameras), "camera_id").withColumn("_p", straight)
    j = j.withColumn("_g", pixel_to_ground(F.col("_p.u"), F.col("_p.v"), F.col("camera"))).withColumns({"x_m": F.col("_g.x"), "z_m": F.col("_g.z")}).drop("_p", "_g", "camera", "lens")
    ok = finite(F.col("x_m"), F.col("z_m"))
    if above_horizon == "drop":
        return j.where(ok)
    return j.withColumn("x_m", F.when(ok, F.col("x_m")).otherwise(F.raise_error(F.concat(F.lit("a point at or above the horizon: "), F.col("camera_id").cast("string")))))


def to_calibrated(points: DataFrame, cameras: DataFrame, source: tuple[int, int] | None = None, slack: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(scaled, refused): points (camera_id, u, v) in the pixels of their camera's picture.

    With ``source``, the size of the picture that they are pixels of, they are scaled. Without, they are taken as they
    are, and those of a camera of which any point lies over ``slack`` times the picture's size from its corner are refused.
    """
    size = cameras.select("camera_id", F.get("image_size_px", F.lit(0)).alias("_w"), F.get("image_size_px", F.lit(1)).alias("_h"))
    p = points.join(size, "camera_id")
    if source:
        p = p.withColumns({"u": F.col("u") * F.col("_w") / source[0], "v": F.col("v") * F.col("_h") / source[1]}).drop("_w", "_h")
        return p, p.where(F.lit(False))
    far = (F.abs("u") > slack * F.greatest("_w", F.lit(1))) | (F.abs("v") > slack * F.greatest("_h", F.lit(1)))
    bad = p.where(far).select("camera_id").distinct()
    p = p.drop("_w", "_h")
    return p.join(bad, "camera_id", "left_anti"), p.join(bad, "camera_id", "left_semi")
