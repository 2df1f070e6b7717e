"""Label schemes, vocabularies, thresholds, keypoints and names as column expressions and small joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewatch.functions.geometry import finite

IGNORE = 255

# The limbs of the 17-keypoint human skeleton, as pairs of keypoint indexes; their order is that of the features.
LIMBS = [(5, 7), (7, 9), (6, 8), (8, 10), (11, 13), (13, 15), (12, 14), (14, 16), (5, 6), (11, 12), (5, 11), (6, 12)]
SMALLEST_TORSO = 8.0  # pixels under which a torso is no measure


def remap_labels(rows: DataFrame, mapping: DataFrame, col: str = "source_id") -> DataFrame:
    """Rows with ``class_id`` of a small mapping (source_id, class_id); unmapped ids become IGNORE."""
    return rows.join(F.broadcast(mapping), col, "left").withColumn("class_id", F.coalesce("class_id", F.lit(IGNORE)))


def map_vocabulary(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows whose category (case and outer spaces aside) is an alias, with its class; others go."""
    return rows.withColumn("alias", F.lower(F.trim("category"))).join(F.broadcast(aliases), "alias").drop("alias")


def class_mask(vocabulary: list[str], labelled: Column) -> Column:
    """Which classes of ``vocabulary`` a data set labels, as booleans in its order."""
    return F.array(*[F.array_contains(labelled, v) for v in vocabulary])


def retail_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (name) with the ``group`` of their class, null without one, and a ``label`` that shows both where they differ."""
    j = rows.join(groups, "name", "left")
    return j.withColumn("label", F.when(F.col("group").isNotNull() & (F.col("group") != F.col("name")), F.concat_ws("/", "group", "name")).otherwise(F.col("name")))


def head_order(names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(name, channel): the distinct ``names`` in the order of the taxonomy's ids (name, id), however they were listed; a name
    that the taxonomy hasn't is an error. A head has a few hundred channels, so the numbering is one small window."""
    j = names.select("name").distinct().join(taxonomy.select("name", "id"), "name", "left")
    known = F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("not in the taxonomy: "), F.col("name"))))
    return j.withColumn("id", known).select("name", (F.row_number().over(Window.orderBy("id")) - 1).alias("channel"))


def narrow_indices(keep: DataFrame, trained: DataFrame) -> DataFrame:
    """(name, trained_channel, channel): which channel of a trained head each kept channel is; a class that the head never saw is an error."""
    j = keep.select("name", "channel").join(trained.select("name", F.col("channel").alias("trained_channel")), "name", "left")
    return j.withColumn("trained_channel", F.when(F.col("trained_channel").isNotNull(), F.col("trained_channel")).otherwise(F.raise_error(F.concat(F.lit("not a trained class: "), F.col("name"))))).select("name", "trained_channel", "channel")


def unsourced_classes(taxonomy: DataFrame, mappings: DataFrame) -> DataFrame:
    """Classes that no mapping can produce."""
    return taxonomy.select("class_id").join(mappings.select("class_id"), "class_id", "left_anti").distinct()


def with_overrides(defaults: DataFrame, overrides: DataFrame, cameras: DataFrame) -> DataFrame:
    """(camera_id, class_name, birth, keep, basis): default thresholds with each camera's own over them. An override without a basis is an error."""
    o = overrides.withColumn("basis", F.when(F.length(F.trim("basis")) > 0, F.col("basis")).otherwise(F.raise_error(F.lit("a threshold override has to state its basis"))))
    every = cameras.select("camera_id").join(F.broadcast(defaults))  # a handful of classes for each camera
    o = o.select("camera_id", "class_name", F.col("birth").alias("_b"), F.col("keep").alias("_k"), F.col("basis").alias("_s"))
    return every.join(o, ["camera_id", "class_name"], "left").select("camera_id", "class_name", F.coalesce("_b", "birth").alias("birth"), F.coalesce("_k", "keep").alias("keep"), F.coalesce("_s", F.lit("default")).alias("basis"))


def filter_and_scale(det: DataFrame, thresholds: DataFrame, reference: float = 0.35) -> DataFrame:
    """Detections at or over their class's keep threshold, with ``scaled`` = score * reference / birth."""
    j = det.join(F.broadcast(thresholds), ["camera_id", "class_name"])
    return j.where(F.col("score") >= F.col("keep")).withColumn("scaled", F.col("score") * reference / F.col("birth")).drop("birth", "keep", "basis")


def joint(keypoints: Column, k: int, least: float = 0.3) -> Column:
    """Keypoint ``k`` (struct x, y, conf), null under the confidence."""
    p = F.element_at(keypoints, k + 1)
    return F.when(p["conf"] >= least, p)


TORSO_INSET = 0.15  # fixed value


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; expressions that name a column several times repeat its whole tree."""
    return F.element_at(F.transform(F.array(value), body), 1)


def torso_region(keypoints: Column, least: float = 0.3) -> Column:
    """struct(x0, y0, x1, y1) from the mean row of the measured shoulders to that of the measured hips, as wide as those
    joints, less TORSO_INSET of the width on each side where both shoulders are measured; null without a shoulder and a
    hip, or without an area."""
    some = lambda k: F.filter(F.slice(keypoints, k + 1, 2), lambda p: p["conf"] >= least)
    row = lambda ps: F.aggregate(ps, F.lit(0.0), lambda s, p: s + p["y"]) / F.nullif(F.size(ps), F.lit(0))

    def spans(j: Column) -> Column:
        x = F.transform(F.concat(j["shoulders"], j["hips"]), lambda p: p["x"])
        return F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi"), row(j["shoulders"]).alias("y0"), row(j["hips"]).alias("y1"), (F.size(j["shoulders"]) == 2).alias("both"))

    def region(s: Column) -> Column:
        pad = F.when(s["both"], TORSO_INSET * (s["hi"] - s["lo"])).otherwise(0.0)
        return F.struct((s["lo"] + pad).alias("x0"), s["y0"].alias("y0"), (s["hi"] - pad).alias("x1"), s["y1"].alias("y1"))

    joints = F.struct(some(5).alias("shoulders"), some(11).alias("hips"))
    return _let(_let(_let(joints, spans), region), lambda r: F.when((r["x1"] > r["x0"]) & (r["y1"] > r["y0"]), r))


def torso(keypoints: Column, least: float = 0.3) -> Column:
    """struct(angle, hip_ankle, length): degrees of hips to shoulders from upright, rows from hips to ankles, torso length; null without its joints."""
    j = {k: joint(keypoints, k, least) for k in (5, 6, 11, 12, 15, 16)}
    mid = lambda a, b, c: (j[a][c] + j[b][c]) / 2
    dx, dy = mid(5, 6, "x") - mid(11, 12, "x"), mid(11, 12, "y") - mid(5, 6, "y")
    return F.struct(F.degrees(F.atan2(F.abs(dx), dy)).alias("angle"), (mid(15, 16, "y") - mid(11, 12, "y")).alias("hip_ankle"), F.hypot(dx, dy).alias("length"))


def frame_features(keypoints: Column) -> Column:
    """53 numbers: cosine, sine and length (over the torso's) of twelve limbs, then 17 confidences within 0 to 1.

    A joint is measured if its confidence is over 0. Direction and length are 0 where a joint isn't measured or the limb has no
    length, and lengths are 0 without a torso of SMALLEST_TORSO pixels.
    """
    limbs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in LIMBS])
    measured = F.transform(keypoints, lambda p: F.when((p["conf"] > 0) & finite(p["x"], p["y"]), p))
    some = lambda c: F.coalesce(c, F.lit(0.0))

    def with_scale(at: Column) -> Column:
        mid = lambda a, b, c: (at[a][c] + at[b][c]) / 2
        torso_px = F.hypot(mid(11, 12, "x") - mid(5, 6, "x"), mid(11, 12, "y") - mid(5, 6, "y"))
        return F.struct(at.alias("at"), torso_px.alias("torso"))

    def of_limbs(k: Column) -> Column:
        step = lambda m: F.struct((k["at"][m["b"]]["x"] - k["at"][m["a"]]["x"]).alias("x"), (k["at"][m["b"]]["y"] - k["at"][m["a"]]["y"]).alias("y"))
        scale = F.when(k["torso"] >= SMALLEST_TORSO, k["torso"])
        three = lambda d: _let(F.struct(d["x"].alias("x"), d["y"].alias("y"), F.hypot(d["x"], d["y"]).alias("n")), lambda v: F.array(some(F.when(v["n"] > 1e-6, v["x"] / v["n"])), some(F.when(v["n"] > 1e-6, v["y"] / v["n"])), some(v["n"] / scale)))
        return F.flatten(F.transform(limbs, lambda m: _let(step(m), three)))

    confidence = F.transform(keypoints, lambda p: some(F.greatest(F.least(p["conf"].cast("double"), F.lit(1.0)), F.lit(0.0))))
    return F.concat(_let(_let(measured, with_scale), of_limbs), confidence)


def sequence_features(rows: DataFrame, features: str = "features", *keys: str, order: str = "frame_index") -> DataFrame:
    """Frame features followed by their change since the row before (0 for the first)."""
    prev = F.lag(features).over(Window.partitionBy(*keys).orderBy(order))
    delta = F.zip_with(F.col(features), F.coalesce(prev, F.col(features)), lambda a, b: a - b)
    return rows.withColumn(features, F.concat(F.col(features), delta))


def angle_to(x: Column, y: Column, z: Column, up: tuple[float, float, float]) -> Column:
    """Degrees between a 3D vector and ``up``; null for the zero vector."""
    n = math.sqrt(sum(u * u for u in up))
    d = (x * up[0] + y * up[1] + z * up[2]) / (F.nullif(F.sqrt(x * x + y * y + z * z), F.lit(0.0)) * n)
    return F.degrees(F.acos(F.greatest(F.least(d, F.lit(1.0)), F.lit(-1.0))))


def archive_start(name: Column) -> Column:
    """The UTC start that a file name like archive_20240131-235959_x holds; null if it holds none."""
    stamp = F.regexp_extract(name, r"(\d{8}-\d{6})", 1)
    return F.to_timestamp(F.when(stamp != "", stamp), "yyyyMMdd-HHmmss")


def frame_name(name: Column) -> Column:
    """struct(camera, clip, frame) of a name camera__clip__frame.ext."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", ""), "__")
    return F.struct(F.get(parts, F.lit(0)).alias("camera"), F.get(parts, F.lit(1)).alias("clip"), F.get(parts, F.lit(2)).try_cast("bigint").alias("frame"))


def delivery_tail(value: Column) -> Column:
    """A path-like string cut to its last two parts; other strings as they are."""
    parts = F.filter(F.split(F.regexp_replace(value, r"\\", "/"), "/"), lambda p: p != "")
    return F.when(value.rlike(r"[/\\]") & (F.size(parts) > 2), F.array_join(F.slice(parts, -2, 2), "/")).otherwise(value)
