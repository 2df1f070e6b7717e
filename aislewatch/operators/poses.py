"""Posture events from keypoints (array of struct x, y, conf) and label runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewatch.functions.labels import joint, torso
from aislewatch.operators.runs import TRACK, observed_runs, run_seconds, window_median


def _spells(rows: DataFrame, flag: Column, fps: float, min_seconds: float, *more: Column) -> DataFrame:
    runs = observed_runs(rows, TRACK, flag).groupBy(*TRACK, "run").agg(F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"), *more)
    return runs.drop("run").withColumn("value", run_seconds(fps)).where(F.col("value") >= min_seconds)


def _postures(rows: DataFrame, before: int) -> DataFrame:
    """``rows`` with _angle, _ratio (hips to ankles over the torso's length), _h (box height) and _k (place in the track)."""
    t, order = torso(F.col("keypoints")), Window.partitionBy(*TRACK).orderBy("frame_index")
    ratio = F.when((t["length"] > 0) & t["hip_ankle"].isNotNull(), t["hip_ankle"] / t["length"])
    r = rows.withColumns({"_angle": t["angle"], "_ratio": ratio, "_h": F.col("y1") - F.col("y0"), "_k": F.row_number().over(order)})
    w = order.rowsBetween(-before, -1)
    return r.withColumns({"_ref": window_median("_h", w), "_n": F.count("_h").over(w)})


def _shrunk_spells(r: DataFrame, flag: Column, fps: float, min_seconds: float, shrink: float, *more: Column) -> DataFrame:
    """Spells of ``flag`` whose median box height is at most ``shrink`` times the median of the observations before (three at least)."""
    first = F.min_by(F.struct("_ref", "_n"), "frame_index").alias("_s")
    s = _spells(r, flag, fps, min_seconds, first, F.percentile("_h", 0.5).alias("_m"), *more)
    return s.where((F.col("_s._n") >= 3) & (F.col("_s._ref") > 0) & (F.col("_m") <= shrink * F.col("_s._ref")))


def fall(rows: DataFrame, fps: float = 5.0, angle: float = 55.0, min_seconds: float = 1.0, shrink: float = 0.9, before_seconds: float = 2.0, head: str | None = None, head_height: float = 0.8, head_seconds: float = 0.7) -> DataFrame:
    """A torso at least ``angle`` degrees from upright, sustained, in a box that got lower than before.

    With ``head``, a column of metres of the head over the floor (null where it can't be measured), a spell in which it is
    measured also has to keep it at ``head_height`` or lower for ``head_seconds`` on end.
    """
    r = _postures(rows, max(3, round(before_seconds * fps)))
    flag = F.coalesce(F.col("_angle") >= angle, F.lit(False))
    more = [F.max("_angle").alias("angle")]
    if head:
        low = F.coalesce(F.col(head) <= head_height, F.lit(False))
        order = Window.partitionBy(*TRACK).orderBy("frame_index")
        r = r.withColumn("_flag", flag).withColumn("_run0", F.sum(F.when(F.col("_flag") & low, 0).otherwise(1)).over(order))
        r = r.withColumn("_low", F.when(F.col("_flag") & low, F.count(F.when(F.col("_flag") & low, 1)).over(Window.partitionBy(*TRACK, "_run0"))).otherwise(0))
        more += [F.max("_low").alias("_lowest"), F.count(head).alias("_seen")]
    s = _shrunk_spells(r, flag, fps, min_seconds, shrink, *more)
    if head:
        s = s.where((F.col("_seen") == 0) | (F.col("_lowest") / fps >= head_seconds))
    return s.select(F.lit("fall").alias("type"), *TRACK, "frame_start", "frame_end", "value", "angle")


def crouch(rows: DataFrame, fps: float = 5.0, ratio: float = 0.6, min_seconds: float = 1.0, angle: float = 55.0, shrink: float = 0.9, before_seconds: float = 2.0) -> DataFrame:
    """Hips close to the ankles for the length of the torso, the trunk upright (under ``angle``, or not measured), sustained, in a
    box that got lower than before."""
    r = _postures(rows, max(3, round(before_seconds * fps)))
    flag = (F.coalesce("_angle", F.lit(0.0)) < angle) & F.coalesce(F.col("_ratio") <= ratio, F.lit(False))
    return _shrunk_spells(r, flag, fps, min_seconds, shrink, F.min("_ratio").alias("ratio")).select(F.lit("crouch").alias("type"), *TRACK, "frame_start", "frame_end", "value", "ratio")


def wrist_contact(rows: DataFrame, runs: DataFrame, fixture: int, person: int, radius: float = 25.0) -> DataFrame:
    """(camera_id, track_id, frame_index, contact): share of ``fixture`` among the labels other than ``person`` within ``radius`` of either wrist.

    Runs of a row are cut to the chord of the disk in that row; wrists meet runs of their frame by bands of rows.
    """
    band = max(int(2 * radius), 1)
    w = rows.select(*TRACK, "frame_index", F.explode(F.array(joint(F.col("keypoints"), 9), joint(F.col("keypoints"), 10))).alias("w")).where("w IS NOT NULL")
    w = w.withColumn("_b", F.explode(F.sequence(F.floor((F.col("w.y") - radius) / band), F.floor((F.col("w.y") + radius) / band))))
    r = runs.where(F.col("class_id") != person).withColumn("_b", F.floor(F.col("y") / band))
    j = w.join(r, ["camera_id", "frame_index", "_b"])
    dy = F.col("y") - F.col("w.y")
    half = F.sqrt(F.greatest(F.lit(radius * radius) - dy * dy, F.lit(0.0)))
    length = F.greatest(F.least(F.col("x_end").cast("double"), F.col("w.x") + half) - F.greatest(F.col("x_start").cast("double"), F.col("w.x") - half), F.lit(0.0))
    j = j.withColumn("_l", length).where("_l > 0")
    return j.groupBy(*TRACK, "frame_index").agg((F.sum(F.when(F.col("class_id") == fixture, F.col("_l")).otherwise(0.0)) / F.sum("_l")).alias("contact"))


def reach_to_shelf(rows: DataFrame, contact: DataFrame, fps: float = 5.0, share: float = 0.35, min_seconds: float = 0.6) -> DataFrame:
    r = rows.join(contact, [*TRACK, "frame_index"], "left")
    return _spells(r, F.col("contact") >= share, fps, min_seconds, F.max("contact").alias("contact")).select(F.lit("reach_to_shelf").alias("type"), *TRACK, "frame_start", "frame_end", "value", "contact")


def visit_overlap(truth: DataFrame, pred: DataFrame, bucket: int = 64) -> DataFrame:
    """True visits with the longest predicted visit of the same camera and zone that overlaps them (0 if none). Visits meet in the buckets of ``bucket`` frames that both cover."""
    covers = F.explode(F.sequence(F.floor(F.col("frame_start") / bucket), F.floor(F.col("frame_end") / bucket)))
    p = pred.withColumn("_k", covers).select("camera_id", "zone", "_k", F.col("frame_start").alias("_a"), F.col("frame_end").alias("_b"), F.col("seconds").alias("_s"))
    j = truth.withColumn("_k", covers).join(p, ["camera_id", "zone", "_k"], "left").withColumn("_s", F.when((F.col("_a") <= F.col("frame_end")) & (F.col("frame_start") <= F.col("_b")), F.col("_s")))
    return j.groupBy(*truth.columns).agg(F.coalesce(F.max("_s"), F.lit(0.0)).alias("found_seconds"))


def visit_purity(visits: DataFrame, owners: DataFrame) -> DataFrame:
    """Visits with the truth identity that most of their frames had, and its share; ``owners``: camera_id, track_id, frame_index, gt_id."""
    j = visits.join(owners, TRACK).where("frame_index BETWEEN frame_start AND frame_end")
    n = j.groupBy(*TRACK, "zone", "frame_start", "frame_end", "gt_id").agg(F.count("*").alias("n"))
    g = n.groupBy(*TRACK, "zone", "frame_start", "frame_end").agg(F.max(F.struct("n", (-F.col("gt_id")).alias("g"))).alias("m"), F.sum("n").alias("t"))
    return g.select(*TRACK, "zone", "frame_start", "frame_end", (-F.col("m.g")).alias("gt_id"), (F.col("m.n") / F.col("t")).alias("purity"))


def embedding_collisions(rows: DataFrame) -> DataFrame:
    """(a, b, cosine, excess) of class pairs: mean embeddings of classes, and how far over the median cosine each pair is. A row a class: classes are few."""

    long = rows.select("pid", F.posexplode("feat").alias("i", "x")).groupBy("pid", "i").agg(F.avg("x").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("pid")))
    u = long.withColumn("u", F.col("x") / norm)
    pairs = u.select(F.col("pid").alias("a"), "i", F.col("u").alias("ua")).join(u.select(F.col("pid").alias("b"), "i", F.col("u").alias("ub")), "i").where("a < b")
    cos = pairs.groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("cosine"))
    floor = cos.agg(F.percentile("cosine", 0.5).alias("floor"))  # one row
    return cos.join(F.broadcast(floor)).withColumn("excess", F.greatest(F.lit(0.0), (F.col("cosine") - F.col("floor")) / (1 - F.col("floor"))))


def leave_one_out(rows: DataFrame, features: list[str], key: str = "camera", steps: int = 12, ridge: float = 1e-2) -> DataFrame:
    """(key, n, positives, accuracy) of each fold (value of ``key``) under a class-balanced logistic fit of all others.

    Features are standardised with the means and standard deviations of the rows that a fold is fitted to, never those of its own. All folds' Newton
    steps are taken together: each step is one aggregation by fold, of which k x k sums a fold reach the driver. Folds (cameras, performers) are
    few, and are broadcast; a row takes part in the sums of every fold but its own. A fold whose other rows are of one class has no
    fit: its accuracy is null. ``checkpoint`` keeps the rows for the steps.
    """
    import numpy as np

    m = len(features)
    k = m + 1
    x = rows.select(F.col(key).alias("_key"), F.col("label").cast("double").alias("_y"), F.array(*[F.col(c).cast("double") for c in features]).alias("_raw")).checkpoint()
    sums = x.groupBy("_key", "_y").agg(F.count("*").alias("n"), *[F.sum(F.col("_raw")[i]).alias(f"s{i}") for i in range(m)], *[F.sum(F.col("_raw")[i] * F.col("_raw")[i]).alias(f"q{i}") for i in range(m)]).collect()
    folds = sorted({r["_key"] for r in sums})
    size = {f: [sum(r["n"] for r in sums if r["_key"] != f and int(r["_y"]) == c) for c in (0, 1)] for f in folds}
    scale = {}
    for f in folds:
        others = [r for r in sums if r["_key"] != f]
        n = max(1, sum(r["n"] for r in others))
        mean = np.array([sum(r[f"s{i}"] for r in others) for i in range(m)]) / n
        square = np.array([sum(r[f"q{i}"] for r in others) for i in range(m)]) / n
        scale[f] = mean, np.sqrt(np.maximum(square - mean**2, 0)) + 1e-6
    w = {f: np.zeros(k) for f in folds if min(size[f]) > 0}
    kind = x.schema["_key"].dataType.simpleString()

    def fold_table() -> DataFrame:
        data = [(f, [float(v) for v in w[f]], [0.5 / n for n in size[f]], *([float(v) for v in s] for s in scale[f])) for f in w]
        return F.broadcast(rows.sparkSession.createDataFrame(data, f"_fold {kind}, _w array<double>, _c array<double>, _mean array<double>, _sd array<double>"))

    standard = F.concat(F.zip_with(F.zip_with("_raw", "_mean", lambda a, b: a - b), "_sd", lambda a, b: a / b), F.array(F.lit(1.0)))
    dot = F.aggregate(F.zip_with("_w", "_x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    for _ in range(steps if w else 0):
        j = x.join(fold_table(), F.col("_key") != F.col("_fold")).withColumn("_x", standard).withColumn("_p", 1 / (1 + F.exp(-dot))).withColumn("_cost", F.element_at("_c", F.col("_y").cast("int") + 1))
        g = [F.sum(F.col("_cost") * (F.col("_y") - F.col("_p")) * F.col("_x")[i]) for i in range(k)]
        h = [F.sum(F.col("_cost") * F.col("_p") * (1 - F.col("_p")) * F.col("_x")[a] * F.col("_x")[b]) for a in range(k) for b in range(a, k)]
        moved = 0.0
        for r in j.groupBy("_fold").agg(*[c.alias(f"c{i}") for i, c in enumerate(g + h)]).collect():
            v, hess = np.array(r[1 : k + 1], float), np.zeros((k, k))
            hess[np.triu_indices(k)] = r[k + 1 :]
            hess = hess + np.triu(hess, 1).T
            step = np.linalg.solve(hess + ridge * np.eye(k), v - ridge * w[r[0]])
            w[r[0]], moved = w[r[0]] + step, max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    own = x.join(fold_table(), F.col("_key") == F.col("_fold"), "left").withColumn("_x", standard) if w else x.select("*", F.lit(None).cast("array<double>").alias("_w"), F.lit(None).cast("array<double>").alias("_x"))
    right = F.when(F.col("_w").isNotNull(), ((dot >= 0).cast("double") == F.col("_y")).cast("double"))
    return own.groupBy(F.col("_key").alias(key)).agg(F.count("*").alias("n"), F.sum("_y").cast("long").alias("positives"), F.avg(right).alias("accuracy"))


def licence(held_out: DataFrame, least: float = 0.90) -> DataFrame:
    """Per camera whether a verdict may be given, with the reason if not."""
    r = F.when(F.col("accuracy").isNull() | (F.col("positives") == 0) | (F.col("positives") == F.col("n")), "one class only").when(F.col("accuracy") < least, "accuracy too low")
    return held_out.select("*", r.alias("reason"), r.isNull().alias("licensed"))
