"""What single boxes, labels and scores say of each other: joins and tallies behind reviews of detections and tracks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewatch.functions.boxes import area, box, intersection, iou
from aislewatch.operators.overlaps import nearest, overlapping
from aislewatch.operators.pairs import compared
from aislewatch.operators.runs import TRACK

FRAME = ["camera_id", "frame_index"]
CORNERS = ["x0", "y0", "x1", "y1"]


def _other(prefix: str) -> tuple[Column, ...]:
    return box(prefix)


def _renamed(boxes: DataFrame, prefix: str, *more: str) -> DataFrame:
    return boxes.select(*FRAME, *[F.col(c).alias(f"{prefix}{c}") for c in (*CORNERS, *more)])


def high_band_only(tracks: DataFrame, det: DataFrame, least: float, places: int = 4) -> DataFrame:
    """Observations with ``band``: whether their detection, found by its rounded box in its frame, scores ``least`` or
    more. Without such a detection the score is unknown and the observation stays in the band."""
    key = [F.round(c, places).alias(f"_{c}") for c in CORNERS]
    scores = det.select(*FRAME, *key, "score").groupBy(*FRAME, *[f"_{c}" for c in CORNERS]).agg(F.max("score").alias("_s"))
    j = tracks.select("*", *key).join(scores, [*FRAME, *[f"_{c}" for c in CORNERS]], "left")
    return j.withColumn("band", F.coalesce(F.col("_s") >= least, F.lit(True))).drop("_s", *[f"_{c}" for c in CORNERS])


def nearest_labels(obs: DataFrame, det: DataFrame) -> DataFrame:
    """Observations with ``label``: the class of the detection of their frame whose corners are nearest (sum of distances;
    ties: the smallest det_id)."""
    j = nearest(obs, det.withColumnRenamed("class_name", "d_class_name"), FRAME, ["track_id"], ["det_id", "d_class_name"], "det_id")
    return j.groupBy(*TRACK, "frame_index").agg(F.min_by("d_class_name", F.struct("gap", "det_id")).alias("label"))


def detection_of(obs: DataFrame, det: DataFrame, least: float = 0.99) -> DataFrame:
    """(track, frame, det_id): which detection an observation was: the one of the highest IoU (ties: the smallest id), if it is ``least`` or more."""
    j = overlapping(obs, det, least, FRAME, ["track_id"], ["det_id"])
    return j.groupBy(*TRACK, "frame_index").agg(F.max_by("det_id", F.struct("iou", -F.col("det_id"))).alias("det_id"))


def witness(ends: DataFrame, det: DataFrame, dense: DataFrame, frames: int = 5, match: float = 0.3, present: float = 0.1, good: float = 0.35, weak: float = 0.15) -> DataFrame:
    """(track, best_assoc, best_score, dense, verdict) of tracks that ended (last frame and box in ``ends``).

    Over the next ``frames`` frames: the best score of a box that the tracker could have matched, that of any box at the place,
    and whether the dense head saw somebody there. available: the tracker had a good box; demoted: the detector's box scored
    too low; boxless: only the dense head; vacated: nobody.
    """
    want = ends.withColumn("_f", F.explode(F.sequence(F.col("frame_index") + 1, F.col("frame_index") + frames))).drop("frame_index").withColumnRenamed("_f", "frame_index")
    d = want.join(_renamed(det, "d_", "score"), FRAME).withColumn("_i", iou(box(), _other("d_")))
    top = lambda t: F.coalesce(F.max(F.when(F.col("_i") >= t, F.col("d_score"))), F.lit(0.0))
    boxes = d.groupBy(*TRACK).agg(top(match).alias("best_assoc"), top(present).alias("best_score"))
    seen = want.join(_renamed(dense, "d_"), FRAME).where(iou(box(), _other("d_")) >= present).select(*TRACK).distinct().withColumn("dense", F.lit(True))
    j = ends.select(*TRACK).join(boxes, TRACK, "left").join(seen, TRACK, "left").fillna({"best_assoc": 0.0, "best_score": 0.0, "dense": False})
    verdict = F.when(F.col("best_assoc") >= good, "available").when(F.col("best_score") >= weak, "demoted").when(F.col("dense"), "boxless").otherwise("vacated")
    return j.withColumn("verdict", verdict)


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def reference_distances(obs: DataFrame, features: list[str], least: int = 6) -> DataFrame:
    """(camera_id, kind, a, b, distance): what a join between tracks is read against.

    "within": between the mean features of a track's first and second half, of tracks with ``least`` rows; "between":
    between the means of two tracks that share a frame. Features are standardised over their camera.
    """
    cam = obs.groupBy("camera_id").agg(*[f(c).alias(f"_{k}{n}") for n, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = obs.join(cam, "camera_id").select(*TRACK, "frame_index", *[((F.col(c) - F.col(f"_m{n}")) / (F.col(f"_s{n}") + 1e-6)).alias(c) for n, c in enumerate(features)])
    order, every = Window.partitionBy(*TRACK).orderBy("frame_index"), Window.partitionBy(*TRACK)
    half = z.withColumns({"_k": F.row_number().over(order), "_n": F.count("*").over(every)}).where(F.col("_n") >= least).withColumn("_first", F.col("_k") <= F.floor(F.col("_n") / 2))
    mean = lambda c: F.array(*[F.avg(F.when(c, F.col(f))) for f in features])
    within = half.groupBy(*TRACK).agg(mean(F.col("_first")).alias("u"), mean(~F.col("_first")).alias("v")).select("camera_id", F.lit("within").alias("kind"), F.col("track_id").alias("a"), F.col("track_id").alias("b"), _distance("u", "v").alias("distance"))
    means = z.groupBy(*TRACK).agg(F.array(*[F.avg(f) for f in features]).alias("v"))
    between = compared(obs, means, "distance", lambda u, v: np.sqrt(((u - v) ** 2).sum(axis=1)))
    return within.unionByName(between.select("camera_id", F.lit("between").alias("kind"), "a", "b", "distance"))


def coexisting_cosines(obs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(camera_id, a, b, cosine) of tracks that share a frame and so are two people; ``embeddings``: track_id, feat."""
    dot = lambda u, v: (u * v).sum(axis=1)
    return compared(obs, embeddings.select("track_id", F.col("feat").alias("v")), "cosine", lambda u, v: dot(u, v) / (np.sqrt(dot(u, u)) * np.sqrt(dot(v, v))))


def adjacent_candidates(det: DataFrame, least: float = 0.5) -> DataFrame:
    """(camera_id, a_id, b_id, score): detections of one class in frames f and f + 1 that overlap by ``least``; score falls with the overlap."""
    after = det.select("camera_id", (F.col("frame_index") - 1).alias("frame_index"), "class_name", F.col("det_id").alias("b_id"), *CORNERS)
    j = overlapping(det.withColumnRenamed("det_id", "a_id"), after, least, [*FRAME, "class_name"], ["a_id"], ["b_id"])
    return j.select("camera_id", "a_id", "b_id", (1 - F.col("iou")).alias("score"))


def box_survival(det: DataFrame, least: float = 0.5) -> DataFrame:
    """(camera_id, head, length): how many frames on end each raw box lives, linked greedily from frame to frame within its class."""
    from aislewatch.operators.tracks import chains, stitch_greedy

    heads = chains(stitch_greedy(adjacent_candidates(det, least))).select("camera_id", F.col("track_id").alias("det_id"), "head")
    j = det.select("camera_id", "det_id").join(heads, ["camera_id", "det_id"], "left").withColumn("head", F.coalesce("head", "det_id"))
    return j.groupBy("camera_id", "head").agg(F.count("*").alias("length"))


def survival_report(lives: DataFrame) -> DataFrame:
    """Per camera: lives, their mean, median and longest length, and the shares of one frame and of five or more."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return lives.groupBy("camera_id").agg(F.count("*").alias("lives"), F.avg("length").alias("mean"), F.percentile("length", 0.5).alias("p50"), F.max("length").alias("longest"), share(F.col("length") == 1).alias("one_frame"), share(F.col("length") >= 5).alias("five_or_more"))


def dense_against_boxes(regions: DataFrame, boxes: DataFrame, cover: float = 0.3, fragment: float = 0.5, confirm: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(regions with best, contained and verdict; boxes with confirmed) of each frame.

    A region is covered if a box overlaps it by IoU ``cover``, else a fragment if ``fragment`` of it lies in a box, else uncovered. A
    box is confirmed if ``confirm`` of some region lies in it. ``regions`` have region_id, ``boxes`` det_id.
    """
    j = regions.select(*FRAME, "region_id", *CORNERS).join(_renamed(boxes, "d_", "det_id"), FRAME)
    both = F.when(area(box()) > 0, intersection(box(), _other("d_")) / area(box())).otherwise(0.0)
    j = j.withColumns({"_i": iou(box(), _other("d_")), "_c": both})
    best = j.groupBy(*FRAME, "region_id").agg(F.max("_i").alias("best"), F.max("_c").alias("contained"))
    r = regions.join(best, [*FRAME, "region_id"], "left").fillna({"best": 0.0, "contained": 0.0})
    r = r.withColumn("verdict", F.when(F.col("best") >= cover, "covered").when(F.col("contained") >= fragment, "fragment").otherwise("uncovered"))
    yes = j.where(F.col("_c") >= confirm).select(*FRAME, F.col("d_det_id").alias("det_id")).distinct().withColumn("confirmed", F.lit(True))
    return r, boxes.join(yes, [*FRAME, "det_id"], "left").fillna({"confirmed": False})


def night_veto(boxes: DataFrame, score: float = 0.35, drop_from: float = 0.5, least_pixels: int = 64) -> DataFrame:
    """Boxes (score, share of static pixels, plate_pixels or null without a plate, excluded) with ``keep`` and ``reason``, in the order of the rules."""
    reason = (
        F.when(F.col("excluded"), "camera excluded").when(F.col("score") < score, "below score threshold").when(F.col("plate_pixels").isNull(), "no static plate")
        .when(F.col("plate_pixels") < least_pixels, "kept: plate too coarse").when(F.col("share") >= drop_from, "static: furniture").otherwise("kept")
    )
    return boxes.withColumn("reason", reason).withColumn("keep", F.col("reason").startswith("kept"))


def night_ghosts(decisions: DataFrame) -> DataFrame:
    """Per camera of closed-shop clips: person boxes over the score threshold, those left by the veto, frames with either."""
    over = ~F.col("reason").isin("camera excluded", "below score threshold")
    n = lambda c: F.count(F.when(c, 1))
    return decisions.groupBy("camera_id").agg(n(over).alias("before"), n(F.col("keep")).alias("after"), F.countDistinct(F.when(over, F.col("frame_index"))).alias("frames_before"), F.countDistinct(F.when(F.col("keep"), F.col("frame_index"))).alias("frames_after"))


def score_density(frames: DataFrame, quantiles: tuple[float, ...] = (0.0, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9, 1.0)) -> DataFrame:
    """Frames (person_px, top, n_high, n_low) in bands of person pixels between quantiles, both ends in: frames and medians of each band.

    The edges, to six places, are one row; a frame on an edge counts in both bands.
    """
    edges = frames.agg(F.percentile("person_px", F.array(*map(F.lit, quantiles)))).first()[0]
    edges = [round(e, 6) for e in edges or []]
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))] or [F.expr("named_struct('band', 0, 'lo', 0e0, 'hi', -1e0)")])
    j = frames.select("*", F.explode(bands).alias("x")).where("person_px BETWEEN x.lo AND x.hi")
    m = lambda c: F.percentile(c, 0.5).alias(c)
    return j.groupBy("x.band", "x.lo", "x.hi").agg(F.count("*").alias("frames"), m("top"), m("n_high"), m("n_low"))


def standing(boxes: DataFrame, runs: DataFrame, kinds: dict[int, str], strip: float = 20.0) -> DataFrame:
    """Boxes (det_id) with ``standing``: what most of the label pixels in the strip under the box are: grounded, cut, behind, or other.

    ``kinds`` names classes; without any of them under the box it is other. Ties go to the first name. Runs meet boxes by bands of rows.
    """
    b = boxes.withColumn("_k", F.explode(F.sequence(F.floor(F.col("y1") / strip), F.floor((F.col("y1") + strip) / strip))))
    r = runs.select(*FRAME, "y", "x_start", "x_end", "class_id", F.floor(F.col("y") / strip).alias("_k"))
    j = b.join(r, [*FRAME, "_k"]).where((F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y1") + strip))
    length = F.greatest(F.least(F.col("x_end").cast("double"), F.col("x1")) - F.greatest(F.col("x_start").cast("double"), F.col("x0")), F.lit(0.0))
    kind = F.coalesce(*[F.when(F.col("class_id") == c, n) for c, n in kinds.items()])
    n = j.withColumns({"_l": length, "_n": kind}).where("_l > 0 AND _n IS NOT NULL").groupBy("camera_id", "det_id", "_n").agg(F.sum("_l").alias("_l"))
    top = n.groupBy("camera_id", "det_id").agg(F.min_by("_n", F.struct((-F.col("_l")).alias("l"), "_n")).alias("standing"))
    return boxes.join(top, ["camera_id", "det_id"], "left").fillna({"standing": "other"})


def lone_person_scores(boxes: DataFrame, good: float = 0.35) -> DataFrame:
    """Per camera over frames with one person box: frames, p10, p50 and p90 of its score, and the share of ``good`` ones."""
    lone = boxes.groupBy(*FRAME).agg(F.count("*").alias("n"), F.max("score").alias("score")).where("n = 1")
    q = lambda p: F.percentile("score", p)
    return lone.groupBy("camera_id").agg(F.count("*").alias("frames"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.avg(F.when(F.col("score") >= good, 1.0).otherwise(0.0)).alias("good"))


def prepared_attributes(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """Rows (image_name, split, attributes as 0, 1 or 2) with uncertain values (2) as 0, their number in ``uncertain``, and the
    ``person`` that the file name proves (up to its tarid part; null without one)."""
    person = F.regexp_extract("image_name", r"^(.+?-tarid\d+)-", 1)
    uncertain = sum(((F.col(a) == 2).cast("int") for a in attributes), F.lit(0))
    return rows.withColumn("uncertain", uncertain).withColumns({a: (F.col(a) == 1).cast("int") for a in attributes}).withColumn("person", F.when(person != "", person))


def attribute_rates(rows: DataFrame, merged: dict[str, list[str]], low: float = 0.01) -> DataFrame:
    """(attribute, positives, rate, low_support) of each target attribute: the largest of its sources, of which "~x" is 1 - x; without
    sources it is 0 throughout."""
    value = lambda s: 1 - F.col(s[1:]) if s.startswith("~") else F.col(s)
    target = {t: F.greatest(*map(value, s), F.lit(0)) if s else F.lit(0) for t, s in merged.items()}
    named = F.explode(F.array(*[F.struct(F.lit(t).alias("attribute"), c.alias("v")) for t, c in target.items()])).alias("x")
    r = rows.select(named).groupBy("x.attribute").agg(F.sum("x.v").alias("positives"), F.avg("x.v").alias("rate"))
    return r.withColumn("low_support", (F.col("rate") > 0) & (F.col("rate") < low))


def persons_across_splits(rows: DataFrame) -> DataFrame:
    """(person, splits, images) of persons with images in several splits."""
    return rows.where("person IS NOT NULL").groupBy("person").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("images")).where("splits > 1")


def nearest_fixture(cells: DataFrame, contacts: DataFrame, reach: float = 0.9) -> DataFrame:
    """Floor cells (camera_id, x_m, z_m) with the nearest fixture whose contact points (fixture, x_m, z_m) lie within ``reach``
    metres and the distance; ties: the smallest fixture. Points meet cells by squares of that size; other cells are left out."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    square = lambda c: F.floor(F.col(c) / reach)
    p = contacts.select("camera_id", "fixture", F.col("x_m").alias("px"), F.col("z_m").alias("pz")).withColumn("a", around)
    p = p.select("camera_id", "fixture", "px", "pz", (square("px") + F.col("a.i")).alias("_x"), (square("pz") + F.col("a.j")).alias("_z"))
    d = F.sqrt((F.col("x_m") - F.col("px")) ** 2 + (F.col("z_m") - F.col("pz")) ** 2)
    j = cells.withColumns({"_x": square("x_m"), "_z": square("z_m")}).join(p, ["camera_id", "_x", "_z"]).withColumn("_d", d).where(F.col("_d") <= reach)
    return j.groupBy("camera_id", "x_m", "z_m").agg(F.min(F.struct("_d", "fixture")).alias("m")).select("camera_id", "x_m", "z_m", "m.fixture", F.col("m._d").alias("distance"))


def stale_supplements(supplements: DataFrame, held_out: DataFrame, manifest: DataFrame) -> DataFrame:
    """(supplement, reason, detail): supplements that hold a held-out camera, and those whose digest of the split isn't the
    manifest's present one. ``supplements``: supplement, camera, digest; ``manifest``: camera, split."""
    held = supplements.join(held_out.select("camera").distinct(), "camera", "left_semi").groupBy("supplement").agg(F.array_join(F.sort_array(F.collect_set(F.col("camera").cast("string"))), ",").alias("detail"))
    present = split_digest(manifest).first()[0]
    old = supplements.select("supplement", "digest").distinct().where(F.col("digest") != F.lit(present))
    return held.select("supplement", F.lit("held-out camera").alias("reason"), "detail").unionByName(old.select("supplement", F.lit("another split").alias("reason"), F.col("digest").alias("detail")))


def split_digest(manifest: DataFrame) -> DataFrame:
    """One row ``present``: a digest of all (camera, split); cameras are a few rows a shop."""
    row = F.concat_ws("=", F.col("camera").cast("string"), "split")
    return manifest.select(row.alias("r")).distinct().agg(F.sha2(F.array_join(F.sort_array(F.collect_list("r")), ";"), 256).alias("present"))


def spell_separation(spells: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, hits, false_alarms, balanced): the shares of clips of the wanted action (``wanted``) and of others whose longest
    spell reaches each threshold, and the mean of hits and of right silences."""
    s = spells.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    share = lambda c: F.avg(F.when(c, (F.col("spell") >= F.col("threshold")).cast("double")))
    r = s.groupBy("threshold").agg(share(F.col("wanted")).alias("hits"), share(~F.col("wanted")).alias("false_alarms"))
    return r.withColumn("balanced", (F.col("hits") + 1 - F.col("false_alarms")) / 2)
