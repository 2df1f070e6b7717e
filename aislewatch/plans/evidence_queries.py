"""Joins and tallies behind reviews of detections and tracks, over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewatch.functions import boxes as B
from aislewatch.functions import labels as L
from aislewatch.operators import evidence as E
from aislewatch.operators import poses as P
from aislewatch.operators import regions as G
from aislewatch.operators.runs import observed_runs
from aislewatch.plans import views as V
from aislewatch.plans.pose_queries import poses

C = V.Catalogue()
_r = lambda df, *cols, n=6: df.withColumns({c: F.round(c, n) for c in cols})

#: The IoU of boxes a and b of two table aliases, and the area that they share.
_BOTH = "greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0e0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0e0)"
_AREA = "(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def _iou(a: str, b: str) -> str:
    both = _BOTH.format(a=a, b=b)
    return f"({both} / ({_AREA.format(a=a)} + {_AREA.format(a=b)} - {both}))"


@C.add("agg_high_band_only", """, s AS (SELECT camera_id, frame_index, x0, y0, x1, y1, max(score) AS s FROM detections GROUP BY ALL)
SELECT o.camera_id, o.track_id, count(*) FILTER (coalesce(s.s >= 35e-2, true)) AS kept, count(*) FILTER (NOT coalesce(s.s >= 35e-2, true)) AS dropped
FROM observations o LEFT JOIN s ON o.camera_id = s.camera_id AND o.frame_index = s.frame_index AND o.x0 = s.x0 AND o.y0 = s.y0 AND o.x1 = s.x1 AND o.y1 = s.y1 GROUP BY 1, 2""", ("observations", "detections"))
def agg_high_band_only(spark, d):
    o = E.high_band_only(V.observations(spark, d), V.detections(spark, d), 0.35)
    return o.groupBy("camera_id", "track_id").agg(F.count(F.when(F.col("band"), 1)).alias("kept"), F.count(F.when(~F.col("band"), 1)).alias("dropped"))


@C.add("j_label_of_track", """SELECT camera_id, track_id, frame_index, label FROM (SELECT o.camera_id, o.track_id, o.frame_index, d.class_name AS label,
row_number() OVER (PARTITION BY o.camera_id, o.track_id, o.frame_index ORDER BY abs(o.x0 - d.x0) + abs(o.y0 - d.y0) + abs(o.x1 - d.x1) + abs(o.y1 - d.y1), d.det_id) AS r
FROM observations o JOIN detections d ON o.camera_id = d.camera_id AND o.frame_index = d.frame_index) WHERE r = 1""", ("observations", "detections"))
def j_label_of_track(spark, d):
    return E.nearest_labels(V.observations(spark, d), V.detections(spark, d))


@C.add("j_index_of", f"""SELECT camera_id, track_id, frame_index, det_id FROM (SELECT o.camera_id, o.track_id, o.frame_index, d.det_id, {_iou('o', 'd')} AS i,
row_number() OVER (PARTITION BY o.camera_id, o.track_id, o.frame_index ORDER BY {_iou('o', 'd')} DESC, d.det_id) AS r
FROM observations o JOIN detections d ON o.camera_id = d.camera_id AND o.frame_index = d.frame_index) WHERE r = 1 AND i >= 99e-2""", ("observations", "detections"))
def j_index_of(spark, d):
    return E.detection_of(V.observations(spark, d), V.detections(spark, d))


@C.add("j_witness", f""", e AS (SELECT camera_id, track_id, arg_max(struct_pack(f := frame_index, x0 := x0, y0 := y0, x1 := x1, y1 := y1), frame_index) AS b FROM observations WHERE frame_index < 150 GROUP BY 1, 2),
w AS (SELECT camera_id, track_id, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, unnest(range(b.f + 1, b.f + 6)) AS frame_index FROM e),
j AS (SELECT w.camera_id, w.track_id, d.score, {_iou('w', 'd')} AS i FROM w JOIN detections d ON w.camera_id = d.camera_id AND w.frame_index = d.frame_index),
s AS (SELECT camera_id, track_id, coalesce(max(score) FILTER (i >= 3e-1), 0) AS best_assoc, coalesce(max(score) FILTER (i >= 1e-1), 0) AS best_score FROM j GROUP BY 1, 2),
t AS (SELECT DISTINCT w.camera_id, w.track_id FROM w JOIN pred_boxes p ON w.camera_id = p.camera_id AND w.frame_index = p.frame_index AND {_iou('w', 'p')} >= 1e-1),
v AS (SELECT e.camera_id, e.track_id, coalesce(best_assoc, 0) AS best_assoc, coalesce(best_score, 0) AS best_score, t.track_id IS NOT NULL AS dense FROM e LEFT JOIN s ON e.camera_id = s.camera_id AND e.track_id = s.track_id LEFT JOIN t ON e.camera_id = t.camera_id AND e.track_id = t.track_id)
SELECT *, CASE WHEN best_assoc >= 35e-2 THEN 'available' WHEN best_score >= 15e-2 THEN 'demoted' WHEN dense THEN 'boxless' ELSE 'vacated' END AS verdict FROM v""", ("observations", "detections", "pred_boxes"))
def j_witness(spark, d):
    o = V.observations(spark, d).where("frame_index < 150")  # tracks as they stand at frame 150; what comes after bears witness
    last = o.groupBy("camera_id", "track_id").agg(F.max_by(F.struct("frame_index", "x0", "y0", "x1", "y1"), "frame_index").alias("b")).select("camera_id", "track_id", "b.*")
    return E.witness(last, V.detections(spark, d), V.pred_boxes(spark, d))


_COEXIST = ", c AS (SELECT DISTINCT a.camera_id, a.track_id AS a, b.track_id AS b FROM observations a JOIN observations b ON a.camera_id = b.camera_id AND a.frame_index = b.frame_index AND a.track_id < b.track_id)"


@C.add("j_references", _COEXIST + """, z AS (SELECT camera_id, track_id, frame_index, (score - avg(score) OVER c) / (stddev_pop(score) OVER c + 1e-6) AS s, (x_m - avg(x_m) OVER c) / (stddev_pop(x_m) OVER c + 1e-6) AS x FROM observations WINDOW c AS (PARTITION BY camera_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) AS k, count(*) OVER (PARTITION BY camera_id, track_id) AS n FROM z),
w AS (SELECT camera_id, track_id, avg(s) FILTER (k <= n // 2) - avg(s) FILTER (k > n // 2) AS ds, avg(x) FILTER (k <= n // 2) - avg(x) FILTER (k > n // 2) AS dx FROM h WHERE n >= 6 GROUP BY 1, 2),
m AS (SELECT camera_id, track_id, avg(s) AS s, avg(x) AS x FROM z GROUP BY 1, 2)
SELECT camera_id, 'within' AS kind, track_id AS a, track_id AS b, round(sqrt(ds * ds + dx * dx), 5) AS distance FROM w
UNION ALL SELECT c.camera_id, 'between', c.a, c.b, round(sqrt((u.s - v.s) ** 2 + (u.x - v.x) ** 2), 5) FROM c JOIN m u ON u.camera_id = c.camera_id AND u.track_id = c.a JOIN m v ON v.camera_id = c.camera_id AND v.track_id = c.b""", ("observations",))
def j_references(spark, d):
    return _r(E.reference_distances(V.observations(spark, d), ["score", "x_m"]), "distance", n=5)


@C.add("j_coexist_cosine", _COEXIST + """, f AS (SELECT vec_id AS track_id, feat FROM reid)
SELECT c.camera_id, c.a, c.b, round(list_dot_product(u.feat, v.feat) / sqrt(list_dot_product(u.feat, u.feat)) / sqrt(list_dot_product(v.feat, v.feat)), 5) AS cosine FROM c JOIN f u ON u.track_id = c.a JOIN f v ON v.track_id = c.b""", ("observations", "reid"))
def j_coexist_cosine(spark, d):
    return _r(E.coexisting_cosines(V.observations(spark, d), V.reid(spark, d).select(F.col("vec_id").alias("track_id"), "feat")), "cosine", n=5)


@C.add("agg_box_survival")
def agg_box_survival(spark, d):
    V.shared_dir(spark)
    return _r(E.survival_report(E.box_survival(V.detections(spark, d), 0.3)), "mean", "one_frame", "five_or_more")


def _regions(spark, d):
    """Dense regions: the boxes of the tracks, moved and made smaller by the track's number."""
    o, k = V.observations(spark, d), F.col("track_id") % 7
    return o.select("camera_id", "frame_index", F.col("track_id").alias("region_id"), (F.col("x0") + k).alias("x0"), (F.col("y0") + k * 5).alias("y0"), F.col("x1").alias("x1"), (F.col("y1") - k * 4).alias("y1"))


_REGIONS = ", r AS (SELECT camera_id, frame_index, track_id AS region_id, x0 + track_id % 7 AS x0, y0 + track_id % 7 * 5 AS y0, x1, y1 - track_id % 7 * 4 AS y1 FROM observations), b AS (SELECT * FROM detections WHERE score >= 5e-1)"


@C.add("j_dense_vs_box", _REGIONS + f""", j AS (SELECT r.camera_id, r.frame_index, region_id, det_id, {_iou('r', 'b')} AS i, {_BOTH.format(a='r', b='b')} / {_AREA.format(a='r')} AS c FROM r JOIN b ON r.camera_id = b.camera_id AND r.frame_index = b.frame_index),
m AS (SELECT r.camera_id, coalesce(max(i), 0) AS i, coalesce(max(c), 0) AS c FROM r LEFT JOIN j USING (camera_id, frame_index, region_id) GROUP BY r.camera_id, r.frame_index, region_id),
v AS (SELECT camera_id, count(*) AS regions, count(*) FILTER (i < 3e-1 AND c >= 5e-1) AS fragments, count(*) FILTER (i < 3e-1 AND c < 5e-1) AS uncovered FROM m GROUP BY 1),
k AS (SELECT camera_id, count(DISTINCT det_id) FILTER (c >= 25e-2) AS confirmed FROM j GROUP BY 1)
SELECT v.camera_id, regions, fragments, uncovered, coalesce(confirmed, 0) AS confirmed FROM v LEFT JOIN k ON v.camera_id = k.camera_id""", ("observations", "detections"))
def j_dense_vs_box(spark, d):
    regions, boxes = E.dense_against_boxes(_regions(spark, d), V.detections(spark, d).where("score >= 0.5"))
    n = lambda c: F.count(F.when(c, 1))
    r = regions.groupBy("camera_id").agg(F.count("*").alias("regions"), n(F.col("verdict") == "fragment").alias("fragments"), n(F.col("verdict") == "uncovered").alias("uncovered"))
    b = boxes.groupBy("camera_id").agg(n(F.col("confirmed")).alias("confirmed"))
    return r.join(b, "camera_id", "left").fillna({"confirmed": 0})


# plates of a hundredth of the picture's size, 10 x 8 pixels; the slot is the frame's part of the day, and slot 3 has no plate
_NIGHT = """, pr AS (SELECT user_id % 8 AS camera_id, CAST((extract(day FROM ts) - 1) * 6 + floor(extract(hour FROM ts) / 4) AS BIGINT) AS frame_index, event_id % 8 AS y, event_id // 8 % 6 AS x_start, event_id // 8 % 6 + 4 AS x_end FROM events),
pf AS (SELECT camera_id, frame_index % 6 AS slot, count(DISTINCT frame_index) AS n FROM pr WHERE frame_index % 6 <> 3 GROUP BY 1, 2),
px AS (SELECT camera_id, frame_index % 6 AS slot, y, x, count(DISTINCT frame_index) AS n FROM (SELECT camera_id, frame_index, y, unnest(range(x_start, x_end)) AS x FROM pr) GROUP BY 1, 2, 3, 4),
pl AS (SELECT px.camera_id, px.slot, y, x FROM px JOIN pf ON px.camera_id = pf.camera_id AND px.slot = pf.slot WHERE px.n >= 45e-2 * pf.n),
nb AS (SELECT camera_id, frame_index, det_id, score, frame_index % 6 AS slot, CAST(greatest(floor(x0 / 1e2), 0) AS BIGINT) AS l, CAST(greatest(floor(y0 / 1e2), 0) AS BIGINT) AS t, CAST(ceil(x1 / 1e2) AS BIGINT) AS r, CAST(ceil(y1 / 1e2) AS BIGINT) AS b FROM detections WHERE class_name = 'person'),
nc AS (SELECT nb.* REPLACE (least(greatest(r, l + 1), 10) AS r, least(greatest(b, t + 1), 8) AS b), pf.n IS NOT NULL AS has FROM nb LEFT JOIN pf ON nb.camera_id = pf.camera_id AND nb.slot = pf.slot),
ns AS (SELECT det_id, count(*) AS s FROM nc JOIN pl ON nc.has AND nc.camera_id = pl.camera_id AND nc.slot = pl.slot AND x >= l AND x < r AND y >= t AND y < b GROUP BY 1),
n AS (SELECT camera_id, frame_index, nc.det_id, score, CASE WHEN has THEN CASE WHEN (r - l) * (b - t) > 0 THEN coalesce(s, 0) / ((r - l) * (b - t)) ELSE 0 END END AS share, CASE WHEN has THEN (r - l) * (b - t) END AS plate_pixels, camera_id = 7 AS excluded FROM nc LEFT JOIN ns ON nc.det_id = ns.det_id),
v AS (SELECT *, CASE WHEN excluded THEN 'camera excluded' WHEN score < 35e-2 THEN 'below score threshold' WHEN plate_pixels IS NULL THEN 'no static plate' WHEN plate_pixels < 2 THEN 'kept: plate too coarse' WHEN share >= 5e-1 THEN 'static: furniture' ELSE 'kept' END AS reason FROM n)
"""


def _night(spark, d):
    e, i = V.table(spark, d, "events"), F.col("event_id")
    frame = ((F.dayofmonth("ts") - 1) * 6 + F.floor(F.hour("ts") / 4)).cast("long")
    runs = e.select((F.col("user_id") % 8).alias("camera_id"), frame.alias("frame_index"), (i % 8).alias("y"), (F.floor(i / 8) % 6).alias("x_start"), (F.floor(i / 8) % 6 + 4).alias("x_end")).withColumn("slot", F.col("frame_index") % 6).where("slot <> 3")
    b = V.detections(spark, d).where("class_name = 'person'").withColumn("slot", F.col("frame_index") % 6).withColumn("excluded", F.col("camera_id") == 7)
    shares = G.plate_shares(b, G.static_plate(runs, 0.45), runs, scale=0.01, width=10, height=8)
    return E.night_veto(shares, least_pixels=2)


@C.add("night_veto", _NIGHT + "SELECT camera_id, det_id, round(share, 6) AS share, plate_pixels, reason, reason LIKE 'kept%' AS keep FROM v", ("detections",))
def night_veto(spark, d):
    return _night(spark, d).select("camera_id", "det_id", F.round("share", 6).alias("share"), "plate_pixels", "reason", "keep")


@C.add("agg_night_ghosts", _NIGHT + """SELECT camera_id, count(*) FILTER (reason NOT IN ('camera excluded', 'below score threshold')) AS before, count(*) FILTER (reason LIKE 'kept%') AS after,
count(DISTINCT frame_index) FILTER (reason NOT IN ('camera excluded', 'below score threshold')) AS frames_before, count(DISTINCT frame_index) FILTER (reason LIKE 'kept%') AS frames_after FROM v GROUP BY 1""", ("detections",))
def agg_night_ghosts(spark, d):
    return E.night_ghosts(_night(spark, d))


@C.add("agg_score_density", """, f AS (SELECT camera_id, frame_index, sum(CAST((x1 - x0) * (y1 - y0) AS BIGINT) + det_id % 50) AS person_px, max(score) AS top, count(*) FILTER (score >= 35e-2) AS n_high, count(*) FILTER (score >= 15e-2) AS n_low FROM detections WHERE class_name = 'person' GROUP BY 1, 2),
e AS (SELECT quantile_cont(CAST(person_px AS DOUBLE), [0, 15e-2, 3e-1, 45e-2, 6e-1, 75e-2, 9e-1, 1]) AS e FROM f), b AS (SELECT k - 1 AS band, round(e[k], 6) AS lo, round(e[k + 1], 6) AS hi FROM e, (SELECT unnest(range(1, 8)) AS k))
SELECT CAST(band AS INTEGER) AS band, round(lo, 4) AS lo, round(hi, 4) AS hi, count(*) AS frames, round(median(top), 6) AS top, median(n_high) AS n_high, median(n_low) AS n_low FROM f JOIN b ON person_px BETWEEN lo AND hi GROUP BY band, lo, hi""", ("detections",))
def agg_score_density(spark, d):
    p = V.detections(spark, d).where("class_name = 'person'")
    px = F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("bigint") + F.col("det_id") % 50
    n = lambda t: F.count(F.when(F.col("score") >= t, 1))
    f = p.groupBy("camera_id", "frame_index").agg(F.sum(px).alias("person_px"), F.max("score").alias("top"), n(0.35).alias("n_high"), n(0.15).alias("n_low"))
    return _r(_r(E.score_density(f), "lo", "hi", n=4), "top")


@C.add("agg_score_factors", """, r AS (SELECT user_id % 8 AS camera_id, CAST((extract(day FROM ts) - 1) * 6 + floor(extract(hour FROM ts) / 4) AS BIGINT) AS frame_index, (event_id * 13) % 700 AS y, (event_id * 7) % 800 AS a, (event_id * 7) % 800 + 200 AS b, event_id % 3 AS c FROM events),
j AS (SELECT d.camera_id, det_id, c, sum(greatest(least(CAST(b AS DOUBLE), x1) - greatest(CAST(a AS DOUBLE), x0), 0e0)) AS l FROM detections d JOIN r ON d.camera_id = r.camera_id AND d.frame_index = r.frame_index AND y >= y1 AND y < y1 + 20 GROUP BY 1, 2, 3),
k AS (SELECT camera_id, det_id, ['grounded', 'cut', 'behind'][c + 1] AS kind, row_number() OVER (PARTITION BY camera_id, det_id ORDER BY l DESC, ['grounded', 'cut', 'behind'][c + 1]) AS n FROM j WHERE l > 0)
SELECT coalesce(kind, 'other') AS standing, count(*) AS boxes, round(quantile_cont(score, 1e-1), 6) AS p10, round(quantile_cont(score, 5e-1), 6) AS p50, round(quantile_cont(score, 9e-1), 6) AS p90
FROM detections d LEFT JOIN k ON d.camera_id = k.camera_id AND d.det_id = k.det_id AND n = 1 WHERE class_name = 'person' GROUP BY 1""", ("detections",))
def agg_score_factors(spark, d):
    from aislewatch.plans.pose_queries import _runs

    s = E.standing(V.detections(spark, d).where("class_name = 'person'"), _runs(spark, d), {0: "grounded", 1: "cut", 2: "behind"})
    q = lambda p: F.percentile("score", p)
    return _r(s.groupBy("standing").agg(F.count("*").alias("boxes"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90")), "p10", "p50", "p90")


@C.add("agg_lone_person_scores", ", l AS (SELECT camera_id, frame_index, max(score) AS score FROM detections WHERE class_name = 'boxed_stock' GROUP BY 1, 2 HAVING count(*) = 1) SELECT camera_id, count(*) AS frames, round(quantile_cont(score, 1e-1), 6) AS p10, round(quantile_cont(score, 5e-1), 6) AS p50, round(quantile_cont(score, 9e-1), 6) AS p90, round(avg(CASE WHEN score >= 35e-2 THEN 1e0 ELSE 0e0 END), 6) AS good FROM l GROUP BY 1", ("detections",))
def agg_lone_person_scores(spark, d):
    # the views crowd every frame with persons; the rarer class stands for them
    return _r(E.lone_person_scores(V.detections(spark, d).where("class_name = 'boxed_stock'")), "p10", "p50", "p90", "good")


_ATTR = """WITH a AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'x.png' ELSE 'cam' || p_partkey % 4 || '-tarid' || p_partkey % 500 || '-f' || p_partkey || '.png' END AS image_name, CASE WHEN p_partkey // 7 % 10 < 7 THEN 'train' WHEN p_partkey // 7 % 10 < 9 THEN 'val' ELSE 'test' END AS split,
  p_size % 3 AS hat, (p_partkey * 7) % 3 AS bag, p_partkey % 200 // 199 AS rare FROM part),
p AS (SELECT image_name, split, CASE WHEN hat = 1 THEN 1 ELSE 0 END AS hat, CASE WHEN bag = 1 THEN 1 ELSE 0 END AS bag, CASE WHEN rare = 1 THEN 1 ELSE 0 END AS rare, CASE WHEN hat = 2 THEN 1 ELSE 0 END + CASE WHEN bag = 2 THEN 1 ELSE 0 END + CASE WHEN rare = 2 THEN 1 ELSE 0 END AS uncertain, nullif(regexp_extract(image_name, '^(.+?-tarid[0-9]+)-', 1), '') AS person FROM a)
"""


def _attributes(spark, d):
    k, mod = F.col("p_partkey"), lambda n: (F.col("p_partkey") % n)
    name = F.when(mod(11) == 0, "x.png").otherwise(F.concat(F.lit("cam"), mod(4).cast("string"), F.lit("-tarid"), mod(500).cast("string"), F.lit("-f"), k.cast("string"), F.lit(".png")))
    tenth = F.floor(k / 7) % 10
    split = F.when(tenth < 7, "train").when(tenth < 9, "val").otherwise("test")
    rows = V.table(spark, d, "part").select(name.alias("image_name"), split.alias("split"), (F.col("p_size") % 3).alias("hat"), (k * 7 % 3).alias("bag"), F.floor(mod(200) / 199).alias("rare"))
    return E.prepared_attributes(rows, ["hat", "bag", "rare"])


@C.add("attr_prep", _ATTR + "SELECT image_name, split, hat, bag, rare, uncertain, person FROM p")
def attr_prep(spark, d):
    return _attributes(spark, d)


@C.add("agg_attr_rates", _ATTR + """, t AS (SELECT unnest([struct_pack(n := 'covered', v := greatest(hat, bag)), struct_pack(n := 'bareheaded', v := 1 - hat), struct_pack(n := 'rare', v := rare), struct_pack(n := 'absent', v := 0)]) AS x FROM p)
SELECT x.n AS attribute, CAST(sum(x.v) AS BIGINT) AS positives, round(avg(x.v), 6) AS rate, avg(x.v) > 0 AND avg(x.v) < 1e-2 AS low_support FROM t GROUP BY 1""")
def agg_attr_rates(spark, d):
    return _r(E.attribute_rates(_attributes(spark, d), {"covered": ["hat", "bag"], "bareheaded": ["~hat"], "rare": ["rare"], "absent": []}), "rate")


@C.add("agg_attr_person_leak", _ATTR + "SELECT person, count(DISTINCT split) AS splits, count(*) AS images FROM p WHERE person IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def agg_attr_person_leak(spark, d):
    return E.persons_across_splits(_attributes(spark, d))


@C.add("j_supplement_stale", """, h AS (SELECT DISTINCT camera FROM clip_rows WHERE split = 'test'), s AS (SELECT DISTINCT c_nationkey % 5 AS supplement, c_nationkey AS camera, 'digest ' || c_nationkey % 5 AS digest FROM customer)
SELECT supplement, 'held-out camera' AS reason, string_agg(CAST(s.camera AS VARCHAR), ',' ORDER BY CAST(s.camera AS VARCHAR)) AS detail FROM s JOIN h ON s.camera = h.camera GROUP BY 1
UNION ALL SELECT DISTINCT supplement, 'another split', digest FROM s""", ("clip_rows",))
def j_supplement_stale(spark, d):
    n = F.col("c_nationkey")
    s = V.table(spark, d, "customer").select((n % 5).alias("supplement"), n.alias("camera"), F.concat(F.lit("digest "), (n % 5).cast("string")).alias("digest")).distinct()
    clips = V.clip_rows(spark, d)
    return E.stale_supplements(s, clips.where("split = 'test'"), clips)


@C.add("win_nearest_fixture", """, c AS (SELECT DISTINCT camera_id, x_m, z_m FROM observations), f AS (SELECT DISTINCT camera_id, track_id % 16 AS fixture, x_m + 25e-2 AS px, z_m + 15e-2 AS pz FROM observations WHERE class_name <> 'person'),
j AS (SELECT c.camera_id, x_m, z_m, fixture, sqrt((x_m - px) ** 2 + (z_m - pz) ** 2) AS d FROM c JOIN f ON c.camera_id = f.camera_id AND abs(x_m - px) <= 1 AND abs(z_m - pz) <= 1)
SELECT camera_id, x_m, z_m, fixture, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, x_m, z_m ORDER BY d, fixture) AS r FROM j WHERE d <= 9e-1) WHERE r = 1""", ("observations",))
def win_nearest_fixture(spark, d):
    o = V.observations(spark, d)
    f = o.where("class_name <> 'person'").select("camera_id", (F.col("track_id") % 16).alias("fixture"), (F.col("x_m") + 0.25).alias("x_m"), (F.col("z_m") + 0.15).alias("z_m")).distinct()
    return _r(E.nearest_fixture(o.select("camera_id", "x_m", "z_m").distinct(), f), "distance")


_KEYS = ", p AS (SELECT *, (x0 + x1) / 2 AS cx, ((track_id * 3 + CAST(floor(frame_index / 8) AS BIGINT) * 7) % 9) * 1e1 AS dx, least(score + 3e-1, 1e0) AS conf, sqrt((((track_id * 3 + CAST(floor(frame_index / 8) AS BIGINT) * 7) % 9) * 1e1) ** 2 + 9e2) AS torso FROM observations)"


@C.add("torso_region", _KEYS + " SELECT camera_id, track_id, frame_index, round(cx, 6) AS x0, y0 + 30 AS y0, round(cx + dx, 6) AS x1, y0 + 60 AS y1 FROM (SELECT camera_id, track_id, frame_index, cx + 15e-2 * dx AS cx, 7e-1 * dx AS dx, y0 FROM p WHERE dx > 0)", ("observations",))
def torso_region(spark, d):
    t = poses(spark, d).select("camera_id", "track_id", "frame_index", L.torso_region(F.col("keypoints")).alias("t")).where("t IS NOT NULL")
    return _r(t.select("camera_id", "track_id", "frame_index", "t.*"), "x0", "x1")


_LIMB = "CASE WHEN {n} > 1e-6 THEN {dx} / {n} ELSE 0 END, CASE WHEN {n} > 1e-6 THEN {dy} / {n} ELSE 0 END, {n} / torso"
_F53 = ", q AS (SELECT camera_id, track_id, frame_index, list_transform(list_concat([" + ", ".join([
    "0e0, 0e0, 0e0", "0e0, 0e0, 0e0", "0e0, 0e0, 0e0", "0e0, 0e0, 0e0", "0e0, 0e0, 0e0", "0e0, 0e0, 0e0", "0e0, 0e0, 0e0", "0e0, 0e0, 0e0",
    "0e0, 0e0, 0e0", "0e0, 0e0, 0e0", _LIMB.format(n="torso", dx="-dx", dy="3e1"), _LIMB.format(n="torso", dx="-dx", dy="3e1")]) + "], list_transform(range(17), lambda i: CASE WHEN i IN (5, 6, 9, 10, 11, 12, 15, 16) THEN conf ELSE 0e0 END)), lambda v: round(v, 5)) AS f FROM p)"


def _bare(spark, d):
    """The derived poses with the joints that they don't place (ends of the other limbs) unmeasured, as a pose model would leave them."""
    p = poses(spark, d)
    placed = (5, 6, 9, 10, 11, 12, 15, 16)
    return p.withColumn("keypoints", F.array(*[F.struct(F.col("keypoints")[k]["x"].alias("x"), F.col("keypoints")[k]["y"].alias("y"), (F.col("keypoints")[k]["conf"] if k in placed else F.lit(0.0)).alias("conf")) for k in range(17)]))


@C.add("frame_features", _KEYS + _F53 + "  SELECT camera_id, track_id, frame_index, array_to_string(list_transform(f, lambda v: CAST(round(v * 1e4) AS BIGINT)), ' ') AS f FROM q", ("observations",))
def frame_features(spark, d):
    return _bare(spark, d).select("camera_id", "track_id", "frame_index", F.array_join(F.transform(L.frame_features(F.col("keypoints")), lambda v: F.round(F.round(v, 5) * 1e4).cast("bigint").cast("string")), " ").alias("f"))


@C.add("sequence_features", _KEYS + _F53 + ", s AS (SELECT *, lag(f) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) AS g FROM q) SELECT camera_id, track_id, frame_index, 106 AS n, round(list_sum(list_transform(range(1, 54), lambda i: abs(f[i] - coalesce(g[i], f[i])))), 4) AS moved FROM s", ("observations",))
def sequence_features(spark, d):
    f = _bare(spark, d).select("camera_id", "track_id", "frame_index", F.transform(L.frame_features(F.col("keypoints")), lambda v: F.round(v, 5)).alias("features"))
    s = L.sequence_features(f, "features", "camera_id", "track_id")
    return s.select("camera_id", "track_id", "frame_index", F.size("features").alias("n"), F.round(F.aggregate(F.slice("features", 54, 53), F.lit(0.0), lambda a, v: a + F.abs(v)), 4).alias("moved"))


@C.add("sc_angle3d", "SELECT camera_id, track_id, frame_index, round(degrees(acos(greatest(least(y / sqrt(x * x + y * y + z * z), 1), -1))), 4) AS angle FROM (SELECT camera_id, track_id, frame_index, x_m AS x, z_m AS y, score + 1 AS z FROM observations)", ("observations",))
def sc_angle3d(spark, d):
    return _r(V.observations(spark, d).select("camera_id", "track_id", "frame_index", L.angle_to(F.col("x_m"), F.col("z_m"), F.col("score") + 1, (0.0, 1.0, 0.0)).alias("angle")), "angle", n=4)


@C.add("class_mask", ", l AS (SELECT camera_id, list(DISTINCT class_name) AS c FROM detections WHERE det_id % 3 = camera_id % 3 GROUP BY 1) SELECT camera_id, array_to_string(list_transform(['bag', 'person', 'cart', 'boxed_stock'], lambda v: CASE WHEN list_contains(c, v) THEN 'y' ELSE 'n' END), '') AS mask FROM l", ("detections",))
def class_mask(spark, d):
    c = V.detections(spark, d).where("det_id % 3 = camera_id % 3").groupBy("camera_id").agg(F.collect_set("class_name").alias("c"))
    return c.select("camera_id", F.array_join(F.transform(L.class_mask(["bag", "person", "cart", "boxed_stock"], F.col("c")), lambda m: F.when(m, "y").otherwise("n")), "").alias("mask"))


def _names(spark, d):
    return V.table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id"))


_NAMES = "WITH n AS (SELECT p_type AS name, min(p_partkey) AS id FROM part GROUP BY 1), g AS (SELECT name, CASE WHEN id % 3 = 0 THEN 'product' ELSE 'belonging' END AS grp FROM n WHERE id % 3 < 2)"


@C.add("retail_group", _NAMES + " SELECT p_partkey, grp AS retail_group, CASE WHEN grp IS NOT NULL AND grp <> n.name THEN grp || '/' || n.name ELSE n.name END AS label FROM part JOIN n ON p_type = n.name LEFT JOIN g ON g.name = n.name")
def retail_group(spark, d):
    n = _names(spark, d)
    g = n.where("id % 3 < 2").select("name", F.when(F.col("id") % 3 == 0, "product").otherwise("belonging").alias("group"))
    rows = V.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("name"))
    return L.retail_groups(rows, g).select("p_partkey", F.col("group").alias("retail_group"), "label")


@C.add("head_order", _NAMES + " SELECT name, row_number() OVER (ORDER BY id) - 1 AS channel FROM n WHERE id % 2 = 0")
def head_order(spark, d):
    n = _names(spark, d)
    return L.head_order(n.where("id % 2 = 0").select("name").unionByName(n.where("id % 4 = 0").select("name")), n)


@C.add("narrow_indices", _NAMES + ", t AS (SELECT name, id, row_number() OVER (ORDER BY id) - 1 AS channel FROM n WHERE id % 2 = 0) SELECT name, channel AS trained_channel, row_number() OVER (ORDER BY id) - 1 AS channel FROM t WHERE id % 4 = 0")
def narrow_indices(spark, d):
    n = _names(spark, d)
    return L.narrow_indices(L.head_order(n.where("id % 4 = 0").select("name"), n), L.head_order(n.where("id % 2 = 0").select("name"), n))


def _spells(spark, d):
    """The longest spell near the camera of each track; the tracks of bags stand for the wanted action."""
    r = observed_runs(V.observations(spark, d), ["camera_id", "track_id", "class_name"], F.col("z_m") <= 4.0)
    n = r.groupBy("camera_id", "track_id", "class_name", "run").agg(((F.max("frame_index") - F.min("frame_index") + 1) / 5.0).alias("s"))
    return n.groupBy("camera_id", "track_id", "class_name").agg(F.max("s").alias("spell")).withColumn("wanted", F.col("class_name") == "bag")


@C.add("agg_fall_discriminator", """, r AS (SELECT *, sum(CASE WHEN z_m <= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) AS run FROM observations),
s AS (SELECT camera_id, track_id, class_name, max(s) AS spell FROM (SELECT camera_id, track_id, class_name, run, (max(frame_index) - min(frame_index) + 1) / 5e0 AS s FROM r WHERE z_m <= 4 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3), t AS (SELECT unnest([1e0, 2e0, 4e0, 8e0]) AS threshold),
v AS (SELECT threshold, avg(CASE WHEN spell >= threshold THEN 1e0 ELSE 0e0 END) FILTER (class_name = 'bag') AS h, avg(CASE WHEN spell >= threshold THEN 1e0 ELSE 0e0 END) FILTER (class_name <> 'bag') AS f FROM s, t GROUP BY 1)
SELECT threshold, round(h, 6) AS hits, round(f, 6) AS false_alarms, round((h + 1 - f) / 2, 6) AS balanced FROM v""", ("observations",))
def agg_fall_discriminator(spark, d):
    return _r(E.spell_separation(_spells(spark, d), [1.0, 2.0, 4.0, 8.0]), "hits", "false_alarms", "balanced")


def _action_rows(spark, d):
    e = V.table(spark, d, "events").groupBy(F.col("user_id").alias("clip")).agg(F.avg("value").alias("a"), F.count("*").alias("c"), F.max("value").alias("m"), F.avg(F.col("event_id") % 7).alias("o"))
    return e.select((F.col("clip") % 5).alias("performer"), ((F.col("a") - 50) / 20).alias("a"), ((F.col("c") - 60) / 20).alias("c"), ((F.col("m") - 90) / 10).alias("m"), (F.col("o") - 3).alias("o"), (F.col("a") > 50).cast("int").alias("label"))


@C.add("agg_separability")
def agg_separability(spark, d):
    return _r(P.leave_one_out(_action_rows(spark, d), ["a", "c", "m"], "performer"), "accuracy")


@C.add("agg_linear_probe")
def agg_linear_probe(spark, d):
    sets = {"all": ["a", "c", "m", "o"], "counts": ["c", "o"], "values": ["a", "m"]}
    out = None
    for name, features in sets.items():
        r = P.leave_one_out(_action_rows(spark, d), features, "performer").select(F.lit(name).alias("features"), "*")
        out = r if out is None else out.unionByName(r)
    return _r(out, "accuracy")


@C.add("j_pose_student_teacher", """, j AS (SELECT o.camera_id, k, abs(((o.track_id * 7 + o.frame_index) % 11 - 5) * (k % 3)) AS dx, abs(k % 2) * 2 AS dy, o.score + 3e-1 AS conf FROM observations o, (SELECT unnest(range(17)) AS k))
SELECT k AS joint, count(*) AS judged, round(avg(CASE WHEN sqrt(dx * dx + dy * dy) <= 8e0 THEN 1e0 ELSE 0e0 END), 6) AS pck, round(quantile_cont(sqrt(dx * dx + dy * dy), 5e-1), 6) AS p50, round(quantile_cont(sqrt(dx * dx + dy * dy), 9e-1), 6) AS p90 FROM j WHERE conf >= 5e-1 GROUP BY 1""", ("observations",))
def j_pose_student_teacher(spark, d):
    from aislewatch.operators.metrics import pose_pairs

    o = V.observations(spark, d).withColumn("person", F.concat_ws("-", "camera_id", "track_id", "frame_index"))
    s = (F.col("track_id") * 7 + F.col("frame_index")) % 11 - 5
    joints = F.explode(F.sequence(F.lit(0), F.lit(16))).alias("joint")
    teacher = o.select("person", joints, "x0", "y0", "score").select("person", "joint", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("score") + 0.3).alias("conf"))
    student = o.select("person", "x0", "y0", s.alias("s"), joints).select("person", "joint", (F.col("x0") + F.col("s") * (F.col("joint") % 3)).alias("x"), (F.col("y0") + F.col("joint") % 2 * 2).alias("y"))
    p = pose_pairs(student, teacher, least=0.5)
    q = lambda v: F.percentile("distance", v)
    return _r(p.groupBy("joint").agg(F.count("*").alias("judged"), F.avg((F.col("distance") <= 8.0).cast("double")).alias("pck"), q(0.5).alias("p50"), q(0.9).alias("p90")), "pck", "p50", "p90")


@C.add("undistort_boxes", """, u AS (SELECT camera_id, track_id, frame_index, -2e-1 AS k, 44e1 AS cx, 34e1 AS cy, 880e0 * 880 / 4 + 680e0 * 680 / 4 AS rr, x0, y0, x1, y1 FROM observations),
v AS (SELECT *, 1 + k * ((x0 - cx) ** 2 + (y0 - cy) ** 2) / rr AS s, 1 + k * ((x1 - cx) ** 2 + (y1 - cy) ** 2) / rr AS t FROM u),
w AS (SELECT camera_id, track_id, frame_index, cx + (x0 - cx) / s AS a, cy + (y0 - cy) / s AS b, cx + (x1 - cx) / t AS c, cy + (y1 - cy) / t AS d FROM v)
SELECT camera_id, track_id, frame_index, round(least(a, c), 4) AS x0, round(least(b, d), 4) AS y0, round(greatest(a, c), 4) AS x1, round(greatest(b, d), 4) AS y1 FROM w""", ("observations",))
def undistort_boxes(spark, d):
    o = V.observations(spark, d).select("camera_id", "track_id", "frame_index", B.undistort_box(B.box(), F.lit(-0.2), F.lit(880.0), F.lit(680.0)).alias("b"))
    return _r(o.select("camera_id", "track_id", "frame_index", "b.*"), "x0", "y0", "x1", "y1", n=4)
