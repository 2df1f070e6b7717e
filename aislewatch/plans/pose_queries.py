"""Posture, visits against truth, staff fits and reports over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewatch.functions import labels as L
from aislewatch.operators import metrics as M
from aislewatch.operators import poses as P
from aislewatch.operators import retail as R
from aislewatch.plans import views as V
from aislewatch.plans.retail_queries import _VISITS

C = V.Catalogue()
_r = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def poses(spark, d):
    """Observations with keypoints drawn from the box: shoulders lean with track and frame, ankles are at the lower edge."""
    o = V.observations(spark, d)
    cx, dx = (F.col("x0") + F.col("x1")) / 2, ((F.col("track_id") * 3 + F.floor(F.col("frame_index") / 8) * 7) % 9) * 10.0
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (F.col("score") + 0.3).alias("conf"))
    sh, hip, ank, wr = at(cx + dx, F.col("y0") + 30), at(cx, F.col("y0") + 60), at(cx, F.col("y1")), at(cx + 15, F.col("y0") + 55)
    zero = at(F.lit(0.0), F.lit(0.0))
    points = {5: sh, 6: sh, 9: wr, 10: wr, 11: hip, 12: hip, 15: ank, 16: ank}
    return o.withColumn("keypoints", F.array(*[points.get(k, zero) for k in range(17)]))


_POSE = ", p AS (SELECT *, ((track_id * 3 + CAST(floor(frame_index / 8) AS BIGINT) * 7) % 9) * 1e1 AS dx FROM observations), a AS (SELECT *, degrees(atan2(dx, 3e1)) AS angle, (y1 - y0 - 60) / sqrt(dx * dx + 9e2) AS ratio FROM p)"


@C.add("torso", _POSE + " SELECT camera_id, track_id, frame_index, round(angle, 6) AS angle, round(y1 - y0 - 60, 6) AS hip_ankle, round(sqrt(dx * dx + 9e2), 6) AS length FROM a", ("observations",))
def torso(spark, d):
    p = poses(spark, d).select("camera_id", "track_id", "frame_index", L.torso(F.col("keypoints")).alias("t"))
    return _r(p.select("camera_id", "track_id", "frame_index", "t.angle", "t.hip_ankle", "t.length"), "angle", "hip_ankle", "length")


_SPELL = """, r AS (SELECT *, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) AS run FROM a),
s AS (SELECT camera_id, track_id, min(frame_index) AS frame_start, max(frame_index) AS frame_end, (max(frame_index) - min(frame_index) + 1) / 5e0 AS value, max(angle) AS angle, min(ratio) AS ratio FROM r WHERE {flag} GROUP BY camera_id, track_id, run)
"""


def _bent(spark, d):
    """The poses, and with them boxes whose height falls every twelfth frame for six frames; every other track bends its knees then,
    and the head is at a height in metres that follows."""
    low = F.floor(F.col("frame_index") / 6) % 2 == 1
    ankle = lambda p: F.struct(p["x"].alias("x"), (F.col("y0") + 75).alias("y"), p["conf"].alias("conf"))
    bent = F.transform("keypoints", lambda p, i: F.when(i.isin(15, 16), ankle(p)).otherwise(p))
    p = poses(spark, d).withColumn("keypoints", F.when(low & (F.col("track_id") % 2 == 0), bent).otherwise(F.col("keypoints")))
    return p.withColumn("y0", F.when(low, F.col("y1") - 70.0).otherwise(F.col("y0"))).withColumn("head_m", F.when(F.col("track_id") % 3 == 0, F.when(low & (F.col("frame_index") % 6 > 0), 0.5).otherwise(1.6)))


_BENT = _POSE + """, b AS (SELECT camera_id, track_id, frame_index, angle, CASE WHEN frame_index // 6 % 2 = 1 AND track_id % 2 = 0 THEN 15 / sqrt(dx * dx + 9e2) ELSE ratio END AS ratio, CASE WHEN frame_index // 6 % 2 = 1 THEN 7e1 ELSE y1 - y0 END AS h, CASE WHEN track_id % 3 = 0 THEN CASE WHEN frame_index // 6 % 2 = 1 AND frame_index % 6 > 0 THEN 5e-1 ELSE 16e-1 END END AS head FROM a),
k AS (SELECT *, median(h) OVER w AS ref, count(h) OVER w AS before FROM b WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_index ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, {flag} AS flag, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) AS run, sum(CASE WHEN {flag} AND head <= 8e-1 THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) AS lowrun FROM k),
l AS (SELECT *, CASE WHEN flag AND head <= 8e-1 THEN count(*) FILTER (flag AND head <= 8e-1) OVER (PARTITION BY camera_id, track_id, lowrun) ELSE 0 END AS low FROM r),
s AS (SELECT camera_id, track_id, min(frame_index) AS frame_start, max(frame_index) AS frame_end, (max(frame_index) - min(frame_index) + 1) / 5e0 AS value, max(angle) AS angle, min(ratio) AS ratio, median(h) AS m, arg_min(ref, frame_index) AS ref, arg_min(before, frame_index) AS before, max(low) AS low, count(head) AS seen FROM l WHERE flag GROUP BY camera_id, track_id, run)
"""


@C.add("ev_crouch", _BENT.format(flag="angle < 55 AND ratio <= 6e-1") + "SELECT 'crouch' AS type, camera_id, track_id, frame_start, frame_end, value, round(ratio, 6) AS ratio FROM s WHERE value >= 1e0 AND before >= 3 AND m <= 9e-1 * ref", ("observations",))
def ev_crouch(spark, d):
    return _r(P.crouch(_bent(spark, d)), "ratio")


@C.add("ev_fall", _BENT.format(flag="angle >= 55") + "SELECT 'fall' AS type, camera_id, track_id, frame_start, frame_end, value, round(angle, 6) AS angle FROM s WHERE value >= 1e0 AND before >= 3 AND m <= 9e-1 * ref", ("observations",))
def ev_fall(spark, d):
    return _r(P.fall(_bent(spark, d)), "angle")


@C.add("ev_fall_head", _BENT.format(flag="angle >= 55") + "SELECT 'fall' AS type, camera_id, track_id, frame_start, frame_end, value, round(angle, 6) AS angle FROM s WHERE value >= 1e0 AND before >= 3 AND m <= 9e-1 * ref AND (seen = 0 OR low / 5e0 >= 4e-1)", ("observations",))
def ev_fall_head(spark, d):
    return _r(P.fall(_bent(spark, d), head="head_m", head_seconds=0.4), "angle")


def _runs(spark, d):
    e, i = V.table(spark, d, "events"), F.col("event_id")
    return e.select((F.col("user_id") % 8).alias("camera_id"), ((F.dayofmonth("ts") - 1) * 6 + F.floor(F.hour("ts") / 4)).cast("long").alias("frame_index"), ((i * 13) % 700).alias("y"), ((i * 7) % 800).alias("x_start"), ((i * 7) % 800 + 200).alias("x_end"), (i % 3).alias("class_id"))


_CONTACT = """
, r AS (SELECT user_id % 8 AS camera_id, CAST((extract(day FROM ts) - 1) * 6 + floor(extract(hour FROM ts) / 4) AS BIGINT) AS frame_index, (event_id * 13) % 700 AS y, (event_id * 7) % 800 AS a, (event_id * 7) % 800 + 200 AS b, event_id % 3 AS c FROM events),
w AS (SELECT camera_id, track_id, frame_index, (x0 + x1) / 2 + 15 AS wx, y0 + 55 AS wy FROM observations WHERE score + 3e-1 >= 3e-1),
j AS (SELECT w.camera_id, track_id, w.frame_index, c, greatest(least(b, wx + sqrt(greatest(16e2 - (y - wy) * (y - wy), 0))) - greatest(a, wx - sqrt(greatest(16e2 - (y - wy) * (y - wy), 0))), 0) AS l FROM w JOIN r ON r.camera_id = w.camera_id AND r.frame_index = w.frame_index AND c <> 0 AND abs(y - wy) <= 40)"""


@C.add("j_wrist_contact", _CONTACT + " SELECT camera_id, track_id, frame_index, round(sum(CASE WHEN c = 1 THEN l ELSE 0 END) / sum(l), 6) AS contact FROM j WHERE l > 0 GROUP BY 1, 2, 3", ("observations",))
def j_wrist_contact(spark, d):
    return _r(P.wrist_contact(poses(spark, d), _runs(spark, d), 1, 0, 40.0), "contact")


@C.add("ev_reach_to_shelf", _CONTACT + """, c AS (SELECT camera_id, track_id, frame_index, sum(CASE WHEN c = 1 THEN l ELSE 0 END) / sum(l) AS contact FROM j WHERE l > 0 GROUP BY 1, 2, 3),
o AS (SELECT o.camera_id, o.track_id, o.frame_index, contact, coalesce(contact >= 35e-2, false) AS flag FROM observations o LEFT JOIN c ON c.camera_id = o.camera_id AND c.track_id = o.track_id AND c.frame_index = o.frame_index),
q AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) AS run FROM o)
SELECT 'reach_to_shelf' AS type, camera_id, track_id, min(frame_index) AS frame_start, max(frame_index) AS frame_end, (max(frame_index) - min(frame_index) + 1) / 5e0 AS value, round(max(contact), 6) AS contact FROM q WHERE flag GROUP BY camera_id, track_id, run HAVING (max(frame_index) - min(frame_index) + 1) / 5e0 >= 2e-1""", ("observations",))
def ev_reach_to_shelf(spark, d):
    p = poses(spark, d)
    return _r(P.reach_to_shelf(p, P.wrist_contact(p, _runs(spark, d), 1, 0, 40.0), min_seconds=0.2), "contact")


@C.add("j_visit_overlap", """
, t AS (SELECT camera_id, track_id, zone, frame_start, frame_end FROM stays WHERE track_id % 2 = 0), p AS (SELECT camera_id, zone, frame_start AS a, frame_end AS b, value AS s FROM stays WHERE track_id % 2 = 1)
SELECT t.camera_id, t.track_id, t.zone, t.frame_start, t.frame_end, coalesce(max(s) FILTER (a <= frame_end AND frame_start <= b), 0) AS found_seconds FROM t LEFT JOIN p ON t.camera_id = p.camera_id AND t.zone = p.zone GROUP BY 1, 2, 3, 4, 5""", ("stays",))
def j_visit_overlap(spark, d):
    from aislewatch.operators.events import zone_stays

    s = zone_stays(V.observations(spark, d), V.zones(spark), V.FPS).select("camera_id", "track_id", "zone", "frame_start", "frame_end", F.col("value").alias("seconds"))
    return P.visit_overlap(s.where("track_id % 2 = 0").drop("seconds"), s.where("track_id % 2 = 1"))


@C.add("j_visit_purity", _VISITS + """, m AS (SELECT camera_id, pred_id // 10 AS track_id, frame_index, arg_max(gt_id, (iou, gt_id)) AS gt_id FROM pairs WHERE iou >= 5e-1 GROUP BY 1, 2, 3),
n AS (SELECT v.camera_id, v.track_id, zone, frame_start, frame_end, gt_id, count(*) AS n FROM visits v JOIN m ON v.camera_id = m.camera_id AND v.track_id = m.track_id AND frame_index BETWEEN frame_start AND frame_end GROUP BY ALL)
SELECT camera_id, track_id, zone, frame_start, frame_end, arg_max(gt_id, (n, -gt_id)) AS gt_id, round(max(n) / sum(n), 6) AS purity FROM n GROUP BY 1, 2, 3, 4, 5""", ("inzone", "pairs"))
def j_visit_purity(spark, d):
    o = V.observations(spark, d)
    m = M.matched_boxes(V.truth_boxes(spark, d), V.pred_boxes(spark, d))
    owners = m.groupBy("camera_id", F.expr("pred_id DIV 10").alias("track_id"), "frame_index").agg(F.max_by("gt_id", F.struct("iou", "gt_id")).alias("gt_id"))
    return _r(P.visit_purity(R.visits(o, V.zones(spark)).select("camera_id", "track_id", "zone", "frame_start", "frame_end"), owners), "purity")


@C.add("j_embedding_collisions", """
, l AS (SELECT pid, unnest(feat) AS x, generate_subscripts(feat, 1) AS i FROM reid), m AS (SELECT pid, i, avg(x) AS x FROM l GROUP BY 1, 2), n AS (SELECT pid, sqrt(sum(x * x)) AS n FROM m GROUP BY 1),
c AS (SELECT p.pid AS a, q.pid AS b, sum(p.x * q.x) / any_value(np.n * nq.n) AS cosine FROM m p JOIN m q ON p.i = q.i AND p.pid < q.pid JOIN n np ON np.pid = p.pid JOIN n nq ON nq.pid = q.pid GROUP BY 1, 2), f AS (SELECT quantile_cont(cosine, 5e-1) AS f FROM c)
SELECT a, b, round(cosine, 6) AS cosine, round(f, 6) AS floor, round(greatest(0, (cosine - f) / (1 - f)), 6) AS excess FROM c, f""", ("reid",))
def j_embedding_collisions(spark, d):
    return _r(P.embedding_collisions(V.reid(spark, d)), "cosine", "floor", "excess")


STAFF = ["mean", "spread", "low", "high", "middle", "many", "days", "kinds", "late"]


def _staff(spark, d):
    """Nine numbers of each user, of unlike sizes; whether the user is staff depends on some of them."""
    e = V.table(spark, d, "events")
    t = e.groupBy(F.col("user_id").alias("track")).agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("spread"), F.min("value").alias("low"), F.max("value").alias("high"), F.percentile("value", 0.5).alias("middle"), F.count("*").cast("double").alias("many"),
        F.countDistinct(F.dayofmonth("ts")).cast("double").alias("days"), F.countDistinct("event_type").cast("double").alias("kinds"), F.avg((F.hour("ts") >= 12).cast("double")).alias("late"))
    return t.withColumns({"camera": F.col("track") % 4, "label": ((F.col("mean") - 50) / 10 + (F.col("late") - 0.5) * 4 + (F.col("track") % 7 - 3) / 4 > 0).cast("int")})


@C.add("agg_staff_fit")
def agg_staff_fit(spark, d):
    V.shared_dir(spark)
    return _r(P.leave_one_out(_staff(spark, d), STAFF), "accuracy")


@C.add("agg_staff_licence")
def agg_staff_licence(spark, d):
    V.shared_dir(spark)
    return _r(P.licence(P.leave_one_out(_staff(spark, d), STAFF)), "accuracy")


@C.add("agg_score_census", "SELECT camera_id, class_name, round(quantile_cont(score, 5e-1), 6) AS p50, round(quantile_cont(score, 9e-1), 6) AS p90, max(score) AS top, count(*) AS n FROM detections GROUP BY 1, 2", ("detections",))
def agg_score_census(spark, d):
    return _r(V.detections(spark, d).groupBy("camera_id", "class_name").agg(F.percentile("score", 0.5).alias("p50"), F.percentile("score", 0.9).alias("p90"), F.max("score").alias("top"), F.count("*").alias("n")), "p50", "p90")


@C.add("agg_campaign_plan", "SELECT c_nationkey AS camera, c_custkey % 7 AS day, count(*) AS clips, least(greatest(600 // count(*), 5), 60) AS frames_per_clip FROM customer WHERE c_acctbal >= 0 GROUP BY 1, 2")
def agg_campaign_plan(spark, d):
    c = V.table(spark, d, "customer").where("c_acctbal >= 0").groupBy(F.col("c_nationkey").alias("camera"), (F.col("c_custkey") % 7).alias("day")).agg(F.count("*").alias("clips"))
    return c.withColumn("frames_per_clip", F.least(F.greatest(F.expr("600 DIV clips"), F.lit(5)), F.lit(60)))


@C.add("agg_ambient_select", "SELECT image FROM (SELECT image, sum(n) FILTER (gt = 0) / sum(n) AS f, coalesce(sum(n) FILTER (gt = 1), 0) / sum(n) AS s FROM label_counts GROUP BY 1) WHERE f >= 8e-2 AND s <= 2e-2", ("label_counts",))
def agg_ambient_select(spark, d):
    share = lambda k: F.sum(F.when(F.col("gt") == k, F.col("n")).otherwise(0)) / F.sum("n")
    return V.label_counts(spark, d).groupBy("image").agg(share(0).alias("f"), share(1).alias("s")).where("f >= 0.08 AND s <= 0.02").select("image")


@C.add("agg_class_weight_steps", "SELECT gt AS class, CAST(sum(DISTINCT camera + 1) AS BIGINT) AS steps FROM label_counts GROUP BY 1", ("label_counts",))
def agg_class_weight_steps(spark, d):
    return V.label_counts(spark, d).select(F.col("gt").alias("class"), "camera").distinct().groupBy("class").agg(F.sum(F.col("camera") + 1).alias("steps"))


@C.add("j_head_disagreement", "SELECT camera, CAST(sum(n) FILTER (gt % 3 <> pred % 3) AS BIGINT) AS pixels, round(sum(n) FILTER (gt % 3 <> pred % 3) / sum(n), 6) AS share FROM label_counts GROUP BY 1", ("label_counts",))
def j_head_disagreement(spark, d):
    bad = F.sum(F.when(F.col("gt") % 3 != F.col("pred") % 3, F.col("n")))
    return _r(V.label_counts(spark, d).groupBy("camera").agg(bad.alias("pixels"), (bad / F.sum("n")).alias("share")), "share")


@C.add("j_world_truth", "SELECT g.camera_id, round(avg(sqrt((p.x0 - g.x0) ** 2)), 6) AS mean_error, round(quantile_cont(sqrt((p.x0 - g.x0) ** 2), 9e-1), 6) AS p90, count(*) AS n FROM truth_boxes g JOIN pred_boxes p ON g.camera_id = p.camera_id AND g.frame_index = p.frame_index AND g.gt_id = p.pred_id // 10 GROUP BY 1", ("truth_boxes", "pred_boxes"))
def j_world_truth(spark, d):
    t, p = V.truth_boxes(spark, d), V.pred_boxes(spark, d).select("camera_id", "frame_index", F.expr("pred_id DIV 10").alias("gt_id"), F.col("x0").alias("px"))
    j = t.join(p, ["camera_id", "frame_index", "gt_id"]).withColumn("e", F.abs(F.col("px") - F.col("x0")))
    return _r(j.groupBy("camera_id").agg(F.avg("e").alias("mean_error"), F.percentile("e", 0.9).alias("p90"), F.count("*").alias("n")), "mean_error", "p90")
