"""Tracks over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewatch.operators import tracks as T
from aislewatch.plans import views as V

C = V.Catalogue()
_r = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def _ready(spark):
    V.shared_dir(spark)


@C.add("udf_track")
def udf_track(spark, d):
    return T.track_boxes(V.detections(spark, d), max_age=5, min_hits=2).drop("x0", "y0", "x1", "y1")


@C.add("udf_track_two_stage")
def udf_track_two_stage(spark, d):
    return T.track_boxes(V.detections(spark, d), max_age=5, min_hits=2, high=0.5, low=0.1).drop("x0", "y0", "x1", "y1")


@C.add("udf_track_blocks")
def udf_track_blocks(spark, d):
    _ready(spark)
    return T.track_boxes(V.detections(spark, d), max_age=5, min_hits=2, block=60, overlap=20).drop("x0", "y0", "x1", "y1")


@C.add("op_nms", """
, r AS (SELECT *, row_number() OVER (PARTITION BY camera_id, frame_index, class_name ORDER BY score DESC, det_id) AS k, struct_pack(det_id, score, x0, y0, x1, y1) AS b FROM detections),
s AS (SELECT camera_id, frame_index, class_name, k, [b] AS kept FROM r WHERE k = 1
  UNION ALL SELECT r.camera_id, r.frame_index, r.class_name, r.k, CASE WHEN len(list_filter(kept, lambda a: greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0e0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0e0) * 15e-1 >= 5e-1 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)))) = 0 THEN list_append(kept, b) ELSE kept END
  FROM s JOIN r ON r.camera_id = s.camera_id AND r.frame_index = s.frame_index AND r.class_name = s.class_name AND r.k = s.k + 1),
f AS (SELECT camera_id, frame_index, class_name, unnest(arg_max(kept, k)) AS b FROM s GROUP BY 1, 2, 3)
SELECT b.det_id AS det_id, camera_id, frame_index, class_name, b.score AS score FROM f""", ("detections",))
def op_nms(spark, d):
    return T.suppress(V.detections(spark, d), 0.5).select("det_id", "camera_id", "frame_index", "class_name", "score")


@C.add("top_pre_nms", "SELECT det_id, camera_id, frame_index, score FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, frame_index ORDER BY score DESC, det_id) AS r FROM detections) WHERE r <= 3", ("detections",))
def top_pre_nms(spark, d):
    return T.top_scores(V.detections(spark, d), 3).select("det_id", "camera_id", "frame_index", "score")


_CLS = "SELECT *, CAST(score * 100 AS BIGINT) % 3 AS class_id FROM observations"


@C.add("win_label_vote", f"""
, c AS ({_CLS}), n AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, class_id ORDER BY frame_index) AS n FROM c)
SELECT a.camera_id, a.track_id, a.frame_index, a.class_id, arg_max(b.class_id, (b.n, -b.class_id)) AS voted FROM n a JOIN n b ON a.camera_id = b.camera_id AND a.track_id = b.track_id AND b.frame_index <= a.frame_index GROUP BY 1, 2, 3, 4""", ("observations",))
def win_label_vote(spark, d):
    rows = V.observations(spark, d).select("camera_id", "track_id", "frame_index", (F.round(F.col("score") * 100).cast("bigint") % 3).alias("class_id"))
    return T.label_vote(rows)


_CUTS = "SELECT camera_id, track_id, unnest([60, 120]) AS cut FROM (SELECT DISTINCT camera_id, track_id FROM observations WHERE track_id % 3 = 0)"


@C.add("win_split_at", f", c AS ({_CUTS}) SELECT camera_id, track_id, frame_index, (SELECT count(*) FROM c WHERE c.camera_id = o.camera_id AND c.track_id = o.track_id AND cut <= frame_index) AS part FROM observations o", ("observations",))
def win_split_at(spark, d):
    o = V.observations(spark, d)
    cuts = o.where("track_id % 3 = 0").select("camera_id", "track_id").distinct().withColumn("cut", F.explode(F.array(F.lit(60), F.lit(120))))
    return T.split_at(o, cuts).select("camera_id", "track_id", "frame_index", F.col("part").cast("long").alias("part"))


@C.add("win_merge_apply", """
, m AS (SELECT o.camera_id, frame_index, track_id, min(track_id) OVER (PARTITION BY camera_id, track_id % 24) AS merged_id FROM observations o)
SELECT camera_id, frame_index, merged_id, min(track_id) AS track_id, count(*) - 1 AS duplicates FROM m GROUP BY 1, 2, 3""", ("observations",))
def win_merge_apply(spark, d):
    o = V.observations(spark, d)
    groups = o.select("camera_id", "track_id", (F.col("track_id") % 24).alias("group")).distinct()
    return T.merge_tracks(o, groups).select("camera_id", "frame_index", "merged_id", "track_id", "duplicates")


_FRAG = """
, v AS (SELECT camera_id, track_id, frame_index, x0, y0, x1, y1, (x0 - lag(x0) OVER w) / (frame_index - lag(frame_index) OVER w) AS dx, (y1 - lag(y1) OVER w) / (frame_index - lag(frame_index) OVER w) AS dy
  FROM (SELECT camera_id, track_id * 10 + frame_index // 30 AS track_id, frame_index, x0, y0, x1, y1 FROM observations) WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_index)),
f AS (SELECT camera_id, track_id, min(frame_index) AS f0, max(frame_index) AS f1, arg_min(x0, frame_index) AS ax0, arg_min(x1, frame_index) AS ax1, arg_min(y0, frame_index) AS ay0, arg_min(y1, frame_index) AS ay1,
  arg_max(x0, frame_index) AS bx0, arg_max(x1, frame_index) AS bx1, arg_max(y0, frame_index) AS by0, arg_max(y1, frame_index) AS by1, coalesce(arg_max(dx, frame_index), 0) AS vx, coalesce(arg_max(dy, frame_index), 0) AS vy FROM v GROUP BY 1, 2),
j AS (SELECT e.camera_id, e.track_id AS a_id, s.track_id AS b_id, s.f0 - e.f1 AS gap, (s.ax0 + s.ax1 - e.bx0 - e.bx1) / 2 AS dx, s.ay1 - e.by1 AS dy, e.vx, e.vy, e.by1 - e.by0 AS h0, s.ay1 - s.ay0 AS h1 FROM f e JOIN f s ON e.camera_id = s.camera_id AND s.f0 - e.f1 BETWEEN 1 AND 10),
c AS (SELECT camera_id, a_id, b_id, gap, least(sqrt(dx * dx + dy * dy), sqrt((dx - vx * gap) ** 2 + (dy - vy * gap) ** 2)) / greatest(h0, 1e-6) AS score, h0, h1 FROM j)
"""


def _frags(spark, d):
    o = V.observations(spark, d)
    return T.fragments(o.withColumn("track_id", F.col("track_id") * 10 + F.floor(F.col("frame_index") / 30)))


@C.add("j_stitch_candidates", _FRAG + "SELECT camera_id, a_id, b_id, gap, round(score, 6) AS score FROM c WHERE score <= 5e-1 + 5e-2 * gap AND greatest(h0, h1) <= 1.6e0 * least(h0, h1)", ("observations",))
def j_stitch_candidates(spark, d):
    return _r(T.stitch_candidates(_frags(spark, d), max_gap=10), "score")


@C.add("j_stitch_greedy")
def j_stitch_greedy(spark, d):
    _ready(spark)
    return T.stitch_greedy(T.stitch_candidates(_frags(spark, d), max_gap=10))


@C.add("j_stitch_chains")
def j_stitch_chains(spark, d):
    _ready(spark)
    return T.chains(T.stitch_greedy(T.stitch_candidates(_frags(spark, d), max_gap=10)))


@C.add("j_interpolate", """
, g AS (SELECT *, lag(frame_index) OVER w AS pf, lag(x0) OVER w AS p0, lag(y0) OVER w AS p1, lag(x1) OVER w AS p2, lag(y1) OVER w AS p3 FROM observations WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_index)),
i AS (SELECT *, unnest(range(pf + 1, frame_index)) AS f FROM g WHERE frame_index - pf > 1)
SELECT camera_id, track_id, f AS frame_index, round(p0 + (x0 - p0) * ((f - pf) / (frame_index - pf)), 6) AS x0, round(p1 + (y0 - p1) * ((f - pf) / (frame_index - pf)), 6) AS y0, round(p2 + (x1 - p2) * ((f - pf) / (frame_index - pf)), 6) AS x1, round(p3 + (y1 - p3) * ((f - pf) / (frame_index - pf)), 6) AS y1, true AS interpolated FROM i
UNION ALL SELECT camera_id, track_id, frame_index, round(x0, 6), round(y0, 6), round(x1, 6), round(y1, 6), false FROM observations""", ("observations",))
def j_interpolate(spark, d):
    return _r(T.interpolate(V.observations(spark, d)), "x0", "y0", "x1", "y1")


_CO = """
, j AS (SELECT a.camera_id, a.track_id AS a_id, b.track_id AS b_id, a.frame_index, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0e0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0e0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
  FROM observations a JOIN observations b ON a.camera_id = b.camera_id AND a.frame_index = b.frame_index AND a.track_id < b.track_id)
"""


@C.add("j_copresent", _CO + "SELECT camera_id, a_id, b_id, count(*) AS frames, round(max(i / (s - i)), 6) AS max_iou, arg_max(frame_index, (i / (s - i), -frame_index)) AS at_frame FROM j GROUP BY 1, 2, 3", ("observations",))
def j_copresent(spark, d):
    return _r(T.copresence(V.observations(spark, d)), "max_iou")


@C.add("j_ending_classify", """
, l AS (SELECT camera_id, track_id, max(frame_index) AS f, arg_max((x0 + x1) / 2, frame_index) AS u, arg_max(y1, frame_index) AS v FROM observations GROUP BY 1, 2), e AS (SELECT camera_id, max(frame_index) AS e FROM observations GROUP BY 1),
n AS (SELECT l.camera_id, l.track_id, min(d.frame_index) AS r FROM l JOIN observations d ON l.camera_id = d.camera_id AND d.track_id <> l.track_id AND d.frame_index > f AND d.frame_index <= f + 5 AND sqrt(((x0 + x1) / 2 - u) ** 2 + (y1 - v) ** 2) <= 60 * (d.frame_index - f) GROUP BY 1, 2)
SELECT l.camera_id, l.track_id, f AS last_frame, CASE WHEN f > e - 5 THEN 'censored' WHEN r IS NOT NULL THEN 'lost' ELSE 'gone' END AS why, r AS recovered_at FROM l JOIN e ON l.camera_id = e.camera_id LEFT JOIN n ON n.camera_id = l.camera_id AND n.track_id = l.track_id""", ("observations",))
def j_ending_classify(spark, d):
    o = V.observations(spark, d)
    return T.endings(o, o, max_gap=5)


@C.add("agg_track_endings", """
, l AS (SELECT camera_id, track_id, max(frame_index) AS f, arg_max((x0 + x1) / 2, frame_index) AS u, arg_max(y1, frame_index) AS v FROM observations GROUP BY 1, 2), e AS (SELECT camera_id, max(frame_index) AS e FROM observations GROUP BY 1),
n AS (SELECT l.camera_id, l.track_id, min(d.frame_index) AS r FROM l JOIN observations d ON l.camera_id = d.camera_id AND d.track_id <> l.track_id AND d.frame_index > f AND d.frame_index <= f + 5 AND sqrt(((x0 + x1) / 2 - u) ** 2 + (y1 - v) ** 2) <= 60 * (d.frame_index - f) GROUP BY 1, 2),
w AS (SELECT l.camera_id, f, CASE WHEN r IS NOT NULL THEN 'lost' ELSE 'gone' END AS why, r FROM l JOIN e ON l.camera_id = e.camera_id LEFT JOIN n ON n.camera_id = l.camera_id AND n.track_id = l.track_id WHERE f <= e - 5)
SELECT camera_id, why, count(*) AS n, median(r - f) AS gap_p50 FROM w GROUP BY 1, 2""", ("observations",))
def agg_track_endings(spark, d):
    o = V.observations(spark, d)
    return T.endings(o, o, max_gap=5).where("why <> 'censored'").groupBy("camera_id", "why").agg(F.count("*").alias("n"), F.percentile(F.col("recovered_at") - F.col("last_frame"), 0.5).alias("gap_p50"))


@C.add("j_drop_static", """
, n AS (SELECT camera_id, count(DISTINCT frame_index) AS n FROM detections GROUP BY 1),
h AS (SELECT a.det_id, count(DISTINCT b.frame_index) AS k FROM detections a JOIN detections b ON a.camera_id = b.camera_id AND a.frame_index <> b.frame_index
  AND greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0e0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0e0) * 1.8e0 >= 8e-1 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)) GROUP BY 1)
SELECT d.det_id, coalesce(k >= greatest(round(5e-2 * n), 2), false) AS static FROM detections d JOIN n ON d.camera_id = n.camera_id LEFT JOIN h ON d.det_id = h.det_id""", ("detections",))
def j_drop_static(spark, d):
    return T.drop_static(V.detections(spark, d), share=0.05).select("det_id", "static")


@C.add("j_joins_between_trackers", """
, o AS (SELECT camera_id, track_id, frame_index, (track_id * 7 + frame_index // 20) % 5 AS owner FROM observations), c AS (SELECT *, CASE WHEN owner <> lag(owner) OVER w THEN 1 ELSE 0 END AS c FROM o WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_index)),
r AS (SELECT *, sum(c) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) AS run FROM c), g AS (SELECT camera_id, track_id, run, owner, min(frame_index) AS frame_start, max(frame_index) AS frame_end, count(*) AS n FROM r GROUP BY 1, 2, 3, 4)
SELECT camera_id, track_id, owner, frame_start, frame_end, n, lead(owner) OVER (PARTITION BY camera_id, track_id ORDER BY run) AS next_owner FROM g""", ("observations",))
def j_joins_between_trackers(spark, d):
    o = V.observations(spark, d).select("camera_id", "track_id", "frame_index", ((F.col("track_id") * 7 + F.floor(F.col("frame_index") / 20)) % 5).alias("owner"))
    return T.owner_runs(o).drop("run")


@C.add("win_low_spell", """
, r AS (SELECT *, sum(CASE WHEN z_m <= 3e0 THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) AS run FROM observations)
SELECT camera_id, track_id, max(s) AS seconds FROM (SELECT camera_id, track_id, (max(frame_index) - min(frame_index) + 1) / 5e0 AS s FROM r WHERE z_m <= 3e0 GROUP BY camera_id, track_id, run) GROUP BY 1, 2""", ("observations",))
def win_low_spell(spark, d):
    return T.longest_low_spell(V.observations(spark, d), F.col("z_m"), 3.0)


@C.add("sel_farthest_first")
def sel_farthest_first(spark, d):
    _ready(spark)
    e = V.table(spark, d, "embeddings").select((F.col("vec_id") % 64).alias("clip"), F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("feat"))
    return T.farthest_first(e, 5, "clip")


_BD = """
, e AS (SELECT camera_id, max(frame_index) AS e FROM observations GROUP BY 1), t AS (SELECT camera_id, track_id, min(frame_index) AS f0, max(frame_index) AS f1, arg_min(x_m, frame_index) AS ax, arg_min(z_m, frame_index) AS az, arg_max(x_m, frame_index) AS bx, arg_max(z_m, frame_index) AS bz FROM observations GROUP BY 1, 2)
SELECT camera_id, track_id, 'birth' AS kind, f0 AS frame_index, ax AS x, az AS z FROM t WHERE f0 >= 2 UNION ALL SELECT t.camera_id, track_id, 'death', f1, bx, bz FROM t JOIN e ON t.camera_id = e.camera_id WHERE f1 <= e - 2"""


@C.add("win_censored_events", _BD, ("observations",))
def win_censored_events(spark, d):
    return T.births_and_deaths(V.observations(spark, d))


@C.add("win_entrance_clusters")
def win_entrance_clusters(spark, d):
    p = T.births_and_deaths(V.observations(spark, d))
    return T.entrance_clusters(p.withColumn("order", F.col("frame_index") * 1000 + F.col("track_id")))
