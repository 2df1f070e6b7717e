"""Security events over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewatch.operators import events as E
from aislewatch.plans import views as V

C = V.Catalogue()
_TRACK_EVENT = "camera_id, track_id, zone, frame_start, frame_end, value"


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@C.add("ev_loitering", f"SELECT 'loitering' AS type, {_TRACK_EVENT}, loiter_seconds AS threshold FROM stays WHERE value >= loiter_seconds", ("stays",))
def ev_loitering(spark, d):
    return E.loitering(V.observations(spark, d), V.zones(spark))


@C.add("ev_zone_intrusion", f"SELECT 'zone_intrusion' AS type, {_TRACK_EVENT}, 1e0 AS threshold FROM stays WHERE restricted AND value >= 1e0", ("stays",))
def ev_zone_intrusion(spark, d):
    return E.zone_intrusion(V.observations(spark, d), V.zones(spark))


@C.add("win_runs", "SELECT camera_id, track_id, zone, frame_start, frame_end, value FROM stays", ("stays",))
def win_runs(spark, d):
    return E.zone_stays(V.observations(spark, d), V.zones(spark), V.FPS).select("camera_id", "track_id", "zone", "frame_start", "frame_end", "value")


@C.add("j_zone_contains", "SELECT camera_id, track_id, frame_index, zone, inside FROM inzone", ("inzone",))
def j_zone_contains(spark, d):
    return E.in_zones(V.observations(spark, d), V.zones(spark)).select("camera_id", "track_id", "frame_index", "zone", "inside")


_OCC = "SELECT camera_id, zone, frame_index, count(*) AS n FROM inzone WHERE inside GROUP BY 1, 2, 3"


@C.add("agg_occupancy_frame", _OCC, ("inzone",))
def agg_occupancy_frame(spark, d):
    return E.zone_occupancy(V.observations(spark, d), V.zones(spark)).select("camera_id", "zone", "frame_index", "n")


@C.add("ev_occupancy", f"""
SELECT 'occupancy_exceeded' AS type, camera_id, zone, min(frame_index) AS frame_start, max(frame_index) AS frame_end, CAST(max(n) AS DOUBLE) AS value, 0e0 AS threshold
FROM (SELECT *, frame_index - row_number() OVER (PARTITION BY camera_id, zone ORDER BY frame_index) AS run FROM ({_OCC}) WHERE n > 0)
GROUP BY camera_id, zone, run HAVING (max(frame_index) - min(frame_index) + 1) / 5e0 >= 4e-1""", ("inzone",))
def ev_occupancy(spark, d):
    return E.occupancy_exceeded(V.observations(spark, d), V.zones(spark).withColumn("max_occupancy", F.lit(0)), min_seconds=0.4)


@C.add("ev_line_cross", "SELECT 'line_cross' AS type, camera_id, track_id, line, frame_start, frame_end, CAST(value AS DOUBLE) AS value, direction FROM crossings", ("crossings",))
def ev_line_cross(spark, d):
    return E.line_crossings(V.observations(spark, d), V.lines(spark))


@C.add("ev_tailgating", """
SELECT 'tailgating' AS type, camera_id, line, direction, t0 AS first_track, track_id AS second_track, f0 AS frame_start, frame_end, (frame_start - f0) / 5e0 AS value
FROM (SELECT *, lag(track_id) OVER w AS t0, lag(frame_start) OVER w AS f0 FROM crossings WINDOW w AS (PARTITION BY camera_id, line, direction ORDER BY frame_start, track_id, frame_end))
WHERE t0 <> track_id AND (frame_start - f0) / 5e0 <= 2e0""", ("crossings",))
def ev_tailgating(spark, d):
    return E.tailgating(V.observations(spark, d), V.lines(spark))


@C.add("ev_running", """
, s AS (SELECT camera_id, track_id, frame_index, CASE WHEN f1 > frame_index THEN sqrt((x1_ - x_m) * (x1_ - x_m) + (z1_ - z_m) * (z1_ - z_m)) / ((f1 - frame_index) / 5e0) END AS speed
  FROM (SELECT *, last_value(frame_index) OVER w AS f1, last_value(x_m) OVER w AS x1_, last_value(z_m) OVER w AS z1_ FROM observations
        WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_index RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING)))
SELECT 'running' AS type, camera_id, track_id, min(frame_index) AS frame_start, max(frame_index) AS frame_end, round(max(speed), 6) AS value, 1.2e0 AS threshold
FROM (SELECT *, sum(CASE WHEN coalesce(speed, 0) > 1.2e0 THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) AS run FROM s) WHERE speed > 1.2e0
GROUP BY camera_id, track_id, run HAVING (max(frame_index) - min(frame_index) + 1) / 5e0 >= 6e-1""", ("observations",))
def ev_running(spark, d):
    return _r(E.running(V.observations(spark, d), max_speed=1.2), "value")


_NEAR = "SELECT a.camera_id, a.frame_index, a.track_id, count(*) AS n FROM observations a JOIN observations b ON a.camera_id = b.camera_id AND a.frame_index = b.frame_index AND sqrt((b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.z_m - a.z_m) * (b.z_m - a.z_m)) <= 1.5e0 GROUP BY 1, 2, 3"


@C.add("j_crowd_pairs", _NEAR, ("observations",))
def j_crowd_pairs(spark, d):
    return E.crowd_neighbours(V.observations(spark, d), 1.5)


@C.add("ev_crowd", f"""
, m AS (SELECT camera_id, frame_index, max(n) AS n FROM ({_NEAR}) GROUP BY 1, 2 HAVING max(n) >= 2)
SELECT 'crowd_forming' AS type, camera_id, min(frame_index) AS frame_start, max(frame_index) AS frame_end, CAST(max(n) AS DOUBLE) AS value, 2e0 AS threshold
FROM (SELECT *, frame_index - row_number() OVER (PARTITION BY camera_id ORDER BY frame_index) AS run FROM m) GROUP BY camera_id, run HAVING (max(frame_index) - min(frame_index) + 1) / 5e0 >= 4e-1""", ("observations",))
def ev_crowd(spark, d):
    return E.crowd_forming(V.observations(spark, d), min_people=2, min_seconds=0.4)


_BAGS = """
, bag AS (SELECT camera_id, track_id, min(frame_index) AS frame_start, max(frame_index) AS frame_end, avg(x_m) AS x, avg(z_m) AS z, (max(frame_index) - min(frame_index) + 1) / 5e0 AS value
  FROM observations WHERE class_name = 'bag' GROUP BY 1, 2),
spread AS (SELECT bag.*, (SELECT max(sqrt((o.x_m - x) ** 2 + (o.z_m - z) ** 2)) FROM observations o WHERE o.camera_id = bag.camera_id AND o.track_id = bag.track_id) AS spread FROM bag),
near AS (SELECT s.camera_id, s.track_id, min(sqrt((o.x_m - x) ** 2 + (o.z_m - z) ** 2)) AS nearest FROM spread s LEFT JOIN observations o ON o.camera_id = s.camera_id AND o.class_name = 'person' AND o.frame_index BETWEEN s.frame_start AND s.frame_end GROUP BY 1, 2)
"""


@C.add("ev_object_left", _BAGS + """SELECT 'object_left' AS type, s.camera_id, s.track_id, frame_start, frame_end, value, round(spread, 6) AS spread, round(nearest, 6) AS nearest
FROM spread s JOIN near n ON s.camera_id = n.camera_id AND s.track_id = n.track_id WHERE value >= 2e0 AND spread <= 6e0 AND (nearest IS NULL OR nearest > 5e-2)""", ("observations",))
def ev_object_left(spark, d):
    return _r(E.object_left(V.observations(spark, d), still_seconds=2.0, still_radius=6.0, owner_radius=0.05), "spread", "nearest")


@C.add("j_nearest_person", _BAGS + "SELECT s.camera_id, s.track_id, frame_start, frame_end, round(nearest, 6) AS nearest FROM spread s JOIN near n ON s.camera_id = n.camera_id AND s.track_id = n.track_id", ("observations",))
def j_nearest_person(spark, d):
    o = V.observations(spark, d)
    spans = o.where("class_name = 'bag'").groupBy("camera_id", "track_id").agg(F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"), F.avg("x_m").alias("x"), F.avg("z_m").alias("z"))
    return _r(E.nearest_person(spans, o.where("class_name = 'person'")), "nearest").drop("x", "z")


_STOCK = """
, boxes AS (SELECT * FROM detections WHERE class_name IN ('boxed_stock', 'device') AND score >= 3e-1),
hit AS (SELECT b.camera_id, zone, frame_index, count(*) AS n FROM boxes b JOIN zones z ON b.camera_id = z.camera_id AND x_m >= x_lo AND x_m < x_hi AND z_m >= z_lo AND z_m < z_hi GROUP BY 1, 2, 3),
stock AS (SELECT f.camera_id, zone, f.frame_index, coalesce(n, 0) AS n FROM (SELECT DISTINCT camera_id, frame_index FROM detections) f JOIN (SELECT camera_id, zone FROM zones) z USING (camera_id) LEFT JOIN hit USING (camera_id, zone, frame_index))
"""


@C.add("agg_zone_stock", _STOCK + "SELECT * FROM stock", ("detections", "zones"))
def agg_zone_stock(spark, d):
    det = V.detections(spark, d)
    return E.zone_stock(det, det, V.zones(spark))


@C.add("ev_stock_removed", _STOCK + """, ends AS (SELECT camera_id, zone, min(frame_index) AS lo, max(frame_index) AS hi FROM stock GROUP BY 1, 2),
dense AS (SELECT e.camera_id, e.zone, lo, hi, f AS frame_index, coalesce(s.n, 0) AS n FROM (SELECT *, unnest(range(lo, hi + 1)) AS f FROM ends) e LEFT JOIN stock s ON s.camera_id = e.camera_id AND s.zone = e.zone AND s.frame_index = f),
level AS (SELECT *, median(n) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before, max(n) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS after FROM dense WINDOW w AS (PARTITION BY camera_id, zone ORDER BY frame_index)),
drops AS (SELECT camera_id, zone, frame_index, before - after AS value FROM level WHERE frame_index - lo >= 2 AND frame_index + 1 <= hi AND before - after >= 1),
kept AS (SELECT camera_id, zone, min(frame_index) AS frame_index FROM drops GROUP BY 1, 2 UNION ALL SELECT k.camera_id, k.zone, min(d.frame_index) FROM kept k JOIN drops d ON d.camera_id = k.camera_id AND d.zone = k.zone AND d.frame_index >= k.frame_index + 2 GROUP BY k.camera_id, k.zone, k.frame_index)
SELECT 'stock_removed' AS type, camera_id, zone, frame_index AS frame_start, frame_index + 1 AS frame_end, CAST(value AS DOUBLE) AS value FROM kept JOIN drops USING (camera_id, zone, frame_index)""", ("detections", "zones"))
def ev_stock_removed(spark, d):
    det = V.detections(spark, d)
    return E.stock_removed(E.zone_stock(det, det, V.zones(spark)), hold_seconds=0.4)


@C.add("ev_fall_candidate", """
, s AS (SELECT *, y1 - y0 AS h, (x1 - x0) / (y1 - y0) AS a FROM observations), t AS (SELECT camera_id, track_id, quantile_cont(h, 9e-1) AS tall, count(*) AS n FROM s GROUP BY 1, 2)
SELECT 'fall_candidate' AS type, camera_id, track_id, min(frame_index) AS frame_start, max(frame_index) AS frame_end, (max(frame_index) - min(frame_index) + 1) / 5e0 AS value, max(a) AS box_aspect
FROM (SELECT s.*, tall, sum(CASE WHEN a >= 4e-1 AND h <= tall THEN 0 ELSE 1 END) OVER (PARTITION BY s.camera_id, s.track_id ORDER BY frame_index) AS run FROM s JOIN t ON s.camera_id = t.camera_id AND s.track_id = t.track_id AND n > 1)
WHERE a >= 4e-1 AND h <= tall GROUP BY camera_id, track_id, run HAVING (max(frame_index) - min(frame_index) + 1) / 5e0 >= 1.5e0""", ("observations",))
def ev_fall_candidate(spark, d):
    return E.fall_candidate(V.observations(spark, d), aspect=0.4, ratio=1.0)


@C.add("j_event_support", """
, e AS (SELECT camera_id, track_id, zone, frame_start, frame_end FROM stays WHERE value >= loiter_seconds)
SELECT e.*, round(median(score), 6) AS score_p50, min(score) AS score_min, count(*) AS observed, frame_end - frame_start + 1 AS span
FROM e JOIN observations o ON e.camera_id = o.camera_id AND e.track_id = o.track_id AND o.frame_index BETWEEN frame_start AND frame_end GROUP BY ALL""", ("stays",))
def j_event_support(spark, d):
    o = V.observations(spark, d)
    ev = E.loitering(o, V.zones(spark)).select("camera_id", "track_id", "zone", "frame_start", "frame_end")
    return _r(E.event_support(ev, o), "score_p50")


@C.add("set_union_events", f"""
SELECT 'loitering' AS type, camera_id, track_id, zone, frame_start, frame_end, value FROM stays WHERE value >= loiter_seconds
UNION ALL SELECT 'line_cross', camera_id, track_id, NULL, frame_start, frame_end, CAST(value AS DOUBLE) FROM crossings""", ("stays", "crossings"))
def set_union_events(spark, d):
    o = V.observations(spark, d)
    return E.union_events(E.loitering(o, V.zones(spark)).drop("threshold"), E.line_crossings(o, V.lines(spark)).drop("line", "direction"))


@C.add("event_row", """SELECT camera_id, track_id, zone, frame_start, frame_end, round(value / 7, 3) AS value FROM stays WHERE value >= loiter_seconds""", ("stays",))
def event_row(spark, d):
    ev = E.loitering(V.observations(spark, d), V.zones(spark))
    return E.event_row(ev.withColumn("value", F.col("value") / 7)).drop("type", "threshold")


@C.add("event_clock", """
SELECT camera_id, track_id, zone, frame_start, frame_end, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(frame_start * 200000) AS started_at, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds((frame_end + 1) * 200000) AS ended_at, value AS seconds
FROM stays WHERE value >= loiter_seconds""", ("stays",))
def event_clock(spark, d):
    ev = E.with_clock(E.loitering(V.observations(spark, d), V.zones(spark)), F.lit("2024-01-01").cast("timestamp"), V.FPS)
    return ev.select("camera_id", "track_id", "zone", "frame_start", "frame_end", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), "seconds")


@C.add("require_buildable", "SELECT DISTINCT event_type AS type FROM events")
def require_buildable(spark, d):
    return E.require_buildable(V.table(spark, d, "events").select(F.col("event_type").alias("type")))
