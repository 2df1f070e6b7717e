"""Dwell, heat, visits and journeys over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewatch.operators import retail as R
from aislewatch.plans import views as V

C = V.Catalogue()
_r = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

_DWELL = """SELECT t.camera_id, track_id, first_frame, last_frame, observed_frames, (last_frame - first_frame + 1) / 5e0 AS dwell_s, last_frame - first_frame + 1 - observed_frames AS coasted, last_frame >= e AS truncated
FROM (SELECT camera_id, track_id, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS observed_frames FROM observations GROUP BY 1, 2) t JOIN (SELECT camera_id, max(frame_index) AS e FROM observations GROUP BY 1) x ON t.camera_id = x.camera_id"""


@C.add("agg_dwell_table", _DWELL, ("observations",))
def agg_dwell_table(spark, d):
    return R.dwell_table(V.observations(spark, d))


@C.add("sort_first_seen", f"SELECT camera_id, track_id, first_frame, row_number() OVER (PARTITION BY camera_id ORDER BY first_frame, track_id) AS place FROM ({_DWELL})", ("observations",))
def sort_first_seen(spark, d):
    from pyspark.sql import Window

    t = R.dwell_table(V.observations(spark, d))
    return t.select("camera_id", "track_id", "first_frame", F.row_number().over(Window.partitionBy("camera_id").orderBy("first_frame", "track_id")).alias("place"))


@C.add("agg_flow_summary", f"SELECT camera_id, count(*) AS tracks, count(*) FILTER (NOT truncated) AS complete, round(quantile_cont(dwell_s, 5e-1) FILTER (NOT truncated), 6) AS median_s, round(quantile_cont(dwell_s, 9e-1) FILTER (NOT truncated), 6) AS p90_s FROM ({_DWELL}) GROUP BY 1", ("observations",))
def agg_flow_summary(spark, d):
    return _r(R.flow_summary(R.dwell_table(V.observations(spark, d))), "median_s", "p90_s")


_MAP = """, b AS (SELECT camera_id, min(x_m) AS xl, max(x_m) AS xh, min(z_m) AS zl, max(z_m) AS zh FROM observations GROUP BY 1),
cells AS (SELECT o.camera_id, CAST(least(floor((x_m - xl) / 25e-2), greatest(ceil((xh - xl) / 25e-2), 1) - 1) AS BIGINT) AS cell_x, CAST(least(floor((z_m - zl) / 25e-2), greatest(ceil((zh - zl) / 25e-2), 1) - 1) AS BIGINT) AS cell_z, any_value(xl) AS xl, any_value(zl) AS zl, count(*) AS n
  FROM observations o JOIN b ON o.camera_id = b.camera_id GROUP BY 1, 2, 3)
"""


@C.add("agg_ground_map", _MAP + "SELECT camera_id, cell_x, cell_z, round(xl + (cell_x + 5e-1) * 25e-2, 6) AS x, round(zl + (cell_z + 5e-1) * 25e-2, 6) AS z, n FROM cells", ("observations",))
def agg_ground_map(spark, d):
    return _r(R.ground_map(V.observations(spark, d)), "x", "z")


@C.add("agg_visited_area", _MAP + "SELECT camera_id, count(*) * 625e-4 AS visited_m2 FROM cells GROUP BY 1", ("observations",))
def agg_visited_area(spark, d):
    return R.visited_area(R.ground_map(V.observations(spark, d)))


@C.add("top_busiest", _MAP + "SELECT * FROM (SELECT camera_id, cell_x, cell_z, n, row_number() OVER (PARTITION BY camera_id ORDER BY n DESC, cell_x, cell_z) AS rank FROM cells) WHERE rank <= 5", ("observations",))
def top_busiest(spark, d):
    return R.busiest_cells(R.ground_map(V.observations(spark, d))).drop("x", "z")


_HEAT = "SELECT camera_id, CAST(floor(x_m / 25e-2) AS BIGINT) AS cell_x, CAST(floor(z_m / 25e-2) AS BIGINT) AS cell_z, count(*) / 5e0 AS seconds, count(DISTINCT track_id) AS tracks FROM observations GROUP BY 1, 2, 3"


@C.add("agg_heat_dwell", f"SELECT camera_id, cell_x, cell_z, seconds FROM ({_HEAT})", ("observations",))
def agg_heat_dwell(spark, d):
    return R.heat_cells(V.observations(spark, d)).drop("tracks")


@C.add("agg_heat_traffic", f"SELECT camera_id, cell_x, cell_z, tracks FROM ({_HEAT})", ("observations",))
def agg_heat_traffic(spark, d):
    return R.heat_cells(V.observations(spark, d)).drop("seconds")


@C.add("agg_heat_normalise", f"""
, h AS ({_HEAT}), b AS (SELECT camera_id, min(cell_x) xl, max(cell_x) xh, min(cell_z) zl, max(cell_z) zh FROM h GROUP BY 1),
k AS (SELECT d, exp(-d * d / 45e-1) / sum(exp(-d * d / 45e-1)) OVER () AS g FROM (SELECT unnest(range(-6, 7)) AS d)),
gx AS (SELECT b.camera_id, x AS cell_x, z AS cell_z, xl, xh, zl, zh FROM b, (SELECT unnest(range(-100, 100)) AS x), (SELECT unnest(range(-100, 100)) AS z) WHERE x BETWEEN xl AND xh AND z BETWEEN zl AND zh),
s1 AS (SELECT gx.camera_id, gx.cell_x, gx.cell_z, sum(coalesce(h.seconds, 0) * g) AS v, any_value(zl) zl, any_value(zh) zh FROM gx, k LEFT JOIN h ON h.camera_id = gx.camera_id AND h.cell_z = gx.cell_z
  AND h.cell_x = CASE WHEN gx.cell_x + d < xl THEN 2 * xl - 1 - gx.cell_x - d WHEN gx.cell_x + d > xh THEN 2 * xh + 1 - gx.cell_x - d ELSE gx.cell_x + d END GROUP BY 1, 2, 3),
s2 AS (SELECT a.camera_id, a.cell_x, a.cell_z, sum(coalesce(c.v, 0) * g) AS v FROM s1 a, k LEFT JOIN s1 c ON c.camera_id = a.camera_id AND c.cell_x = a.cell_x
  AND c.cell_z = CASE WHEN a.cell_z + d < a.zl THEN 2 * a.zl - 1 - a.cell_z - d WHEN a.cell_z + d > a.zh THEN 2 * a.zh + 1 - a.cell_z - d ELSE a.cell_z + d END GROUP BY 1, 2, 3),
top AS (SELECT camera_id, quantile_cont(v, 99e-2) AS t FROM s2 WHERE v > 0 GROUP BY 1)
SELECT s2.camera_id, cell_x, cell_z, round(least(v / t, 1e0), 6) AS heat FROM s2 JOIN top ON s2.camera_id = top.camera_id WHERE v > 0""", ("observations",))
def agg_heat_normalise(spark, d):
    return _r(R.heat_normalised(R.heat_cells(V.observations(spark, d))), "heat")


@C.add("agg_busiest_zone", f"""
, c AS (SELECT camera_id, floor(x_m / 25e-2) AS cx, floor(z_m / 25e-2) AS cz, count(*) AS n FROM observations GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY n DESC, cx, cz) AS k, sum(n) OVER (PARTITION BY camera_id) AS t FROM c)
SELECT camera_id, (cx + 5e-1) * 25e-2 - 5e-1 AS x_lo, (cx + 5e-1) * 25e-2 + 5e-1 AS x_hi, (cz + 5e-1) * 25e-2 - 5e-1 AS z_lo, (cz + 5e-1) * 25e-2 + 5e-1 AS z_hi, n, round(n / t, 6) AS share FROM r WHERE k = 1""", ("observations",))
def agg_busiest_zone(spark, d):
    return _r(R.busiest_zone(V.observations(spark, d)), "share")


_VISITS = """
, k AS (SELECT *, sum(CAST(inside AS INT)) OVER (PARTITION BY camera_id, track_id, zone ORDER BY frame_index) AS k FROM inzone),
spell AS (SELECT camera_id, track_id, zone, k, min(frame_index) FILTER (inside) AS f, min(frame_index) FILTER (NOT inside) AS o0, max(frame_index) FILTER (NOT inside) AS o1, count(*) FILTER (NOT inside) AS n_out FROM k WHERE k > 0 GROUP BY 1, 2, 3, 4),
prev AS (SELECT *, lag(o0) OVER w AS p0, lag(o1) OVER w AS p1, lag(n_out) OVER w AS pn FROM spell WINDOW w AS (PARTITION BY camera_id, track_id, zone ORDER BY f)),
brk AS (SELECT *, coalesce(pn > 0 AND (p1 - p0 + 1) / 5e0 >= 1e0, false) AS new FROM prev),
num AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY camera_id, track_id, zone ORDER BY f) AS v FROM brk),
visits AS (SELECT camera_id, track_id, zone, min(f) AS frame_start, max(f) AS frame_end, CAST(sum(1 + CASE WHEN new OR pn IS NULL THEN 0 ELSE pn END) AS BIGINT) AS observed, max(f) - min(f) + 1 AS span, (max(f) - min(f) + 1) / 5e0 AS seconds
  FROM num GROUP BY camera_id, track_id, zone, v HAVING (max(f) - min(f) + 1) / 5e0 >= 1e0)
"""


@C.add("win_visit", _VISITS + "SELECT * FROM visits", ("inzone",))
def win_visit(spark, d):
    return R.visits(V.observations(spark, d), V.zones(spark))


@C.add("win_time_in", _VISITS + "SELECT camera_id, track_id, zone, round(sum(seconds), 6) AS seconds FROM visits GROUP BY 1, 2, 3", ("inzone",))
def win_time_in(spark, d):
    return _r(R.time_in(R.visits(V.observations(spark, d), V.zones(spark))), "seconds")


@C.add("agg_zone_totals", _VISITS + "SELECT camera_id, zone, count(*) AS visits, round(sum(seconds), 6) AS seconds, count(DISTINCT track_id) AS tracks FROM visits GROUP BY 1, 2", ("inzone",))
def agg_zone_totals(spark, d):
    return _r(R.zone_totals(R.visits(V.observations(spark, d), V.zones(spark))), "seconds")


@C.add("agg_tracks_in_no_zone", _VISITS + "SELECT camera_id, count(*) AS tracks FROM (SELECT DISTINCT camera_id, track_id FROM observations) t WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.camera_id = t.camera_id AND v.track_id = t.track_id) GROUP BY 1", ("inzone",))
def agg_tracks_in_no_zone(spark, d):
    o = V.observations(spark, d)
    return R.tracks_in_no_zone(o, R.visits(o, V.zones(spark)))


@C.add("win_journey", _VISITS + """
, p AS (SELECT camera_id, track_id, sum(s) AS path FROM (SELECT *, sqrt((x_m - lag(x_m) OVER w) ** 2 + (z_m - lag(z_m) OVER w) ** 2) AS s FROM observations WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_index)) GROUP BY 1, 2)
SELECT o.camera_id, o.track_id, min(frame_index) AS frame_start, max(frame_index) AS frame_end, count(*) AS observed, round(median(score), 6) AS score_p50, (max(frame_index) - min(frame_index) + 1) / 5e0 AS seconds,
  round(coalesce(any_value(path), 0), 6) AS path_m, coalesce((SELECT string_agg(zone, '>' ORDER BY v.frame_start, zone) FROM visits v WHERE v.camera_id = o.camera_id AND v.track_id = o.track_id), '') AS route
FROM observations o JOIN p ON o.camera_id = p.camera_id AND o.track_id = p.track_id GROUP BY o.camera_id, o.track_id""", ("inzone",))
def win_journey(spark, d):
    j = R.journeys(V.observations(spark, d), V.zones(spark)).withColumn("route", F.array_join("route", ">")).drop("visits")
    return _r(j, "score_p50", "path_m")


@C.add("win_transitions", _VISITS + "SELECT camera_id, a AS from_zone, zone AS to_zone, count(*) AS n FROM (SELECT *, lag(zone) OVER (PARTITION BY camera_id, track_id ORDER BY frame_start, zone) AS a FROM visits) WHERE a IS NOT NULL GROUP BY 1, 2, 3", ("inzone",))
def win_transitions(spark, d):
    return R.transitions(R.journeys(V.observations(spark, d), V.zones(spark)))


_VEL = "SELECT *, (x_m - lag(x_m) OVER w) / ((frame_index - lag(frame_index) OVER w) / 5e0) AS vx, (z_m - lag(z_m) OVER w) / ((frame_index - lag(frame_index) OVER w) / 5e0) AS vz FROM observations WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_index)"


@C.add("win_velocity", f"SELECT camera_id, track_id, frame_index, round(vx, 6) AS vx, round(vz, 6) AS vz FROM ({_VEL})", ("observations",))
def win_velocity(spark, d):
    return _r(R.velocity(V.observations(spark, d)), "vx", "vz").select("camera_id", "track_id", "frame_index", "vx", "vz")


@C.add("win_world_frames", f"SELECT camera_id, 'camera_floor' AS space, frame_index, frame_index / 5e0 AS time_s, track_id, class_name AS name, x_m, z_m, round(vx, 6) AS vx, round(vz, 6) AS vz, CASE WHEN sqrt(vx * vx + vz * vz) > 0 THEN round(atan2(vx, vz), 6) END AS yaw, true AS observed, score FROM ({_VEL})", ("observations",))
def win_world_frames(spark, d):
    return _r(R.world_rows(V.observations(spark, d)), "vx", "vz", "yaw")


@C.add("agg_track_lengths", """
, s AS (SELECT camera_id, track_id, CASE WHEN frame_index - lag(frame_index) OVER w = 1 THEN sqrt(((x0 + x1) / 2 - lag((x0 + x1) / 2) OVER w) ** 2 + ((y0 + y1) / 2 - lag((y0 + y1) / 2) OVER w) ** 2) END AS d FROM observations WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_index)),
t AS (SELECT camera_id, track_id, count(*) AS n FROM s GROUP BY 1, 2)
SELECT t.camera_id, count(*) AS tracks, quantile_cont(CAST(n AS DOUBLE), 5e-1) AS median_length, max(n) AS longest, any_value(round(p50, 6)) AS speed_p50, any_value(round(p90, 6)) AS speed_p90
FROM t JOIN (SELECT camera_id, quantile_cont(d, 5e-1) AS p50, quantile_cont(d, 9e-1) AS p90 FROM s GROUP BY 1) q ON t.camera_id = q.camera_id GROUP BY 1""", ("observations",))
def agg_track_lengths(spark, d):
    return _r(R.track_lengths(V.observations(spark, d)), "speed_p50", "speed_p90")
