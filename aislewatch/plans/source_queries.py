"""Sources and sinks: rows of the derived views are written in each format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aislewatch.functions import geometry as G
from aislewatch.plans import views as V
from aislewatch.sources import cameras as K
from aislewatch.sources import logs as S

C = V.Catalogue()
_r = lambda df, *cols, n=4: df.withColumns({c: F.round(c, n) for c in cols})


def _folder(spark, name: str) -> str:
    return f"{V.shared_dir(spark)}/aislewatch/{name}-{uuid.uuid4().hex}"


# --- camera files: one for each supplier, some of them wrong in one way or several

_KINDS = ["walkable", "entrance_line", "till", "display", "premium_shelf", "stockroom_door", "forbidden"]
_CAMS = """WITH c AS (SELECT s_suppkey AS k, 'cam' || s_suppkey AS camera_id, CASE WHEN s_suppkey % 13 = 0 THEN 4 ELSE 1 + s_suppkey % 3 END AS version, CASE WHEN s_suppkey % 2 = 0 THEN 1920 ELSE 960 END AS w, CASE WHEN s_suppkey % 2 = 0 THEN 1080 ELSE 540 END AS h,
  9e2 + s_nationkey AS fx, (s_suppkey % 5) * 2e2 - 4e2 AS off, (s_suppkey % 7) * 5e-1 - 5e-1 AS height_m, (s_suppkey % 9) * 2e-1 + 1e-1 AS pitch, (s_suppkey % 6) * 4e-1 - 1e0 AS k1 FROM supplier),
y AS (SELECT k, camera_id, 'z' || j AS name, CASE WHEN k % 11 = 0 AND j = 0 THEN 'shelf' ELSE ['walkable', 'entrance_line', 'till', 'display', 'premium_shelf', 'stockroom_door', 'forbidden'][(k + j * 3) % 7 + 1] END AS kind, j FROM c, (SELECT unnest([0, 1, 2]) AS j)),
z AS (SELECT *, CASE WHEN kind = 'entrance_line' THEN 2 ELSE 3 END + (k + j) % 2 - CASE WHEN k % 7 = 3 AND kind <> 'entrance_line' THEN 1 ELSE 0 END AS n FROM y),
p AS (SELECT camera_id, 'schema_version' AS problem FROM c WHERE version > 3 UNION ALL SELECT camera_id, 'height_m' FROM c WHERE height_m <= 0 UNION ALL SELECT camera_id, 'pitch' FROM c WHERE pitch >= pi() / 2
  UNION ALL SELECT DISTINCT camera_id, 'zone kind' FROM z WHERE kind = 'shelf' UNION ALL SELECT DISTINCT camera_id, 'zone points' FROM z WHERE n < CASE WHEN kind = 'entrance_line' THEN 2 ELSE 3 END
  UNION ALL SELECT camera_id, 'principal point' FROM c WHERE w / 2e0 + off < w / 4e0 OR w / 2e0 + off > w * 3 / 4e0 UNION ALL SELECT camera_id, 'lens k1' FROM c WHERE k % 3 = 0 AND (k1 <= -1 OR k1 >= 1)
  UNION ALL SELECT camera_id, 'shelf_rois_px' FROM c WHERE k % 10 = 0 UNION ALL SELECT camera_id, 'mask_ignore' FROM c WHERE k % 50 = 0),
ok AS (SELECT * FROM c WHERE camera_id NOT IN (SELECT camera_id FROM p)),
pt AS (SELECT camera_id, name, kind, i, (i % 2) * 4e0 - 2e0 + j AS x, (i // 2) * 4e0 + 1e0 AS y FROM z, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE i < n)
"""


def camera_rows(spark, d):
    """Rows in the layout of camera files."""
    k = F.col("s_suppkey")
    w, h = F.when(k % 2 == 0, 1920).otherwise(960), F.when(k % 2 == 0, 1080).otherwise(540)
    corner = lambda j, i: F.array(F.lit((i % 2) * 4.0 - 2.0 + j), F.lit((i // 2) * 4.0 + 1.0))
    kind = lambda j: F.when((k % 11 == 0) & F.lit(j == 0), "shelf").otherwise(F.element_at(F.array(*map(F.lit, _KINDS)), ((k + j * 3) % 7 + 1).cast("int")))
    points = lambda j: F.when(kind(j) == "entrance_line", 2 + (k + j) % 2).otherwise(3 + (k + j) % 2 - F.when(k % 7 == 3, 1).otherwise(0)).cast("int")
    zone = lambda j: F.struct(F.lit(f"z{j}").alias("name"), kind(j).alias("kind"), F.slice(F.array(*[corner(j, i) for i in range(4)]), F.lit(1), points(j)).alias("points_m"))
    lens = F.struct(((k % 6) * 0.4 - 1.0).alias("k1"), F.array(w / 2, h / 2).alias("centre_px"), (F.hypot(w, h) / 2).alias("radius_px"))
    square = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((100.0, 100.0), (500.0, 100.0), (500.0, 300.0), (100.0, 300.0))])
    return V.table(spark, d, "supplier").select(
        F.when(k % 13 == 0, 4).otherwise(1 + k % 3).cast("int").alias("schema_version"), F.concat(F.lit("cam"), k.cast("string")).alias("camera_id"), F.array(w, h).alias("image_size_px"),
        F.struct((900.0 + F.col("s_nationkey")).alias("fx"), (900.0 + F.col("s_nationkey")).alias("fy"), (w / 2 + (k % 5) * 200.0 - 400.0).alias("cx"), (h / 2).alias("cy")).alias("camera"),
        F.struct(((k % 7) * 0.5 - 0.5).alias("height_m"), ((k % 9) * 0.2 + 0.1).alias("pitch"), F.lit(0.0).alias("roll")).alias("plane"),
        F.when(k % 3 == 0, lens).alias("lens"), F.array(*map(zone, range(3))).alias("zones"),
        F.array(F.array(F.lit(0.0), F.lit(0.0), F.when(k % 10 == 0, 5000.0).otherwise(100.0), F.lit(50.0))).alias("shelf_rois_px"),
        F.array(square).alias("false_positive_polygons_px"), F.when(k % 50 == 0, 0).otherwise(255).cast("int").alias("mask_ignore"))


def _cameras(spark, d):
    """The camera rows after a round trip through JSON; versions as they were."""
    path = _folder(spark, "cameras")
    camera_rows(spark, d).write.json(path)
    return K.read_cameras(spark, path, lines=True)


@C.add("src_camera_json", _CAMS + "SELECT camera_id, version AS schema_version, w AS width, h AS height, fx, round(pitch, 6) AS pitch, 3 AS zones, k % 3 = 0 AS has_lens FROM c")
def src_camera_json(spark, d):
    c = _cameras(spark, d)
    return _r(c.select("camera_id", "schema_version", F.col("image_size_px")[0].alias("width"), F.col("image_size_px")[1].alias("height"), "camera.fx", "plane.pitch", F.size("zones").alias("zones"), F.col("lens").isNotNull().alias("has_lens")), "pitch", n=6)


@C.add("sink_camera_json", _CAMS + "SELECT camera_id, 3 AS schema_version, fx, round(height_m, 6) AS height_m FROM ok")
def sink_camera_json(spark, d):
    path = _folder(spark, "written")
    K.write_cameras(K.usable(_cameras(spark, d)), path)
    return _r(K.read_cameras(spark, path, lines=True).select("camera_id", "schema_version", "camera.fx", "plane.height_m"), "height_m", n=6)


@C.add("chk_camera", _CAMS + "SELECT camera_id, problem FROM p")
def chk_camera(spark, d):
    return _cameras(spark, d).select("camera_id", F.explode("problems").alias("problem"))


@C.add("zones_from_camera", _CAMS + "SELECT ok.camera_id, name AS zone, kind, count(*) AS corners, sum(x) AS sx, sum(y) AS sz FROM ok JOIN pt ON ok.camera_id = pt.camera_id WHERE kind <> 'entrance_line' GROUP BY 1, 2, 3")
def zones_from_camera(spark, d):
    z = K.zones_of(K.usable(_cameras(spark, d)))
    total = lambda c: F.aggregate("polygon", F.lit(0.0), lambda s, p: s + p[c])
    return z.select("camera_id", "zone", "kind", F.size("polygon").cast("long").alias("corners"), total("x").alias("sx"), total("z").alias("sz"))


@C.add("counting_lines", _CAMS + "SELECT camera_id, name AS line, j - 2e0 AS ax, 1e0 AS az, j + 2e0 AS bx, 1e0 AS bz FROM z WHERE kind = 'entrance_line' AND n = 2")
def counting_lines(spark, d):
    c = _cameras(spark, d).withColumn("zones", F.filter("zones", lambda z: F.size(z["points_m"]) == 2))
    return K.lines_of(c)


@C.add("walkable_bounds", _CAMS + """, w AS (SELECT camera_id, min(x) - 2 AS a, max(x) + 2 AS b, greatest(min(y) - 2, 0) AS c, max(y) + 2 AS d FROM pt WHERE kind = 'walkable' GROUP BY 1)
SELECT ok.camera_id, coalesce(a, -12e0) AS x_lo, coalesce(b, 12e0) AS x_hi, coalesce(c, 0e0) AS z_lo, coalesce(d, 14e0) AS z_hi FROM ok LEFT JOIN w ON ok.camera_id = w.camera_id""")
def walkable_bounds(spark, d):
    return K.walkable_bounds(K.usable(_cameras(spark, d)))


def _points(spark, d):
    """A pixel and a floor point for each camera and each of 40 numbers."""
    n = F.explode(F.sequence(F.lit(0), F.lit(39))).alias("n")
    k = F.col("s_suppkey")
    p = V.table(spark, d, "supplier").select(k, F.concat(F.lit("cam"), k.cast("string")).alias("camera_id"), n)
    return p.select("camera_id", "n", ((F.col("n") * 37 + k) % 960 + 0.5).alias("u"), ((F.col("n") * 53 + k) % 540 + 0.5).alias("v"), ((F.col("n") * 13 + k) % 80 / 10.0 - 4.05).alias("x_m"), ((F.col("n") * 7 + k) % 60 / 10.0 + 0.05).alias("z_m"))


_PTS = ", q AS (SELECT 'cam' || s_suppkey AS camera_id, n, (n * 37 + s_suppkey) % 960 + 5e-1 AS u, (n * 53 + s_suppkey) % 540 + 5e-1 AS v, (n * 13 + s_suppkey) % 80 / 1e1 - 405e-2 AS x_m, (n * 7 + s_suppkey) % 60 / 1e1 + 5e-2 AS z_m FROM supplier, (SELECT unnest(range(40)) AS n))"


@C.add("in_walkable", _CAMS + _PTS + """, w AS (SELECT camera_id, j, n AS corners FROM z WHERE kind = 'walkable'),
e AS (SELECT camera_id, name, i, x AS ax, y AS ay, coalesce(lead(x) OVER o, first_value(x) OVER o) AS bx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS by_ FROM pt WHERE kind = 'walkable' WINDOW o AS (PARTITION BY camera_id, name ORDER BY i)),
x AS (SELECT q.camera_id, q.n, e.name, count(*) FILTER ((ay > z_m) <> (by_ > z_m) AND x_m < (bx - ax) * (z_m - ay) / (by_ - ay) + ax) % 2 = 1 AS inside FROM q JOIN e ON q.camera_id = e.camera_id GROUP BY 1, 2, 3)
SELECT q.camera_id, q.n, coalesce(bool_or(inside), false) AS walkable FROM q LEFT JOIN x ON q.camera_id = x.camera_id AND q.n = x.n WHERE q.camera_id IN (SELECT camera_id FROM ok) GROUP BY 1, 2""")
def in_walkable(spark, d):
    c = K.usable(_cameras(spark, d))
    return K.in_walkable(_points(spark, d).join(c.select("camera_id"), "camera_id", "left_semi"), c).select("camera_id", "n", "walkable")


@C.add("in_fp_zone", _CAMS + _PTS + "SELECT camera_id, n, u BETWEEN 100 AND 500 AND v BETWEEN 100 AND 300 AS vetoed FROM q")
def in_fp_zone(spark, d):
    return K.in_fp_zone(_points(spark, d), _cameras(spark, d)).select("camera_id", "n", "vetoed")


_LENS = """, g0 AS (SELECT q.camera_id, q.n, fx, w / 2e0 + off AS cx, h / 2e0 AS cy, height_m, pitch, CASE WHEN k % 3 = 0 THEN 1 + k1 * ((u - w / 2e0) ** 2 + (v - h / 2e0) ** 2) / ((w * w + h * h) / 4e0) ELSE 1 END AS s, u, v, w, h FROM q JOIN ok ON q.camera_id = ok.camera_id),
g1 AS (SELECT *, (w / 2e0 + (u - w / 2e0) / s - cx) / fx AS rx, (h / 2e0 + (v - h / 2e0) / s - cy) / fx AS ry FROM g0), g2 AS (SELECT *, cos(pitch) * ry + sin(pitch) AS dy, cos(pitch) - sin(pitch) * ry AS dz FROM g1)"""


@C.add("ground_points", _CAMS + _PTS + _LENS + " SELECT camera_id, n, round(rx * height_m / dy, 4) AS x_m, round(dz * height_m / dy, 4) AS z_m FROM g2 WHERE dy > 1e-9")
def ground_points(spark, d):
    return _r(K.ground_points(_points(spark, d).drop("x_m", "z_m"), _cameras(spark, d), "drop").select("camera_id", "n", "x_m", "z_m"), "x_m", "z_m")


@C.add("to_calibrated_px", _CAMS + _PTS + """, f AS (SELECT q.camera_id, q.n, u * 3 AS u, v * 3 AS v, w, h FROM q JOIN c ON q.camera_id = c.camera_id), b AS (SELECT DISTINCT camera_id FROM f WHERE u > 15e-1 * w OR v > 15e-1 * h)
SELECT 'scaled' AS kind, camera_id, n, round(u * w / 2880, 4) AS u, round(v * h / 1620, 4) AS v FROM f UNION ALL SELECT 'taken', camera_id, n, round(u, 4), round(v, 4) FROM f WHERE camera_id NOT IN (SELECT camera_id FROM b) UNION ALL SELECT 'refused', camera_id, n, round(u, 4), round(v, 4) FROM f WHERE camera_id IN (SELECT camera_id FROM b)""")
def to_calibrated_px(spark, d):
    p, c = _points(spark, d).select("camera_id", "n", (F.col("u") * 3).alias("u"), (F.col("v") * 3).alias("v")), _cameras(spark, d)
    scaled, _ = K.to_calibrated(p, c, (2880, 1620))
    taken, refused = K.to_calibrated(p, c)
    out = [x.select(F.lit(k).alias("kind"), "camera_id", "n", "u", "v") for k, x in (("scaled", scaled), ("taken", taken), ("refused", refused))]
    return _r(out[0].unionByName(out[1]).unionByName(out[2]), "u", "v")


_BOXES = """, b AS (SELECT camera_id, track_id, frame_index, x0, y0, x1, y1, 9e2 AS f, 64e1 AS cx, 36e1 AS cy, 25e-1 AS hm, cos(6e-1) AS cp, sin(6e-1) AS sp FROM observations),
r AS (SELECT *, hm / (cp * (y1 - cy) / f + sp) AS t, cp * (y1 - cy) / f + sp AS dy, cp - sp * (y1 - cy) / f AS dz, cp * (y0 - cy) / f + sp AS ty, cp - sp * (y0 - cy) / f AS tz FROM b)"""


@C.add("place_boxes", _BOXES + " SELECT camera_id, track_id, frame_index, CASE WHEN dy > 1e-9 THEN round(((x0 + x1) / 2 - cx) / f * t, 4) END AS x_m, CASE WHEN dy > 1e-9 THEN round(dz * t, 4) END AS z_m FROM r", ("observations",))
def place_boxes(spark, d):
    from aislewatch.plans.scalar_queries import _cam

    o = V.observations(spark, d).drop("x_m", "z_m")
    p = K.floor_positions(o, o.select("camera_id").distinct().withColumn("camera", _cam()))
    return _r(p.select("camera_id", "track_id", "frame_index", "x_m", "z_m"), "x_m", "z_m")


@C.add("box_extents", _BOXES + " SELECT camera_id, track_id, frame_index, CASE WHEN dy > 1e-9 THEN round((x1 - x0) / f * t, 4) END AS width_m, CASE WHEN dy > 1e-9 AND hm - dz * t / tz * ty > 0 THEN round(hm - dz * t / tz * ty, 4) END AS height_m FROM r", ("observations",))
def box_extents(spark, d):
    from aislewatch.plans.scalar_queries import _cam

    o = V.observations(spark, d)
    e = K.box_extents(o, o.select("camera_id").distinct().withColumn("camera", _cam()))
    return _r(e.select("camera_id", "track_id", "frame_index", "width_m", "height_m"), "width_m", "height_m")


@C.add("pose_gate", _CAMS + """, g AS (SELECT camera_id, h / 2e0 - fx * tan(pitch) AS row, h FROM c WHERE pitch < pi() / 2)
SELECT camera_id, round(row, 3) AS horizon_row, CASE WHEN row >= h THEN 'horizon below the picture' WHEN row >= 0 THEN 'horizon in the picture' END AS reason FROM g""")
def pose_gate(spark, d):
    c = _cameras(spark, d).where(F.col("plane.pitch") < 1.5707963267948966)
    row = G.horizon_row(F.col("camera.fy"), F.col("camera.cy"), F.col("plane.pitch"))
    return _r(c.select("camera_id", row.alias("horizon_row"), G.pose_refusal(row, F.col("image_size_px")[1]).alias("reason")), "horizon_row", n=3)


# --- annotations, tracks, logs, metrics, manifests, thresholds

_COCO_BOX = "round(x0, 3) AS x, round(y0, 3) AS y, round(x1 - x0, 3) AS w, round(y1 - y0, 3) AS h"


def _coco(spark, d):
    o = V.observations(spark, d)
    k = F.when(F.col("class_name") == "person", 1).when(F.col("class_name") == "bag", 2).otherwise(3)
    boxes = o.select(F.concat_ws("__", F.col("camera_id").cast("string"), F.lpad(F.col("frame_index").cast("string"), 6, "0")).alias("file_name"), k.alias("category_id"), "x0", "y0", "x1", "y1")
    categories = spark.createDataFrame([(1, "person"), (2, "bag"), (3, "boxed_stock")], "id long, name string")
    path = _folder(spark, "coco")
    S.write_coco(boxes, categories, path)
    return S.read_coco(spark, path, lines=True)


_FILES = ", i AS (SELECT *, camera_id || '__' || lpad(CAST(frame_index AS VARCHAR), 6, '0') AS file_name FROM observations)"


@C.add("src_coco", _FILES + f" SELECT file_name, class_name AS category, {_COCO_BOX} FROM i", ("observations",))
def src_coco(spark, d):
    _, ann, _ = _coco(spark, d)
    b = F.col("bbox")
    return _r(ann.select("file_name", "category", b[0].alias("x"), b[1].alias("y"), b[2].alias("w"), b[3].alias("h")), "x", "y", "w", "h", n=3)


@C.add("sink_coco", _FILES + " SELECT file_name, row_number() OVER (ORDER BY file_name) AS image_id, n AS annotations, CAST(1 + coalesce(sum(n) OVER (ORDER BY file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_annotation FROM (SELECT file_name, count(*) AS n FROM i GROUP BY 1)", ("observations",))
def sink_coco(spark, d):
    images, ann, _ = _coco(spark, d)
    n = ann.groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("annotations"), F.min("id").alias("first_annotation"))
    return images.join(n, "id").select("file_name", F.col("id").alias("image_id"), "annotations", "first_annotation")


def _track_folder(spark, d):
    path = _folder(spark, "tracks")
    S.write_tracks(V.observations(spark, d), path)
    return path


@C.add("src_tracks_json", "SELECT CAST(camera_id AS VARCHAR) AS camera_id, track_id, frame_index, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM observations", ("observations",))
def src_tracks_json(spark, d):
    return _r(S.read_tracks(spark, _track_folder(spark, d)), "x0", "y0", "x1", "y1")


@C.add("sink_tracks_json", "SELECT CAST(camera_id AS VARCHAR) AS camera, count(DISTINCT track_id) AS files, count(*) AS boxes FROM observations GROUP BY 1", ("observations",))
def sink_tracks_json(spark, d):
    raw = spark.read.text(_track_folder(spark, d))
    m = F.from_json("value", "MAP<STRING, MAP<STRING, ARRAY<DOUBLE>>>")
    one = raw.select("camera", F.explode(m).alias("t", "f")).groupBy("camera").agg(F.countDistinct("t").alias("files"), F.sum(F.size("f")).alias("boxes"))
    return one.select(F.col("camera").cast("string").alias("camera"), "files", "boxes")


_LOG = """WITH l AS (SELECT event_id AS id, ts, CASE event_id % 10 WHEN 7 THEN 'corrupt' WHEN 8 THEN 'newer schema' WHEN 9 THEN 'unknown kind' WHEN 6 THEN 'missing field' END AS reason, CASE WHEN event_type = 'purchase' THEN 'alert' ELSE 'disposition' END AS kind, user_id FROM events)
"""


def _log_lines(spark, d):
    """Alerts and verdicts as JSON lines; every tenth is broken, too new, of an unknown kind or without a time."""
    e, i = V.table(spark, d, "events"), F.col("event_id") % 10
    row = F.struct(F.when(i == 8, 99).otherwise(1).alias("schema_version"), F.when(i == 9, "note").when(F.col("event_type") == "purchase", "alert").otherwise("disposition").alias("kind"), F.col("user_id").cast("string").alias("alert_id"), F.lit("confirmed").alias("status"),
                   F.when(i != 6, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"), F.col("event_id").cast("string").alias("note"))
    line = F.when(i == 7, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(row))
    path = _folder(spark, "log")
    e.select(line.alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("day")).write.partitionBy("day").text(path)
    return path


@C.add("src_alert_log", _LOG + "SELECT kind, CAST(user_id AS VARCHAR) AS alert_id, CAST(id AS VARCHAR) AS note, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM l WHERE reason IS NULL")
def src_alert_log(spark, d):
    good, _ = S.read_alert_log(spark, _log_lines(spark, d))
    return good.select("kind", "alert_id", "note", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@C.add("parse_log_row", _LOG + "SELECT coalesce(CASE reason WHEN 'corrupt' THEN 'not JSON' ELSE reason END, 'good') AS reason, count(*) AS n FROM l GROUP BY 1")
def parse_log_row(spark, d):
    good, bad = S.read_alert_log(spark, _log_lines(spark, d))
    return good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@C.add("sink_alert_log", _LOG + "SELECT strftime(ts, '%Y-%m-%d') AS utc_date, kind, count(*) AS n FROM l WHERE reason IS NULL GROUP BY 1, 2")
def sink_alert_log(spark, d):
    good, _ = S.read_alert_log(spark, _log_lines(spark, d))
    path = _folder(spark, "appended")
    S.append_alert_log(good.drop("file").where("kind = 'alert'"), path)
    S.append_alert_log(good.drop("file").where("kind <> 'alert'"), path)
    return spark.read.json(path).groupBy(F.col("utc_date").cast("string").alias("utc_date"), "kind").agg(F.count("*").alias("n"))


@C.add("src_metrics_jsonl", "SELECT 'run' || o_custkey % 12 AS run, o_orderkey AS epoch, m.metric AS metric, m.value AS value FROM (SELECT *, unnest([struct_pack(metric := 'loss', value := CAST(o_totalprice AS DOUBLE)), struct_pack(metric := 'seen', value := CAST(o_custkey AS DOUBLE))]) AS m FROM orders)")
def src_metrics_jsonl(spark, d):
    o = V.table(spark, d, "orders")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").cast("double").alias("loss"), F.col("o_custkey").alias("seen"), F.col("o_orderstatus").alias("state")))
    path = _folder(spark, "runs")
    o.select(line.alias("value"), F.concat(F.lit("run"), (F.col("o_custkey") % 12).cast("string")).alias("run")).write.partitionBy("run").text(path)
    return S.read_metrics(spark, path).select("run", "epoch", "metric", "value")


@C.add("src_clip_manifest", "SELECT DISTINCT 'cam' || c_nationkey AS camera, 'clip' || c_custkey || '.mp4' AS clip FROM customer")
def src_clip_manifest(spark, d):
    c = V.table(spark, d, "customer")
    clip = F.struct(F.concat(F.lit("store/"), F.col("c_nationkey").cast("string"), F.lit("/clip"), F.col("c_custkey").cast("string"), F.lit(".mp4")).alias("uri"))
    per = c.groupBy(F.concat(F.lit("cam"), F.col("c_nationkey").cast("string")).alias("camera"), F.floor(F.col("c_custkey") / 1000).alias("file")).agg(F.collect_list(clip).alias("clips"))
    path = _folder(spark, "manifest")
    per.select(F.array(F.struct("camera", "clips")).alias("pulled")).write.json(path)
    return S.read_clip_manifest(spark, path, lines=True)


@C.add("src_attr_parquet", "SELECT doc_id AS key, quality, toxic FROM labels")
def src_attr_parquet(spark, d):
    path = _folder(spark, "attributes")
    V.table(spark, d, "labels").select(F.col("doc_id").alias("key"), "quality", "toxic", F.lit("picture").cast("binary").alias("image")).write.parquet(path)
    return S.read_attributes(spark, path, "quality", "toxic")


@C.add("src_labels_scene_csv", "SELECT 'img' || p_partkey AS image, 'scene' || p_size % 5 AS scene FROM part")
def src_labels_scene_csv(spark, d):
    path = _folder(spark, "scenes")
    V.table(spark, d, "part").select(F.concat(F.lit("img"), F.col("p_partkey").cast("string"), F.lit(" scene"), (F.col("p_size") % 5).cast("string"))).write.text(path)
    return S.read_scene_labels(spark, path)


@C.add("src_thresholds", "SELECT 'cam' || s_suppkey AS camera_id, x.c AS class_name, x.b AS birth, x.b / 2 AS keep, CASE WHEN s_suppkey % 2 = 0 THEN 'measured' END AS basis FROM (SELECT *, unnest([struct_pack(c := 'person', b := 35e-2 + s_nationkey / 1e2), struct_pack(c := 'bag', b := 5e-1)]) AS x FROM supplier)")
def src_thresholds(spark, d):
    s = V.table(spark, d, "supplier")
    entry = lambda b: F.struct(b.alias("birth"), (b / 2).alias("keep"), F.when(F.col("s_suppkey") % 2 == 0, "measured").alias("basis"))
    book = F.create_map(F.concat(F.lit("cam"), F.col("s_suppkey").cast("string")), F.create_map(F.lit("person"), entry(0.35 + F.col("s_nationkey") / 100.0), F.lit("bag"), entry(F.lit(0.5))))
    path = _folder(spark, "thresholds")
    s.select(F.to_json(book)).write.text(path)
    return S.read_thresholds(spark, path)


@C.add("agg_metrics_flatten", "SELECT o_orderkey AS run, x.k AS key, x.v AS value FROM (SELECT *, unnest([struct_pack(k := 'model.depth', v := CAST(o_custkey % 5 AS VARCHAR)), struct_pack(k := 'model.name', v := o_orderpriority), struct_pack(k := 'seed', v := CAST(o_custkey AS VARCHAR))]) AS x FROM orders)")
def agg_metrics_flatten(spark, d):
    o = V.table(spark, d, "orders")
    model = F.struct((F.col("o_custkey") % 5).alias("depth"), F.col("o_orderpriority").alias("name"))
    return S.flatten_params(o.select(F.col("o_orderkey").alias("run"), F.to_json(F.struct(model.alias("model"), F.col("o_custkey").alias("seed"))).alias("json")))


@C.add("src_skeletons", """WITH s AS (SELECT c_custkey AS k, f, b, j FROM customer, (SELECT unnest(range(3)) AS f), (SELECT unnest(range(2)) AS b), (SELECT unnest(range(4)) AS j) WHERE b < 1 + c_custkey % 2)
SELECT 'S' || k AS clip, f AS frame, b AS body, j AS joint, round(k % 7 + j / 4e0, 4) AS x, round(f + b / 2e0, 4) AS y, round(k % 3 + 1e0, 4) AS z FROM s""")
def src_skeletons(spark, d):
    k = F.col("c_custkey")
    joint = lambda f, b, j: F.concat_ws(" ", (k % 7 + j / 4.0).cast("string"), F.lit(str(f + b / 2.0)), (k % 3 + 1.0).cast("string"), F.lit("0 0"))
    body = lambda f, b: [F.lit("id 0 0"), F.lit("4"), *[joint(f, b, j) for j in range(4)]]
    frame = lambda f, n: [F.lit(str(n)), *[x for b in range(n) for x in body(f, b)]]
    text = lambda n: F.concat_ws("\n", F.lit("3"), *[x for f in range(3) for x in frame(f, n)])
    path = _folder(spark, "skeletons")
    files = V.table(spark, d, "customer").select(F.concat(F.lit("S"), k.cast("string")).alias("clip"), F.when(k % 2 == 0, text(1)).otherwise(text(2)).alias("text"))
    files.write.parquet(path)  # packed: small text files by the thousand would only measure the file system
    return _r(S.parse_skeletons(spark.read.parquet(path)), "x", "y", "z")
