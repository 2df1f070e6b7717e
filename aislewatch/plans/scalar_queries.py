"""Geometry, boxes, labels and names over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewatch.functions import boxes as B
from aislewatch.functions import geometry as G
from aislewatch.functions import labels as L
from aislewatch.operators.ordering import nearest_item
from aislewatch.plans import views as V

C = V.Catalogue()
_r = lambda df, *cols, n=4: df.withColumns({c: F.round(c, n) for c in cols})

CAMERA = {"fx": 900.0, "fy": 900.0, "cx": 640.0, "cy": 360.0, "height": 2.5, "pitch": 0.6, "roll": 0.0}
_P = """, p AS (SELECT camera_id, track_id, frame_index, x_m, z_m, y0, (x0 + x1) / 2 AS u, y1 AS v FROM observations)"""


def _cam():
    return F.struct(*[F.lit(v).alias(k) for k, v in CAMERA.items()])


@C.add("pixel_to_ground", _P + """, r AS (SELECT *, (u - 64e1) / 9e2 AS rx, (v - 36e1) / 9e2 AS ry FROM p), t AS (SELECT *, cos(6e-1) * ry + sin(6e-1) AS dy, cos(6e-1) - sin(6e-1) * ry AS dz FROM r)
SELECT camera_id, track_id, frame_index, round(CASE WHEN dy > 1e-9 THEN rx * (25e-1 / dy) END, 4) AS x, round(CASE WHEN dy > 1e-9 THEN dz * (25e-1 / dy) END, 4) AS z FROM t""", ("observations",))
def pixel_to_ground(spark, d):
    o = V.observations(spark, d)
    g = G.pixel_to_ground(*B.foot(B.box()), _cam())
    return _r(o.select("camera_id", "track_id", "frame_index", g.alias("g")).select("camera_id", "track_id", "frame_index", "g.x", "g.z"), "x", "z")


@C.add("track_ground_path", _P + """, r AS (SELECT *, (u - 64e1) / 9e2 AS rx, (v - 36e1) / 9e2 AS ry FROM p), t AS (SELECT *, cos(6e-1) * ry + sin(6e-1) AS dy, cos(6e-1) - sin(6e-1) * ry AS dz FROM r)
SELECT camera_id, track_id, count(*) AS n, round(sum(rx * (25e-1 / dy)), 3) AS sx, round(sum(dz * (25e-1 / dy)), 3) AS sz FROM t WHERE dy > 1e-9 GROUP BY 1, 2""", ("observations",))
def track_ground_path(spark, d):
    from aislewatch.sources.cameras import floor_positions

    o = V.observations(spark, d)
    cams = o.select("camera_id").distinct().withColumn("camera", _cam())
    p = floor_positions(o.drop("x_m", "z_m"), cams).where("x_m IS NOT NULL")
    return _r(p.groupBy("camera_id", "track_id").agg(F.count("*").alias("n"), F.sum("x_m").alias("sx"), F.sum("z_m").alias("sz")), "sx", "sz", n=3)


@C.add("ground_to_pixel", """
SELECT camera_id, track_id, frame_index, round(9e2 * x_m / (sin(6e-1) * 25e-1 + cos(6e-1) * z_m) + 64e1, 3) AS u, round(9e2 * (cos(6e-1) * 25e-1 - sin(6e-1) * z_m) / (sin(6e-1) * 25e-1 + cos(6e-1) * z_m) + 36e1, 3) AS v, round(sin(6e-1) * 25e-1 + cos(6e-1) * z_m, 4) AS depth FROM observations""", ("observations",))
def ground_to_pixel(spark, d):
    o = V.observations(spark, d).withColumn("g", G.ground_to_pixel(F.col("x_m"), F.col("z_m"), _cam()))
    return _r(_r(o.select("camera_id", "track_id", "frame_index", "g.u", "g.v", "g.depth"), "u", "v", n=3), "depth")


@C.add("height_above_floor", """
, t AS (SELECT *, (y0 - 36e1) / 9e2 AS t FROM observations) SELECT camera_id, track_id, frame_index, round(25e-1 - z_m * (t * cos(6e-1) + sin(6e-1)) / (cos(6e-1) - t * sin(6e-1)), 4) AS h FROM t""", ("observations",))
def height_above_floor(spark, d):
    o = V.observations(spark, d)
    return _r(o.select("camera_id", "track_id", "frame_index", G.height_above_floor(F.col("y0"), F.col("x_m"), F.col("z_m"), _cam()).alias("h")), "h")


@C.add("pixel_row_at_height", """
SELECT camera_id, track_id, frame_index, round(9e2 * (cos(6e-1) * 8e-1 - sin(6e-1) * z_m) / (sin(6e-1) * 8e-1 + cos(6e-1) * z_m) + 36e1, 3) AS row FROM observations""", ("observations",))
def pixel_row_at_height(spark, d):
    o = V.observations(spark, d)
    return _r(o.select("camera_id", "track_id", "frame_index", G.pixel_row_at_height(F.lit(1.7), F.col("x_m"), F.col("z_m"), _cam()).alias("row")), "row", n=3)


@C.add("undistort_points", """
, q AS (SELECT *, (x0 - 5e2) AS du, (y1 - 4e2) AS dv FROM observations) SELECT camera_id, track_id, frame_index, round(5e2 + du / (1 + -1e-1 * (du * du + dv * dv) / 36e4), 4) AS u, round(4e2 + dv / (1 + -1e-1 * (du * du + dv * dv) / 36e4), 4) AS v FROM q""", ("observations",))
def undistort_points(spark, d):
    o = V.observations(spark, d).withColumn("g", G.undistort(F.col("x0"), F.col("y1"), F.lit(-0.1), F.lit(500.0), F.lit(400.0), F.lit(600.0)))
    return _r(o.select("camera_id", "track_id", "frame_index", "g.u", "g.v"), "u", "v")


@C.add("distort_points", "SELECT camera_id, track_id, frame_index, round(x0, 3) AS u, round(y1, 3) AS v FROM observations", ("observations",))
def distort_points(spark, d):
    args = (F.lit(-0.1), F.lit(500.0), F.lit(400.0), F.lit(600.0))
    o = V.observations(spark, d).withColumn("g", G.undistort(F.col("x0"), F.col("y1"), *args))
    o = o.withColumn("h", G.distort(F.col("g.u"), F.col("g.v"), *args))
    return _r(o.select("camera_id", "track_id", "frame_index", "h.u", "h.v"), "u", "v", n=3)


@C.add("undistort_equidistant", """
, q AS (SELECT *, sqrt((x0 - 5e2) ** 2 + (y1 - 4e2) ** 2) AS r FROM observations) SELECT camera_id, track_id, frame_index, round(5e2 + (x0 - 5e2) * CASE WHEN r < 1e-12 THEN 1 ELSE 6e2 * tan(r / 6e2) / r END, 3) AS u, round(4e2 + (y1 - 4e2) * CASE WHEN r < 1e-12 THEN 1 ELSE 6e2 * tan(r / 6e2) / r END, 3) AS v FROM q""", ("observations",))
def undistort_equidistant(spark, d):
    o = V.observations(spark, d).withColumn("g", G.undistort_equidistant(F.col("x0"), F.col("y1"), F.lit(600.0), F.lit(500.0), F.lit(400.0)))
    return _r(o.select("camera_id", "track_id", "frame_index", "g.u", "g.v"), "u", "v", n=3)


@C.add("distort_equidistant", """
, q AS (SELECT *, sqrt((x0 - 5e2) ** 2 + (y1 - 4e2) ** 2) AS r FROM observations) SELECT camera_id, track_id, frame_index, round(5e2 + (x0 - 5e2) * CASE WHEN r < 1e-12 THEN 1 ELSE 6e2 * atan(r / 6e2) / r END, 3) AS u, round(4e2 + (y1 - 4e2) * CASE WHEN r < 1e-12 THEN 1 ELSE 6e2 * atan(r / 6e2) / r END, 3) AS v FROM q""", ("observations",))
def distort_equidistant(spark, d):
    o = V.observations(spark, d).withColumn("g", G.distort_equidistant(F.col("x0"), F.col("y1"), F.lit(600.0), F.lit(500.0), F.lit(400.0)))
    return _r(o.select("camera_id", "track_id", "frame_index", "g.u", "g.v"), "u", "v", n=3)


@C.add("camera_from_vfov", "SELECT c_custkey AS k, round(54e1 / tan(radians(30 + c_custkey % 40) / 2), 4) AS fx, round(54e1 / tan(radians(30 + c_custkey % 40) / 2) / 2, 4) AS half FROM customer")
def camera_from_vfov(spark, d):
    c = V.table(spark, d, "customer")
    cam = G.camera_from_vfov((F.col("c_custkey") % 40 + 30).cast("double"), F.lit(1920.0), F.lit(1080.0))
    c = c.select(F.col("c_custkey").alias("k"), cam.alias("cam")).withColumn("s", G.scaled_camera(F.col("cam"), F.lit(0.5), F.lit(0.5)))
    return _r(c.select("k", F.col("cam.fx").alias("fx"), F.col("s.fx").alias("half")), "fx", "half")


@C.add("foot_point", "SELECT camera_id, track_id, frame_index, round((x0 + x1) / 2, 6) AS u, round(y1, 6) AS v FROM observations", ("observations",))
def foot_point(spark, d):
    u, v = B.foot(B.box())
    return V.observations(spark, d).select("camera_id", "track_id", "frame_index", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@C.add("box_iou", "SELECT camera_id, frame_index, gt_id, pred_id, round(iou, 6) AS iou FROM pairs", ("pairs",))
def box_iou(spark, d):
    from aislewatch.operators.metrics import matched_boxes

    return matched_boxes(V.truth_boxes(spark, d), V.pred_boxes(spark, d), 0.0).select("camera_id", "frame_index", "gt_id", "pred_id", F.round("iou", 6).alias("iou"))


@C.add("cwh_xyxy", "SELECT camera_id, track_id, frame_index, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h, round(x0, 6) AS x0 FROM observations", ("observations",))
def cwh_xyxy(spark, d):
    c = B.centre_form(B.box())
    o = V.observations(spark, d).select("camera_id", "track_id", "frame_index", *[x.alias(n) for x, n in zip(c, ("cx", "cy", "w", "h"), strict=True)])
    return _r(o.withColumn("x0", B.corner_form(*[F.col(n) for n in ("cx", "cy", "w", "h")])[0]), "cx", "cy", "w", "h", "x0", n=6)


@C.add("invert_geom", "SELECT camera_id, track_id, frame_index, round((x0 - 12e0) / 5e-1, 6) AS x0, round((y1 - 8e0) / 5e-1, 6) AS y1 FROM observations", ("observations",))
def invert_geom(spark, d):
    b = B.from_letterbox(B.box(), F.lit(0.5), F.lit(12.0), F.lit(8.0))
    return V.observations(spark, d).select("camera_id", "track_id", "frame_index", F.round(b[0], 6).alias("x0"), F.round(b[3], 6).alias("y1"))


@C.add("usable_crops", "SELECT camera_id, track_id, frame_index FROM observations WHERE x0 > 3 AND y0 > 3 AND x1 < 877 AND y1 < 677 AND y1 - y0 >= 64", ("observations",))
def usable_crops(spark, d):
    return V.observations(spark, d).where(B.usable_crop(B.box(), F.lit(880), F.lit(680))).select("camera_id", "track_id", "frame_index")


@C.add("border_contact", "SELECT camera_id, track_id, bool_or(x0 <= 3 OR y0 <= 3 OR x1 >= 877 OR y1 >= 677) AS touches, round(median(y1), 6) AS y1_p50 FROM observations GROUP BY 1, 2", ("observations",))
def border_contact(spark, d):
    free = B.usable_crop(B.box(), F.lit(880), F.lit(680), least_height=0.0)
    return V.observations(spark, d).groupBy("camera_id", "track_id").agg(F.bool_or(~free).alias("touches"), F.round(F.median("y1"), 6).alias("y1_p50"))


@C.add("segments_cross", "SELECT camera_id, track_id, frame_end AS frame_index FROM crossings", ("crossings",))
def segments_cross(spark, d):
    from aislewatch.operators.events import line_crossings

    return line_crossings(V.observations(spark, d), V.lines(spark)).select("camera_id", "track_id", F.col("frame_end").alias("frame_index"))


@C.add("cross2_side", "SELECT camera_id, track_id, frame_index, CAST(sign(-x_m * 6e0) AS DOUBLE) AS side FROM observations", ("observations",))
def cross2_side(spark, d):
    s = G.side(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(7.0), F.col("x_m"), F.col("z_m"))
    return V.observations(spark, d).select("camera_id", "track_id", "frame_index", (s + F.lit(0.0)).alias("side"))


@C.add("polygon_area", "SELECT o_orderkey AS k, CAST((2 + o_orderkey % 7) * (1 + o_custkey % 5) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS DOUBLE) / 2 AS area FROM orders")
def polygon_area(spark, d):
    # triangles, every other one clockwise
    w, h = (F.col("o_orderkey") % 7 + 2).cast("double"), (F.col("o_custkey") % 5 + 1).cast("double")
    corner = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    zero, right, up = corner(F.lit(0.0), F.lit(0.0)), corner(w, F.lit(0.0)), corner(w / 3, h)
    p = F.when(F.col("o_orderkey") % 2 == 0, F.array(zero, right, up)).otherwise(F.array(up, right, zero))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), G.polygon_area(p).alias("area"))


@C.add("finite_or_null", "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events")
def finite_or_null(spark, d):
    e = V.table(spark, d, "events")
    v = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    return e.select("event_id", G.finite_or_null(v).alias("v"))


@C.add("label_remap", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 30 < 25 THEN l_suppkey % 30 % 5 ELSE 255 END AS class_id FROM lineitem")
def label_remap(spark, d):
    m = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("source_id"), (F.col("n_nationkey") % 5).cast("bigint").alias("class_id"))
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 30).cast("bigint").alias("source_id"))
    return L.remap_labels(rows, m).select("l_orderkey", "l_linenumber", "class_id")


@C.add("vocab_map", "SELECT c_custkey AS k, lower(c_mktsegment) AS class FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def vocab_map(spark, d):
    c = V.table(spark, d, "customer")
    aliases = c.select(F.lower("c_mktsegment").alias("alias")).distinct().where("alias IN ('building', 'machinery')").withColumn("class", F.col("alias"))
    return L.map_vocabulary(c.select(F.col("c_custkey").alias("k"), F.concat(F.lit(" "), F.upper("c_mktsegment")).alias("category")), aliases).select("k", "class")


@C.add("unsourced_classes", "SELECT p_partkey AS class_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unsourced_classes(spark, d):
    sources = V.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("class_id"))
    return L.unsourced_classes(V.table(spark, d, "part").select(F.col("p_partkey").alias("class_id")), sources)


_TH = "SELECT c AS camera_id, n AS class_name, CASE WHEN c % 3 = 0 AND n = 'person' THEN 4e-1 ELSE 5e-1 END AS birth, CASE WHEN c % 3 = 0 AND n = 'person' THEN 1e-1 ELSE 2e-1 END AS keep, CASE WHEN c % 3 = 0 AND n = 'person' THEN 'night' ELSE 'default' END AS basis FROM (SELECT DISTINCT camera_id AS c FROM detections), (VALUES ('person'), ('bag')) AS v(n)"


def _thresholds(spark, d):
    cams = V.detections(spark, d).select("camera_id").distinct()
    defaults = spark.sql("SELECT * FROM VALUES ('person', 0.5e0, 0.2e0), ('bag', 0.5e0, 0.2e0) AS t(class_name, birth, keep)")
    own = cams.where("camera_id % 3 = 0").select("camera_id", F.lit("person").alias("class_name"), F.lit(0.4).alias("birth"), F.lit(0.1).alias("keep"), F.lit("night").alias("basis"))
    return L.with_overrides(defaults, own, cams)


@C.add("for_camera", _TH, ("detections",))
def for_camera(spark, d):
    return _thresholds(spark, d)


@C.add("filter_and_scale", f", t AS ({_TH}) SELECT det_id, round(score * 35e-2 / birth, 6) AS scaled FROM detections d JOIN t ON d.camera_id = t.camera_id AND d.class_name = t.class_name WHERE score >= keep", ("detections",))
def filter_and_scale(spark, d):
    return L.filter_and_scale(V.detections(spark, d), _thresholds(spark, d)).select("det_id", F.round("scaled", 6).alias("scaled"))


@C.add("sc_filename_parse", "SELECT event_id, date_trunc('second', ts) AS started, user_id AS frame FROM events")
def sc_filename_parse(spark, d):
    e = V.table(spark, d, "events")
    name = F.concat(F.lit("a/cam1__archive_"), F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("_x__"), F.col("user_id").cast("string"), F.lit(".jpg"))
    return e.select("event_id", L.archive_start(name).cast("timestamp_ntz").alias("started"), L.frame_name(name)["frame"].alias("frame"))


@C.add("delivery_tail", """WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '/', chr(92)) ELSE url END AS url FROM pages), p AS (SELECT page_id, url, list_filter(string_split(replace(url, chr(92), '/'), '/'), lambda p: p <> '') AS parts FROM u)
SELECT page_id, CASE WHEN len(parts) > 2 AND (contains(url, '/') OR contains(url, chr(92))) THEN array_to_string(parts[-2:], '/') ELSE url END AS tail FROM p""")
def delivery_tail(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.replace(F.col("url"), F.lit("/"), F.lit("\\"))).otherwise(F.col("url"))
    return V.table(spark, d, "pages").select("page_id", L.delivery_tail(url).alias("tail"))


@C.add("nearest_clip", "SELECT c_custkey AS k, arg_min(o_orderkey, (abs(o_custkey * 10 - c_custkey * 7), o_orderkey)) AS clip FROM customer JOIN orders ON c_custkey % 25 = o_custkey % 25 GROUP BY 1")
def nearest_clip(spark, d):
    c, o = V.table(spark, d, "customer"), V.table(spark, d, "orders")
    asks = c.select((F.col("c_custkey") % 25).alias("g"), (F.col("c_custkey") * 7).alias("at"), F.col("c_custkey").alias("k"))
    holds = o.select((F.col("o_custkey") % 25).alias("g"), (F.col("o_custkey") * 10).alias("at"), F.col("o_orderkey").alias("item"))
    return nearest_item(asks.distinct(), holds, "g").select("k", F.col("item").alias("clip"))
