"""Camera tables derived from the driver's tables by integer arithmetic, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FPS = 5.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new one where it is unset and all run on this machine (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="aislewatch-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def _positions(df: DataFrame) -> DataFrame:
    u, f = F.col("track_id"), F.col("frame_index")
    x = F.abs((f * 5 * (u % 7 + 1) + u * 131) % 1600 - 800) / 1e2 - 4e0
    z = F.abs((f * 3 * (u % 5 + 1) + u * 57) % 1200 - 600) / 1e2 + 1e0
    df = df.withColumns({"camera_id": u % 8, "class_name": F.when(u % 10 == 0, "bag").when(u % 10 == 1, "boxed_stock").otherwise("person"), "score": ((F.col("e") * 31) % 100) / 1e2, "x_m": x, "z_m": z})
    return df.withColumns({"x0": (F.col("x_m") + 5e0) * 1e2 - 2e1, "y0": F.col("z_m") * 1e2 - 1e2, "x1": (F.col("x_m") + 5e0) * 1e2 + 2e1, "y1": F.col("z_m") * 1e2})


OBS = ["camera_id", "track_id", "frame_index", "class_name", "score", "x_m", "z_m", "x0", "y0", "x1", "y1"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (camera, track, frame); a frame is four hours of ``events``, a track a user."""
    e = table(spark, sf_dir, "events")
    frame = ((F.dayofmonth("ts") - 1) * 6 + F.floor(F.hour("ts") / 4)).cast("long")
    return _positions(e.groupBy(F.col("user_id").alias("track_id"), frame.alias("frame_index")).agg(F.max("event_id").alias("e"))).select(*OBS)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: observations without the deduplication of a frame, with det_id."""
    e = table(spark, sf_dir, "events")
    frame = ((F.dayofmonth("ts") - 1) * 6 + F.floor(F.hour("ts") / 4)).cast("long")
    return _positions(e.select(F.col("event_id").alias("det_id"), F.col("event_id").alias("e"), F.col("user_id").alias("track_id"), frame.alias("frame_index"))).select("det_id", *OBS)


ZONES = {"till": ((-1, 2), (1, 2), (1, 4), (-1, 4)), "display": ((1, 3), (3, 3), (3, 5), (1, 5)), "door": ((-4, 1), (-2, 1), (-2, 3), (-4, 3))}


def zones(spark: SparkSession) -> DataFrame:
    """Three square zones of each of eight cameras."""
    values = ", ".join(f"({c}, '{n}', array({', '.join(f'struct({x}e0 AS x, {z}e0 AS z)' for x, z in p)}))" for c in range(8) for n, p in ZONES.items())
    return spark.sql(f"SELECT CAST(camera_id AS BIGINT) AS camera_id, zone, polygon, 2 AS max_occupancy, 0.4e0 AS loiter_seconds, zone <> 'display' AS restricted FROM VALUES {values} AS t(camera_id, zone, polygon)")


def lines(spark: SparkSession) -> DataFrame:
    return spark.range(8).select(F.col("id").alias("camera_id"), F.lit("gate").alias("line"), F.lit(0.0).alias("ax"), F.lit(1.0).alias("az"), F.lit(0.0).alias("bx"), F.lit(7.0).alias("bz"))


def truth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("camera_id", F.col("track_id").alias("gt_id"), "frame_index", "x0", "y0", "x1", "y1")


def pred_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("track_id") * 7 + F.col("frame_index")) % 11 - 5
    pid = F.col("track_id") * 10 + F.when(F.col("frame_index") >= 90, 1).otherwise(0)
    return observations(spark, sf_dir).select("camera_id", pid.alias("pred_id"), "frame_index", "score", *[(F.col(c) + (s if c[0] == "x" else 0)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("image"), (F.col("l_suppkey") % 10).alias("camera"), (F.col("l_partkey") % 8).alias("gt"), ((F.col("l_partkey") + F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)) % 8).alias("pred"), F.col("l_quantity").cast("bigint").alias("n"))


def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse label maps: one class per (camera, frame, cell)."""
    e = table(spark, sf_dir, "events")
    frame = ((F.dayofmonth("ts") - 1) * 6 + F.floor(F.hour("ts") / 4)).cast("long")
    cell = F.col("user_id") % 16
    return e.groupBy((F.col("user_id") % 8).alias("camera_id"), frame.alias("frame_index"), F.floor(cell / 4).alias("cell_y"), (cell % 4).alias("cell_x")).agg((F.sum("event_id") % 5).alias("class_id"))


def attribute_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return l.join(d.select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"), (F.col("n_chars") % 1000 / 1e3).alias("score"))


def reid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("pid"), (F.col("vec_id") % 4).alias("camera"), (F.col("vec_id") % 5 == 0).alias("query"), F.col("embedding").cast("array<double>").alias("feat"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("alert_id")).distinct()


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("event_type") == "view", "confirmed").when(F.col("event_type") == "click", "rejected").when(F.col("event_type") == "signup", "unreviewed")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("alert_id"), s.alias("status"), "ts", F.col("event_id").alias("line_no")).where("status is not null")


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 12).alias("run"), (F.col("o_orderkey") % 30).alias("epoch"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_orderkey").alias("k"))


def clip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("c_custkey") % 10 == 8, "train").when(F.col("c_custkey") % 10 == 9, "test").otherwise("val")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), F.col("c_nationkey").alias("camera"), split.alias("split"), F.col("c_acctbal").cast("double").alias("bytes"))


_FRAME = "CAST((extract(day FROM ts) - 1) * 6 + floor(extract(hour FROM ts) / 4) AS BIGINT)"
_OBS = """SELECT camera_id, track_id, frame_index, class_name, score, x_m, z_m, (x_m + 5e0) * 1e2 - 2e1 AS x0, z_m * 1e2 - 1e2 AS y0, (x_m + 5e0) * 1e2 + 2e1 AS x1, z_m * 1e2 AS y1 {more}
FROM (SELECT u % 8 AS camera_id, u AS track_id, f AS frame_index, e AS det_id,
  CASE WHEN u % 10 = 0 THEN 'bag' WHEN u % 10 = 1 THEN 'boxed_stock' ELSE 'person' END AS class_name, ((e * 31) % 100) / 1e2 AS score,
  abs(((f * 5 * (u % 7 + 1) + u * 131) % 1600) - 800) / 1e2 - 4e0 AS x_m, abs(((f * 3 * (u % 5 + 1) + u * 57) % 1200) - 600) / 1e2 + 1e0 AS z_m
  FROM ({rows}))"""
SQL = {
    "observations": _OBS.format(more="", rows=f"SELECT user_id AS u, max(event_id) AS e, {_FRAME} AS f FROM events GROUP BY 1, 3"),
    "detections": _OBS.format(more=", det_id", rows=f"SELECT user_id AS u, event_id AS e, {_FRAME} AS f FROM events"),
    "zones": "SELECT c AS camera_id, zone, x_lo, x_hi, z_lo, z_hi, 2 AS max_occupancy, 0.4e0 AS loiter_seconds, zone <> 'display' AS restricted FROM (VALUES ('till', -1e0, 1e0, 2e0, 4e0), ('display', 1e0, 3e0, 3e0, 5e0), ('door', -4e0, -2e0, 1e0, 3e0)) AS v(zone, x_lo, x_hi, z_lo, z_hi), (SELECT unnest(range(8)) AS c)",
    # the even-odd rule puts a square's left and lower edges inside, its right and upper ones outside
    "inzone": "SELECT o.*, zone, max_occupancy, loiter_seconds, restricted, x_m >= x_lo AND x_m < x_hi AND z_m >= z_lo AND z_m < z_hi AS inside FROM observations o JOIN zones z ON o.camera_id = z.camera_id",
    "stays": "SELECT camera_id, track_id, zone, any_value(loiter_seconds) AS loiter_seconds, bool_and(restricted) AS restricted, min(frame_index) AS frame_start, max(frame_index) AS frame_end, (max(frame_index) - min(frame_index) + 1) / 5e0 AS value FROM (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id, zone ORDER BY frame_index) AS run FROM inzone) WHERE inside GROUP BY camera_id, track_id, zone, run",
    "crossings": """SELECT camera_id, track_id, 'gate' AS line, f0 AS frame_start, frame_index AS frame_end, s1 AS value, CASE WHEN s1 > 0 THEN 'in' ELSE 'out' END AS direction FROM (
      SELECT *, sign(-(px - 0) * 6e0) AS s0, sign(-(x_m - 0) * 6e0) AS s1, sign((x_m - px) * (1e0 - pz) - (z_m - pz) * (0 - px)) AS t0, sign((x_m - px) * (7e0 - pz) - (z_m - pz) * (0 - px)) AS t1
      FROM (SELECT *, lag(x_m) OVER w AS px, lag(z_m) OVER w AS pz, lag(frame_index) OVER w AS f0 FROM observations WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_index)) WHERE f0 IS NOT NULL)
      WHERE s0 * s1 = -1 AND t0 * t1 = -1""",
    "truth_boxes": "SELECT camera_id, track_id AS gt_id, frame_index, x0, y0, x1, y1 FROM observations",
    "pred_boxes": "SELECT camera_id, track_id * 10 + CASE WHEN frame_index >= 90 THEN 1 ELSE 0 END AS pred_id, frame_index, score, x0 + s AS x0, y0, x1 + s AS x1, y1 FROM (SELECT *, (track_id * 7 + frame_index) % 11 - 5 AS s FROM observations)",
    "pairs": """SELECT *, b / ((gx1 - gx0) * (gy1 - gy0) + (px1 - px0) * (py1 - py0) - b) AS iou FROM (SELECT g.camera_id, gt_id, pred_id, g.frame_index, score, g.x0 gx0, g.y0 gy0, g.x1 gx1, g.y1 gy1, p.x0 px0, p.y0 py0, p.x1 px1, p.y1 py1,
      greatest(least(g.x1, p.x1) - greatest(g.x0, p.x0), 0e0) * greatest(least(g.y1, p.y1) - greatest(g.y0, p.y0), 0e0) AS b FROM truth_boxes g JOIN pred_boxes p ON g.camera_id = p.camera_id AND g.frame_index = p.frame_index)""",
    "label_counts": "SELECT l_orderkey AS image, l_suppkey % 10 AS camera, l_partkey % 8 AS gt, (l_partkey + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) % 8 AS pred, CAST(l_quantity AS BIGINT) AS n FROM lineitem",
    "label_cells": f"SELECT user_id % 8 AS camera_id, {_FRAME} AS frame_index, CAST(floor((user_id % 16) / 4) AS BIGINT) AS cell_y, user_id % 16 % 4 AS cell_x, CAST(sum(event_id) % 5 AS BIGINT) AS class_id FROM events GROUP BY 1, 2, 3, 4",
    "attribute_scores": "SELECT l.doc_id AS key, quality AS label, n_chars % 1000 / 1e3 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "reid": "SELECT vec_id, label AS pid, vec_id % 4 AS camera, vec_id % 5 = 0 AS query, CAST(embedding AS DOUBLE[]) AS feat FROM embeddings",
    "alerts": "SELECT DISTINCT user_id AS alert_id FROM events WHERE event_type = 'purchase'",
    "dispositions": "SELECT * FROM (SELECT user_id AS alert_id, CASE event_type WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'rejected' WHEN 'signup' THEN 'unreviewed' END AS status, ts, event_id AS line_no FROM events) WHERE status IS NOT NULL",
    "run_metrics": "SELECT o_custkey % 12 AS run, o_orderkey % 30 AS epoch, o_orderpriority AS metric, CAST(o_totalprice AS DOUBLE) AS value, o_orderkey AS k FROM orders",
    "clip_rows": "SELECT c_custkey AS clip, c_nationkey AS camera, CASE c_custkey % 10 WHEN 8 THEN 'train' WHEN 9 THEN 'test' ELSE 'val' END AS split, CAST(c_acctbal AS DOUBLE) AS bytes FROM customer",
}
_NEEDS = {"inzone": ["observations", "zones"], "stays": ["inzone"], "crossings": ["observations"], "truth_boxes": ["observations"], "pred_boxes": ["observations"], "pairs": ["truth_boxes", "pred_boxes"]}


def with_views(query: str, *names: str) -> str:
    """``query`` after a WITH clause of the named views and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + query.strip()


class Catalogue:
    """Collects queries and their SQL as they are defined."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: tuple[str, ...] = ()):
        def put(f):
            assert name not in self.queries, name
            self.queries[name] = f
            if sql:
                self.sql[name] = with_views(sql, *views) if views else sql.strip()
            return f

        return put
