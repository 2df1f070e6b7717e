"""Quality metrics over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewatch.operators import metrics as M
from aislewatch.plans import views as V
from aislewatch.plans.track_queries import _ready

C = V.Catalogue()
_r = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


@C.add("agg_confusion", "SELECT gt, pred, CAST(sum(n) AS BIGINT) AS n FROM label_counts GROUP BY 1, 2", ("label_counts",))
def agg_confusion(spark, d):
    return M.confusion(V.label_counts(spark, d))


_IOU = """, m AS (SELECT {k} gt, pred, sum(n) AS n FROM label_counts GROUP BY ALL),
r AS (SELECT {k} gt AS class, sum(n) AS support, sum(n) FILTER (gt = pred) AS hit FROM m GROUP BY ALL), p AS (SELECT {k} pred AS class, sum(n) AS predicted FROM m GROUP BY ALL),
i AS (SELECT {k} class, coalesce(hit, 0) / (coalesce(support, 0) + coalesce(predicted, 0) - coalesce(hit, 0)) AS iou, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted FROM r FULL JOIN p USING ({u} class))
"""


@C.add("agg_miou", _IOU.format(k="", u="") + "SELECT class, round(iou, 6) AS iou, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, support < 1e-2 * sum(support) OVER () AS thin FROM i", ("label_counts",))
def agg_miou(spark, d):
    return _r(M.class_iou(M.confusion(V.label_counts(spark, d))), "iou")


@C.add("agg_miou_by_dataset", _IOU.format(k="camera,", u="camera,") + "SELECT camera, round(avg(iou) FILTER (support > 0), 6) AS miou, count(*) FILTER (support > 0) AS classes, count(*) FILTER (support = 0 AND predicted > 0) AS phantom FROM i GROUP BY 1", ("label_counts",))
def agg_miou_by_dataset(spark, d):
    return _r(M.mean_iou(M.class_iou(M.confusion(V.label_counts(spark, d), "camera"), "camera"), "camera"), "miou")


@C.add("agg_confusion_report", "SELECT camera, gt, pred, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY camera, gt), 6) AS share, round(sum(n) OVER (PARTITION BY camera, gt) / sum(n) OVER (PARTITION BY camera), 6) AS truth_share FROM (SELECT camera, gt, pred, sum(n) AS n FROM label_counts GROUP BY 1, 2, 3)", ("label_counts",))
def agg_confusion_report(spark, d):
    return _r(M.confusion_shares(M.confusion(V.label_counts(spark, d), "camera"), "camera"), "share", "truth_share")


_BOOT = """, d AS (SELECT unnest(range(1, 51)) AS draw), x AS (SELECT image, camera, gt, pred, sum(n) AS n FROM label_counts GROUP BY 1, 2, 3, 4),
k AS (SELECT unit, id, draw, (CAST(('0x' || left(md5(id || ':' || draw), 8)) AS BIGINT) + 5e-1) / 4294967296e0 AS u FROM (SELECT DISTINCT 'image' AS unit, image AS id FROM x UNION ALL SELECT DISTINCT 'camera', camera FROM x), d),
w AS (SELECT unit, id, draw, CAST(u > 36787944e-8 AS INT) + CAST(u > 73575888e-8 AS INT) + CAST(u > 9196986e-7 AS INT) + CAST(u > 98101184e-8 AS INT) + CAST(u > 99634015e-8 AS INT) + CAST(u > 99940582e-8 AS INT) AS m FROM k),
c AS (SELECT unit, draw, gt, pred, sum(n * m) AS n FROM w JOIN x ON id = CASE unit WHEN 'image' THEN image ELSE camera END WHERE m > 0 GROUP BY 1, 2, 3, 4),
r AS (SELECT unit, draw, gt AS class, sum(n) AS support, sum(n) FILTER (gt = pred) AS hit FROM c GROUP BY 1, 2, 3), p AS (SELECT unit, draw, pred AS class, sum(n) AS predicted FROM c GROUP BY 1, 2, 3),
i AS (SELECT unit, draw, avg(coalesce(hit, 0) / (support + coalesce(predicted, 0) - coalesce(hit, 0))) AS miou FROM r LEFT JOIN p USING (unit, draw, class) GROUP BY 1, 2),
n AS (SELECT unit, count(DISTINCT id) AS units FROM k GROUP BY 1)
SELECT unit, round(avg(miou), 6) AS mean, round(stddev_samp(miou), 6) AS sd, round(quantile_cont(miou, 25e-3), 6) AS low, round(quantile_cont(miou, 975e-3), 6) AS high, any_value(units) AS units, round(any_value(units) * (stddev_samp(miou) / 1e-2) ** 2, 2) AS needed FROM i JOIN n USING (unit) GROUP BY unit"""


@C.add("agg_bootstrap_miou", _BOOT, ("label_counts",))
def agg_bootstrap_miou(spark, d):
    rows = V.label_counts(spark, d)
    out = []
    for unit in ("image", "camera"):
        text = F.concat_ws(":", F.col(unit).cast("string"), F.col("draw").cast("string"))
        chance = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
        out.append(M.bootstrap_miou(rows, unit, draws=50, chance=chance).withColumn("unit", F.lit(unit)))
    return _r(out[0].unionByName(out[1]), "mean", "sd", "low", "high").withColumn("needed", F.round("needed", 2))


@C.add("j_gt_pred_iou", "SELECT camera_id, frame_index, gt_id, pred_id, round(iou, 6) AS iou FROM pairs WHERE iou >= 5e-1", ("pairs",))
def j_gt_pred_iou(spark, d):
    return _r(M.matched_boxes(V.truth_boxes(spark, d), V.pred_boxes(spark, d)), "iou").select("camera_id", "frame_index", "gt_id", "pred_id", "iou")


@C.add("agg_idf1")
def agg_idf1(spark, d):
    _ready(spark)
    return M.idf1(V.truth_boxes(spark, d), V.pred_boxes(spark, d))


@C.add("agg_id_switches", """
, b AS (SELECT camera_id, gt_id, frame_index, arg_max(pred_id, (iou, pred_id)) AS best FROM pairs WHERE iou >= 5e-1 GROUP BY 1, 2, 3),
c AS (SELECT camera_id, gt_id, sum(CASE WHEN best <> l THEN 1 ELSE 0 END) AS switches, count(DISTINCT best) AS preds FROM (SELECT *, lag(best) OVER (PARTITION BY camera_id, gt_id ORDER BY frame_index) AS l FROM b) GROUP BY 1, 2),
t AS (SELECT camera_id, gt_id, max(n) AS top FROM (SELECT camera_id, gt_id, best, count(*) AS n FROM b GROUP BY 1, 2, 3) GROUP BY 1, 2),
g AS (SELECT camera_id, gt_id, count(*) AS frames FROM truth_boxes GROUP BY 1, 2)
SELECT g.camera_id, CAST(sum(coalesce(switches, 0)) AS BIGINT) AS switches, round(avg(coalesce(preds, 0)), 6) AS tracks_per_identity, CAST(sum(CASE WHEN top >= 8e-1 * frames THEN 1 ELSE 0 END) AS BIGINT) AS mostly_tracked, round(avg(CASE WHEN top >= 8e-1 * frames THEN 1e0 ELSE 0e0 END), 6) AS mostly_tracked_frac
FROM g LEFT JOIN c USING (camera_id, gt_id) LEFT JOIN t USING (camera_id, gt_id) GROUP BY 1""", ("pairs",))
def agg_id_switches(spark, d):
    return _r(M.id_switches(V.truth_boxes(spark, d), V.pred_boxes(spark, d)), "tracks_per_identity", "mostly_tracked_frac")


@C.add("agg_cmc_map", """
, v AS (SELECT vec_id, pid, camera, query, feat, sqrt(list_dot_product(feat, feat)) AS n FROM reid),
r AS (SELECT q.vec_id AS q, g.vec_id, g.pid = q.pid AS match, round(list_dot_product(q.feat, g.feat) / (q.n * g.n), 9) AS sim FROM v q JOIN v g ON q.query AND NOT g.query AND g.pid <> -1 AND (g.pid <> q.pid OR g.camera <> q.camera)),
k AS (SELECT *, row_number() OVER w AS rank, sum(CAST(match AS INT)) OVER w AS hits FROM r WINDOW w AS (PARTITION BY q ORDER BY sim DESC, vec_id)),
p AS (SELECT q, avg(hits / rank) AS ap, min(rank) AS first FROM k WHERE match GROUP BY 1)
SELECT round(avg(ap), 5) AS map, count(*) AS queries_scored, round(avg(CAST(first <= 1 AS DOUBLE)), 6) AS rank1, round(avg(CAST(first <= 5 AS DOUBLE)), 6) AS rank5, round(avg(CAST(first <= 10 AS DOUBLE)), 6) AS rank10 FROM p""".replace("CAST(first <= 1 AS DOUBLE)", "CASE WHEN first <= 1 THEN 1e0 ELSE 0e0 END").replace("CAST(first <= 5 AS DOUBLE)", "CASE WHEN first <= 5 THEN 1e0 ELSE 0e0 END").replace("CAST(first <= 10 AS DOUBLE)", "CASE WHEN first <= 10 THEN 1e0 ELSE 0e0 END"), ("reid",))
def agg_cmc_map(spark, d):
    return _r(M.cmc_map(V.reid(spark, d)), "rank1", "rank5", "rank10").withColumn("map", F.round("map", 5))


@C.add("agg_attributes", """
, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS k FROM attribute_scores),
s AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q, count(*) FILTER (label = 1 AND score >= 5e-1) AS tp, count(*) FILTER (score >= 5e-1) AS c, sum(k) FILTER (label = 1) AS k FROM r)
SELECT p AS positives, round(tp / c, 6) AS precision, round(tp / p, 6) AS recall, round(2 * (tp / c) * (tp / p) / (tp / c + tp / p), 6) AS f1, round((k - p * (p + 1) / 2) / (p * q), 6) AS auroc FROM s""", ("attribute_scores",))
def agg_attributes(spark, d):
    _ready(spark)
    return _r(M.attribute_report(V.attribute_scores(spark, d)), "precision", "recall", "f1", "auroc")


# the classes of truth and prediction: of every ninth prediction the class is another one, and of every tenth truth there is none
_AP = """, g AS (SELECT o.camera_id, o.frame_index, o.class_name, o.track_id AS gt_id, o.x0, o.y0, o.x1, o.y1 FROM observations o WHERE (track_id + frame_index) % 10 <> 0),
q AS (SELECT o.camera_id, o.frame_index, CASE WHEN (p.pred_id + p.frame_index) % 9 = 0 THEN 'bag' ELSE o.class_name END AS class_name, p.pred_id, p.score, p.x0, p.y0, p.x1, p.y1 FROM pred_boxes p JOIN observations o ON p.camera_id = o.camera_id AND p.frame_index = o.frame_index AND p.pred_id // 10 = o.track_id),
th AS (SELECT unnest([5e-1, 55e-2, 6e-1, 65e-2, 7e-1, 75e-2, 8e-1, 85e-2, 9e-1, 95e-2]) AS t),
j AS (SELECT q.camera_id, q.frame_index, q.class_name, pred_id, gt_id, b / ((g.x1 - g.x0) * (g.y1 - g.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - b) AS i
  FROM (SELECT q.*, gt_id, g.x0 AS gx0, greatest(least(g.x1, q.x1) - greatest(g.x0, q.x0), 0e0) * greatest(least(g.y1, q.y1) - greatest(g.y0, q.y0), 0e0) AS b, g.camera_id AS c FROM q JOIN g ON q.camera_id = g.camera_id AND q.frame_index = g.frame_index AND q.class_name = g.class_name) q JOIN g USING (camera_id, frame_index, class_name, gt_id)),
l AS (SELECT camera_id, frame_index, class_name, pred_id, list({'i': i, 'gt': gt_id} ORDER BY i DESC, gt_id DESC) AS m FROM j WHERE i >= 5e-1 GROUP BY 1, 2, 3, 4),
k AS (SELECT q.camera_id, q.frame_index, q.class_name, q.pred_id, q.score, m, row_number() OVER (PARTITION BY q.camera_id, q.frame_index, q.class_name ORDER BY q.score DESC, q.pred_id) AS n FROM q LEFT JOIN l USING (camera_id, frame_index, class_name, pred_id)),
z AS (SELECT camera_id, frame_index, class_name, t, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS took, CAST(NULL AS BIGINT) AS pred_id, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT camera_id, frame_index, class_name FROM k), th
  UNION ALL SELECT camera_id, frame_index, class_name, t, n, CASE WHEN took IS NULL THEN taken ELSE list_append(taken, took) END, took, pred_id, score
  FROM (SELECT z.camera_id, z.frame_index, z.class_name, z.t, k.n, z.taken, k.pred_id, k.score, list_filter(coalesce(k.m, []), lambda x: x.i >= z.t AND NOT list_contains(z.taken, x.gt))[1].gt AS took
        FROM z JOIN k ON z.camera_id = k.camera_id AND z.frame_index = k.frame_index AND z.class_name = k.class_name AND k.n = z.n + 1)),
h AS (SELECT class_name, t, score, camera_id, frame_index, pred_id, took IS NOT NULL AS hit FROM z WHERE n > 0),
c AS (SELECT class_name, t, hit, sum(CAST(hit AS INT)) OVER w AS tp, row_number() OVER w AS k FROM h WINDOW w AS (PARTITION BY class_name, t ORDER BY score DESC, camera_id, frame_index, pred_id)),
n AS (SELECT class_name, count(*) AS truths FROM g GROUP BY 1),
r AS (SELECT c.class_name, t, tp / truths AS recall, tp / k AS precision FROM c JOIN n ON c.class_name = n.class_name WHERE hit),
s AS (SELECT n.class_name, th.t, truths, x, coalesce((SELECT max(precision) FROM r WHERE r.class_name = n.class_name AND r.t = th.t AND recall >= x / 1e2 - 1e-11), 0) AS p FROM n, th, (SELECT unnest(range(101)) AS x)),
ap AS (SELECT class_name, t, avg(p) AS ap, any_value(truths) AS truths FROM s GROUP BY 1, 2)
"""


def _classed_boxes(spark, d):
    o = V.observations(spark, d).select("camera_id", "frame_index", "class_name", F.col("track_id").alias("gt_id"), "x0", "y0", "x1", "y1")
    p = V.pred_boxes(spark, d).withColumn("gt_id", F.expr("pred_id DIV 10")).join(o.select("camera_id", "frame_index", "gt_id", "class_name"), ["camera_id", "frame_index", "gt_id"]).drop("gt_id")
    return o.where("(gt_id + frame_index) % 10 <> 0"), p.withColumn("class_name", F.when((F.col("pred_id") + F.col("frame_index")) % 9 == 0, "bag").otherwise(F.col("class_name")))


@C.add("agg_detection_ap", _AP + "SELECT class_name, t, round(ap, 6) AS ap, truths FROM ap", ("observations", "pred_boxes"))
def agg_detection_ap(spark, d):
    _ready(spark)
    return _r(M.average_precision(*_classed_boxes(spark, d), "class_name"), "ap")


@C.add("agg_detection_map", _AP + "SELECT round(avg(ap), 6) AS map, round(avg(ap) FILTER (t = 5e-1), 6) AS map50, round(avg(ap) FILTER (t = 75e-2), 6) AS map75, count(*) FILTER (t = 5e-1) AS classes FROM ap", ("observations", "pred_boxes"))
def agg_detection_map(spark, d):
    _ready(spark)
    return _r(M.mean_precision(M.average_precision(*_classed_boxes(spark, d), "class_name")), "map", "map50", "map75")


_PAIR = "SELECT o_orderpriority AS k, CAST(o_totalprice AS DOUBLE) AS gt, CAST(o_totalprice AS DOUBLE) * (1 + (o_custkey % 7 - 3) / 1e1) AS pred FROM orders"


@C.add("agg_depth_errors", f"SELECT k, round(avg(CASE WHEN greatest(gt / pred, pred / gt) < 125e-2 THEN 1e0 ELSE 0e0 END), 6) AS delta1, round(avg(abs(pred - gt) / gt), 6) AS absrel, round(sqrt(avg((pred - gt) ** 2)), 3) AS rmse, count(*) AS n FROM ({_PAIR}) GROUP BY 1")
def agg_depth_errors(spark, d):
    o = V.table(spark, d, "orders")
    gt = F.col("o_totalprice").cast("double")
    rows = o.select(F.col("o_orderpriority").alias("k"), gt.alias("gt"), (gt * (1 + (F.col("o_custkey") % 7 - 3) / F.lit(10.0))).alias("pred"))
    return _r(M.depth_errors(rows, "k"), "delta1", "absrel").withColumn("rmse", F.round("rmse", 3))


@C.add("agg_pose_pck", """
, j AS (SELECT g.camera_id, sqrt((p.x0 - g.x0) ** 2) AS d, g.y1 - g.y0 AS h FROM truth_boxes g JOIN pred_boxes p ON g.camera_id = p.camera_id AND g.frame_index = p.frame_index AND g.gt_id = p.pred_id // 10)
SELECT camera_id, round(avg(CASE WHEN d <= 2e-2 * h THEN 1e0 ELSE 0e0 END), 6) AS pck, round(quantile_cont(d, 5e-1), 6) AS l2_p50, round(quantile_cont(d, 9e-1), 6) AS l2_p90, count(*) AS joints FROM j GROUP BY 1""", ("truth_boxes", "pred_boxes"))
def agg_pose_pck(spark, d):
    t, p = V.truth_boxes(spark, d), V.pred_boxes(spark, d)
    s = p.select("camera_id", "frame_index", F.expr("pred_id DIV 10").alias("gt_id"), F.col("x0").alias("sx"), F.col("y0").alias("sy"))
    j = t.select("camera_id", "frame_index", "gt_id", F.col("x0").alias("tx"), F.col("y0").alias("ty"), (F.col("y1") - F.col("y0")).alias("height")).join(s, ["camera_id", "frame_index", "gt_id"])
    return _r(M.pose_pck(j, "camera_id", share=0.02), "pck", "l2_p50", "l2_p90")


@C.add("agg_selection_report", """
, m AS (SELECT run, epoch, metric, avg(value) AS value FROM run_metrics GROUP BY 1, 2, 3),
b AS (SELECT run, metric, max(value) AS best, arg_max(epoch, (value, -epoch)) AS best_epoch, max(epoch) AS last_epoch FROM m GROUP BY 1, 2),
s AS (SELECT run, max(epoch) AS epoch FROM m GROUP BY 1)
SELECT b.run, b.metric, round(best, 3) AS best, best_epoch, last_epoch, round(m.value, 3) AS chosen, round(best - m.value, 3) AS gap, coalesce(abs(best - m.value) > 2e-2, false) AS gap_warning, best_epoch * 2 < last_epoch AS early_peak
FROM b JOIN s ON b.run = s.run LEFT JOIN m ON m.run = b.run AND m.metric = b.metric AND m.epoch = s.epoch""", ("run_metrics",))
def agg_selection_report(spark, d):
    m = V.run_metrics(spark, d).groupBy("run", "epoch", "metric").agg(F.avg("value").alias("value"))
    out = M.selection_report(m, m.groupBy("run").agg(F.max("epoch").alias("epoch")))
    return out.withColumns({c: F.round(c, 3) for c in ("best", "chosen", "gap")})


@C.add("agg_run_table", ", m AS (SELECT run, epoch, metric, max(value) AS value FROM run_metrics GROUP BY 1, 2, 3) SELECT run, max(value) AS best, arg_max(epoch, (value, -epoch)) AS epoch, count(*) AS rows FROM m WHERE metric = '1-URGENT' GROUP BY 1", ("run_metrics",))
def agg_run_table(spark, d):
    return M.run_table(V.run_metrics(spark, d).groupBy("run", "epoch", "metric").agg(F.max("value").alias("value")), "1-URGENT")


@C.add("agg_distribution", "SELECT metric, count(value) AS n, round(avg(value), 3) AS mean, round(quantile_cont(value, 5e-1), 3) AS p50, round(quantile_cont(value, 9e-1), 3) AS p90, max(value) AS max FROM run_metrics GROUP BY 1", ("run_metrics",))
def agg_distribution(spark, d):
    return M.distribution(V.run_metrics(spark, d), "value", "metric").withColumns({c: F.round(c, 3) for c in ("mean", "p50", "p90")})


# label runs of 24 rows, 20 pixels apart, each class standing on the floor under its lowest row; how level they are is made up
_SURFACE = """WITH r AS (SELECT user_id % 8 AS camera_id, event_id % 40 AS frame_index, event_id // 40 % 3 AS class_id, event_id // 120 % 24 AS row, 20 + event_id % 40 AS n, event_id * 7 % 101 / 1e2 AS horiz FROM events),
f AS (SELECT *, 100 + 20 * row AS y, 120 + 20 * max(row) OVER (PARTITION BY camera_id, frame_index, class_id) AS foot FROM r),
g AS (SELECT *, (foot - 36e1) / 9e2 AS ry, (y - 36e1) / 9e2 AS t FROM f),
h AS (SELECT *, CASE WHEN cos(6e-1) * ry + sin(6e-1) > 1e-9 THEN 25e-1 - (cos(6e-1) - sin(6e-1) * ry) * 25e-1 / (cos(6e-1) * ry + sin(6e-1)) * (t * cos(6e-1) + sin(6e-1)) / (cos(6e-1) - t * sin(6e-1)) END AS height FROM g)
"""


def _surface(spark, d):
    from aislewatch.plans.scalar_queries import _cam

    i = F.col("event_id")
    e = V.table(spark, d, "events").select((F.col("user_id") % 8).alias("camera_id"), (i % 40).alias("frame_index"), (F.floor(i / 40) % 3).alias("class_id"), (100 + 20 * (F.floor(i / 120) % 24)).alias("y"), F.lit(600).alias("x_start"), (620 + i % 40).alias("x_end"), (i * 7 % 101 / 1e2).alias("horiz"))
    foot = e.groupBy("camera_id", "frame_index", "class_id").agg((F.max("y") + 20).alias("foot_v")).withColumn("foot_u", F.lit(640))
    cams = e.select("camera_id").distinct().withColumn("camera", _cam())
    return M.run_heights(e.join(foot, ["camera_id", "frame_index", "class_id"]), cams)


@C.add("agg_height_histogram", _SURFACE + "SELECT camera_id, CAST(floor((height + 2e-1) / 1e-1) AS BIGINT) AS bin, CAST(coalesce(sum(n) FILTER (horiz >= 8e-1), 0) AS BIGINT) AS horizontal, CAST(coalesce(sum(n) FILTER (horiz > 5e-1 AND horiz < 8e-1), 0) AS BIGINT) AS mid, CAST(coalesce(sum(n) FILTER (horiz <= 5e-1), 0) AS BIGINT) AS vertical FROM h WHERE height >= -2e-1 AND height < 26e-1 GROUP BY 1, 2")
def agg_height_histogram(spark, d):
    return M.height_histogram(_surface(spark, d))


@C.add("agg_level_quantiles", _SURFACE + ", x AS (SELECT camera_id, horiz, unnest(range(n)) AS k FROM h WHERE height IS NOT NULL) SELECT camera_id, count(*) AS pixels, [round(q, 6) FOR q IN quantile_cont(horiz, [1e-1, 25e-2, 5e-1, 75e-2, 9e-1])] AS quantiles FROM x GROUP BY 1")
def agg_level_quantiles(spark, d):
    return M.level_quantiles(_surface(spark, d)).withColumn("quantiles", F.transform("quantiles", lambda q: F.round(q, 6)))
