"""Label cells, data-set audits, attributes and alerts over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewatch.operators import audits as A
from aislewatch.operators import regions as G
from aislewatch.plans import views as V

C = V.Catalogue()
_r = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

_CONS = """, n AS (SELECT camera_id, cell_y, cell_x, class_id, count(*) AS n FROM label_cells GROUP BY 1, 2, 3, 4),
c AS (SELECT camera_id, cell_y, cell_x, arg_max(class_id, (n, -class_id)) AS class_id, max(n) / sum(n) AS agreement, CAST(sum(n) AS BIGINT) AS frames FROM n GROUP BY 1, 2, 3)
"""


@C.add("agg_consensus", _CONS + "SELECT camera_id, cell_y, cell_x, class_id, round(agreement, 6) AS agreement, frames, agreement >= 3e-1 AS stable FROM c", ("label_cells",))
def agg_consensus(spark, d):
    return _r(A.consensus(V.label_cells(spark, d), 0.3), "agreement")


@C.add("agg_consensus_fleet", _CONS + "SELECT camera_id, count(*) FILTER (frames >= 2) AS cells, round(avg(CASE WHEN agreement >= 3e-1 THEN 1e0 ELSE 0e0 END) FILTER (frames >= 2), 6) AS stable_share FROM c GROUP BY 1", ("label_cells",))
def agg_consensus_fleet(spark, d):
    return _r(A.consensus_fleet(A.consensus(V.label_cells(spark, d), 0.3)), "stable_share")


_OF = "sum(pairs) AS pairs, sum(flips) AS flips, sum(bounced) AS bounced, sum(evaluable) AS evaluable"


@C.add("agg_flip_rates", _CONS + f"""
, o AS (SELECT *, lag(class_id) OVER w AS p, lead(class_id, 1) OVER w AS a1, lead(class_id, 2) OVER w AS a2, lead(class_id, 3) OVER w AS a3 FROM label_cells WINDOW w AS (PARTITION BY camera_id, cell_y, cell_x ORDER BY frame_index)),
q AS (SELECT camera_id, cell_y, cell_x, p, class_id <> p AS flip, coalesce(a1 = p, false) OR coalesce(a2 = p, false) OR coalesce(a3 = p, false) AS back, a3 IS NOT NULL AS full_ FROM o WHERE p IS NOT NULL),
f AS (SELECT camera_id, cell_y, cell_x, p, count(*) AS pairs, count(*) FILTER (flip) AS flips, count(*) FILTER (flip AND back) AS bounced, count(*) FILTER (flip AND (back OR full_)) AS evaluable FROM q GROUP BY 1, 2, 3, 4),
z AS (SELECT f.*, c.class_id AS modal, unnest([CASE WHEN agreement >= 3e-1 THEN 'static' ELSE 'moving' END, 'all']) AS zone FROM f JOIN c USING (camera_id, cell_y, cell_x)),
d AS (SELECT a.camera_id, a.cell_y, a.cell_x, b.class_id AS region, count(*) AS n FROM c a JOIN c b ON a.camera_id = b.camera_id AND abs(a.cell_y - b.cell_y) + abs(a.cell_x - b.cell_x) <= 1 GROUP BY 1, 2, 3, 4)
SELECT *, CAST(pairs AS BIGINT) AS pairs, CAST(flips AS BIGINT) AS flips, CAST(bounced AS BIGINT) AS bounced, CAST(evaluable AS BIGINT) AS evaluable FROM (
SELECT camera_id, 'all' AS subject, NULL AS class_id, zone, count(DISTINCT (cell_y, cell_x)) AS cells, {_OF} FROM z GROUP BY camera_id, zone
UNION ALL SELECT camera_id, 'from', p, zone, count(*), {_OF} FROM z GROUP BY camera_id, p, zone
UNION ALL SELECT camera_id, CASE WHEN n = 5 THEN 'interior' ELSE 'band' END AS place, region, zone, count(DISTINCT (cell_y, cell_x)), {_OF} FROM d JOIN z USING (camera_id, cell_y, cell_x) GROUP BY camera_id, place, region, zone)""".replace("SELECT *, CAST(pairs AS BIGINT) AS pairs", "SELECT camera_id, subject, class_id, zone, cells, CAST(pairs AS BIGINT) AS pairs"), ("label_cells",))
def agg_flip_rates(spark, d):
    cells = V.label_cells(spark, d)
    cons = A.consensus(cells, 0.3)
    return G.flip_report(cells, cons.where("stable"), cons)


_MOVES = """, m AS (SELECT coalesce(a.camera_id, b.camera_id) AS camera_id, a.class_id AS old_class, b.class_id AS new_class, count(*) AS n FROM (SELECT * FROM label_cells WHERE frame_index % 7 <> 0) a
FULL JOIN (SELECT camera_id, cell_y, cell_x, frame_index, (class_id + frame_index % 2) % 5 AS class_id FROM label_cells) b ON a.camera_id = b.camera_id AND a.cell_y = b.cell_y AND a.cell_x = b.cell_x AND a.frame_index = b.frame_index GROUP BY 1, 2, 3)
"""


def _moves(spark, d):
    c = V.label_cells(spark, d)
    return A.label_moves(c.where("frame_index % 7 <> 0"), c.withColumn("class_id", (F.col("class_id") + F.col("frame_index") % 2) % 5))


@C.add("j_pair_masks_diff", _MOVES + "SELECT * FROM m", ("label_cells",))
def j_pair_masks_diff(spark, d):
    return _moves(spark, d)


@C.add("top_moves", _MOVES + "SELECT * FROM m WHERE old_class <> new_class ORDER BY n DESC, camera_id, old_class, new_class LIMIT 10", ("label_cells",))
def top_moves(spark, d):
    return A.top_moves(_moves(spark, d))


_HOT = """
, w AS (SELECT *, row_number() OVER (PARTITION BY camera_id, frame_index, class_name ORDER BY score DESC, det_id) AS k, struct_pack(det_id, score, x0, y0, x1, y1) AS b FROM detections),
s AS (SELECT camera_id, frame_index, class_name, k, [b] AS kept FROM w WHERE k = 1
  UNION ALL SELECT w.camera_id, w.frame_index, w.class_name, w.k, CASE WHEN len(list_filter(kept, lambda a: greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0e0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0e0) * 15e-1 >= 5e-1 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)))) = 0 THEN list_append(kept, b) ELSE kept END
  FROM s JOIN w ON w.camera_id = s.camera_id AND w.frame_index = s.frame_index AND w.class_name = s.class_name AND w.k = s.k + 1),
g AS (SELECT camera_id, frame_index, b.det_id AS det_id, (b.x0 + b.x1) / 2 AS u, (b.y0 + b.y1) / 2 AS v FROM (SELECT camera_id, frame_index, unnest(arg_max(kept, k)) AS b FROM s GROUP BY camera_id, frame_index, class_name) WHERE b.score < 35e-2),
f AS (SELECT camera_id, count(DISTINCT frame_index) AS n FROM detections GROUP BY 1),
h AS (SELECT g.camera_id, CAST(floor(u / 64) AS BIGINT) AS cx, CAST(floor(v / 64) AS BIGINT) AS cy, count(DISTINCT frame_index) / any_value(n) AS share FROM g JOIN f ON g.camera_id = f.camera_id GROUP BY 1, 2, 3),
t AS (SELECT *, CASE WHEN share > {strong} THEN 'strong' WHEN share > {candidate} THEN 'candidate' END AS tier, cy * 1000 + cx AS id FROM h),
e AS (SELECT a.camera_id, a.tier, a.id AS x, b.id AS y FROM t a JOIN t b ON a.camera_id = b.camera_id AND a.tier = b.tier AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1),
z AS (SELECT camera_id, tier, id, id AS root FROM t WHERE tier IS NOT NULL UNION SELECT z.camera_id, z.tier, e.y, z.root FROM z JOIN e ON e.camera_id = z.camera_id AND e.tier = z.tier AND e.x = z.id),
c AS (SELECT camera_id, tier, id, min(root) AS root FROM z GROUP BY 1, 2, 3),
p AS (SELECT c.camera_id, c.tier, root, min(cx) AS l, min(cy) AS tp, max(cx) AS r, max(cy) AS bt, count(*) AS cells FROM c JOIN t ON c.camera_id = t.camera_id AND c.id = t.id GROUP BY 1, 2, 3),
q AS (SELECT camera_id, tier, greatest(0, l * 64 - 32) AS x0, greatest(0, tp * 64 - 32) AS y0, least(1920, (r + 1) * 64 + 32) AS x1, least(1080, (bt + 1) * 64 + 32) AS y1,
  (SELECT max(share) FROM t WHERE t.camera_id = p.camera_id AND cx BETWEEN l AND r AND cy BETWEEN tp AND bt) AS share, cells FROM p)
""".replace("{strong}", "3e-2").replace("{candidate}", "2e-2")


def _hot(spark, d):
    det = V.detections(spark, d)
    return det, G.hotspot_regions(G.hotspots(det, strong=0.03, candidate=0.02))


@C.add("agg_fp_hotspots", _HOT + "SELECT camera_id, tier, x0, y0, x1, y1, round(share, 6) AS share, cells FROM q", ("detections",))
def agg_fp_hotspots(spark, d):
    V.shared_dir(spark)
    return _r(_hot(spark, d)[1], "share")


@C.add("agg_fp_cover", _HOT + """, x AS (SELECT DISTINCT camera_id, unnest(range(x0 // 8, x1 // 8)) AS i, y0, y1 FROM q), y AS (SELECT DISTINCT camera_id, i, unnest(range(y0 // 8, y1 // 8)) AS j FROM x)
SELECT f.camera_id, (SELECT count(*) FROM q WHERE q.camera_id = f.camera_id) AS regions, 64 * (SELECT count(*) FROM y WHERE y.camera_id = f.camera_id) AS area, (SELECT count(*) FROM g WHERE g.camera_id = f.camera_id) AS boxes,
  (SELECT count(DISTINCT det_id) FROM g JOIN q ON q.camera_id = g.camera_id AND u >= x0 AND u < x1 AND v >= y0 AND v < y1 WHERE g.camera_id = f.camera_id) AS covered FROM f""", ("detections",))
def agg_fp_cover(spark, d):
    V.shared_dir(spark)
    return G.hotspot_cover(*_hot(spark, d))


_REGION_KEYS = "camera_id, frame_index, class_id"
_REGION_RUNS = "SELECT user_id % 8 AS camera_id, event_id % 40 AS frame_index, (event_id // 120) % 24 AS y, (user_id * 37 + event_id // 40 * 11) % 200 AS x_start, (user_id * 37 + event_id // 40 * 11) % 200 + 20 + event_id % 40 AS x_end, event_id // 40 % 3 AS class_id FROM events"


def _region_runs(spark, d):
    e, u, i = V.table(spark, d, "events"), F.col("user_id"), F.col("event_id")
    x = (u * 37 + F.floor(i / 40) * 11) % 200
    return e.select((u % 8).alias("camera_id"), (i % 40).alias("frame_index"), (F.floor(i / 120) % 24).alias("y"), x.alias("x_start"), (x + 20 + i % 40).alias("x_end"), (F.floor(i / 40) % 3).alias("class_id"))


@C.add("agg_box_of_region", f"""WITH RECURSIVE r AS ({_REGION_RUNS}),
s AS (SELECT *, CASE WHEN x_start > max(x_end) OVER (PARTITION BY {_REGION_KEYS}, y ORDER BY x_start, x_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM r),
t AS (SELECT *, sum(new) OVER (PARTITION BY {_REGION_KEYS}, y ORDER BY x_start, x_end ROWS UNBOUNDED PRECEDING) AS g FROM s),
m AS (SELECT {_REGION_KEYS}, y, min(x_start) AS x_start, max(x_end) AS x_end, y * 1000 + min(x_start) AS id FROM t GROUP BY {_REGION_KEYS}, y, g),
e AS (SELECT a.camera_id, a.frame_index, a.class_id, a.id AS x, b.id AS z FROM m a JOIN m b ON a.camera_id = b.camera_id AND a.frame_index = b.frame_index AND a.class_id = b.class_id AND abs(a.y - b.y) = 1 AND a.x_start < b.x_end AND b.x_start < a.x_end),
w AS (SELECT {_REGION_KEYS}, id, id AS root FROM m UNION SELECT w.camera_id, w.frame_index, w.class_id, e.z, w.root FROM w JOIN e ON e.camera_id = w.camera_id AND e.frame_index = w.frame_index AND e.class_id = w.class_id AND e.x = w.id),
c AS (SELECT {_REGION_KEYS}, id, min(root) AS root FROM w GROUP BY {_REGION_KEYS}, id)
SELECT {_REGION_KEYS}, min(x_start) AS x0, min(y) AS y0, max(x_end) AS x1, max(y) + 1 AS y1, CAST(sum(x_end - x_start) AS BIGINT) AS area FROM c JOIN m USING ({_REGION_KEYS}, id) GROUP BY {_REGION_KEYS}, root HAVING sum(x_end - x_start) >= 40""")
def agg_box_of_region(spark, d):
    V.shared_dir(spark)
    return G.connected_regions(_region_runs(spark, d), "camera_id", "frame_index", "class_id", least_area=40, band=8)


_COVER = """, r AS (SELECT user_id % 8 AS camera_id, CAST((extract(day FROM ts) - 1) * 6 + floor(extract(hour FROM ts) / 4) AS BIGINT) AS frame_index, (event_id * 13) % 700 AS y, (event_id * 7) % 800 AS x_start, (event_id * 7) % 800 + 200 AS x_end, event_id % 3 AS class_id FROM events),
v AS (SELECT det_id, coalesce(sum(greatest(least(x1, x_end) - greatest(x0, x_start), 0)) FILTER (y IS NOT NULL), 0) / any_value((x1 - x0) * (y1 - y0)) AS covered
FROM detections b LEFT JOIN r ON r.camera_id = b.camera_id AND r.frame_index = b.frame_index AND r.class_id = 1 AND y >= y0 AND y < y1 GROUP BY 1)
"""


def _covered(spark, d):
    from aislewatch.plans.pose_queries import _runs as all_runs

    return A.covered_share(V.detections(spark, d).select("det_id", "camera_id", "frame_index", "x0", "y0", "x1", "y1"), all_runs(spark, d), 1)


@C.add("static_share", _COVER + "SELECT det_id, round(covered, 6) AS covered FROM v", ("detections",))
def static_share(spark, d):
    return _r(_covered(spark, d), "covered").select("det_id", "covered")


@C.add("confirm_with_dense", _COVER + "SELECT det_id FROM v WHERE covered >= 2e-2", ("detections",))
def confirm_with_dense(spark, d):
    return _covered(spark, d).where("covered >= 0.02").select("det_id")


@C.add("j_split_leak", "SELECT camera, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT DISTINCT camera, split FROM clip_rows) GROUP BY 1 HAVING count(*) > 1 AND bool_or(split = 'train')", ("clip_rows",))
def j_split_leak(spark, d):
    return A.split_leak(V.clip_rows(spark, d)).select("camera", F.array_join("splits", ",").alias("splits"))


@C.add("set_shared_cameras", "SELECT camera FROM clip_rows WHERE split = 'train' INTERSECT SELECT camera FROM clip_rows WHERE split = 'test'", ("clip_rows",))
def set_shared_cameras(spark, d):
    return A.shared_cameras(V.clip_rows(spark, d), "train", "test")


@C.add("agg_split_audit", """
SELECT 'leak' AS rule, CAST(camera AS VARCHAR) AS subject, string_agg(split, ',' ORDER BY split) AS detail FROM (SELECT DISTINCT camera, split FROM clip_rows) GROUP BY camera HAVING count(*) > 1 AND bool_or(split = 'train')
UNION ALL SELECT 'few_cameras', split, CAST(count(DISTINCT camera) AS VARCHAR) FROM clip_rows GROUP BY split HAVING count(DISTINCT camera) < 2
UNION ALL SELECT 'one_camera', split, CAST(camera AS VARCHAR) FROM (SELECT split, camera, count(*) / sum(count(*)) OVER (PARTITION BY split) AS s FROM clip_rows GROUP BY 1, 2) WHERE s > 5e-1
UNION ALL SELECT 'cameras', 'all', CAST(count(DISTINCT camera) AS VARCHAR) FROM clip_rows""", ("clip_rows",))
def agg_split_audit(spark, d):
    return A.split_audit(V.clip_rows(spark, d))


@C.add("j_unpaired", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 3000)
SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def j_unpaired(spark, d):
    o, c = V.table(spark, d, "orders").where("o_totalprice > 200000"), V.table(spark, d, "customer").where("c_acctbal > 3000")
    return A.unpaired(o.select(F.col("o_custkey").alias("k")), c.select(F.col("c_custkey").alias("k")), "k")


@C.add("set_missing", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_missing(spark, d):
    o, c = V.table(spark, d, "orders").where("o_totalprice > 200000"), V.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("k")).join(o.select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@C.add("set_union_splits", "SELECT clip, 'train' AS part FROM clip_rows WHERE split = 'train' UNION ALL SELECT clip, 'rest' FROM clip_rows WHERE split <> 'train'", ("clip_rows",))
def set_union_splits(spark, d):
    c = V.clip_rows(spark, d)
    return c.where("split = 'train'").select("clip", F.lit("train").alias("part")).unionByName(c.where("split <> 'train'").select("clip", F.lit("rest").alias("part")))


@C.add("j_split_assign", "SELECT clip, camera, CASE WHEN camera % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM clip_rows WHERE camera < 20 AND camera <> 5", ("clip_rows",))
def j_split_assign(spark, d):
    c = V.clip_rows(spark, d).select("clip", "camera")
    cams = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("camera")).where("camera < 20").withColumn("split", F.when(F.col("camera") % 3 == 0, "test").otherwise("train"))
    return A.assign_split(c, cams, cams.where("camera = 5"))[0].select("clip", "camera", "split")


_CP = "SELECT CASE WHEN image % 5 = 0 THEN 'test' ELSE 'train' END AS split, camera, gt AS class, n FROM label_counts"


def _cp(spark, d):
    return V.label_counts(spark, d).select(F.when(F.col("image") % 5 == 0, "test").otherwise("train").alias("split"), "camera", F.col("gt").alias("class"), "n", "image")


@C.add("agg_class_pixels", f"SELECT split, camera, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT class) AS classes, CAST(grouping_id(split, camera) AS BIGINT) AS level FROM ({_CP}) GROUP BY ROLLUP (split, camera)", ("label_counts",))
def agg_class_pixels(spark, d):
    return A.class_pixels(_cp(spark, d)).withColumn("level", F.col("level").cast("bigint"))


@C.add("agg_coverage", f"SELECT class, round(sum(n) FILTER (split = 'train') / (SELECT sum(n) FROM ({_CP}) WHERE split = 'train'), 6) AS train, round(sum(n) FILTER (split = 'test') / (SELECT sum(n) FROM ({_CP}) WHERE split = 'test'), 6) AS test FROM ({_CP}) GROUP BY 1", ("label_counts",))
def agg_coverage(spark, d):
    return _r(A.coverage(_cp(spark, d), ["train", "test"]), "train", "test")


@C.add("agg_qa_counts", f"SELECT split, camera, CAST(sum(n) AS BIGINT) AS pixels, count(*) AS rows FROM ({_CP}) GROUP BY 1, 2", ("label_counts",))
def agg_qa_counts(spark, d):
    return _cp(spark, d).groupBy("split", "camera").agg(F.sum("n").alias("pixels"), F.count("*").alias("rows"))


_IM = "SELECT l_orderkey AS image, CASE WHEN l_linenumber % 4 = 0 THEN 255 ELSE l_partkey % 9 END AS class, CAST(l_quantity AS BIGINT) AS n FROM lineitem"


@C.add("agg_dataset_audit", f"""
WITH i AS ({_IM}), c AS (SELECT image, class, n FROM i), p AS (SELECT image, sum(n) AS t, coalesce(sum(n) FILTER (class <> 255), 0) AS l, max(n) FILTER (class <> 255) AS m FROM c GROUP BY 1)
SELECT DISTINCT image, 'outside_taxonomy' AS problem FROM c WHERE class <> 255 AND class >= 8 UNION ALL SELECT image, 'hardly_labelled' FROM p WHERE l < 5e-2 * t UNION ALL SELECT image, 'one_class' FROM p WHERE l > 0 AND m > 97e-2 * l""")
def agg_dataset_audit(spark, d):
    li = V.table(spark, d, "lineitem")
    im = li.select(F.col("l_orderkey").alias("image"), F.when(F.col("l_linenumber") % 4 == 0, 255).otherwise(F.col("l_partkey") % 9).alias("class"), F.col("l_quantity").cast("bigint").alias("n"))
    tax = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("class")).where("class < 8")
    return A.dataset_audit(im, tax)


@C.add("agg_duplicates", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def agg_duplicates(spark, d):
    return A.duplicates(V.table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("file"), F.md5(F.col("text").cast("binary")).alias("digest")))


@C.add("agg_fingerprint", """, n AS (SELECT split, clip, 'clip' || clip || ':' || clip AS line, CAST(('0x' || left(sha256('clip' || clip), 3)) AS BIGINT) AS part FROM clip_rows), p AS (SELECT split, part, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM n GROUP BY 1, 2),
q AS (SELECT split, sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part)) AS digest FROM p GROUP BY 1) SELECT n.split, count(*) AS files, CAST(sum(clip) AS BIGINT) AS bytes, any_value(digest) AS digest FROM n JOIN q ON n.split = q.split GROUP BY 1""", ("clip_rows",))
def agg_fingerprint(spark, d):
    f = V.clip_rows(spark, d).select("split", F.concat(F.lit("clip"), F.col("clip").cast("string")).alias("name"), F.col("clip").alias("size"))
    return A.fingerprint(f, "split")


@C.add("sel_hash_split", "SELECT c_custkey AS clip, CASE WHEN CAST(('0x' || left(sha1('clip' || c_custkey), 8)) AS BIGINT) / 4294967295e0 < 2e-1 THEN 'test' ELSE 'train' END AS split FROM customer")
def sel_hash_split(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("clip"), A.hash_split(F.concat(F.lit("clip"), F.col("c_custkey").cast("string")), 0.2).alias("split"))


@C.add("sel_crop_curation", """
WITH r AS (SELECT c_custkey AS person, c_nationkey AS camera, c_custkey % 17 + 1 AS crops FROM customer), t AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY crops DESC, person) AS turn FROM r)
SELECT person, camera, crops, turn, coalesce(sum(crops) OVER (ORDER BY turn, camera, person ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500 AS taken FROM t""")
def sel_crop_curation(spark, d):
    p = V.table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("camera"), (F.col("c_custkey") % 17 + 1).alias("crops"))
    return A.crop_curation(p, 500)


@C.add("sel_camera_move", "SELECT clip, camera, split, row_number() OVER (PARTITION BY split ORDER BY camera, clip) AS new_id FROM (SELECT clip, camera, CASE WHEN camera IN (3, 4) THEN 'train' ELSE split END AS split FROM clip_rows)", ("clip_rows",))
def sel_camera_move(spark, d):
    return A.camera_move(V.clip_rows(spark, d).drop("bytes"), [3, 4], "train")


@C.add("j_clip_camera", """
WITH c AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'cam' || c_nationkey || '__' || c_custkey ELSE 'clip' || (c_custkey % 400) END AS clip, c_custkey AS k, c_nationkey AS n FROM customer),
m AS (SELECT clip, count(DISTINCT n) AS u, any_value('cam' || n) AS one FROM c WHERE k % 4 <> 0 AND k % 400 < 300 GROUP BY 1)
SELECT DISTINCT c.clip, CASE WHEN c.clip LIKE '%\\_\\_%' ESCAPE '\\' THEN split_part(c.clip, '__', 1) WHEN u = 1 THEN one WHEN u > 1 THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END AS camera FROM c LEFT JOIN m ON c.clip = m.clip""")
def j_clip_camera(spark, d):
    k, cam = F.col("c_custkey"), F.concat(F.lit("cam"), F.col("c_nationkey").cast("string"))
    c = V.table(spark, d, "customer").select(F.when(k % 4 == 0, F.concat_ws("__", cam, k.cast("string"))).otherwise(F.concat(F.lit("clip"), (k % 400).cast("string"))).alias("clip"), cam.alias("camera"), k.alias("k"))
    return A.clip_camera(c.select("clip"), c.where("k % 4 <> 0 AND k % 400 < 300").select("clip", "camera")).distinct()


@C.add("agg_retention", "SELECT l_returnflag AS tier, count(*) AS examined, count(*) FILTER (l_partkey % 90 > 30) AS over_age, CAST(sum(CASE WHEN l_partkey % 90 > 30 AND l_linenumber <> 1 THEN l_suppkey ELSE 0 END) AS BIGINT) AS bytes, count(*) FILTER (l_partkey % 90 > 30 AND l_linenumber = 1) AS refused FROM lineitem GROUP BY 1")
def agg_retention(spark, d):
    li = V.table(spark, d, "lineitem")
    return A.retention(li.select(F.col("l_returnflag").alias("tier"), (F.col("l_partkey") % 90).alias("age_days"), F.col("l_suppkey").alias("bytes"), (F.col("l_linenumber") == 1).alias("tracked")), 30)


_TA = "SELECT user_id AS track, event_type AS attribute, avg(value - 5e1) / 1e1 AS mean, count(*) AS n, avg(CASE WHEN value > 5e1 THEN 1e0 ELSE 0e0 END) AS up FROM events GROUP BY 1, 2"


def _ta(spark, d):
    return A.track_attributes(V.table(spark, d, "events").select(F.col("user_id").alias("track"), F.col("event_type").alias("attribute"), ((F.col("value") - 50) / 10).alias("logit")))


@C.add("agg_track_attributes", f"SELECT track, attribute, n, CASE WHEN n >= 3 THEN round(1 / (1 + exp(-mean)), 5) END AS probability, CASE WHEN n >= 3 THEN round(CASE WHEN mean > 0 THEN up ELSE 1 - up END, 6) END AS agreement FROM ({_TA})")
def agg_track_attributes(spark, d):
    return _ta(spark, d).withColumns({"probability": F.round("probability", 5), "agreement": F.round("agreement", 6)})


@C.add("agg_age_band", f"SELECT track, arg_max(attribute, mean) AS band FROM ({_TA}) WHERE n >= 3 GROUP BY 1")
def agg_age_band(spark, d):
    return A.arg_band(_ta(spark, d))


@C.add("agg_staff_verdict", "SELECT user_id AS track, count(*) AS n, CASE WHEN count(*) >= 6 THEN median(value / 1e2) >= 5e-1 END AS staff FROM events GROUP BY 1")
def agg_staff_verdict(spark, d):
    return A.staff_verdict(V.table(spark, d, "events").select(F.col("user_id").alias("track"), (F.col("value") / 100).alias("p")))


@C.add("staff_probability", "SELECT event_id, round(1 / (1 + exp(-((value - 5e1) / 2e1 * 7e-1 + (event_id % 10 - 45e-1) / 3e0 * -4e-1 + 1e-1))), 6) AS p FROM events")
def staff_probability(spark, d):
    e = V.table(spark, d, "events").withColumn("f", F.array(F.col("value"), (F.col("event_id") % 10).cast("double")))
    return e.select("event_id", F.round(A.staff_probability(F.col("f"), [50.0, 4.5], [20.0, 3.0], [0.7, -0.4], 0.1), 6).alias("p"))


_LATEST = "SELECT a.alert_id, coalesce(s, 'unreviewed') AS status FROM alerts a LEFT JOIN (SELECT alert_id, arg_max(status, (ts, line_no)) AS s FROM dispositions GROUP BY 1) d ON a.alert_id = d.alert_id"


@C.add("win_latest_verdict", _LATEST, ("alerts", "dispositions"))
def win_latest_verdict(spark, d):
    return A.latest_verdicts(V.alerts(spark, d), V.dispositions(spark, d))


@C.add("agg_disposition_counts", f"SELECT status, count(*) AS n FROM ({_LATEST}) GROUP BY 1", ("alerts", "dispositions"))
def agg_disposition_counts(spark, d):
    return A.latest_verdicts(V.alerts(spark, d), V.dispositions(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@C.add("j_alert_exists", "SELECT alert_id, line_no, alert_id IN (SELECT alert_id FROM alerts WHERE alert_id % 4 <> 0) AS accepted FROM dispositions", ("alerts", "dispositions"))
def j_alert_exists(spark, d):
    yes, no = A.known_dispositions(V.alerts(spark, d).where("alert_id % 4 <> 0"), V.dispositions(spark, d))
    return yes.select("alert_id", "line_no", F.lit(True).alias("accepted")).unionByName(no.select("alert_id", "line_no", F.lit(False).alias("accepted")))


@C.add("agg_fleet_report", """
WITH f AS (SELECT user_id % 50 AS camera_id, event_id % 1000 AS seq, CAST(epoch(ts) AS BIGINT) AS t FROM events), r AS (SELECT *, CASE WHEN seq <= lag(seq) OVER (PARTITION BY camera_id ORDER BY t, seq) THEN 1 ELSE 0 END AS r FROM f)
SELECT camera_id, count(*) AS frames, CAST(sum(r) AS BIGINT) AS reconnects, CASE WHEN 1706742000 - max(t) > 20000 THEN 'stalled' ELSE 'live' END AS state FROM r GROUP BY 1""")
def agg_fleet_report(spark, d):
    f = V.table(spark, d, "events").select((F.col("user_id") % 50).alias("camera_id"), (F.col("event_id") % 1000).alias("seq"), F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("at"))
    return A.fleet_report(f, 1706742000, 20000)
