"""Operators on small frames with known answers."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewatch.functions import geometry as G
from aislewatch.functions import labels as L
from aislewatch.operators import assignment as N
from aislewatch.operators import audits as A
from aislewatch.operators import events as E
from aislewatch.operators import metrics as M
from aislewatch.operators import ordering as O
from aislewatch.operators import retail as R
from aislewatch.operators import tracks as T
from aislewatch.sources import cameras, logs

OBS = "camera_id long, track_id long, frame_index long, class_name string, score double, x_m double, z_m double, x0 double, y0 double, x1 double, y1 double"
SQUARE = [(-1.0, 3.0), (1.0, 3.0), (1.0, 5.0), (-1.0, 5.0)]


def walk(spark, *tracks, name="person"):
    """Tracks as (id, [(frame, x, z), ...])."""
    rows = [(0, t, f, name, 0.9, x, z, 100.0 + 10 * f, 50.0, 140.0 + 10 * f, 150.0) for t, path in tracks for f, x, z in path]
    return spark.createDataFrame(rows, OBS)


def zone(spark, **policy):
    p = {"max_occupancy": 1, "loiter_seconds": 1.0, "restricted": True} | policy
    return spark.createDataFrame([(0, "till", SQUARE, p["max_occupancy"], p["loiter_seconds"], p["restricted"])], "camera_id long, zone string, polygon array<struct<x double, z double>>, max_occupancy int, loiter_seconds double, restricted boolean")


def test_loitering_counts_observations_not_frames(spark):
    path = [(0, 0.0, 4.0), (1, 0.0, 4.0), (6, 0.0, 4.0), (7, 9.0, 9.0), (8, 0.0, 4.0)]
    got = [(r.frame_start, r.frame_end, r.value) for r in E.loitering(walk(spark, (1, path)), zone(spark), fps=5).collect()]
    assert got == [(0, 6, 1.4)]


def test_unmeasured_position_is_outside(spark):
    path = [(0, 0.0, 4.0), (1, float("nan"), 4.0), (2, None, None), (3, 0.0, 4.0)]
    inside = {r.frame_index: r.inside for r in E.in_zones(walk(spark, (1, path)), zone(spark)).collect()}
    assert inside == {0: True, 1: False, 2: False, 3: True}


def test_zone_needs_three_corners(spark):
    bad = zone(spark).withColumn("polygon", F.slice("polygon", 1, 2))
    with pytest.raises(Exception, match="three corners"):
        E.in_zones(walk(spark, (1, [(0, 0.0, 4.0)])), bad).collect()


def test_occupancy_ends_with_a_missing_frame(spark):
    two = [(f, 0.0, 4.0) for f in (0, 1, 2, 4)]
    got = E.occupancy_exceeded(walk(spark, (1, two), (2, two)), zone(spark), fps=1, min_seconds=2).collect()
    assert [(r.frame_start, r.frame_end, r.value) for r in got] == [(0, 2, 2.0)]


def test_line_direction_and_segment_end(spark):
    line = spark.createDataFrame([(0, "gate", 0.0, 1.0, 0.0, 5.0)], "camera_id long, line string, ax double, az double, bx double, bz double")
    over = walk(spark, (1, [(0, 1.0, 2.0), (1, -1.0, 2.0)]), (2, [(0, -1.0, 3.0), (2, 1.0, 3.0)]), (3, [(0, 1.0, 7.0), (1, -1.0, 7.0)]), (4, [(0, 0.0, 2.0), (1, -1.0, 2.0)]))
    got = {r.track_id: (r.direction, r.frame_start, r.frame_end) for r in E.line_crossings(over, line).collect()}
    assert got == {1: ("in", 0, 1), 2: ("out", 0, 2)}
    pair = walk(spark, (1, [(0, 1.0, 2.0), (1, -1.0, 2.0)]), (2, [(3, 1.0, 2.0), (4, -1.0, 2.0)]))
    assert [(r.first_track, r.second_track, r.value) for r in E.tailgating(pair, line, fps=5).collect()] == [(1, 2, 0.6)]


def test_running_and_crowd(spark):
    fast = walk(spark, (1, [(f, 0.6 * f, 2.0) for f in range(10)]), (2, [(f, 0.1 * f, 2.0) for f in range(10)]))
    assert {r.track_id for r in E.running(fast, fps=5).collect()} == {1}
    crowd = walk(spark, *[(t, [(f, 0.1 * t, 2.0) for f in range(30)]) for t in range(4)], (9, [(f, 50.0, 2.0) for f in range(30)]))
    assert [(r.frame_start, r.frame_end, r.value) for r in E.crowd_forming(crowd, fps=5).collect()] == [(0, 29, 4.0)]


def test_object_left_and_its_owner(spark):
    bag = walk(spark, (1, [(f, 0.0, 4.0) for f in range(160)]), name="bag")
    far, near = walk(spark, (2, [(80, 5.0, 4.0)])), walk(spark, (2, [(80, 1.0, 4.0)]))
    assert [r.nearest for r in E.object_left(bag.unionByName(far), fps=5).collect()] == [5.0]
    assert E.object_left(bag.unionByName(near), fps=5).count() == 0
    assert [r.nearest for r in E.object_left(bag, fps=5).collect()] == [None]


def test_stock_removed_skips_the_hold(spark):
    counts = [5] * 6 + [3] * 6 + [1] * 6
    df = spark.createDataFrame([(0, "shelf", f, n) for f, n in enumerate(counts)], "camera_id long, zone string, frame_index long, n int")
    assert [(r.frame_start, r.value) for r in E.stock_removed(df, fps=1, hold_seconds=4).orderBy("frame_start").collect()] == [(6, 2.0), (12, 2.0)]


def test_visit_hysteresis(spark):
    z = zone(spark)
    inside, out = (0.0, 4.0), (9.0, 9.0)
    short = walk(spark, (1, [(f, *(out if f in (10, 11) else inside)) for f in range(20)]))
    assert [(r.frame_start, r.frame_end, r.observed) for r in R.visits(short, z, fps=5).collect()] == [(0, 19, 20)]
    long = walk(spark, (1, [(f, *(out if 10 <= f < 16 else inside)) for f in range(30)]))
    assert sorted((r.frame_start, r.frame_end, r.observed) for r in R.visits(long, z, fps=5).collect()) == [(0, 9, 10), (16, 29, 14)]
    gap = walk(spark, (1, [(f, *inside) for f in (*range(5), *range(50, 55))]))
    assert [(r.frame_start, r.frame_end) for r in R.visits(gap, z, fps=5).collect()] == [(0, 54)]
    j = R.journeys(long, z, fps=5).collect()[0]
    assert list(j.route) == ["till", "till"] and abs(j.path_m - 2 * math.hypot(9, 5)) < 1e-9
    assert all(r.seconds is None for r in R.visits(short, z, fps=None).collect())


CAM = {"fx": 382.7, "fy": 382.7, "cx": 480.0, "cy": 270.0, "height": 2.49, "pitch": math.radians(49.5), "roll": 0.03}


def test_projection_is_its_own_inverse(spark):
    cam = F.struct(*[F.lit(v).alias(k) for k, v in CAM.items()])
    df = spark.createDataFrame([(0.0, 3.0), (1.5, 4.0), (-2.0, 6.5)], "x double, z double").withColumn("p", G.ground_to_pixel(F.col("x"), F.col("z"), cam))
    for r in df.withColumn("g", G.pixel_to_ground(F.col("p.u"), F.col("p.v"), cam)).collect():
        assert abs(r.g.x - r.x) < 1e-9 and abs(r.g.z - r.z) < 1e-9
    sky = spark.range(1).select(G.pixel_to_ground(F.lit(480.0), F.lit(-5000.0), cam).alias("g")).first().g
    assert sky.x is None and sky.z is None
    level = F.struct(*[F.lit(0.0 if k == "roll" else v).alias(k) for k, v in CAM.items()])
    v = G.pixel_row_at_height(F.lit(1.7), F.lit(0.5), F.lit(4.0), level)
    assert abs(spark.range(1).select(G.height_above_floor(v, F.lit(0.5), F.lit(4.0), level).alias("h")).first().h - 1.7) < 1e-9


def test_best_assignment_is_optimal():
    r = np.random.default_rng(1)
    for n, m in ((3, 3), (2, 5), (5, 2), (4, 4)):
        v = r.integers(0, 20, (n, m)).astype(float)
        got = sum(v[i, j] for i, j in N.best_assignment(v))
        small, large = min(n, m), max(n, m)
        w = v if n <= m else v.T
        assert got == max(sum(w[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))


def test_identity_metrics(spark):
    t = [(0, g, f, 100.0 * g, 0.0, 100.0 * g + 50, 100.0) for g in (1, 2) for f in range(10)]
    truth = spark.createDataFrame(t, "camera_id long, gt_id long, frame_index long, x0 double, y0 double, x1 double, y1 double")
    pred = truth.withColumn("pred_id", F.when((F.col("gt_id") == 1) & (F.col("frame_index") >= 6), 9).otherwise(F.col("gt_id"))).withColumn("score", F.lit(0.5)).drop("gt_id")
    r = M.idf1(truth, pred).first()
    assert (r.idtp, r.idfp, r.idfn, r.idf1) == (16, 4, 4, 0.8)
    s = M.id_switches(truth, pred).first()
    assert (s.switches, s.tracks_per_identity, s.mostly_tracked) == (1, 1.5, 1)
    ap = M.mean_precision(M.average_precision(truth, pred.withColumn("score", F.col("frame_index") / 10))).first()
    assert ap.map == 1.0 and ap.map50 == 1.0


def test_sparse_total_is_optimal():
    r = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 9), (9, 4), (12, 12)):
        for share in (0.2, 0.5, 1.0):
            v = r.integers(1, 20, (n, m)) * (r.random((n, m)) < share)
            v[0, 0] = 7
            i, j = np.nonzero(v)
            assert N.sparse_total(i, j, v[i, j].astype(float)) == sum(v[a, b] for a, b in N.best_assignment(v.astype(float)))


def grouped(monkeypatch):
    """Column lists that pandas functions are given groups of."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, plain = [], DataFrame.groupBy
    monkeypatch.setattr(DataFrame, "groupBy", lambda self, *c: seen.append(c) or plain(self, *c))
    return seen


def test_identities_that_nothing_links_are_assigned_apart(spark):
    chain = [(0, g, g + d, 3) for g in range(1, 40) for d in (100, 101)] + [(0, 500, 900, 2), (1, 1, 101, 4)]
    hits = spark.createDataFrame(chain, "camera_id long, gt_id long, pred_id long, hits long")
    got = M.identity_groups(hits)
    assert got.count() == len(chain)
    assert sorted(tuple(r) for r in got.select("camera_id", "part").distinct().collect()) == [(0, 1), (0, 500), (1, 1)]


def test_frames_and_classes_are_groups(spark, monkeypatch):
    seen = grouped(monkeypatch)
    rows = [(1, 0, 0, "a", 0.9, 0.0, 0.0, 10.0, 10.0)]
    det = spark.createDataFrame(rows, "det_id long, camera_id long, frame_index long, class_name string, score double, x0 double, y0 double, x1 double, y1 double")
    T.suppress(det)
    assert seen[-1] == ("camera_id", "frame_index", "class_name")
    M.average_precision(det.withColumnRenamed("det_id", "gt_id"), det.withColumnRenamed("det_id", "pred_id"))
    assert ("camera_id", "_b") in seen  # 64 frames of a camera


def test_farthest_first(spark):
    rows = [("a", 1, [0.0, 0.0]), ("a", 2, [0.0, 0.0]), ("a", 3, [9.0, 0.0]), ("a", 4, [4.0, 0.0]), (None, 7, [1.0, 1.0]), (None, 8, [1.0, 1.0])]
    got = T.farthest_first(spark.createDataFrame(rows, "clip string, item long, feat array<double>"), 4, "clip")
    assert sorted((r.clip or "", r.place, r.item) for r in got.collect()) == [("", 0, 7), ("", 1, 8), ("a", 0, 1), ("a", 1, 3), ("a", 2, 4), ("a", 3, 2)]


def test_tracker_is_independent_of_order(spark):
    rows = [(f * 10 + t, 0, f, "person", 0.9, 300.0 * t + 5 * f, 0.0, 300.0 * t + 5 * f + 60, 100.0) for f in (*range(8), *range(40, 48)) for t in range(3)]
    det = spark.createDataFrame(rows, "det_id long, camera_id long, frame_index long, class_name string, score double, x0 double, y0 double, x1 double, y1 double")
    got = T.track_boxes(det, max_age=10)
    keys = {(r.track_key, r.det_id % 10) for r in got.collect()}
    assert len({k for k, _ in keys}) == 6 and len(keys) == 6 and all(r.confirmed for r in got.collect())
    assert sorted(got.collect()) == sorted(T.track_boxes(det.repartition(5), max_age=10).collect())


def test_stitch_chain(spark):
    c = spark.createDataFrame([(0, 1, 2, 1, 0.1), (0, 2, 3, 1, 0.2), (0, 1, 3, 5, 0.3), (0, 4, 2, 1, 0.05)], "camera_id long, a_id long, b_id long, gap long, score double")
    kept = T.stitch_greedy(c)
    assert sorted((r.a_id, r.b_id) for r in kept.collect()) == [(2, 3), (4, 2)]
    assert sorted((r.track_id, r.head) for r in T.chains(kept).collect()) == [(2, 4), (3, 4), (4, 4)]


def test_stitch_takes_every_tied_pair(spark):
    c = spark.range(50).select(F.lit(0).cast("long").alias("camera_id"), F.col("id").alias("a_id")).crossJoin(spark.range(100, 150).select(F.col("id").alias("b_id"))).selectExpr("*", "1L AS gap", "0.1D AS score")
    kept = T.stitch_greedy(c).collect()
    assert len(kept) == len({r.a_id for r in kept}) == len({r.b_id for r in kept}) == 50


def test_stitch_descending_scores(spark):
    # a_id i may go on as i or i + 1, each candidate a little better than the one before: one is taken a round
    rows = [(0, i, 100 + i + k, 1, 1.0 - (2 * i + k) / 100) for i in range(25) for k in (0, 1)]
    kept = T.stitch_greedy(spark.createDataFrame(rows, "camera_id long, a_id long, b_id long, gap long, score double"))
    assert sorted((r.a_id, r.b_id) for r in kept.collect()) == [(i, 101 + i) for i in range(25)]


def test_chain_of_many_fragments(spark):
    links = spark.range(5000).select(F.lit(0).cast("long").alias("camera_id"), F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"))
    got = T.chains(links)
    assert got.count() == 5001 and [r.head for r in got.select("head").distinct().collect()] == [0]
    with pytest.raises(ValueError, match="ring"):
        T.chains(spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "camera_id long, a_id long, b_id long"))


def test_nms(spark):
    rows = [(1, 0, 0, "a", 0.9, 0.0, 0.0, 10.0, 10.0), (2, 0, 0, "a", 0.8, 1.0, 0.0, 11.0, 10.0), (3, 0, 0, "b", 0.7, 1.0, 0.0, 11.0, 10.0), (4, 0, 1, "a", 0.8, 1.0, 0.0, 11.0, 10.0)]
    det = spark.createDataFrame(rows, "det_id long, camera_id long, frame_index long, class_name string, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.det_id for r in T.suppress(det).collect()) == [1, 3, 4]


def test_pose(spark):
    up = [(0.0, 0.0, 0.9)] * 17
    up = [(*({5: (10, 20), 6: (20, 20), 11: (10, 60), 12: (20, 60), 15: (10, 120), 16: (20, 120)}.get(k, (0, 0))), 0.9) for k in range(17)]
    lying = [(*({5: (50, 60), 6: (50, 60), 11: (10, 60), 12: (10, 60)}.get(k, (0, 0))), 0.9) for k in range(17)]
    none = [(0, 0, 0.1)] * 17
    df = spark.createDataFrame([(0, [tuple(map(float, p)) for p in up]), (1, [tuple(map(float, p)) for p in lying]), (2, [tuple(map(float, p)) for p in none])], "id long, k array<struct<x double, y double, conf double>>")
    got = {r.id: r.t for r in df.select("id", L.torso(F.col("k")).alias("t")).collect()}
    assert got[0].angle == 0 and got[0].hip_ankle == 60 and got[0].length == 40 and got[1].angle == 90 and got[2].angle is None
    f = df.select("id", L.frame_features(F.col("k")).alias("features"), F.col("id").alias("frame_index"), F.lit(1).alias("g"))
    s = {r.id: r.features for r in L.sequence_features(f, "features", "g").collect()}
    assert len(s[0]) == 106 and all(v == 0 for v in s[0][53:]) and all(v == 0 for v in s[2][:36])


def test_thresholds_need_a_basis(spark):
    cams = spark.createDataFrame([(1,)], "camera_id long")
    d = spark.createDataFrame([("person", 0.5, 0.2)], "class_name string, birth double, keep double")
    o = spark.createDataFrame([(1, "person", 0.4, 0.1, " ")], "camera_id long, class_name string, birth double, keep double, basis string")
    with pytest.raises(Exception, match="basis"):
        L.with_overrides(d, o, cams).collect()


def camera_file(**other):
    zones = [{"name": "w", "kind": "walkable", "points_m": [list(p) for p in SQUARE]}, {"name": "l", "kind": "entrance_line", "points_m": [[0, 1], [0, 2]]}]
    return {"schema_version": 3, "camera_id": "c1", "image_size_px": [960, 540], "camera": {"fx": 382.7, "fy": 382.7, "cx": 480, "cy": 270}, "plane": {"height_m": 2.49, "pitch": 0.86, "roll": 0.0}, "zones": zones, "mask_ignore": 255} | other


def test_camera_files(spark, tmp_path):
    bad = {
        "c2": {"schema_version": 4, "plane": {"height_m": -1, "pitch": 49.3, "roll": 0}, "zones": [{"name": "l", "kind": "entrance_line", "points_m": [[0, 1]]}]},
        "c3": {"camera": {"fx": 382.7, "fy": 0, "cx": 960, "cy": 270}, "zones": [{"name": "s", "kind": "shelf", "points_m": [[0, 1], [1, 1], [1, 2]]}], "shelf_rois_px": [[10, 10, 5, 20]]},
        "c4": {"lens": {"k1": -1.05, "centre_px": [2000, 10], "radius_px": 1.0}, "mask_ignore": 0},
    }
    for name, x in {"c1": {}, **bad}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(camera_file(camera_id=name, **x), indent=1))
    c = cameras.read_cameras(spark, str(tmp_path))
    assert {r.camera_id: set(r.problems) for r in c.collect()} == {
        "c1": set(), "c2": {"schema_version", "height_m", "pitch", "zone points"}, "c3": {"fy", "principal point", "zone kind", "shelf_rois_px"}, "c4": {"lens k1", "lens centre", "lens radius", "mask_ignore"}}
    good = cameras.usable(c)
    assert [r.zone for r in cameras.zones_of(good).collect()] == ["w"] and [(r.ax, r.az, r.bx, r.bz) for r in cameras.lines_of(good).collect()] == [(0.0, 1.0, 0.0, 2.0)]
    with pytest.raises(Exception, match="two points"):
        cameras.lines_of(c.where("camera_id = 'c2'")).collect()
    b = {r.camera_id: (r.x_lo, r.x_hi, r.z_lo, r.z_hi) for r in cameras.walkable_bounds(c).collect()}
    xs, zs = [p[0] for p in SQUARE], [p[1] for p in SQUARE]
    assert b["c1"] == (min(xs) - 2, max(xs) + 2, max(0.0, min(zs) - 2), max(zs) + 2) and b["c3"] == (-12.0, 12.0, 0.0, 14.0)
    cameras.write_cameras(good, str(tmp_path / "out"))
    again = cameras.read_cameras(spark, str(tmp_path / "out"), lines=True).collect()
    assert [(r.camera_id, r.problems) for r in again] == [("c1", [])]


def test_points_of_cameras(spark, tmp_path):
    (tmp_path / "c1.json").write_text(json.dumps(camera_file(false_positive_polygons_px=[[[0, 0], [64, 0], [64, 64], [0, 64]]])))
    c = cameras.read_cameras(spark, str(tmp_path))
    p = spark.createDataFrame([("c1", 10.0, 10.0), ("c1", 480.0, 500.0), ("c1", 3000.0, 10.0)], "camera_id string, u double, v double")
    assert [r.vetoed for r in cameras.in_fp_zone(p, c).orderBy("u").collect()] == [True, False, False]
    taken, refused = cameras.to_calibrated(p, c)
    assert taken.count() == 0 and refused.count() == 3
    scaled, none = cameras.to_calibrated(p, c, (1920, 1080))
    assert sorted(r.u for r in scaled.collect()) == [5.0, 240.0, 1500.0] and none.count() == 0
    up = spark.createDataFrame([("c1", 480.0, -5000.0)], "camera_id string, u double, v double")
    assert cameras.ground_points(up, c, "drop").count() == 0
    with pytest.raises(Exception, match="horizon"):
        cameras.ground_points(up, c, "raise").collect()
    with pytest.raises(ValueError):
        cameras.ground_points(up, c, "keep")


def test_alert_log(spark, tmp_path):
    rows = [{"schema_version": 1, "kind": "alert", "alert_id": "a", "at": "2024-01-01T00:00:00Z"}, {"schema_version": 2, "kind": "alert", "alert_id": "b", "at": "2024-01-01T00:00:00Z"}, {"schema_version": 1, "kind": "note", "alert_id": "c", "at": "2024-01-01T00:00:00Z"}, {"schema_version": 1, "kind": "alert"}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "2024-01-01.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken", ""]))
    good, corrupt = logs.read_alert_log(spark, str(tmp_path / "log"))
    assert [r.alert_id for r in good.collect()] == ["a"]
    assert sorted(r.reason for r in corrupt.collect()) == ["missing field", "newer schema", "not JSON", "unknown kind"]
    logs.append_alert_log(good.drop("file"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().alert_id == "a"


def test_other_sources(spark, tmp_path):
    (tmp_path / "cam.json").write_text(json.dumps({"7": {"0": [0, 1, 2, 3], "5": [1, 1, 2, 3]}}))
    t = logs.read_tracks(spark, str(tmp_path / "cam.json"))
    assert sorted((r.camera_id, r.track_id, r.frame_index, r.x0) for r in t.collect()) == [("cam", 7, 0, 0.0), ("cam", 7, 5, 1.0)]
    assert json.loads(logs.tracks_json(t).first().json) == {"0": [0, 1, 2, 3], "5": [1, 1, 2, 3]}
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "metrics.jsonl").write_text('{"epoch": 3, "miou": 0.5, "note": "x"}\n')
    assert [tuple(r) for r in logs.read_metrics(spark, str(tmp_path / "run1" / "metrics.jsonl")).collect()] == [("run1", 3, "miou", 0.5)]
    (tmp_path / "m.json").write_text(json.dumps({"pulled": [{"camera": "c1", "clips": [{"uri": "s/a/clip1.mp4"}, {"uri": "clip2.mp4"}]}]}))
    assert [tuple(r) for r in logs.read_clip_manifest(spark, str(tmp_path / "m.json")).collect()] == [("c1", "clip1.mp4"), ("c1", "clip2.mp4")]
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 9, "height": 9}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [0, 0, 3, 3], "area": 9, "iscrowd": 0}], "categories": [{"id": 2, "name": "person"}]}
    (tmp_path / "coco.json").write_text(json.dumps(coco))
    assert [(r.file_name, r.category) for r in logs.read_coco(spark, str(tmp_path / "coco.json"))[1].collect()] == [("a.jpg", "person")]


def test_audits(spark):
    c = spark.createDataFrame([(1, "train"), (1, "val"), (2, "train"), (3, "val"), (3, "test")], "camera long, split string")
    assert [(r.camera, list(r.splits)) for r in A.split_leak(c).collect()] == [(1, ["train", "val"])]
    alerts = spark.createDataFrame([(1,), (2,), (3,)], "alert_id long")
    d = spark.createDataFrame([(1, "confirmed", 1, 1), (1, "rejected", 1, 2), (2, "confirmed", 5, 1), (9, "confirmed", 1, 1)], "alert_id long, status string, ts long, line_no long")
    assert {r.alert_id: r.status for r in A.latest_verdicts(alerts, d).collect()} == {1: "rejected", 2: "confirmed", 3: "unreviewed"}
    assert [r.alert_id for r in A.known_dispositions(alerts, d)[1].collect()] == [9]


def test_drop_static_of_large_and_small_boxes(spark):
    """Boxes 2,000 pixels wide that shift by 130 in turn overlap by 0.88: each comes again. Brute force over mixed sizes agrees."""
    kind = "camera_id long, det_id long, frame_index long, x0 double, y0 double, x1 double, y1 double"
    wide = [(0, f, f, 130.0 * (f % 2), 0.0, 130.0 * (f % 2) + 2000, 900.0) for f in range(8)]
    assert all(r.static for r in T.drop_static(spark.createDataFrame(wide, kind), share=0.3).collect())
    r = np.random.default_rng(3)
    rows = []
    for c, scale in enumerate((3.0, 60.0, 1500.0)):
        spots = r.uniform(0, 6 * scale, (4, 2))
        for f in range(10):
            for x, y in spots + r.normal(0, 0.06 * scale, spots.shape):
                w, h = scale * (1 + r.normal(0, 0.05)), scale * 1.7 * (1 + r.normal(0, 0.05))
                rows.append((c, len(rows), f, float(x - w / 2), float(y - h / 2), float(x + w / 2), float(y + h / 2)))
    got = {x.det_id: x.static for x in T.drop_static(spark.createDataFrame(rows, kind), share=0.4, least=0.75).collect()}
    for a in rows:
        again = {b[2] for b in rows if b[0] == a[0] and b[2] != a[2] and T.pair_iou(np.array([a[3:]]), np.array([b[3:]]))[0, 0] >= 0.75}
        assert got[a[1]] == (len(again) >= 4)
    assert any(got.values()) and not all(got.values())


def test_running_sums_over_one_order(spark):
    """One key holds nearly all rows, another is null; ranges are cut inside keys."""
    r = np.random.default_rng(1)
    rows = [("a" if i % 50 else None if i % 100 else "b", int(x), i, int(v)) for i, (x, v) in enumerate(zip(r.integers(0, 40, 3000), r.integers(0, 9, 3000), strict=True))]
    df = spark.createDataFrame(rows, "k string, x long, id long, v long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {g.id: (g.s, g.n) for g in O.running(df, ["k"], [("x", True), ("id", False)], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    for key in ("a", "b", None):
        total = 0
        for n, (_, _, i, v) in enumerate(sorted((q for q in rows if q[0] == key), key=lambda q: (-q[1], q[2])), 1):
            total += v
            assert got[i] == (total, n)


def test_auc_of_ties(spark):
    r = np.random.default_rng(2)
    rows = [(str(k), int(y), float(x)) for k in range(2) for y, x in zip(r.integers(0, 2, 200), r.integers(0, 6, 200) / 5, strict=True)] + [("one class", 1, 0.5), ("none", None, 0.5)]
    got = {g.k: g.auroc for g in O.rank_auc(spark.createDataFrame(rows, "k string, label int, score double"), "k").collect()}
    for k in ("0", "1"):
        pos, neg = ([x for q, y, x in rows if q == k and y == c] for c in (1, 0))
        assert abs(got[k] - np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])) < 1e-12
    assert got["one class"] is None and got["none"] is None


def test_average_precision_by_class(spark):
    """Against a plain computation: classes, two pictures, a truth that two predictions want, one without any, and a class without predictions."""
    box = lambda x: (float(x), 0.0, float(x) + 10, 10.0)
    truth = [("cat", 0, 0, 1, *box(0)), ("cat", 0, 0, 2, *box(30)), ("cat", 0, 1, 3, *box(0)), ("dog", 0, 0, 4, *box(60)), ("fox", 0, 0, 5, *box(90))]
    pred = [("cat", 0, 0, 10, 0.9, *box(1)), ("cat", 0, 0, 11, 0.8, *box(0)), ("cat", 0, 1, 12, 0.7, *box(50)), ("cat", 0, 0, 13, 0.6, *box(32)), ("dog", 0, 0, 14, 0.5, *box(60)), ("dog", 0, 1, 15, 0.95, *box(60)), ("owl", 0, 0, 16, 0.9, *box(0))]
    t = spark.createDataFrame(truth, "class_name string, camera_id long, frame_index long, gt_id long, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(pred, "class_name string, camera_id long, frame_index long, pred_id long, score double, x0 double, y0 double, x1 double, y1 double")
    got = {(g.class_name, round(g.t, 2)): g.ap for g in M.average_precision(t, p, "class_name").collect()}
    # cat at 0.5: hit, miss, miss, hit of 3 truths: precision 1 up to a recall of 1/3, then 2/4 up to 2/3
    assert abs(got["cat", 0.5] - (34 * 1.0 + 33 * 0.5) / 101) < 1e-12
    # at 0.85 the first cat (0.82) misses and the second takes its truth
    assert abs(got["cat", 0.85] - 34 * 0.5 / 101) < 1e-12
    assert got["dog", 0.95] == 0.5 and got["fox", 0.5] == 0.0 and len(got) == 30 and M.mean_precision(M.average_precision(t, p, "class_name")).first().classes == 3


def test_tracks_in_blocks_are_the_sequential_ones(spark):
    """A camera without a gap of ten blocks, tracks seen on both sides of every seam, some that start or end near one."""
    kind = "det_id long, camera_id long, frame_index long, class_name string, score double, x0 double, y0 double, x1 double, y1 double"
    # the plain prediction carries its errors on over silences, so its persons are seen in every frame; the filter's are not
    for seen, options in ((1.0, {}), (0.9, {"high": 0.5, "low": 0.1, "filtered": True, "assignment": "optimal"})):
        r, rows = np.random.default_rng(12), []
        for p in range(7):
            x, v = 250.0 * p, r.normal(0, 0.1)
            for f in range(int(r.integers(0, 60)), int(r.integers(150, 200))):
                x += v + r.normal(0, 1.5)
                if r.random() < seen:
                    rows.append((len(rows), 0, f, "person", float(r.uniform(0.2, 1)), x, 0.0, x + 60, 140.0))
        rows += [(10_000 + f, 0, f, "person", 0.9, 5000.0, 0.0, 5060.0, 140.0) for f in range(200)]  # so that no frame is empty
        det = spark.createDataFrame(rows, kind)
        whole = {q.det_id: (q.track_key, q.confirmed) for q in T.track_boxes(det, max_age=5, **options).collect()}
        parts = {q.det_id: (q.track_key, q.confirmed) for q in T.track_boxes(det, max_age=5, block=20, overlap=12, **options).collect()}
        assert parts == whole and len({k for k, _ in whole.values()}) >= 8
    with pytest.raises(ValueError, match="longer than its overlap"):
        T.track_boxes(det, max_age=15, block=20)


def test_heights_and_levels(spark):
    samples = spark.createDataFrame([(0, 0.05, 0.9, 3), (0, 0.05, 0.6, 2), (0, 1.0001, 0.5, 4), (0, float("nan"), 0.5, 9), (0, 9.0, 0.1, 1), (1, None, 0.9, 1)], "camera_id long, height double, horiz double, n long")
    got = {(g.camera_id, g.bin): (g.horizontal, g.mid, g.vertical) for g in M.height_histogram(samples).collect()}
    assert got == {(0, 2): (3, 2, 0), (0, 12): (0, 0, 4)}
    exact = M.level_quantiles(samples).collect()
    assert [(g.camera_id, g.pixels) for g in exact] == [(0, 10)] and np.allclose(exact[0].quantiles, np.quantile([0.9] * 3 + [0.6] * 2 + [0.5] * 4 + [0.1], [0.1, 0.25, 0.5, 0.75, 0.9]))
    many = spark.range(20_000).select(F.lit(0).cast("long").alias("camera_id"), F.lit(1.0).alias("height"), (F.col("id") / 20_000).alias("horiz"), F.lit(1).cast("long").alias("n"))
    assert np.allclose(M.level_quantiles(many, sketch=200).first().quantiles, [0.1, 0.25, 0.5, 0.75, 0.9], atol=0.03)
    runs = spark.createDataFrame([(0, 500, 10, 30, 640.0, 500.0), (0, 400, 10, 30, 640.0, 500.0), (0, 300, 10, 30, 640.0, -900.0)], "camera_id long, y long, x_start long, x_end long, foot_u double, foot_v double")
    cams = spark.range(1).select(F.col("id").alias("camera_id"), F.struct(*[F.lit(v).alias(k) for k, v in {"fx": 900.0, "fy": 900.0, "cx": 640.0, "cy": 360.0, "height": 2.5, "pitch": 0.6, "roll": 0.0}.items()]).alias("camera"))
    at = [g.height for g in M.run_heights(runs, cams).orderBy("y").collect()]
    assert at[0] is None and at[1] > 0.3 and abs(at[2]) < 1e-9


def test_cmc_map_queries_of_all_cameras(spark):
    """One vector in five is a query, of every camera; a gallery in one block and one in many give the ranking that sorting all pairs gives."""
    from aislewatch.plans import views as V

    rows = V.reid(spark, "/root/testdata/sf0.001").localCheckpoint()
    asked = rows.where("query")
    assert asked.count() * 5 == rows.count() and {r.camera for r in asked.select("camera").distinct().collect()} == {0, 1, 2, 3}
    got, blocks = M.cmc_map(rows).first(), M.cmc_map(rows, block=64, whole=0).first()
    r = rows.collect()
    f = np.array([x.feat for x in r])
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    sims, ap, first = np.round(f @ f.T, 9), [], []
    for i in (i for i, x in enumerate(r) if x.query):
        use = sorted((-sims[i, j], y.vec_id, y.pid == r[i].pid) for j, y in enumerate(r) if not y.query and y.pid != -1 and (y.pid, y.camera) != (r[i].pid, r[i].camera))
        at = [k + 1 for k, u in enumerate(use) if u[2]]
        if at:
            ap.append(np.mean([(n + 1) / k for n, k in enumerate(at)]))
            first.append(at[0])
    for x in (got, blocks):
        assert x.queries_scored == len(ap) and abs(x.map - np.mean(ap)) < 1e-9 and x.rank5 == pytest.approx(np.mean(np.array(first) <= 5))
