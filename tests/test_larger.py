"""What only shows on more rows than the smallest tables have: ties, rounding, crowded frames, and plans that shuffle or broadcast too much."""

from __future__ import annotations

import datetime
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aislewatch.operators import audits as A
from aislewatch.operators import metrics as M
from aislewatch.operators import overlaps, pairs
from aislewatch.operators import tracks as T
from aislewatch.plans import catalogue
from tests.test_oracle import plain

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def at(seconds: float) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=round(seconds * 1e6))


def crowd(n: int, users: int, frames: int, seed: int = 1) -> list[tuple]:
    """Events of few users in few frames, so that frames are full."""
    r = random.Random(seed)
    times = sorted(r.random() * frames * 14400 for _ in range(n))
    return [(i, at(t), r.randrange(users), r.choice(["view", "click", "purchase"]), round(r.random() * 100, 2), "{}") for i, t in enumerate(times)]


def same_as_sql(spark, folder, name: str, **tables) -> int:
    """Runs a query over ``tables`` (rows, schema) and compares it with its SQL; the number of rows."""
    import duckdb

    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        path = f"{folder}/{t}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    df, r = catalogue.QUERIES[name](spark, str(folder)), c.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    order = [r.columns.index(k) for k in cols]
    got = sorted(repr([plain(x[k]) for k in cols]) for x in df.collect())
    assert got == sorted(repr([plain(x[i]) for i in order]) for x in r.fetchall())
    return len(got)


def test_fleet_seconds_are_rounded(spark, tmp_path):
    """Frames 0.2 seconds apart, on either side of a half second, while the sequence starts again."""
    rows = [(999, at(10.4), 0, "view", 1.0, "{}"), (1000, at(10.6), 0, "view", 1.0, "{}"), (1001, at(10.9), 50, "view", 1.0, "{}"), (2001, at(11.2), 50, "view", 1.0, "{}")]
    assert same_as_sql(spark, tmp_path, "agg_fleet_report", events=(rows, EVENT)) == 1


def test_logits_that_cancel_out(spark):
    """The mean of logits whose sum is 0 isn't positive, whatever the order in which they are added up."""
    import itertools

    logits = [6.06, -3.755, -2.305]
    rows = [(k, "hat", x) for k, order in enumerate(itertools.permutations(logits)) for x in order] + [(9, "hat", x) for x in (0.1, 0.2, -0.3)] + [(10, "hat", x) for x in (0.1, 0.2, -0.299)]
    got = {r.track: round(r.agreement, 6) for r in A.track_attributes(spark.createDataFrame(rows, "track long, attribute string, logit double").coalesce(1)).collect()}
    assert 0.1 + 0.2 - 0.3 > 0 and got[9] == 0.333333 and got[10] == 0.666667
    assert {got[k] for k in range(6)} == {0.666667}


def test_close_pairs():
    """The same pairs as a table of all, for boxes of many sizes, one without an area, one upside down and one without an edge."""
    r = np.random.default_rng(1)
    p, s = r.random((700, 2)) * 300, r.random((700, 2)) ** 4 * 200
    a = np.hstack([p, p + s]).round(1)
    a[0, 2:], a[1, 2], a[2, 0] = a[0, :2], a[1, 0] - 5, np.nan
    b = np.vstack([a[3:300] + 1, a[:200], [[-500.0, -500.0, 900.0, 900.0]]])
    for cells in (1 << 20, 500):
        overlaps.CELLS = cells
        for x, y in ((a, b), (b, a)):
            for least in (0.05, 0.5, 1.0):
                i, j, v = overlaps.close_pairs(x, y, least)
                want = overlaps.iou_table(x, y)
                assert sorted(zip(i.tolist(), j.tolist(), v.tolist())) == sorted((m, n, want[m, n]) for m, n in zip(*(k.tolist() for k in np.nonzero(want >= least))))
    overlaps.CELLS = 1 << 20


@pytest.mark.parametrize("name", ["agg_detection_ap", "agg_detection_map", "j_gt_pred_iou", "agg_id_switches"])
def test_crowded_frames(spark, tmp_path, name):
    """More than a hundred predictions of a class in a picture all count."""
    assert same_as_sql(spark, tmp_path, name, events=(crowd(2500, 2400, 2), EVENT))


def nodes(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j_drop_static", "j_pose_student_teacher"])
def test_exploded_rows_are_not_broadcast(spark, tmp_path, name):
    """A table of few bytes from which an explode makes many rows looks small; its rows mustn't pass through the driver."""
    assert same_as_sql(spark, tmp_path, name, events=(crowd(600, 300, 4), EVENT))
    assert "SortMergeJoin" in nodes(catalogue.QUERIES[name](spark, str(tmp_path)))


def test_nearest_item(spark, tmp_path):
    """As the SQL, with ties in distance and several orders at a place; and no join of all with all."""
    orders = [(i, c, "O", 1.0, at(0), "x") for i, c in enumerate([0, 25, 35, 35, 60, 50, 100, 3])]
    customers = [(c, "x", 1, 1.0, "x") for c in [0, 25, 50, 75, 100, 10, 35, 60, 3, 4]]
    kinds = "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    assert same_as_sql(spark, tmp_path, "nearest_clip", customer=(customers, kinds[0]), orders=(orders, kinds[1])) == 9
    assert "Join" not in nodes(catalogue.QUERIES["nearest_clip"](spark, str(tmp_path)))


def test_nearest_rows():
    """The same rows as a table of all, with ties and few cells at once; a box without an edge is as far as can be."""
    r = np.random.default_rng(2)
    b = r.integers(0, 30, (400, 4)).astype(float)
    a = np.vstack([r.integers(0, 30, (300, 4)).astype(float), b[:50], [[900.0, -900.0, 900.0, -900.0], [np.nan, 0, 0, 0]]])
    table = np.abs(a[:, None] - b[None]).sum(axis=2)
    want = np.where(np.isnan(table), np.inf, table).argmin(axis=1)
    for cells in (1 << 20, 3000):
        overlaps.CELLS = cells
        i, j, _ = overlaps.nearest_rows(a, b)
        assert i.tolist() == list(range(len(a))) and j.tolist() == want.tolist()
    overlaps.CELLS = 1 << 20


@pytest.mark.parametrize("name", ["j_index_of", "j_label_of_track"])
def test_frames_without_all_pairs(spark, tmp_path, name):
    """As the SQL where frames are full, without a row for each pair of a frame."""
    assert same_as_sql(spark, tmp_path, name, events=(crowd(900, 700, 3), EVENT))
    assert "Join" not in nodes(catalogue.QUERIES[name](spark, str(tmp_path)))


def exchanged(plan: str) -> int:
    return plan.count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["j_copresent", "j_references", "j_coexist_cosine"])
def test_pairs_of_tracks_in_blocks(spark, tmp_path, name, monkeypatch):
    """As the SQL over several blocks; pairs of rows are never joined, which is what filled the disk."""
    monkeypatch.setattr(pairs.in_blocks, "__defaults__", (7,))
    for f in (pairs.meetings, pairs.compared):
        monkeypatch.setattr(f, "__defaults__", (7,))
    vectors = [(i, [float(x) for x in np.random.default_rng(i).random(4)], i % 3) for i in range(0, 200, 2)]
    assert same_as_sql(spark, tmp_path, name, events=(crowd(900, 160, 70), EVENT), embeddings=(vectors, "vec_id long, embedding array<float>, label long"))
    assert "frame_index" not in "".join(x for x in nodes(catalogue.QUERIES[name](spark, str(tmp_path))).split("\n") if "Join" in x)


def test_several_boxes_of_a_track_in_a_frame(spark):
    """Each pair of boxes counts as a frame, and the largest overlap is found whatever the order."""
    rows = [(0, 1, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 0, 50.0, 0.0, 60.0, 10.0), (0, 2, 0, 5.0, 0.0, 15.0, 10.0), (0, 2, 0, 0.0, 0.0, 10.0, 10.0), (0, 2, 3, 0.0, 0.0, 10.0, 10.0), (0, 3, 3, 90.0, 0.0, 99.0, 9.0)]
    obs = spark.createDataFrame(rows, "camera_id long, track_id long, frame_index long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(tuple(r) for r in pairs.meetings(obs).collect()) == [(0, 1, 2, 4, 1.0, 0), (0, 2, 3, 1, 0.0, 3)]


def test_bootstrap_chances_are_worked_out_once(spark):
    """One hash for each unit and draw, not one for each cell of a unit and each threshold; equal to weights worked out by hand."""
    rows = spark.range(60).selectExpr("id % 7 AS image", "id % 3 AS gt", "id DIV 2 % 3 AS pred", "id + 1 AS n")
    chance = (F.conv(F.substring(F.md5(F.concat_ws(":", "image", "draw").cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    out = M.bootstrap_miou(rows, "image", draws=20, chance=chance)
    assert nodes(out).count("md5(") <= 2  # a plan names it once; AQE's initial plan may repeat it
    weights = {}
    for i in range(7):
        for d in range(1, 21):
            u = (int(hashlib.md5(f"{i}:{d}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0
            weights[i, d] = sum(u > t for t in (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582))
    means = []
    for d in range(1, 21):
        table = np.zeros((3, 3))
        for k in range(60):
            table[k % 3, k // 2 % 3] += (k + 1) * weights[k % 7, d]
        truth = table.sum(axis=1)
        means.append(np.mean([table[c, c] / (truth[c] + table[:, c].sum() - table[c, c]) for c in range(3) if truth[c]]))
    assert out.first()["mean"] == pytest.approx(np.mean(means))


def test_many_ties_of_similarity(spark):
    """Copies of vectors tie by vec_id, in one block as in many, and are ranked in one go."""
    r = np.random.default_rng(3)
    kinds = r.standard_normal((6, 4))
    rows = [(i, i % 3, i // 3 % 4, i % 5 == 0, kinds[i % 6].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, pid long, camera long, query boolean, feat array<double>")
    got, blocks = M.cmc_map(df).first(), M.cmc_map(df, block=64, whole=0).first()
    assert got["map"] == pytest.approx(blocks["map"]) and tuple(got)[1:] == tuple(blocks)[1:] and got["queries_scored"] == 80


def test_tracker_takes_stretches_in_batches(spark):
    """Rows of two cameras in batches of seven, shorter than a frame, give the tracks of the tracker over all rows at once; no task holds a whole stretch."""
    r = random.Random(5)
    rows = [(c, "person", 1000 * c + 20 * f + k, f, r.random(), 30.0 * k + f, 5.0 * c, 30.0 * k + f + 20 + r.random(), 40.0) for c in (0, 1) for f in range(0, 40) if f % 17 < 9 for k in range(10) if r.random() < 0.8]
    det = spark.createDataFrame(r.sample(rows, len(rows)), "camera_id long, class_name string, det_id long, frame_index long, score double, x0 double, y0 double, x1 double, y1 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = T.track_boxes(det, max_age=3, min_hits=2, high=0.4, low=0.1)
        got = {x.det_id: x.track_key for x in out.collect()}
        assert "FlatMapGroups" not in nodes(out)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for c in (0, 1):
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (x[3], x[2]))
        for stretch in ([x for x in mine if lo <= x[3] < lo + 17] for lo in (0, 17, 34)):
            tracker = T.BoxTracker(0.3, 3, 0.4, 0.1, min_hits=2)
            tracker.pairs = lambda score, least: T.greedy_pairs(score, least)  # the table of all pairs
            keys, _ = tracker.follow(pd.DataFrame(stretch, columns=det.columns))
            want |= {x[2]: k for x, k in zip(stretch, keys) if k is not None}
    assert got == want and len(set(got.values())) > 20


def test_boxes_of_one_side_alone(spark):
    """Frames of a camera that one table has and the other hasn't."""
    kind = "camera_id long, frame_index long, {} long, class_name string, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(0, 0, 1, "a", 0.0, 0.0, 9.0, 9.0), (1, 0, 2, "a", 0.0, 0.0, 9.0, 9.0)], kind.format("gt_id"))
    b = spark.createDataFrame([(0, 0, 5, None, 0.0, 0.0, 9.0, 9.0), (2, 90, 6, "a", 0.0, 0.0, 9.0, 9.0)], kind.format("pred_id"))
    assert [tuple(r) for r in M.matched_boxes(a, b).collect()] == [(0, 0, 1, 5, 1.0)]
    assert M.matched_boxes(a, b.where("camera_id = 2")).count() == 0
