"""Evidence joins, fits and trackers against brute force on small frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewatch.functions import labels as L
from aislewatch.operators import evidence as E
from aislewatch.operators import poses as P
from aislewatch.operators import tracks as T

DET = "camera_id long, det_id long, frame_index long, class_name string, score double, x0 double, y0 double, x1 double, y1 double"


def detections(spark, seed=3, frames=30, people=6):
    r = np.random.default_rng(seed)
    at, rows = r.uniform(0, 300, (people, 2)), []
    for f in range(frames):
        at = at + r.normal(0, 4, at.shape)
        for k in range(people):
            if r.random() < 0.85:
                x, y = map(float, at[k])
                rows.append((0, len(rows), f, "person" if k % 3 else "bag", float(r.random()), x, y, x + 60, y + 120))
    return spark.createDataFrame(rows, DET), rows


def test_box_survival(spark):
    df, rows = detections(spark)
    box = {r[1]: np.array([r[5:9]]) for r in rows}
    links = {}
    for f in range(30):
        here, there = [[r for r in rows if r[2] == k] for k in (f, f + 1)]
        pairs = sorted(((-T.pair_iou(box[a[1]], box[b[1]])[0, 0], a[1], b[1]) for a in here for b in there if a[3] == b[3]))
        used = set()
        for score, a, b in pairs:
            if -score >= 0.5 and ("a", a) not in used and ("b", b) not in used:
                links[b] = a
                used |= {("a", a), ("b", b)}
    head = lambda k: head(links[k]) if k in links else k
    want = {}
    for k in box:
        want[head(k)] = want.get(head(k), 0) + 1
    assert {r["head"]: r.length for r in E.box_survival(df).collect()} == want
    report = E.survival_report(E.box_survival(df)).first()
    assert report.lives == len(want) and report.longest == max(want.values()) and abs(report.one_frame - np.mean([v == 1 for v in want.values()])) < 1e-9


def test_filter_follows_a_steady_walk():
    f = T.BoxFilter(np.array([0.0, 0.0, 40.0, 100.0]))
    for k in range(1, 20):
        f.update(np.array([5.0 * k, 0.0, 40.0 + 5 * k, 100.0]), 1)
    assert np.allclose(f.box(2), [105.0, 0.0, 145.0, 100.0], atol=1.0)


def test_leave_one_out(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((120, 2))
    y = (x[:, 0] + 0.5 * r.standard_normal(120) > 0).astype(int)
    rows = [(i % 4, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "camera long, a double, b double, label int")
    got = {q.camera: (q.n, q.positives, q.accuracy) for q in P.leave_one_out(df, ["a", "b"]).collect()}
    x1, fold = np.column_stack([x, np.ones(120)]), np.arange(120) % 4
    for k in range(4):
        tr, w = fold != k, np.zeros(3)
        cost = np.where(y[tr] == 1, 0.5 / y[tr].sum(), 0.5 / (1 - y[tr]).sum())
        for _ in range(8):
            p = 1 / (1 + np.exp(-x1[tr] @ w))
            w += np.linalg.solve((x1[tr] * (cost * p * (1 - p))[:, None]).T @ x1[tr] + 1e-3 * np.eye(3), x1[tr].T @ (cost * (y[tr] - p)) - 1e-3 * w)
        n, positives, accuracy = got[k]
        assert (n, positives) == (30, y[~tr].sum()) and abs(accuracy - np.mean((x1[~tr] @ w > 0) == y[~tr])) < 1e-9
    one = P.licence(P.leave_one_out(df.withColumn("label", F.lit(1)), ["a", "b"])).collect()
    assert all(q.accuracy is None and q.reason == "one class only" and not q.licensed for q in one)


def test_leave_one_out_standardises_on_the_fitted_rows(spark):
    """Nine features of unlike sizes; the means and deviations are those of the other folds."""
    r = np.random.default_rng(7)
    x = r.standard_normal((200, 9)) * 10.0 ** r.integers(-3, 4, 9) + r.uniform(-5, 5, 9)
    fold = np.arange(200) % 5
    x[fold == 2] *= 1.5
    y = (x[:, 0] / x[:, 0].std() + x[:, 3] / x[:, 3].std() + 0.7 * r.standard_normal(200) > 0).astype(int)
    names = [f"f{i}" for i in range(9)]
    df = spark.createDataFrame([(int(k), *map(float, v), int(c)) for k, v, c in zip(fold, x, y, strict=True)], "camera long, " + ", ".join(f"{n} double" for n in names) + ", label int")
    got = {q.camera: q.accuracy for q in P.leave_one_out(df, names).collect()}
    for k in range(5):
        tr = fold != k
        z = np.column_stack([(x - x[tr].mean(axis=0)) / (x[tr].std(axis=0) + 1e-6), np.ones(200)])
        cost, w = np.where(y[tr] == 1, 0.5 / y[tr].sum(), 0.5 / (1 - y[tr]).sum()), np.zeros(10)
        for _ in range(25):
            p = 1 / (1 + np.exp(-z[tr] @ w))
            w += np.linalg.solve((z[tr] * (cost * p * (1 - p))[:, None]).T @ z[tr] + 1e-2 * np.eye(10), z[tr].T @ (cost * (y[tr] - p)) - 1e-2 * w)
        assert abs(got[k] - np.mean((z[~tr] @ w >= 0) == y[~tr])) < 1e-9


def test_night_veto_in_the_order_of_the_rules(spark):
    rows = [(True, 0.9, 100, 0.9), (False, 0.1, 100, 0.9), (False, 0.9, None, 0.9), (False, 0.9, 10, 0.9), (False, 0.9, 100, 0.9), (False, 0.9, 100, 0.1)]
    df = spark.createDataFrame(rows, "excluded boolean, score double, plate_pixels long, share double")
    assert [(r.reason, r.keep) for r in E.night_veto(df).collect()] == [
        ("camera excluded", False), ("below score threshold", False), ("no static plate", False), ("kept: plate too coarse", True), ("static: furniture", False), ("kept", True)]


def test_head_order_refuses_unknown_names(spark):
    taxonomy = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id long, name string")
    keep = spark.createDataFrame([("c",), ("a",), ("c",)], "name string")
    assert sorted((r.channel, r.name) for r in L.head_order(keep, taxonomy).collect()) == [(0, "a"), (1, "c")]
    with pytest.raises(Exception, match="not in the taxonomy"):
        L.head_order(keep.unionByName(spark.createDataFrame([("z",)], "name string")), taxonomy).collect()


def test_frame_features_leave_what_is_not_measured(spark):
    kp = [(0.0, 0.0, 0.0)] * 17
    for k, p in {5: (10.0, 0.0, 0.9), 6: (20.0, 0.0, 1.7), 11: (10.0, 40.0, 0.5), 12: (20.0, 40.0, 0.01)}.items():
        kp[k] = p
    df = spark.createDataFrame([(kp,), ([(x, y / 10, c) for x, y, c in kp],)], "k array<struct<x double, y double, conf double>>")
    far, small = (r.f for r in df.select(L.frame_features(F.col("k")).alias("f")).collect())
    limb = lambda f, n: f[3 * n : 3 * n + 3]
    assert limb(far, 8) == [1.0, 0.0, 0.25] and limb(far, 10) == [0.0, 1.0, 1.0] and limb(far, 0) == [0.0, 0.0, 0.0]
    assert limb(small, 8) == [1.0, 0.0, 0.0]  # the torso is under eight pixels: no length
    assert far[36:][5:7] == [0.9, 1.0] and far[36:][12] == 0.01 and len(far) == 53
