"""Streams over files, against the batch answers."""

from __future__ import annotations

import datetime
import os
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewatch.operators import events as E
from aislewatch.operators import tracks as T
from aislewatch.streaming import ordered as O
from aislewatch.streaming import pipelines as S

FRAMES = "camera_id long, seq long, ts timestamp, pts double"


def run(spark, df, path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def frames(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 2).alias("camera_id"), F.floor(F.col("id") / 4).alias("seq"), F.timestamp_seconds(F.col("id") / 4).alias("ts"), (F.col("id") / 4).alias("pts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(FRAMES).parquet(str(tmp_path / "in"))


def test_duplicates_go(spark, tmp_path):
    got = run(spark, S.without_duplicates(frames(spark, tmp_path)), tmp_path, "dedup")
    assert len(got) == 20 and len({(r.camera_id, r.seq) for r in got}) == 20


def test_sequences(spark, tmp_path):
    got = run(spark, S.sequences(frames(spark, tmp_path)), tmp_path, "seqs")
    for cam in (0, 1):
        mine = sorted((r.seq, r.pts) for r in got if r.camera_id == cam)
        assert [s for s, _ in mine] == list(range(1, len(mine) + 1)) and [p for _, p in mine] == sorted({p for _, p in mine})


def slices(spark, tmp_path, name, batches, schema):
    """A stream whose batches are the given lists of rows, a file each, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        for f in (tmp_path / name).glob("part-*"):
            if f.name not in SEEN:
                SEEN.add(f.name)
                os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    kind = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


SEEN: set[str] = set()


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=float(seconds))


END = 10**6  # seconds, behind everything
OBS = "ts timestamp, camera_id long, track_id long, frame_index long, x_m double, z_m double"
SQUARE = [(-1.0, 3.0), (1.0, 3.0), (1.0, 5.0), (-1.0, 5.0)]


def zones_and_lines(spark):
    z = spark.createDataFrame([(0, "till", SQUARE, 2, 0.4, True), (0, "hall", [(-5.0, 0.0), (5.0, 0.0), (5.0, 9.0), (-5.0, 9.0)], 9, 1.0, False)], "camera_id long, zone string, polygon array<struct<x: double, z: double>>, max_occupancy int, loiter_seconds double, restricted boolean")
    return z, spark.createDataFrame([(0, "gate", 0.0, 0.0, 0.0, 9.0)], "camera_id long, line string, ax double, az double, bx double, bz double")


def walks(seed, n=60):
    r = np.random.default_rng(seed)
    return [(at(f), 0, t, f, float(x), float(z)) for t in range(4) for f, x, z in zip(range(n), np.cumsum(r.normal(0, 0.6, n)), 4 + r.normal(0, 0.8, n), strict=True) if r.random() < 0.9]


@pytest.mark.parametrize("order", ["in time", "shuffled", "one batch"])
def test_track_events_are_the_batch_ones(spark, tmp_path, order):
    """Three input orders and cuts into batches: intrusions, loitering and crossings are those of the batch operators."""
    rows = walks(3)
    z, lines = zones_and_lines(spark)
    obs = spark.createDataFrame(rows, OBS)
    want = {("zone_intrusion", r.track_id, r.zone, r.frame_start, r.frame_end, r.value) for r in E.zone_intrusion(obs, z).collect()}
    want |= {("loitering", r.track_id, r.zone, r.frame_start, r.frame_end, r.value) for r in E.loitering(obs, z).collect()}
    want |= {("line_cross", r.track_id, r.line, r.frame_start, r.frame_end, r.value) for r in E.line_crossings(obs, lines).collect()}
    assert {w[0] for w in want} == {"zone_intrusion", "loitering", "line_cross"}
    if order == "shuffled":  # by up to eight seconds, inside the delay
        rows = [rows[i] for i in np.argsort([r[3] + s for r, s in zip(rows, np.random.default_rng(1).uniform(0, 8, len(rows)), strict=True)])]
    else:
        rows.sort(key=lambda r: r[3])
    step = len(rows) if order == "one batch" else 40
    batches = [rows[i : i + step] for i in range(0, len(rows), step)] + [[(at(END), 9, 9, 0, 0.0, 0.0)]]
    stream = slices(spark, tmp_path, "in", batches, OBS)
    got = run(spark, O.track_events(stream, z, lines, delay="10 seconds", idle="100 seconds"), tmp_path, "events_" + order.replace(" ", "_"))
    assert {(r.type, r.track_id, r.place, r.frame_start, r.frame_end, r.value) for r in got} == want and len(got) == len(want)


def test_late_rows_are_counted_and_change_nothing(spark, tmp_path):
    """A stay of frames 4 and 5 is closed by frame 6; then frame 3, inside too, comes behind the watermark."""
    z, lines = zones_and_lines(spark)
    row = lambda f, x=0.0: (at(f), 0, 1, f, x, 4.0)
    batches = [[row(4), row(5), row(6, 3.0)], [row(30, 3.0)], [row(31, 3.0)], [row(3), row(2)], [(at(END), 9, 9, 0, 0.0, 0.0)]]
    got = run(spark, O.track_events(slices(spark, tmp_path, "in", batches, OBS), z, lines, delay="5 seconds", idle="1000 seconds"), tmp_path, "late_rows")
    assert {(r.type, r.place, r.frame_start, r.frame_end, r.n) for r in got if r.place != "hall"} == {("late", None, None, None, 2), ("loitering", "till", 4, 5, None)}


DET = "ts timestamp, camera_id long, class_name string, det_id long, frame_index long, score double, x0 double, y0 double, x1 double, y1 double"


def boxes(seed=0, frames=40, people=5):
    r, rows = np.random.default_rng(seed), []
    x, v = r.uniform(0, 400, people), r.normal(0, 4, people)
    for f in range(frames):
        x = x + v + r.normal(0, 2, people)
        for p in range(people):
            if r.random() < 0.85 and not (p == 0 and 12 <= f < 22):
                rows.append((at(f), 0, "person", len(rows), f, float(np.round(r.uniform(0.1, 1), 3)), float(x[p]), 50.0, float(x[p]) + 40, 150.0))
    return rows


OPTIONS = [{"max_age": 5}, {"max_age": 4, "memory_gap": 15, "memory_iou": 0.05, "min_hits": 2}, {"max_age": 5, "high": 0.5, "low": 0.2, "least_low": 0.5, "filtered": True, "assignment": "optimal"}]


@pytest.mark.parametrize(("options", "order"), [(OPTIONS[0], "one batch"), (OPTIONS[1], "shuffled"), (OPTIONS[1], "in time"), (OPTIONS[2], "shuffled")])
def test_tracks_are_the_batch_ones(spark, tmp_path, options, order):
    rows = boxes()
    want = {(r.det_id, r.track_key, r.heir_of) for r in T.track_boxes(spark.createDataFrame(rows, DET), **options).collect()}
    assert "memory_gap" not in options or any(h for _, _, h in want)
    if order == "shuffled":
        rows = [rows[i] for i in np.argsort([r[4] + s for r, s in zip(rows, np.random.default_rng(1).uniform(0, 8, len(rows)), strict=True)])]
    step = len(rows) if order == "one batch" else 45
    batches = [rows[i : i + step] for i in range(0, len(rows), step)] + [[(at(END), 9, "none", -1, 0, 1.0, 0.0, 0.0, 1.0, 1.0)]]
    got = run(spark, O.tracks(slices(spark, tmp_path, "in", batches, DET), "10 seconds", "100 seconds", **options), tmp_path, f"tracks_{order.replace(' ', '_')}_{OPTIONS.index(options)}")
    assert {(r.det_id, r.track_key, r.heir_of) for r in got if r.camera_id == 0} == want and all(r.kind == "box" for r in got)


def test_late_boxes_are_counted(spark, tmp_path):
    rows = boxes(1, 20, 2)
    late = [r for r in rows if r[4] in (3, 4)]
    batches = [[r for r in rows if r[4] not in (3, 4)], [(at(40), *rows[-1][1:3], 999, 40, *rows[-1][5:])], late, [(at(END), 9, "none", -1, 0, 1.0, 0.0, 0.0, 1.0, 1.0)]]
    got = run(spark, O.tracks(slices(spark, tmp_path, "in", batches, DET), "5 seconds", "1000 seconds", max_age=5), tmp_path, "late_boxes")
    used = spark.createDataFrame([r for r in rows if r[4] not in (3, 4)] + batches[1], DET)
    assert [r.n for r in got if r.kind == "late"] == [len(late)]
    assert {(r.det_id, r.track_key) for r in got if r.kind == "box" and r.camera_id == 0} == {(r.det_id, r.track_key) for r in T.track_boxes(used, max_age=5).collect()}


def test_state_of_an_idle_camera_goes(spark, tmp_path):
    """After ``idle`` a camera's tracks are forgotten: the same box is a new track, though nothing of the frames' numbers says so."""
    box = lambda s, f, d: (at(s), 0, "person", d, f, 0.9, 0.0, 0.0, 40.0, 100.0)
    other = lambda s: (at(s), 5, "person", 0, int(s), 0.9, 0.0, 0.0, 40.0, 100.0)
    batches = [[box(0, 0, 1), box(1, 1, 2)], [other(500)], [other(501)], [box(502, 2, 3)], [(at(END), 9, "none", -1, 0, 1.0, 0.0, 0.0, 1.0, 1.0)]]
    got = {r.det_id: r.track_key for r in run(spark, O.tracks(slices(spark, tmp_path, "in", batches, DET), "1 second", "60 seconds", max_age=5), tmp_path, "idle_camera") if r.camera_id == 0}
    assert got[1] == got[2] == "0-0" and got[3] == "2-0"


FRAME = "camera_id long, ts timestamp"


def test_stalls_and_cameras_that_never_delivered(spark, tmp_path):
    frames = slices(spark, tmp_path, "frames", [[(1, at(s)) for s in (1, 2, 3, 20, 21)], [(1, at(22))], [(8, at(END))]], FRAME)
    roster = slices(spark, tmp_path, "roster", [[(1, at(0)), (2, at(0))], [(2, at(30))], [(8, at(END))]], FRAME)
    got = run(spark, O.camera_states(frames, roster, "6 seconds", "60 seconds"), tmp_path, "states")
    ms = lambda s: round(at(s).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    assert sorted((r.camera_id, r.since, r.state, r.frames, r.ever_delivered) for r in got if r.camera_id != 8) == sorted([
        (1, ms(0), "connecting", 0, False), (1, ms(1), "live", 0, True), (1, ms(9), "stalled", 3, True), (1, ms(20), "live", 3, True), (1, ms(28), "stalled", 6, True),
        (2, ms(0), "connecting", 0, False), (2, ms(6), "never_delivered", 0, False), (2, ms(30), "connecting", 0, False), (2, ms(36), "never_delivered", 0, False)])


def test_stalls_by_the_clock(spark, tmp_path):
    """Timers of processing time fire though nothing comes any more."""
    frames = slices(spark, tmp_path, "frames", [[(1, at(0))]], FRAME)
    roster = slices(spark, tmp_path, "roster", [[(1, at(0)), (2, at(0))]], FRAME)
    q = O.camera_states(frames, roster, "1 second", live=True).writeStream.format("memory").queryName("live_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            got = {(r.camera_id, r.state) for r in spark.table("live_states").collect()}
            if {(1, "stalled"), (2, "never_delivered")} <= got:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert {(1, "connecting"), (1, "live"), (1, "stalled"), (2, "connecting"), (2, "never_delivered")} == got


def test_freshest(spark, tmp_path):
    """Older numbers after a newer one are left out, in later ticks too; rows behind the watermark are counted."""
    f = lambda s, seq: (1, at(s), seq)
    batches = [[f(0.1, 5), f(0.2, 7), f(0.3, 6)], [f(1.5, 4), f(2.5, 8), f(2.6, 9)], [f(60, 10)], [f(61, 11)], [f(0.5, 12)], [(8, at(END), 1)]]
    got = run(spark, O.freshest(slices(spark, tmp_path, "in", batches, "camera_id long, ts timestamp, seq long"), "1 second", "5 seconds"), tmp_path, "fresh")
    base = round(at(0).replace(tzinfo=datetime.timezone.utc).timestamp())
    mine = [r for r in got if r.camera_id == 1]
    assert sorted((r.tick // 1000 - base, r.seq, r.replaced, r.left_out) for r in mine if r.tick is not None) == [(0, 7, 1, 1), (2, 9, 1, 1), (60, 10, 0, 0), (61, 11, 0, 0)]
    assert [r.late for r in mine if r.tick is None] == [1]


def test_verdicts_of_two_streams(spark, tmp_path):
    """Alerts get the verdicts of their day; those without one come out when their time is over."""
    a = slices(spark, tmp_path, "a", [[("x", at(0)), ("y", at(10))], [("z", at(200_000))], [("end", at(END))]], "alert_id string, at timestamp")
    v = slices(spark, tmp_path, "v", [[("x", at(60), "confirmed"), ("x", at(86_000), "rejected")], [("y", at(90_000), "confirmed"), ("z", at(199_000), "confirmed")], [("end", at(END), "x")]], "alert_id string, decided_at timestamp, status string")
    got = run(spark, S.with_verdicts(a, v), tmp_path, "verdicts")
    assert sorted((r.alert_id, r.status) for r in got if r.alert_id != "end") == [("x", "confirmed"), ("x", "rejected"), ("y", "unreviewed"), ("z", "unreviewed")]


def test_alert_sink(spark, tmp_path):
    """A restart from the checkpoint adds nothing; neither does a batch that is run again when the ledger has it; a batch without its ledger row isn't read."""
    df = spark.createDataFrame([("a", "2024-01-01T00:00:00"), ("b", "2024-01-02T00:00:00")], "alert_id string, t string").select("alert_id", F.col("t").cast("timestamp").alias("at"))
    df.write.parquet(str(tmp_path / "in"))
    start = lambda cp: S.write_alerts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / cp), once=True).awaitTermination()
    read = lambda: sorted((r.alert_id, str(r.utc_date)) for r in S.read_alerts(spark, str(tmp_path / "out"), "alert_id string, at timestamp").collect())
    for cp in ("cp", "cp", "lost"):  # the last: all batches come again, under the numbers that they had
        start(cp)
        assert read() == [("a", "2024-01-01"), ("b", "2024-01-02")]
    shutil.copytree(tmp_path / "out/alerts/batch=0", tmp_path / "out/alerts/batch=7")
    assert read() == [("a", "2024-01-01"), ("b", "2024-01-02")]
    v = spark.createDataFrame([("a", "confirmed")], "alert_id string, status string")
    assert {r.alert_id: r.status for r in S.with_current_verdict(df, v).collect()} == {"a": "confirmed", "b": "unreviewed"}
