"""Tracks: making them from boxes, cutting, merging, stitching and judging them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewatch.functions.boxes import box, iou
from aislewatch.operators.assignment import best_assignment
from aislewatch.operators.components import connected_components
from aislewatch.operators.overlaps import close_pairs
from aislewatch.operators.pairs import meetings
from aislewatch.operators.runs import TRACK, observed_runs


def pair_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of ``a`` with every box of ``b``."""
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(hi - lo, 0, None).prod(axis=2)
    union = (a[:, 2:] - a[:, :2]).prod(axis=1)[:, None] + (b[:, 2:] - b[:, :2]).prod(axis=1)[None, :] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def greedy_pairs(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs by falling score, each row and column once; ties by row, then column."""
    out, rows, cols = [], set(), set()
    x, y = np.nonzero(score >= least)
    for k in np.argsort(-score[x, y], kind="stable").tolist():
        i, j = int(x[k]), int(y[k])
        if i not in rows and j not in cols:
            out.append((i, j))
            rows.add(i)
            cols.add(j)
    return out


def close_greedy_pairs(last: np.ndarray, ahead: np.ndarray, boxes: np.ndarray, least: float) -> list[tuple[int, int]]:
    """:func:`greedy_pairs` of the larger overlap of each track's last and predicted box with each box, from those of ``least`` (over 0) alone."""
    n = len(boxes)
    best: dict[int, float] = {}
    for table in (last, ahead):
        i, j, v = close_pairs(table, boxes, least)
        for k, x in zip((i * n + j).tolist(), v.tolist(), strict=True):
            if x > best.get(k, 0.0):
                best[k] = x
    out, rows, cols = [], set(), set()
    for k, _ in sorted(best.items(), key=lambda kv: (-kv[1], kv[0])):
        i, j = divmod(k, n)
        if i not in rows and j not in cols:
            out.append((i, j))
            rows.add(i)
            cols.add(j)
    return out


def optimal_pairs(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The pairs of the assignment with the largest total score, but for those under ``least``.

    Only boxes that meet can add to the total, so each set of boxes that overlaps tie together is assigned on its own.
    """
    out: list[tuple[int, int]] = []
    open_ = set(np.flatnonzero((score > 0).any(axis=1)).tolist())
    while open_:
        rows, cols, found = set(), set(), {open_.pop()}
        while found:
            rows |= found
            cols = set(np.flatnonzero((score[sorted(rows)] > 0).any(axis=0)).tolist())
            found = set(np.flatnonzero((score[:, sorted(cols)] > 0).any(axis=1)).tolist()) - rows
        open_ -= rows
        r, c = sorted(rows), sorted(cols)
        some = score[np.ix_(r, c)]
        pairs = [(0, 0)] if some.size == 1 else best_assignment(some)
        out += [(r[i], c[j]) for i, j in pairs if i < len(r) and j < len(c) and some[i, j] >= least]
    return sorted(out)


class BoxFilter:
    """A Kalman filter of one box: centre, width, height and their changes a frame; noise in proportion to the height."""

    POSITION, VELOCITY = 1 / 20, 1 / 160  # standard deviations over the height
    STEP = np.eye(8) + np.diag(np.ones(4), 4)

    def __init__(self, box: np.ndarray | None = None):
        if box is not None:
            self.x = np.concatenate([self._centre(box), np.zeros(4)])
            self.p = np.diag((self.x[3] * np.r_[np.full(4, 2 * self.POSITION), np.full(4, 10 * self.VELOCITY)]) ** 2)

    @staticmethod
    def _centre(b: np.ndarray) -> np.ndarray:
        return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]], float)

    def ahead(self, frames: int) -> tuple[np.ndarray, np.ndarray]:
        """State and covariance after so many frames."""
        x, p = self.x, self.p
        for _ in range(frames):
            noise = max(float(x[3]), 1.0) * np.r_[np.full(4, self.POSITION), np.full(4, self.VELOCITY)]
            x, p = self.STEP @ x, self.STEP @ p @ self.STEP.T + np.diag(noise**2)
        return x, p

    def box(self, frames: int) -> np.ndarray:
        cx, cy, w, h = self.x[:4] + frames * self.x[4:]
        return np.array([cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2])

    def update(self, box: np.ndarray, frames: int) -> None:
        x, p = self.ahead(frames)
        z = self._centre(box)
        gain = np.linalg.solve(p[:4, :4] + np.diag(np.full(4, self.POSITION * max(float(z[3]), 1.0)) ** 2), p[:4]).T
        self.x, self.p = x + gain @ (z - x[:4]), p - gain @ p[:4]


class BoxTracker:
    """IoU tracking of one camera: prediction, birth, confirmation, retirement, memory.

    A box joins the live track that its predicted or last box overlaps most; prediction moves the last box by what the centre was
    off the prediction at the last match, or is that of a Kalman filter of eight states (``filtered``). ``assignment``: "greedy" by
    falling overlap, or "optimal" by the largest total. With ``low`` set, boxes of a score between ``low`` and ``high`` may only prolong what
    the better ones left without a box, at an overlap of ``least_low`` (two-stage association). Ages are frame differences, so frames
    without boxes need no rows. Ids are (birth frame, order of birth in it): the same whatever the batch.

    With ``memory_gap`` a track of ``min_hits`` boxes or more is remembered for so many frames from its last box on, though it was retired
    after ``max_age``: a track that is born over its last box (``memory_iou`` at least; the largest overlap, then the one seen last)
    is its heir, whose verdicts on the person go on with the donor's. A track has one heir at most.
    """

    def __init__(self, least: float = 0.3, max_age: int = 15, high: float = 0.0, low: float | None = None, filtered: bool = False, least_low: float | None = None, assignment: str = "greedy", min_hits: int = 3, memory_gap: int = 0, memory_iou: float = 0.3):
        self.least, self.max_age, self.high, self.low, self.filtered = least, max_age, high, low, filtered
        self.least_low = least if least_low is None else least_low
        self.pairs = {"greedy": greedy_pairs, "optimal": optimal_pairs}[assignment]
        self.min_hits, self.memory_gap, self.memory_iou = min_hits, memory_gap, memory_iou
        self.live: list[dict] = []
        self.retired: list[dict] = []
        self.heirs: dict[tuple[int, int], tuple[int, int]] = {}

    def _ahead(self, t: dict, frame: int) -> np.ndarray:
        return t["filter"].box(frame - t["frame"]) if self.filtered else t["box"] + np.tile(t["v"], 2) * (frame - t["frame"])

    def _retire(self, frame: int) -> None:
        gone = [t for t in self.live if frame - t["frame"] > self.max_age]
        if gone:
            self.live = [t for t in self.live if frame - t["frame"] <= self.max_age]
            self.retired += [t for t in gone if t["hits"] >= self.min_hits]
        self.retired = [t for t in self.retired if frame - t["frame"] <= self.memory_gap and not t["given"]]

    def _donor(self, box: np.ndarray) -> dict | None:
        open_ = [t for t in self.retired if not t["given"]]
        if not open_:
            return None
        overlap = pair_iou(np.stack([t["box"] for t in open_]), box[None])[:, 0]
        best, _, _, k = max((float(o), t["frame"], t["id"], i) for i, (o, t) in enumerate(zip(overlap, open_, strict=True)))
        return open_[k] if best >= self.memory_iou else None

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray) -> list[tuple[int, int] | None]:
        """The track (birth frame, order) of each box, None for boxes that no track takes and that start none."""
        self._retire(frame)
        out: list[tuple[int, int] | None] = [None] * len(boxes)
        free = list(range(len(self.live)))
        better = scores >= self.high
        for use, least in ((np.flatnonzero(better), self.least), (np.flatnonzero(~better & (scores >= self.low)) if self.low is not None else np.zeros(0, int), self.least_low)):
            if len(use) and free:
                last = np.stack([self.live[k]["box"] for k in free])
                ahead = np.stack([self._ahead(self.live[k], frame) for k in free])
                if self.pairs is greedy_pairs and least > 0:
                    pairs = close_greedy_pairs(last, ahead, boxes[use], least)
                else:
                    pairs = self.pairs(np.maximum(pair_iou(last, boxes[use]), pair_iou(ahead, boxes[use])), least)
                for i, j in pairs:
                    t, b = self.live[free[i]], boxes[use[j]]
                    if self.filtered:
                        t["filter"].update(b, frame - t["frame"])
                    else:
                        t["v"] = (b - ahead[i]).reshape(2, 2).mean(axis=0)
                    t |= {"box": b, "frame": frame, "hits": t["hits"] + 1}
                    out[use[j]] = t["id"]
                taken = {free[i] for i, _ in pairs}
                free = [k for k in free if k not in taken]
        for n, k in enumerate(k for k in np.flatnonzero(better).tolist() if out[k] is None):
            donor = self._donor(boxes[k]) if self.memory_gap else None
            if donor:
                donor["given"] = True
                self.heirs[frame, n] = donor["id"]
            self.live.append({"id": (frame, n), "box": boxes[k], "v": np.zeros(2), "frame": frame, "hits": 1, "given": False} | ({"filter": BoxFilter(boxes[k])} if self.filtered else {}))
            out[k] = (frame, n)
        return out

    def follow(self, rows: pd.DataFrame) -> tuple[list[str | None], list[str | None]]:
        """(the track key of each row, the key of the track whose heir it is where a row starts one) of rows (frame_index, x0..y1, score) in the order of frames."""
        frames, boxes, scores = rows["frame_index"].to_numpy(), rows[["x0", "y0", "x1", "y1"]].to_numpy(float), rows["score"].to_numpy(float)
        cuts = np.flatnonzero(np.diff(frames)) + 1
        name = lambda k: None if k is None else f"{k[0]}-{k[1]}"
        keys: list[str | None] = []
        heirs: list[str | None] = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(frames)], strict=True):
            if a < b:
                self.heirs = {}
                found = self.step(int(frames[a]), boxes[a:b], scores[a:b])
                keys += [name(k) for k in found]
                heirs += [name(self.heirs.get(k)) if k is not None else None for k in found]
        return keys, heirs

    def rows(self) -> dict[tuple[int, int], tuple]:
        """The live and remembered tracks by id, as plain values, for the state of a stream."""
        kept = [(t, False) for t in self.live] + [(t, True) for t in self.retired]
        return {t["id"]: (t["frame"], t["hits"], t["box"].tolist(), t["v"].tolist(), *((t["filter"].x.tolist(), t["filter"].p.ravel().tolist()) if self.filtered else ([], [])), retired, t["given"]) for t, retired in kept}

    def restore(self, rows: dict[tuple[int, int], tuple]) -> None:
        """Sets live and remembered tracks to :meth:`rows`, in the order in which they were born and retired."""
        self.live, self.retired = [], []
        for k, (frame, hits, box_, v, x, p, retired, given) in sorted(rows.items()):
            t = {"id": tuple(k), "box": np.array(box_, float), "v": np.array(v, float), "frame": frame, "hits": hits, "given": given}
            if self.filtered:
                t["filter"] = BoxFilter()
                t["filter"].x, t["filter"].p = np.array(x, float), np.array(p, float).reshape(8, 8)
            (self.retired if retired else self.live).append(t)


def track_boxes(det: DataFrame, least: float = 0.3, max_age: int = 15, min_hits: int = 3, high: float = 0.0, low: float | None = None, filtered: bool = False, memory_gap: int = 0, block: int | None = None, overlap: int | None = None, **options) -> DataFrame:
    """(camera_id, class_name, det_id, frame_index, track_key, heir_of, confirmed, box) of detections; ``options`` are those of :class:`BoxTracker`.

    A clip is sequential, but no track outlives ``max_age`` empty frames, and none is remembered beyond ``memory_gap``: a camera's stream is
    cut at longer gaps, and each stretch is a group of its own. A track with ``min_hits`` boxes or more is confirmed.

    A stretch may be as long as the stream. With ``block`` it is also cut every so many frames, and each block is tracked from ``overlap`` frames
    (three times the longest silence, if unset) before its first one on; tracks of neighbouring blocks that share the most boxes of the
    overlap, each the other's first choice, are one, under the key of the earlier block. That equals the sequential tracker where a block's tracks have
    settled within the overlap. What may differ: a track that is silent for the whole overlap is cut, a prediction at a seam
    knows no more than the overlap (the plain one carries its errors on over silences, so it may then take another box), and a donor before it isn't remembered.
    """
    longest = max(max_age, memory_gap)
    key = ["camera_id", "class_name"]
    w = Window.partitionBy(*key).orderBy("frame_index")
    frames = det.select(*key, "frame_index").distinct().withColumn("_g", (F.col("frame_index") - F.lag("frame_index").over(w) > longest).cast("int")).withColumn("_part", F.coalesce(F.sum("_g").over(w), F.lit(0)))
    rows = det.join(frames.drop("_g"), [*key, "frame_index"])
    overlap = 3 * max(longest, 1) if overlap is None else overlap
    at = F.floor(F.col("frame_index") / block) if block else F.lit(0).cast("long")
    if block:
        if overlap >= block:
            raise ValueError("a block has to be longer than its overlap")
        rows = rows.withColumn("_k", F.explode(F.when(F.col("frame_index") >= (at + 1) * block - overlap, F.array(at, at + 1)).otherwise(F.array(at))))
    else:
        rows = rows.withColumn("_k", at)

    kind = dict(det.dtypes)
    part, given = [*key, "_part", "_k"], ["camera_id", "class_name", "det_id", "frame_index", "x0", "y0", "x1", "y1"]
    schema = ", ".join(f"{c} {kind[c]}" for c in given) + ", _k long, track_key string, heir_of string"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda: BoxTracker(least, max_age, high, low, filtered, min_hits=min_hits, memory_gap=memory_gap, **options)
        tracker, now, held = new(), None, None  # held: rows of the last frame so far, which the next batch may go on with

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, heirs = tracker.follow(t.select(["frame_index", "x0", "y0", "x1", "y1", "score"]).to_pandas())
            out = t.select([*given, "_k"]).append_column("track_key", pa.array(keys, pa.string())).append_column("heir_of", pa.array(heirs, pa.string()))
            yield from out.filter(pc.is_valid(out.column("track_key"))).to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            held, at = None, list(zip(*(t.column(c).to_pylist() for c in part), strict=True))
            cuts = [0, *(n for n in range(1, len(at)) if at[n] != at[n - 1]), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if at[a] != now:
                    tracker, now = new(), at[a]
                mine = t.slice(a, b - a)
                if b == len(at):
                    frames_ = mine.column("frame_index").to_numpy()
                    open_ = int(np.flatnonzero(frames_ != frames_[-1])[-1]) + 1 if (frames_ != frames_[-1]).any() else 0
                    held, mine = mine.slice(open_), mine.slice(0, open_)
                if mine.num_rows:
                    yield from done(mine)
        if held is not None and held.num_rows:
            yield from done(held)

    # a task takes its stretches frame by frame out of Spark's own sort, and holds the live tracks and a batch of rows
    tracked = rows.repartition(*part).sortWithinPartitions(*part, "frame_index", "det_id").select(*given, "score", "_part", "_k").mapInArrow(follow, schema)
    if block:
        tracked = _across_seams(tracked.checkpoint(), block)
    return tracked.drop("_k").withColumn("confirmed", F.count("*").over(Window.partitionBy(*key, "track_key")) >= min_hits)


def _across_seams(tracked: DataFrame, block: int) -> DataFrame:
    """Blocks' own rows of ``tracked`` (block _k, track_key), with the keys of tracks that go on over seams made one."""
    key = ["camera_id", "class_name"]
    own = F.floor(F.col("frame_index") / block) == F.col("_k")
    a = tracked.where(own).select(*key, "det_id", "frame_index", F.col("_k").alias("_ka"), F.col("track_key").alias("_a"))
    b = tracked.where(~own).select(*key, "det_id", F.col("_k").alias("_kb"), F.col("track_key").alias("_b"))
    shared = a.join(b, [*key, "det_id"]).groupBy(*key, "_ka", "_a", "_kb", "_b").agg(F.struct(F.count("*"), F.max("frame_index")).alias("_n"))
    first = lambda *by: F.row_number().over(Window.partitionBy(*key, "_ka", *by).orderBy(F.desc("_n"), "_a", "_b"))
    links = shared.withColumns({"_i": first("_a"), "_j": first("_b")}).where("_i = 1 AND _j = 1")
    node = lambda k, t: F.struct(F.col(k).alias("k"), F.col(t).alias("t"))
    comps = connected_components(links.select(*key, node("_ka", "_a").alias("a"), node("_kb", "_b").alias("b")), *key)
    to = comps.select(*key, F.col("node.k").alias("_k"), F.col("node.t").alias("_t"), F.col("component.t").alias("_to"))
    mine = tracked.where(own)
    named = mine.join(to.withColumnRenamed("_t", "track_key"), [*key, "_k", "track_key"], "left").withColumn("track_key", F.coalesce("_to", "track_key")).drop("_to")
    named = named.join(to.withColumnRenamed("_t", "heir_of"), [*key, "_k", "heir_of"], "left").withColumn("heir_of", F.coalesce("_to", "heir_of")).drop("_to")
    return named.select(*tracked.columns)


def suppress(det: DataFrame, least: float = 0.5) -> DataFrame:
    """Non-maximum suppression per camera, frame and class: a box goes if a kept better one overlaps it by ``least``."""

    def keep(t: pa.Table) -> pa.Table:
        t = t.sort_by([("score", "descending"), ("det_id", "ascending")])
        b, left = np.column_stack([t[c].to_numpy().astype(float) for c in ("x0", "y0", "x1", "y1")]), []
        open_ = np.arange(len(b))
        while len(open_):
            left.append(open_[0])
            open_ = open_[1:][pair_iou(b[open_[:1]], b[open_[1:]])[0] < least]
        return t.take(pa.array(left))

    return det.groupBy("camera_id", "frame_index", "class_name").applyInArrow(keep, det.schema)


def top_scores(det: DataFrame, k: int) -> DataFrame:
    """The ``k`` best boxes of each frame."""
    w = Window.partitionBy("camera_id", "frame_index").orderBy(F.desc("score"), "det_id")
    return det.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def label_vote(rows: DataFrame) -> DataFrame:
    """The class that most observations of a track up to now had (ties: the smallest).

    Counts only grow, so the best (count, -class) among the rows so far is the current majority.
    """
    n = F.row_number().over(Window.partitionBy(*TRACK, "class_id").orderBy("frame_index"))
    best = F.max(F.struct("_n", (-F.col("class_id")).alias("_c"))).over(Window.partitionBy(*TRACK).orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_n", n).withColumn("voted", -best["_c"]).drop("_n")


def split_at(obs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Observations with ``part``: 0 before a track's first cut frame, one more from each cut on."""
    c = cuts.groupBy(*TRACK).agg(F.sort_array(F.collect_set("cut")).alias("_cuts"))
    return obs.join(c, TRACK, "left").withColumn("part", F.coalesce(F.size(F.filter("_cuts", lambda x: x <= F.col("frame_index"))), F.lit(0))).drop("_cuts")


def merge_tracks(obs: DataFrame, groups: DataFrame) -> DataFrame:
    """Observations with ids folded into the smallest of their group (columns camera_id, group, track_id); of two in one frame the first stays."""
    low = groups.withColumn("_to", F.min("track_id").over(Window.partitionBy("camera_id", "group"))).select("camera_id", "track_id", "_to")
    m = obs.join(low, TRACK, "left").withColumn("merged_id", F.coalesce("_to", "track_id")).drop("_to")
    w = Window.partitionBy("camera_id", "merged_id", "frame_index").orderBy("track_id")
    return m.withColumns({"_r": F.row_number().over(w), "duplicates": F.count("*").over(Window.partitionBy("camera_id", "merged_id", "frame_index")) - 1}).where("_r = 1").drop("_r")


def fragments(obs: DataFrame) -> DataFrame:
    """Per track its first and last frame and box, and the velocity of its last step (pixels a frame)."""
    here = F.struct("frame_index", "x0", "y0", "x1", "y1")
    w = Window.partitionBy(*TRACK).orderBy("frame_index")
    dt = F.col("frame_index") - F.lag("frame_index").over(w)
    v = obs.withColumns({"_vx": (F.col("x0") - F.lag("x0").over(w)) / dt, "_vy": (F.col("y1") - F.lag("y1").over(w)) / dt})
    return v.groupBy(*TRACK).agg(F.min_by(here, "frame_index").alias("a"), F.max_by(here, "frame_index").alias("b"), F.coalesce(F.max_by("_vx", "frame_index"), F.lit(0.0)).alias("vx"), F.coalesce(F.max_by("_vy", "frame_index"), F.lit(0.0)).alias("vy"), F.count("*").alias("n"))


def stitch_candidates(frags: DataFrame, max_gap: int = 30, base: float = 0.5, rate: float = 0.05, size_ratio: float = 1.6) -> DataFrame:
    """(camera_id, a_id, b_id, gap, score): ends that a later start may go on, by distance over height against what the gap allows.

    The distance is the lesser of standing still and walking on. A range join over buckets of ``max_gap`` frames.
    """
    e = frags.select("camera_id", F.col("track_id").alias("a_id"), F.col("b").alias("end"), "vx", "vy", F.explode(F.array(F.floor(F.col("b.frame_index") / max_gap), F.floor(F.col("b.frame_index") / max_gap) + 1)).alias("_k"))
    s = frags.select("camera_id", F.col("track_id").alias("b_id"), F.col("a").alias("start"), F.floor(F.col("a.frame_index") / max_gap).alias("_k"))
    j = e.join(s, ["camera_id", "_k"]).withColumn("gap", F.col("start.frame_index") - F.col("end.frame_index")).where(f"gap BETWEEN 1 AND {max_gap}")
    h0, h1 = F.col("end.y1") - F.col("end.y0"), F.col("start.y1") - F.col("start.y0")
    dx, dy = (F.col("start.x0") + F.col("start.x1") - F.col("end.x0") - F.col("end.x1")) / 2, F.col("start.y1") - F.col("end.y1")
    still, walk = F.sqrt(dx * dx + dy * dy), F.sqrt((dx - F.col("vx") * F.col("gap")) ** 2 + (dy - F.col("vy") * F.col("gap")) ** 2)
    score = F.least(still, walk) / F.greatest(h0, F.lit(1e-6))
    ok = (score <= base + rate * F.col("gap")) & (F.greatest(h0, h1) <= size_ratio * F.least(h0, h1))
    return j.withColumn("score", score).where(ok).select("camera_id", "a_id", "b_id", "gap", "score")


def stitch_greedy(candidates: DataFrame) -> DataFrame:
    """The candidates that taking them by rising score would keep, each fragment with one successor and one predecessor.

    In a round every candidate that is the best of both its fragments is taken and its rivals go; what is left meets
    again, until no candidate is open. With a strict order (score, hash of the ids, a_id, b_id) that is the greedy choice;
    the hash lets a clique of equal scores end in few rounds. ``checkpoint`` ends each round's lineage.
    """
    left, kept, rounds = candidates.checkpoint(), None, 0
    order = ["score", F.xxhash64("a_id", "b_id"), "a_id", "b_id"]
    while left.limit(1).count():
        r = left.withColumns({"_a": F.row_number().over(Window.partitionBy("camera_id", "a_id").orderBy(*order)), "_b": F.row_number().over(Window.partitionBy("camera_id", "b_id").orderBy(*order))})
        take = r.where("_a = 1 AND _b = 1").drop("_a", "_b").checkpoint()
        kept, rounds = take if kept is None else kept.unionByName(take), rounds + 1
        if rounds % 16 == 0:
            kept = kept.checkpoint()
        left = left.join(take.select("camera_id", "a_id"), ["camera_id", "a_id"], "left_anti").join(take.select("camera_id", "b_id"), ["camera_id", "b_id"], "left_anti").checkpoint()
    return kept if kept is not None else candidates.limit(0)


def chains(links: DataFrame) -> DataFrame:
    """(camera_id, track_id, head): the first fragment of the chain that each linked fragment is in, by pointer doubling until nothing moves.

    Links that form a ring have no first fragment and are an error.
    """
    p = links.select("camera_id", F.col("b_id").alias("track_id"), F.col("a_id").alias("head")).checkpoint()
    for _ in range(p.count().bit_length() + 1):
        q = p.select("camera_id", F.col("track_id").alias("head"), F.col("head").alias("_h"))
        n = p.join(q, ["camera_id", "head"], "left").select("camera_id", "track_id", F.coalesce("_h", "head").alias("head"), F.col("_h").isNotNull().alias("_m")).checkpoint()
        p = n.drop("_m")
        if not n.where("_m").limit(1).count():
            break
    else:
        raise ValueError("links form a ring")
    return p.unionByName(p.select("camera_id", F.col("head").alias("track_id"), "head").distinct())


def interpolate(obs: DataFrame) -> DataFrame:
    """Observations plus straight-line boxes in the gaps of each track, flagged."""
    w = Window.partitionBy(*TRACK).orderBy("frame_index")
    cols = ["x0", "y0", "x1", "y1"]
    gaps = obs.withColumns({f"_{c}": F.lag(c).over(w) for c in ("frame_index", *cols)}).where(F.col("frame_index") - F.col("_frame_index") > 1)
    filled = gaps.withColumn("f", F.explode(F.sequence(F.col("_frame_index") + 1, F.col("frame_index") - 1)))
    share = (F.col("f") - F.col("_frame_index")) / (F.col("frame_index") - F.col("_frame_index"))
    rows = filled.select(*TRACK, F.col("f").alias("frame_index"), *[(F.col(f"_{c}") + (F.col(c) - F.col(f"_{c}")) * share).alias(c) for c in cols], F.lit(True).alias("interpolated"))
    return obs.select(*TRACK, "frame_index", *cols, F.lit(False).alias("interpolated")).unionByName(rows)


def copresence(obs: DataFrame) -> DataFrame:
    """(camera_id, a_id, b_id, frames, max_iou, at_frame) of tracks that share frames; see :func:`aislewatch.operators.pairs.meetings`."""
    return meetings(obs)


def endings(obs: DataFrame, det: DataFrame, speed: float = 60.0, max_gap: int = 15) -> DataFrame:
    """(camera_id, track_id, last_frame, why, recovered_at): lost where a later detection of another box lies within reach of the last one, gone where none does, censored near the camera's end."""
    last = obs.groupBy(*TRACK).agg(F.max_by(F.struct("frame_index", "x0", "x1", "y1"), "frame_index").alias("l"))
    end = obs.groupBy("camera_id").agg(F.max("frame_index").alias("_end"))
    d = det.select("camera_id", F.col("frame_index").alias("_f"), ((F.col("x0") + F.col("x1")) / 2).alias("_u"), F.col("y1").alias("_v"), F.col("track_id").alias("_t"), F.floor(F.col("frame_index") / max_gap).alias("_k"))
    e = last.withColumn("_k", F.explode(F.array(F.floor(F.col("l.frame_index") / max_gap), F.floor(F.col("l.frame_index") / max_gap) + 1)))
    dt = F.col("_f") - F.col("l.frame_index")
    du, dv = F.col("_u") - (F.col("l.x0") + F.col("l.x1")) / 2, F.col("_v") - F.col("l.y1")
    near = e.join(d, ["camera_id", "_k"]).where((dt > 0) & (dt <= max_gap) & (F.col("_t") != F.col("track_id")) & (F.sqrt(du * du + dv * dv) <= speed * dt))
    first = near.groupBy(*TRACK).agg(F.min("_f").alias("recovered_at"))
    out = last.join(first, TRACK, "left").join(end, "camera_id")
    why = F.when(F.col("l.frame_index") > F.col("_end") - max_gap, "censored").when(F.col("recovered_at").isNotNull(), "lost").otherwise("gone")
    return out.select(*TRACK, F.col("l.frame_index").alias("last_frame"), why.alias("why"), "recovered_at")


def drop_static(det: DataFrame, share: float = 0.5, least: float = 0.8) -> DataFrame:
    """Detections with ``static``: whether the box comes again (IoU of ``least``) in max(round(share n), 2) other frames of its camera's n.

    Boxes that overlap so much have longer sides that differ by the factor 1 / ``least`` at most, and centres that differ by at most (1 - ``least``) of the
    longer one. So boxes are dealt to bands of their longer side, each a power of two, and in a band to cells of that reach; a box
    looks into the cells around its centre in its own band and those that its partners can be in. Rows that look are many times the detections, which
    Spark's estimate of a table's size doesn't know: the join is a merge by a hint, never a broadcast.
    """
    steps = max(1, math.ceil(-math.log2(least)))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-6))
    band = F.floor(F.log2(side)).cast("int")
    reach = lambda k: F.pow(F.lit(2.0), k + 1) / least * (1 - least)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    n = det.groupBy("camera_id").agg(F.countDistinct("frame_index").alias("_n"))
    corners = ("x0", "y0", "x1", "y1")
    a = det.select("camera_id", "det_id", F.col("frame_index").alias("_fa"), *[F.col(c).alias(f"a_{c}") for c in corners], cx.alias("_u"), cy.alias("_v"), F.explode(F.sequence(band - steps, band + steps)).alias("_k"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = a.withColumn("_o", around).withColumns({"_cx": F.floor(F.col("_u") / reach(F.col("_k"))) + F.col("_o.i"), "_cy": F.floor(F.col("_v") / reach(F.col("_k"))) + F.col("_o.j")}).drop("_u", "_v", "_o")
    b = det.select("camera_id", band.alias("_k"), F.floor(cx / reach(band)).alias("_cx"), F.floor(cy / reach(band)).alias("_cy"), "frame_index", *[F.col(c).alias(f"b_{c}") for c in corners])
    hits = a.hint("merge").join(b.hint("merge"), ["camera_id", "_k", "_cx", "_cy"]).where((F.col("frame_index") != F.col("_fa")) & (iou(box("a_"), box("b_")) >= least)).groupBy("det_id").agg(F.countDistinct("frame_index").alias("_again"))
    need = F.greatest(F.round(F.lit(share) * F.col("_n")), F.lit(2))
    return det.join(n, "camera_id").join(hits, "det_id", "left").withColumn("static", F.coalesce(F.col("_again") >= need, F.lit(False))).drop("_n", "_again")


def owner_runs(rows: DataFrame) -> DataFrame:
    """Along each track (owner column: another tracker's id) the runs of one owner, and the owner that takes over next."""
    w = Window.partitionBy(*TRACK).orderBy("frame_index")
    r = rows.withColumn("_c", F.coalesce((F.col("owner") != F.lag("owner").over(w)).cast("int"), F.lit(0))).withColumn("run", F.sum("_c").over(w))
    g = r.groupBy(*TRACK, "run", "owner").agg(F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"), F.count("*").alias("n"))
    return g.withColumn("next_owner", F.lead("owner").over(Window.partitionBy(*TRACK).orderBy("run")))


def longest_low_spell(obs: DataFrame, value: Column, limit: float, fps: float = 5.0) -> DataFrame:
    """Per track the longest unbroken spell of ``value`` at or below ``limit``, in seconds."""
    r = observed_runs(obs, TRACK, value <= limit).groupBy(*TRACK, "run").agg(((F.max("frame_index") - F.min("frame_index") + 1) / F.lit(float(fps))).alias("s"))
    return r.groupBy(*TRACK).agg(F.max("s").alias("seconds"))


def farthest_first(rows: DataFrame, k: int = 5, *keys: str) -> DataFrame:
    """Up to ``k`` rows (item, feat) of each group, each the farthest from those before; the first is the smallest item, ties go to it.

    A round for each place; no row is taken twice. ``checkpoint`` ends each round's lineage.
    """
    left, kept = rows.select(*keys, "item", "feat", F.lit(float("inf")).alias("_far")).checkpoint(), None
    for place in range(k):
        at = left.groupBy(*keys).agg(F.min_by(F.struct("item", "feat"), F.struct(-F.col("_far"), F.col("item"))).alias("_at")).where("_at IS NOT NULL").checkpoint()
        some = at.select(*keys, F.col("_at.item").alias("item"), F.lit(place).cast("long").alias("place"))
        kept = some if kept is None else kept.unionByName(some)
        to = at.select(*[F.col(c).alias(f"_{n}") for n, c in enumerate(keys)], "_at")
        same = F.lit(True)
        for n, c in enumerate(keys):
            same = same & F.col(c).eqNullSafe(F.col(f"_{n}"))
        d = F.aggregate(F.zip_with("feat", "_at.feat", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
        left = left.join(to, same).where("item <> _at.item").select(*keys, "item", "feat", F.least("_far", d).alias("_far")).checkpoint()
    return kept


def entrance_clusters(points: DataFrame, radius: float = 1.0) -> DataFrame:
    """Clusters of a camera's birth and death points (x, z, order): a point joins the first running mean within ``radius``, or starts one."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        means: list[list[float]] = []
        for x, z in pdf.sort_values("order", kind="stable")[["x", "z"]].to_numpy(float):
            for m in means:
                if np.hypot(m[0] - x, m[1] - z) <= radius:
                    m[2] += 1
                    m[0] += (x - m[0]) / m[2]
                    m[1] += (z - m[1]) / m[2]
                    break
            else:
                means.append([x, z, 1])
        return pd.DataFrame([(pdf.camera_id.iloc[0], i, *m) for i, m in enumerate(means)], columns=["camera_id", "cluster", "x", "z", "n"])

    return points.groupBy("camera_id").applyInPandas(cluster, "camera_id long, cluster long, x double, z double, n double")


def births_and_deaths(obs: DataFrame) -> DataFrame:
    """First and last floor points of tracks that start after the camera's second frame and end before its last but one."""
    ends = obs.groupBy("camera_id").agg(F.max("frame_index").alias("_end"))
    p = F.struct(F.col("frame_index").alias("f"), F.col("x_m").alias("x"), F.col("z_m").alias("z"))
    t = obs.groupBy(*TRACK).agg(F.min_by(p, "frame_index").alias("a"), F.max_by(p, "frame_index").alias("b")).join(ends, "camera_id")
    born = t.where("a.f >= 2").select(*TRACK, F.lit("birth").alias("kind"), F.col("a.f").alias("frame_index"), F.col("a.x").alias("x"), F.col("a.z").alias("z"))
    died = t.where("b.f <= _end - 2").select(*TRACK, F.lit("death").alias("kind"), F.col("b.f").alias("frame_index"), F.col("b.x").alias("x"), F.col("b.z").alias("z"))
    return born.unionByName(died)
