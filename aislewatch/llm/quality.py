"""Quality scores by Bradley-Terry pairwise ranking over surface features of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewatch.llm.common import table
from aislewatch.llm.labelled import labelled_texts, remainder
from aislewatch.llm.words import SPACE, Words, text_pieces

CUT = 0.3
_KIND = np.zeros((8, 256), np.float64)
for _row, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"?-", b"!", b"#$%&*+/<=>@\\^_`{|}~", b"\n", range(128, 256))):
    _KIND[_row, list(_bytes)] = 1
_COLUMN = np.where(_KIND.any(axis=0), _KIND.argmax(axis=0), 8)
FEATURES = 16


def text_features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each text: shares of byte kinds, word lengths, repetition, size."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(row * 9 + _COLUMN[buf], minlength=9 * n).reshape(n, 9)[:, :8] / np.maximum(1, np.diff(off))[:, None]
    w = Words(buf, off, SPACE)
    h, count = w.hashes(), np.maximum(1, w.count)
    length = (w.end - w.start).astype(np.float64)
    total = np.bincount(w.doc, length, n)
    mean = total / count
    spread = np.sqrt(np.maximum(0, np.bincount(w.doc, length**2, n) / count - mean**2))
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    same = np.bincount(w.doc, again, n) / count
    order = np.lexsort((h, w.doc))
    new = np.ones(len(h))
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order], new, n) / count
    shout = np.bincount(w.doc, ((buf[w.start] >= 65) & (buf[w.start] <= 90)).astype(float), n) / count
    odd = np.bincount(w.doc, (_COLUMN[buf[w.end - 1]] == 5).astype(float), n) / count
    expected = distinct - 1 / (1 + np.log1p(count) / 8)  # long texts say more words again
    return np.column_stack([np.sqrt(kinds), np.log1p(count), np.minimum(mean, 30) / 10, np.minimum(spread, 30) / 10, same, expected, shout, odd, (w.count == 0)])


class Ranker:
    """score = x.w of standardised features and their squares; ``cut`` is the quantile of the training scores that the threshold stands for."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, seed: int = 9):
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        z = self.expand(x)
        r = np.random.default_rng(seed)
        d = z[r.choice(np.flatnonzero(y == 1), pairs)] - z[r.choice(np.flatnonzero(y == 0), pairs)]
        w = np.zeros(d.shape[1])
        for _ in range(25):  # Newton's method on the mean of log(1 + exp(-d.w))
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        s = z @ w
        tries = np.quantile(s, np.linspace(0.005, 0.6, 240))
        right = [((s >= c) & (y == 1)).sum() / (y == 1).sum() + ((s < c) & (y == 0)).sum() / (y == 0).sum() for c in tries]
        best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
        self.cut = float(tries[best[len(best) // 4]])
        self.width = float(s.std() + 1e-6) / 2

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.column_stack([z, z**2])

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, CUT at the threshold's quantile."""
        t = (self.expand(x) @ self.w - self.cut) / self.width + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, off in text_pieces(batch.column(1)):
            x = text_features(buf, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["_id", "label", "x"])


def fit_quality(rows: DataFrame) -> Ranker | None:
    """A ranker of the rows (doc_id, text, label 0 or 1; a bounded sample); only features reach the driver. None without both labels."""
    got = rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(_features, "_id long, label int, x array<double>").collect()
    got.sort(key=lambda r: (r._id, r.label, r.x))
    y = np.array([r.label for r in got])
    return Ranker(np.array([r.x for r in got]), y) if len(got) and y.min() == 0 and y.max() == 1 else None


def score_quality(docs: DataFrame, model: Ranker | None, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, score) for every row of ``docs``. Null texts are scored as empty ones. Without a model (one label
    only) every score is 1. Repeated rows are scored each; other columns are ignored."""
    slim = docs.select(F.col(id_col).alias("_id"), "text")
    if model is None:
        return slim.select(F.col("_id").alias(id_col), F.lit(1.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in text_pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.score(text_features(buf, off)))], names=["_id", "score"])

    return slim.mapInArrow(score, f"_id {slim.schema['_id'].dataType.simpleString()}, score double").withColumnRenamed("_id", id_col)


def op4_bradley_terry(spark: SparkSession, sf_dir: str, bound: int = 6000) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", bound))
    return score_quality(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
