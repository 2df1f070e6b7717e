"""Language identification by a bidirectional gated recurrent network that labels every byte of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewatch.llm.labelled import class_sample, remainder
from aislewatch.llm.common import table
from aislewatch.llm.words import text_pieces

WINDOW, CONTEXT = 512, 32  # bytes that a run over a text labels, and bytes before and after them that it reads as well
TRAINED = 64  # bytes of a training sequence
AT_ONCE = 1024  # windows that a worker runs side by side


def _soft(x: np.ndarray) -> np.ndarray:
    """Softsign, from -1 to 1."""
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of softsign where its value is ``y``."""
    return (1 - np.abs(y)) ** 2


class ByteGRU:
    """Embedding, one gated recurrent layer each way, and a softmax at every byte.

    z, r = (1 + s(x Wx + h Wh + b)) / 2, c = s(x Wc + (r h) Uc + bc), h' = (1 - z) h + z c, where s is softsign, which
    costs a quarter of tanh and the logistic function in numpy. Sequences are stretches of bytes as they stand, with spaces, digits and punctuation. Trained by backpropagation through time on the cross
    entropy of all positions, with Adam. Byte ids are the bytes + 1; 0 stands for no byte.
    """

    def __init__(self, classes: list[str], embed: int = 8, hidden: int = 8, seed: int = 3):
        r = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        f = np.float32
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(f)
        self.p = {"E": (r.standard_normal((257, embed)) * 0.3).astype(f), "V": g(2 * hidden, len(classes)), "v": np.zeros(len(classes), f)}
        for d in "fb":
            self.p |= {f"W{d}": g(embed, 3 * hidden), f"U{d}": g(hidden, 2 * hidden), f"C{d}": g(hidden, hidden), f"b{d}": np.zeros(3 * hidden, f)}

    def _run(self, xw: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """xw: input products [T, N, 3H]; the states of all positions, and what the way back needs."""
        h_n, t_n = self.hidden, xw.shape[0]
        h = np.zeros((xw.shape[1], h_n), np.float32)
        out, kept = np.zeros((t_n, xw.shape[1], h_n), np.float32), []
        for t in range(t_n) if d == "f" else range(t_n - 1, -1, -1):
            zr = 0.5 + 0.5 * _soft(xw[t, :, : 2 * h_n] + h @ self.p[f"U{d}"])
            z, r = zr[:, :h_n], zr[:, h_n:]
            c = _soft(xw[t, :, 2 * h_n :] + (r * h) @ self.p[f"C{d}"])
            m = mask[t][:, None]
            new = h + m * z * (c - h)
            if keep:
                kept.append((t, h, z, r, c, m))
            out[t] = h = new
        return out, kept

    def probabilities(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The probabilities of the classes at every position, [T, C, N], of sequences ``x`` [N, T] of ``n`` bytes.

        As :meth:`_forward`, but both ways at once: the way back runs over the reversed sequences. Positions past a
        sequence's end come last on the way there, and first on the way back, where the state stays zero.
        """
        k, (count, t_n) = self.hidden, x.shape
        back = np.where(np.arange(t_n)[None, :] < n[:, None], np.take_along_axis(x, np.maximum(n[:, None] - 1 - np.arange(t_n)[None, :], 0), 1), 0)
        steps = np.ascontiguousarray(np.concatenate([x, back]).T)
        inputs = [(self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]).T.copy() for d in "fb"]
        u, c = [self.p[f"U{d}"].T.copy() for d in "fb"], [0.5 * self.p[f"C{d}"].T for d in "fb"]
        h = np.zeros((k, 2 * count), np.float32)
        states = np.empty((t_n, k, 2 * count), np.float32)
        xw, sides, spare = np.empty((3 * k, 2 * count), np.float32), (slice(0, count), slice(count, None)), np.empty((2 * k, 2 * count), np.float32)
        zr, new, rh = xw[: 2 * k], xw[2 * k :], np.empty_like(h)  # z and r twice as large, and so halved below
        for t in range(t_n):
            for i, s in enumerate(sides):
                xw[:, s] = inputs[i].take(steps[t, s], axis=1)
                zr[:, s] += u[i] @ h[:, s]
            np.abs(zr, out=spare)
            spare += 1
            zr /= spare
            zr += 1
            np.multiply(zr[k:], h, out=rh)
            for i, s in enumerate(sides):
                new[:, s] += c[i] @ rh[:, s]
            np.abs(new, out=rh)
            rh += 1
            new /= rh
            new -= h
            new *= zr[:k]
            new *= np.float32(0.5)
            h = np.add(h, new, out=states[t])
        v = self.p["V"].T.copy()
        out = np.einsum("ck,tkn->tcn", v[:, :k], states[:, :, :count], optimize=True)
        turned = np.einsum("ck,tkn->tcn", v[:, k:], states[:, :, count:], optimize=True)
        at = np.maximum(n[None, :] - 1 - np.arange(t_n)[:, None], 0)
        out += np.take_along_axis(turned, at[:, None, :], 0) + self.p["v"][None, :, None]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def _forward(self, x: np.ndarray, n: np.ndarray, keep: bool = False) -> tuple:
        mask = (np.arange(x.shape[1])[:, None] < n[None, :]).astype(np.float32)
        xt = x.T
        states, kept = [], {}
        for d in "fb":
            by_byte = self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]  # the input products of all 257 bytes
            s, kept[d] = self._run(by_byte[xt], mask, d, keep)
            states.append(s)
        hs = np.concatenate(states, axis=2)
        logits = hs @ self.p["V"] + self.p["v"]
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), mask, hs, kept, xt

    def _gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        lp, mask, hs, kept, xt = self._forward(x, n, True)
        h_n, g = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        err = np.exp(lp)
        err[:, np.arange(len(y)), y] -= 1
        err *= mask[:, :, None] / mask.sum()
        g["V"] = np.einsum("tnh,tnc->hc", hs, err, optimize=True)
        g["v"] = err.sum((0, 1))
        back = err @ self.p["V"].T
        for k, d in enumerate("fb"):
            dh = np.zeros((x.shape[0], h_n), np.float32)
            dxw = np.zeros((x.shape[1], x.shape[0], 3 * h_n), np.float32)
            for t, h, z, r, c, m in reversed(kept[d]):
                dh = dh + back[t, :, k * h_n : (k + 1) * h_n]
                dz, dc = dh * m * (c - h), dh * m * z
                da_c = dc * _slope(c)
                drh = da_c @ self.p[f"C{d}"].T
                da_zr = 0.5 * np.concatenate([dz * _slope(2 * z - 1), drh * h * _slope(2 * r - 1)], axis=1)
                g[f"C{d}"] += (r * h).T @ da_c
                g[f"U{d}"] += h.T @ da_zr
                dxw[t] = np.concatenate([da_zr, da_c], axis=1)
                dh = dh * (1 - m * z) + drh * r + da_zr @ self.p[f"U{d}"].T
            flat, ids = dxw.reshape(-1, 3 * h_n), xt.reshape(-1)
            by_byte = np.zeros((257, 3 * h_n), np.float32)
            np.add.at(by_byte, ids, flat)
            g[f"b{d}"] = flat.sum(0)
            g[f"W{d}"] = self.p["E"].T @ by_byte
            g["E"] += by_byte @ self.p[f"W{d}"].T
        return g

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.02, seed: int = 5) -> ByteGRU:
        """Each step takes stretches of TRAINED bytes from random places of random texts, as many of each class."""
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        size = np.array([len(t) for t in texts])
        pools = [np.flatnonzero((labels == c) & (size > 0)) for c in range(len(self.classes))]
        for step in range(1, steps + 1):
            pick = np.concatenate([r.choice(p, batch // len(pools) + 1, p=size[p] / size[p].sum()) for p in pools if len(p)])
            at = r.integers(0, np.maximum(1, size[pick] - TRAINED + 1))
            some = [texts[i][a : a + TRAINED] for i, a in zip(pick, at, strict=True)]
            n = np.array([len(s) for s in some])
            x = np.zeros((len(some), int(n.max())), np.int64)
            x[np.arange(x.shape[1])[None, :] < n[:, None]] = np.frombuffer(b"".join(some), np.uint8).astype(np.int64) + 1
            g = self._gradients(x, n, labels[pick])
            lr = rate * (1 - 0.9 * step / steps)
            for q, v in g.items():
                m1[q] = 0.9 * m1[q] + 0.1 * v
                m2[q] = 0.999 * m2[q] + 0.001 * v * v
                self.p[q] -= (lr * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fit_language(docs: DataFrame, lang_col: str = "lang", per_class: int = 400) -> ByteGRU | None:
    """A network fitted to the texts of about ``per_class`` documents at most of each language of ``docs``, whose rows may
    all be learnt from; None if there are none."""
    rows = class_sample(docs.where("text is not null"), "doc_id", lang_col, per_class).select("doc_id", "text", lang_col).collect()
    classes = sorted({r[2] for r in rows})
    if not classes:
        return None
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.text))
    texts = [r.text.encode() for r in rows]
    model = ByteGRU(classes)
    return model.train(texts, np.array([classes.index(r[2]) for r in rows])) if any(texts) else model


def text_probabilities(buf: np.ndarray, off: np.ndarray, model: ByteGRU) -> np.ndarray:
    """The mean of the class probabilities at all bytes of each row; zeros for empty rows.

    Rows are cut into windows of WINDOW bytes, each run together with CONTEXT bytes on its two sides.
    """
    sums = np.zeros((len(off) - 1, len(model.classes)))
    size = np.diff(off)
    many = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), many)
    start = off[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
    lo, hi = np.maximum(off[:-1][row], start - CONTEXT), np.minimum(off[1:][row], start + WINDOW + CONTEXT)
    stop = np.minimum(off[1:][row], start + WINDOW)
    order = np.argsort(hi - lo, kind="stable")
    for a in range(0, len(order), AT_ONCE):
        w = order[a : a + AT_ONCE]
        n = hi[w] - lo[w]
        at = np.arange(int(n.max()))[None, :]
        x = np.where(at < n[:, None], buf[np.minimum(lo[w][:, None] + at, len(buf) - 1)].astype(np.int64) + 1, 0)
        p = model.probabilities(x, n)
        own = ((at >= (start[w] - lo[w])[:, None]) & (at < (stop[w] - lo[w])[:, None])).T.astype(np.float32)
        np.add.at(sums, row[w], np.einsum("tcn,tn->nc", p, own, optimize=True))
    return sums / np.maximum(size, 1)[:, None]


def _has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode()))


def _predict(batches: Iterator[pa.RecordBatch], model: ByteGRU) -> Iterator[pa.RecordBatch]:
    names = np.array(model.classes, dtype=object)
    for batch in batches:
        for a, b, buf, off in text_pieces(batch.column(1)):
            p = text_probabilities(buf, off, model)
            best = p.argmax(axis=1)
            ascii_letter = np.concatenate([[0], np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122))])
            letters = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
            for i in np.flatnonzero(~letters):
                letters[i] = _has_letter(buf[off[i] : off[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.where(letters, names[best], "und"), pa.string()), pa.array(np.where(letters, p[np.arange(b - a), best], 0.0))], names=["_id", "lang_pred", "score"])


def identify_language(docs: DataFrame, model: ByteGRU | None, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, lang_pred, score) for every row of ``docs``.

    The network labels every byte of the whole text, however long; a document's probabilities are the means of its
    bytes', and score is the largest. ``und`` with score 0 where the text is null or has no letter, or nothing could be
    learnt. Repeated rows are scored each, alike; ties go to the first value in the order of names; an empty table
    gives an empty result; other columns, whatever their names, are ignored.
    """
    slim = docs.select(F.col(id_col).alias("_id"), "text")
    if model is None:
        return slim.select(F.col("_id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return slim.mapInArrow(lambda batches: _predict(batches, shared.value), f"_id {slim.schema['_id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def op2_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.where(remainder("doc_id", 4) != 2))
    return identify_language(docs, model).withColumn("held_out", remainder("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score")
