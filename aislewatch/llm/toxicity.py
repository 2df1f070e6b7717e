"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks."""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewatch.llm.common import filter_texts, table
from aislewatch.llm.labelled import known_labels, labelled_texts, remainder
from aislewatch.llm.memo import Memo, worker_memo
from aislewatch.llm.words import CHUNK, LOWER, SPACE, Words, text_pieces

SPAN, DECAY, LONGEST = 6, 0.6, 20
SYMBOLS = 64
# a-z, 0-9, then all other bytes dealt to 27 symbols; 63 stands for punctuation, which a subsequence may skip but not hold
CODE = (np.arange(256) % 27 + 36).astype(np.int64)
CODE[97:123] = np.arange(26)
CODE[48:58] = np.arange(26, 36)
CODE[[*range(48), *range(58, 97), *range(123, 128)]] = 63
PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and weights, a row for each word: all subsequences of three characters that span up to SPAN bytes,
    each weighing DECAY to the power of the bytes it spans; the kernel is the product of these vectors over their norms."""
    n = np.array([len(w) for w in words])
    code = np.full((len(words), int(n.max(initial=0)) + SPAN), 63, np.int64)
    code[:, : code.shape[1] - SPAN][np.arange(code.shape[1] - SPAN)[None, :] < n[:, None]] = CODE[np.frombuffer(b"".join(words), np.uint8)]
    t = code.shape[1] - SPAN
    ids, weights = [], []
    ok = code != 63
    for a, b in PAIRS:
        good = ok[:, :t] & ok[:, a : a + t] & ok[:, b : b + t]
        ids.append(np.where(good, (code[:, :t] * SYMBOLS + code[:, a : a + t]) * SYMBOLS + code[:, b : b + t], 0))
        weights.append(np.where(good, DECAY ** (b + 1), 0.0).astype(np.float32))
    return np.concatenate(ids, axis=1), np.concatenate(weights, axis=1)


def norms(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Roots of the words' kernels with themselves; a subsequence that comes again adds to its first."""
    order = np.argsort(ids, axis=1, kind="stable")
    i, w = np.take_along_axis(ids, order, 1), np.take_along_axis(weights, order, 1).astype(np.float64)
    c = np.concatenate([np.zeros((len(i), 1)), np.cumsum(w, axis=1)], axis=1)
    last = np.concatenate([i[:, 1:] != i[:, :-1], np.ones((len(i), 1), bool)], axis=1)
    upto = np.where(last, c[:, 1:], 0)
    before = np.concatenate([np.zeros((len(i), 1)), np.maximum.accumulate(upto, axis=1)[:, :-1]], axis=1)
    return np.sqrt(np.maximum((np.where(last, upto - before, 0) ** 2).sum(axis=1), 1e-12))


def pieces(word: bytes) -> list[bytes]:
    """A word without the punctuation around it, and without that inside it if it has any; in overlapping parts if long."""
    w = word.strip(EDGE)
    bare = w.translate(None, EDGE)
    return parts(w) if len(bare) == len(w) else parts(w) + parts(bare)


def parts(w: bytes) -> list[bytes]:
    return [w] if len(w) <= LONGEST else [w[a : a + LONGEST] for a in range(0, len(w) - LONGEST // 2, LONGEST // 2)]


class KernelSVM:
    """Decision values of words. In the space of subsequences, Nystroem features and the machine's weights together are
    one vector, ``table``; a word's value is its product with the word's vector over the norm, plus ``bias``."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        ids, w = subsequences(landmarks)
        # only the subsequences of landmarks matter to the kernel with them: their columns, and one of zeros for all others
        used = np.unique(ids)
        self.column = np.full(SYMBOLS**3, len(used), np.int32)
        self.column[used] = np.arange(len(used))
        phi = np.zeros((len(landmarks), len(used) + 1))
        np.add.at(phi, (np.arange(len(landmarks))[:, None], self.column[ids]), w)
        phi /= np.sqrt((phi**2).sum(axis=1, keepdims=True) + 1e-12)
        values, vectors = np.linalg.eigh(phi @ phi.T)
        use = values > 1e-3
        self.root = vectors[:, use] / np.sqrt(values[use])  # K(landmarks)^-1/2
        self.phi, self.bias, self.table = phi.astype(np.float32), 0.0, np.zeros(SYMBOLS**3, np.float32)

    def features(self, words: list[bytes]) -> np.ndarray:
        out = []
        for a in range(0, len(words), 512):
            ids, w = subsequences(words[a : a + 512])
            x = np.zeros((len(ids), self.phi.shape[1]), np.float32)
            np.add.at(x, (np.arange(len(ids))[:, None], self.column[ids]), w)
            x[:, -1] = 0
            k = x @ self.phi.T
            out.append((k / norms(ids, w)[:, None]) @ self.root)
        return np.concatenate(out) if out else np.zeros((0, self.root.shape[1]))

    def train(self, x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.2) -> None:
        """Squared hinge loss by Newton's method; ``y`` is -1 or 1."""
        x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        w = np.zeros(x1.shape[1])
        reg = np.full(x1.shape[1], ridge)
        reg[-1] = 1e-3
        for _ in range(30):
            inside = y * (x1 @ w) < 1
            xa, ca = x1[inside], cost[inside]
            new = np.linalg.solve(np.diag(reg) + (xa * ca[:, None]).T @ xa, xa.T @ (ca * y[inside]))
            if np.abs(new - w).max() < 1e-6:
                break
            w = new
        small = (self.phi.T.astype(np.float64) @ (self.root @ w[:-1])).astype(np.float32)
        self.table = np.append(small[:-1], np.float32(0))[self.column]
        self.bias = float(w[-1])

    def whole(self, windows: list[bytes]) -> np.ndarray:
        """The value of each window as it is."""
        got = np.empty(len(windows))
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))  # windows of like lengths go together
        for a in range(0, len(windows), 1024):
            at = order[a : a + 1024]
            ids, w = subsequences([windows[i] for i in at])
            got[at] = (self.table[ids] * w).sum(axis=1) / norms(ids, w) + self.bias
        return got

    def words(self, words: list[bytes]) -> np.ndarray:
        """One column: the largest value of each word's parts; windows of several words are valued as they are."""
        cut = [[w] if b" " in w else pieces(w) for w in words]
        n, flat = np.array([len(x) for x in cut]), [p for x in cut for p in x]
        got = self.whole(flat)
        return np.maximum.reduceat(got, np.cumsum(n) - n)[:, None].astype(np.float32) if len(words) else np.zeros((0, 1), np.float32)


def spelt_out(w: Words, row: int) -> list[bytes]:
    """Runs of four single characters or more in a row of text, each run joined into one word."""
    single = np.diff(np.concatenate([[0], (w.end - w.start)[w.first[row] : w.first[row + 1]] == 1, [0]]).astype(np.int8))
    return [b"".join(w.word(int(w.first[row]) + k) for k in range(a, b)) for a, b in zip(np.flatnonzero(single == 1), np.flatnonzero(single == -1), strict=True) if b - a >= 4]


SENTENCE = re.compile(rb"[.!?\n]+")
MARK = np.zeros(256, bool)
MARK[list(b".!?\n")] = True
WORDS, LONGEST_WINDOW = 3, 40  # windows are single words and two or three neighbouring words of a sentence in up to so many bytes
NONE = -3.0  # the value of a window that isn't there
PIECE = CHUNK // 4  # bytes of text that are worked on at once
KEPT = 200_000  # words whose values a worker keeps
BALANCE = 1.0  # what a window of toxic texts weighs against one of clean texts
HARD = -0.3  # clean windows of several words that are valued over it join the training, where toxic texts have such windows of their own
PENALTY = 0.5  # what a window of several words has to be valued more than a word: clean sentences have many that overlap


def neighbours(w: Words, table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, first byte, last byte + 1, bound) of every window of two or three words of one sentence; no window's value is over its bound.

    The sums of a window's subsequences, white space and punctuation skipped, come from running sums over the bytes, one for each
    span. Without the subsequences that come again its norm is less than the true one, so a value over 0 is less than this bound.
    """
    n = len(w.low)
    code = np.full(n + SPAN, 63, np.int32)
    code[:n] = CODE[w.low]
    ok = (code != 63).astype(np.int32)
    total, square = [], []
    for b in range(2, SPAN):
        got, many = np.zeros(n, np.float64), np.zeros(n, np.int32)
        high, low = code[:n] << 12, code[b : n + b]
        for a in range(1, b):
            got += table[high + (code[a : n + a] << 6) + low]
            many += ok[a : n + a]
        both = ok[:n] * ok[b : n + b]
        total.append(np.concatenate([[0.0], np.cumsum(got * both * DECAY ** (b + 1))]))
        square.append(np.concatenate([[0.0], np.cumsum(many * both * DECAY ** (2 * (b + 1)))]))
    sentence = np.concatenate([[0], np.cumsum(MARK[w.low])])[w.start]
    found = []
    for k in range(1, WORDS):
        i = np.arange(max(0, len(w.start) - k))
        i = i[(w.doc[i] == w.doc[i + k]) & (sentence[i] == sentence[i + k]) & (w.end[i + k] - w.start[i] <= LONGEST_WINDOW)]
        found.append((i, w.start[i], w.end[i + k]))
    i, s, e = (np.concatenate([f[c] for f in found]) for c in range(3))
    t, q = np.zeros(len(s)), np.zeros(len(s))
    for b, p, r in zip(range(2, SPAN), total, square, strict=True):
        stop = np.maximum(s, e - b)
        t += p[stop] - p[s]
        q += r[stop] - r[s]
    return i, s, e, np.where(t > 0, t / np.sqrt(np.maximum(q, 1e-12)), 0.0) + bias


class ToxicModel:
    """``svm`` values windows of sentences, and a sentence has its highest window's value; ``weights`` (of a text's two highest sentences and its second word, the
    logarithm of its number of words, and a constant) and ``alone`` (a value beyond which one sentence is enough) make a text's probability of them."""

    def __init__(self, svm: KernelSVM, weights: np.ndarray, alone: float):
        self.svm, self.weights, self.alone = svm, weights, alone

    def probability(self, two: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.maximum(_inputs(two, windows) @ self.weights, 8 * (two[:, 0] - self.alone)), -30, 30)))


def _inputs(two: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip(two, -1.5, 1.5), np.log(windows + 1.0), np.ones(len(two))])


def sentence_bags(text: str) -> list[list[bytes]]:
    """The words (without punctuation around them) of each sentence, lower-cased as in scoring: A-Z only."""
    low = text.encode().translate(LOWER.tobytes())
    return [[x for w in s.split() if (x := w.strip(EDGE))] for s in SENTENCE.split(low)]


def sentence_windows(words: list[bytes]) -> list[bytes]:
    """All windows of a sentence: its words, and two or three neighbouring ones."""
    return [x for k in range(WORDS) for i in range(len(words) - k) if len(x := b" ".join(words[i : i + k + 1])) <= LONGEST_WINDOW or not k]


def _two(values: list[float]) -> list[float]:
    return sorted([*values, NONE, NONE], reverse=True)[:2]


def _odds(toxic: Counter, clean: Counter) -> dict[bytes, int]:
    """Words of three toxic texts or more, and windows of several words of eight (there are so many that some come by chance), that toxic texts have twenty times as
    often as clean ones; of windows that hold another such one the shorter stays."""
    found = {w: n for w, n in toxic.items() if n >= (8 if b" " in w else 3) and n > 20 * clean[w] and len(w) >= 3}
    return {w: n for w, n in found.items() if b" " not in w or not any(part in found for k in range(1, WORDS) for part in sentence_windows(w.split()) if part != w)}


def _train_svm(docs: list[list[list[bytes]]], y: np.ndarray, landmarks: int, negatives: int, seed: int) -> KernelSVM:
    """Multiple-instance training on sentences: all windows of clean texts' sentences are clean; of a toxic text one sentence at least holds
    an insult, at first unknown which. It starts from windows that come in toxic texts only, each also with a character inserted,
    which is how insults are disguised; each round trains the machine, picks the highest window of each toxic text's highest
    sentence anew, and adds clean windows, of one word or more, that were valued too highly."""
    bags = [sorted({x for s in d for x in sentence_windows(s)}) for d in docs]
    toxic, clean = (Counter(x for b, k in zip(bags, y, strict=True) if k == c for x in b) for c in (1, 0))
    odds = _odds(toxic, clean)
    one = lambda w: b" " not in w
    seeds = sorted(odds, key=lambda w: (-odds[w], w))[: landmarks * 3 // 4]
    draw = np.random.default_rng(seed)
    common = sorted((w for w in clean if one(w)), key=lambda w: (-clean[w], w))
    rare = [common[i] for i in sorted(draw.choice(len(common), min(len(common), negatives), replace=False))]
    several = sorted((w for w in clean if not one(w)), key=lambda w: (-clean[w], w))
    wide = any(not one(w) for w in odds)  # insults of several words
    against = list(dict.fromkeys(common[:2000] + rare + ([several[i] for i in sorted(draw.choice(len(several), min(len(several), negatives // 4), replace=False))] if wide else [])))
    if not seeds:
        seeds = sorted((w for w in toxic if one(w)), key=lambda w: (clean[w] - toxic[w], w))[:8]
    other = [w for w in against if len(w) >= 3]
    svm = KernelSVM(seeds + [other[i] for i in sorted(draw.choice(len(other), max(0, min(len(other), landmarks - len(seeds))), replace=False))])
    insert = lambda w, k: w[:k] + bytes([draw.choice(list(b"aeiox1_"))]) + w[k:]
    disguised = {insert(w, k): toxic[w] / 2 for w in seeds if len(w) >= 4 for k in range(1, len(w))}
    positive = sorted({*seeds, *disguised})
    every = sorted({w for b in bags for w in b if one(w)} | {w for w in odds if not one(w)})
    held = [b" ".join(s) for d, k in zip(docs, y, strict=True) if not k for s in d]  # the clean sentences, a row each
    for _ in range(3):
        x = svm.features([pieces(w)[0] if one(w) else w for w in positive + against])
        label = np.concatenate([np.ones(len(positive)), -np.ones(len(against))])
        # each window counts as often as texts of its class have it, disguised ones half as often as the window that they hide
        svm.train(x, label, np.array([BALANCE * max(toxic[w], disguised.get(w, 1.0)) for w in positive] + [1.0 + min(clean[w], 200) for w in against]))
        value = dict(zip(every, svm.words(every)[:, 0], strict=True))
        top = [max((w for w in b if w in value), key=lambda w: (value[w], w), default=b"") for b in bags]
        positive = sorted({w for w, k in zip(top, y, strict=True) if k and w and value[w] > -0.3} | {*seeds, *disguised})
        hard = sorted(w for w in clean if one(w) and value[w] > -0.7 and not odds.get(w)) + (sorted(_high_windows(held, svm, HARD) - odds.keys()) if wide else [])
        against = list(dict.fromkeys(against + hard))
    svm.phi = svm.root = svm.column = None  # training alone needs them
    return svm


def _high_windows(sentences: list[bytes], svm: KernelSVM, least: float) -> set[bytes]:
    """The windows of several words that are valued over ``least``."""
    found: set[bytes] = set()
    for _, _, buf, off in text_pieces(pa.array(sentences, pa.binary()).cast(pa.string())):
        w = Words(buf, off, SPACE)
        _, s, e, bound = neighbours(w, svm.table, svm.bias)
        found |= {w.low[a:b].tobytes() for a, b in zip(s[bound > least].tolist(), e[bound > least].tolist(), strict=True)}
    some = sorted(found)
    return {x for x, v in zip(some, svm.whole(some), strict=True) if v > least}


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (cost * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (cost * (p - y)) + 0.1 * w)
    return w


def fit_toxicity(rows: list[tuple[str | None, int]], landmarks: int = 160, negatives: int = 12_000, clean_weight: float = 1.0) -> ToxicModel | None:
    """A machine trained on the sentences of labelled texts (text, 0 or 1); None if one class only is given. Each clean
    text stands for ``clean_weight`` ones.

    The curve from a text's two highest sentences to its probability is fitted to values that machines trained on the
    other half of the texts give; its middle is where these predictions have the best F1. One sentence alone is enough
    where its value is over that of all clean training texts'.
    """
    rows = [(t, k) for t, k in rows if t]
    y = np.array([k for _, k in rows], np.int64)
    if not len(rows) or y.min() == y.max():
        return None
    docs = [sentence_bags(t) for t, _ in rows]
    half = np.array([zlib.crc32(t.encode()) & 1 for t, _ in rows])
    texts = pa.array([t for t, _ in rows])
    svm = _train_svm(docs, y, landmarks, negatives, 7)
    two = top_sentences(texts, svm, Memo(svm.words, 1))[0]
    if all(np.unique(y[half == k]).size == 2 and (y[half == k] == 1).sum() >= 10 for k in (0, 1)):
        for k in (0, 1):
            other = _train_svm([d for d, h in zip(docs, half, strict=True) if h != k], y[half != k], landmarks, negatives, 8 + k)
            two[half == k] = top_sentences(texts.filter(pa.array(half == k)), other, Memo(other.words, 1))[0]
    x, cost = _inputs(two, np.array([len(t.split()) for t, _ in rows])), np.where(y > 0, 1.0, clean_weight)
    weights = _logistic(x, y, cost)
    logit = x @ weights
    order = np.argsort(-logit, kind="stable")
    f1 = 2 * np.cumsum(y[order]) / (np.cumsum(cost[order]) + y.sum())
    best = int(np.argmax(f1))
    weights[-1] -= (logit[order[best]] + logit[order[min(best + 1, len(y) - 1)]]) / 2
    return ToxicModel(svm, weights, float(two[y == 0, 0].max()) + 0.1)


def top_sentences(texts: pa.Array, svm: KernelSVM, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(for each text the values of its two highest sentences and of its second word, its number of words); a sentence has the value of its highest window.

    Words are valued once a worker. Of windows of several words those are valued whose bound is over the text's second sentence
    by its words: no other one can change the two.
    """
    top, count = np.full((len(texts), 3), NONE), np.zeros(len(texts), np.int64)
    for a, b, buf, off in text_pieces(texts, PIECE):
        w = Words(buf, off, SPACE)
        count[a:b] = w.count
        if not len(w.start):
            continue
        rows, which = memo(w, w.hashes())
        value = rows[which, 0].astype(np.float64)
        mark = np.concatenate([[0], np.cumsum(MARK[w.low])])[w.start]
        start = np.flatnonzero(np.concatenate([[True], (w.doc[1:] != w.doc[:-1]) | (mark[1:] != mark[:-1])]))
        second = _two_of(value, w.doc, b - a)[:, 1]
        best = _two_of(np.maximum.reduceat(value, start), w.doc[start], b - a)
        i, s, e, bound = neighbours(w, svm.table, svm.bias)
        use = bound - PENALTY > best[w.doc[i], 1]
        if use.any():
            windows, back = np.unique(np.array([w.low[x:y].tobytes() for x, y in zip(s[use].tolist(), e[use].tolist(), strict=True)], object), return_inverse=True)
            np.maximum.at(value, i[use], svm.whole(windows.tolist())[back] - PENALTY)
            best = _two_of(np.maximum.reduceat(value, start), w.doc[start], b - a)
        short = np.concatenate([[0], np.cumsum(w.end - w.start == 1)])
        for k in np.flatnonzero(short[w.first[1:]] - short[w.first[:-1]] >= 4):
            if runs := spelt_out(w, k):
                more = svm.words(runs)[:, 0]
                best[k], second[k] = _two([*best[k], *more]), max(second[k], _two([*best[k], *more])[1])
        top[a:b] = np.column_stack([best, second])
    return top, count


def _two_of(value: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The two highest values of each of ``n`` texts, whose values stand together."""
    out = np.full((n, 2), NONE)
    has, start = np.unique(doc, return_index=True)
    out[has, 0] = np.maximum.reduceat(value, start)
    at = np.flatnonzero(value == out[doc, 0])
    _, one = np.unique(doc[at], return_index=True)
    rest = value.copy()
    rest[at[one]] = NONE  # one sentence of the highest value
    out[has, 1] = np.maximum.reduceat(rest, start)
    return out


def score_texts(texts: pa.Array, model: ToxicModel) -> np.ndarray:
    svm = model.svm
    memo = worker_memo("toxicity-" + hashlib.md5(svm.table.tobytes()).hexdigest(), lambda: Memo(svm.words, 1, KEPT))
    two, count = top_sentences(texts, svm, memo)
    return np.where(count > 0, model.probability(two, count), 0.0)


def _score(batches: Iterator[pa.RecordBatch], model: ToxicModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1), model))], names=["_id", "score"])


def score_toxicity(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, score) for every row of ``docs``: the probability that its text is toxic, from its two highest
    sentences, each valued by its highest window.

    0 for null and empty texts and those without words, and everywhere where labels of one class only were given. Texts
    of any length are read whole; repeated rows are scored each, alike; of sentences with equal values one counts
    as the highest. An empty table gives an empty result; other columns, whatever their names, are ignored."""
    slim = docs.select(F.col(id_col).alias("_id"), "text")
    if model is None:
        return slim.select(F.col("_id").alias(id_col), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return slim.mapInArrow(lambda batches: _score(batches, shared.value), f"_id {slim.schema['_id'].dataType.simpleString()}, score double").withColumnRenamed("_id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicModel | None, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``; all of them without a model."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, lambda texts: score_texts(texts, shared.value) < limit)


def trained(spark: SparkSession, sf_dir: str, bound: int = 1000) -> ToxicModel | None:
    """A model of about ``bound`` labelled documents of each class at most, none of them held out. One task trains it, so that a
    lost executor costs a second try and the driver holds no more than the finished model (about 2 MB)."""
    labels = table(spark, sf_dir, "labels")
    rows = labelled_texts(table(spark, sf_dir, "documents"), labels, "toxic", bound).select("doc_id", "text", F.col("label").cast("long").alias("label"))
    clean = known_labels(labels, "toxic").where("label = 0").count()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], r[1] or ""))
        stands = clean / max(1, sum(label == 0 for _, _, label in got))
        model = fit_toxicity([(text, label) for _, text, label in got], clean_weight=max(1.0, stands))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.where("doc_id is not null").repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(made[0].model) if made else None


def op5_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
