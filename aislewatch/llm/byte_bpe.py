"""Byte-level BPE by ranks: encoding with a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import contextlib
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from aislewatch.llm.common import table

PIECE = 4 << 20  # bytes of text that are encoded at once
KEPT = 300_000  # chunks, and pieces, that a worker keeps the ids of
ROWS = 8192  # pieces that are merged side by side
LONGEST_KEPT = 64
#: A space goes with what follows it, and the last white space of a run does if it is a space: no match of the pattern reaches across these places.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s")
SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to this expression's \s, but not to the pattern's


class Vocabulary(NamedTuple):
    ranks: dict[bytes, int]
    tokens: list[bytes]
    longest: int
    pattern: object
    pairs: tuple[np.ndarray, np.ndarray]  # two parts' ids in one number, ascending, and the id of their union
    chunks: dict[str, bytes]
    pieces: dict[str, bytes]  # at first the tokens that are text: a match that is a token has its id


_WORKER: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The ranks of a file of base64 tokens and numbers, and this worker's memo; both outlive a task, because workers are used again."""
    if (path, pattern) not in _WORKER:
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        known = {}
        for token, rank in ranks.items():
            with contextlib.suppress(UnicodeDecodeError):
                known[token.decode()] = rank.to_bytes(4, "little")
        _WORKER.clear()
        _WORKER[path, pattern] = Vocabulary(ranks, tokens, max(map(len, ranks)), regex.compile(pattern), pair_table(ranks), {}, known)
    return _WORKER[path, pattern]


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens whose union is a token."""
    keys, to = [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                to.append(rank)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(to, np.int64)[order]


class PairTree:
    """The neighbouring parts of a piece and the ranks of their unions, as a segment tree over byte positions.

    Leaf i stands for the part that starts at byte i and the part after it; its value is (rank, i) in one number, so that the
    root is the leftmost pair of the smallest rank. A merge changes the leaves of the merged part, of the part that it took in and
    of the part before, and on the way up only nodes whose minimum changes.
    """

    def __init__(self, piece: bytes, ranks: dict[bytes, int], longest: int):
        self.piece, self.ranks, self.longest = piece, ranks, longest
        n = len(piece)
        self.bits = n.bit_length()
        self.none = 1 << (self.bits + 40)
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.end, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = self.tree = [self.none] * (2 * self.leaves)
        for i in range(n - 1):
            tree[self.leaves + i] = self._value(i, i + 2)
        for k in range(self.leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def _value(self, i: int, stop: int) -> int:
        rank = self.ranks.get(self.piece[i:stop]) if stop - i <= self.longest else None
        return self.none if rank is None else rank << self.bits | i

    def _set(self, i: int, value: int) -> None:
        tree, k = self.tree, self.leaves + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            least = value if value < other else other
            k >>= 1
            if tree[k] == least:
                return
            tree[k] = value = least

    def merged(self) -> list[int]:
        """The ids after all merges."""
        n, end, before, tree, mask = len(self.piece), self.end, self.before, self.tree, (1 << self.bits) - 1
        while tree[1] < self.none:
            i = tree[1] & mask
            taken = end[i]
            stop = end[i] = end[taken]
            self._set(taken, self.none)
            if stop < n:
                before[stop] = i
                self._set(i, self._value(i, end[stop]))
            else:
                self._set(i, self.none)
            if before[i] >= 0:
                self._set(before[i], self._value(before[i], stop))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[self.piece[i : end[i]]])
            i = end[i]
        return ids


NONE = 1 << 62


class PairTrees:
    """:class:`PairTree` for many short pieces at once: a tree for each row, whose merges go on side by side until no row has a pair.

    The id of a part is its rank, so the root of a row says where it merges and to what. A part that another took in has the id -1.
    """

    def __init__(self, pieces: list[bytes], width: int, ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray]):
        self.width, self.bits, self.pairs = width, width.bit_length() - 1, pairs
        m = len(pieces)
        self.n = np.fromiter(map(len, pieces), np.int64, m)
        inside = np.arange(width) < self.n[:, None]
        self.ids = np.full((m, width), -1, np.int64)
        single = np.array([ranks[bytes([c])] for c in range(256)], np.int64)
        self.ids[inside] = single[np.frombuffer(b"".join(pieces), np.uint8)]
        self.after = np.broadcast_to(np.arange(1, width + 1), (m, width)).copy()
        self.before = np.broadcast_to(np.arange(-1, width - 1), (m, width)).copy()
        self.tree = np.full((m, 2 * width), NONE, np.int64)
        row, i = np.nonzero(inside[:, 1:])
        self.tree[row, width + i] = self._value(self.ids[row, i], self.ids[row, i + 1], i)
        k = width
        while k > 1:
            k //= 2
            self.tree[:, k : 2 * k] = np.minimum(self.tree[:, 2 * k : 4 * k : 2], self.tree[:, 2 * k + 1 : 4 * k : 2])

    def _value(self, left: np.ndarray, right: np.ndarray, i: np.ndarray) -> np.ndarray:
        keys, to = self.pairs
        want = left << 32 | right
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, to[at] << self.bits | i, NONE)

    def _set(self, row: np.ndarray, i: np.ndarray, value: np.ndarray | int) -> None:
        """New values of leaves, and the minima above them; rows whose minimum stays are left at that node."""
        flat = self.tree.reshape(-1)
        base, k = row * (2 * self.width), self.width + i
        flat[base + k] = value
        for _ in range(self.bits):
            k = k >> 1
            least = np.minimum(flat[base + 2 * k], flat[base + 2 * k + 1])
            changed = flat[base + k] != least
            base, k = base[changed], k[changed]
            if not len(k):
                return
            flat[base + k] = least[changed]

    def merged(self) -> list[bytes]:
        """The ids of each piece after all merges, as little-endian 32-bit integers."""
        row = np.flatnonzero(self.tree[:, 1] < NONE)
        while len(row):
            root = self.tree[row, 1]
            i, union = root & (self.width - 1), root >> self.bits
            taken = self.after[row, i]
            stop = self.after[row, taken]
            self.ids[row, i], self.ids[row, taken], self.after[row, i] = union, -1, stop
            inner = np.flatnonzero(stop < self.n[row])
            self.before[row[inner], stop[inner]] = i[inner]
            value = np.full(len(row), NONE, np.int64)
            value[inner] = self._value(union[inner], self.ids[row[inner], stop[inner]], i[inner])
            last = taken < self.width
            self._set(row[last], taken[last], NONE)
            self._set(row, i, value)
            p = self.before[row, i]
            later = np.flatnonzero(p >= 0)
            self._set(row[later], p[later], self._value(self.ids[row[later], p[later]], union[later], p[later]))
            row = row[self.tree[row, 1] < NONE]
        alive = self.ids >= 0
        flat, stops = self.ids[alive].astype("<u4").tobytes(), [0, *(4 * np.cumsum(alive.sum(axis=1))).tolist()]
        return [flat[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]


def encode_pieces(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """The ids of matches of the pattern that are no tokens: what merging leaves. Short ones are merged side by side."""
    out: list[bytes] = [b""] * len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    low = 0
    for width in (8, 16, 32, 64):
        some = np.flatnonzero((size > low) & (size <= width))
        for a in range(0, len(some), ROWS):
            at = some[a : a + ROWS].tolist()
            for k, ids in zip(at, PairTrees([pieces[k] for k in at], width, v.ranks, v.pairs).merged(), strict=True):
                out[k] = ids
        low = width
    for k in np.flatnonzero(size > low).tolist():
        out[k] = array("I", PairTree(pieces[k], v.ranks, v.longest).merged()).tobytes()
    return out


def encode_texts(texts: list[str | None], v: Vocabulary) -> list[bytes]:
    """The ids of whole texts as little-endian 32-bit integers. Each distinct chunk of the texts, and each distinct match in them, is encoded once."""
    cut = [[] if not t else v.pattern.findall(t) if SEPARATORS.search(t) else CHUNK.findall(t) for t in texts]
    here = {c: v.chunks.get(c) for c in set().union(*cut)}
    new = [(c, v.pattern.findall(c)) for c, ids in here.items() if ids is None]
    matches = {p: v.pieces.get(p) for p in set().union(*(ps for _, ps in new))}
    unknown = [p for p, ids in matches.items() if ids is None]
    for p, ids in zip(unknown, encode_pieces([p.encode() for p in unknown], v), strict=True):
        matches[p] = ids
        if len(p) <= LONGEST_KEPT and len(v.pieces) < KEPT:
            v.pieces[p] = ids
    for c, ps in new:
        here[c] = ids = matches[ps[0]] if len(ps) == 1 else b"".join([matches[p] for p in ps])
        if len(c) <= LONGEST_KEPT and len(v.chunks) < KEPT:
            v.chunks[c] = ids
    return [b"".join(map(here.__getitem__, chunks)) for chunks in cut]


def _slices(size: list[int | None]) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of rows that hold about PIECE bytes together."""
    a, held = 0, 0
    for i, n in enumerate(size):
        if held and held + (n or 0) > PIECE:
            yield a, i
            a, held = i, 0
        held += n or 0
    if a < len(size):
        yield a, len(size)


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, array<int>, in place of ``text_col``: the ids of each whole text, without special tokens, a match of ``pattern`` at a time.

    Null and empty texts have no ids; texts of any length are encoded whole, in one pass without a shuffle. Rows that repeat are
    rows of their own; other columns stay as they are, and so does an empty table.
    """
    rest = [c for c in docs.columns if c not in (text_col, out)]
    names = [f"_{i}" for i in range(len(rest))]
    slim = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)), F.col(text_col).alias("_text"))
    schema = slim.drop("_text").schema.add("_ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks, pattern)
        for batch in batches:
            texts = batch.columns[-1]
            for a, b in _slices(pa.compute.binary_length(texts).to_pylist()):
                ids = encode_texts(texts.slice(a, b - a).to_pylist(), v)
                off = pa.array([0, *(len(i) // 4 for i in ids)], pa.int64())
                lists = pa.ListArray.from_arrays(pa.compute.cumulative_sum(off).cast(pa.int32()), pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))]))
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + [lists], names=schema.names)

    return slim.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, rest, strict=True))).withColumnRenamed("_ids", out)


def decode(rows: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """``rows`` with ``out``, binary: the bytes that the ids of ``ids_col`` stand for. They are UTF-8 where ids of whole texts are decoded,
    and may stop inside a character where a part of them is. Null gives null, no ids no bytes; an id that the vocabulary doesn't have is an error."""
    rest = [c for c in rows.columns if c != out]
    names = [f"_{i}" for i in range(len(rest))]
    slim = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)))
    at, schema = rest.index(ids_col), StructType([*slim.schema, StructField("_bytes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks, pattern)
        for batch in batches:
            lists = batch.column(at)
            for a, b in _slices([n and 4 * n for n in pa.compute.list_value_length(lists).to_pylist()]):
                part = lists.slice(a, b - a)
                found = [None if ids.values is None else b"".join([v.tokens[i] for i in ids.values.to_numpy().tolist()]) for ids in part]
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns] + [pa.array(found, pa.binary())], names=schema.names)

    return slim.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, rest, strict=True))).withColumnRenamed("_bytes", out)


def op11_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    given = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *given), *given)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
