"""Compression of vectors to short codes: product quantisation in whole numbers, with memoised grid cells in place of full searches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewatch.llm.common import hot_join, staged, table

PIECE = 1 << 19  # numbers that are worked on at once
CELLS = 50_000  # cells that a worker keeps for each part
FINE = 16  # cells along the spread of a part's entries in one dimension
LARGEST = 1 << 20  # components beyond this would not leave distances room in 64 bits


class Grid:
    """The entries of one part's codebook, and for each cell of a grid the entries that can be nearest to a point of that cell.

    An entry is dominated in a cell if its least distance to the cell's box is over another's greatest distance; what is left
    is kept under the cell's hash. Only kept entries are evaluated, exactly. Points whose cell shares its hash with an
    earlier cell are compared with all entries.
    """

    def __init__(self, entries: np.ndarray, limit: int = CELLS):
        self.entries, self.limit = entries, limit
        k, w = entries.shape
        self.side = max(1, int((entries.max(axis=0) - entries.min(axis=0)).max()) // FINE)
        self.slot: dict[int, int] = {}
        self.cell = np.zeros((0, w), np.int64)
        self.near = np.zeros((0, k), np.int16)
        self.size = np.zeros(0, np.int64)

    def _candidates(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each cell its entries in ascending order, filled up with the first, and their number."""
        near, size = np.zeros((len(cells), len(self.entries)), np.int16), np.zeros(len(cells), np.int64)
        step = max(1, PIECE // self.entries.size)
        for a in range(0, len(cells), step):
            lo = cells[a : a + step, None, :] * self.side
            below, above = lo - self.entries, self.entries - (lo + self.side - 1)
            least = (np.maximum(0, np.maximum(below, above)) ** 2).sum(axis=2)
            most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
            keep = least <= most.min(axis=1, keepdims=True)
            n = keep.sum(axis=1)
            order = np.argsort(~keep, axis=1, kind="stable").astype(np.int16)
            near[a : a + step] = np.where(np.arange(keep.shape[1]) < n[:, None], order, order[:, :1])
            size[a : a + step] = n
        return near, size

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) for each row of ``x``; of equal distances the lower index."""
        cells = x // self.side
        h = np.zeros(len(x), np.int64)
        for j in range(x.shape[1]):
            h = (h ^ cells[:, j]) * np.int64(0x9E3779B97F4A7C15 - (1 << 64))
            h ^= h >> np.int64(29)
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.fromiter((self.slot.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        cell, near, size = cells[first], np.zeros((len(keys), len(self.entries)), np.int16), np.zeros(len(keys), np.int64)
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        cell[old], near[old], size[old] = self.cell[at[old]], self.near[at[old]], self.size[at[old]]
        if len(new):
            near[new], size[new] = self._candidates(cell[new])
            room = new[: max(0, self.limit - len(self.slot))]
            if len(room):
                n = len(self.slot)
                if n + len(room) > len(self.size):
                    more = n + 2 * len(room)
                    self.cell, self.near, self.size = (np.concatenate([c, np.zeros((more - len(c), *c.shape[1:]), c.dtype)]) for c in (self.cell, self.near, self.size))
                s = slice(n, n + len(room))
                self.cell[s], self.near[s], self.size[s] = cell[room], near[room], size[room]
                self.slot.update(zip(keys[room].tolist(), range(n, n + len(room)), strict=True))
        index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        shared = (cells != cell[which]).any(axis=1)
        wide = np.where(shared, -1, size[which])
        for width in np.unique(wide).tolist():
            rows = np.flatnonzero(wide == width)
            some = np.broadcast_to(np.arange(len(self.entries)), (len(rows), len(self.entries))) if width < 0 else near[which[rows], :width].astype(np.int64)
            d = ((x[rows, None, :] - self.entries[some]) ** 2).sum(axis=2)
            best = d.argmin(axis=1)
            index[rows], error[rows] = some[np.arange(len(rows)), best], d[np.arange(len(rows)), best]
        return index, error


_WORKER: dict[str, list[Grid]] = {}


def _grids(books: np.ndarray) -> list[Grid]:
    """This worker's grids of a codebook; they outlive a task, because workers are used again. One codebook's are kept at a time."""
    key = hashlib.sha256(books.tobytes()).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = [Grid(b) for b in books]
    return _WORKER[key]


def _whole(column: pa.Array, scale: float, dim: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, floor(scale * x) of each component), a bounded number of components at once."""
    step = max(1, PIECE // dim)
    for a in range(0, len(column), step):
        part = column.slice(a, step)
        x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), dim)
        yield a, a + len(part), np.floor(scale * x).astype(np.int64)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, squared distance), rows x parts, of whole-number vectors."""
    parts, _, w = books.shape
    found = [g.nearest(x[:, p * w : (p + 1) * w]) for p, g in enumerate(_grids(books))]
    return np.stack([f[0] for f in found], axis=1).reshape(-1, parts), np.stack([f[1] for f in found], axis=1).reshape(-1, parts)


def usable(vec_col: str, scale: float = 256.0) -> Column:
    """Whether a vector can be coded: not null or empty, all components non-null, finite and under LARGEST / ``scale`` in size."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > LARGEST / scale))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def _sums(books: np.ndarray, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a partition: how many parts go to each entry, and their components' sums; parts x entries rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, w = books.shape
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, w), np.int64)
        for batch in batches:
            for _, _, x in _whole(batch.column(0), scale, parts * w):
                code, _ = assign(x, books)
                for p in range(parts):
                    count[p] += np.bincount(code[:, p], minlength=k)
                    np.add.at(total[p], code[:, p], x[:, p * w : (p + 1) * w])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return run


def fit_codebooks(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Codebooks (parts x entries x components, whole numbers) of the usable ``vectors``.

    They start as the parts of the ``entries`` smallest ids (of equal ids, the smaller vector). In each round every part goes
    to its nearest entry, and each entry becomes the floor of its parts' mean; an entry without parts stays. A task adds
    up its own rows; parts x entries sums reach the driver. With fewer vectors there are as many entries; without any, none.
    A length that ``parts`` doesn't divide is an error; vectors of other lengths than the first take no part.
    """
    rows = vectors.where(usable(vec_col, scale)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    dim = len(first[0].v)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    start = [r.v for r in first if len(r.v) == dim]
    if len(start) < len(first):
        start = [r.v for r in rows.where(F.size("v") == dim).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    books = np.floor(scale * np.array(start, np.float64)).astype(np.int64).reshape(len(start), parts, dim // parts).transpose(1, 0, 2).copy()
    same = rows.where(F.size("v") == dim).select("v")
    for _ in range(rounds):
        sums = same.mapInArrow(_sums(books, scale), "part int, entry int, n long, total array<long>")
        components = [F.sum(F.col("total")[j]).alias(f"x{j}") for j in range(dim // parts)]
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *components).collect():
            books[r.part, r.entry] = [r[f"x{j}"] // r.n for j in range(dim // parts)]
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """(``id_col``, columns of ``keep``, code binary, error long): a byte for each part, and the squared distances summed over the parts.

    Usable vectors of the codebooks' length only; rows that repeat are rows of their own. Empty codebooks or tables give no rows.
    """
    parts, _, w = books.shape
    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate([id_col, *(keep or [])])]
    rows = vectors.where(usable(vec_col, scale) & (F.size(vec_col) == parts * w)).select(*kept, F.col(vec_col).alias("_v"))
    out = rows.drop("_v").schema.add("code", "binary").add("error", "long")
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _whole(batch.columns[-1], scale, parts * w):
                code, error = assign(x, books)
                codes = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.arange(0, (b - a + 1) * parts, parts, dtype=np.int32)), pa.py_buffer(code.astype(np.uint8).tobytes())])
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + [codes, pa.array(error.sum(axis=1))], names=names)

    coded = rows.mapInArrow(run, out) if w else vectors.sparkSession.createDataFrame([], out)
    return coded.withColumnsRenamed({f"_{i}": c for i, c in enumerate([id_col, *(keep or [])])})


def decode(codes: DataFrame, books: np.ndarray, scale: float = 256.0, code_col: str = "code", out: str = "vector") -> DataFrame:
    """Adds ``out``, the vector that a code stands for, to ``codes``: the middle of the whole-number steps of its entries. Null codes give null."""
    parts = books.shape[0]
    book = [F.array(*(F.array(*(F.lit((float(x) + 0.5) / scale) for x in e)) for e in b)) for b in books]
    number = [F.conv(F.hex(F.substring(code_col, p + 1, 1)), 16, 10).cast("int") for p in range(parts)]
    return codes.withColumn(out, F.when(F.col(code_col).isNotNull(), F.concat(*(book[p][number[p]] for p in range(parts)))))


def codebooks_text(books: np.ndarray) -> str:
    """All components in decimal by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def op12_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls among labels are one label; a label may hold any share of the rows."""
    rows = table(spark, sf_dir, "embeddings")
    books = fit_codebooks(rows)
    coded = staged(encode(rows, books, keep=["label"]), "codes")
    sums = coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    out = hot_join(coded, sums, ["label"], "n", ["vec_id", "code"])
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(codebooks_text(books).encode()).hexdigest()).alias("codebooks_sha256"))


_NEAREST = """
{out} AS MATERIALIZED (
  SELECT vec_id, p, min(d * 64 + k) AS m
  FROM (SELECT vec_id, part.p, k, CAST(list_sum([(part.v[i] - b.v[i]) * (part.v[i] - b.v[i]) FOR i IN range(1, len(b.v) + 1)]) AS BIGINT) AS d FROM part JOIN {book} b ON part.p = b.p)
  GROUP BY vec_id, p)"""
_MEANS = """
{out} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(new.v, b.v) AS v
  FROM {book} b LEFT JOIN (
    SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT p, k, i, sum(x) AS s, count(*) AS n
          FROM (SELECT part.p, m % 64 AS k, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM part JOIN {near} a ON part.vec_id = a.vec_id AND part.p = a.p) GROUP BY p, k, i)
    GROUP BY p, k) new ON b.p = new.p AND b.k = new.k)"""
SQL = "".join([
    """
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT vec_id, p, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding[p * w + 1 : p * w + w]] AS v FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),""",
    _NEAREST.format(out="near0", book="book0"), ",", _MEANS.format(out="book1", book="book0", near="near0"), ",", _NEAREST.format(out="near1", book="book1"), ",",
    _MEANS.format(out="book2", book="book1", near="near1"), ",", _NEAREST.format(out="near2", book="book2"),
    """,
codes AS (SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM book2) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
""",
])
