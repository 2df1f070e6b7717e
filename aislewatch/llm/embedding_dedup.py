"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewatch.llm.common import components, cut, hot_join, scratch, staged, table

TILE = 1024
BLOCK_BYTES = 16 << 20  # of a block's vectors in double precision; a task holds two blocks
LEAST_BLOCK = 1024  # vectors; tables of four such blocks are one
DEALT_BYTES = 64 << 20  # of packed vectors that leave a worker at once
MOST_LEVELS = 12  # of splits: 4,096 blocks, or larger ones
SAMPLE = 20_000  # vectors that the splits are fitted to
SLACK = 1e-4  # what single precision may be off by in the bounds; links are decided in double precision


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the outer products of a partition's unit vectors, a row for each dimension."""
    total = None
    for batch in batches:
        x = _matrix(batch.column(0))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """The principal axes of the unit vectors, largest spread first, as columns; dim x dim sums reach the driver."""
    parts = vectors.select("v").mapInArrow(_moments, "i int, row array<double>")
    rows = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    m = np.zeros((dim, dim))
    for r in rows:
        m[r.i, r.j] = r.x
    values, axes = np.linalg.eigh((m + m.T) / 2)
    return axes[:, np.argsort(-values, kind="stable")]


def _bound(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, rest: float) -> float:
    """The most that vectors of two boxes can have as their product."""
    return float(np.maximum(np.maximum(lo_a * lo_b, lo_a * hi_b), np.maximum(hi_a * lo_b, hi_a * hi_b)).sum() + rest)


class Side:
    """Vectors of a block in the order of their first principal coordinate: ids, raw vectors, rotated unit vectors, suffix norms."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, axes: np.ndarray, steps: list[int]):
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        turned = unit @ axes
        order = np.argsort(turned[:, 0], kind="stable")
        self.ids, self.raw, self.norm = ids[order], raw[order], np.linalg.norm(raw[order], axis=1)
        turned = turned[order]
        self.suffix = [np.sqrt(np.maximum(0, 1 - (turned[:, :k] ** 2).sum(axis=1))).astype(np.float32) for k in steps]
        self.turned = turned.astype(np.float32)


def tile_links(a: Side, b: Side, same: bool, steps: list[int], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with a cosine of ``least`` or more, each pair once. A tile is left as soon as nothing in it can reach it."""
    for i in range(0, len(a.ids), TILE):
        for j in range(i if same else 0, len(b.ids), TILE):
            p, q = slice(i, i + TILE), slice(j, j + TILE)
            k = steps[0]
            box = [f(x.turned[s, :k], axis=0) for x, s in ((a, p), (b, q)) for f in (np.min, np.max)]
            if _bound(*box, float(a.suffix[0][p].max() * b.suffix[0][q].max())) < least - SLACK:
                continue
            part = a.turned[p, :k] @ b.turned[q, :k].T
            alive = part + a.suffix[0][p][:, None] * b.suffix[0][q][None, :] >= least - SLACK
            if same and i == j:
                alive &= np.triu(np.ones(alive.shape, bool), 1)
            x, y = np.nonzero(alive)
            got = part[x, y]
            x, y = x + i, y + j
            for at, (lo, hi) in enumerate(zip(steps[:-1], steps[1:], strict=True), 1):
                if not len(x):
                    break
                for s in range(0, len(x), 1 << 16):  # a hot tile can keep all of its pairs
                    u = slice(s, s + (1 << 16))
                    got[u] += np.einsum("nd,nd->n", a.turned[x[u], lo:hi], b.turned[y[u], lo:hi])
                keep = got + a.suffix[at][x] * b.suffix[at][y] >= least - SLACK
                x, y, got = x[keep], y[keep], got[keep]
            for s in range(0, len(x), 1 << 16):
                u, v = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                hit = np.einsum("nd,nd->n", a.raw[u], b.raw[v]) / (a.norm[u] * b.norm[v]) >= least
                yield u[hit], v[hit]


class Blocks:
    """Where vectors go: a tree of splits along leading principal axes, fitted to a bounded sample. Any tree keeps the comparison exact."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.at = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
        inside = [sample]
        for node in range(len(self.axis)):
            x = inside[node]
            if len(x):
                self.axis[node] = int(np.argmax(x.std(axis=0)))
                self.at[node] = float(np.median(x[:, self.axis[node]]))
            over = x[:, self.axis[node]] > self.at[node]
            inside += [x[~over], x[over]]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.at[node])
        return node - len(self.axis)


def near_leaves(lo: np.ndarray, hi: np.ndarray, rest: np.ndarray, least: float) -> np.ndarray:
    """Whether two leaves hold vectors whose product can reach ``least``, as a symmetric matrix."""
    out = np.zeros((len(lo), len(lo)), bool)
    for i in range(len(lo)):
        most = np.maximum(np.maximum(lo[i] * lo, lo[i] * hi), np.maximum(hi[i] * lo, hi[i] * hi)).sum(axis=1) + rest[i] * rest
        out[i] = most >= least - SLACK
    return out | out.T


def deal(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, leaf: np.ndarray, start: np.ndarray, parts: np.ndarray, near: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Vectors for the pairs of blocks (i, j, side) that their block is in, packed; ``most`` bytes and one block's vectors of this batch leave at once.

    ``start`` and ``parts``: the first block of each leaf and how many it has. The smaller block of a pair is side 0.
    """
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
    own = start[leaf] + h % parts[leaf]
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([int(r[c]) for r in held], pa.int32()) for c in range(3)] + [pa.array([r[c] for r in held], pa.binary()) for c in (3, 4, 5)], names=["i", "j", "side", "ids", "copies", "data"])

    for k in np.unique(own).tolist():
        at = own == k
        packed = ids[at].tobytes(), copies[at].tobytes(), x[at].tobytes()
        for other in np.flatnonzero(near[leaf[at][0]]).tolist():
            for o in range(int(start[other]), int(start[other] + parts[other])):
                held.append((min(k, o), max(k, o), int(k > o), *packed))
                size += sum(map(len, packed))
                if size >= most:
                    yield batch()
                    held, size = [], 0
    if held:
        yield batch()


def _compare(t: pa.Table, axes: np.ndarray, least: float) -> pa.Table:
    """(vec, n, root) for the vectors of two blocks that have links here: the copies that they link with, and the smallest id that
    the links reach."""
    dim = len(axes)
    steps = sorted({max(1, dim // 4), max(1, dim // 2), max(1, 3 * dim // 4), dim})
    side = np.array(t.column("side").to_pylist())
    ids, copies = ([np.frombuffer(x.as_buffer(), np.int64) for x in t.column(c)] for c in ("ids", "copies"))
    raw = [np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dim) for x in t.column("data")]

    def pick(s: int) -> tuple[Side, np.ndarray]:
        at = np.flatnonzero(side == s)
        own, many = np.concatenate([ids[k] for k in at]), np.concatenate([copies[k] for k in at])
        made = Side(own, np.concatenate([raw[k] for k in at]), axes, steps)
        order = np.argsort(own, kind="stable")
        return made, many[order][np.searchsorted(own[order], made.ids)]

    same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    found = {}
    if same or {0, 1} <= set(side):
        a, many_a = pick(0)
        b, many_b = (a, many_a) if same else pick(1)
        all_ids = a.ids if same else np.concatenate([a.ids, b.ids])
        many = many_a if same else np.concatenate([many_a, many_b])
        shift = 0 if same else len(a.ids)
        n = np.zeros(len(all_ids), np.int64)
        rank = np.argsort(np.argsort(all_ids, kind="stable"), kind="stable")
        root = rank.copy()
        for x, y in tile_links(a, b, same, steps, least):
            y = y + shift
            np.add.at(n, x, many[y])
            np.add.at(n, y, many[x])
            while len(x):  # the smaller rank spreads over these links and what they tie together
                rx, ry = root[x], root[y]
                if (rx == ry).all():
                    break
                small, large = np.minimum(rx, ry), np.maximum(rx, ry)
                to = np.arange(len(n))
                np.minimum.at(to, large, small)
                while (to[to] != to).any():
                    to = to[to]
                root = to[root]
        hit = np.flatnonzero(n)
        by_rank = np.sort(all_ids, kind="stable")
        found = {"vec": all_ids[hit], "n": n[hit], "root": by_rank[root[hit]]}
    return pa.table({k: pa.array(found.get(k, np.zeros(0, np.int64)), pa.int64()) for k in ("vec", "n", "root")})


def _tiles(classes: DataFrame, dim: int, total: int, least: float) -> DataFrame:
    """(vec, n, root) of all pairs of blocks of ``classes`` (cid, copies, v of ``dim`` numbers) that can hold a link."""
    spark = classes.sparkSession
    axes = principal_axes(classes, dim)
    shared = spark.sparkContext.broadcast(axes)
    lead = max(1, dim // 4)
    block = max(LEAST_BLOCK, BLOCK_BYTES // (8 * dim))
    levels = 0 if total <= 4 * LEAST_BLOCK else max(3, min(MOST_LEVELS, int(np.ceil(np.log2(max(1, total / block))))))  # small tables are one block
    block = max(block, total >> MOST_LEVELS)

    def turned(x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ shared.value

    rows = classes.where(F.pmod(F.xxhash64("cid", F.lit(13)), F.lit(max(1, total // SAMPLE))) == 0).select("v").toArrow().column("v").combine_chunks()
    leaf_of = Blocks(((_matrix(rows) / np.linalg.norm(_matrix(rows), axis=1, keepdims=True)) @ axes)[:, :lead] if len(rows) else np.zeros((0, lead)), levels)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = turned(_matrix(batch.column(0)))
            leaf, rest = leaf_of(x[:, :lead]), np.sqrt(np.maximum(0, 1 - (x[:, :lead] ** 2).sum(axis=1)))
            out = [(int(k), int((leaf == k).sum()), float(rest[leaf == k].max()), [*x[leaf == k, :lead].min(axis=0)], [*x[leaf == k, :lead].max(axis=0)]) for k in np.unique(leaf)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["leaf", "n", "rest", "lo", "hi"])

    seen = classes.select("v").mapInArrow(measure, "leaf int, n long, rest double, lo array<double>, hi array<double>")
    side = [f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("lo", F.min), ("hi", F.max)) for k in range(lead)]
    boxes = {r.leaf: r for r in seen.groupBy("leaf").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"), *side).collect()}  # 4,096 leaves at most
    names = sorted(boxes)
    table = lambda c: np.array([[boxes[k][f"{c}{j}"] for j in range(lead)] for k in names])
    near = near_leaves(table("lo"), table("hi"), np.array([boxes[k].rest for k in names]), least)
    parts = np.array([max(1, -(-boxes[k].n // (2 * block))) for k in names])  # a leaf of too many vectors is several blocks
    number, start = {k: i for i, k in enumerate(names)}, np.cumsum(parts) - parts
    plan = spark.sparkContext.broadcast((number, start, parts, near))  # 4,096 x 4,096 booleans at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, start, parts, near = plan.value
        for batch in batches:
            x = _matrix(batch.column(2))
            leaf = np.array([number[k] for k in leaf_of(turned(x)[:, :lead]).tolist()])
            yield from deal(batch.column(0).to_numpy(), batch.column(1).to_numpy(), x, leaf, start, parts, near, DEALT_BYTES)

    tasks = classes.select("cid", "copies", "v").mapInArrow(run, "i int, j int, side int, ids binary, copies binary, data binary")
    return tasks.groupBy("i", "j").applyInArrow(lambda t: _compare(t, shared.value, least), "vec long, n long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector id: ``id_col``, n_links, component_id, kept.

    Equal vectors are one class with its number of copies. Classes are rotated to principal axes and dealt to blocks by a tree of
    splits along the leading ones. Pairs of blocks whose boxes (in the leading quarter of the axes, with the largest suffix norm)
    can't hold a link are left out before anything is shuffled; each other pair is a task of bounded size: products of the leading quarter of the
    axes first, plus the product of the suffix norms as the bound of the rest; what can't reach ``least`` stops there, then
    after half and three quarters. Links are decided by the cosine in double precision. A task returns at most one row
    for each of its classes, never pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths don't link (each length, of which there are few, is compared on its own). Rows that repeat an id are one
    vector (the smallest by its components, a usable one if there is any). Null ids are left out. Empty tables give an
    empty result; other columns, whatever their names, are ignored.
    """
    v = F.col(vec_col).cast("array<double>")
    usable = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(usable, v).alias("v"))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    rows = staged(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(7))}), "vectors")
    none = F.lit(0).cast("long")
    with scratch(vectors.sparkSession):
        classes = staged(rows.where("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("cid"), F.count("*").alias("copies"), F.first("v").alias("v")), "classes")
        lengths = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()
        if not lengths:
            return rows.select(F.col("id").alias(id_col), none.alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        found: DataFrame | None = None
        for r in sorted(lengths):
            part = _tiles(classes.where(F.size("v") == r.d), r.d, r.n, least)
            found = part if found is None else found.unionByName(part)
        found = cut(found)
        comps = components(found.where("vec <> root").select(F.col("vec").alias("a"), F.col("root").alias("b")))
        counts = found.groupBy("vec").agg(F.sum("n").alias("n"))
        known = classes.select("h1", "h2", "cid", "copies").join(counts.withColumnRenamed("vec", "cid"), "cid", "left").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
        known = cut(known.select("h1", "h2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), keep=True)
    out = hot_join(rows.select("id", "h1", "h2", F.col("v").isNotNull().alias("_ok")), known, ["h1", "h2"], "copies", ["id"])
    links, component = F.when(F.col("_ok"), F.col("n_links")), F.coalesce(F.when(F.col("_ok"), F.col("component")), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce(links, none).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def op1_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(r.m, vec_id)) AS component_id, coalesce(r.m, vec_id) >= vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) k ON vec_id = k.a LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON vec_id = r.a
"""
