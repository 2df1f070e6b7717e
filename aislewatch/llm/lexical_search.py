"""Ranked lexical search: an index of compressed postings in shards of documents, searched by Block-Max MaxScore."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislewatch.llm.common import scratch, staged, table
from aislewatch.llm.words import ALNUM, Words, text_pieces

SHARD_BYTES = 32 << 20  # of text in a shard, or one longer text
BLOCK = 128  # postings of a block
SLICE_TERMS = 400_000  # distinct terms, item by item, that are searched for at once
FIRST_SHARDS = 16  # about so many shards give the first thresholds
WINDOW = 256  # documents of the first window; each further one is twice as large
WIDTHS = (np.uint8, np.uint16, np.uint32)


def part_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document for each unit of its weight: 10^9 tf div (1000 tf + 8 m)."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norm(n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """100 - 75 + (75 n N) div L."""
    return 25 + (75 * n * total_docs) // max(1, total_terms)


def term_weight(df: int, total_docs: int) -> int:
    return math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for a, b, buf, off in text_pieces(texts):
        yield a, b, Words(buf, off, ALNUM)


def corpus_totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, all their terms with repeats); each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for _, _, w in _pieces(batch.column(0)):
                n, total = n + int((w.count > 0).sum()), total + len(w.start)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    r = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return r[0] or 0, r[1] or 0


class Shard:
    """Documents of one task until they are SHARD_BYTES of text: ids, lengths, and (term, document, occurrences) of each piece."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = self.docs = 0

    def add(self, ids: pa.Array, w: Words) -> None:
        terms, which = np.unique(w.hashes(), return_inverse=True)
        pair, tf = np.unique(which.astype(np.int64) * len(w.count) + w.doc, return_counts=True)
        self.parts.append((terms[pair // max(1, len(w.count))].view(np.int64), pair % max(1, len(w.count)) + self.docs, tf))
        self.ids.append(ids)
        self.lengths.append(w.count)
        self.docs += len(w.count)
        self.bytes += len(w.low)

    def rows(self, number: int, totals: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        """The shard as rows of the index. Documents are numbered in ascending id order (null last)."""
        ids = pa.concat_arrays(self.ids)
        order = pa.compute.sort_indices(ids, null_placement="at_end")
        place = np.empty(self.docs, np.int64)
        place[order.to_numpy()] = np.arange(self.docs)
        norm = np.empty(self.docs, np.int64)
        norm[place] = length_norm(np.concatenate(self.lengths), *totals)
        term, doc, tf = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        doc = place[doc]
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        yield index_batch(number, [None], [self.docs], [0], [[]], [[]], [norm.tobytes()], [ids.take(order)], ids.type)
        if not len(term):
            return
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        df = np.diff(np.append(start, len(term)))
        gap = np.diff(doc, prepend=0)
        gap[start] = doc[start]
        score = part_score(tf, norm[doc])
        blocks = -(-df // BLOCK)
        first_block = np.cumsum(blocks) - blocks
        at = np.repeat(start, blocks) + BLOCK * (np.arange(int(blocks.sum())) - np.repeat(first_block, blocks))
        last = doc[np.minimum(at + BLOCK, np.repeat(start + df, blocks)) - 1]
        most, top = np.maximum.reduceat(score, at), np.maximum.reduceat(score, start)
        wide = [np.searchsorted([1 << 8, 1 << 16], np.maximum.reduceat(x, start), "right") for x in (gap, tf)]
        packed = [[x.astype(t).tobytes() for t in WIDTHS] for x in (gap, tf)]
        size = [t(0).itemsize for t in WIDTHS]
        data = [bytes((g, t)) + packed[0][g][a * size[g] : b * size[g]] + packed[1][t][a * size[t] : b * size[t]] for a, b, g, t in zip(start.tolist(), (start + df).tolist(), wide[0].tolist(), wide[1].tolist(), strict=True)]
        step = 20_000
        for a in range(0, len(start), step):
            b = min(a + step, len(start))
            lo, hi = first_block[a], first_block[b - 1] + blocks[b - 1]
            off = pa.array(np.append(first_block[a:b], hi) - lo, pa.int32())
            yield index_batch(number, term[start[a:b]], df[a:b], top[a:b], pa.ListArray.from_arrays(off, pa.array(last[lo:hi], pa.int32())), pa.ListArray.from_arrays(off, pa.array(most[lo:hi])), data[a:b], [None] * (b - a), ids.type)


def index_batch(number: int, term, df, top, last, most, data, ids, kind: pa.DataType) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.list_(kind))
    columns = ([number] * len(term), term, df, top, last, most, data, ids)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "term", "df", "top", "last", "most", "data", "ids"])


def build_index(docs: DataFrame, totals: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, term, df, top, last, most, data, ids): for each shard a row for each term, and one with a null term for its documents.

    A task cuts its own documents into shards, so nothing is shuffled. A term (its 64-bit hash) has its postings in blocks of BLOCK:
    ``data`` holds the documents' differences and occurrences in the narrowest of three widths, ``last`` each block's last
    document, ``most`` and ``top`` the largest part score of a block and of the list. The row with the null term has the
    documents' ids in ``ids`` and their length norms in ``data``. Null texts and texts without a term aren't indexed.
    """
    slim = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = Shard(), TaskContext.get().partitionId() << 24
        for batch in batches:
            for a, b, w in _pieces(batch.column(1)):
                shard.add(batch.column(0).slice(a, b - a), w)
                if shard.bytes >= shard_bytes:
                    yield from shard.rows(number, totals)
                    shard, number = Shard(), number + 1
        if shard.docs:
            yield from shard.rows(number, totals)

    return slim.mapInArrow(run, f"shard long, term long, df long, top long, last array<int>, most array<long>, data binary, ids array<{kind}>")


class Postings:
    """One term's postings in a shard. Blocks are decompressed when they are asked for; until then all of a block's places hold its last document."""

    def __init__(self, df: int, top: int, last: np.ndarray, most: np.ndarray, data: bytes, norm: np.ndarray):
        self.df, self.top, self.last, self.most, self.data, self.norm = df, top, last, most, data, norm
        self.docs: np.ndarray | None = None
        self.opened = 0

    def open(self, blocks: np.ndarray) -> None:
        if self.docs is None:
            self.docs = np.repeat(self.last, BLOCK)[: self.df].astype(np.int64)
            self.score, self.known = np.zeros(self.df, np.int64), np.zeros(len(self.last), bool)
            g, t = WIDTHS[self.data[0]], WIDTHS[self.data[1]]
            self.gap = np.frombuffer(self.data, g, self.df, 2)
            self.tf = np.frombuffer(self.data, t, self.df, 2 + self.gap.nbytes)
        for k in blocks[~self.known[blocks]].tolist():
            s = slice(k * BLOCK, min(self.df, (k + 1) * BLOCK))
            self.docs[s] = np.cumsum(self.gap[s], dtype=np.int64) + (self.last[k - 1] if k else 0)
            self.score[s] = part_score(self.tf[s].astype(np.int64), self.norm[self.docs[s]])
            self.known[k] = True
            self.opened += 1

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, part scores) from document ``lo`` to before ``hi``."""
        a, b = np.searchsorted(self.last, [lo, hi])
        self.open(np.arange(a, min(b + 1, len(self.last))))
        s = slice(*np.searchsorted(self.docs, [lo, hi]))
        return self.docs[s], self.score[s]

    def at(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The part scores of ``docs``, which lie in ``blocks`` if anywhere."""
        self.open(np.unique(blocks))
        place = np.searchsorted(self.docs, docs)
        return np.where(self.docs[place] == docs, self.score[place], 0)


def best(lists: list[tuple[int, Postings]], n_docs: int, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` highest scores over ``least``, of equal scores the first documents; ``lists`` has weights and postings.

    Lists in the order of their bounds: those whose bounds together can't exceed the threshold are non-essential. A window of documents
    takes its candidates from the essential lists. What a candidate can gain from the others is first bounded by their
    blocks' maxima; only blocks with candidates that can still exceed the threshold are opened, the highest bound first.
    Documents come in ascending order, so a later one has to exceed the threshold.
    """
    lists = sorted(lists, key=lambda x: x[0] * x[1].top)
    weight = np.array([w for w, _ in lists], np.int64)
    bound = np.cumsum(weight * np.array([p.top for _, p in lists], np.int64))
    found, score, least_now = np.zeros(0, np.int64), np.zeros(0, np.int64), least
    lo, width = 0, WINDOW
    while lo < n_docs:
        hi = min(n_docs, lo + width)
        essential = int(np.searchsorted(bound, least_now, "right"))
        if essential == len(lists):
            break
        total = np.zeros(hi - lo, np.int64)
        for i in range(essential, len(lists)):
            docs, part = lists[i][1].between(lo, hi)
            total[docs - lo] += weight[i] * part
        docs = np.flatnonzero(total > max(0, least_now - (int(bound[essential - 1]) if essential else 0)))
        sums, docs = total[docs], docs + lo
        if essential and len(docs):
            block = np.stack([np.searchsorted(p.last, docs) for _, p in lists[:essential]])
            gain = np.stack([weight[i] * np.append(p.most, 0)[block[i]] for i, (_, p) in enumerate(lists[:essential])])
            rest = np.cumsum(gain, axis=0)
            for i in range(essential - 1, -1, -1):
                alive = sums + rest[i] > least_now
                if not alive.all():
                    docs, sums, block, gain, rest = docs[alive], sums[alive], block[:, alive], gain[:, alive], rest[:, alive]
                if not len(docs):
                    break
                p = lists[i][1]
                inside = np.flatnonzero(block[i] < len(p.last))
                if len(inside):
                    sums[inside] += weight[i] * p.at(docs[inside], block[i][inside])
        keep = sums > least_now
        found, score = np.concatenate([found, docs[keep]]), np.concatenate([score, sums[keep]])
        if len(found) > k:
            top = np.lexsort((found, -score))[:k]
            found, score = found[top], score[top]
        if len(found) == k:
            least_now = max(least_now, int(score.min()))
        lo, width = hi, 2 * width
    return found, score


def _search(items: list[tuple[np.ndarray, np.ndarray]], names: pa.Array, least: np.ndarray, k: int) -> Callable[[pa.Table], pa.Table]:
    """The ``k`` best documents of a shard for each item (terms, weights)."""

    def run(shard: pa.Table) -> pa.Table:
        term = shard.column("term").to_pylist()
        head = term.index(None)
        norm = np.frombuffer(shard.column("data")[head].as_buffer(), np.int64)
        column = {c: shard.column(c) for c in ("df", "top", "last", "most", "data")}
        lists = {t: Postings(column["df"][i].as_py(), column["top"][i].as_py(), *(column[c][i].values.to_numpy() for c in ("last", "most")), column["data"][i].as_py(), norm) for i, t in enumerate(term) if t is not None}
        which, docs, scores = [], [], []
        for i, (terms, weights) in enumerate(items):
            here = [(w, lists[t]) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if w and t in lists]
            if here:
                found, score = best(here, len(norm), k, int(least[i]))
                which.append(np.full(len(found), i))
                docs.append(found)
                scores.append(score)
        flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (which, docs, scores)]
        ids = shard.column("ids")[head].values
        return pa.table({"item": names.take(pa.array(flat[0])), "id": ids.take(pa.array(flat[1])), "score": pa.array(flat[2])})

    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    """Merges the shards' results; Spark keeps ``k`` rows an item in each task before it shuffles."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term, n): the terms of each item and how often it has them."""
    slim = items.groupBy(F.col(item_col).alias("item")).agg(F.min(text_col).alias("text"))
    kind = slim.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, w in _pieces(batch.column(1)):
                names = batch.column(0).take(pa.array(w.doc + a))
                yield pa.RecordBatch.from_arrays([names, pa.array(w.hashes().view(np.int64))], names=["item", "term"])

    return slim.mapInArrow(run, f"item {kind}, term long").groupBy("item", "term").agg(F.count("*").alias("n"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item, rank, id, score): for each item its ``k`` documents of the highest scores over 0, of equal scores those with the smaller id (null last).

    The totals come from one pass, the index from another; it is written to the shared folder. Items are searched for in slices of
    about SLICE_TERMS distinct terms (at least one item), which are broadcast: each slice reads its terms' rows of the index,
    counts their documents and searches each shard in a task. About FIRST_SHARDS shards are searched first; the k-th score that they
    give an item is a threshold for the others.

    Null texts have no terms. Rows of one item id (null is one) are one item, with the smallest text. Documents that repeat
    an id are documents of their own. Empty tables give no rows; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    totals = corpus_totals(docs, text_col)
    with scratch(spark):
        index = staged(build_index(docs, totals, id_col, text_col, shard_bytes), "index")
        asked = staged(query_terms(items, item_col, item_text_col), "query-terms")
        kinds = [index.schema["ids"].dataType.elementType.simpleString(), asked.schema["item"].dataType.simpleString()]
        n_slices = max(1, -(-asked.count() // SLICE_TERMS))
        shards = index.where("term is null").count()
        first = F.pmod(F.xxhash64("shard"), F.lit(max(1, shards // FIRST_SHARDS))) == 0
        schema = f"item {kinds[1]}, id {kinds[0]}, score long"
        out = spark.createDataFrame([], schema)
        for s in range(n_slices):
            part = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_slices)) == s)
            here = index.join(F.broadcast(part.select("term").distinct()), "term", "left_semi")
            df = {r.term: r.df for r in here.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # the slice's terms at most
            rows = part.toArrow()
            if not rows.num_rows or not df:
                continue
            term, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
            weight = np.array([term_weight(df[t], totals[0]) * c if t in df else 0 for t, c in zip(term.tolist(), n.tolist(), strict=True)], np.int64)
            code = rows.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
            names, at = code.dictionary, code.indices.to_numpy()
            by = np.argsort(at, kind="stable")
            stops = np.searchsorted(at[by], np.arange(len(names) + 1))
            known = [(term[by[a:b]], weight[by[a:b]]) for a, b in zip(stops[:-1], stops[1:], strict=True)]
            wanted = here.unionByName(index.where("term is null"))

            def run(shards_of: DataFrame, least: np.ndarray, known=known, names=names) -> DataFrame:
                held = spark.sparkContext.broadcast((known, names, least))
                return shards_of.groupBy("shard").applyInArrow(lambda t: _search(*held.value, k)(t), schema)

            least = np.zeros(len(names), np.int64)
            if shards > 2 * FIRST_SHARDS:
                begun = staged(run(wanted.where(first), least), "first-shards")
                place = {x: i for i, x in enumerate(names.to_pylist())}
                for r in _top(begun, k).where(F.col("rank") == k).collect():  # a row for each item of the slice at most
                    least[place[r.item]] = r.score - 1  # an equal score may have a smaller id
                found = begun.unionByName(run(wanted.where(~first), least))
            else:
                found = run(wanted, least)
            out = out.unionByName(found)
        found = staged(out, "found", keep=True)
    return _top(found, k).select("item", "rank", "id", "score")


def op13_block_max_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) AS all_docs, CAST(sum(len(w)) AS BIGINT) AS all_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, n, t),
weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(all_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY t),
q AS (
  SELECT item_id, t, count(*) AS q
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, t),
scored AS (
  SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * all_docs) // all_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN weight USING (t), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
