"""Benchmark decontamination: Wu-Manber search for every ten-word window of the benchmark's items, over word symbols."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewatch.llm.common import content, filter_texts, staged, table
from aislewatch.llm.words import ALNUM, Words, mix, text_pieces, windows

STEP = 128
BITS = 20
SLICE_WORDS = 500_000  # words of benchmark text, and so patterns, that are searched for at once: about 40 MB of arrays, four times that while they are built
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))


def same_words(a: Words, at_a: np.ndarray, b: Words, at_b: np.ndarray, m: int) -> np.ndarray:
    """Whether the ``m`` words of ``a`` from each position ``at_a`` on are those of ``b`` from ``at_b`` on, byte by byte."""
    ok = np.ones(len(at_a), bool)
    for j in range(m):
        left = np.flatnonzero(ok)
        x, y = at_a[left] + j, at_b[left] + j
        n = a.end[x] - a.start[x]
        equal = n == b.end[y] - b.start[y]
        ok[left[~equal]] = False
        left, x, y, n = left[equal], x[equal], y[equal], n[equal]
        if len(left):
            begin = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(begin, n)
            match = a.low[np.repeat(a.start[x], n) + step] == b.low[np.repeat(b.start[y], n) + step]
            ok[left] = np.logical_and.reduceat(match, begin)
    return ok


class WuManber:
    """The windows of ``m`` words of a benchmark's texts, as arrays over one buffer of words.

    ``shift``: for each hash of a block of two words (one, if m = 1) how far the search may move when the block ends
    at the current position; 0 if a pattern may end here. ``key`` and ``at``: the patterns (position of the first word)
    by the hash of all their words; where a position's hash is met, its words are compared with the pattern's. ``item`` and
    ``first``: the items of each pattern.
    """

    def __init__(self, text: Words, h: np.ndarray, at: np.ndarray, item: np.ndarray, m: int):
        self.text, self.m, self.block = text, m, min(2, m)
        self.shift = np.full(1 << BITS, m - self.block + 1, np.int16)
        for j in range(self.block, m + 1):
            np.minimum.at(self.shift, self.blocks(h, at + j - 1), m - j)
        key = windows(h, at, m)
        order = np.lexsort((item, key))
        key, at, item = key[order], at[order], item[order].astype(np.int32)
        new = np.append(True, key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        new |= ~same_words(text, at, text, at[head], m)  # equal hashes of other words: a pattern of its own
        self.key, self.at, self.item = key[new], at[new].astype(np.int32), item
        self.first = np.append(np.flatnonzero(new), len(key)).astype(np.int32)

    def blocks(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = h[end] if self.block == 1 else h[end] + h[end - 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mix(s) >> np.uint64(64 - BITS)).astype(np.int64)

    def find(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, pattern) of every occurrence. Rows are searched in steps side by side."""
        m = self.m
        last = w.first[1:] - m
        n = np.maximum(0, last - w.first[:-1] + 1)
        parts = -(-n // STEP)
        row = np.repeat(np.arange(len(n)), parts)
        at = w.first[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * STEP
        stop = np.minimum(at + STEP, last[row] + 1)
        places, patterns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at):
            move = self.shift[self.blocks(h, at + m - 1)]
            hit = at[move == 0]
            if len(hit):
                key = windows(h, hit, m)
                lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
                n = hi - lo
                p, k = np.repeat(hit, n), np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                ok = same_words(w, p, self.text, self.at[k], m)
                places.append(p[ok])
                patterns.append(k[ok])
            at = at + np.maximum(move, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        return np.concatenate(places), np.concatenate(patterns)

    def items(self, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``pattern``, item) of all items of the patterns."""
        n = self.first[pattern + 1] - self.first[pattern]
        which = np.repeat(np.arange(len(pattern)), n)
        return which, self.item[np.repeat(self.first[pattern], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]


class Searchers:
    """Patterns of each length for some items; ``names`` of the items, null where an item has none."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.names = pa.array([n for n, _ in items], pa.string())
        raw = [t.encode() for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        text = Words(np.frombuffer(b"".join(raw), np.uint8), off, ALNUM)
        h = text.hashes()
        lengths = np.minimum(window, text.count)
        self.by_length = []
        for m in sorted(set(lengths[lengths > 0].tolist())):
            own = np.flatnonzero(lengths == m)
            n = text.count[own] - m + 1
            item = np.repeat(own, n)
            at = np.repeat(text.first[own], n) + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            self.by_length.append(WuManber(text, h, at, item, m))


def _slices(benchmark: DataFrame, window: int, slice_words: int) -> Iterator[Searchers]:
    """Searchers for the benchmark's items, about ``slice_words`` of their words at a time, so that neither the driver nor
    a task ever holds more. An item longer than that is a slice of its own size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text")).where("text is not null")
    total = items.agg(F.sum(F.regexp_count(F.col("text"), F.lit(ALNUM_WORD)))).first()[0] or 0
    n = max(1, -(-int(total) // slice_words))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64(F.coalesce("name", "text"), F.length("text")), F.lit(n)) == k).collect()
        yield Searchers([(r.name, r.text) for r in rows], window)


def _lists(n: int, row: np.ndarray, values: pa.Array) -> pa.ListArray:
    """``values``, sorted by ``row``, as a list for each of ``n`` rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _search(batches: Iterator[pa.RecordBatch], searchers: Searchers, hits_only: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, off in text_pieces(batch.column("_text")):
            w = Words(buf, off, ALNUM)
            h = w.hashes()
            marks = np.zeros(len(h) + 1, np.int64)
            doc, item, span = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
            for s in searchers.by_length:
                p, k = s.find(w, h)
                np.add.at(marks, p, 1)
                np.add.at(marks, p + s.m, -1)
                which, items = s.items(k)
                doc.append(w.doc[p[which]])
                item.append(items)
                span.append(np.column_stack([w.doc[p], p - w.first[w.doc[p]], np.full(len(p), s.m)]))
            covered = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
            hit = covered[w.first[1:]] - covered[w.first[:-1]]
            pairs = np.unique(np.column_stack([np.concatenate(doc), np.concatenate(item)]), axis=0)
            names = searchers.names.take(pa.array(pairs[:, 1]))
            named = names.is_valid().to_numpy(zero_copy_only=False)
            rows = pa.table({"d": pairs[named, 0], "i": names.filter(pa.array(named))}).group_by(["d", "i"]).aggregate([]).sort_by([("d", "ascending"), ("i", "ascending")]).combine_chunks()
            items = rows.column("i").combine_chunks() if rows.num_rows else pa.array([], pa.string())
            spans = np.unique(np.concatenate(span), axis=0)
            out = pa.table({
                "_id": batch.column("_id").slice(a, b - a), "_h1": batch.column("_h1").slice(a, b - a), "_h2": batch.column("_h2").slice(a, b - a), "n_words": pa.array(w.count, pa.int64()), "n_hit": pa.array(hit, pa.int64()),
                "items": _lists(b - a, rows.column("d").to_numpy(), items),
                "spans": _lists(b - a, spans[:, 0], pa.StructArray.from_arrays([pa.array(spans[:, 1]), pa.array(spans[:, 2])], fields=list(SPANS.value_type))),
            })
            yield from (out.filter(pa.array(hit > 0)) if hits_only else out).to_batches()


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", slice_words: int = SLICE_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_hit, items (sorted item ids as strings), spans (first word, words).

    The items are searched for in slices of about ``slice_words`` words, chosen by a hash of the item; with more than one
    slice each slice's hits are written before the next is read, and then merged by a shuffle. Null and empty texts have
    no words and no hits; an item without words has no windows; equal windows of several items count for each; an item
    with a null id marks words and spans but adds nothing to items. Items that come twice count once; documents that
    come twice are rows of their own. Texts of any length are searched whole. Columns besides the id and text are
    ignored, whatever their names; empty tables give no hits or an empty result.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text"), *(c.alias(n) for c, n in zip(content("text"), ("_h1", "_h2"), strict=True)))
    schema = "_id {}, _h1 long, _h2 long, n_words long, n_hit long, items array<string>, spans array<struct<first: long, words: long>>".format(slim.schema["_id"].dataType.simpleString())
    parts: list[DataFrame] = []
    held = None
    for searchers in _slices(benchmark, window, slice_words):
        if held is not None:
            parts[-1] = staged(parts[-1], "found")
            held.destroy()
        held = spark.sparkContext.broadcast(searchers)
        parts.append(slim.mapInArrow(lambda batches, held=held, more=bool(parts): _search(batches, held.value, more), schema))
    if len(parts) == 1:
        return parts[0].drop("_h1", "_h2").withColumnRenamed("_id", id_col)
    # rows of one id and text have the same hits, so they are told by these, whatever order a later pass reads them in
    more = parts[1]
    for p in parts[2:]:
        more = more.unionByName(p)
    more = more.groupBy(F.col("_id").alias("_i"), F.col("_h1").alias("_a"), F.col("_h2").alias("_b")).agg(F.flatten(F.collect_set("items")).alias("_items"), F.flatten(F.collect_set("spans")).alias("_spans"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b"))
    both = lambda x, y, kind: F.array_sort(F.array_distinct(F.concat(x, F.coalesce(y, F.array().cast(kind)))))
    merged = parts[0].join(more, same, "left").select("_id", "n_words", both("items", "_items", "array<string>").alias("items"), both("spans", "_spans", "array<struct<first: long, words: long>>").alias("spans"))
    fold = """aggregate(spans, named_struct('upto', 0L, 'n', 0L),
        (s, x) -> named_struct('upto', greatest(s.upto, x.first + x.words), 'n', s.n + greatest(0L, x.first + x.words - greatest(s.upto, x.first))), s -> s.n)"""
    return merged.select(F.col("_id").alias(id_col), "n_words", F.expr(fold).alias("n_hit"), "items", "spans")


def _clean(texts: pa.Array, searchers: Searchers) -> np.ndarray:
    keep = np.ones(len(texts), bool)
    for a, _, buf, off in text_pieces(texts):
        w = Words(buf, off, ALNUM)
        h = w.hashes()
        for s in searchers.by_length:
            keep[a + w.doc[s.find(w, h)[0]]] = False
    return keep


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without a word inside an occurrence of a window.

    One pass without a shuffle if the benchmark is one slice; else each slice's hit texts are written as hashes before
    the next slice is read, and the rows with those texts are left out by a join. Defined results as in :func:`find_benchmark`.
    """
    spark = docs.sparkSession
    held, gone = None, None
    for searchers in _slices(benchmark, window, slice_words):
        if held is not None:
            found = staged(_hit_texts(docs, held), "hit")
            gone = found if gone is None else gone.unionByName(found)
            held.destroy()
        held = spark.sparkContext.broadcast(searchers)
    if gone is None:
        return filter_texts(docs, lambda texts: _clean(texts, held.value))
    h1, h2 = content("text")
    gone = gone.unionByName(_hit_texts(docs, held)).distinct().select(F.col("h1").alias("_h1_of_content"), F.col("h2").alias("_h2_of_content"))
    return docs.join(gone, (h1 == F.col("_h1_of_content")) & (h2 == F.col("_h2_of_content")), "left_anti")


def _hit_texts(docs: DataFrame, held) -> DataFrame:
    slim = docs.select("text", *content("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["h1", "h2"]).filter(pa.array(~_clean(batch.column("text"), held.value)))

    return slim.mapInArrow(run, "h1 long, h2 long").distinct()


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
pattern AS (
  SELECT id, least(10, len(w)) AS m, unnest([array_to_string(w[i : i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS p
  FROM words WHERE kind = 'b' AND len(w) > 0),
place AS (
  SELECT id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM words, (SELECT DISTINCT m FROM pattern) WHERE kind = 'd'),
hit AS (
  SELECT place.id, i, place.m, pattern.id AS item FROM place JOIN pattern ON place.m = pattern.m AND array_to_string(w[i : i + place.m - 1], ' ') = p),
cover AS (SELECT id, count(DISTINCT x) AS n FROM (SELECT id, unnest(range(i, i + m)) AS x FROM hit) GROUP BY id),
item AS (SELECT id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT CAST(item AS VARCHAR))), ',') AS names FROM hit GROUP BY id)
SELECT words.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(item.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM words LEFT JOIN cover ON words.id = cover.id LEFT JOIN item ON words.id = item.id WHERE kind = 'd'
"""
