"""Byte-level BPE, vector codes and ranked search against brute force, and their defined results for odd rows."""

from __future__ import annotations

import base64
import glob
import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aislewatch.llm import byte_bpe, lexical_search, vector_codes
from aislewatch.llm.common import hot_join
from aislewatch.llm.words import ALNUM, Words, text_pieces
from tests.llm.test_llm import ODD, clash, frame, prose

SF = "/root/testdata/sf0.001"


# ---- byte-level BPE


@pytest.fixture(scope="module")
def given():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library(given):
    import tiktoken

    with open(given[0], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=given[1], mergeable_ranks=ranks, special_tokens={})


def plain_merges(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_merges_as_plain_search_does():
    """Ties of the rank go to the leftmost pair; merges that make new pairs on both sides; pieces of one byte to some hundred."""
    r = np.random.default_rng(5)
    merges = [b"ab", b"bc", b"aa", b"abab", b"aaa", b"cab", b"ca", b"abc", b"bcab", b"aaaa"]
    ranks = {bytes([c]): c for c in range(256)} | {x: 256 + i for i, x in enumerate(merges)}
    pieces = [bytes(r.choice(list(b"abc"), n)) for n in [*range(1, 65), *[7] * 200, *[15] * 200, 100, 333]]
    v = byte_bpe.Vocabulary(ranks, [], 4, None, byte_bpe.pair_table(ranks), {}, {})
    for piece, ids in zip(pieces, byte_bpe.encode_pieces(pieces, v), strict=True):
        want = plain_merges(piece, ranks)
        assert byte_bpe.PairTree(piece, ranks, 4).merged() == want and np.frombuffer(ids, "<u4").tolist() == want


TEXTS = [*ODD, "don't  we'll\n\n  it's 'S", " a b　 c ", "x\x1cy\x1e z \x1f", "a\r\n\tb  \n", "عربي 123,456.78", "ab" * 20_000, "\U0001f469‍\U0001f4bb!!", "  lead", "trail  ", "é́ ﻿"]


def test_bpe_is_the_librarys(spark, given, library):
    docs = clash(frame(spark, TEXTS + TEXTS[:5]))
    got = byte_bpe.decode(byte_bpe.encode(docs, *given), *given)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["ids", "bytes"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(TEXTS) + 5
    for i, t in enumerate(TEXTS + TEXTS[:5]):
        assert rows[i].ids == library.encode_ordinary(t or "") and bytes(rows[i].bytes) == (t or "").encode() and rows[i]._b == "x"


def test_bpe_of_random_texts(given, library):
    v, r = byte_bpe.vocabulary(*given), np.random.default_rng(3)
    texts = ["".join(r.choice(list("ab c\n\t.,'s12é中\x1c\x1e  \r \U0001f600"), r.integers(0, 60))) for _ in range(3000)]
    assert [np.frombuffer(b, "<u4").tolist() for b in byte_bpe.encode_texts(texts, v)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_of_an_empty_table_and_parts_of_ids(spark, given):
    assert byte_bpe.decode(byte_bpe.encode(frame(spark, []), *given), *given).count() == 0
    some = spark.createDataFrame([(1, None), (2, []), (3, [50, 70])], "doc_id long, ids array<int>")
    v = byte_bpe.vocabulary(*given)
    assert [r.bytes and bytes(r.bytes) for r in byte_bpe.decode(some, *given).orderBy("doc_id").collect()] == [None, b"", v.tokens[50] + v.tokens[70]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_of_bpe(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {}
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op11_segment_tree(spark, SF).collect()} == want


# ---- vector codes


def plain_codes(rows, parts, entries, rounds):
    """{row number: (code, error)} and the codebooks, in Python's whole numbers; rows: (id, vector)."""
    whole = {i: [math.floor(256 * x) for x in v] for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)}
    first = sorted(whole, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    w = len(whole[first[0]]) // parts
    cut = {i: [x[p * w : p * w + w] for p in range(parts)] for i, x in whole.items()}
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            took = {}
            for i in cut:
                took.setdefault(near(p, cut[i][p])[1], []).append(cut[i][p])
            for k, xs in took.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = {i: [near(p, cut[i][p]) for p in range(parts)] for i in cut}
    return {i: ([k for _, k in f], sum(d for d, _ in f)) for i, f in found.items()}, books


@pytest.mark.parametrize("n", [3, 70, 400])
def test_vector_codes(spark, n):
    """Nulls and what isn't finite, ties (few distinct numbers), equal vectors, repeated and null ids, clashing columns."""
    r = np.random.default_rng(n)
    rows = [(i % 50 if i % 60 else None, [float(x) for x in r.integers(-3, 4, 8) / 7]) for i in range(n)]
    rows += [rows[0], (7, None), (8, []), (9, [0.0] * 7 + [None]), (10, [float("nan")] + [0.0] * 7), (11, [float("inf")] * 8), (12, [0.0] * 8), (13, [1e30] + [0.0] * 7)]
    df = clash(spark.createDataFrame([(a, i, b) for i, (a, b) in enumerate(rows)], "vec_id long, row long, embedding array<double>"))
    want, books = plain_codes([(a, b if not b or 1e30 not in b else None) for a, b in rows], 4, 64, 2)
    got_books = vector_codes.fit_codebooks(df, parts=4)
    assert got_books.tolist() == books
    coded = vector_codes.encode(df, got_books, keep=["row"])
    got = {r.row: (list(r.code), r.error) for r in coded.collect()}
    assert got == want
    back = vector_codes.decode(coded, got_books).collect()
    assert all(sum((math.floor(256 * x) - math.floor(256 * y)) ** 2 for x, y in zip(r.vector, rows[r.row][1], strict=True)) == r.error for r in back)


def test_vector_codes_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    books = vector_codes.fit_codebooks(df)
    assert books.size == 0 and vector_codes.encode(df, books, keep=["label"]).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fit_codebooks(spark.createDataFrame([(1, [0.5] * 10)], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("limit", [0, 3, 10_000])
def test_grid_cells_lose_no_entry(limit):
    r = np.random.default_rng(1)
    entries = r.integers(-150, 150, (64, 4))
    g = vector_codes.Grid(entries, limit)
    evaluated = []
    for _ in range(3):
        x = np.concatenate([r.integers(-200, 200, (500, 4)), entries, entries + 1])
        index, error = g.nearest(x)
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
        evaluated += g.size[: len(g.slot)].tolist()
    assert len(g.slot) <= limit and (not evaluated or np.mean(evaluated) < 40)


def test_cells_that_share_a_hash(monkeypatch):
    r = np.random.default_rng(2)
    entries, x = r.integers(-90, 90, (20, 4)), r.integers(-90, 90, (300, 4))
    g = vector_codes.Grid(entries)
    monkeypatch.setattr(vector_codes.np, "unique", lambda h, **k: (np.array([1]), np.array([0]), np.zeros(len(h), np.int64)) if k else np.array(sorted(set(h.tolist()))))
    index, _ = g.nearest(x)
    assert (index == ((x[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_hot_join(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") < 2900, 1).otherwise(F.col("id")).alias("label"))
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    got = {r.id: r.s for r in hot_join(rows, sums, ["label"], "n", ["id"]).collect()}
    all_of = Counter()
    for r in rows.collect():
        all_of[r.label] += r.id
    assert got == {r.id: all_of[r.label] for r in rows.collect()} and hot_join(rows.limit(0), sums.limit(0), ["label"], "n", ["id"]).count() == 0


# ---- ranked search


def plain_ranks(docs, items, k=10):
    """{item: [(doc_id, score)]}; docs: (id, text)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(i, cut(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = {}
    for item, text in items:
        scores = []
        for i, w in terms:
            tf, m = Counter(w), 100 - 75 + (75 * len(w) * n_docs) // max(1, n_terms)
            s = sum(weight[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in cut(text) if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out[item] = [(None if null else i, -s) for s, null, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("shard_bytes", [1500, 40_000, 32 << 20])
def test_search(spark, shard_bytes):
    """One and many shards (thresholds from the first ones), ties of copies, null ids and texts, terms that repeat in an item, words that all texts have."""
    texts = [t + (" the the of" if i % 2 else " the") for i, t in enumerate(prose(300, 8, 150))] + [*ODD, "the The THE"]
    docs = [(i, t) for i, t in enumerate(texts + texts[:40])] + [(None, texts[3]), (None, texts[4]), (5, texts[9])]
    items = [(i, " ".join(t.split()[:12])) for i, t in enumerate(texts[:25])] + [(100, "the the of"), (101, None), (102, ""), (103, "absentword"), (104, texts[0] + " " + texts[0]), (None, texts[7])]
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    q = clash(spark.createDataFrame(items, "item_id long, text string"))
    got: dict = {i: [] for i, _ in items}
    for r in sorted(lexical_search.search(d, q, shard_bytes=shard_bytes).collect(), key=lambda r: r.rank):
        got[r["item"]].append((r.id, r.score))
        assert r.rank == len(got[r["item"]])
    assert got == plain_ranks(docs, items)


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(d.limit(0), q).count() == 0 and lexical_search.search(d, q.limit(0)).count() == 0
    assert [(r["item"], r.rank, r.id) for r in lexical_search.search(d, q).collect()] == [(1, 1, 1)]


def test_rows_of_an_item_are_one(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "c"), (1, "a"), (1, "a")], "item_id long, text string")
    assert [(r.rank, r.id) for r in lexical_search.search(d, q).collect()] == [(1, 1)]


def test_search_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SLICE_TERMS", 30)
    texts = prose(60, 4, 100)
    docs, items = list(enumerate(texts)), [(i, " ".join(t.split()[:9])) for i, t in enumerate(texts[:20])]
    got: dict = {i: [] for i, _ in items}
    for r in sorted(lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect(), key=lambda r: r.rank):
        got[r["item"]].append((r.id, r.score))
    assert got == plain_ranks(docs, items)


def test_block_maxima_leave_blocks_shut(monkeypatch):
    """The best documents are those of a full search, and blocks of common terms stay compressed."""
    monkeypatch.setattr(lexical_search, "BLOCK", 16)
    monkeypatch.setattr(lexical_search, "WINDOW", 64)
    r = np.random.default_rng(4)
    texts = [" ".join(["common"] * int(r.integers(1, 9)) + ["usual"] * int(r.integers(0, 2)) + (["rare"] if i % 97 == 0 else []) + list(map(str, r.integers(0, 50, r.integers(1, 60))))) for i in range(2000)]
    shard = lexical_search.Shard()
    lengths = [len(t.split()) for t in texts]
    totals = len(texts), sum(lengths)
    for a, b, buf, off in text_pieces(pa.array(texts)):
        shard.add(pa.array(range(a, b)), Words(buf, off, ALNUM))
    rows = pa.Table.from_batches(list(shard.rows(0, totals))).to_pylist()
    norm = np.frombuffer(rows[0]["data"], np.int64)
    of = lambda t: int(Words(*list(text_pieces(pa.array([t])))[0][2:], ALNUM).hashes().view(np.int64)[0])
    made = {x["term"]: x for x in rows[1:]}
    post = lambda t: lexical_search.Postings(made[of(t)]["df"], made[of(t)]["top"], np.array(made[of(t)]["last"]), np.array(made[of(t)]["most"]), made[of(t)]["data"], norm)
    lists = [(lexical_search.term_weight(made[of(t)]["df"], totals[0]), post(t)) for t in ("common", "usual", "rare", "7")]
    docs, scores = lexical_search.best(lists, len(texts), 10)
    want = plain_ranks(list(enumerate(texts)), [(0, "common usual rare 7")])[0]
    assert sorted(zip(docs.tolist(), scores.tolist(), strict=True), key=lambda x: (-x[1], x[0])) == want
    assert lists[0][1].opened < len(lists[0][1].last) / 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("query", [(vector_codes.op12_grid_cells, vector_codes.SQL), (lexical_search.op13_block_max_maxscore, lexical_search.SQL)])
def test_queries_against_sql(spark, query):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, r = query[0](spark, SF), c.sql(query[1])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    at = [r.columns.index(x) for x in cols]
    assert sorted(tuple(x[k] for k in cols) for x in df.collect()) == sorted(tuple(x[i] for i in at) for x in r.fetchall())
