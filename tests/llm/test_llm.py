"""The training-data operators against brute force on small tables, and their defined results for odd rows."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aislewatch.llm import decontamination, embedding_dedup, jaccard_join, language, licenses, mixing, quality, sharding, token_files, toxicity
from aislewatch.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t", "a", "one two", "é", "12 34", "x" * 60_000, "word " * 20_000, "The licence: MIT License!", "中文 \U0001f600"]


def frame(spark, texts, lang="en"):
    rows = [(i, t, lang, None if i % 7 == 3 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clash(df):
    """Extra columns with names that operators use inside."""
    for c in ("_id", "id", "n", "k1", "_seq", "size", "shard", "block", "_text", "label", "_b"):
        df = df.withColumn(c, F.lit("x"))
    return df


def prose(n, seed=0, vocabulary=400):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdefghilmnoprstu"), r.integers(2, 8))) for _ in range(vocabulary)]
    return [" ".join(r.choice(words, r.integers(5, 120))) for _ in range(n)]


def near_copies(texts, seed=1):
    r = np.random.default_rng(seed)
    out = list(texts)
    for t in texts[::3]:
        w = t.split()
        w[r.integers(len(w))] = "changed"
        out.append(" ".join(w))
    return out + texts[:4] * 3


def unite(n, pairs):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
    return root


def jaccard_brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = unite(len(sets), pairs)
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 106)] + [(5, k) for k in range(20, 60)] + [(7, 7), (9, 3), (3, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 107)}, **{k: 5 for k in (5, *range(20, 60))}, 9: 1, 3: 1, 1: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain(spark, monkeypatch):
    """Rounds grow with the logarithm of a chain's length, whatever the order of its ids."""
    from aislewatch.llm import common

    calls, plain = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df, keep=False: calls.append(1) or plain(df, keep))
    got = common.components(spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r.component for r in got.collect()} == {0} and got.count() == 2001
    assert len(calls) <= 3 + 3 * 14


def test_jaccard_join(spark):
    texts = near_copies(prose(60)) + ODD + ODD[:3]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(clash(frame(spark, texts))).collect()}
    assert got == jaccard_brute(texts)


def test_jaccard_join_small_groups(spark, monkeypatch):
    """Groups of three classes: what chunks and opened groups find together is still all."""
    monkeypatch.setattr(jaccard_join, "GROUP", 3)
    monkeypatch.setattr(jaccard_join, "LEAD_ROWS", 50)  # a leader's tokens in many parts
    base = prose(1, 5)[0].split() * 1 + prose(1, 6)[0].split()
    r = np.random.default_rng(2)
    texts = []
    for _ in range(40):
        w = list(base)
        for k in r.choice(len(w), 2, replace=False):
            w[k] = f"w{r.integers(1000)}"
        texts.append(" ".join(w))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similar_components(frame(spark, texts)).collect()}
    assert got == jaccard_brute(texts)


def test_jaccard_join_holds_little_in_a_worker():
    """What helpers hold at once beside their rows, on a partition of 3 million tokens; and what the toxicity stage left goes."""
    import tracemalloc

    from aislewatch.llm import memo

    r = np.random.default_rng(8)
    texts = [" ".join(map(str, r.integers(0, 10_000, 300))) for _ in range(10_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a : a + 1000])], names=["text"]) for a in range(0, len(texts), 1000)]
    none = jaccard_join.Often(np.zeros(0, np.uint64), np.zeros(0, np.int32))
    n = 3000
    q = pa.table({"token": np.arange(n) % 10, "cid": np.arange(n) - (1 << 40), "n": np.full(n, 9), "comp": np.full(n, 1), "many": np.full(n, 1), "gid": np.full(n, 5)})
    m = pa.table({"token": np.arange(n) % 10, "to": np.arange(n) % 3, "lo": np.full(n, 9), "hi": np.full(n, 9), "tmany": np.full(n, 2), "tcomp": np.full(n, 2)})
    memo.worker_memo("toxicity", lambda: memo.Memo(lambda words: np.zeros((len(words), 1)), 1))
    jaccard_join._lookups(q, m, 80)  # imports and tables that stay
    assert sum(x.num_rows for x in jaccard_join._postings(iter(batches[:1]), none, 5, 80, 256)) == 256
    assert not memo._WORKER
    for limit, run in ((90, lambda: list(jaccard_join._repeated(iter(batches), 5))), (60, lambda: [b.num_rows for b in jaccard_join._postings(iter(batches), none, 5, 80, 256)]), (40, lambda: jaccard_join._lookups(q, m, 80))):
        tracemalloc.start()
        got = run()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < limit, peak
    assert got.num_rows == 3 * n and sum(got.column("c").to_pylist()) == n * n // 10


def test_small_batches_leave_the_setting_as_it_was(spark):
    from aislewatch.llm import common

    before = spark.conf.get(common.BATCH)
    with common.small_batches(spark, 10_000):
        rows = spark.range(4000).select(F.repeat(F.lit("x"), 100).alias("text")).repartition(1).mapInArrow(lambda b: (pa.RecordBatch.from_arrays([pa.array([x.num_rows])], names=["n"]) for x in b), "n long").collect()
    assert max(r.n for r in rows) < 1000 and sum(r.n for r in rows) == 4000
    assert spark.conf.get(common.BATCH) == before


def test_jaccard_join_empty_and_one_of_each(spark):
    assert jaccard_join.similar_components(frame(spark, [])).count() == 0
    texts = near_copies(prose(20))
    docs = frame(spark, texts)
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs).collect()}
    assert kept == {c for _, c in jaccard_brute(texts).values()}
    twice = jaccard_join.one_of_each(docs.unionByName(docs))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(kept) and twice.columns == docs.columns
    # one id, or none, for several unlike texts: each text is a row of its own; a linked copy goes whatever its id
    odd = frame(spark, [texts[0], texts[1], texts[2], texts[0], None, ""]).withColumn("doc_id", F.when(F.col("doc_id") < 3, F.lit(4)).when(F.col("doc_id") == 3, 2))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in jaccard_join.one_of_each(clash(odd)).collect())
    assert got == sorted([(False, 2, texts[0]), (False, 4, texts[1]), (False, 4, texts[2]), (True, 0, ""), (True, 0, "")])


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((40, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base[:20] + 0.1 * r.standard_normal((20, 16)), base[:5]]))]
    bad = [(100, None), (101, [0.0] * 16), (102, [float("nan")] + [1.0] * 15), (103, [None] + [1.0] * 15), (104, [1.0] * 3), (105, []), (106, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(clash(df)).collect()}
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    root = unite(len(u), [tuple(p) for p in np.argwhere(link)])
    assert link.sum() > 20
    assert got == {**{i: (int(link[i].sum()), root[i], root[i] == i) for i in range(len(u))}, **{i: (0, i, True) for i, _ in bad}}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id >= 100 AND vec_id <> 104")).count() == 6


def test_embeddings_in_many_blocks(spark, monkeypatch):
    """Small blocks, clusters that no split parts, copies, and two lengths."""
    monkeypatch.setattr(embedding_dedup, "LEAST_BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 8 * 8 * 12)
    r = np.random.default_rng(14)
    centres = r.standard_normal((6, 12))
    x = np.concatenate([centres[r.integers(0, 6, 150)] + 0.25 * r.standard_normal((150, 12)), np.repeat(centres[:1], 60, axis=0), r.standard_normal((40, 12))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000 + i, [float(c) for c in v[:5]]) for i, v in enumerate(x[:50])]
    got = {y.vec_id: (y.n_links, y.component_id) for y in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for start, part in ((0, x), (1000, x[:50, :5])):
        u = part / np.linalg.norm(part, axis=1, keepdims=True)
        link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
        root = unite(len(u), [tuple(p) for p in np.argwhere(link)])
        assert {i: got[start + i] for i in range(len(u))} == {i: (int(link[i].sum()), start + root[i]) for i in range(len(u))}


def test_far_blocks_are_left_out():
    lo, hi = np.array([[0.9, -0.1], [-1.0, -0.1], [0.8, 0.0]]), np.array([[1.0, 0.1], [-0.9, 0.1], [0.9, 0.2]])
    near = embedding_dedup.near_leaves(lo, hi, np.array([0.1, 0.1, 0.3]), 0.9)
    assert near.tolist() == [[True, False, True], [False, True, False], [True, False, True]]


def test_dealing_to_many_blocks_is_bounded():
    """600 blocks none of which can be left out: each pair gets both sides, and no more than a bound leaves a worker at once."""
    r = np.random.default_rng(5)
    x, n, most = r.standard_normal((3000, 64)), 600, 1 << 20
    leaf = np.arange(3000) % 500
    parts = np.where(np.arange(500) < 100, 2, 1)  # a hundred leaves of two blocks each
    batches = list(embedding_dedup.deal(np.arange(3000), np.ones(3000, np.int64), x, leaf, np.cumsum(parts) - parts, parts, np.ones((500, 500), bool), most))
    size = [sum(len(v) for c in ("ids", "copies", "data") for v in b.column(c).to_pylist()) for b in batches]
    assert len(batches) > 100 and max(size) <= most + 30 * 66 * 8 and sum(size) == 3000 * n * 66 * 8
    got = {(i, j, s) for b in batches for i, j, s in zip(*(b.column(c).to_pylist() for c in ("i", "j", "side")), strict=True)}
    assert got == {(i, j, s) for i in range(n) for j in range(i, n) for s in (0, 1) if not (i == j and s)}


def test_tile_bounds_lose_nothing():
    """Vectors around the threshold and a hot group, over several tiles."""
    r = np.random.default_rng(8)
    centre = r.standard_normal(24)
    x = np.concatenate([r.standard_normal((1500, 24)), centre + 0.32 * r.standard_normal((900, 24))])
    axes = np.linalg.qr(r.standard_normal((24, 24)))[0]
    side = embedding_dedup.Side(np.arange(len(x)), x, axes, [6, 12, 18, 24])
    got = sum(len(a) for a, _ in embedding_dedup.tile_links(side, side, True, [6, 12, 18, 24], 0.9))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == np.triu(u @ u.T >= 0.9, 1).sum() > 1000


def test_decontamination(spark):
    texts = prose(80, 3)
    items = [" ".join(texts[k].split()[:25]) for k in (0, 1, 2)] + ["short item here", None, "", "!!", "short item here"]
    docs = [*texts, "so a SHORT, item-here and short item here", *ODD, texts[0] + " tail", "pre " + " ".join(texts[1].split()[3:14])]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    want = {}
    for i, t in enumerate(docs):
        w, hit, found = words(t), set(), set()
        for k, item in enumerate(items):
            p = words(item)
            m = min(10, len(p))
            windows = {tuple(p[a : a + m]) for a in range(len(p) - m + 1)} if p else set()
            for a in range(len(w) - m + 1):
                if m and tuple(w[a : a + m]) in windows:
                    hit |= set(range(a, a + m))
                    found.add(str(k))
        want[i] = (len(w), len(hit), sorted(found))
    for size in (1 << 20, 8):  # one slice, and many
        got = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in decontamination.find_benchmark(clash(frame(spark, docs)), bench, slice_words=size).collect()}
        assert got == want
        dropped = decontamination.drop_contaminated(clash(frame(spark, docs)), bench, slice_words=size)
        assert {r.doc_id for r in dropped.collect()} == {i for i, (_, n, _) in want.items() if not n} and dropped.columns == clash(frame(spark, docs)).columns
    twice = frame(spark, docs[:3]).unionByName(frame(spark, docs[:3]))
    assert sorted((r.doc_id, r.n_hit) for r in decontamination.find_benchmark(twice, bench, slice_words=8).collect()) == sorted((i, want[i][1]) for i in (0, 0, 1, 1, 2, 2))
    assert decontamination.find_benchmark(frame(spark, docs), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.find_benchmark(frame(spark, []), bench).count() == 0


def test_benchmark_items_without_an_id(spark):
    docs = frame(spark, ["one two three four five six", "other words of its own"])
    bench = spark.createDataFrame([(None, "two three four"), (None, "not to be found"), (7, "five six")], "item_id long, text string")
    for size in (1 << 20, 1):
        got = sorted((r.n_words, r.n_hit, list(r.items)) for r in decontamination.find_benchmark(docs, bench, slice_words=size).collect())
        assert got == [(5, 0, []), (6, 5, ["7"])]
        left = decontamination.drop_contaminated(docs, bench.where("item_id IS NULL"))
        assert [r.text for r in left.collect()] == ["other words of its own"]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = [*prose(40), *ODD, "it's <|endoftext|> and<|startoftext|>more.\r\nNext line x ΟΔΟΣ é"]
    out = str(tmp_path / "tokens")
    token_files.write_tokens(clash(frame(spark, texts)), out, path, encoding=encoding)
    tokens = token_files.read_tokens(spark, out)
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_files.token_starts(tokens, tokens.select("part", "n_tokens")).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, list(got[i].ids)) == (at, ids)
        at += len(ids)
    import pyarrow.parquet as pq

    parts = sorted((tmp_path / "tokens").glob("part-*"))
    firsts = [pq.read_table(p).column("doc_id").to_pylist() for p in parts]
    assert [x for p in firsts for x in p] == list(range(len(texts)))
    chunk = pq.ParquetFile(parts[0]).metadata.row_group(0).column(3)
    assert chunk.has_offset_index
    assert ("DELTA_BINARY_PACKED" if encoding == "delta" else "RLE_DICTIONARY") in str(chunk.encodings).replace("PLAIN_DICTIONARY", "RLE_DICTIONARY")


def scanned(df):
    """The rows that the scan of an executed plan gave on."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaf = plan.collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_are_read_in_parts(spark, tmp_path, encoding):
    """A range of ids opens its pages only, and a span of positions has the tokens that lie there."""
    import public_tokenizers

    texts = [f"word {i} of many words" for i in range(4000)]
    docs, out = frame(spark, texts), str(tmp_path / encoding)
    token_files.write_tokens(docs, out, public_tokenizers.path("word_bpe_49k.json"), encoding=encoding, page_rows=50, page_bytes=1 << 10)
    part = token_files.read_tokens(spark, out, first=1000, last=1009)
    assert sorted(r.doc_id for r in part.collect()) == list(range(1000, 1010))
    narrow = token_files.read_tokens(spark, out, first=1000, last=1009, columns=("doc_id", "n_tokens"))
    rows = narrow._jdf.queryExecution().executedPlan().executeCollect()
    assert len(rows) == 10 and scanned(narrow) <= 200
    every = sorted((r.doc_id, list(r.ids)) for r in token_files.read_tokens(spark, out).collect())
    flat = [t for _, ids in every for t in ids]
    span = sorted((r["at"], list(r.ids)) for r in token_files.read_span(spark, out, 777, 1234).collect())
    assert [t for _, ids in span for t in ids] == flat[777:1234] and span[0][0] == 777
    assert token_files.read_span(spark, out, len(flat), len(flat) + 5).count() == 0
    assert token_files.chunkable(public_tokenizers.path("word_bpe_49k.json")) and not token_files.chunkable(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files_empty(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    token_files.write_tokens(frame(spark, []), str(tmp_path / "t"), P.path("word_bpe_49k.json"))


def test_mixing(spark):
    texts = prose(150, 9) + ODD
    docs = clash(frame(spark, texts))
    rows = mixing.mix_sources(docs, block=16).collect()
    assert sorted(rows) == sorted(mixing.mix_sources(docs.repartition(7), block=16).collect())
    source = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, left, want = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(names), {}
    while left:
        line = (1.5 * sum(size.values()) - sum(want.values())) / sum(weight[s] for s in left)
        over = {s for s in left if line * weight[s] > 2 * size[s]}
        want |= {s: 2.0 * size[s] for s in over} if over else {s: line * weight[s] for s in left}
        left -= over or left
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    again = Counter()
    for r in out.collect():
        again[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert again == Counter({r.doc_id: r.taken for r in rows if r.taken})
    named = docs.withColumns({c: F.lit(f"kept {c}") for c in ("size", "epoch", "_k", "_parts", "_row", "_seq", "shard", "a.b")})
    kinds = {tuple(r[c] for c in ("size", "epoch", "_k", "_parts", "_row", "_seq", "shard", "a.b")) for r in mixing.mixed_documents(named, block=16).collect()}
    assert kinds == {tuple(f"kept {c}" for c in ("size", "epoch", "_k", "_parts", "_row", "_seq", "shard", "a.b"))}
    assert mixing.mix_sources(frame(spark, [])).count() == 0 and mixing.mixed_documents(frame(spark, [None, ""])).count() == 0


def test_mixing_of_a_written_table(spark, tmp_path):
    """Texts of a written table are read from it again and not written another time; rows are those of the same table unwritten."""
    from aislewatch.llm.common import as_written, scratch

    r = np.random.default_rng(5)
    texts = [" ".join(r.bytes(6).hex() for _ in range(300)) for _ in range(400)] + ODD
    made = clash(frame(spark, texts)).withColumns({"_row": F.lit("kept"), "_seq": F.lit("kept"), "a.b": F.lit("kept")})
    made.repartition(5).write.parquet(str(tmp_path / "the docs"))
    size = sum(p.stat().st_size for p in (tmp_path / "the docs").rglob("*.parquet"))
    docs = spark.read.parquet(str(tmp_path / "the docs"))
    assert as_written(docs) and not any(map(as_written, (docs.where("doc_id > 3"), docs.union(docs), docs.drop("lang"), docs.withColumn("x", F.rand()), made, docs.withColumnRenamed("lang", "_metadata"))))
    left = []
    with scratch(spark, left):
        out = mixing.mixed_documents(docs, block=16)
    rows = out.collect()
    wrote = sum(os.path.getsize(os.path.join(d, f)) for p in left for d, _, files in os.walk(p.removeprefix("file:")) for f in files)
    assert 0 < wrote < size / 2
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed_documents(made, block=16).collect())) and {c for x in rows for c in (x._row, x._seq, x["a.b"])} == {"kept"}
    twice = docs.union(docs).where("doc_id < 50")  # rows that repeat are documents of their own
    again = Counter()
    for x in mixing.mixed_documents(twice, block=16).collect():
        again[x.doc_id] += len(x.text.split())
    assert again == Counter({x.doc_id: x.n for x in mixing.mix_sources(twice, block=16).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect() if x.n})
    named = mixing.mixed_documents(docs.withColumnRenamed("lang", "_metadata"), block=16)
    assert "_metadata" in named.columns and named.count() == len(rows)


def test_mix_plan(spark):
    """Every source's draws are each taken once, shards are full, and a shard's counts vary as a draw does, with the right mean."""
    targets = spark.createDataFrame([(False, "a", 9000, 18000.0), (False, "b", 20000, 9000.5), (True, "", 500, 120.0)], "_nil boolean, _src string, source_size long, target double")
    rows = mixing.mix_plan(targets, block=10, shard_slots=100).collect()
    words, seen, per = Counter(), set(), defaultdict(Counter)
    for r in rows:
        key = (r._nil, r._src)
        words[key] += r["take"]
        assert (key, r.epoch, r.block) not in seen
        seen.add((key, r.epoch, r.block))
        per[r.shard][key] += 1
    assert words == {(False, "a"): 18000, (False, "b"): 9000, (True, ""): 120}
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) == 1800 + 900 + 12
    assert [sum(per[s].values()) for s in sorted(per)] == [100] * 27 + [12]
    of_a = [per[s][False, "a"] for s in range(27)]
    assert abs(np.mean(of_a) - 100 * 1800 / 2712) < 4 and 2 < np.std(of_a) < 9
    assert sorted(r.block for r in rows if r._src == "b")[:3] != [0, 1, 2]  # a permutation's first ranks, not the first blocks


@pytest.mark.parametrize("copies", [40])
def test_sharding(spark, copies):
    texts = prose(200, 11) + ["hot text"] * copies + ["pair a", "pair b"] * 2 + ODD
    rows = sharding.balanced_shards(clash(frame(spark, texts)), 8).collect()
    count, slots, groups = Counter(), defaultdict(list), defaultdict(Counter)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        count[r.shard] += 1
        slots[r.shard].append(r.slot)
        groups[raw][r.shard] += 1
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(8))
    assert all(sorted(v) == list(range(count[s])) for s, v in slots.items())
    assert len(groups[b"pair a"]) == 1 and len(groups[b"pair b"]) == 1
    assert len(groups[b"hot text"]) <= copies // (len(texts) // 8) + 2
    report = sharding.cut_links(sharding.balanced_shards(frame(spark, texts), 8)).first()
    torn = {k: c for k, c in groups.items() if len(c) > 1}
    assert report.groups == sum(sum(c.values()) > 1 for c in groups.values()) and (report.torn, report.cut) == (len(torn), sum(sum(c.values()) - max(c.values()) for c in torn.values()))


def test_sharding_odd(spark):
    assert sharding.balanced_shards(frame(spark, [])).count() == 0
    docs = frame(spark, ["same"] * 5)
    assert sorted(r.shard for r in sharding.balanced_shards(docs.unionByName(docs), 3).collect()) == [0] * 4 + [1] * 3 + [2] * 3


def test_licenses(spark):
    texts = ["Released under the MIT License.", "the MIT  license, mit license", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0 you may", "general public mit license", "under the mit license", *ODD, "licensed under cc by-nc 4.0.", *prose(20)]
    got = {r.doc_id: r for r in licenses.scan_licenses(clash(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, v) for p, v in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        joined = "".join(f" {x}" for x in w)
        base = {v for _, v in at}
        found = {k for k, m in licenses.TEMPLATES.items() if re.search(licenses.template_regex(m), joined)}
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min([k for k, _ in at], default=None), max([k for k, _ in at], default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(base | found)))
    assert got[0].labels == "mit,mit-notice" and got[4].labels == "mit" and got[5].labels == "mit"


def test_automaton_regions():
    a = licenses.Automaton("start [maybe this] then {1-3} end")
    say = lambda t: a.accepts(t.encode().split(), 0)
    assert [say(t) for t in ("start then x end", "start maybe this then x y z end", "start maybe then x end", "start then end", "start then a b c d end")] == [4, 8, -1, -1, -1]


def test_language(spark, tmp_path):
    r = np.random.default_rng(3)
    make = lambda parts, n: [" ".join("".join(r.choice(parts, 3)) for _ in range(r.integers(6, 30))) for _ in range(n)]
    texts = make(["the", "ing", "er", "th"], 60) + make(["ung", "sch", "ei", "ß"], 60)
    rows = [(i, t, "en" if i < 60 else "de", "s", 0) for i, t in enumerate(texts)] + [(200 + i, t, None, None, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit_language(docs.where("doc_id % 4 <> 2"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_language(clash(docs), model).collect()}
    held = [i for i in range(120) if i % 4 == 2]
    assert sum(got[i][0] == ("en" if i < 60 else "de") for i in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {i: got[200 + i][0] for i in (0, 1, 2, 3, 7)} == dict.fromkeys((0, 1, 2, 3, 7), "und")
    none = language.fit_language(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language.identify_language(docs, none).collect()} == {"und"}


def padded(*words):
    x = np.zeros((len(words), max(map(len, words))), np.int64)
    for i, w in enumerate(words):
        x[i, : len(w)] = np.frombuffer(w, np.uint8).astype(np.int64) + 1
    return x, np.array([len(w) for w in words])


def test_gru_labels_every_byte():
    """The fast run over many windows, and whole texts cut into windows, give what the recurrence gives byte by byte."""
    m = language.ByteGRU(["a", "b", "c"], seed=9)
    x, n = padded(b"abc de", b"z", "h\u00e9llo, w 12".encode())
    slow, fast = np.exp(m._forward(x, n)[0]), m.probabilities(x, n)
    for i, k in enumerate(n):
        assert np.allclose(slow[:k, i], fast[:k, :, i], atol=1e-5)
    text = (" ".join(prose(6, 77))).encode()[:1500] + b"\n"
    off = np.array([0, 0, 5, len(text)])
    got = language.text_probabilities(np.frombuffer(text, np.uint8), off, m)
    assert (got[0] == 0).all() and len(text) > 2 * language.WINDOW
    for row, (a, b) in enumerate([(0, 5), (5, len(text))], 1):
        total = np.zeros(3)
        for start in range(a, b, language.WINDOW):
            lo, hi, stop = max(a, start - language.CONTEXT), min(b, start + language.WINDOW + language.CONTEXT), min(b, start + language.WINDOW)
            p = np.exp(m._forward(*padded(text[lo:hi]))[0])[:, 0]
            total += p[start - lo : stop - lo].sum(axis=0)
        assert np.allclose(got[row], total / (b - a), atol=1e-4)


def test_gru_gradients():
    m = language.ByteGRU(["a", "b"], embed=3, hidden=4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, n = padded(b"abc", b"zz", b"hello")
    y = np.array([0, 1, 1])

    def loss():
        lp, mask = m._forward(x, n)[:2]
        return -(lp[:, np.arange(3), y] * mask).sum() / mask.sum()

    g = m._gradients(x, n, y)
    for k, v in m.p.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        v[i] += 1e-3
        up = loss()
        v[i] -= 2e-3
        down = loss()
        v[i] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-3 * max(1, abs(g[k][i]))


def test_quality(spark):
    r = np.random.default_rng(5)
    good = [t.capitalize() + "." for t in prose(120, 21)]
    bad = [t.upper().replace(" ", "!! ") for t in prose(40, 22)] + [" ".join(w for w in t.split() for _ in range(6)) for t in prose(40, 23)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(200)] + [(3, None, None), (900, 1, 1)], "doc_id long, quality int, toxic int")
    from aislewatch.llm.labelled import labelled_texts

    model = quality.fit_quality(labelled_texts(docs, labels, "quality", 500))
    got = {x.doc_id: x.score for x in quality.score_quality(clash(docs.unionByName(frame(spark, ODD).withColumn("doc_id", F.col("doc_id") + 500))), model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 212
    assert np.mean([(got[i] >= quality.CUT) == (i < 120) for i in range(200)]) >= 0.95
    assert quality.fit_quality(labelled_texts(docs, labels.where("quality = 1"), "quality", 500)) is None
    assert {x.score for x in quality.score_quality(docs, None).collect()} == {1.0}
    assert r is not None


def test_toxicity(spark):
    r = np.random.default_rng(6)
    clean = prose(240, 31)
    rows = [(t, 0) for t in clean[:160]]
    for t in clean[160:]:
        w = t.split()
        for _ in range(3):
            w.insert(int(r.integers(len(w) + 1)), str(r.choice(["zuckwort", "jammerlump", "quirrkopf"])))
        rows.append((" ".join(w), 1))
    model = toxicity.fit_toxicity(rows[:100] + rows[160:220], clean_weight=1.5)
    texts = [t for t, _ in rows] + ["plain zuckwort", "so a z-u-c-k-w-o-r-t", "z u c k w o r t", "zuckxwort", "Jammerlump!!", *ODD]
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(clash(frame(spark, texts)), model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    test = [*range(100, 160), *range(220, 240)]
    assert np.mean([(got[i] >= 0.5) == bool(rows[i][1]) for i in test]) >= 0.95
    n = len(rows)
    assert all(got[n + k] >= 0.5 for k in range(5)), [got[n + k] for k in range(5)]
    assert all(got[n + 5 + k] == 0 for k in range(4))
    assert toxicity.fit_toxicity([("a b", 0), (None, 1)]) is None
    kept = {x.doc_id for x in toxicity.drop_toxic(clash(frame(spark, texts)), model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}


def test_toxic_windows_of_sentences():
    """Insults of two words that are harmless apart, insults over a space, and words that meet only across a full stop."""
    r = np.random.default_rng(9)
    rows = []
    for i, t in enumerate(prose(400, 33, 150)):
        w = t.split()
        for word in ("gorm", "blask") if i % 2 else ():  # both words are usual in clean texts, but not side by side
            w.insert(int(r.integers(len(w) + 1)), word)
        if i % 4 == 0:
            k = int(r.integers(len(w) + 1))
            w[k:k] = ["gorm", "blask"] if i % 8 else ["quirrkopf"]
        rows.append((" ".join(w), int(i % 4 == 0)))
    rows = [(t, int("gorm blask" in t or "quirrkopf" in t)) for t, _ in rows]
    model = toxicity.fit_toxicity(rows[:300], clean_weight=1.0)
    test = toxicity.score_texts(pa.array([t for t, _ in rows[300:]]), model) >= 0.5
    assert np.mean(test == np.array([bool(k) for _, k in rows[300:]])) >= 0.9
    some = ["so a gorm blask here", "so a gorm. blask here", "so a quirr kopf here", "a gorm here", "a blask here", "a quirrkopf here"]
    got = dict(zip(some, (toxicity.score_texts(pa.array(some), model) >= 0.5).tolist(), strict=True))
    assert got == {some[0]: True, some[1]: False, some[2]: True, some[3]: False, some[4]: False, some[5]: True}


def test_bounds_of_windows():
    """No window's value is over its bound, and all windows of two or three words of a sentence are there."""
    svm = toxicity.KernelSVM([b"idiot", b"banana", b"there you"])
    r = np.random.default_rng(3)
    svm.train(r.standard_normal((40, svm.root.shape[1])), np.where(np.arange(40) % 2, 1.0, -1.0), np.ones(40))
    text = "An idiot, there you go! Bananas ban ana idi ot. A b\nC d e-f idiotidiotidiot banananana x"
    w = toxicity.Words(*list(toxicity.text_pieces(pa.array([text, "", "one", "two idiots"])))[0][2:], toxicity.SPACE)
    first, s, e, bound = toxicity.neighbours(w, svm.table, svm.bias)
    windows = [w.low[a:b].tobytes() for a, b in zip(s, e, strict=True)]
    want = [x for line in [*toxicity.SENTENCE.sub(b"\n", text.lower().encode()).split(b"\n"), b"one", b"two idiots"] for x in toxicity.sentence_windows(line.split()) if b" " in x]
    assert sorted(x.rstrip(b".!") for x in windows) == sorted(want)
    value = svm.whole(windows)
    assert (value <= bound + 1e-9).all() and (value > svm.bias + 0.01).any()


def test_kernel_is_the_subsequence_kernel():
    """The table of weights says the same as kernels with landmarks, Nystroem features and the machine."""
    marks = [b"idiot", b"banana", b"there", b"loser"]
    svm = toxicity.KernelSVM(marks)
    words = [b"idixot", b"other", b"bananas", b"lo.ser"]
    x = svm.features([*marks, *words])
    k = x @ x.T
    assert np.allclose(np.diag(k)[:4], 1, atol=1e-3)

    def brute(s, t):
        def phi(w):
            c = Counter()
            for i in range(len(w)):
                for a in range(1, toxicity.SPAN):
                    for b in range(a + 1, toxicity.SPAN):
                        if i + b < len(w) and all(toxicity.CODE[w[j]] != 63 for j in (i, i + a, i + b)):
                            c[w[i], w[i + a], w[i + b]] += toxicity.DECAY ** (b + 1)
            return c

        p, q = phi(s), phi(t)
        dot = lambda u, v: sum(u[f] * v[f] for f in u)
        return dot(p, q) / np.sqrt(dot(p, p) * dot(q, q))

    for i, a in enumerate(marks):
        for j, b in enumerate(words):
            assert abs(k[i, 4 + j] - brute(a, b)) < 1e-3


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    texts = near_copies(prose(60, 41)) + ["you idiot idiot"] * 2 + ODD
    sf = tmp_path / "sf"
    frame(spark, texts).write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(texts[5].split()[:14]))], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    docs = spark.read.parquet(str(sf / "documents.parquet"))
    a = P.without_toxic(spark, docs, str(sf))
    assert a.count() == len(texts)  # no toxic label: nothing can be learnt, nothing goes
    b = P.one_of_near_copies(spark, a, str(sf))
    keep = {c for _, c in jaccard_brute(texts).values()}
    assert {r.doc_id for r in b.collect()} == keep and b.columns == docs.columns
    c = P.without_benchmark(spark, b, str(sf))
    left = {r.doc_id for r in c.collect()}
    assert left < keep and 5 not in left and len(keep - left) <= 2
    rows = P.run(spark, str(sf)).collect()
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and {r.doc_id for r in rows} <= left


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_queries_that_learn(spark):
    """Held-out parts, ranges and thresholds of the queries' results, and what they get right of the labels that they haven't seen."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language.op2_byte_gru(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in judged]) >= 0.97
    known = {r.doc_id: r for r in labels.collect()}
    for query, cut, label, least in ((quality.op4_bradley_terry, quality.CUT, "quality", 0.95), (toxicity.op5_subsequence_svm, 0.5, "toxic", 0.93)):
        got = query(spark, SF).collect()
        assert sorted(r.doc_id for r in got) == sorted(lang)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
        judged = [r for r in got if r.held_out and r.doc_id in known]
        assert np.mean([r.predicted == known[r.doc_id][label] for r in judged]) >= least


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_of_token_files(spark):
    """Against whole-text encoding of every document."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, {}
    for doc_id, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op3_token_files(spark, SF).collect()} == want


def test_benchmark_patterns_are_small():
    """Patterns are arrays over one buffer of words: about a hundred bytes a word, so that a slice of SLICE_WORDS stays under 100 MB."""
    import pickle

    items = [(str(i), t) for i, t in enumerate(prose(2000, 5, 5000))]
    words = sum(len(t.split()) for _, t in items)
    found = decontamination.Searchers(items, 10)
    shifts = len(found.by_length) * (2 << decontamination.BITS)
    assert (len(pickle.dumps(found)) - shifts) / words < 120 and decontamination.SLICE_WORDS * 120 <= 100 << 20


def test_token_files_encode_a_word_once():
    """A word is worked out once whatever marks follow it and however it is written; the ids are those of whole texts."""
    import public_tokenizers

    from aislewatch.llm import token_files as T

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, words, _ = T._encoder(path)
    asked: list[str] = []
    texts = ["alpha. alpha! alpha,,, alpha", "Alpha. Été été! ALPHA$$$ İ. don't. x'. a.b <|startoftext|>. o̸! ΟΣ.", "", "alpha\nété.\t!"]
    got = T._by_chunk(tok, lambda w: asked.extend(w) or words(w), {}, texts)
    assert got == [np.array(e.ids, np.uint32).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert len(asked) == len(set(asked)) and {"alpha", "été"} <= set(asked) and not any(w.startswith("alpha") for w in asked if w != "alpha")


def test_only_wanted_sets_are_joined(spark):
    """Of 20,000 sets the bitmap lets all wanted ones through, each whole, and at most one other in a hundred; of none wanted, next to none."""
    full = spark.range(20_000).select(F.col("id").alias("cid"), F.encode(F.repeat(F.col("id").cast("string"), 3), "UTF-8").alias("set"))
    wanted = spark.range(0, 20_000, 50).withColumnRenamed("id", "cid")
    got = {r.cid: bytes(r.set) for r in jaccard_join._only(full, wanted).collect()}
    assert all(got[c] == str(c).encode() * 3 for c in range(0, 20_000, 50)) and len(got) <= 400 + 200
    assert jaccard_join._only(full, wanted.where("cid < 0")).isEmpty()
