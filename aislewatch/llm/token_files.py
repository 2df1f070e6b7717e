"""Token ids as Parquet files: encoded lists in ascending document order, with row groups and pages of a set size."""

from __future__ import annotations

import itertools
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislewatch.llm.common import shared_dir, table

KEPT_CHUNKS = 500_000
PIECE = 4 << 20
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which begins pieces such as 's
_WORKER: dict[str, tuple] = {}


def _encoder(path: str) -> tuple:
    """The tokenizer, its model's :func:`_words` and this worker's ids of chunks; all outlive a task, because workers are used again."""
    if path not in _WORKER:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _WORKER[path] = (tok, _words(tok, path), {})
    return _WORKER[path]


def _words(tok, path: str) -> Callable[[list[str]], dict[str, bytes]] | None:
    """Encodes lower-case words by the tokenizer's model alone, which gets them as the bytes' letters; None unless what the tokenizer
    does between its split and its model is byte-level writing and nothing else."""
    spec = json.loads(Path(path).read_text())
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    last = steps[-1] if len(steps) == 2 else {}
    if last.get("type") != "ByteLevel" or last.get("add_prefix_space") or last.get("use_regex") or spec["model"].get("type") != "BPE" or spec["model"].get("dropout") or any(not a["content"].startswith("<|") for a in spec["added_tokens"]):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip([b for b in range(256) if b not in plain], range(256, 512)))
    model = tok.model

    def run(words: list[str]) -> dict[str, bytes]:
        rows = [[t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(letters))] for w in words]
        flat = np.fromiter(itertools.chain.from_iterable(rows), np.uint32).tobytes()
        ends = list(itertools.accumulate((4 * len(r) for r in rows), initial=0))
        return {w: flat[x:y] for w, x, y in zip(words, ends, ends[1:])}

    return run


def chunkable(path: str) -> bool:
    """Whether a tokenizer may encode a text's chunks between white space on their own: it has to lower-case, take white space out
    when it splits, part letters from other characters before it merges, and add nothing around a text."""
    spec = json.loads(Path(path).read_text())
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [s.get("type") for s in norm.get("normalizers", [norm])]
    first = pre.get("pretokenizers", [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    removes = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
    return set(steps) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in steps and removes and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and not spec.get("post_processor")


def _encode_chunks(tok, chunks: list[str]) -> dict[str, bytes]:
    """The ids of each chunk. An added token, on whose two sides the tokenizer works apart, fences chunks off in one text."""
    mark = "<|startoftext|>"
    fence = tok.token_to_id(mark)
    alone = [c for c in chunks if "<|" in c] if fence is not None else chunks
    out = {}
    for a in range(0, len(alone), 2000):
        out |= {c: np.array(e.ids, np.uint32).tobytes() for c, e in zip(alone[a : a + 2000], tok.encode_batch_fast(alone[a : a + 2000], add_special_tokens=False), strict=True)}
    joined = [c for c in chunks if c not in out]
    for a in range(0, len(joined), 2000):
        some = joined[a : a + 2000]
        ids = np.array(tok.encode_batch_fast([mark.join(some)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.append(np.flatnonzero(ids == fence), len(ids)).tolist()
        out |= {c: ids[x:y].tobytes() for c, x, y in zip(some, [0, *(k + 1 for k in stops[:-1])], stops, strict=True)}
    return out


def _letters(s: str) -> bool:
    """Whether ``s`` is letters that stay letters, one for one, when the tokenizer normalises and lower-cases them."""
    return s.isalpha() and (s.isascii() or max(s) < "\u0180" and "\u0130" not in s)


def _by_chunk(tok, words: Callable | None, known: dict[str, bytes], texts: list[str]) -> list[bytes]:
    """The ids of texts that are cut at spaces and line feeds; each distinct chunk of the texts is encoded once.

    ASCII texts are lower-cased first, as the tokenizer does. Marks at the end of a chunk, after a letter, are one piece of
    their own to the tokenizer and are cut off; words are encoded in lower case, so that a word's ids are worked out once
    whatever marks follow it.
    """
    cut = [(t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ").split(" ") for t in texts]
    made, plain, other = {}, set(), set()
    for c in set().union(*cut).difference(known):
        w = c if "<|" in c else c.rstrip(MARKS)
        if len(w) == len(c) or not _letters(w[-1:]):
            w = c
        else:
            other.add(c[len(w) :])
        low = w.lower() if _letters(w) else w
        (plain if low is not w or _letters(w) else other).add(low)
        if low != c:
            made[c] = low, c[len(w) :]
    new = [c for c in plain if c not in known]
    known.update(words(new) if words else _encode_chunks(tok, new))
    known.update(_encode_chunks(tok, [c for c in other if c not in known]))
    known.update([(c, known[w] + known[marks] if marks else known[w]) for c, (w, marks) in made.items()])
    ids = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
    while len(known) > KEPT_CHUNKS:
        known.popitem()  # the newest
    return ids


def encode_texts(texts: list[str | None], path: str, by_chunk: bool) -> list[bytes]:
    """The ids of whole texts as little-endian 32-bit integers. ``by_chunk`` is right for tokenizers that lower-case, drop
    white space and part letters from other characters before they merge: then nothing reaches across those places."""
    tok, words, known = _encoder(path)
    texts = [t or "" for t in texts]
    if by_chunk:
        return _by_chunk(tok, words, known, texts)
    return [np.array(e.ids, np.uint32).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, by_chunk: bool) -> Iterator[pa.RecordBatch]:
    tail = np.array([end], np.uint32).tobytes()
    for batch in batches:
        texts = batch.column("_text")
        size = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + PIECE, "right")))
            ids = encode_texts(texts.slice(a, b - a).to_pylist(), path, by_chunk)
            n = np.array([len(i) // 4 + 1 for i in ids], np.int64)
            flat = np.frombuffer(tail.join([*ids, b""]), np.int32)
            off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_id").slice(a, b - a), pa.array(n), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["_id", "n_tokens", "ids"])
            a = b


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end: int = 2, by_chunk: bool | None = None, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000, id_col: str = "doc_id") -> None:
    """Writes (``id_col``, n_tokens, ids, part) as Parquet under ``out``, ids list<int32>, files and rows in ascending id order.

    Texts, not ids, are shuffled, by ranges of the id; each range becomes a file. ``encoding``: "dictionary", or
    "delta" (DELTA_BINARY_PACKED, Parquet's second data page version). Row groups take ``row_group_bytes``, pages
    ``page_bytes`` and ``page_rows`` at most; page indexes are written, so that a read of some ids or of the
    metadata columns alone opens those pages only.

    ``by_chunk``: encode the distinct chunks between white space once each; unset, where :func:`chunkable` says that this
    gives the ids of whole texts.

    Null texts are written as empty (the end id alone). Texts of any length are encoded whole. Repeated ids stay, next to
    each other, in one file. A null id comes first. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    by_chunk = chunkable(tokenizer) if by_chunk is None else by_chunk
    slim = docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text"))
    ordered = slim.repartitionByRange("_id").sortWithinPartitions("_id")
    kind = slim.schema["_id"].dataType.simpleString()
    rows = ordered.mapInArrow(lambda batches: _encode(batches, tokenizer, end, by_chunk), f"_id {kind}, n_tokens long, ids array<int>")
    writer = rows.select(F.col("_id").alias(id_col), F.spark_partition_id().alias("part"), "n_tokens", "ids").write
    writer.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows).option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).option("parquet.writer.version", "v2" if encoding == "delta" else "v1").parquet(out)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", first: int | None = None, last: int | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """(``id_col``, part, n_tokens, ids) of the files, or some ``columns``, of documents from ``first`` to ``last`` (ids, both included).

    Only the chosen columns' pages are opened; because rows are in the order of ids, the bounds leave row groups shut by their
    statistics and pages by the page index. Rows with a null id belong to no range.
    """
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col(id_col) >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col(id_col) <= F.lit(last))
    return rows.select(*columns) if columns else rows


def read_span(spark: SparkSession, path: str, start: int, stop: int, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, at, ids): the tokens from position ``start`` to before ``stop`` of all files' tokens in order, a row for each document that
    has some of them; ``at`` is the position of the first.

    Positions come from the metadata columns alone; ids are read of the documents between the first and the last that have a part of the span.
    """
    meta = read_tokens(spark, path, id_col, columns=(id_col, "part", "n_tokens"))
    where = token_starts(meta, meta, id_col).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start)).select(id_col, "part", "n_tokens", "start")
    ends = where.agg(F.min(id_col), F.max(id_col)).first()
    rows = read_tokens(spark, path, id_col, *ends) if ends[0] is not None else read_tokens(spark, path, id_col).limit(0)
    j = rows.join(where.drop("n_tokens"), [id_col, "part"])
    lo = F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int")
    hi = F.least(F.lit(stop) - F.col("start"), F.col("n_tokens")).cast("int")
    return j.select(id_col, (F.col("start") + lo).alias("at"), F.slice("ids", lo + 1, hi - lo).alias("ids"))


def token_starts(rows: DataFrame, meta: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds start, the ids before each document over all files, to ``rows`` (``id_col``, part, n_tokens, ...).

    A running sum inside each file, plus the sums of the files before it (one row per file, from the metadata columns
    of ``meta``). Rows of one id are taken by their lengths.
    """
    files = meta.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = files.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(F.col(id_col).asc_nulls_first(), "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_i", F.coalesce(inside, F.lit(0))).join(before, "part").withColumn("start", F.col("_o") + F.col("_i")).drop("_i", "_o")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        off, flat = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=[*batch.schema.names[:3], "ids_crc32"])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{shared_dir(spark)}/aislewatch/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    tokens = read_tokens(spark, out)
    crc = tokens.select("doc_id", "part", "n_tokens", "ids").mapInArrow(_digest, "doc_id long, part int, n_tokens long, ids_crc32 long")
    return token_starts(crc, tokens.select("part", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")
