"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislewatch.llm.common import as_written, cut, number_rows, staged, table

WORD = r"[^\x20\x09-\x0D]+"


def _keys(source: Column) -> list[Column]:
    """A source as two columns without nulls: is it null, and its name."""
    return [source.isNull().alias("_nil"), F.coalesce(source, F.lit("")).alias("_src")]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(_nil, _src, source_size, target) of each source of ``sizes`` (_nil, _src, size).

    Sources in code point order, null last, take the weights in turn. The whole is ``share`` times all sizes. A target
    stops at ``limit`` times its source's size and what is over goes to the others by weight until none is above:
    with the sources ordered by size / weight, those below the water line stop and the rest share by weight.
    The windows run over one row per source.
    """
    per = sizes.groupBy("_nil", "_src").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy("_nil", "_src")) - 1, F.lit(len(weights))) + 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int"))).withColumn("cap", limit * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), "_nil", "_src")
    every = Window.partitionBy()
    line = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("line", line)
    # the first source whose share stays within its limit sets the line for all after it
    level = F.min(F.when(F.col("line") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), "line"))).over(every)["line"]
    return per.select("_nil", "_src", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _spread(rows: int) -> int:
    """Hash buckets in which rows of one key are numbered: about a million rows each."""
    return max(1024, rows // 1_000_000)


def _plan(targets: DataFrame, block: int) -> DataFrame:
    """Adds to ``targets``: n (blocks of the source), full (whole epochs), rest (words of the epoch after them), draws."""
    t = targets.where("source_size > 0").withColumn("words", F.floor(F.col("target") + 1e-6)).withColumn("n", F.ceil(F.col("source_size") / block)).withColumn("full", F.floor(F.col("words") / F.col("source_size"))).withColumn("rest", F.col("words") - F.col("full") * F.col("source_size"))
    return t.withColumn("draws", (F.col("full") * F.col("n") + F.ceil(F.col("rest") / block)).cast("long"))


def permutations(plan: DataFrame, block: int, rows: int, seed: int = 17) -> DataFrame:
    """(_nil, _src, rank, block): a pseudorandom permutation of each source's block indexes, as the rank of each in the
    order of a seeded hash. A short last block always has the last rank."""
    index = plan.withColumn("hi", F.explode(F.expr("sequence(0L, CAST((n - 1) DIV 1024 AS BIGINT))"))).repartition("_nil", "_src", "hi").withColumn("block", F.explode(F.expr("sequence(hi * 1024, least(n, hi * 1024 + 1024) - 1)")))
    cols = ["_nil", "_src", "n", "block"]
    ranked = staged(index.select(*cols, F.xxhash64("_nil", "_src", "block", F.lit(seed)).alias("_h")), "blocks")
    body = number_rows(ranked.where("block < n - 1"), ["_nil", "_src"], ["_h", "block"], "rank", spread=_spread(rows))
    ends = ranked.where("block = n - 1").withColumn("rank", F.col("n") - 1)
    return body.select("_nil", "_src", "rank", "block").unionByName(ends.select("_nil", "_src", "rank", "block"))


def draw_slots(plan: DataFrame, shard_slots: int = 4096, seed: int = 18) -> DataFrame:
    """The slots of the mix: _nil, _src, draw, shard, slot. A source's draws are 0, 1, 2, ... without gaps.

    Each slot of each output shard draws a source by the sources' numbers of draws, from a hash of (seed, shard, slot), so that
    the counts of a shard are a multinomial draw. What a source got beyond its draws goes to sources that got too few,
    so that totals hold to the slot; that is about the root of the number of slots.
    """
    spark = plan.sparkSession
    by = Window.orderBy("_nil", "_src")  # one row per source
    bounds = cut(plan.select("_nil", "_src", "draws", F.coalesce(F.sum("draws").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lo")).withColumn("hi", F.col("lo") + F.col("draws")).where("draws > 0"))
    total = bounds.agg(F.max("hi")).first()[0] or 0
    cell = max(1, -(-total // 1024))
    shards = spark.range(-(-total // shard_slots)).withColumnRenamed("id", "shard").repartition(F.col("shard"))
    slots = shards.withColumn("slot", F.explode(F.expr(f"sequence(0L, least({shard_slots}, {total} - shard * {shard_slots}) - 1)")))
    slots = slots.withColumn("x", F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(max(1, total)))).withColumn("cell", F.expr(f"x DIV {cell}"))
    cells = bounds.withColumn("cell", F.explode(F.expr(f"sequence(lo DIV {cell}, (hi - 1) DIV {cell})")))
    # Spark takes what is exploded from a few rows for small and would broadcast it; written tables have their true sizes
    met = slots.join(F.broadcast(cells) if bounds.count() < 10_000 else cells.hint("merge"), "cell")
    drawn = staged(met.where("x >= lo AND x < hi").select("_nil", "_src", "draws", "shard", "slot", F.xxhash64(F.lit(seed + 1), "shard", "slot").alias("_h")), "drawn")
    counted = staged(number_rows(drawn, ["_nil", "_src"], ["_h", "shard", "slot"], "draw", spread=_spread(total)).drop("_h"), "draws")
    over = number_rows(counted.where("draw >= draws").select("shard", "slot"), [], ["shard", "slot"], "k")
    got = counted.groupBy("_nil", "_src").agg(F.count("*").alias("got"))
    short = bounds.join(got, ["_nil", "_src"], "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < draws")
    short = short.withColumn("_o", F.coalesce(F.sum(F.col("draws") - F.col("got")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    missing = short.withColumn("draw", F.explode(F.expr("sequence(got, draws - 1)"))).withColumn("k", F.col("_o") + F.col("draw") - F.col("got"))
    cols = ["_nil", "_src", "draw", "shard", "slot"]
    return counted.where("draw < draws").select(*cols).unionByName(over.join(missing, "k").select(*cols))


def mix_plan(targets: DataFrame, block: int = 256, shard_slots: int = 4096) -> DataFrame:
    """The mix: _nil, _src, epoch, block, take (words of the block, from its first on), shard, slot.

    A source of n words is ceil(n / block) blocks. Draw d of a source is rank d mod blocks of epoch d div blocks; the
    source's permutation maps the rank to a block. Whole epochs take every block; the epoch that is left over takes
    the first ranks, the last one in part, so that a source's words are the whole part of its target.
    """
    plan = cut(_plan(targets, block))
    rows = plan.agg(F.sum("n")).first()[0] or 0
    order = permutations(plan, block, rows)
    slots = draw_slots(plan, shard_slots).join(F.broadcast(plan) if plan.count() < 10_000 else plan, ["_nil", "_src"])
    slots = slots.withColumn("epoch", F.expr("draw DIV n")).withColumn("rank", F.expr("draw % n")).select("_nil", "_src", "source_size", "full", "rest", "epoch", "rank", "shard", "slot")
    met = slots.join(order, ["_nil", "_src", "rank"])
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    take = F.when(F.col("epoch") < F.col("full"), length).otherwise(F.least(length, F.col("rest") - F.col("rank") * block))
    return met.select("_nil", "_src", "epoch", "block", take.cast("long").alias("take"), "shard", "slot")


def _mixed(docs: DataFrame, seq: Column, block: int, weights: tuple[float, ...], share: float, limit: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized documents, targets, and for each document and epoch the words [lo, hi) that each of its blocks' slots take.

    Sized documents have _id, _nil, _src, size, _th, _seq: ``seq`` tells the rows of ``docs`` apart.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col("doc_id").alias("_id"), *_keys(F.col("source")), size.alias("size"), F.xxhash64("text").alias("_th"), seq.alias("_seq")))
    targets = cut(source_targets(sized, weights, share, limit))
    # where a document's words begin in its source: documents are packed in the order of their numbers, which don't leave gaps
    b = sized.withColumn("_b", F.pmod(F.xxhash64("_id", "_th"), F.lit(_spread(sized.count()))).cast("int"))
    before = Window.partitionBy("_nil", "_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy("_nil", "_src", "_b").agg(F.sum("size").alias("_n")).select("_nil", "_src", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.sum("size").over(Window.partitionBy("_nil", "_src", "_b").orderBy("_id", "_th", "size", "_seq").rowsBetween(Window.unboundedPreceding, -1))
    at = b.select("_seq", "_id", "_th", "_nil", "_src", "size", "_b").withColumn("_i", F.coalesce(inside, F.lit(0))).join(offsets, ["_nil", "_src", "_b"]).where("size > 0").select("_seq", "_nil", "_src", "size", (F.col("_o") + F.col("_i")).alias("_at"))
    pieces = at.withColumn("block", F.explode(F.expr(f"sequence(_at DIV {block}, (_at + size - 1) DIV {block})")))
    slots = mix_plan(targets, block)
    start = F.col("block") * block
    taken = pieces.join(slots, ["_nil", "_src", "block"]).select("_seq", "size", "epoch", F.greatest(F.lit(0), start - F.col("_at")).alias("lo"), F.least("size", start + F.col("take") - F.col("_at")).alias("hi"), "shard", "slot").where("hi > lo")
    return sized, targets, taken


def _placed(docs: DataFrame) -> DataFrame:
    """(_row, _seq): all columns of ``docs`` as one, and the file and place in it where the row lies.

    Both are the same each time they are read. A table that lies in its folder as it was written is read from there; only
    other rows are written first.
    """
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row")
    docs, row = (docs, row) if as_written(docs) else (staged(docs.select(row), "rows"), F.col("_row"))
    return docs.select(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("_seq"))


def mix_sources(docs: DataFrame, block: int = 256, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, and where in the mix it is met first:
    first_shard, first_slot (null if not taken).

    A null or empty text has size 0 and is taken 0 times. Null sources are one source, the last. Repeated rows are
    documents of their own; documents that tie in the order of packing are taken in the order of their rows. An empty
    table gives an empty result; texts of any length are packed whole. Columns besides doc_id, text and source are
    ignored, whatever their names. Permutations and draws are seeded hashes of indexes, so reruns over the same rows
    agree on every source's words; which of two equal rows is taken can't be told.
    """
    sized, targets, taken = _mixed(docs, F.monotonically_increasing_id(), block, weights, share, limit)
    words = taken.groupBy("_seq").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min(F.struct("shard", "slot")).alias("first"))
    out = sized.join(words, "_seq", "left").join(targets, ["_nil", "_src"])
    return out.select(F.col("_id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("first.shard").alias("first_shard"), F.col("first.slot").alias("first_slot"))


def mixed_documents(docs: DataFrame, block: int = 256, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The mix as documents: a row of ``docs`` for each epoch that takes words of it, with the columns of ``docs``.

    A text that an epoch takes whole stays as it is; of others the words that the blocks take, in order, with single
    spaces. ``n_chars``, where there is one, is counted anew. Columns of any name are carried along. Defined results as
    in :func:`mix_sources`.
    """
    rows = _placed(docs)
    _, _, taken = _mixed(rows.select("_row.doc_id", "_row.text", "_row.source", "_seq"), F.col("_seq"), block, weights, share, limit)
    parts = taken.groupBy("_seq", "size", "epoch").agg(F.sum(F.col("hi") - F.col("lo")).alias("_k"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_parts"))
    text = F.col("_row").getField("text")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    chosen = F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice(words, p.lo.cast("int") + 1, (p.hi - p.lo).cast("int")))), " ")
    out = rows.join(parts, "_seq").withColumn("_text", F.when(F.col("_k") == F.col("size"), text).otherwise(chosen))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op6_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
