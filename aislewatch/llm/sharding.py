"""Sharding by balanced label propagation (law ``rows``: shard counts are at most one apart)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewatch.llm.common import cut, number_rows, spread_join, table

FINE = 256


def _propagate(linked: DataFrame, n_shards: int, capacity: int) -> DataFrame:
    """(_seq, shard) of the linked documents that found a place.

    ``linked`` has _seq, _g (group) and shard (first label). In a round each group prefers, among the shards that are
    open, the one that most of its members carry (ties: the smallest). Members that carry it settle, the others ask to
    move there. A shard takes requests, largest groups first, up to the capacity that settled documents leave; whole
    groups go by a hash of the group, groups of over 1/64 of the capacity member by member. A shard that turned
    requests away is closed, and a round that closes none settles all that asked, so the rounds are n_shards + 2 at most;
    those that find every shard closed have no place as a group. What the driver sees of a round is a histogram of
    bounded size: shards x size classes x ``FINE`` hash steps. A group's rows are never gathered: counts are summed
    before the shuffle, and its preference is joined to its rows over several salts.
    """
    state = cut(linked.select("_seq", "_g", "shard", F.lit(False).alias("settled")))
    quota = dict.fromkeys(range(n_shards), capacity)
    while True:
        open_ = [s for s, q in quota.items() if q > 0]
        if not open_:
            break
        hist = state.groupBy("_g", "shard", "settled").agg(F.count("*").alias("n"))
        pref = hist.groupBy("_g").agg(
            F.max_by("shard", F.struct("n", -F.col("shard"))).alias("any"),
            F.max(F.when(F.col("shard").isin(open_), F.struct("n", (-F.col("shard")).alias("to")))).alias("best"),
            F.sum(F.when(~F.col("settled"), F.col("n")).otherwise(0)).alias("left"),
        ).where("left > 0")
        spill = F.element_at(F.array(*map(F.lit, open_)), (F.pmod(F.xxhash64("_g"), F.lit(len(open_))) + 1).cast("int"))
        pref = pref.select("_g", "left", F.coalesce(-F.col("best.to"), spill).cast("int").alias("to"))
        pref = pref.select("_g", "to", F.when(F.col("left") > max(1, capacity // 64), 99).otherwise(F.floor(F.log2("left"))).cast("int").alias("cls"))
        ask = spread_join(state, pref, ["_g"], ["_seq"], "left")
        step = F.pmod(F.when(F.col("cls") == 99, F.xxhash64("_seq", F.lit(7))).otherwise(F.xxhash64("_g", F.lit(7))), F.lit(FINE)).cast("int")
        ask = cut(ask.select("_seq", "_g", "shard", "settled", "to", "cls", F.when(~F.col("settled") & F.col("to").isNotNull(), step).alias("step")))
        demand = ask.where("step is not null").groupBy("to", "cls", "step").agg(F.count("*").alias("n")).collect()
        if not demand:
            break
        limits: list[tuple[int, int, int]] = []  # of each shard: the first (class, step) that is turned away
        for s in open_:
            room, stop = quota[s], None
            for _to, cls, fine, n in sorted((r for r in demand if r.to == s), key=lambda r: (-r.cls, r.step)):
                if n > room:
                    stop = (cls, fine)
                    break
                room -= n
            if stop:
                limits.append((s, *stop))
            quota[s] = 0 if stop else room
        refused = F.lit(False)
        for s, cls, fine in limits:
            refused |= (F.col("to") == s) & ((F.col("cls") < cls) | (F.col("cls") == cls) & (F.col("step") >= fine))
        moved = F.col("step").isNotNull() & ~refused
        state = cut(ask.select("_seq", "_g", F.when(moved, F.col("to")).otherwise(F.col("shard")).cast("int").alias("shard"), (F.col("settled") | moved).alias("settled")))
    return state.where("settled").select("_seq", "shard")


def balanced_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards for all rows of ``docs``: ``id_col``, size, text_crc32, law, shard, slot, grown_shard.

    Documents with equal texts are linked. Linked documents move towards the shard of most of their group in rounds
    of joins under capacity quotas; all others fill the shards up to the exact quotas, so that counts are at most one
    apart whatever the groups' sizes. A group larger than a shard is cut over as few shards as there is room in.
    ``slot`` numbers a shard's rows without gaps. ``grown_shard`` is null: the law ``rows`` places by counts.

    Null texts: size 1, crc 0, linked with empty ones. Texts of any length are hashed whole. Repeated rows are rows of
    their own, and which of them has which slot can't be told; other ties go by content. A null id is an id like
    others. An empty table gives an empty result. Extra columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_g"))
    # rows that are equal in all columns may be exchanged; the number makes them distinct for the joins below
    slim = cut(slim.withColumn("_seq", F.monotonically_increasing_id()))
    total = slim.count()
    cuts = total // n_shards
    groups = slim.groupBy("_g", "size", "text_crc32").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    linked = spread_join(slim, groups, ["_g", "size", "text_crc32"], ["_seq"], "left_semi").select("_seq", F.xxhash64("_g", "size", "text_crc32").alias("_g"), F.pmod(F.xxhash64("_id"), F.lit(n_shards)).cast("int").alias("shard"))
    placed = cut(_propagate(linked, n_shards, cuts))
    taken = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    all_ = cut(slim.drop("_g").join(placed, "_seq", "left"))
    free = number_rows(all_.where("shard is null").drop("shard"), [], ["_id", "size", "text_crc32"], "_k", ["_seq"])
    upto, bounds = 0, []
    for s in range(n_shards):
        upto += cuts + (s < total % n_shards) - taken.get(s, 0)
        bounds.append(upto)
    fill = F.lit(n_shards - 1)
    for s in reversed(range(n_shards - 1)):
        fill = F.when(F.col("_k") < bounds[s], s).otherwise(fill)
    whole = cut(all_.where("shard is not null").unionByName(free.select("_id", "size", "text_crc32", "_seq", fill.cast("int").alias("shard"))))
    return number_rows(whole, ["shard"], ["_id", "size", "text_crc32"], "slot", ["_seq"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(shards: DataFrame) -> DataFrame:
    """One row on the result of :func:`balanced_shards`: groups (of equal texts), torn (those in several shards) and cut
    (their documents outside the shard that holds most of the group: links that are cut of a star over the group)."""
    per = shards.groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("n")).groupBy("text_crc32", "size").agg(F.sum("n").alias("all"), F.max("n").alias("most")).where("all > 1")
    return per.agg(F.count("*").alias("groups"), F.coalesce(F.sum((F.col("most") < F.col("all")).cast("long")), F.lit(0)).alias("torn"), F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("cut"))


def op9_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))
