"""Sums over what comes before a row in one order of all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, keys: list[str], order: list[tuple[str, bool]], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with each of ``sums`` (name: value) added up over the rows of the same ``keys`` before a row and itself, in ``order`` (column, whether it falls).

    A key may hold any share of the rows: rows are dealt to ranges of (keys, order), each task sums its own range, and adds
    what the ranges before it hold of the key, one row for each key and range. The order should be strict; nulls come first. ``checkpoint``
    fixes the ranges.
    """
    by = [F.col(k).asc_nulls_first() for k in keys] + [F.col(c).desc_nulls_last() if falls else F.col(c).asc_nulls_first() for c, falls in order]
    dealt = rows.withColumns({f"_v_{n}": v for n, v in sums.items()}).repartitionByRange(*by).withColumn("_range", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("_range", *keys).orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("_range", *keys).agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums))
    starts = whole.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = dealt.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(starts, same)
    return out.withColumns({n: F.col(f"_w_{n}") + F.col(f"_o_{n}") for n in sums}).select(*rows.columns, *sums)


def nearest_item(asks: DataFrame, holds: DataFrame, *keys: str) -> DataFrame:
    """``asks`` (keys, at and more) with the ``item`` of ``holds`` (keys, at, item) of the same keys whose ``at`` is nearest; ties: the smallest item. Asks without any go.

    The nearest one is the last at or before a place or the first at or after it: two passes over the places in order, each row looked at once.
    """
    where = holds.where("at IS NOT NULL").groupBy(*keys, "at").agg(F.min("item").alias("_item")).select(*keys, "at", F.struct("at", "_item").alias("_h"))
    rest = [c for c in asks.columns if c not in (*keys, "at")]
    both = asks.where("at IS NOT NULL").select("*", F.lit(None).cast(where.schema["_h"].dataType).alias("_h"), F.lit(True).alias("_asks")).unionByName(where.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    upto = lambda order: F.last("_h", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order, "_asks").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_a", upto(F.col("at"))).withColumn("_b", upto(F.col("at").desc())).where("_asks AND (_a IS NOT NULL OR _b IS NOT NULL)")
    near = F.filter(F.array("_a", "_b"), lambda h: h.isNotNull())
    best = F.array_min(F.transform(near, lambda h: F.struct(F.abs(h["at"] - F.col("at")).alias("gap"), h["_item"].alias("item"))))
    return found.select(*keys, "at", *rest, best["item"].alias("item"))


def rank_auc(rows: DataFrame, *keys: str, label: str = "label", score: str = "score") -> DataFrame:
    """(keys, positives, negatives, auroc): the share of pairs of a positive (label 1) and a negative (0) in which the positive has the higher score, ties counting half; null without both.

    Rows are counted for each distinct score first, so that ties of any size are one row; the negatives before each score come
    from :func:`running`.
    """
    n = lambda v: F.sum((F.col(label) == v).cast("long"))
    per = rows.groupBy(*keys, score).agg(n(1).alias("_p"), n(0).alias("_q"))
    r = running(per, list(keys), [(score, False)], {"_upto": F.col("_q")})
    total = r.groupBy(*keys).agg(F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"), F.sum(F.col("_p") * (F.col("_upto") - F.col("_q") / 2)).alias("_won"))
    return total.select(*keys, "positives", "negatives", F.try_divide(F.col("_won"), F.col("positives") * F.col("negatives")).alias("auroc"))
