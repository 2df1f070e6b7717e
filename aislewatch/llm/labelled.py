"""Bounded, deterministic samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def class_sample(rows: DataFrame, id_col: str, label: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most of each class of ``label`` (non-null), by a hash of the id. Classes are few."""
    per = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*")).collect()}
    keep = F.lit(False)
    for value, n in sorted(per.items(), key=lambda x: str(x[0])):
        keep |= (F.col(label) == F.lit(value)) & (F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(max(1, -(-n // bound)))) == 0)
    return rows.where(keep)


def known_labels(labels: DataFrame, label: str, held_mod: int = 5, held: int = 0) -> DataFrame:
    """doc_id, label outside the held-out part; a document's largest label counts."""
    return labels.where(remainder("doc_id", held_mod) != held).groupBy("doc_id").agg(F.max(label).alias("label")).where("label is not null")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, held_mod: int = 5, held: int = 0) -> DataFrame:
    """doc_id, text, label of a bounded sample of the labelled rows outside the held-out part; a document's largest label counts."""
    known = known_labels(labels, label, held_mod, held)
    return docs.select("doc_id", "text").join(F.broadcast(class_sample(known, "doc_id", "label", bound)), "doc_id")
