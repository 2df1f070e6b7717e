"""Pieces that several operators share: staging, gapless numbers, connected components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset and all run on this machine (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="aislewatch-")
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


_SCOPES: list[list[str]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def scratch(spark: SparkSession, left: list[str] | None = None) -> Iterator[None]:
    """Deletes at its end what :func:`staged` and :func:`cut` wrote inside, except what was written to ``keep``: that is left to the scope around it.

    Tables that a lazy result still reads have to be kept. With ``left`` nothing is deleted: the paths are added to it, for :func:`remove` when the
    result has been written.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            if left is None:
                remove(spark, path)
            else:
                left.append(path)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 2 << 20) -> Iterator[None]:
    """What is computed inside goes to and from Python in Arrow batches of about ``size`` bytes, which the JVM and the worker both hold."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: it is computed once, its lineage ends there, and it survives lost executors.

    The files of its shuffles go as soon as it is written (Spark's own clean-up, which is on for this write alone).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/aislewatch/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def as_written(df: DataFrame) -> bool:
    """Whether ``df`` is one Parquet folder and nothing else, so that its rows lie in files and are the same each time they are read.

    Spark compares the plan with that of reading the folder, by each of the names that the folder may have been given.
    """
    folders = {unquote(f).rsplit("/", 1)[0] for f in df.inputFiles()}
    if len(folders) != 1 or "_metadata" in map(str.lower, df.columns):
        return False
    uri = folders.pop()
    path = re.sub(r"^[^/:]+:(//[^/]*)?", "", uri)
    for name in (path, uri, f"file:{path}"):
        with contextlib.suppress(AnalysisException):  # no folder of that name
            if df.sameSemantics(df.sparkSession.read.schema(df.schema).parquet(name)):
                return True
    return False


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """:func:`staged` for narrow tables between the steps of a loop."""
    return staged(df, "cut", keep)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing will read again, wherever it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def content(text: str) -> list[Column]:
    """h1 and h2, which tell texts apart; null is like empty in h2 alone."""
    return [F.xxhash64(text).alias("h1"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("h2")]


def filter_texts(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose texts ``keep`` says True of; in one pass without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str, tie: list[str] | None = None, spread: int = 1024) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps within ``keys`` (non-null columns).

    A key may hold any share of the rows: rows are numbered within ``spread`` hash buckets of each key, and the
    buckets' offsets come from their counts. The order is (bucket of the hash of ``order``, ``order``, ``tie``); ``df`` is read twice, so stage it.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    counts = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")) if keys else counts.select(
        "_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order, *(tie or []))) - 1
    return b.withColumn("_r", inside).join(offsets, [*keys, "_b"]).withColumn(out, F.col("_o") + F.col("_r")).drop("_b", "_o", "_r")


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], how: str = "inner", spread: int = 8) -> DataFrame:
    """``many`` joined with ``few``, which has one row for each key; a key of ``many`` may hold any share of its rows.

    The rows of ``many`` are dealt to ``spread`` salts by a hash of the columns ``by``, and ``few`` comes once for each salt.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(spread)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def hot_join(many: DataFrame, few: DataFrame, keys: list[str], count: str, by: list[str]) -> DataFrame:
    """``many`` with the other columns of ``few``, which has one row for each key (null is a key) and in ``count`` that key's rows in ``many``.

    A key with over a thousandth of all rows is dealt to one salt for each thousandth, by a hash of the columns ``by``; there are fewer
    than 1,000 such keys, whose salts are broadcast. Other keys are joined as they are.
    """
    total = few.agg(F.sum(count)).first()[0] or 0
    share = max(1, total // 1000)
    salts = F.ceil(F.col(count) / F.lit(share)).cast("int")
    hot = few.where(F.col(count) > share).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), salts.alias("_salts"))
    left = many.join(F.broadcast(hot), _same(keys, "_hot_"), "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1))).cast("int"))
    right = few.withColumn("_few_salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumnsRenamed({k: f"_few_{k}" for k in keys}).drop(count)
    return left.join(right, _same(keys, "_few_") & (F.col("_salt") == F.col("_few_salt")), "left").drop("_salts", "_salt", "_few_salt", *(f"_{x}_{k}" for x in ("hot", "few") for k in keys))


def _same(keys: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(prefix + k))
    return same


def _before(a: str, b: str) -> Column:
    """Node ``a`` comes before ``b`` in the order of the nodes' hashes (equal hashes: of the nodes)."""
    x, y = F.xxhash64(a), F.xxhash64(b)
    return (x < y) | (x == y) & (F.col(a) < F.col(b))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is the smallest node that links reach.

    Each round points every node at its first neighbour in the order of hashes, follows the pointers two steps on, and
    contracts the edges. In that order about half of the nodes at least go in a round, however the nodes are numbered:
    a chain of n links takes about log n rounds, a star two. Minima are combined before the shuffle; no node's
    neighbours are gathered.
    """
    spark = edges.sparkSession
    with scratch(spark):
        return _components(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))


def _components(edges: DataFrame) -> DataFrame:
    left = cut(edges.where("a <> b").distinct())
    maps: list[DataFrame] = []
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("p")).select("a", F.when(_before("p", "a"), F.col("p")).otherwise(F.col("a")).alias("p"))
        p = cut(p)
        q = p.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        p = cut(p.join(q, "p").select("a", F.col("pp").alias("p")))
        maps.append(p)
        to = p.select(F.col("a").alias("x"), F.col("p").alias("px"))
        left = left.join(to.withColumnsRenamed({"x": "a", "px": "pa"}), "a").join(to.withColumnsRenamed({"x": "b", "px": "pb"}), "b")
        left = cut(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct())
    if not maps:
        return cut(left.select(F.col("a").alias("node"), F.col("b").alias("component")), keep=True)
    found = maps[-1]
    for p in reversed(maps[:-1]):
        known = found.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        found = p.join(known, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
    found = cut(found)
    smallest = found.groupBy("p").agg(F.min("a").alias("least"))
    return cut(spread_join(found, smallest, ["p"], ["a"]).select(F.col("a").alias("node"), F.least("least", "p").alias("component")), keep=True)
