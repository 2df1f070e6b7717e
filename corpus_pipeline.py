"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aislewatch.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from aislewatch.llm.common import remove, scratch, shared_dir, table

#: What stages wrote in between. When a stage's own table has been written and is the next one's docs, nothing reads these any more.
LEFT: list[str] = []


def clears(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stage before left, and leaves the tables that its own lazy result reads to the next one."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reads = "\n".join(docs.inputFiles()) if LEFT else ""
        for path in [p for p in LEFT if p.rsplit("/", 1)[-1] not in reads]:  # a stage that wasn't written still reads its tables
            LEFT.remove(path)
            remove(spark, path)
        with scratch(spark, LEFT):
            return stage(spark, docs, sf_dir)

    return run



@clears
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine doesn't reject. Null and empty texts, and everything where there is nothing to learn
    from, stay; rows that repeat are judged alike; an empty table stays empty."""
    return toxicity.drop_toxic(docs, toxicity.trained(spark, sf_dir))


@clears
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of a Jaccard similarity of 0.8 connect, the one with the smallest doc_id (null ids last; of rows with
    one id, one by its content). Texts without words link with nothing and stay."""
    return jaccard_join.one_of_each(docs)


@clears
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item. Null and empty texts stay; without items all do; rows that repeat stay or go alike; an empty table
    stays empty."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@clears
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch of the mix that takes words of a document; texts without words are taken by none. Null sources are one
    source, the last in order; rows that repeat are documents of their own, ties of their order go by content; an empty table gives an empty mix."""
    return mixing.mixed_documents(docs)


@clears
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards and slots of all rows, equal texts together where shards have room; rows that repeat are rows of their own,
    and an empty table has no shards."""
    return sharding.balanced_shards(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed),
    ("sharding", sharded),
]

#: SQL can't express the classifier, the pseudorandom mix and label propagation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table is deleted when its successor has been written."""
    docs = table(spark, sf_dir, "documents")
    out = f"{shared_dir(spark)}/aislewatch/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        if last:
            remove(spark, last)
        last = f"{out}/{name}"
    while LEFT:
        remove(spark, LEFT.pop())
    return docs
