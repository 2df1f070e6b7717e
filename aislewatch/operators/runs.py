"""Runs: stretches of consecutive rows, or of consecutive frames, that share a flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TRACK = ["camera_id", "track_id"]


def observed_runs(rows: DataFrame, keys: list[str], flag: Column, order: str = "frame_index", out: str = "run") -> DataFrame:
    """The rows where ``flag`` holds, with ``out`` numbering runs in the order of observation: a frame without a row
    does not end a run, a row without the flag does."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn(out, F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w)).where("_f").drop("_f")


def frame_runs(rows: DataFrame, keys: list[str], order: str = "frame_index", out: str = "run") -> DataFrame:
    """Numbers runs of consecutive frames among ``rows`` (one row a key and frame); a frame without a row ends a run."""
    return rows.withColumn(out, F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def run_seconds(fps: float, first: str = "frame_start", last: str = "frame_end") -> Column:
    return (F.col(last) - F.col(first) + 1) / F.lit(float(fps))


def window_median(col: str, frame: WindowSpec) -> Column:
    """The median over a bounded window frame (built-in medians take whole partitions only); null over an empty one."""
    a = F.sort_array(F.collect_list(col).over(frame))
    n = F.size(a)
    return F.when(n > 0, (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor(n / 2).cast("int") + 1)) / 2)
