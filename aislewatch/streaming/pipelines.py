"""Streaming twins: deduplication, sequences, occupancy windows, alerts with verdicts, alert sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aislewatch.functions.geometry import point_in_polygon


def without_duplicates(frames: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The first row of each (camera_id, seq) that comes within the watermark."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["camera_id", "seq"])


def occupancy_windows(obs: DataFrame, zones: DataFrame, width: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    """Per camera, zone and window: rows inside and (approximately) distinct tracks. Zones are a static, small table."""
    j = obs.join(F.broadcast(zones.select("camera_id", "zone", "polygon")), "camera_id").where(point_in_polygon(F.col("x_m"), F.col("z_m"), F.col("polygon")))
    g = j.withWatermark("ts", delay).groupBy(F.window("ts", width), "camera_id", "zone")
    return g.agg(F.count("*").alias("inside"), F.approx_count_distinct("track_id").alias("tracks")).select("camera_id", "zone", F.col("window.start").alias("start"), "inside", "tracks")


def stalls(frames: DataFrame, gap: str = "6 seconds", delay: str = "10 seconds") -> DataFrame:
    """Stretches of delivery per camera: a gap without frames ends one."""
    f = frames.withWatermark("ts", delay)
    return f.groupBy(F.session_window("ts", gap), "camera_id").agg(F.count("*").alias("frames")).select("camera_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "frames")


def sequences(frames: DataFrame) -> DataFrame:
    """(camera_id, pts, seq): numbers that rise over reconnects; a frame not newer than the last one is left out."""

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, last = state.get if state.exists else (0, -1.0)
        out = []
        for pts in sorted(p for b in batches for p in b["pts"]):
            if pts > last:
                seq, last = seq + 1, pts
                out.append((key[0], pts, seq))
        state.update((seq, last))
        yield pd.DataFrame(out, columns=["camera_id", "pts", "seq"])

    return frames.groupBy("camera_id").applyInPandasWithState(number, "camera_id long, pts double, seq long", "seq long, last double", "append", GroupStateTimeout.NoTimeout)


def with_verdicts(alerts: DataFrame, verdicts: DataFrame, within: str = "1 day", delay: str = "10 minutes", verdict_delay: str = "10 minutes") -> DataFrame:
    """A stream of alerts (alert_id, at, ...) with each verdict (alert_id, decided_at, status) of a second stream that came ``within`` it.

    Both streams have a watermark of their own: an alert waits until its time for verdicts is over, and is given out without
    one (status "unreviewed") if there was none; then its state goes, as do verdicts that no later alert can claim.
    """
    a = alerts.withWatermark("at", delay)
    v = verdicts.select(F.col("alert_id").alias("_alert_id"), "decided_at", "status").withWatermark("decided_at", verdict_delay)
    ok = (F.col("alert_id") == F.col("_alert_id")) & (F.col("decided_at") >= F.col("at")) & (F.col("decided_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    return a.join(v, ok, "leftOuter").drop("_alert_id").withColumn("status", F.coalesce("status", F.lit("unreviewed")))


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts a query, which ends with the input if ``once``, that appends alerts under their UTC date.

    Each batch's files stand under its number, and when they are complete a row in the ledger says how many alerts it has. A batch
    that the ledger has is not written again; one that was cut short replaces its own files. :func:`read_alerts` reads what the ledger has.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger/batch={number}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return
        rows = f"{path}/alerts/batch={number}"
        batch.withColumn("utc_date", F.to_date("at")).write.mode("overwrite").partitionBy("utc_date").parquet(rows)
        written = spark.read.schema(batch.schema).parquet(rows)
        written.agg(F.count("*").alias("alerts")).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    w = alerts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_alerts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The alerts (``schema``) with utc_date and batch, of the batches that the ledger has."""
    ledger = spark.read.option("basePath", f"{path}/ledger").schema("alerts long, batch long").parquet(f"{path}/ledger").select("batch")
    return spark.read.option("basePath", f"{path}/alerts").schema(schema + ", batch long, utc_date date").parquet(f"{path}/alerts").join(ledger, "batch", "left_semi")


def with_current_verdict(alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A stream of alerts with the static table's current verdict."""
    return alerts.join(verdicts.select("alert_id", "status"), "alert_id", "left").withColumn("status", F.coalesce("status", F.lit("unreviewed")))
