"""Label maps over time, dataset audits, selection, attributes, alerts and fleet reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- label cells over time: camera_id, frame_index, cell_y, cell_x, class_id

CELL = ["camera_id", "cell_y", "cell_x"]


def consensus(cells: DataFrame, stable: float = 0.8, drop_class: int | None = None) -> DataFrame:
    """Per cell its most usual class (ties: the lowest), its share of the frames, and whether that is stable; cells that ever had ``drop_class`` are left out."""
    if drop_class is not None:
        cells = cells.join(cells.where(F.col("class_id") == drop_class).select(*CELL).distinct(), CELL, "left_anti")
    n = cells.groupBy(*CELL, "class_id").agg(F.count("*").alias("n"))
    out = n.groupBy(*CELL).agg(F.max(F.struct("n", (-F.col("class_id")).alias("c"))).alias("m"), F.sum("n").alias("frames"))
    return out.select(*CELL, (-F.col("m.c")).alias("class_id"), (F.col("m.n") / F.col("frames")).alias("agreement"), "frames", (F.col("m.n") / F.col("frames") >= stable).alias("stable"))


def consensus_fleet(cons: DataFrame, least_frames: int = 2) -> DataFrame:
    """Per camera the stable share of its measurable cells; null where none is measurable."""
    ok = F.col("frames") >= least_frames
    return cons.groupBy("camera_id").agg(F.count(F.when(ok, 1)).alias("cells"), F.avg(F.when(ok, F.col("stable").cast("double"))).alias("stable_share"))


def label_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(camera_id, old_class, new_class, n): how the class of each cell and frame differs between two label sets."""
    key = [*CELL, "frame_index"]
    j = old.withColumnRenamed("class_id", "old_class").join(new.withColumnRenamed("class_id", "new_class"), key, "full")
    return j.groupBy("camera_id", "old_class", "new_class").agg(F.count("*").alias("n"))


def top_moves(moves: DataFrame, n: int = 10) -> DataFrame:
    return moves.where("old_class <> new_class").orderBy(F.desc("n"), "camera_id", "old_class", "new_class").limit(n)


def covered_share(boxes: DataFrame, runs: DataFrame, class_id: int, band: int = 64) -> DataFrame:
    """Boxes (det_id, camera_id, frame_index, x0..y1 in pixels) with the share of their area that runs of ``class_id`` cover.

    Runs meet the boxes of their frame by bands of ``band`` rows, so that a frame's runs don't meet all its boxes.
    """
    b = boxes.withColumn("_k", F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))))
    r = runs.where(F.col("class_id") == class_id).withColumn("_k", F.floor(F.col("y") / band))
    j = b.join(r, ["camera_id", "frame_index", "_k"]).where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    part = j.groupBy("det_id", "camera_id", "frame_index").agg(F.sum(F.greatest(F.least("x1", "x_end") - F.greatest("x0", "x_start"), F.lit(0))).alias("_c"))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-9))
    return boxes.join(part, ["det_id", "camera_id", "frame_index"], "left").withColumn("covered", F.coalesce("_c", F.lit(0)) / area).drop("_c")


# ---- data sets: splits, leaks, coverage


def split_leak(rows: DataFrame, keep: str = "train") -> DataFrame:
    """Cameras (columns camera, split) that are in ``keep`` and in another split too."""
    s = rows.select("camera", "split").distinct()
    bad = s.groupBy("camera").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return bad.where(F.array_contains("splits", keep) & (F.size("splits") > 1))


def shared_cameras(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col("split") == a).select("camera").intersect(rows.where(F.col("split") == b).select("camera"))


def split_audit(rows: DataFrame, rare: int = 2) -> DataFrame:
    """Findings, one a row: leaks, splits that miss cameras, splits whose one camera holds over half of the clips."""
    leak = split_leak(rows).select(F.lit("leak").alias("rule"), F.col("camera").cast("string").alias("subject"), F.array_join("splits", ",").alias("detail"))
    every = rows.agg(F.countDistinct("camera").alias("_all"))
    per = rows.groupBy("split").agg(F.countDistinct("camera").alias("c"))
    few = per.where(F.col("c") < rare).select(F.lit("few_cameras").alias("rule"), F.col("split").alias("subject"), F.col("c").cast("string").alias("detail"))
    part = rows.groupBy("split", "camera").agg(F.count("*").alias("n")).withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("split")))
    rich = part.where("s > 0.5").select(F.lit("one_camera").alias("rule"), F.col("split").alias("subject"), F.col("camera").cast("string").alias("detail"))
    total = every.select(F.lit("cameras").alias("rule"), F.lit("all").alias("subject"), F.col("_all").cast("string").alias("detail"))
    return leak.unionByName(few).unionByName(rich).unionByName(total)


def unpaired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has."""
    x = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left"))
    return x.unionByName(b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right")))


def assign_split(clips: DataFrame, cameras: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assigned, unknown, excluded): clips with their camera's split; clips of unknown cameras; clips of excluded ones."""
    out = clips.join(excluded.select("camera"), "camera", "left_anti")
    return out.join(cameras, "camera"), out.join(cameras.select("camera"), "camera", "left_anti"), clips.join(excluded.select("camera"), "camera", "left_semi")


def class_pixels(rows: DataFrame) -> DataFrame:
    """Sums per split and camera, per split and in all (columns split, camera, n, class)."""
    return rows.rollup("split", "camera").agg(F.sum("n").alias("n"), F.countDistinct("class").alias("classes"), F.grouping_id().alias("level"))


def coverage(rows: DataFrame, splits: list[str]) -> DataFrame:
    """Share of labelled pixels by class, a column a split."""
    total = F.sum("n").over(Window.partitionBy("split"))
    return rows.groupBy("class", "split").agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / total).groupBy("class").pivot("split", splits).agg(F.first("share"))


def dataset_audit(images: DataFrame, taxonomy: DataFrame, labelled: float = 0.05, single: float = 0.97) -> DataFrame:
    """(image, problem): classes outside the taxonomy, hardly any labels, one class almost alone; ``images`` has image, class, n (255: no label)."""
    alien = images.where("class <> 255").join(taxonomy, "class", "left_anti").select("image", F.lit("outside_taxonomy").alias("problem")).distinct()
    per = images.groupBy("image").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("class") != 255, F.col("n")).otherwise(0)).alias("l"), F.max(F.when(F.col("class") != 255, F.col("n"))).alias("m"))
    bare = per.where(F.col("l") < labelled * F.col("t")).select("image", F.lit("hardly_labelled").alias("problem"))
    one = per.where((F.col("l") > 0) & (F.col("m") > single * F.col("l"))).select("image", F.lit("one_class").alias("problem"))
    return alien.unionByName(bare).unionByName(one)


def duplicates(files: DataFrame, digest: str = "digest") -> DataFrame:
    """Digests that several files share, with their number and first file."""
    return files.groupBy(digest).agg(F.count("*").alias("n"), F.min("file").alias("first")).where("n > 1")


def fingerprint(files: DataFrame, *keys: str) -> DataFrame:
    """Files, bytes and a digest of each split: names are dealt to 4,096 parts by their SHA-256, and the digest is that of the parts'
    digests of their sorted (name, size) lists, so that no split's list is gathered whole."""
    line = F.concat_ws(":", "name", F.col("size").cast("string"))
    rows = files.withColumn("_p", F.conv(F.substring(F.sha2("name", 256), 1, 3), 16, 10).cast("long"))
    parts = rows.groupBy(*keys, "_p").agg(F.count("*").alias("_n"), F.sum("size").alias("_s"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("_d"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("_p", "_d"))), lambda x: F.concat_ws(":", x["_p"].cast("string"), x["_d"]))
    return parts.groupBy(*keys).agg(F.sum("_n").alias("files"), F.sum("_s").alias("bytes"), F.sha2(F.array_join(each, "\n"), 256).alias("digest"))


def hash_split(name: Column, test_share: float) -> Column:
    """train or test by the first eight hex digits of the name's SHA-1."""
    return F.when(F.conv(F.substring(F.sha1(name), 1, 8), 16, 10).cast("double") / 0xFFFFFFFF < test_share, "test").otherwise("train")


def crop_curation(people: DataFrame, target: int) -> DataFrame:
    """Whole people (person, camera, crops), the richest of each camera first and cameras in turn, while the crops before them are under ``target``."""
    r = people.withColumn("turn", F.row_number().over(Window.partitionBy("camera").orderBy(F.desc("crops"), "person")))
    # turns are numbered from the sums of whole turns first, so that no window runs over all people
    turns = r.groupBy("turn").agg(F.sum("crops").alias("t"))
    before = turns.select("turn", (F.sum("t").over(Window.orderBy("turn")) - F.col("t")).alias("_b"))
    inside = F.sum("crops").over(Window.partitionBy("turn").orderBy("camera", "person")) - F.col("crops")
    return r.join(before, "turn").withColumn("taken", F.col("_b") + inside < target).drop("_b")


def camera_move(rows: DataFrame, moved: list[int], to: str) -> DataFrame:
    """Rows with whole cameras put into split ``to``, and ids numbered anew within each split in the order of cameras and clips.
    Rows are numbered inside their camera; the cameras' offsets come from one row for each."""
    m = rows.withColumn("split", F.when(F.col("camera").isin(moved), to).otherwise(F.col("split")))
    n = m.groupBy("split", "camera").agg(F.count("*").alias("_n"))
    start = n.select("split", "camera", F.coalesce(F.sum("_n").over(Window.partitionBy("split").orderBy("camera").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    k = F.row_number().over(Window.partitionBy("split", "camera").orderBy("clip"))
    return m.withColumn("_k", k).join(start, ["split", "camera"]).withColumn("new_id", F.col("_o") + F.col("_k")).drop("_o", "_k")


def clip_camera(clips: DataFrame, manifest: DataFrame) -> DataFrame:
    """Clips with their camera: the name's prefix before '__', else the one manifest entry, else AMBIGUOUS or UNKNOWN."""
    prefix = F.when(F.contains("clip", F.lit("__")), F.split_part("clip", F.lit("__"), F.lit(1)))
    m = manifest.groupBy("clip").agg(F.array_sort(F.collect_set("camera")).alias("_c"))
    return clips.join(m, "clip", "left").select("clip", F.coalesce(prefix, F.when(F.size("_c") == 1, F.element_at("_c", 1)).when(F.size("_c") > 1, "AMBIGUOUS"), F.lit("UNKNOWN")).alias("camera"))


def retention(files: DataFrame, cutoff_days: int) -> DataFrame:
    """Per tier: files examined, those over age and their bytes, and tracked ones, which are refused. A report; nothing is deleted."""
    old = F.col("age_days") > cutoff_days
    return files.groupBy("tier").agg(F.count("*").alias("examined"), F.sum(old.cast("long")).alias("over_age"), F.sum(F.when(old & ~F.col("tracked"), F.col("bytes")).otherwise(0)).alias("bytes"), F.sum((old & F.col("tracked")).cast("long")).alias("refused"))


# ---- attributes, alerts, fleet


def track_attributes(rows: DataFrame, least: int = 3) -> DataFrame:
    """Per track and attribute: probability of the mean logit and the share of frames that agree with its sign; null with fewer than ``least`` frames.

    Logits that cancel out have the mean 0 in whatever order they are added up: what is within rounding of 0 counts as 0, which isn't positive.
    """
    m = rows.groupBy("track", "attribute").agg(F.avg("logit").alias("mean"), F.count("logit").alias("n"), F.avg((F.col("logit") > 0).cast("double")).alias("up"), F.avg(F.abs("logit")).alias("_size"))
    ok = F.col("n") >= least
    return m.select("track", "attribute", "n", F.when(ok, 1 / (1 + F.exp(-F.col("mean")))).alias("probability"), F.when(ok, F.when(F.col("mean") > 1e-12 * F.col("_size"), F.col("up")).otherwise(1 - F.col("up"))).alias("agreement"))


def arg_band(rows: DataFrame) -> DataFrame:
    """The attribute with the highest probability of each track (ties: the first by name)."""
    return rows.where("probability IS NOT NULL").groupBy("track").agg(F.min_by("attribute", F.struct(-F.col("probability"), "attribute")).alias("band"))


def staff_probability(features: Column, mean: list[float], sd: list[float], weights: list[float], bias: float) -> Column:
    """Logistic score of standardised features; null if any is."""
    terms = [(F.element_at(features, k + 1) - m) / s * w for k, (m, s, w) in enumerate(zip(mean, sd, weights, strict=True))]
    return 1 / (1 + F.exp(-(sum(terms, F.lit(0.0)) + bias)))


def staff_verdict(rows: DataFrame, least: int = 6, threshold: float = 0.5) -> DataFrame:
    """Per track whether the median probability reaches ``threshold``; null with fewer than ``least`` finite ones."""
    p = F.when(~F.isnan("p"), F.col("p"))
    return rows.groupBy("track").agg(F.count(p).alias("n"), F.median(p).alias("_m")).select("track", "n", F.when(F.col("n") >= least, F.col("_m") >= threshold).alias("staff"))


def latest_verdicts(alerts: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Alerts with their last disposition by (ts, line_no); ``unreviewed`` without any."""
    last = dispositions.groupBy("alert_id").agg(F.max_by("status", F.struct("ts", "line_no")).alias("status"))
    return alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce("status", F.lit("unreviewed")))


def known_dispositions(alerts: DataFrame, dispositions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): dispositions of alerts that exist, and the others."""
    key = alerts.select("alert_id")
    return dispositions.join(key, "alert_id", "left_semi"), dispositions.join(key, "alert_id", "left_anti")


def fleet_report(frames: DataFrame, now: int, stall_seconds: int = 6) -> DataFrame:
    """Per camera of ``frames`` (camera_id, seq, pts, at): state, frames, reconnects (sequence restarts)."""
    w = Window.partitionBy("camera_id").orderBy("at", "seq")
    r = frames.withColumn("_r", (F.col("seq") <= F.lag("seq").over(w)).cast("long"))
    g = r.groupBy("camera_id").agg(F.count("seq").alias("frames"), F.coalesce(F.sum("_r"), F.lit(0)).alias("reconnects"), F.max("at").alias("_last"))
    return g.select("camera_id", "frames", "reconnects", F.when(F.col("_last").isNull(), "never_delivered").when(now - F.col("_last") > stall_seconds, "stalled").otherwise("live").alias("state"))
