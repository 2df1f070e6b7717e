"""Security events from observations (camera_id, track_id, frame_index, class_name, score, x_m, z_m, x0..y1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewatch.functions.geometry import finite, point_in_polygon, segments_cross, side
from aislewatch.operators.runs import TRACK, frame_runs, observed_runs, run_seconds, window_median

EVENT_TYPES = ("zone_intrusion", "loitering", "occupancy_exceeded", "line_cross", "tailgating", "running", "crowd_forming", "object_left", "stock_removed", "fall_candidate", "fall", "crouch", "reach_to_shelf")


def in_zones(obs: DataFrame, zones: DataFrame) -> DataFrame:
    """Each observation with each zone of its camera, and ``inside``. Zones are a small dimension: one row a zone."""
    return obs.join(zones.select("camera_id", "zone", "polygon", "max_occupancy", "loiter_seconds", "restricted"), "camera_id").withColumn("inside", point_in_polygon(F.col("x_m"), F.col("z_m"), F.col("polygon"))).drop("polygon")


def zone_stays(obs: DataFrame, zones: DataFrame, fps: float) -> DataFrame:
    """Runs of observations inside each zone."""
    runs = observed_runs(in_zones(obs, zones), [*TRACK, "zone"], F.col("inside"))
    stays = runs.groupBy(*TRACK, "zone", "run").agg(F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"), F.first("loiter_seconds").alias("loiter_seconds"), F.first("restricted").alias("restricted"))
    return stays.withColumn("value", run_seconds(fps)).drop("run")


def zone_intrusion(obs: DataFrame, zones: DataFrame, fps: float = 5.0, min_seconds: float = 1.0) -> DataFrame:
    hit = zone_stays(obs, zones, fps).where(F.col("restricted") & (F.col("value") >= min_seconds))
    return hit.select(F.lit("zone_intrusion").alias("type"), *TRACK, "zone", "frame_start", "frame_end", "value", F.lit(float(min_seconds)).alias("threshold"))


def loitering(obs: DataFrame, zones: DataFrame, fps: float = 5.0) -> DataFrame:
    hit = zone_stays(obs, zones, fps).where(F.col("value") >= F.col("loiter_seconds"))
    return hit.select(F.lit("loitering").alias("type"), *TRACK, "zone", "frame_start", "frame_end", "value", F.col("loiter_seconds").alias("threshold"))


def zone_occupancy(obs: DataFrame, zones: DataFrame) -> DataFrame:
    """(camera_id, zone, frame_index, n): tracks inside each zone in each frame with any."""
    return in_zones(obs, zones).where("inside").groupBy("camera_id", "zone", "frame_index").agg(F.count("*").alias("n"), F.first("max_occupancy").alias("max_occupancy"))


def occupancy_exceeded(obs: DataFrame, zones: DataFrame, fps: float = 5.0, min_seconds: float = 2.0) -> DataFrame:
    """Runs of consecutive frames with more tracks inside than the zone's limit (0 or more)."""
    over = frame_runs(zone_occupancy(obs, zones).where("n > max_occupancy"), ["camera_id", "zone"])
    runs = over.groupBy("camera_id", "zone", "run").agg(F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"), F.max("n").cast("double").alias("value"), F.first("max_occupancy").cast("double").alias("threshold"))
    return runs.where(run_seconds(fps) >= min_seconds).select(F.lit("occupancy_exceeded").alias("type"), "camera_id", "zone", "frame_start", "frame_end", "value", "threshold")


def line_crossings(obs: DataFrame, lines: DataFrame) -> DataFrame:
    """Consecutive observations of a track on two sides of a directed segment, whose step crosses it."""
    w = Window.partitionBy(*TRACK).orderBy("frame_index")
    steps = obs.withColumns({"px": F.lag("x_m").over(w), "pz": F.lag("z_m").over(w), "frame_start": F.lag("frame_index").over(w)}).where(F.col("frame_start").isNotNull() & finite(F.col("x_m"), F.col("z_m"), F.col("px"), F.col("pz")))
    j = steps.join(lines, "camera_id")
    a, b, p, q = ((F.col(x), F.col(z)) for x, z in (("ax", "az"), ("bx", "bz"), ("px", "pz"), ("x_m", "z_m")))
    after = side(*a, *b, *q)
    hit = j.where((side(*a, *b, *p) * after == -1) & segments_cross(a, b, p, q))
    return hit.select(F.lit("line_cross").alias("type"), *TRACK, "line", "frame_start", F.col("frame_index").alias("frame_end"), after.alias("value"), F.when(after > 0, "in").otherwise("out").alias("direction"))


def tailgating(obs: DataFrame, lines: DataFrame, fps: float = 5.0, within_seconds: float = 2.0) -> DataFrame:
    """Neighbouring crossings of a line in one direction by two tracks; ties of the frame are taken by track."""
    w = Window.partitionBy("camera_id", "line", "direction").orderBy("frame_start", "track_id", "frame_end")
    pairs = line_crossings(obs, lines).withColumns({"first_track": F.lag("track_id").over(w), "first_start": F.lag("frame_start").over(w)})
    gap = (F.col("frame_start") - F.col("first_start")) / F.lit(float(fps))
    return pairs.where((F.col("first_track") != F.col("track_id")) & (gap <= within_seconds)).select(F.lit("tailgating").alias("type"), "camera_id", "line", "direction", "first_track", F.col("track_id").alias("second_track"), F.col("first_start").alias("frame_start"), "frame_end", gap.alias("value"))


def running(obs: DataFrame, fps: float = 5.0, max_speed: float = 2.5, window_seconds: float = 1.0, min_seconds: float = 0.6) -> DataFrame:
    """Net displacement to the furthest observation within the window, over the time to it, above ``max_speed``."""
    span = max(round(window_seconds * fps), 1)
    ahead = Window.partitionBy(*TRACK).orderBy("frame_index").rangeBetween(0, span)
    s = obs.withColumn("_e", F.last(F.struct("frame_index", "x_m", "z_m")).over(ahead))
    dt = (F.col("_e.frame_index") - F.col("frame_index")) / F.lit(float(fps))
    ok = (dt > 0) & finite(F.col("x_m"), F.col("z_m"), F.col("_e.x_m"), F.col("_e.z_m"))
    s = s.withColumn("speed", F.when(ok, F.hypot(F.col("_e.x_m") - F.col("x_m"), F.col("_e.z_m") - F.col("z_m")) / dt))
    runs = observed_runs(s, TRACK, F.col("speed") > max_speed).groupBy(*TRACK, "run").agg(F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"), F.max("speed").alias("value"))
    return runs.where(run_seconds(fps) >= min_seconds).select(F.lit("running").alias("type"), *TRACK, "frame_start", "frame_end", "value", F.lit(float(max_speed)).alias("threshold"))


def crowd_neighbours(obs: DataFrame, radius: float = 1.5) -> DataFrame:
    """(camera_id, frame_index, track_id, n): tracks within ``radius`` of each, itself included.

    Positions are dealt to square cells as wide as the radius and each looks in nine, so that a dense frame doesn't
    compare all with all.
    """
    p = obs.where(finite(F.col("x_m"), F.col("z_m"))).select(*TRACK, "frame_index", "x_m", "z_m", F.floor(F.col("x_m") / radius).alias("cx"), F.floor(F.col("z_m") / radius).alias("cz"))
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(cx + i AS x, cz + j AS z))))"))
    q = p.select("camera_id", "frame_index", "track_id", "x_m", "z_m", near.alias("c")).select("camera_id", "frame_index", F.col("track_id").alias("me"), F.col("x_m").alias("mx"), F.col("z_m").alias("mz"), F.col("c.x").alias("cx"), F.col("c.z").alias("cz"))
    dx, dz = F.col("x_m") - F.col("mx"), F.col("z_m") - F.col("mz")
    d = F.sqrt(dx * dx + dz * dz)
    return q.join(p, ["camera_id", "frame_index", "cx", "cz"]).where(d <= radius).groupBy("camera_id", "frame_index", F.col("me").alias("track_id")).agg(F.count("*").alias("n"))


def crowd_forming(obs: DataFrame, fps: float = 5.0, radius: float = 1.5, min_people: int = 4, min_seconds: float = 5.0) -> DataFrame:
    most = crowd_neighbours(obs, radius).groupBy("camera_id", "frame_index").agg(F.max("n").alias("n")).where(F.col("n") >= min_people)
    runs = frame_runs(most, ["camera_id"]).groupBy("camera_id", "run").agg(F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"), F.max("n").cast("double").alias("value"))
    return runs.where(run_seconds(fps) >= min_seconds).select(F.lit("crowd_forming").alias("type"), "camera_id", "frame_start", "frame_end", "value", F.lit(float(min_people)).alias("threshold"))


def nearest_person(spans: DataFrame, people: DataFrame, bucket: int = 64) -> DataFrame:
    """``spans`` (camera_id, track_id, frame_start, frame_end, x, z) with ``nearest``: the least distance of a person in the span, null if none.

    A range join over frame buckets: a span looks into the buckets that it covers.
    """
    p = people.where(finite(F.col("x_m"), F.col("z_m"))).select("camera_id", F.col("frame_index").alias("_f"), F.col("x_m").alias("_x"), F.col("z_m").alias("_z"), F.floor(F.col("frame_index") / bucket).alias("_b"))
    s = spans.withColumn("_b", F.explode(F.expr(f"sequence(CAST(floor(frame_start / {bucket}) AS BIGINT), CAST(floor(frame_end / {bucket}) AS BIGINT))")))
    j = s.join(p, ["camera_id", "_b"], "left").withColumn("_d", F.when(F.col("_f").between(F.col("frame_start"), F.col("frame_end")), F.hypot(F.col("_x") - F.col("x"), F.col("_z") - F.col("z"))))
    return j.groupBy(*spans.columns).agg(F.min("_d").alias("nearest"))


def object_left(obs: DataFrame, fps: float = 5.0, still_seconds: float = 30.0, still_radius: float = 0.5, owner_radius: float = 2.0, bag: str = "bag", person: str = "person") -> DataFrame:
    runs = observed_runs(obs.where(F.col("class_name") == bag), TRACK, finite(F.col("x_m"), F.col("z_m")))
    w = Window.partitionBy(*TRACK, "run")
    runs = runs.withColumns({"x": F.avg("x_m").over(w), "z": F.avg("z_m").over(w)})
    spans = runs.groupBy(*TRACK, "run").agg(F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"), F.first("x").alias("x"), F.first("z").alias("z"), F.max(F.hypot(F.col("x_m") - F.col("x"), F.col("z_m") - F.col("z"))).alias("spread"), F.count("*").alias("_n"))
    spans = spans.withColumn("value", run_seconds(fps)).where((F.col("value") >= still_seconds) & (F.col("spread") <= still_radius)).drop("run", "_n")
    near = nearest_person(spans, obs.where(F.col("class_name") == person))
    return near.where(F.col("nearest").isNull() | (F.col("nearest") > owner_radius)).select(F.lit("object_left").alias("type"), *TRACK, "frame_start", "frame_end", "value", "spread", "nearest")


def zone_stock(frames: DataFrame, boxes: DataFrame, zones: DataFrame, classes: tuple[str, ...] = ("boxed_stock", "device"), score: float = 0.3) -> DataFrame:
    """(camera_id, zone, frame_index, n) for every row of ``frames`` (camera_id, frame_index): merchandise boxes in the zone, 0 where none."""
    hit = in_zones(boxes.where(F.col("class_name").isin(*classes) & (F.col("score") >= score)), zones).where("inside").groupBy("camera_id", "zone", "frame_index").agg(F.count("*").alias("n"))
    every = frames.select("camera_id", "frame_index").distinct().join(zones.select("camera_id", "zone"), "camera_id")
    return every.join(hit, ["camera_id", "zone", "frame_index"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def stock_removed(counts: DataFrame, fps: float = 5.0, drop: int = 1, hold_seconds: float = 10.0) -> DataFrame:
    """Drops of the count that last: the median of the frames before minus the largest of those after, over dense frames.

    After a hit the next ``hold`` frames start no other; hits of one zone are few and are walked in order in a fold.
    """
    hold = max(round(hold_seconds * fps), 1)
    ends = counts.groupBy("camera_id", "zone").agg(F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"))
    dense = ends.withColumn("frame_index", F.explode(F.sequence("lo", "hi"))).join(counts, ["camera_id", "zone", "frame_index"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("camera_id", "zone").orderBy("frame_index")
    d = dense.withColumns({"before": window_median("n", w.rowsBetween(-hold, -1)), "after": F.max("n").over(w.rowsBetween(0, hold - 1))})
    hits = d.where((F.col("frame_index") - F.col("lo") >= hold) & (F.col("frame_index") + hold - 1 <= F.col("hi")) & (F.col("before") - F.col("after") >= drop))
    walked = hits.groupBy("camera_id", "zone").agg(F.sort_array(F.collect_list(F.struct("frame_index", (F.col("before") - F.col("after")).alias("value")))).alias("h"))
    fold = F.aggregate("h", F.array().cast("array<struct<frame_index: bigint, value: double>>"), lambda kept, x: F.when((F.size(kept) == 0) | (x["frame_index"] >= F.element_at(kept, -1)["frame_index"] + hold), F.concat(kept, F.array(x))).otherwise(kept))
    out = walked.select("camera_id", "zone", F.explode(fold).alias("e"))
    return out.select(F.lit("stock_removed").alias("type"), "camera_id", "zone", F.col("e.frame_index").alias("frame_start"), (F.col("e.frame_index") + hold - 1).alias("frame_end"), F.col("e.value").alias("value"))


def fall_candidate(obs: DataFrame, fps: float = 5.0, aspect: float = 1.0, ratio: float = 0.6, min_seconds: float = 1.5) -> DataFrame:
    """Boxes wider than tall and far lower than the track's 90th percentile of heights, sustained."""
    h = F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-6))
    s = obs.withColumns({"_h": h, "_a": (F.col("x1") - F.col("x0")) / h})
    s = s.withColumns({"_tall": F.percentile("_h", 0.9).over(Window.partitionBy(*TRACK)), "_n": F.count("*").over(Window.partitionBy(*TRACK))})
    runs = observed_runs(s.where("_n > 1"), TRACK, (F.col("_a") >= aspect) & (F.col("_h") <= ratio * F.col("_tall"))).groupBy(*TRACK, "run").agg(F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"), F.max("_a").alias("box_aspect"))
    return runs.withColumn("value", run_seconds(fps)).where(F.col("value") >= min_seconds).select(F.lit("fall_candidate").alias("type"), *TRACK, "frame_start", "frame_end", "value", "box_aspect")


def event_support(events: DataFrame, obs: DataFrame) -> DataFrame:
    """Events (event_id, camera_id, track_id, frame_start, frame_end) with score_p50, score_min, observed, span of their own observations."""
    o = obs.select("camera_id", "track_id", "frame_index", "score")
    j = events.join(o, (events.camera_id == o.camera_id) & (events.track_id == o.track_id) & o.frame_index.between(events.frame_start, events.frame_end), "left").select(*[events[c] for c in events.columns], "frame_index", "score")
    return j.groupBy(*events.columns).agg(F.median("score").alias("score_p50"), F.min("score").alias("score_min"), F.count("frame_index").alias("observed")).withColumn("span", F.col("frame_end") - F.col("frame_start") + 1)


def union_events(*parts: DataFrame) -> DataFrame:
    """All detectors' rows in one table; a column that a detector lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def require_buildable(requested: DataFrame, known: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """Requested event types (column type) that no detector here produces."""
    return requested.where(~F.col("type").isin(*known)).select("type").distinct()


def with_clock(events: DataFrame, clip_start: Column, fps: float) -> DataFrame:
    """started_at, ended_at (the end of the last frame) and seconds from the clip's start; null without one."""
    at = lambda f: clip_start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (f / F.lit(float(fps))).cast("decimal(18,6)"))
    return events.withColumns({"started_at": at(F.col("frame_start")), "ended_at": at(F.col("frame_end") + 1), "seconds": run_seconds(fps)})


def event_row(events: DataFrame, digits: int = 3) -> DataFrame:
    """Rows for a report: every double rounded half to even."""
    return events.select(*[F.bround(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in events.dtypes])
