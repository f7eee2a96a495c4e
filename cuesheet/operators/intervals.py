"""Interval joins without inequality joins: overlap, nearest, as-of, cover, union, slicing.

An overlap join explodes both sides into time bins of ``bin_ms``, joins on (media, bin) and keeps a pair only in its first
common bin, so no pair appears twice and no distinct is needed. One long media is spread over its bins. Without a media
key the helpers refuse to plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_MS = 60_000


def _bins(df: DataFrame, start: str, end: str, bin_ms: int, slack: int = 0) -> DataFrame:
    lo = F.floor((F.col(start) - slack) / bin_ms)
    return df.withColumn("_lo", lo).withColumn("_bin", F.explode(F.sequence(lo, F.greatest(lo, F.floor((F.col(end) + slack) / bin_ms)))))


def overlap_join(a: DataFrame, b: DataFrame, key: list[str], condition: Column, bin_ms: int = BIN_MS, how: str = "inner", slack_ms: int = 0) -> DataFrame:
    """a(key, start_ms, end_ms, ...) with b(key, b_start_ms, b_end_ms, ...) where condition holds; touching intervals (or
    ones within slack_ms) share a bin. how: inner or left_semi."""
    if not key:
        raise ValueError("an interval join needs an equality key")
    left = _bins(a, "start_ms", "end_ms", bin_ms, slack_ms).withColumnRenamed("_lo", "_alo")
    right = _bins(b, "b_start_ms", "b_end_ms", bin_ms).withColumnRenamed("_lo", "_blo")
    if how == "left_semi":
        both = left.join(right, [*key, "_bin"]).where(condition & (F.col("_bin") == F.greatest("_alo", "_blo")))
        return both.select(*[F.col(c) for c in a.columns]).distinct()
    both = left.join(right, [*key, "_bin"])
    return both.where((F.col("_bin") == F.greatest("_alo", "_blo")) & condition).drop("_alo", "_blo", "_bin")


def shared_ms() -> Column:
    return F.least("end_ms", "b_end_ms") - F.greatest("start_ms", "b_start_ms")


def match_ocr(asr: DataFrame, ocr: DataFrame, least_ms: int = 200) -> DataFrame:
    """Overlap by least_ms or touching, ends included."""
    touch = (F.col("end_ms") >= F.col("b_start_ms")) & (F.col("start_ms") <= F.col("b_end_ms"))
    return overlap_join(asr, ocr, ["media_id"], (shared_ms() >= least_ms) | touch).withColumn("overlap_ms", F.greatest(F.lit(0).cast("long"), shared_ms()))


def _around(rows: DataFrame, marks: DataFrame, key: list[str], back: str, ahead: str, bin_ms: int) -> DataFrame:
    """rows(key, _t, ...) with the last mark(key, _t, _v) at or before _t and the first one after it. Rows and marks meet in time
    bins, by a running window in either direction; what lies beyond a bin comes from a scan over one row a bin. So a key is
    spread over its bins, and the work is linear in its rows. A null key or time meets nothing."""
    both = rows.withColumns({"_kind": F.lit(1), "_v": F.lit(None).cast(marks.schema["_v"].dataType)})
    both = both.unionByName(marks.where(F.col("_t").isNotNull()).withColumn("_kind", F.lit(0)), allowMissingColumns=True).withColumn("_bin", F.floor(F.col("_t") / bin_ms))
    inside, whole = Window.partitionBy(*key, "_bin"), Window.partitionBy(*key)
    up, down = inside.orderBy("_t", "_kind"), inside.orderBy(F.desc("_t"), F.desc("_kind"))
    upto = (Window.unboundedPreceding, 0)
    local = both.withColumn("_back", F.last("_v", True).over(up.rowsBetween(*upto))).withColumn("_ahead", F.last("_v", True).over(down.rowsBetween(*upto)))
    at = F.when(F.col("_kind") == 0, F.col("_t"))
    bins = both.groupBy(*key, "_bin").agg(F.max_by("_v", at).alias("_last"), F.min_by("_v", at).alias("_first"))
    earlier, later = (whole.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_bin"), F.desc("_bin")))
    beyond = bins.select(*key, "_bin", F.last("_last", True).over(earlier).alias("_before"), F.last("_first", True).over(later).alias("_after"))
    told = local.where("_kind = 1").join(beyond, [*key, "_bin"], "left")
    found = told.withColumns({back: F.coalesce("_back", "_before"), ahead: F.coalesce("_ahead", "_after")})
    return found.select(*[c for c in rows.columns], back, ahead)


def asof(left: DataFrame, points: DataFrame, key: list[str], t: str, p: str, back: str = "before", ahead: str = "after", bin_ms: int = BIN_MS) -> DataFrame:
    """left with the last point <= t and the first point > t: no inequality join."""
    marks = points.select(*key, F.col(p).cast("long").alias("_t"), F.col(p).cast("long").alias("_v"))
    return _around(left.withColumn("_t", F.col(t)), marks, key, back, ahead, bin_ms).drop("_t")


def snap_to_cuts(segs: DataFrame, cuts: DataFrame) -> DataFrame:
    """A start up to 450 ms after a cut moves to 20 ms after it, if the segment goes on 250 ms beyond the cut; then an end
    that overruns a cut by up to 200 ms moves to 20 ms before it."""
    one = asof(segs, cuts, ["media_id"], "start_ms", "cut_ms")
    late = F.col("start_ms") - F.col("before")
    move = late.between(1, 450) & (F.col("end_ms") > F.col("before") + 250)
    one = one.withColumn("new_start_ms", F.when(move, F.least(F.col("start_ms"), F.col("before") + 20)).otherwise(F.col("start_ms"))).drop("before", "after")
    two = asof(one, cuts, ["media_id"], "end_ms", "cut_ms").drop("after")
    over = F.col("end_ms") - F.col("before")
    pull = over.between(1, 200) & (F.col("before") - 20 > F.col("new_start_ms"))
    return two.withColumn("new_end_ms", F.when(pull, F.col("before") - 20).otherwise(F.col("end_ms"))).drop("before")


def nearest(points: DataFrame, targets: DataFrame, key: list[str], t: str, tolerance_ms: int | None = None, bin_ms: int = BIN_MS) -> DataFrame:
    """points(key, t) with the target(key, target_id, at_ms) nearest in time; ties take the lower id. Only the nearest on
    either side can win, so two running windows are enough whatever the distances."""
    at, rid = F.col("at_ms").cast("long"), F.col("target_id").cast("long")
    firsts = targets.groupBy(*key, at.alias("_t")).agg(F.min(rid).alias("id"))
    marks = firsts.select(*key, "_t", F.struct(F.col("_t").alias("at"), "id").alias("_v"))
    near = _around(points.withColumn("_t", F.col(t)), marks, key, "_b", "_a", bin_ms)

    def way(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["at"] - F.col("_t")).alias("distance_ms"), F.col(c)["id"].alias("target_id")))

    best = near.withColumn("_best", F.least(way("_b"), way("_a")))
    ok = F.col("_best.distance_ms") <= tolerance_ms if tolerance_ms is not None else F.lit(True)
    return best.withColumns({"target_id": F.when(ok, F.col("_best.target_id")), "distance_ms": F.when(ok, F.col("_best.distance_ms"))}).drop("_t", "_a", "_b", "_best")


def uncovered(chunks: DataFrame, segs: DataFrame, share: float = 0.5) -> DataFrame:
    """Chunks(media_id, chunk_id, start_ms, end_ms) of which no single segment(b_start_ms, b_end_ms) covers ``share``."""
    hit = overlap_join(chunks, segs, ["media_id"], shared_ms() > 0)
    best = hit.groupBy("media_id", "chunk_id").agg(F.max(shared_ms()).alias("covered_ms"))
    told = chunks.join(best, ["media_id", "chunk_id"], "left").withColumn("covered_ms", F.coalesce("covered_ms", F.lit(0)))
    return told.where(F.col("covered_ms") < share * (F.col("end_ms") - F.col("start_ms")))


def slice_clips(events: DataFrame, clips: DataFrame) -> DataFrame:
    """Events that intersect a clip (media_id, clip_id, b_start_ms, b_end_ms), cut and shifted to the clip's start."""
    hit = overlap_join(events, clips, ["media_id"], shared_ms() > 0)
    return hit.withColumns({"clip_start_ms": F.greatest("start_ms", "b_start_ms") - F.col("b_start_ms"), "clip_end_ms": F.least("end_ms", "b_end_ms") - F.col("b_start_ms")})


def union_intervals(rows: DataFrame, key: list[str], margin_ms: int = 0, limit: Column | None = None) -> DataFrame:
    """Merged intervals after widening by a margin and clamping to 0..limit."""
    lo = F.greatest(F.lit(0).cast("long"), F.col("start_ms") - margin_ms)
    hi = F.col("end_ms") + margin_ms
    wide = rows.select(*key, lo.alias("lo"), (F.least(hi, limit) if limit is not None else hi).alias("hi"))
    w = Window.partitionBy(*key).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = wide.withColumn("_new", F.coalesce((F.col("lo") > before).cast("int"), F.lit(1)))
    marked = new.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "island").agg(F.min("lo").alias("start_ms"), F.max("hi").alias("end_ms"), F.count("*").alias("n"))


def envelope(frames: DataFrame, buckets: int, full: float) -> DataFrame:
    """Per media ``buckets`` peaks of |amp| over full scale, clipped to 0..1; empty buckets are 0."""
    sizes = frames.groupBy("media_id").agg(F.count("*").alias("_n"))
    dealt = frames.join(sizes, "media_id").withColumn("bucket", F.floor(F.col("idx") * buckets / F.col("_n")))
    peaks = dealt.groupBy("media_id", "bucket").agg(F.max(F.abs("amp")).alias("peak"))
    spine = sizes.select("media_id").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return spine.join(peaks, ["media_id", "bucket"], "left").withColumn("peak", F.least(F.lit(1.0), F.coalesce(F.col("peak") / full, F.lit(0.0))))


def frame_rms(samples: DataFrame, width: int, hop: int) -> DataFrame:
    """Mono mean by index, then root mean square of overlapping frames of ``width`` samples every ``hop``."""
    mono = samples.groupBy("media_id", "idx").agg(F.avg("x").alias("x"))
    last, first = F.floor(F.col("idx") / hop), F.greatest(F.lit(0), F.ceil((F.col("idx") - width + 1) / hop))
    each = mono.withColumn("frame", F.explode(F.sequence(first, last)))
    return each.groupBy("media_id", "frame").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def speech_extent(frames: DataFrame, segs: DataFrame, frame_ms: int, share: float = 0.2, margin_ms: int = 40) -> DataFrame:
    """First and last frame of a segment at or above a share of its peak, with margins inside the segment."""
    timed = frames.select("media_id", (F.col("idx") * frame_ms).alias("b_start_ms"), (F.col("idx") * frame_ms).alias("b_end_ms"), "rms")
    inside = overlap_join(segs, timed, ["media_id"], (F.col("b_start_ms") >= F.col("start_ms")) & (F.col("b_start_ms") < F.col("end_ms")))
    peak = inside.withColumn("peak", F.max("rms").over(Window.partitionBy("media_id", "seg_id")))
    active = peak.where(F.col("rms") >= share * F.col("peak")).groupBy("media_id", "seg_id", "start_ms", "end_ms")
    lo, hi = F.min("b_start_ms"), F.max("b_start_ms")
    return active.agg(
        F.greatest(F.col("start_ms"), lo - margin_ms).alias("speech_start_ms"), F.least(F.col("end_ms"), hi + frame_ms + margin_ms).alias("speech_end_ms"), F.count("*").alias("n_active")
    )
