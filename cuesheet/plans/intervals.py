"""Queries of the interval engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from .registry import query


def _b(df, *more):
    return df.select("media_id", F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms"), *more)


def _ocr(t):
    return _b(t.ocr_segments, "ocr_id", F.col("text").alias("ocr_text"), "confidence")


def _mids(df, id_):
    return df.select("media_id", F.col(id_).alias("target_id"), F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("at_ms"))


def _chunks(t):
    s = F.col("seg_id")
    lo = F.greatest(F.lit(0).cast("long"), F.col("start_ms") - 1500)
    return t.segments.where(s % 2 == 0).select("media_id", s.alias("chunk_id"), lo.alias("start_ms"), (F.col("start_ms") + s * 150).alias("end_ms"))


CHUNKS = """
, chunks AS (SELECT media_id, seg_id AS chunk_id, greatest(0, start_ms - 1500) AS start_ms, start_ms + seg_id * 150 AS end_ms FROM segments WHERE seg_id % 2 = 0)"""


@query("c1_interval_join", "segments ocr_segments", """
SELECT a.media_id, seg_id, ocr_id, greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS overlap_ms
FROM segments a JOIN ocr_segments b ON a.media_id = b.media_id AND a.end_ms >= b.start_ms AND a.start_ms <= b.end_ms""")  # fmt: skip
def _(t):
    return I.match_ocr(t.segments.select("media_id", "seg_id", "start_ms", "end_ms"), _ocr(t)).select("media_id", "seg_id", "ocr_id", "overlap_ms")


@query("c2_nearest", "segments", CHUNKS + """
, d AS (SELECT c.media_id, chunk_id, seg_id, abs((c.start_ms + c.end_ms) // 2 - (s.start_ms + s.end_ms) // 2) AS dist FROM chunks c JOIN segments s USING (media_id))
SELECT media_id, chunk_id, CAST(arg_min(seg_id, dist * 1000000 + seg_id) AS BIGINT) AS target_id, min(dist) AS distance_ms FROM d GROUP BY ALL""")  # fmt: skip
def _(t):
    points = _chunks(t).withColumn("t", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    return I.nearest(points, _mids(t.segments, "seg_id"), ["media_id"], "t").select("media_id", "chunk_id", "target_id", "distance_ms")


@query("c3_nearest_within", "segments ocr_segments", """
, d AS (SELECT o.media_id, ocr_id, seg_id, abs((o.start_ms + o.end_ms) // 2 - (s.start_ms + s.end_ms) // 2) AS dist FROM ocr_segments o JOIN segments s USING (media_id)),
m AS (SELECT media_id, ocr_id, arg_min(seg_id, dist * 1000000 + seg_id) AS s, min(dist) AS d FROM d GROUP BY ALL)
SELECT media_id, ocr_id, CAST(CASE WHEN d <= 300 THEN s END AS BIGINT) AS target_id, CASE WHEN d <= 300 THEN d END AS distance_ms FROM m""")  # fmt: skip
def _(t):
    points = t.ocr_segments.withColumn("t", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    return I.nearest(points, _mids(t.segments, "seg_id"), ["media_id"], "t", 300).select("media_id", "ocr_id", "target_id", "distance_ms")


@query("c4_asof", "segments scene_cuts", """
SELECT media_id, seg_id, (SELECT max(cut_ms) FROM scene_cuts c WHERE c.media_id = s.media_id AND c.cut_ms <= s.start_ms) AS before,
  (SELECT min(cut_ms) FROM scene_cuts c WHERE c.media_id = s.media_id AND c.cut_ms > s.start_ms) AS after FROM segments s""")  # fmt: skip
def _(t):
    return I.asof(t.segments, t.scene_cuts, ["media_id"], "start_ms", "cut_ms").select("media_id", "seg_id", "before", "after")


@query("c5_snap_to_cuts", "segments scene_cuts", """
, s0 AS (SELECT media_id, seg_id, start_ms + CASE WHEN seg_id % 2 = 0 THEN 500 ELSE 0 END AS s, end_ms + CASE WHEN seg_id % 3 = 0 THEN 50 ELSE 0 END AS e FROM segments),
s1 AS (SELECT *, (SELECT max(cut_ms) FROM scene_cuts c WHERE c.media_id = s0.media_id AND c.cut_ms <= s) AS b FROM s0),
s2 AS (SELECT *, CASE WHEN s - b BETWEEN 1 AND 450 AND e > b + 250 THEN least(s, b + 20) ELSE s END AS ns, (SELECT max(cut_ms) FROM scene_cuts c WHERE c.media_id = s1.media_id AND c.cut_ms <= e) AS b2 FROM s1)
SELECT media_id, seg_id, ns AS new_start_ms, CASE WHEN e - b2 BETWEEN 1 AND 200 AND b2 - 20 > ns THEN b2 - 20 ELSE e END AS new_end_ms FROM s2""")  # fmt: skip
def _(t):
    s = F.col("seg_id")
    moved = t.segments.select(
        "media_id", "seg_id", (F.col("start_ms") + F.when(s % 2 == 0, 500).otherwise(0)).alias("start_ms"), (F.col("end_ms") + F.when(s % 3 == 0, 50).otherwise(0)).alias("end_ms")
    )
    return I.snap_to_cuts(moved, t.scene_cuts).select("media_id", "seg_id", "new_start_ms", "new_end_ms")


@query("c6_uncovered", "segments", CHUNKS + """
, b AS (SELECT c.media_id, chunk_id, c.start_ms, c.end_ms, coalesce(max(least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms)), 0) AS cov
  FROM chunks c LEFT JOIN segments s ON s.media_id = c.media_id AND least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms) > 0 GROUP BY ALL)
SELECT media_id, chunk_id, cov AS covered_ms FROM b WHERE cov < 0.5 * (end_ms - start_ms)""")  # fmt: skip
def _(t):
    return I.uncovered(_chunks(t), _b(t.segments)).select("media_id", "chunk_id", "covered_ms")


@query("c17_slice_clips", "segments", """
, clips AS (SELECT media_id, seg_id AS clip_id, start_ms + 300 AS b, start_ms + 6300 AS e FROM segments WHERE seg_id % 3 = 1)
SELECT s.media_id, clip_id, seg_id, greatest(start_ms, b) - b AS clip_start_ms, least(end_ms, e) - b AS clip_end_ms FROM segments s JOIN clips c ON s.media_id = c.media_id AND s.start_ms < e AND s.end_ms > b""")  # fmt: skip
def _(t):
    clips = t.segments.where("seg_id % 3 = 1").select("media_id", F.col("seg_id").alias("clip_id"), (F.col("start_ms") + 300).alias("b_start_ms"), (F.col("start_ms") + 6300).alias("b_end_ms"))
    return I.slice_clips(t.segments, clips).select("media_id", "clip_id", "seg_id", "clip_start_ms", "clip_end_ms")


@query("c19_frames_in", "frames", """
, w AS (SELECT media_id, idx * 200 AS b, idx * 200 + 1000 AS e FROM frames WHERE idx % 40 = 7)
SELECT media_id, idx FROM frames f WHERE EXISTS (SELECT 1 FROM w WHERE w.media_id = f.media_id AND f.idx * 200 BETWEEN b AND e)""")  # fmt: skip
def _(t):
    frames = t.frames.select("media_id", "idx", (F.col("idx") * 200).cast("long").alias("start_ms"), (F.col("idx") * 200).cast("long").alias("end_ms"))
    windows = t.frames.where("idx % 40 = 7").select("media_id", (F.col("idx") * 200).cast("long").alias("b_start_ms"), (F.col("idx") * 200 + 1000).cast("long").alias("b_end_ms"))
    hit = F.col("start_ms").between(F.col("b_start_ms"), F.col("b_end_ms"))
    return I.overlap_join(frames, windows, ["media_id"], hit, how="left_semi").select("media_id", F.col("idx").cast("long").alias("idx"))


@query("e10_union_intervals", "segments", """
, w AS (SELECT media_id, greatest(0, start_ms - 400) AS lo, least(end_ms + 400, max(end_ms) OVER (PARTITION BY media_id)) AS hi FROM segments),
n AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY media_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM w),
i AS (SELECT *, sum(f) OVER (PARTITION BY media_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT media_id, min(lo) AS start_ms, max(hi) AS end_ms, count(*) AS n FROM i GROUP BY media_id, g""")  # fmt: skip
def _(t):
    ends = t.segments.groupBy("media_id").agg(F.max("end_ms").alias("length_ms"))
    return I.union_intervals(t.segments.join(ends, "media_id"), ["media_id"], 400, F.col("length_ms")).drop("island")


@query("d19_envelope", "frames", """
, n AS (SELECT *, idx * 64 // count(*) OVER (PARTITION BY media_id) AS bucket FROM frames), p AS (SELECT media_id, bucket, max(abs(amp)) AS peak FROM n GROUP BY ALL),
s AS (SELECT media_id, unnest(range(64)) AS bucket FROM (SELECT DISTINCT media_id FROM frames))
SELECT s.media_id, s.bucket, CAST(floor(least(1.0, coalesce(peak, 0)) * 1000 + 0.5) AS BIGINT) AS peak_milli FROM s LEFT JOIN p ON p.media_id = s.media_id AND p.bucket = s.bucket""")  # fmt: skip
def _(t):
    return I.envelope(t.frames, 64, 1.0).select("media_id", "bucket", F.floor(F.col("peak") * 1000 + 0.5).alias("peak_milli"))


@query("d21_frame_rms", "frames", """
, m AS (SELECT media_id, idx // 2 AS i, avg(amp) AS x FROM frames GROUP BY ALL),
e AS (SELECT *, unnest(range(greatest(0, CAST(ceil((i - 24) / 10) AS BIGINT)), i // 10 + 1)) AS frame FROM m)
SELECT media_id, frame, count(*) AS n, CAST(floor(sqrt(avg(x * x)) * 10000 + 0.5) AS BIGINT) AS rms FROM e GROUP BY ALL""")  # fmt: skip
def _(t):
    samples = t.frames.select("media_id", F.floor(F.col("idx") / 2).alias("idx"), F.col("amp").alias("x"))
    return I.frame_rms(samples, 25, 10).select("media_id", "frame", "n", F.floor(F.col("rms") * 10000 + 0.5).alias("rms"))


@query("e17_speech_extent", "frames", """
, s AS (SELECT media_id, idx AS seg_id, idx * 10 AS a, idx * 10 + 320 AS b FROM frames WHERE idx % 50 = 3),
j AS (SELECT s.*, idx * 10 AS t, rms, max(rms) OVER (PARTITION BY s.media_id, seg_id) AS p FROM s JOIN frames f ON f.media_id = s.media_id AND f.idx * 10 >= a AND f.idx * 10 < b)
SELECT media_id, seg_id, greatest(a, min(t) - 40) AS speech_start_ms, least(b, max(t) + 50) AS speech_end_ms, count(*) AS n_active FROM j WHERE rms >= 0.9 * p GROUP BY media_id, seg_id, a, b""")  # fmt: skip
def _(t):
    lo = (F.col("idx") * 10).cast("long")
    segs = t.frames.where("idx % 50 = 3").select("media_id", F.col("idx").alias("seg_id"), lo.alias("start_ms"), (lo + 320).alias("end_ms"))
    return I.speech_extent(t.frames, segs, 10, 0.9).select("media_id", F.col("seg_id").cast("long").alias("seg_id"), "speech_start_ms", "speech_end_ms", "n_active")
