"""Queries of fusion, sessions, voices, speakers and word alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import media as M
from ..operators import segments as S
from .intervals import CHUNKS, _chunks, _ocr
from .registry import query
from .segments import RATE_SQL, WORD_SQL


@query("e4_suspects", "segments", CHUNKS + RATE_SQL + """
, e2 AS (SELECT media_id, seg_id, 1 AS k, 'rate' AS why FROM m WHERE n >= 5 AND (rate < 0.4 * mid OR rate > 3 * mid)),
g AS (SELECT media_id, seg_id, start_ms, lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) - end_ms AS gap FROM segments),
gm AS (SELECT *, median(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY media_id) AS mid FROM g),
gw AS (SELECT *, coalesce(gap > greatest(1500, 3 * mid), false) AS wide FROM gm),
e3 AS (SELECT media_id, seg_id, 2 AS k, 'gap' AS why FROM (SELECT *, wide OR coalesce(lag(wide) OVER (PARTITION BY media_id ORDER BY start_ms, seg_id), false) AS bad FROM gw) WHERE bad),
cov AS (SELECT c.media_id, chunk_id, c.start_ms, c.end_ms, coalesce(max(least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms)), 0) AS shared
  FROM chunks c LEFT JOIN segments s ON s.media_id = c.media_id AND least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms) > 0 GROUP BY ALL),
fr AS (SELECT * FROM cov WHERE shared < 0.5 * (end_ms - start_ms)),
nr AS (SELECT f.media_id, chunk_id, arg_min(seg_id, abs((f.start_ms + f.end_ms) // 2 - (s.start_ms + s.end_ms) // 2) * 1000000 + seg_id) AS seg_id FROM fr f JOIN segments s USING (media_id) GROUP BY ALL),
every AS (SELECT * FROM e2 UNION SELECT * FROM e3 UNION SELECT media_id, seg_id, 3, 'chunk' FROM nr),
told AS (SELECT media_id, seg_id, string_agg(why, ',' ORDER BY k) AS reasons FROM every GROUP BY ALL)
SELECT media_id, seg_id, reasons FROM segments LEFT JOIN told USING (media_id, seg_id)""")  # fmt: skip
def _(t):
    return M.suspects(t.segments, _chunks(t)).select("media_id", "seg_id", "reasons")


def _fused(t, whole=False):
    """OCR texts that lack, repeat or add something, and silent segments, so that every rule has its cases. ``whole``: no text
    is cut short or silenced."""
    k = (F.col("media_id") + F.col("ocr_id")) % 6
    less = F.col("text") if whole else F.expr("substring(text, 4)")
    text = F.when(k == 1, F.concat(F.lit("前後"), "text", F.lit("再見"))).when(k == 2, F.concat(F.lit("漢字"), F.reverse("text"))).when(k == 3, less)
    late = F.when(k == 4, 86_400_000).otherwise(0)  # touches no segment
    ocr = _ocr(t).withColumnRenamed("ocr_text", "text").withColumns({"text": F.concat(text.otherwise(F.col("text")), F.lit("看見漢")), "b_start_ms": F.col("b_start_ms") + late, "b_end_ms": F.col("b_end_ms") + late})
    said = t.segments if whole else t.segments.withColumn("text", F.when(F.col("seg_id") % 5 == 0, "…").otherwise(F.col("text")))
    return M.fuse(said, ocr.withColumnRenamed("text", "ocr_text"), M.suspects(t.segments, _chunks(t)).where("reasons IS NOT NULL"))


@query("e5_fuse", "segments ocr_segments")
def _(t):
    return _fused(t).select("media_id", "seg_id", "ocr_id", "decision", "rule", F.round("final_score", 3).alias("final_score"), "final_text", "start_ms", "end_ms")


@query("g2_fusion_report", "segments ocr_segments")
def _(t):
    return _fused(t).groupBy("media_id", "decision").agg(F.count("*").alias("n"))


@query("g1_ocr_only", "segments ocr_segments", """
, g AS (SELECT media_id, ocr_id, start_ms + 100000 AS s, end_ms + 100000 AS e, confidence, text FROM ocr_segments WHERE length(regexp_replace(text, '[^\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]', '', 'g')) >= 3 AND confidence >= 0.6)
SELECT media_id, ocr_id, confidence FROM g WHERE NOT EXISTS (SELECT 1 FROM segments a WHERE a.media_id = g.media_id AND a.end_ms >= g.s AND a.start_ms <= g.e)""")  # fmt: skip
def _(t):
    late = _ocr(t).withColumns({c: F.col(c) + 100_000 for c in ("b_start_ms", "b_end_ms")})
    return M.ocr_only(t.segments, late).select("media_id", "ocr_id", "confidence")


@query("e9_merge_frames", "segments")
def _(t):
    shown = F.concat("text", F.when(F.col("n") % 3 == 0, ".").otherwise(""))
    frames = t.segments.select("media_id", "seg_id", "text", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n"))
    frames = frames.select("media_id", (F.col("seg_id") * 10 + F.col("n")).alias("t"), shown.alias("text"), (F.col("n") / 10).alias("score"))
    return M.merge_frames(frames, frame_ms=1).select("media_id", "start", "end", "text", "stability")


@query("d11_pitch_stats", "frames", """
, f AS (SELECT media_id, CASE WHEN idx % 4 = 0 THEN 0 ELSE 80 + amp * 200 END AS hz FROM frames)
SELECT media_id, CAST(round(quantile_cont(hz, 0.5) * 100) AS BIGINT) AS median, CAST(round(quantile_cont(hz, 0.1) * 100) AS BIGINT) AS p10, CAST(round(quantile_cont(hz, 0.9) * 100) AS BIGINT) AS p90,
  CAST(round(stddev_pop(hz) * 100) AS BIGINT) AS std FROM f WHERE hz > 0 GROUP BY media_id""")  # fmt: skip
def _(t):
    f0 = t.frames.select("media_id", F.when(F.col("idx") % 4 == 0, 0.0).otherwise(80 + F.col("amp") * 200).alias("hz"))
    return M.pitch_stats(f0).select("media_id", *[F.round(F.col(c) * 100).cast("long").alias(c) for c in ("median", "p10", "p90", "std")])


@query("d12_gender", "frames", """
, f AS (SELECT media_id, CASE WHEN idx % 4 = 0 THEN 0 ELSE 80 + media_id % 7 * 25 + amp * 20 END AS hz FROM frames),
p AS (SELECT media_id, quantile_cont(hz, 0.5) FILTER (hz > 0) AS m, count(*) FILTER (hz > 0) / count(*) AS v FROM f GROUP BY media_id)
SELECT media_id, CASE WHEN least(1.0, abs(m - 165) / 165 * 3) * v < 0.2 THEN 'unknown' WHEN m < 165 THEN 'male' ELSE 'female' END AS gender FROM p""")  # fmt: skip
def _(t):
    f0 = t.frames.select("media_id", F.when(F.col("idx") % 4 == 0, 0.0).otherwise(80 + F.col("media_id") % 7 * 25 + F.col("amp") * 20).alias("hz"))
    return M.pitch_stats(f0).select("media_id", "gender")


@query("f4_best_frame", "frames", """
, f AS (SELECT media_id, idx AS ts, amp * 260.0::DOUBLE AS luma, (idx * 7 % 100) * 0.8::DOUBLE AS contrast, rms * 200.0::DOUBLE AS sharp, (idx * 13 % 256)::DOUBLE AS sat FROM frames),
s AS (SELECT *, CASE WHEN luma < 25 THEN 'dark' WHEN luma > 238 THEN 'overexposed' WHEN contrast < 16 THEN 'flat' ELSE 'ok' END AS reason,
  floor((sharp * 3.2::DOUBLE + contrast * 2.0::DOUBLE + sat * 1.4::DOUBLE + greatest(0.0::DOUBLE, 1 - abs(luma - 128.0::DOUBLE) / 128.0::DOUBLE) * 35.0::DOUBLE - CASE WHEN sharp < 8 THEN 75.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS total FROM f),
r AS (SELECT *, CASE reason WHEN 'ok' THEN total WHEN 'flat' THEN -150.0::DOUBLE ELSE -250.0::DOUBLE END AS score FROM s)
SELECT media_id, ts, score, reason FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, ts) AS rn FROM r) WHERE rn = 1""")  # fmt: skip
def _(t):
    i = F.col("idx")
    feats = t.frames.select("media_id", i.alias("ts"), (F.col("amp") * 260).alias("luma"), (i * 7 % 100 * 0.8).alias("contrast"), (F.col("rms") * 200).alias("sharp"), (i * 13 % 256).alias("saturation"))
    return M.best_frame(feats).withColumn("ts", F.col("ts").cast("long"))


@query("f6_cast_voices", "segments", """
, q AS (SELECT media_id, speaker, sum(end_ms - start_ms) AS ms, count(*) AS k, min(start_ms) AS a, max(end_ms) AS z FROM segments GROUP BY ALL),
pr AS (SELECT *, ms / sum(ms) OVER w AS share, floor(ms / sum(ms) OVER w * 100) AS pct, (z - a) / greatest(max(z) OVER w - min(a) OVER w, 1) AS cover FROM q WINDOW w AS (PARTITION BY media_id)),
n AS (SELECT media_id, speaker, CASE pct % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender, 90 + ms % 90 AS hz, share >= 0.35 AND cover >= 0.60 AND k >= 2 AS narrator,
  CASE WHEN pct > 95 THEN 'star' WHEN pct < 30 THEN 'v1' END AS fixed, row_number() OVER (PARTITION BY media_id ORDER BY ms DESC, speaker) AS rn FROM pr),
taken AS (SELECT media_id, coalesce(list(fixed) FILTER (fixed IS NOT NULL), CAST([] AS VARCHAR[])) AS used FROM n GROUP BY media_id),
vs AS (SELECT list({'voice': 'v' || s_suppkey, 'gender': CASE s_suppkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE '' END,
  'tag': CASE s_suppkey % 5 WHEN 0 THEN 'deep_male' WHEN 1 THEN 'young_male' WHEN 2 THEN 'female' WHEN 3 THEN 'child_or_high' ELSE '' END, 'fit': (s_suppkey % 10) / 10::DOUBLE} ORDER BY 'v' || s_suppkey) AS voices FROM supplier),
r AS (WITH RECURSIVE f(media_id, rn, speaker, used, voice, source, score) AS (
  SELECT media_id, CAST(0 AS BIGINT), '', used, '', '', 0.0::DOUBLE FROM taken
  UNION ALL SELECT media_id, rn, speaker, list_append(used, voice), voice, source, score FROM (
    SELECT *, coalesce(fixed, voices[list_position(worth, list_max(worth))].voice) AS voice, CASE WHEN fixed IS NULL THEN 'auto' ELSE 'manual_override' END AS source,
      CASE WHEN fixed IS NULL THEN floor(list_max(worth) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM (
      SELECT n.*, used, voices, list_transform(voices, lambda v: greatest(0.0::DOUBLE, least(1.0::DOUBLE,
        0.4::DOUBLE * (CASE WHEN n.gender = 'unknown' OR v.gender = '' THEN 0.5::DOUBLE WHEN n.gender = v.gender THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
        + 0.2::DOUBLE * (CASE WHEN v.tag = '' THEN 0.5::DOUBLE WHEN n.gender = 'male' AND v.tag = (CASE WHEN hz < 135 THEN 'deep_male' ELSE 'young_male' END) THEN 1.0::DOUBLE
          WHEN n.gender = 'male' AND v.gender = 'male' THEN 0.8::DOUBLE WHEN n.gender = 'female' AND v.tag IN ('female', 'child_or_high') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)
        + 0.25::DOUBLE * (CASE WHEN n.narrator THEN v.fit ELSE 0.6::DOUBLE END) + 0.15::DOUBLE * 1.0::DOUBLE - (CASE WHEN list_contains(used, v.voice) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END)))) AS worth
      FROM f JOIN n ON n.media_id = f.media_id AND n.rn = f.rn + 1, vs))) SELECT * FROM f WHERE rn > 0)
SELECT media_id, speaker, voice, source, score FROM r""")  # fmt: skip
def _(t):
    pct, key = F.col("share_pct"), F.col("s_suppkey")
    profiles = S.profile_speakers(t.segments).select(
        "media_id", "speaker", F.when(pct % 3 == 0, "male").when(pct % 3 == 1, "female").otherwise("unknown").alias("gender"), (90 + F.col("total_ms") % 90).alias("pitch_hz"), "narrator", "total_ms",
        F.when(pct > 95, "star").when(pct < 30, "v1").alias("override"),
    )
    tag = F.when(key % 5 == 0, "deep_male").when(key % 5 == 1, "young_male").when(key % 5 == 2, "female").when(key % 5 == 3, "child_or_high").otherwise("")
    voices = t.supplier.select(
        F.concat(F.lit("v"), key.cast("string")).alias("voice"), F.when(key % 3 == 0, "male").when(key % 3 == 1, "female").otherwise("").alias("gender"),
        tag.alias("pitch_tag"), (key % 10 / 10).alias("narrator_fit"), F.lit("p").alias("provider"),
    )
    return M.cast_voices(profiles, voices)


@query("j1_fill_embeddings", "voiceprints", """
, n AS (SELECT media_id, seg_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_id) AS rn FROM voiceprints)
SELECT media_id, seg_id, (SELECT arg_min(m.rn, abs(m.rn - n.rn) * 1000000 + m.rn) FROM n m WHERE m.media_id = n.media_id AND m.seg_id % 3 = 0) AS from_rn FROM n""")  # fmt: skip
def _(t):
    holes = t.voiceprints.withColumn("embedding", F.when(F.col("seg_id") % 3 == 0, F.col("embedding")))
    return M.fill_embeddings(holes).select("media_id", "seg_id", F.col("from_rn").cast("long").alias("from_rn"))


@query("j2_spread", "voiceprints", """
, v AS (SELECT media_id, seg_id, embedding FROM voiceprints),
p AS (SELECT a.media_id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM v a JOIN v b ON a.media_id = b.media_id AND a.seg_id < b.seg_id)
SELECT media_id, count(*) AS pairs, CAST(round(quantile_cont(d, 0.9) * 10000) AS BIGINT) AS p90, quantile_cont(d, 0.9) < 0.3 AS one_speaker FROM p GROUP BY media_id""")  # fmt: skip
def _(t):
    return M.spread(t.voiceprints).withColumn("p90", F.round(F.col("p90") * 10000).cast("long"))


@query("j3_cluster_speakers", "voiceprints")
def _(t):
    return M.cluster_speakers(t.voiceprints)


@query("j4_relabel", "voiceprints", """
, s AS (SELECT media_id, label, sum(seg_id % 13 + 1) AS ms FROM voiceprints GROUP BY ALL)
SELECT media_id, seg_id, CAST(rn - 1 AS INT) AS speaker_id FROM voiceprints JOIN (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ms DESC, label) AS rn FROM s) USING (media_id, label)""")  # fmt: skip
def _(t):
    rows = t.voiceprints.select("media_id", "seg_id", F.col("label").alias("cluster"), (F.col("seg_id") % 13 + 1).alias("ms"))
    return M.relabel(rows, "ms").select("media_id", "seg_id", "speaker_id")


@query("e14_split_long", "segments")
def _(t):
    words = S.word_times(t.segments).groupBy("media_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "t1_ms"))).alias("words"))
    heard = t.segments.join(words.withColumn("words", F.when(F.col("seg_id") % 3 > 0, F.col("words"))), ["media_id", "seg_id"], "left")
    return M.split_long(heard)


@query("e15_display_cues", "segments")
def _(t):
    return M.split_for_display(t.segments)


@query("e16_anchor_words", "segments", WORD_SQL + """
, x AS (SELECT media_id, seg_id, min(t0_ms) + 350 AS a, max(t1_ms) - 900 AS z FROM words GROUP BY ALL)
SELECT s.media_id, s.seg_id, CASE WHEN abs(a - start_ms) <= 600 THEN a ELSE start_ms END AS new_start_ms,
  greatest(CASE WHEN abs(z - end_ms) <= 600 THEN z ELSE end_ms END, CASE WHEN abs(a - start_ms) <= 600 THEN a ELSE start_ms END) AS new_end_ms FROM segments s JOIN x USING (media_id, seg_id)""")  # fmt: skip
def _(t):
    w = S.word_times(t.segments).groupBy("media_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", (F.col("t0_ms") + 350).alias("t0_ms"), (F.col("t1_ms") - 900).alias("t1_ms")))).alias("words"))
    return M.anchor_words(t.segments.join(w, ["media_id", "seg_id"])).select("media_id", "seg_id", "new_start_ms", "new_end_ms")


@query("e13_map_words", "segments", WORD_SQL + """
, tgt AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY media_id, seg_id) AS nt FROM words WINDOW w AS (PARTITION BY media_id, seg_id ORDER BY pos)),
src AS (SELECT *, row_number() OVER (PARTITION BY media_id, seg_id ORDER BY pos) - 1 AS j, count(*) OVER (PARTITION BY media_id, seg_id) AS na FROM words WHERE pos % 3 <> 1),
b AS (SELECT t.media_id, t.seg_id, t.pos, t.word, t.i, s.t0_ms, s.t1_ms FROM tgt t JOIN src s ON s.media_id = t.media_id AND s.seg_id = t.seg_id AND s.j = t.i * s.na // t.nt),
m AS (SELECT *, max(t0_ms) OVER w AS a, max(t1_ms) OVER w AS z FROM b WINDOW w AS (PARTITION BY media_id, seg_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT media_id, seg_id, CAST(pos AS INT) AS pos, word, a AS t0_ms, greatest(a, z) AS t1_ms FROM m""")  # fmt: skip
def _(t):
    words = S.word_times(t.segments)
    return M.map_words(words.select("media_id", "seg_id", "pos", "word"), words.where("pos % 3 <> 1").drop("word", "span_ms"))


@query("b11_validate_alignment", "segments", WORD_SQL + """
, j AS (SELECT media_id, seg_id, pos, t0_ms - CASE WHEN pos = 5 AND seg_id % 4 = 0 THEN 4000 ELSE 0 END AS a, t1_ms + CASE WHEN seg_id % 5 = 0 THEN 400 ELSE 0 END AS z FROM words WHERE NOT (seg_id % 7 = 0 AND pos = 2)),
f AS (SELECT *, a >= 0 AND a <= z AND coalesce(lag(a) OVER (PARTITION BY media_id, seg_id ORDER BY pos), 0) <= a AS ok FROM j),
p AS (SELECT media_id, seg_id, count(*) AS n, bool_and(ok) AS ok, max(z) AS last FROM f GROUP BY ALL)
SELECT s.media_id, s.seg_id, coalesce(ok, false) AND n = len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AND last <= end_ms + 350 AS valid FROM segments s LEFT JOIN p USING (media_id, seg_id)""")  # fmt: skip
def _(t):
    s = F.col("seg_id")
    words = S.word_times(t.segments).where("NOT (seg_id % 7 = 0 AND pos = 2)").withColumns(
        {"t0_ms": F.col("t0_ms") - F.when((F.col("pos") == 5) & (s % 4 == 0), 4000).otherwise(0), "t1_ms": F.col("t1_ms") + F.when(s % 5 == 0, 400).otherwise(0)}
    )
    return M.validate_alignment(words, t.segments)


@query("e18_acoustic_align", "frames", """
, fr AS (SELECT media_id, idx, rms * (CASE idx // 60 % 4 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END) AS rms FROM frames),
sg AS (SELECT media_id, idx AS seg_id, idx * 10 AS a, idx * 10 + CASE WHEN idx % 4 = 1 THEN 1900 WHEN idx % 200 = 3 THEN 320 ELSE 1100 END AS z,
  CASE idx // 50 % 5 WHEN 0 THEN ['one'] WHEN 1 THEN ['one', 'two'] WHEN 2 THEN ['one', 'two', 'three', 'four'] WHEN 3 THEN ['a', 'b', 'c', 'd', 'e', 'f', 'g'] ELSE CAST([] AS VARCHAR[]) END AS ws FROM frames WHERE idx % 50 = 3),
i AS (SELECT media_id, seg_id, idx * 10 AS ms, rms, max(rms) OVER (PARTITION BY media_id, seg_id) AS peak FROM sg JOIN fr USING (media_id) WHERE idx * 10 >= a AND idx * 10 < z),
x AS (SELECT media_id, seg_id, max(peak) AS peak, min(ms) AS lo, max(ms) + 10 AS hi FROM i WHERE rms >= greatest(0.003::DOUBLE, 0.08::DOUBLE * peak) GROUP BY ALL),
b AS (SELECT sg.*, len(ws) AS n, coalesce(peak, 0) AS peak, coalesce(peak, 0) >= 0.01 AS heard, lo, greatest(50, hi - lo) AS act, greatest(50, z - a) AS clip FROM sg LEFT JOIN x USING (media_id, seg_id)),
p AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN NOT heard THEN 15 ELSE least(99, CASE WHEN peak >= 0.08 THEN 35 WHEN peak >= 0.03 THEN 25 ELSE 10 END
  + CASE WHEN n = 1 THEN 40 WHEN n = 2 THEN 30 WHEN n <= 4 THEN 15 ELSE 5 END + CASE WHEN 100 * act BETWEEN 20 * clip AND 95 * clip THEN 25 ELSE 5 END) END AS pts FROM b),
m AS (SELECT *, CASE WHEN n = 0 THEN 'acoustic_empty' WHEN heard AND pts >= 70 AND (z - a <= 1200 AND n <= 4 OR z - a <= 1800 AND n <= 2) THEN 'acoustic_high_conf' ELSE 'acoustic_low_conf' END AS method,
  CASE WHEN heard THEN lo ELSE a END AS s0, CASE WHEN heard THEN act ELSE z - a END AS span FROM p),
w AS (SELECT *, unnest(CASE WHEN n = 0 THEN [NULL] ELSE range(n) END) AS pos FROM m)
SELECT media_id, seg_id, pos, ws[pos + 1] AS word, pts AS confidence_pct, method, s0 + (2 * pos * span + n) // (2 * n) AS t0_ms, s0 + (2 * (pos + 1) * span + n) // (2 * n) AS t1_ms FROM w""")  # fmt: skip
def _(t):
    i = F.col("idx")
    turn, kind = F.floor(i / 60) % 4, F.floor(i / 50) % 5
    frames = t.frames.select("media_id", "idx", (F.col("rms") * F.when(turn == 0, 0.05).when(turn == 1, 0.4).otherwise(1.0)).alias("rms"))
    lo = (i * 10).cast("long")
    text = F.when(kind == 0, "one").when(kind == 1, "one  two").when(kind == 2, " one two three four").when(kind == 3, "a b c d e f g").otherwise(" ")
    long = F.when(i % 4 == 1, 1900).when(i % 200 == 3, 320).otherwise(1100)
    segs = t.frames.where("idx % 50 = 3").select("media_id", i.alias("seg_id"), lo.alias("start_ms"), (lo + long).alias("end_ms"), text.alias("text"))
    return M.acoustic_align(frames, segs)


@query("f3_snap_range", "segments", """
, w AS (SELECT media_id, seg_id AS req, start_ms + 700 AS a, end_ms + 300 AS z FROM segments WHERE seg_id % 2 = 1),
n AS (SELECT w.*, (SELECT arg_min(s.start_ms, abs(s.start_ms - w.a) * 1000000 + s.seg_id) FROM segments s WHERE s.media_id = w.media_id) AS na FROM w),
e AS (SELECT n.*, (SELECT min(s.end_ms) FROM segments s WHERE s.media_id = n.media_id AND s.end_ms >= greatest(n.z, n.na + 15000)) AS one,
  (SELECT max(s.end_ms) FROM segments s WHERE s.media_id = n.media_id AND s.end_ms <= n.na + 60000) AS two FROM n)
SELECT media_id, req, na AS new_a_ms, coalesce(CASE WHEN one <= na + 60000 THEN one WHEN two > na THEN two END, na + 60000) AS new_z_ms FROM e""")  # fmt: skip
def _(t):
    wanted = t.segments.where("seg_id % 2 = 1").select("media_id", F.col("seg_id").alias("req"), (F.col("start_ms") + 700).alias("a_ms"), (F.col("end_ms") + 300).alias("z_ms"))
    return M.snap_range(t.segments, wanted, 15_000, 60_000)
