"""Queries over the segment table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as S
from .registry import query

CPS = 12.0


@query("b1_target_slot", "segments", """
SELECT media_id, seg_id, greatest(300, coalesce(nullif(CASE WHEN seg_id % 3 = 0 THEN 0 WHEN seg_id % 4 = 0 THEN NULL ELSE dur_ms // 3 END, 0),
  nullif(CASE WHEN seg_id % 2 = 0 THEN 0 ELSE dur_ms END, 0), nullif(end_ms - start_ms, 0))) AS slot_ms FROM segments""")  # fmt: skip
def _(t):
    s = F.col("seg_id")
    speech = F.when(s % 3 == 0, 0).when(s % 4 == 0, None).otherwise(F.floor(F.col("dur_ms") / 3))
    duration = F.when(s % 2 == 0, 0).otherwise(F.col("dur_ms"))
    return t.segments.select("media_id", "seg_id", S.resolve_slot(speech, duration, F.col("start_ms"), F.col("end_ms")).alias("slot_ms"))


@query("b2_effective_cps", "segments", """
SELECT DISTINCT media_id, CAST(floor(12.0::DOUBLE * (1 + (media_id % 3) * 0.25::DOUBLE) / least(1.0::DOUBLE, greatest(0.5::DOUBLE, (media_id % 7) * 0.25::DOUBLE)) * 1000 + 0.5) AS BIGINT) AS cps_milli FROM segments""")  # fmt: skip
def _(t):
    m = F.col("media_id")
    cps = S.effective_cps(F.lit(CPS), 1 + m % 3 * 0.25, m % 7 * 0.25)
    return t.segments.select("media_id").distinct().select("media_id", F.floor(cps * 1000 + 0.5).alias("cps_milli"))


@query("b3_max_chars", "segments", """
SELECT media_id, seg_id, greatest(12, CAST(floor(dur_ms * 12.0 / 1000) AS INT)) AS max_chars FROM segments""")  # fmt: skip
def _(t):
    return t.segments.select("media_id", "seg_id", S.max_chars(F.col("dur_ms"), F.lit(CPS)).alias("max_chars"))


@query("b4_terminal_punct", "segments", r"""
, c AS (SELECT media_id, seg_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[,;\-–— ]+$', '') AS c FROM segments)
SELECT media_id, seg_id, CASE WHEN c = '' OR regexp_matches(c, '[.!?…:]$') THEN c ELSE c || '.' END AS text FROM c""")  # fmt: skip
def _(t):
    return t.segments.select("media_id", "seg_id", S.terminal_punct(F.col("text")).alias("text"))


@query("b5_rescale", "segments", """
SELECT media_id, seg_id, CAST(floor(start_ms * 1.25 + 0.5) AS BIGINT) AS start_ms, CAST(floor(end_ms * 1.25 + 0.5) AS BIGINT) AS end_ms FROM segments""")  # fmt: skip
def _(t):
    return S.rescale(t.segments, 1.25, ["start_ms", "end_ms"]).select("media_id", "seg_id", "start_ms", "end_ms")


@query("b6_shift", "segments", """
SELECT media_id, seg_id, greatest(0, start_ms - 700) AS start_ms, greatest(0, end_ms - 700) AS end_ms FROM segments""")  # fmt: skip
def _(t):
    return S.shift(t.segments, -700, ["start_ms", "end_ms"]).select("media_id", "seg_id", "start_ms", "end_ms")


@query("b10_check_edits", "segments", """
, e AS (SELECT media_id, seg_id, start_ms - CASE WHEN seg_id % 4 = 0 THEN 900 ELSE 0 END AS s, CASE WHEN seg_id % 5 = 0 THEN start_ms + 100 ELSE end_ms + CASE WHEN seg_id % 3 = 0 THEN 2500 ELSE 0 END END AS e FROM segments),
n AS (SELECT *, lag(e) OVER w AS b, lead(s) OVER w AS a FROM e WINDOW w AS (PARTITION BY media_id ORDER BY s, seg_id))
SELECT media_id, seg_id, CASE WHEN s < 0 THEN 'negative' WHEN e - s < 200 THEN 'short' WHEN s < b THEN 'overlaps_previous' WHEN e > a THEN 'overlaps_next' END AS problem FROM n""")  # fmt: skip
def _(t):
    s = F.col("seg_id")
    edited = t.segments.withColumns(
        {
            "end_ms": F.when(s % 5 == 0, F.col("start_ms") + 100).otherwise(F.col("end_ms") + F.when(s % 3 == 0, 2500).otherwise(0)),
            "start_ms": F.col("start_ms") - F.when(s % 4 == 0, 900).otherwise(0),
        }
    )
    return S.check_edits(edited).select("media_id", "seg_id", "problem")


@query("e1_slots", "segments", """
SELECT media_id, seg_id, greatest(300, coalesce(lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) - start_ms, end_ms - start_ms + 2000)) AS slot_ms FROM segments""")  # fmt: skip
def _(t):
    return S.annotate_slots(t.segments).select("media_id", "seg_id", "slot_ms")


_CJK = "length(regexp_replace(text, '[^\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]', '', 'g'))"
RATE_SQL = f"""
, r AS (SELECT media_id, seg_id, CASE WHEN end_ms - start_ms >= 500 AND {_CJK} > 0 THEN {_CJK} * 1000 / (end_ms - start_ms) END AS rate FROM segments),
m AS (SELECT *, median(rate) OVER w AS mid, count(rate) OVER w AS n FROM r WINDOW w AS (PARTITION BY media_id))"""


@query("e2_rate_outliers", "segments", RATE_SQL.replace(">= 500", ">= 500 AND true") + """
SELECT media_id, seg_id, coalesce(n >= 1 AND (rate < 0.4 * mid OR rate > 3 * mid), false) AS rate_suspect FROM m""")  # fmt: skip
def _(t):
    return S.flag_rate(t.segments, samples=1).select("media_id", "seg_id", "rate_suspect")


@query("e3_gap_outliers", "segments", """
, g AS (SELECT media_id, seg_id, start_ms, lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) - end_ms AS gap FROM segments),
m AS (SELECT *, median(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY media_id) AS mid FROM g),
f AS (SELECT *, coalesce(gap > greatest(1500, 3 * mid), false) AS wide FROM m)
SELECT media_id, seg_id, gap AS gap_ms, wide OR coalesce(lag(wide) OVER (PARTITION BY media_id ORDER BY start_ms, seg_id), false) AS gap_suspect FROM f""")  # fmt: skip
def _(t):
    return S.flag_gap(t.segments).select("media_id", "seg_id", "gap_ms", "gap_suspect")


FLAG_SQL = """
, s AS (SELECT *, greatest(300, coalesce(lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) - start_ms, end_ms - start_ms + 2000)) AS slot_ms FROM segments),
f AS (SELECT media_id, seg_id, CASE WHEN regexp_matches(text_vi, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]') THEN 'cjk'
  WHEN length(text_vi) > 1.25 * greatest(12, CAST(floor(slot_ms * 12.0 / 1000) AS INT)) THEN 'over_budget'
  WHEN length(text_vi) < 0.25 * length(text) AND length(text) > 20 THEN 'too_short' END AS flag FROM s)"""


@query("h18_review_flags", "segments", FLAG_SQL + " SELECT media_id, seg_id, flag FROM f")
def _(t):
    return S.review_flags(t.segments, CPS).select("media_id", "seg_id", "flag")


@query("d15_review_gate", "segments", FLAG_SQL + """
SELECT media_id, count(*) AS n, count(flag) AS n_flagged, count(*) FILTER (flag = 'cjk') AS n_cjk, count(*) FILTER (flag = 'over_budget') AS n_over_budget,
  count(*) FILTER (flag = 'too_short') AS n_too_short, count(flag) > 0 AND count(flag) <= 0.35 * count(*) AS review FROM f GROUP BY media_id""")  # fmt: skip
def _(t):
    return S.review_gate(S.review_flags(t.segments, CPS))


@query("h1_script_audit", "segments", """
SELECT media_id, count(*) FILTER (regexp_matches(text_vi, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]')) AS wide,
  count(*) FILTER (regexp_matches(text_vi, '[\\x{4E00}-\\x{9FFF}]')) AS base,
  count(*) FILTER (length(regexp_replace(text_vi, '[^\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{3040}-\\x{30FF}]', '', 'g')) >= 2) AS "full" FROM segments GROUP BY media_id""")  # fmt: skip
def _(t):
    return t.segments.groupBy("media_id").agg(*[F.count_if(S.has_cjk(F.col("text_vi"), how)).alias(how) for how in ("wide", "base", "full")])


@query("h8_syllable_load", "segments", r"""
SELECT media_id, seg_id, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS syllables, len(regexp_extract_all(text, '\S+')) * 1000.0 / greatest(dur_ms, 1) > 1.9 AS too_long FROM segments""")  # fmt: skip
def _(t):
    return S.syllable_load(t.segments.withColumn("slot_ms", F.col("dur_ms")), 1.9).select("media_id", "seg_id", "syllables", "too_long")


WORD_SQL = r"""
, w0 AS (SELECT media_id, seg_id, start_ms, end_ms, regexp_split_to_array(trim(text), '\s+') AS ws FROM segments),
w1 AS (SELECT media_id, seg_id, start_ms, end_ms, i - 1 AS pos, ws[i] AS word, len(ws) AS k FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w0)),
w2 AS (SELECT *, CASE WHEN pos = k - 1 THEN 10 WHEN regexp_matches(word, '[.!?…]$') THEN 19 WHEN regexp_matches(word, '[,;:]$') THEN 15 ELSE 10 END AS wt FROM w1 WHERE word <> ''),
w3 AS (SELECT *, sum(wt) OVER (PARTITION BY media_id, seg_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto, sum(wt) OVER (PARTITION BY media_id, seg_id) AS tot FROM w2),
words AS (SELECT media_id, seg_id, pos, word, CAST(start_ms + (end_ms - start_ms) * (upto - wt) // tot AS BIGINT) AS t0_ms, CAST(start_ms + (end_ms - start_ms) * upto // tot AS BIGINT) AS t1_ms FROM w3)"""


@query("e11_word_times", "segments", WORD_SQL + " SELECT media_id, seg_id, CAST(pos AS INT) AS pos, word, t0_ms, t1_ms FROM words")
def _(t):
    return S.word_times(t.segments).drop("span_ms")


@query("e12_chunk_words", "segments", WORD_SQL + """
, i AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?…,;:]$') THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, seg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM words),
p AS (SELECT *, (row_number() OVER (PARTITION BY media_id, seg_id, island ORDER BY pos) - 1) // 4 AS part FROM i)
SELECT media_id, seg_id, CAST(min(pos) AS INT) AS first_pos, count(*) AS n_words, string_agg(word, ' ' ORDER BY pos) AS text, min(t0_ms) AS t0_ms, max(t1_ms) AS t1_ms FROM p GROUP BY media_id, seg_id, island, part""")  # fmt: skip
def _(t):
    return S.chunk_words(S.word_times(t.segments)).drop("island", "part")


@query("e19_context", "segments", """
SELECT media_id, seg_id, coalesce(string_agg(text, ' ') OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(text, ' ') OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, seg_id)""")  # fmt: skip
def _(t):
    return S.context(t.segments).select("media_id", "seg_id", "before", "after")


@query("e20_plan_batches", "segments", """
, n AS (SELECT media_id, seg_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) - 1 AS rn, count(*) OVER (PARTITION BY media_id) AS n FROM segments),
b AS (SELECT *, (n + 2) // 3 AS b FROM n), c AS (SELECT *, n // b AS base, n % b AS ex FROM b)
SELECT media_id, seg_id, CASE WHEN rn < ex * (base + 1) THEN rn // (base + 1) ELSE ex + (rn - ex * (base + 1)) // base END AS batch FROM c""")  # fmt: skip
def _(t):
    return S.plan_batches(t.segments, 3).select("media_id", "seg_id", "batch")


@query("e21_sample_lines", "segments", """
, n AS (SELECT media_id, seg_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) - 1 AS rn, count(*) OVER (PARTITION BY media_id) AS n FROM segments)
SELECT media_id, seg_id FROM n WHERE n <= 6 OR rn < 2 OR rn BETWEEN n // 2 - 1 AND n // 2 OR rn >= n - 2""")  # fmt: skip
def _(t):
    return S.sample_lines(t.segments, 6).select("media_id", "seg_id")


@query("c16_side_by_side", "segments", """
, o AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) AS row, text, end_ms - start_ms AS ms FROM segments),
v AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) AS row, text_vi, end_ms - start_ms AS ms FROM segments WHERE seg_id % 6 <> 0)
SELECT coalesce(o.media_id, v.media_id) AS media_id, CAST(coalesce(o.row, v.row) AS INT) AS row, text AS text_shown, text_vi AS text_vi_shown,
  CAST(floor(length(text_vi) * 10000 / greatest(100, coalesce(v.ms, o.ms))) AS BIGINT) AS cps_tenths FROM o FULL JOIN v ON o.media_id = v.media_id AND o.row = v.row""")  # fmt: skip
def _(t):
    return S.side_by_side(t.segments, t.segments.where("seg_id % 6 <> 0")).select("media_id", "row", "text_shown", "text_vi_shown", "cps_tenths")


DUB_SQL = """
, s AS (SELECT *, greatest(300, coalesce(lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) - start_ms, end_ms - start_ms + 2000)) AS slot_ms, dur_ms * (60 + media_id * 7 % 90) // 100 AS dub_ms FROM segments),
g AS (SELECT *, dub_ms - slot_ms AS diff_ms, CASE WHEN dub_ms - slot_ms > greatest({floor}, slot_ms * 3 // 10) THEN 'TOO_LONG' WHEN dub_ms - slot_ms < -greatest({floor}, slot_ms * 3 // 10) THEN 'TOO_SHORT' ELSE 'OK' END AS verdict FROM s)"""


def _dubbed(t):
    return S.annotate_slots(t.segments).withColumn("dub_ms", F.floor(F.col("dur_ms") * (60 + F.col("media_id") * 7 % 90) / 100))


@query("d8_timing_guide", "segments", DUB_SQL.format(floor=200) + " SELECT media_id, seg_id, diff_ms, verdict FROM g")
def _(t):
    return S.timing_guide(_dubbed(t)).select("media_id", "seg_id", "diff_ms", "verdict")


@query("d8_timing_totals", "segments", DUB_SQL.format(floor=0) + """
SELECT media_id, count(*) FILTER (verdict = 'OK') AS ok, count(*) FILTER (verdict = 'TOO_LONG') AS too_long, count(*) FILTER (verdict = 'TOO_SHORT') AS too_short,
  CAST(sum(dub_ms) * 1000 // sum(slot_ms) AS BIGINT) AS ratio_milli FROM g GROUP BY media_id""")  # fmt: skip
def _(t):
    told = S.timing_guide(_dubbed(t), floor_ms=0)
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("OK", "TOO_LONG", "TOO_SHORT")]
    return told.groupBy("media_id").agg(*counts, F.floor(F.sum("dub_ms") * 1000 / F.sum("slot_ms")).alias("ratio_milli"))


@query("d9_session_report", "segments", DUB_SQL.format(floor=200) + """
SELECT media_id, CAST(sum(dur_ms) AS BIGINT) AS original_ms, CAST(sum(dub_ms) AS BIGINT) AS dubbed_ms, count(*) FILTER (dub_ms > slot_ms) AS adjusted FROM g GROUP BY media_id""")  # fmt: skip
def _(t):
    return _dubbed(t).groupBy("media_id").agg(F.sum("dur_ms").alias("original_ms"), F.sum("dub_ms").alias("dubbed_ms"), F.count_if(F.col("dub_ms") > F.col("slot_ms")).alias("adjusted"))


@query("d7_quality_report", "segments", DUB_SQL.format(floor=200) + """
, q AS (SELECT *, length(text_vi) > 1.25 * greatest(12, CAST(floor(slot_ms * 12.0 / 1000) AS INT)) AS over_budget, dub_ms > slot_ms AS overlap, dub_ms * 100 > slot_ms * 115 AS tempo FROM g)
SELECT media_id, count(*) AS n, count(*) FILTER (over_budget) AS over_budget, count(*) FILTER (overlap) AS overlaps, count(*) FILTER (tempo) AS tempo, max(greatest(0, diff_ms)) AS worst_ms,
  count(*) FILTER (over_budget OR overlap OR tempo) AS issues FROM q GROUP BY media_id""")  # fmt: skip
def _(t):
    over = F.length("text_vi") > 1.25 * S.max_chars(F.col("slot_ms"), F.lit(CPS))
    late, tempo = F.col("dub_ms") > F.col("slot_ms"), F.col("dub_ms") * 100 > F.col("slot_ms") * 115
    return _dubbed(t).groupBy("media_id").agg(
        F.count("*").alias("n"), F.count_if(over).alias("over_budget"), F.count_if(late).alias("overlaps"), F.count_if(tempo).alias("tempo"),
        F.max(F.greatest(F.lit(0), F.col("dub_ms") - F.col("slot_ms"))).alias("worst_ms"), F.count_if(over | late | tempo).alias("issues"),
    )


@query("d10_speaker_profiles", "segments", """
, p AS (SELECT media_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, count(*) AS n, min(start_ms) AS lo, max(end_ms) AS hi FROM segments GROUP BY ALL),
m AS (SELECT *, sum(total_ms) OVER w AS t, min(lo) OVER w AS a, max(hi) OVER w AS b FROM p WINDOW w AS (PARTITION BY media_id))
SELECT media_id, speaker, total_ms, n, CAST(floor(total_ms / t * 100) AS BIGINT) AS share_pct, CAST(floor((hi - lo) / greatest(b - a, 1) * 100) AS BIGINT) AS cover_pct,
  total_ms / t >= 0.35 AND (hi - lo) / greatest(b - a, 1) >= 0.60 AND n >= 2 AS narrator FROM m""")  # fmt: skip
def _(t):
    return S.profile_speakers(t.segments)


@query("a6_srt_bodies", "segments", """
, c AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) AS rn, start_ms AS s, end_ms AS e, text FROM segments)
SELECT media_id, string_agg(rn || chr(10) || printf('%02d:%02d:%02d,%03d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000) || ' --> ' ||
  printf('%02d:%02d:%02d,%03d', e // 3600000, e // 60000 % 60, e // 1000 % 60, e % 1000) || chr(10) || text || chr(10), chr(10) ORDER BY rn) AS body FROM c GROUP BY media_id""")  # fmt: skip
def _(t):
    return S.srt_bodies(t.segments)


@query("a7_bilingual_script", "segments", """
SELECT media_id, string_agg(text || chr(10) || text_vi, chr(10) || chr(10) ORDER BY start_ms, seg_id) AS body FROM segments GROUP BY media_id""")  # fmt: skip
def _(t):
    return S.script(t.segments, True)
