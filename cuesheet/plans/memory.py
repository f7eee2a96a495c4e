"""Queries of translation memory, resuming and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as M
from .registry import query

KEY = "sha256(trim(text) || chr(31) || 'vi' || chr(31) || 'm1' || chr(31) || '1')"


def _key(c="text"):
    return M.tm_key(F.col(c), F.lit("VI "), F.lit("M1"))


@query("c8_tm_lookup", "segments", f"""
, tm AS (SELECT DISTINCT {KEY} AS k, 'tr:' || trim(text) AS tr FROM segments WHERE (media_id + seg_id) % 3 = 0)
SELECT media_id, seg_id, tr AS tm_text FROM (SELECT *, {KEY} AS k FROM segments) s LEFT JOIN tm USING (k)""")  # fmt: skip
def _(t):
    tm = t.segments.where("(media_id + seg_id) % 3 = 0").select(_key().alias("cache_key"), F.concat(F.lit("tr:"), F.trim("text")).alias("translated_text")).distinct()
    return M.tm_lookup(t.segments, tm, " vi", "m1").select("media_id", "seg_id", "tm_text")


@query("c9_tm_upsert", "ledger", """
, old AS (SELECT fingerprint AS cache_key, 'old' || fingerprint AS tx, CAST(7 AS BIGINT) AS c FROM ledger WHERE event_id % 2 = 0 GROUP BY fingerprint),
new AS (SELECT fingerprint AS cache_key, arg_max('t' || delta, event_id) AS tx, min(event_id) AS c FROM ledger WHERE event_id % 50 = 1 GROUP BY fingerprint)
SELECT coalesce(old.cache_key, new.cache_key) AS cache_key, coalesce(new.tx, old.tx) AS translated_text, coalesce(old.c, new.c) AS created_at FROM old FULL JOIN new USING (cache_key)""")  # fmt: skip
def _(t):
    k = F.col("fingerprint").alias("cache_key")
    old = t.ledger.where("event_id % 2 = 0").select(k, F.concat(F.lit("old"), "fingerprint").alias("translated_text"), F.lit(7).cast("long").alias("created_at")).distinct()
    new = t.ledger.where("event_id % 50 = 1").select(k, F.concat(F.lit("t"), F.col("delta").cast("string")).alias("translated_text"), F.col("event_id").alias("at"))
    return M.tm_upsert(old, new)


@query("c10_take_checkpoint", "segments", """
, b AS (SELECT media_id, CAST(seg_id // 3 AS BIGINT) AS batch, seg_id, text FROM segments), s AS (SELECT media_id, seg_id, CASE WHEN (media_id + seg_id) % 9 = 0 THEN 'x' ELSE text END AS st FROM segments WHERE (media_id + seg_id) % 14 <> 0)
SELECT b.media_id, batch, bool_and(coalesce(st = text, false)) AS reused, count(*) AS n FROM b LEFT JOIN s ON s.media_id = b.media_id AND s.seg_id = b.seg_id GROUP BY ALL""")  # fmt: skip
def _(t):
    m = F.col("media_id") + F.col("seg_id")
    batches = t.segments.select("media_id", F.floor(F.col("seg_id") / 3).alias("batch"), "seg_id", "text")
    saved = t.segments.where(m % 14 != 0).select("media_id", "seg_id", F.when(m % 9 == 0, "x").otherwise(F.col("text")).alias("text"), "text_vi")
    return M.take_checkpoint(batches, saved)


@query("c11_pending", "paid_orders", """
, s AS (SELECT order_code, CASE WHEN order_code % 3 = 0 THEN 'success' ELSE 'failed' END AS st FROM paid_orders WHERE order_code % 2 = 0)
SELECT p.order_code, coalesce(st, 'waiting') AS status FROM paid_orders p LEFT JOIN s ON s.order_code = p.order_code WHERE coalesce(st, '') <> 'success'""")  # fmt: skip
def _(t):
    c = F.col("order_code")
    state = t.paid_orders.where(c % 2 == 0).select("order_code", F.when(c % 3 == 0, "success").otherwise("failed").alias("status"))
    return M.pending(t.paid_orders.select("order_code"), state, "order_code")


@query("c7_merge_translations", "segments", """
, b AS (SELECT media_id, CAST(seg_id // 4 AS BIGINT) AS batch, seg_id, text_vi, row_number() OVER (PARTITION BY media_id, seg_id // 4 ORDER BY seg_id) AS pos FROM segments)
SELECT media_id, batch, seg_id, CASE WHEN media_id % 3 = 0 THEN text_vi WHEN seg_id % 5 = 0 THEN NULL ELSE text_vi END AS text_vi, media_id % 3 <> 0 AND seg_id % 5 = 0 AS missing FROM b""")  # fmt: skip
def _(t):
    from pyspark.sql import Window

    b = t.segments.select("media_id", F.floor(F.col("seg_id") / 4).alias("batch"), "seg_id", "text_vi")
    pos = b.withColumn("pos", F.row_number().over(Window.partitionBy("media_id", "batch").orderBy("seg_id")))
    returned = pos.where((F.col("media_id") % 3 == 0) | (F.col("seg_id") % 5 != 0)).withColumn("seg_id", F.when(F.col("media_id") % 3 != 0, F.col("seg_id")))
    return M.merge_translations(b.drop("text_vi"), returned)


@query("c13_resolve_voice", "segments", """
SELECT media_id, seg_id, CASE WHEN seg_id % 4 = 0 THEN 'own' WHEN speaker = 'user' THEN 'v' || media_id % 3 ELSE 'default' END AS voice FROM segments""")  # fmt: skip
def _(t):
    override = F.when(F.col("seg_id") % 4 == 0, "own").when(F.col("seg_id") % 4 == 1, "")
    voices = t.segments.where("speaker = 'user'").select("media_id", "speaker", F.concat(F.lit("v"), (F.col("media_id") % 3).cast("string")).alias("speaker_voice")).distinct()
    return M.resolve_voice(t.segments.withColumn("override", override), voices, "default").select("media_id", "seg_id", "voice")


@query("c20_apply_fixes", "segments", """
SELECT media_id, seg_id, CASE WHEN seg_id % 3 = 0 THEN 'fixed ' || seg_id ELSE text_vi END AS text_vi, seg_id % 3 = 0 AS fixed FROM segments""")  # fmt: skip
def _(t):
    s = F.col("seg_id")
    fixes = t.segments.where(s % 3 != 1).select("media_id", "seg_id", F.when(s % 3 == 0, F.concat(F.lit(" fixed "), s.cast("string"))).otherwise(" ").alias("fix"))
    return M.apply_fixes(t.segments, fixes).select("media_id", "seg_id", "text_vi", "fixed")


@query("a4_backfill", "segments", """
SELECT media_id, seg_id, start_ms, end_ms, CASE WHEN seg_id % 2 = 0 THEN text ELSE 'new' END AS text, speaker FROM segments""")  # fmt: skip
def _(t):
    s = F.col("seg_id")
    gone = t.segments.select(
        "media_id", "seg_id", F.when(s % 3 == 0, F.col("start_ms")).alias("start_ms"), F.when(s % 4 == 0, F.col("end_ms")).alias("end_ms"),
        F.when(s % 2 == 1, "new").alias("text"), F.lit(None).cast("string").alias("speaker"),
    )
    return M.backfill(gone, t.segments).select("media_id", "seg_id", "start_ms", "end_ms", "text", "speaker")


@query("b7_validate_transcript", "segments", """
SELECT media_id, seg_id, CASE WHEN media_id % 5 = 0 THEN 'count' WHEN seg_id % 4 = 0 THEN 'timing' WHEN seg_id % 3 = 0 THEN 'empty' END AS reason FROM segments WHERE NOT (media_id % 5 = 0 AND seg_id = 1)""")  # fmt: skip
def _(t):
    s = F.col("seg_id")
    rows = t.segments.where("NOT (media_id % 5 = 0 AND seg_id = 1)").select(
        "media_id", "seg_id", F.when(s % 4 == 0, "x1").otherwise(F.col("start_ms").cast("string")).alias("start"), F.col("end_ms").cast("string").alias("end"),
        F.when(s % 3 == 0, "  ").otherwise(F.col("text_vi")).alias("text_vi"),
    )
    return M.validate_transcript(rows, t.segments).select("media_id", "seg_id", "reason")


@query("b8_validate_media", "", """
SELECT doc_id, CASE WHEN n_chars < 200 THEN 'too_small' WHEN doc_id % 11 = 0 THEN 'malformed' WHEN doc_id % 7 = 0 THEN 'no_duration' WHEN doc_id % 5 = 0 THEN 'no_video' WHEN doc_id % 3 = 0 THEN 'no_size'
  WHEN doc_id % 2 = 0 THEN 'no_audio' END AS reason FROM documents""")  # fmt: skip
def _(t):
    d = F.col("doc_id")
    probes = t.documents.select(
        "doc_id", F.col("n_chars").alias("bytes"), F.when(d % 2 == 0, 0.0).when(d % 7 != 0, 5.0).alias("format_s"), F.when(d % 7 == 0, 0.01).otherwise(4.0).alias("stream_s"),
        F.when(d % 11 != 0, d % 5 != 0).alias("has_video"), F.when(d % 3 == 0, 0).otherwise(640).alias("width"), F.lit(360).alias("height"), (d % 2 == 1).alias("has_audio"),
    )
    return M.validate_media(probes, 200).select("doc_id", "reason")


@query("b9_heal", "segments", """
SELECT media_id AS key, count(*) AS n FROM segments GROUP BY media_id HAVING bool_and((media_id + seg_id) % 17 <> 0)""")  # fmt: skip
def _(t):
    bad = (F.col("media_id") + F.col("seg_id")) % 17 == 0
    cache = t.segments.groupBy(F.col("media_id").alias("key")).agg(F.collect_list(F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.when(~bad, F.col("text")).alias("text"))).alias("segments"))
    return M.heal(cache).select("key", F.size("segments").cast("long").alias("n"))


@query("b14_apply_edits", "segments", """
, g AS (SELECT *, sum(CASE WHEN seg_id % 3 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start_ms, seg_id ROWS UNBOUNDED PRECEDING) AS g FROM segments),
m AS (SELECT media_id, min(start_ms) AS s, max(end_ms) AS e, string_agg(text, ' ' ORDER BY start_ms, seg_id) AS text, min(CASE WHEN seg_id % 4 = 1 AND seg_id % 3 <> 0 THEN start_ms + 250 END) AS cut FROM g GROUP BY media_id, g),
w AS (SELECT *, regexp_split_to_array(trim(text), '\\s+') AS ws FROM m), k AS (SELECT *, greatest(1, CAST(floor(len(ws) * (cut - s) / (e - s)) AS INT)) AS n, coalesce(cut > s AND cut < e AND len(ws) > 1, false) AS sp FROM w),
o AS (SELECT media_id, s AS start_ms, CASE WHEN sp THEN cut ELSE e END AS end_ms, CASE WHEN sp THEN array_to_string(ws[1:n], ' ') ELSE text END AS text FROM k
  UNION ALL SELECT media_id, cut, e, array_to_string(ws[n + 1:], ' ') FROM k WHERE sp)
SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) AS INT) AS seg_id, start_ms, end_ms, text FROM o""")  # fmt: skip
def _(t):
    s = F.col("seg_id")
    kind = F.when(s % 3 == 0, "merge").when(s % 4 == 1, "split")
    edits = t.segments.select("media_id", "seg_id", kind.alias("kind"), (F.col("start_ms") + 250).alias("arg")).where("kind IS NOT NULL")
    return M.apply_edits(t.segments, edits)
