"""Translation memory, checkpoints, resuming, merging of results, validation and repair of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION = "1"


def tm_key(text: Column, lang: Column, provider: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.trim(text), F.lower(F.trim(lang)), F.lower(F.trim(provider)), F.lit(VERSION)), 256)


def tm_lookup(segs: DataFrame, tm: DataFrame, lang: str, provider: str) -> DataFrame:
    """segs with tm_text where the memory(cache_key, translated_text) has it. Distinct keys meet the memory once; the hits
    fan out to all equal texts."""
    keyed = segs.withColumn("cache_key", tm_key(F.col("text"), F.lit(lang), F.lit(provider)))
    hits = keyed.select("cache_key").distinct().join(tm.select("cache_key", F.col("translated_text").alias("tm_text")), "cache_key")
    return keyed.join(hits, "cache_key", "left")


def tm_upsert(tm: DataFrame, new: DataFrame) -> DataFrame:
    """new(cache_key, translated_text, at): the last text wins, the first creation time stays."""
    last = new.groupBy("cache_key").agg(F.max_by("translated_text", "at").alias("_text"), F.min("at").alias("_at"))
    both = tm.join(last, "cache_key", "full")
    return both.select("cache_key", F.coalesce("_text", "translated_text").alias("translated_text"), F.coalesce("created_at", "_at").alias("created_at"))


def take_checkpoint(batches: DataFrame, saved: DataFrame) -> DataFrame:
    """batches(media_id, batch, seg_id, text): a batch is reused if every row has a saved row with the same text."""
    kept = saved.select("media_id", "seg_id", F.col("text").alias("_saved"), F.col("text_vi").alias("saved_vi"))
    both = batches.join(kept, ["media_id", "seg_id"], "left").withColumn("_hit", F.coalesce(F.col("_saved") == F.col("text"), F.lit(False)))
    whole = both.groupBy("media_id", "batch").agg(F.bool_and("_hit").alias("reused"), F.count("*").alias("n"))
    return whole


def pending(items: DataFrame, state: DataFrame, key: str, retry: bool = False) -> DataFrame:
    """Items not yet successful (all, if retry), with the status they had."""
    done = state.where("status = 'success'") if not retry else state.limit(0)
    left = items.join(done.select(key), key, "left_anti")
    return left.join(state.select(key, F.col("status").alias("_was")), key, "left").withColumn("status", F.coalesce("_was", F.lit("waiting"))).drop("_was")


def merge_translations(batch: DataFrame, returned: DataFrame) -> DataFrame:
    """batch(media_id, batch, seg_id), returned(media_id, batch, pos, seg_id or null, text_vi): by id; by position in
    batches that came back without any id and with equal counts. Rows without a translation are marked missing."""
    key = ["media_id", "batch"]
    info = returned.groupBy(*key).agg(F.count("seg_id").alias("_ids"), F.count("*").alias("_n"))
    size = batch.groupBy(*key).agg(F.count("*").alias("_size"))
    mode = info.join(size, key).select(*key, ((F.col("_ids") == 0) & (F.col("_n") == F.col("_size"))).alias("_by_pos"))
    numbered = batch.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy("seg_id"))).join(mode, key, "left")
    by_id = returned.where("seg_id IS NOT NULL").groupBy(*key, "seg_id").agg(F.max_by("text_vi", "pos").alias("_a"))
    by_pos = returned.where("seg_id IS NULL").select(*key, "pos", F.col("text_vi").alias("_b"))
    told = numbered.join(by_id, [*key, "seg_id"], "left").join(by_pos, [*key, "pos"], "left")
    text = F.coalesce("_a", F.when(F.coalesce("_by_pos", F.lit(False)), F.col("_b")))
    return told.select(*key, "seg_id", text.alias("text_vi"), text.isNull().alias("missing"))


def resolve_voice(segs: DataFrame, speakers: DataFrame, default: str) -> DataFrame:
    """Override of the segment, else the speaker's voice, else the default. speakers(media_id, speaker, speaker_voice)."""
    both = segs.join(speakers, ["media_id", "speaker"], "left")
    return both.withColumn("voice", F.coalesce(F.nullif("override", F.lit("")), "speaker_voice", F.lit(default)))


def apply_fixes(segs: DataFrame, fixes: DataFrame) -> DataFrame:
    """fixes(media_id, seg_id, fix): the text is replaced where a non-empty fix exists."""
    both = segs.join(fixes, ["media_id", "seg_id"], "left")
    return both.withColumns({"text_vi": F.coalesce(F.nullif(F.trim("fix"), F.lit("")), "text_vi"), "fixed": F.coalesce(F.trim("fix") != "", F.lit(False))}).drop("fix")


def backfill(translated: DataFrame, original: DataFrame) -> DataFrame:
    """Missing times, text and speaker from the original by id."""
    names = ["start_ms", "end_ms", "text", "speaker"]
    old = original.select("media_id", "seg_id", *[F.col(c).alias(f"_{c}") for c in names])
    both = translated.join(old, ["media_id", "seg_id"], "left")
    return both.withColumns({c: F.coalesce(c, f"_{c}") for c in names}).drop(*[f"_{c}" for c in names])


def validate_transcript(rows: DataFrame, original: DataFrame) -> DataFrame:
    """rows(media_id, seg_id, start, end as text, text_vi) with the first reason to reject, null for good ones."""
    counts = original.groupBy("media_id").agg(F.count("*").alias("_want"))
    n = F.count("*").over(Window.partitionBy("media_id"))
    told = rows.withColumn("_n", n).join(counts, "media_id", "left")
    numeric = F.expr("try_cast(start AS DOUBLE)").isNotNull() & F.expr("try_cast(`end` AS DOUBLE)").isNotNull()
    reason = F.when(F.col("_n") != F.coalesce("_want", F.lit(0)), "count").when(~numeric, "timing")
    reason = reason.when(F.coalesce(F.trim("text_vi"), F.lit("")) == "", "empty")
    return told.withColumn("reason", reason).drop("_n", "_want")


def divide(told: DataFrame, folder: str, run: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``reason`` (null for good ones) into two tables, accepted rows and quarantine with reasons, by one scan and
    one write. The run's folder is replaced if the run is done again."""
    spark, path = told.sparkSession, f"{folder.rstrip('/')}/run={run}"
    told.withColumn("_sink", F.when(F.col("reason").isNull(), "accepted").otherwise("quarantine")).write.partitionBy("_sink").mode("overwrite").parquet(path)
    written = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in told.dtypes)}, _sink string").parquet(path)
    return written.where("_sink = 'accepted'").drop("_sink", "reason"), written.where("_sink = 'quarantine'").drop("_sink")


def validate_media(probes: DataFrame, least_bytes: int = 1024, audio: bool = True) -> DataFrame:
    """probes(id, bytes, format_s, stream_s, width, height, has_video, has_audio): first failing rule."""
    length = F.coalesce(F.when(F.col("format_s") > 0, F.col("format_s")), F.col("stream_s"))
    r = F.when(F.coalesce("bytes", F.lit(0)) < least_bytes, "too_small").when(F.col("has_video").isNull(), "malformed")
    r = r.when(F.coalesce(length, F.lit(0.0)) <= 0.05, "no_duration").when(~F.col("has_video"), "no_video")
    r = r.when((F.col("width") <= 0) | (F.col("height") <= 0), "no_size")
    return probes.withColumn("reason", r.when(F.lit(audio) & ~F.coalesce("has_audio", F.lit(False)), "no_audio"))


def heal(cache: DataFrame) -> DataFrame:
    """Cache rows(key, segments array of structs) whose elements all have start, end and text."""
    return cache.where(F.forall("segments", lambda s: s["start"].isNotNull() & s["end"].isNotNull() & s["text"].isNotNull()))


def apply_edits(segs: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(media_id, seg_id, kind, arg): ``merge`` joins a segment to the one before; ``split`` cuts it at arg ms, text
    by the share of words. Merges first, numbered anew. A chain of merges is one group."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "seg_id")
    both = segs.join(edits, ["media_id", "seg_id"], "left")
    head = both.withColumn("_g", F.sum(F.when(F.col("kind") == "merge", 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "seg_id", "text"))), lambda x: x["text"]), " ")
    cut = F.min(F.when(F.col("kind") == "split", F.col("arg")))
    merged = head.groupBy("media_id", "_g").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), text.alias("text"), cut.alias("cut"))
    words = F.split(F.trim("text"), r"\s+")
    n = F.greatest(F.lit(1), F.floor(F.size(words) * (F.col("cut") - F.col("s")) / (F.col("e") - F.col("s"))).cast("int"))
    split = (F.col("cut") > F.col("s")) & (F.col("cut") < F.col("e")) & (F.size(words) > 1)
    piece = lambda a, b, t: F.struct(a.alias("start_ms"), b.alias("end_ms"), t.alias("text"))
    two = F.array(
        piece(F.col("s"), F.col("cut").cast("long"), F.array_join(F.slice(words, 1, n), " ")),
        piece(F.col("cut").cast("long"), F.col("e"), F.array_join(F.slice(words, n + 1, F.size(words)), " ")),
    )
    one = F.array(piece(F.col("s"), F.col("e"), F.col("text")))
    out = merged.select("media_id", F.explode(F.when(split, two).otherwise(one)).alias("p")).select("media_id", "p.*")
    return out.withColumn("seg_id", F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "end_ms")))
