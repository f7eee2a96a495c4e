"""Operators on transcript segments: slots, budgets, outliers, word times, context, edits, checks.

Times are whole milliseconds. A segment table has (media_id, seg_id, start_ms, end_ms, ...); all orders are explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Code point ranges of the three audits of left-over script.
CJK_BASE = "\\u4E00-\\u9FFF"
CJK_WIDE = "\\u3400-\\u4DBF\\u4E00-\\u9FFF"
CJK_FULL = "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\u3040-\\u30FF"


def media() -> WindowSpec:
    return Window.partitionBy("media_id")


def in_order() -> WindowSpec:
    return media().orderBy("start_ms", "seg_id")


def nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def resolve_slot(speech: Column, duration: Column, start: Column, end: Column, least: int = 300) -> Column:
    """Speech duration, else duration, else end - start; zero counts as missing; at least ``least``."""
    found = F.coalesce(nonzero(speech), nonzero(duration), nonzero(end - start))
    return F.when(found.isNotNull(), F.greatest(F.lit(least), found))


def effective_cps(cps: Column, voice_speed: Column, video_speed: Column) -> Column:
    """Characters per second; the video speed is clamped to 0.5 .. 1.0."""
    return cps * voice_speed / F.greatest(F.lit(0.5), F.least(F.lit(1.0), video_speed))


def max_chars(window_ms: Column, cps: Column, least: int = 12) -> Column:
    return F.greatest(F.lit(least), F.floor(window_ms * cps / 1000).cast("int"))


def terminal_punct(text: Column) -> Column:
    """Blanks collapsed; trailing commas, semicolons, dashes and blanks cut; a full stop added unless the text ends well."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_replace(one, r"[,;\-–— ]+$", "")
    return F.when(cut == "", cut).when(cut.rlike("[.!?…:]$"), cut).otherwise(F.concat(cut, F.lit(".")))


def rescale(segs: DataFrame, factor: float, columns: list[str]) -> DataFrame:
    return segs.withColumns({c: F.round(F.col(c) * factor).cast("long") for c in columns})


def shift(segs: DataFrame, ms: int, columns: list[str]) -> DataFrame:
    return segs.withColumns({c: F.greatest(F.lit(0).cast("long"), F.col(c) + ms) for c in columns})


def annotate_slots(segs: DataFrame, tail_ms: int = 2000, least: int = 300) -> DataFrame:
    """Time from a start to the next; the last segment has its duration and a tail."""
    to_next = F.lead("start_ms").over(in_order()) - F.col("start_ms")
    return segs.withColumn("slot_ms", F.greatest(F.lit(least), F.coalesce(to_next, F.col("end_ms") - F.col("start_ms") + tail_ms)).cast("long"))


def cjk_count(text: Column, cls: str = CJK_FULL) -> Column:
    return F.regexp_count(text, F.lit(f"[{cls}]"))


def has_cjk(text: Column, how: str = "wide") -> Column:
    """Three definitions: any of ``wide``, any of ``base``, two or more of ``full``."""
    if how == "full":
        return cjk_count(text) >= 2
    return text.rlike(f"[{CJK_WIDE if how == 'wide' else CJK_BASE}]")


def flag_rate(segs: DataFrame, least_ms: int = 500, samples: int = 5) -> DataFrame:
    """Marks segments whose CJK characters per second are under 0.4 or over 3 times the media's median."""
    measured = F.when((F.col("end_ms") - F.col("start_ms")) >= least_ms, cjk_count(F.col("text"), CJK_WIDE) * 1000 / (F.col("end_ms") - F.col("start_ms")))
    rated = segs.withColumn("rate", F.when(measured > 0, measured))
    stats = rated.withColumns({"mid": F.median("rate").over(media()), "n_rates": F.count("rate").over(media())})
    odd = (F.col("n_rates") >= samples) & ((F.col("rate") < 0.4 * F.col("mid")) | (F.col("rate") > 3 * F.col("mid")))
    return stats.withColumn("rate_suspect", F.coalesce(odd, F.lit(False))).drop("mid", "n_rates")


def flag_gap(segs: DataFrame, least_ms: int = 1500) -> DataFrame:
    """Marks both sides of gaps over ``least_ms`` and over three times the media's median positive gap."""
    gap = F.lead("start_ms").over(in_order()) - F.col("end_ms")
    gaps = segs.withColumn("gap_ms", gap).withColumn("_mid", F.median(F.when(F.col("gap_ms") > 0, F.col("gap_ms"))).over(media()))
    wide = F.coalesce(F.col("gap_ms") > F.greatest(F.lit(least_ms), 3 * F.col("_mid")), F.lit(False))
    marked = gaps.withColumn("_wide", wide)
    return marked.withColumn("gap_suspect", F.col("_wide") | F.coalesce(F.lag("_wide").over(in_order()), F.lit(False))).drop("_mid", "_wide")


def review_flags(segs: DataFrame, cps: float) -> DataFrame:
    """First that holds: cjk, over_budget (more than 1.25 times the budget), too_short (under a quarter of a source of over
    20 characters)."""
    slots = annotate_slots(segs).withColumn("max_chars", max_chars(F.col("slot_ms"), F.lit(cps)))
    n = F.length("text_vi")
    flag = F.when(has_cjk(F.col("text_vi")), "cjk").when(n > 1.25 * F.col("max_chars"), "over_budget")
    return slots.withColumn("flag", flag.when((n < 0.25 * F.length("text")) & (F.length("text") > 20), "too_short"))


def review_gate(flagged: DataFrame, share: float = 0.35) -> DataFrame:
    """Per media: counts by reason, and whether the review goes ahead (not if more than ``share`` is flagged)."""
    counts = [F.count_if(F.col("flag") == f).alias(f"n_{f}") for f in ("cjk", "over_budget", "too_short")]
    per = flagged.groupBy("media_id").agg(F.count("*").alias("n"), F.count("flag").alias("n_flagged"), *counts)
    return per.withColumn("review", (F.col("n_flagged") > 0) & (F.col("n_flagged") <= share * F.col("n")))


def check_edits(segs: DataFrame, least_ms: int = 200) -> DataFrame:
    """Segments with the first broken rule: negative start, too short, overlap with the one before or after."""
    before, after = F.lag("end_ms").over(in_order()), F.lead("start_ms").over(in_order())
    broken = F.when(F.col("start_ms") < 0, "negative").when(F.col("end_ms") - F.col("start_ms") < least_ms, "short")
    broken = broken.when(F.col("start_ms") < before, "overlaps_previous").when(F.col("end_ms") > after, "overlaps_next")
    return segs.withColumn("problem", broken)


def word_times(segs: DataFrame) -> DataFrame:
    """Words with estimated times: shares of the duration by 1 plus a pause weight (.9 after a sentence, .5 after a clause)."""
    words = segs.select("media_id", "seg_id", "start_ms", "end_ms", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "word")).where("word <> ''")
    seg = Window.partitionBy("media_id", "seg_id")
    last = F.row_number().over(seg.orderBy(F.col("pos").desc())) == 1
    weight = F.when(last, 10).when(F.col("word").rlike("[.!?…]$"), 19).when(F.col("word").rlike("[,;:]$"), 15).otherwise(10)
    w = words.withColumn("w", weight).withColumns(
        {"upto": F.sum("w").over(seg.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(seg)}
    )
    span = F.col("end_ms") - F.col("start_ms")

    def at(x: Column) -> Column:
        return F.col("start_ms") + F.expr("(end_ms - start_ms)") * x / F.col("all")

    return w.select(
        "media_id", "seg_id", "pos", "word", F.floor(at(F.col("upto") - F.col("w"))).alias("t0_ms"), F.floor(at(F.col("upto"))).alias("t1_ms"), span.alias("span_ms")
    )


def chunk_words(words: DataFrame, n: int = 4) -> DataFrame:
    """Chunks of at most n words that also end after punctuation: islands by punctuation, then n at a time inside."""
    seg = Window.partitionBy("media_id", "seg_id").orderBy("pos")
    ends = F.col("word").rlike("[.!?…,;:]$").cast("int")
    island = F.coalesce(F.sum(ends).over(seg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = words.withColumn("island", island)
    rn = F.row_number().over(Window.partitionBy("media_id", "seg_id", "island").orderBy("pos"))
    marked = marked.withColumn("part", F.floor((rn - 1) / n))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return marked.groupBy("media_id", "seg_id", "island", "part").agg(
        F.min("pos").alias("first_pos"), F.count("*").alias("n_words"), text.alias("text"), F.min("t0_ms").alias("t0_ms"), F.max("t1_ms").alias("t1_ms")
    )


def context(segs: DataFrame, n: int = 2) -> DataFrame:
    """Texts of the n segments before and after, joined by blanks, without the segment itself."""
    def near(a: int, b: int) -> Column:
        return F.array_join(F.collect_list("text").over(in_order().rowsBetween(a, b)), " ")

    return segs.withColumns({"before": near(-n, -1), "after": near(1, n)})


def plan_batches(segs: DataFrame, size: int) -> DataFrame:
    """Even batches per media: as few as hold ``size`` each, larger ones first, sizes one apart at most."""
    n, rn = F.count("*").over(media()), F.row_number().over(in_order()) - 1
    made = segs.withColumns({"_n": n, "_rn": rn}).withColumn("_b", F.ceil(F.col("_n") / size))
    base, extra = F.floor(F.col("_n") / F.col("_b")), F.col("_n") % F.col("_b")
    big = extra * (base + 1)
    batch = F.when(F.col("_rn") < big, F.floor(F.col("_rn") / (base + 1))).otherwise(extra + F.floor((F.col("_rn") - big) / base))
    return made.withColumn("batch", batch.cast("long")).drop("_n", "_rn", "_b")


def sample_lines(segs: DataFrame, most: int = 120) -> DataFrame:
    """All lines of short media; else a third each from the head, around the middle and from the tail."""
    third = most // 3
    marked = segs.withColumns({"_n": F.count("*").over(media()), "_rn": F.row_number().over(in_order()) - 1})
    mid = F.floor(F.col("_n") / 2) - third // 2
    keep = (F.col("_n") <= most) | (F.col("_rn") < third) | F.col("_rn").between(mid, mid + third - 1) | (F.col("_rn") >= F.col("_n") - third)
    return marked.where(keep).drop("_n", "_rn")


def syllable_load(segs: DataFrame, limit: float = 4.5) -> DataFrame:
    """Blank-separated syllables per second of the slot, and whether they are too many."""
    n = F.regexp_count("text", F.lit(r"\S+"))
    rate = n * 1000.0 / F.greatest(F.col("slot_ms"), F.lit(1))
    return segs.withColumns({"syllables": n, "too_long": rate > limit})


def side_by_side(orig: DataFrame, tran: DataFrame) -> DataFrame:
    """Both by position, with tenths of characters per second of the translation."""
    def numbered(df: DataFrame, text: str) -> DataFrame:
        return df.select("media_id", F.row_number().over(in_order()).alias("row"), F.col(text).alias(f"{text}_shown"), (F.col("end_ms") - F.col("start_ms")).alias(f"{text}_ms"))

    both = numbered(orig, "text").join(numbered(tran, "text_vi"), ["media_id", "row"], "full")
    ms = F.greatest(F.lit(100), F.coalesce("text_vi_ms", "text_ms"))
    return both.withColumn("cps_tenths", F.floor(F.length("text_vi_shown") * 10000 / ms))


def timing_guide(segs: DataFrame, floor_ms: int = 200) -> DataFrame:
    """dub_ms against slot_ms within max(floor, 30 %): OK, TOO_LONG or TOO_SHORT."""
    tolerance = F.greatest(F.lit(floor_ms), F.floor(F.col("slot_ms") * 3 / 10))
    diff = F.col("dub_ms") - F.col("slot_ms")
    verdict = F.when(diff > tolerance, "TOO_LONG").when(diff < -tolerance, "TOO_SHORT").otherwise("OK")
    return segs.withColumns({"diff_ms": diff, "verdict": verdict})


def profile_speakers(segs: DataFrame) -> DataFrame:
    """Speaking time, turns, share and span coverage per speaker; a narrator has a third of the time over most of the media."""
    per = segs.withColumn("ms", F.col("end_ms") - F.col("start_ms")).groupBy("media_id", "speaker").agg(
        F.sum("ms").alias("total_ms"), F.count("*").alias("n"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms")
    )
    all_ms, lo, hi = F.sum("total_ms").over(media()), F.min("first_ms").over(media()), F.max("last_ms").over(media())
    share = F.col("total_ms") / all_ms
    cover = (F.col("last_ms") - F.col("first_ms")) / F.greatest(hi - lo, F.lit(1))
    per = per.withColumns({"share_pct": F.floor(share * 100), "cover_pct": F.floor(cover * 100), "narrator": (share >= 0.35) & (cover >= 0.60) & (F.col("n") >= 2)})
    return per.drop("first_ms", "last_ms")


def srt_time(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, (ms % 1000).cast("long"))


def srt_bodies(segs: DataFrame, text: str = "text") -> DataFrame:
    """One numbered subtitle body per media."""
    cue = F.concat(F.row_number().over(in_order()).cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), F.col(text), F.lit("\n"))
    rows = segs.select("media_id", F.row_number().over(in_order()).alias("rn"), cue.alias("cue"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "cue"))), lambda x: x["cue"]), "\n")
    return rows.groupBy("media_id").agg(body.alias("body"))


def script(segs: DataFrame, bilingual: bool) -> DataFrame:
    line = F.concat(F.col("text"), F.lit("\n"), F.col("text_vi")) if bilingual else F.col("text_vi")
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "seg_id", line.alias("line"))))
    return segs.groupBy("media_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n" if bilingual else "\n").alias("body"))
