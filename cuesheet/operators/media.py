"""Media operators: OCR fusion, frame sessions, pitch, voices, thumbnails, speaker clusters, long-segment splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import align, ocr_normal, ratio_bound, ratio_udf
from . import folds, intervals, timeline
from .segments import CJK_BASE, CJK_WIDE, cjk_count, flag_gap, flag_rate

# Fixed values of the fusion: weights of its scores and thresholds of its rules.
WEIGHTS = {"asr": 0.30, "ocr": 0.20, "align": 0.20, "temporal": 0.15, "completeness": 0.15}
OVERRIDE, MERGE, ALIKE, UNLIKE, LEAST_SURE, LEAST_CJK = 0.75, 0.80, 0.85, 0.60, 0.60, 3
# Fixed values of the frame score, of voice casting and of the acoustic confidence.
FRAME_WEIGHTS = {"sharp": 3.2, "contrast": 2.0, "saturation": 1.4, "balance": 35.0}
DARK, BURNT, FLAT, BLURRED, BLUR_COST = 25.0, 238.0, 16.0, 8.0, 75.0
CAST = {"gender": 0.40, "pitch": 0.20, "narrator": 0.25, "provider": 0.15}
DEEP_HZ, USED_COST = 135.0, 0.80
ENERGY_SHARE, ENERGY_FLOOR, LEAST_PEAK = 0.08, 0.003, 0.01
# Fixed values of display cues.
LINE, LINE_ALONE, LINES, LEAST_CUE_MS, PAUSE = 42, 28, 2, 800, 0.6


def suspects(segs: DataFrame, chunks: DataFrame) -> DataFrame:
    """segs with the distinct reasons to doubt them, in rank order: rate, gap, and the nearest segment of an uncovered
    chunk."""
    marked = flag_gap(flag_rate(segs))
    mids = segs.select("media_id", F.col("seg_id").alias("target_id"), F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("at_ms"))
    free = intervals.uncovered(chunks, segs.select("media_id", F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms")))
    free = free.withColumn("t", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    near = intervals.nearest(free, mids, ["media_id"], "t").where("target_id IS NOT NULL").select("media_id", F.col("target_id").alias("seg_id"), F.lit(3).alias("rank"), F.lit("chunk").alias("reason"))
    both = marked.where("rate_suspect").select("media_id", F.col("seg_id").cast("long").alias("seg_id"), F.lit(1).alias("rank"), F.lit("rate").alias("reason")).unionByName(
        marked.where("gap_suspect").select("media_id", F.col("seg_id").cast("long").alias("seg_id"), F.lit(2).alias("rank"), F.lit("gap").alias("reason"))
    ).unionByName(near)
    reasons = both.groupBy("media_id", "seg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "reason"))), lambda x: x["reason"]), ",").alias("reasons"))
    return segs.join(reasons, ["media_id", "seg_id"], "left")


def fuse(asr: DataFrame, ocr: DataFrame, doubted: DataFrame | None = None) -> DataFrame:
    """One decision per ASR segment against the OCR texts that touch it, by five scores and the rules below in order, and one
    per OCR text that touches none but is long and sure enough. doubted(media_id, seg_id): suspect segments.

    rule 1  nothing was heard, three CJK characters or more are seen, sure enough: the OCR text and its time
    rule 2  alike, and the OCR text adds to either end: the merged text
    rule 3  very much alike: the ASR text
    rule 4  unlike, or a low final score: the ASR text as a fallback; else the ASR text"""
    hit = intervals.match_ocr(asr.select("media_id", "seg_id", "start_ms", "end_ms"), ocr)
    shown = F.array_sort(F.collect_list(F.struct("b_start_ms", "ocr_id", F.trim("ocr_text").alias("t"))))
    per = hit.groupBy("media_id", "seg_id").agg(
        F.array_join(F.transform(shown, lambda x: x["t"]), "").alias("ocr_text"), F.avg("confidence").alias("sure"),
        F.min("b_start_ms").alias("o_start"), F.max("b_end_ms").alias("o_end"),
    )
    both = asr.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).join(per, ["media_id", "seg_id"], "left")
    if doubted is None:
        both = both.withColumn("_doubted", F.lit(False))
    else:
        both = both.join(doubted.select("media_id", "seg_id", F.lit(True).alias("_doubted")).distinct(), ["media_id", "seg_id"], "left")
    told = both.withColumns({f"_{k}": v for k, v in align(F.col("text"), F.col("ocr_text")).items()})
    rate = cjk_count(F.col("text"), CJK_BASE) / F.greatest(F.lit(0.1), (F.col("end_ms") - F.col("start_ms")) / 1000)
    heard = 0.6 * (F.col("text") != "").cast("int") + 0.2 * (~F.coalesce("_doubted", F.lit(False))).cast("int") + 0.2 * rate.between(0.5, 6.0).cast("int")
    common = F.least("end_ms", "o_end") - F.greatest("start_ms", "o_start")
    hull = F.greatest(F.greatest("end_ms", "o_end") - F.least("start_ms", "o_start"), F.lit(1))
    a, o = ocr_normal(F.col("text")), ocr_normal(F.col("ocr_text"))
    part = ((a != "") & o.contains(a)) | ((o != "") & a.contains(o))
    like = F.col("_similarity")
    seen = F.col("ocr_text").isNotNull()
    scores = {
        "asr": F.least(F.lit(1.0), heard), "ocr": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sure"))), "align": like,
        "temporal": F.greatest(F.lit(0.0), common / hull), "completeness": F.when(part, 1.0).when(like >= 0.5, like).otherwise(0.0),
    }
    alone = {"asr": 1.0, "ocr": 0.0, "align": 1.0, "temporal": 0.0, "completeness": 1.0}
    final = sum(w * scores[k] for k, w in WEIGHTS.items())
    both = told.withColumns({f"{k}_score": F.when(seen, v).otherwise(alone[k]) for k, v in scores.items()}).withColumn("final_score", F.when(seen, final).otherwise(1.0))
    from_ocr = (a == "") & (cjk_count(F.col("ocr_text"), CJK_BASE) >= LEAST_CJK) & (F.col("ocr_score") >= LEAST_SURE)
    adds = (F.col("_added_prefix") != "") | (F.col("_added_suffix") != "")
    rule = F.when(~seen, 0).when(from_ocr, 1).when((like >= MERGE) & adds, 2).when(like >= ALIKE, 3)
    rule = rule.when((like < UNLIKE) | (F.col("final_score") < OVERRIDE), 4).otherwise(0)
    names = F.when(~seen, "keep_asr_no_ocr").when(rule == 1, "ocr_override_empty").when(rule == 2, "merged_prefix_suffix")
    names = names.when(rule == 3, "keep_asr_high_similarity").when(rule == 4, "keep_asr_fallback").otherwise("keep_asr")
    each = [*[f"{k}_score" for k in WEIGHTS], "final_score"]
    decided = both.select(
        "media_id", F.col("seg_id").cast("long").alias("seg_id"), F.lit(None).cast("long").alias("ocr_id"), names.alias("decision"), rule.alias("rule"), *each,
        F.col("text").alias("asr_text"), F.coalesce("ocr_text", F.lit("")).alias("ocr_text"),
        F.when(rule == 1, F.col("ocr_text")).when(rule == 2, F.col("_merged")).otherwise(F.col("text")).alias("final_text"),
        F.when(rule == 1, F.col("o_start")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(rule == 1, F.col("o_end")).otherwise(F.col("end_ms")).alias("end_ms"),
    )
    own = {"asr_score": 0.0, "ocr_score": F.col("confidence"), "align_score": 0.0, "temporal_score": 0.0, "completeness_score": 1.0, "final_score": 0.8}
    free = ocr_only(asr, ocr, LEAST_CJK, LEAST_SURE, "narrow")
    standalone = free.select(
        "media_id", F.lit(None).cast("long").alias("seg_id"), F.col("ocr_id").cast("long").alias("ocr_id"), F.lit("ocr_standalone").alias("decision"), F.lit(1).alias("rule"),
        *[(F.lit(v) if isinstance(v, float) else v).alias(k) for k, v in own.items()], F.lit("").alias("asr_text"), F.trim("ocr_text").alias("ocr_text"),
        F.trim("ocr_text").alias("final_text"), F.col("b_start_ms").alias("start_ms"), F.col("b_end_ms").alias("end_ms"),
    )
    return decided.unionByName(standalone)


def fused_timeline(decisions: DataFrame) -> DataFrame:
    """The fused texts in order of time, without overlaps, numbered anew: media_id, new_id, start_ms, end_ms, final_text."""
    w = Window.partitionBy("media_id").orderBy("start_ms", F.col("seg_id").isNull(), "seg_id", "ocr_id")
    rows = decisions.withColumn("no", F.row_number().over(w))
    placed = timeline.deoverlap(rows.select("media_id", F.col("no").alias("seg_id"), "start_ms", "end_ms"))
    return placed.join(rows.select("media_id", F.col("no").alias("seg_id"), "final_text"), ["media_id", "seg_id"]).drop("seg_id")


def ocr_only(asr: DataFrame, ocr: DataFrame, least_cjk: int = 3, least_confidence: float = 0.6, kind: str = "wide") -> DataFrame:
    """OCR rows that match no ASR segment, have enough CJK characters (with or without extension A) and confidence."""
    counted = cjk_count(F.col("ocr_text"), CJK_WIDE if kind == "wide" else CJK_BASE)
    good = ocr.where((counted >= least_cjk) & (F.col("confidence") >= least_confidence))
    hit = intervals.match_ocr(asr.select("media_id", "seg_id", "start_ms", "end_ms"), good).select("media_id", "ocr_id").distinct()
    return good.join(hit, ["media_id", "ocr_id"], "left_anti")


def merge_frames(frames: DataFrame, least: float = 0.90, frame_ms: int = 1000) -> DataFrame:
    """frames(media_id, t, text, score): runs of frames whose text stays like that of the frame before; the best text wins. A run
    lasts to the end of its last frame; its stability is its share of all frames of the media, empty ones too. The ratio is
    worked out by difflib only for pairs of which neither begins with the other, and that can reach it by their lengths and by
    the letters they share."""
    w = Window.partitionBy("media_id").orderBy("t")
    told = frames.where(F.trim("text") != "").withColumn("_before", F.lag("text").over(w))
    a, b = F.length("_before"), F.length("text")
    most = 2.0 * F.least(a, b) / (a + b)
    begun = F.startswith("_before", "text") | F.startswith("text", "_before")  # then difflib finds the shorter text whole
    near = F.coalesce(~begun & (most >= least), F.lit(False))
    can = near & (ratio_bound(F.when(near, F.col("_before")), F.when(near, F.col("text"))) >= least)
    pair = F.when(can, F.col("_before")), F.when(can, F.col("text"))  # nulls cost the function nothing
    same = F.when(begun, most).otherwise(ratio_udf()(*pair))
    new = F.when(F.col("_same") >= least, 0).otherwise(1)
    marked = told.withColumn("_same", same).withColumn("island", F.sum(new).over(w))
    whole = frames.groupBy("media_id").agg(F.count("*").alias("_all"))
    runs = marked.groupBy("media_id", "island").agg(
        F.min("t").alias("start"), (F.max("t") + frame_ms).alias("end"), F.max_by("text", F.struct("score", -F.col("t"))).alias("text"),
        F.avg("score").alias("confidence"), F.count("*").alias("n_frames"),
    )
    shared = runs.join(whole, "media_id").withColumn("stability", F.round(F.col("n_frames") / F.col("_all"), 3))
    return shared.select("media_id", "island", "start", "end", "text", "confidence", "n_frames", "stability")


def pitch_stats(f0: DataFrame) -> DataFrame:
    """f0(media_id, hz or 0): statistics of voiced frames, gender with confidence."""
    v = F.when(F.col("hz") > 0, F.col("hz"))
    per = f0.groupBy("media_id").agg(
        F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.1).alias("p10"), F.percentile(v, 0.9).alias("p90"),
        F.stddev_pop(v).alias("std"), (F.count(v) / F.count("*")).alias("voiced"),
    )
    distance = F.abs(F.col("median") - 165) / 165
    conf = F.least(F.lit(1.0), distance * 3) * F.col("voiced")
    gender = F.when(conf < 0.20, "unknown").when(F.col("median") < 165, "male").otherwise("female")
    return per.withColumns({"confidence": F.coalesce(conf, F.lit(0.0)), "gender": F.coalesce(gender, F.lit("unknown"))})


def best_frame(features: DataFrame) -> DataFrame:
    """features(media_id, ts, luma, contrast, sharp, saturation), all on scales of 8 bits: the frame with the best score, then
    the earliest. Dark, burnt-out and flat frames are rejected by a score below all others, so that a media of such frames only
    still gets its least bad one. Missing values count as 0."""
    luma, contrast, sharp, saturation = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("luma", "contrast", "sharp", "saturation"))
    balance = F.greatest(F.lit(0.0), 1 - F.abs(luma - 128.0) / 128.0)
    total = sharp * FRAME_WEIGHTS["sharp"] + contrast * FRAME_WEIGHTS["contrast"] + saturation * FRAME_WEIGHTS["saturation"] + balance * FRAME_WEIGHTS["balance"]
    total = F.floor((total - F.when(sharp < BLURRED, BLUR_COST).otherwise(0.0)) * 100 + 0.5) / 100
    reason = F.when(luma < DARK, "dark").when(luma > BURNT, "overexposed").when(contrast < FLAT, "flat").otherwise("ok")
    scored = features.select("media_id", "ts", reason.alias("reason"), F.when(reason.isin("dark", "overexposed"), -250.0).when(reason == "flat", -150.0).otherwise(total).alias("score"))
    best = F.max_by(F.struct("ts", "score", "reason"), F.struct("score", -F.col("ts")))
    return scored.groupBy("media_id").agg(best.alias("_best")).select("media_id", "_best.*")


def _fit(p: Column, v: Column, used: Column, provider: str | None) -> Column:
    """How well voice v suits speaker p, 0 to 1."""
    known = p["gender"].isin("male", "female") & (F.coalesce(v["gender"], F.lit("")) != "")
    gender = F.when(F.coalesce(known, F.lit(False)), (p["gender"] == v["gender"]).cast("double")).otherwise(0.5)
    deep, young = (p["pitch_hz"] < DEEP_HZ) & (v["pitch_tag"] == "deep_male"), (p["pitch_hz"] >= DEEP_HZ) & (v["pitch_tag"] == "young_male")
    tagged = F.coalesce(v["pitch_tag"], F.lit("")) != ""
    pitch = F.when(tagged & (p["gender"] == "male") & (deep | young), 1.0).when(tagged & (p["gender"] == "male") & (v["gender"] == "male"), 0.8)
    pitch = pitch.when((p["gender"] == "female") & v["pitch_tag"].isin("female", "child_or_high"), 1.0).otherwise(0.5)
    narrator = F.when(p["narrator"], v["narrator_fit"]).otherwise(0.6)
    source = F.when(v["provider"] == provider, 1.0).otherwise(0.5) if provider else F.lit(1.0)
    raw = CAST["gender"] * gender + CAST["pitch"] * pitch + CAST["narrator"] * narrator + CAST["provider"] * source
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw - F.when(F.array_contains(used, v["voice"]), USED_COST).otherwise(0.0)))


#: All that _fit can see of a speaker: gender, pitch and whether it narrates.
_KINDS = [(g, hz, n) for g in ("male", "female", "unknown") for hz in (0.0, float(DEEP_HZ), None) for n in (False, True)]


def _kind_no(p: Column) -> Column:
    """The place of speaker p in _KINDS."""
    gender = F.when(p["gender"] == "male", 0).when(p["gender"] == "female", 1).otherwise(2)
    pitch = F.when(p["pitch_hz"] < DEEP_HZ, 0).when(p["pitch_hz"] >= DEEP_HZ, 1).otherwise(2)
    return gender * 6 + pitch * 2 + p["narrator"].cast("int")


def cast_voices(profiles: DataFrame, voices: DataFrame, provider: str | None = None, auto: bool = True, default: str = "nam_bac_1") -> DataFrame:
    """profiles(media_id, speaker, gender, pitch_hz, narrator, total_ms, override), voices(voice, gender, pitch_tag, narrator_fit,
    provider): media_id, speaker, voice, source, score. Overrides that are not blank come first; then speakers by speaking time
    take the best voice, the first by name of equal ones; a used voice loses 0.80. Only voices of ``provider`` are taken, if it
    has any. Without ``auto`` or voices everyone gets ``default``.

    The catalogue may be of any size. Fit depends on the kind of a speaker only, and a media of n speakers uses n names at most, so
    whoever is chosen is among the first n + 1 names by fit, then order, of the speaker's kind: any voice before the best
    unused one is used. Only these are broadcast, for the largest n."""
    fit = F.coalesce(F.col("narrator_fit").cast("double"), F.lit(0.5)).alias("narrator_fit")
    known = voices.where("voice IS NOT NULL").select("voice", "gender", "pitch_tag", fit, "provider").distinct()
    if provider and not (own := known.where(F.col("provider") == provider)).isEmpty():
        known = own
    most = profiles.groupBy("media_id").count().agg(F.max("count")).first()[0] or 0
    kinds = profiles.sparkSession.createDataFrame([(i, x) for i, x in enumerate(_KINDS)], "k int, p struct<gender:string,pitch_hz:double,narrator:boolean>")
    each = known.select(F.struct(*known.columns).alias("v")).crossJoin(F.broadcast(kinds))
    scored = each.select("k", "v", _fit(F.col("p"), F.col("v"), F.array().cast("array<string>"), provider).alias("s"))
    names = scored.groupBy("k", F.col("v.voice").alias("voice")).agg(F.collect_list("v").alias("_all"), F.min(F.struct(-F.col("s"), "v")).alias("_best"))
    short = names.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy("_best"))).where(F.col("_r") <= most + 1)
    catalogue = short.select("k", F.explode("_all").alias("v")).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("voices"))
    people = profiles.withColumns({
        "neg": -F.coalesce("total_ms", F.lit(0)), "override": F.nullif(F.trim("override"), F.lit("")), "narrator": F.coalesce("narrator", F.lit(False)), "pitch_hz": F.col("pitch_hz").cast("double"),
    })
    grouped = folds.ordered(people, ["media_id"], ["neg", "speaker"], ["speaker", "gender", "pitch_hz", "narrator", "override"])
    both = grouped.crossJoin(F.broadcast(catalogue))  # one row
    kind = "array<struct<speaker:string,voice:string,source:string,score:double>>"
    fixed = F.filter(F.transform("items", lambda p: p["override"]), lambda v: v.isNotNull())

    def told(p: Column, voice: Column, source: str, score: Column) -> Column:
        return F.struct(p["speaker"].cast("string").alias("speaker"), voice.alias("voice"), F.lit(source).alias("source"), score.alias("score"))

    def step(acc: Column, p: Column) -> Column:
        used = F.concat(fixed, F.transform(acc, lambda a: a["voice"]))
        mine_only = F.transform(F.filter("voices", lambda x: x["k"] == _kind_no(p)), lambda x: x["v"])
        worth = F.transform(mine_only, lambda v: F.struct(_fit(p, v, used, provider).alias("s"), v["voice"].alias("v")))
        best = F.aggregate(worth, F.struct(F.lit(-1.0).alias("s"), F.lit("").alias("v")), lambda a, b: F.when(b["s"] > a["s"], b).otherwise(a))
        mine = told(p, best["v"], "auto", F.floor(best["s"] * 1000 + 0.5) / 1000) if auto else told(p, F.lit(default), "fallback", F.lit(1.0))
        mine = F.when(F.size("voices") == 0, told(p, F.lit(default), "fallback", F.lit(1.0))).otherwise(mine)
        if auto:
            mine = F.when((F.size("voices") > 0) & p["override"].isNotNull(), told(p, p["override"], "manual_override", F.lit(1.0))).otherwise(mine)
        return F.array_append(acc, mine)

    done = F.aggregate("items", F.array().cast(kind), step)
    return both.select("media_id", F.explode(done).alias("_cast")).select("media_id", "_cast.*")


def fill_embeddings(prints: DataFrame) -> DataFrame:
    """voiceprints(media_id, seg_id, embedding or null): the nearest present one by position, the earlier on a tie."""
    w = Window.partitionBy("media_id").orderBy("seg_id")
    n = prints.withColumn("rn", F.row_number().over(w))
    mark = F.when(F.col("embedding").isNotNull(), F.struct("rn", "embedding"))
    down = Window.partitionBy("media_id").orderBy(F.desc("rn"))  # a frame up to the current row is worked out once for all
    both = n.withColumn("b", F.last(mark, True).over(w)).withColumn("a", F.last(mark, True).over(down))
    earlier = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("rn") - F.col("b.rn") <= F.col("a.rn") - F.col("rn")))
    return both.select("media_id", "seg_id", F.when(earlier, F.col("b.embedding")).otherwise(F.col("a.embedding")).alias("embedding"), F.when(earlier, F.col("b.rn")).otherwise(F.col("a.rn")).alias("from_rn"))


BLOCK, BIN, FINE = 1024, 1e-3, 5e-7


def _distances(block: pd.DataFrame) -> np.ndarray:
    """Cosine distances of the pairs of a block: left with right, or each pair once where both are the same part."""
    sides = [np.stack(x["embedding"].to_numpy()).astype(float) if len(x) else np.empty((0, 1)) for x in (block[block["left"]], block[~block["left"]])]
    x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in sides)
    if not len(x) or not len(y):
        return np.empty(0)
    if block["i"].iat[0] == block["j"].iat[0]:
        return np.clip(1 - x @ x.T, 0, 2)[np.triu_indices(len(x), 1)]
    return np.clip(1 - x @ y.T, 0, 2).ravel()


def _counted(width: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """Numbers of distances by bin of a width, between lo and hi, with the least and the largest of each."""
        d = _distances(block)
        d = d[(d >= block["lo"].iat[0]) & (d < block["hi"].iat[0])]
        per = pd.DataFrame({"bin": np.floor(d / width).astype(np.int64), "d": d}).groupby("bin")["d"].agg(["size", "min", "max"]).reset_index()
        per.columns = ["bin", "n", "least", "most"]
        per.insert(0, "media_id", block["media_id"].iat[0])
        return per

    return run


def spread(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """p90 of pairwise cosine distances per media, and whether that is one speaker.

    No pair leaves a task: a media's prints are dealt into parts of about ``block``, every two parts are compared in one task,
    and tasks return counts by bin of distance, at most 2,000 rows each. A second pass counts finely inside the bins that hold
    the two distances next to the 90th per cent; they are exact where a fine bin has one or two, else good to 5e-7."""
    had = prints.where(F.col("embedding").isNotNull())
    parts = had.groupBy("media_id").agg(F.ceil(F.count("*") / block).cast("int").alias("p"))
    dealt = had.join(parts, "media_id").withColumn("b", F.pmod(F.xxhash64("seg_id"), "p").cast("int"))
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    as_left = F.transform(F.sequence(F.col("b"), F.col("p") - 1), lambda j: place(F.col("b"), j, True))
    as_right = F.transform(F.sequence(F.lit(0), F.col("b")), lambda i: place(i, F.col("b"), False))
    pairs = dealt.select("media_id", "seg_id", "embedding", F.explode(F.concat(as_left, as_right)).alias("_at")).select("media_id", "_at.*", "seg_id", "embedding")
    kind = T.StructType([prints.schema["media_id"], *[T.StructField(n, t) for n, t in (("bin", T.LongType()), ("n", T.LongType()), ("least", T.DoubleType()), ("most", T.DoubleType()))]])

    def counts(rows: DataFrame, width: float) -> DataFrame:
        dealt_out = rows.repartition("media_id", "i", "j")  # else all parts of a media would stay where it was dealt into them
        each = dealt_out.groupBy("media_id", "i", "j").applyInPandas(_counted(width), kind)
        per = each.groupBy("media_id", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        w = Window.partitionBy("media_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row per bin
        return per.withColumn("upto", F.sum("n").over(w))

    coarse = counts(pairs.withColumns({"lo": F.lit(0.0), "hi": F.lit(3.0)}), BIN)
    total = coarse.groupBy("media_id").agg(F.sum("n").alias("pairs"))
    rank = total.withColumns({"h": 0.9 * (F.col("pairs") - 1)}).withColumns({"k": F.floor("h"), "k2": F.ceil("h")})
    holds = (F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k2"))
    goal = coarse.join(rank, "media_id").where(holds).groupBy("media_id", "pairs", "h", "k", "k2").agg(
        (F.min("bin") * BIN - 1e-9).alias("lo"), ((F.max("bin") + 1) * BIN + 1e-9).alias("hi"), F.min(F.col("bin")).alias("first")
    )
    below = coarse.join(goal.select("media_id", "first"), "media_id").where("bin < first").groupBy("media_id").agg(F.sum("n").alias("below"))
    fine = counts(pairs.join(goal.select("media_id", "lo", "hi"), "media_id"), FINE)
    told = fine.join(goal, "media_id").join(below, "media_id", "left").withColumn("before", F.coalesce("below", F.lit(0)) + F.col("upto") - F.col("n"))

    def at(rank: Column) -> Column:
        inside = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.when(rank == F.col("before") + F.col("n") - 1, F.col("most")).otherwise(F.col("least"))))

    ends = told.groupBy("media_id", "pairs", "h", "k").agg(at(F.col("k")).alias("v1"), at(F.col("k2")).alias("v2"))
    p90 = F.col("v1") + (F.col("h") - F.col("k")) * (F.col("v2") - F.col("v1"))
    return ends.select("media_id", "pairs", p90.alias("p90"), (p90 < 0.30).alias("one_speaker"))


def _linkage(dist: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Average linkage; labels for every cluster count up to ``most``. Overwrites the matrix and holds no other of its size: what
    is nearest to each row is kept and worked out anew only where it was merged. Of equal pairs the first by row, then column."""
    n = len(dist)
    groups = {i: [i] for i in range(n)}
    np.fill_diagonal(dist, np.inf)
    out = {}
    rows = np.arange(n)
    to = dist.argmin(axis=1)
    near = dist[rows, to]
    while True:
        if len(groups) <= most:
            labels = np.zeros(n, int)
            for k, (_, members) in enumerate(sorted(groups.items())):
                labels[members] = k
            out[len(groups)] = labels
        if len(groups) == 1:
            return out
        i = int(near.argmin())
        i, j = sorted((i, int(to[i])))
        a, b = len(groups[i]), len(groups[j])
        dist[i] = dist[:, i] = (dist[i] * a + dist[j] * b) / (a + b)
        dist[i, i] = np.inf
        dist[j] = dist[:, j] = np.inf
        groups[i] += groups.pop(j)
        lost = np.flatnonzero((to == i) | (to == j))
        closer = (dist[i] < near) | ((dist[i] == near) & (i < to))
        to[closer], near[closer] = i, dist[i][closer]
        for r in {i, j, *lost.tolist()}:
            to[r] = dist[r].argmin()
            near[r] = dist[r, to[r]]


def _silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    ks = np.unique(labels)
    s = np.zeros(len(d))
    for i in range(len(d)):
        own = labels == labels[i]
        if own.sum() < 2:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == k].mean() for k in ks if k != labels[i])
        s[i] = (b - a) / max(a, b, 1e-12)
    return float(s.mean())


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cosine(x: np.ndarray) -> np.ndarray:
    """Cosine distances of unit vectors, in one matrix."""
    d = x @ x.T
    return np.clip(np.subtract(1, d, out=d), 0, 2, out=d)


def _separate(d: np.ndarray, one: float) -> bool:
    """Whether the 90th per cent of the distances says that there is more than one speaker."""
    return len(d) > 2 and np.percentile(np.concatenate([r[i + 1 :] for i, r in enumerate(d)]), 90, overwrite_input=True) >= one


def _small(most_speakers: int, least: float, one: float):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("seg_id")
        labels = np.zeros(len(batch), int)
        x = _unit(batch["embedding"])
        d = _cosine(x)
        if _separate(d, one):
            tried = {k: v for k, v in _linkage(d.copy(), most_speakers).items() if k >= 2}
            best = max(tried, key=lambda k: (_silhouette(d, tried[k]), -k), default=None)
            if best and _silhouette(d, tried[best]) >= least:
                labels = tried[best]
        return pd.DataFrame({"media_id": batch["media_id"], "seg_id": batch["seg_id"], "cluster": labels.astype(np.int32)})

    return run


def _landmarks(most_speakers: int, one: float):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        """The mean unit vector of every cluster, for every number of clusters; no rows for one speaker."""
        x = _unit(batch.sort_values("seg_id")["embedding"])
        d = _cosine(x)
        out = []
        if _separate(d, one):
            tried = {n: v for n, v in _linkage(d, most_speakers).items() if n >= 2}
            out = [(batch["media_id"].iat[0], n, c, x[v == c].mean(axis=0)) for n, v in tried.items() for c in range(n)]
        return pd.DataFrame(out, columns=["media_id", "n", "c", "mean"])

    return run


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _cluster_large(prints: DataFrame, large: DataFrame, most_speakers: int, least: float, one: float, landmarks: int, spread_over: int) -> DataFrame:
    """Labels of media too large for one group: average linkage of their landmarks, then three scans over all prints.

    Landmarks are the ``landmarks`` prints of a media whose segment hashes lowest. The average cosine distance of a print to
    a cluster is one less its product with the mean unit vector, so every print joins the cluster nearest by average linkage,
    and the silhouette over all prints, which chooses the number of clusters, is exact from sums of vectors. Prints of a media
    are spread over ``spread_over`` slots; per-cluster values (at most 2 + ... + most_speakers a media) are copied to each."""
    e = F.col("embedding")
    norm = F.sqrt(F.greatest(_dot(e, e), F.lit(1e-24)))
    mine = prints.join(large, "media_id", "left_semi").select("media_id", "seg_id", F.pmod(F.xxhash64("seg_id"), F.lit(spread_over)).alias("_slot"), F.transform(F.transform(e, lambda x: x.cast("double")), lambda x: x / norm).alias("_u"))
    few = mine.withColumn("_r", F.row_number().over(Window.partitionBy("media_id").orderBy(F.xxhash64(F.lit(1), F.col("seg_id")), "seg_id"))).where(F.col("_r") <= landmarks)
    kind = T.StructType([prints.schema["media_id"], T.StructField("n", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("mean", T.ArrayType(T.DoubleType()))])
    means = few.select("media_id", "seg_id", F.col("_u").alias("embedding")).groupBy("media_id").applyInPandas(_landmarks(most_speakers, one), kind)

    def to_slots(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(spread_over - 1)).cast("array<bigint>")))

    sets = means.groupBy("media_id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "mean"))).alias("_m"))
    tries = mine.join(to_slots(sets), ["media_id", "_slot"])
    nearest = F.array_min(F.transform("_m", lambda m: F.struct((1 - _dot(F.col("_u"), m["mean"])).alias("d"), m["c"].alias("c"))))["c"]
    put = tries.select("media_id", "_slot", "seg_id", "n", nearest.alias("c"), "_u")
    # sums of vectors: each slot adds up its own first
    parts = put.select("media_id", "_slot", "n", "c", F.posexplode("_u").alias("i", "v")).groupBy("media_id", "n", "c", "i").agg(F.sum("v").alias("v"), F.count("*").alias("size"))
    sums = parts.groupBy("media_id", "n", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("sum"), F.max("size").alias("size"))
    whole = sums.groupBy("media_id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "size", "sum"))).alias("_s"))
    scored = put.join(to_slots(whole), ["media_id", "n", "_slot"])
    own = F.element_at(F.filter("_s", lambda s: s["c"] == F.col("c")), 1)
    away = F.array_min(F.transform(F.filter("_s", lambda s: s["c"] != F.col("c")), lambda s: 1 - _dot(F.col("_u"), s["sum"]) / s["size"]))
    near = (own["size"] - _dot(F.col("_u"), own["sum"])) / (own["size"] - 1)
    value = F.when(own["size"] < 2, 0.0).otherwise((away - near) / F.greatest(away, near, F.lit(1e-12)))
    quality = scored.groupBy("media_id", "n").agg(F.avg(F.coalesce(value, F.lit(-1.0))).alias("q"))
    best = quality.groupBy("media_id").agg(F.max_by("n", F.struct(F.round("q", 9), -F.col("n"))).alias("n"), F.max("q").alias("q")).where(F.col("q") >= least).select("media_id", "n")
    chosen = put.join(best, ["media_id", "n"]).select("media_id", "seg_id", "c")
    first = chosen.groupBy("media_id", "c").agg(F.min("seg_id").alias("_first"))
    numbered = first.select("media_id", "c", (F.row_number().over(Window.partitionBy("media_id").orderBy("_first")) - 1).alias("cluster"))
    found = chosen.join(numbered, ["media_id", "c"]).select("media_id", "seg_id", "cluster")
    alone = prints.join(large, "media_id", "left_semi").join(best, "media_id", "left_anti").select("media_id", "seg_id", F.lit(0).alias("cluster"))
    return found.unionByName(alone)


def cluster_speakers(prints: DataFrame, most_speakers: int = 6, least: float = 0.20, one: float = 0.30, most: int = 2000, spread_over: int = 16) -> DataFrame:
    """Speaker labels per media: 2 to most_speakers clusters by best silhouette, else one; clusters are numbered by their first
    segment. seg_id is unique within a media; prints without vector take no part.

    A media of up to ``most`` prints is one group with exact average linkage. A larger one is clustered by as many landmarks and
    every other print joins the nearest cluster (see _cluster_large), so no media has a bound; there whether it is one
    speaker at all is judged by the landmarks' distances."""
    had = prints.where(F.col("embedding").isNotNull()).select("media_id", "seg_id", "embedding")
    large = had.groupBy("media_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("media_id")
    kind = T.StructType([prints.schema["media_id"], prints.schema["seg_id"], T.StructField("cluster", T.IntegerType())])
    small = had.join(large, "media_id", "left_anti").groupBy("media_id").applyInPandas(_small(most_speakers, least, one), kind)
    return small.unionByName(_cluster_large(had, large, most_speakers, least, one, most, spread_over))


def relabel(clusters: DataFrame, ms: str) -> DataFrame:
    """Clusters numbered by total time, longest first."""
    per = clusters.groupBy("media_id", "cluster").agg(F.sum(ms).alias("_ms"))
    w = Window.partitionBy("media_id").orderBy(F.col("_ms").desc(), "cluster")
    return clusters.join(per.select("media_id", "cluster", (F.row_number().over(w) - 1).alias("speaker_id")), ["media_id", "cluster"])


def _by_time(chunks: DataFrame, ends) -> DataFrame:
    """chunks(..., start_ms, end_ms, _c array): _t, the bounds of the chunks from start to end. ``ends(start, i)``: where
    chunk i, which begins at start, ends; the last ends with the segment."""
    zero = F.array(F.col("start_ms").cast("double"))
    inner = F.sequence(F.lit(1), F.size("_c") - 1)
    bounds = F.when(F.size("_c") < 2, zero).otherwise(F.aggregate(inner, zero, lambda acc, i: F.array_append(acc, ends(F.element_at(acc, -1), i).cast("double"))))
    return chunks.withColumn("_t", F.array_append(bounds, F.col("end_ms").cast("double")))


def split_long(segs: DataFrame, most_ms: int = 10_000) -> DataFrame:
    """Segments over most_ms are cut at sentence ends, or at clause ends where there is none; sentences are packed up to
    most_ms by share of characters. A cut is where the last word before it ends if the segment has words(word, t1_ms), else
    by share of characters; it stays 100 ms inside. Pieces are numbered anew per media. A null text stays whole and null."""
    clean = F.trim("text")
    filled = lambda pattern: F.filter(F.split(clean, pattern), lambda x: x != "")
    sentences, clauses = filled(r"(?<=[.!?;。！？；])\s*"), filled(r"(?<=[,，、：:\-])\s*")
    cut = F.when(F.size(sentences) > 1, sentences).otherwise(clauses)
    whole = (F.col("end_ms") - F.col("start_ms") <= most_ms) | F.coalesce(F.size(cut) <= 1, F.lit(True))
    timed = "words" in segs.columns
    rows = segs.withColumn("_p", F.when(whole, F.array("text")).otherwise(cut)).withColumn("_all", F.aggregate("_p", F.lit(0), lambda n, x: n + F.length(x)))
    span = F.col("end_ms") - F.col("start_ms")
    kind = "array<struct<text:string,n:int>>"

    def pack(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        own = F.struct(p.alias("text"), F.length(p).alias("n"))
        longer = F.struct(F.concat(last["text"], F.lit(" "), p).alias("text"), (last["n"] + F.length(p)).alias("n"))
        fits = (last["n"] + F.length(p)) / F.greatest("_all", F.lit(1)) * span <= most_ms
        return F.when(F.size(acc) == 0, F.array(own)).when(fits, F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.array_append(acc, own)).cast(kind)

    packed = rows.withColumn("_c", F.aggregate("_p", F.array().cast(kind), pack))

    def end(start: Column, i: Column) -> Column:
        estimate = start + F.element_at("_c", i)["n"] / F.greatest("_all", F.lit(1)) * span
        at = estimate
        if timed:
            upto = F.aggregate(F.slice("_c", 1, i), F.lit(0), lambda n, x: n + x["n"])
            zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("t"))
            step = lambda acc, w: F.struct((acc["n"] + F.length(w["word"])).alias("n"), F.when(acc["t"].isNotNull() | (acc["n"] + F.length(w["word"]) < upto), acc["t"]).otherwise(w["t1_ms"].cast("double")).alias("t"))
            at = F.coalesce(F.aggregate(F.coalesce("words", F.array().cast(segs.schema["words"].dataType)), zero, step)["t"], estimate)
        return F.round(F.least(F.greatest(at, start + 100), F.col("end_ms") - 100))

    each = _by_time(packed, end).select("media_id", "seg_id", "end_ms", F.col("_t"), F.size("_c").alias("_k"), F.posexplode("_c").alias("pos", "_x"))
    began, ended = F.element_at("_t", F.col("pos") + 1), F.element_at("_t", F.col("pos") + 2)
    began = F.when((F.col("pos") == F.col("_k") - 1) & (F.col("_k") > 1), F.least(began, F.col("end_ms") - 100)).otherwise(began)
    made = each.select("media_id", "seg_id", "pos", F.col("_x.text").alias("text"), began.cast("long").alias("start_ms"), ended.cast("long").alias("end_ms"))
    return made.withColumn("new_id", F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "seg_id", "pos"))).drop("pos")


def _lines(text: Column, width: int) -> Column:
    """Words filled greedily into lines of a width; a longer word is a line."""
    def put(acc: Column, w: Column) -> Column:
        joined = F.concat(F.element_at(acc, -1), F.lit(" "), w)
        return F.when(F.size(acc) == 0, F.array(w)).when(F.length(joined) <= width, F.array_append(F.slice(acc, 1, F.size(acc) - 1), joined)).otherwise(F.array_append(acc, w))

    return F.aggregate(F.split(text, " "), F.array().cast("array<string>"), put)


def split_for_display(segs: DataFrame, lines: int = LINES, line_words: int = 0, all_caps: bool = False) -> DataFrame:
    """With line_words, lines hold that many words and are measured by words, else by letters; all_caps shows capitals.

    Cues of at most ``lines`` lines: clauses packed up to a cue's width; from a clause wider than a cue whole lines come off
    first, each a cue. Time by words, with a pause after a clause mark; ``lines`` holds the text as it is wrapped (at most that
    many lines, as the reference shows it), ``text`` all of it."""
    width = LINE_ALONE if lines == 1 else LINE
    most = (line_words or width) * lines
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    clean = F.upper(clean) if all_caps else clean
    measure = (lambda c: F.size(F.split(c, " "))) if line_words else F.length

    def groups(text: Column, n: int, made: Callable[[Column, Column], Column]) -> Column:
        """The words of text, n at a time; made gets each and whether it is not the last."""
        w = F.split(text, " ")
        last = F.floor((F.size(w) - 1) / n).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: made(F.array_join(F.slice(w, i * n + 1, n), " "), i < last))

    kind = "struct<heads:array<string>,line:string,used:int,rest:string>"

    def off(part: Column) -> Column:
        """The lines that come off a wide clause, and what is left of it."""
        zero = F.struct(F.array().cast("array<string>").alias("heads"), F.lit("").alias("line"), F.lit(0).alias("used"), F.lit(None).cast("string").alias("rest")).cast(kind)

        def take(acc: Column, w: Column) -> Column:
            joined = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
            fits = (acc["line"] == "") | (F.length(joined) <= width)
            used = acc["used"] + F.length(acc["line"]) + 1
            last = F.length(part) - used <= most
            more = F.struct(acc["heads"].alias("heads"), joined.alias("line"), acc["used"].alias("used"), F.lit(None).cast("string").alias("rest"))
            line = F.struct(F.array_append(acc["heads"], acc["line"]).alias("heads"), F.when(last, "").otherwise(w).alias("line"), used.alias("used"), F.when(last, w).alias("rest"))
            done = F.struct(acc["heads"].alias("heads"), acc["line"].alias("line"), acc["used"].alias("used"), F.concat(acc["rest"], F.lit(" "), w).alias("rest"))
            return F.when(acc["rest"].isNotNull(), done).when(fits, more).otherwise(line).cast(kind)

        def items(acc: Column) -> Column:
            heads = F.transform(F.when(acc["line"] == "", acc["heads"]).otherwise(F.array_append(acc["heads"], acc["line"])), lambda x: F.struct(x.alias("t"), F.lit(True).alias("own")))
            return F.when(acc["rest"].isNull(), heads).otherwise(F.array_append(heads, F.struct(acc["rest"].alias("t"), F.lit(False).alias("own"))))

        if line_words:
            return groups(part, most, lambda t, own: F.struct(t.alias("t"), own.alias("own")))
        whole = F.array(F.struct(part.alias("t"), F.lit(False).alias("own")))
        return F.when(F.length(part) <= most, whole).otherwise(F.aggregate(F.split(part, " "), zero, take, items))

    parts = F.filter(F.split(clean, r"(?<=[,.!?;…])\s+"), lambda x: x != "")
    state = "struct<out:array<string>,cur:string>"

    def pack(acc: Column, x: Column) -> Column:
        flushed = F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"]))
        joined = F.when(acc["cur"] == "", x["t"]).otherwise(F.concat(acc["cur"], F.lit(" "), x["t"]))
        own = F.struct(F.array_append(flushed, x["t"]).alias("out"), F.lit("").alias("cur"))
        more = F.struct(acc["out"].alias("out"), joined.alias("cur"))
        new = F.struct(flushed.alias("out"), x["t"].alias("cur"))
        return F.when(x["own"], own).when((acc["cur"] == "") | (measure(joined) <= most), more).otherwise(new).cast(state)

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur")).cast(state)
    finish = lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"]))
    cues = F.when(measure(clean) <= most, F.array(clean)).otherwise(F.aggregate(F.flatten(F.transform(parts, off)), zero, pack, finish))
    weigh = lambda c: F.greatest(F.lit(1.0), F.size(F.split(c, " ")) + F.when(c.rlike(r"[,;:—\-…]$"), PAUSE).otherwise(0.0))
    rows = segs.withColumn("_c", cues).where(clean != "").withColumn("_w", F.transform("_c", weigh))
    span = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    roomy = span >= LEAST_CUE_MS * F.size("_c")

    def end(start: Column, i: Column) -> Column:
        share = span * F.element_at("_w", i) / F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
        return F.least(start + F.when(roomy, F.greatest(share, F.lit(LEAST_CUE_MS))).otherwise(share), F.col("end_ms"))

    each = _by_time(rows, end).select("media_id", "seg_id", "_t", F.posexplode("_c").alias("pos", "text"))
    wrapped = groups(F.col("text"), line_words, lambda t, _: t) if line_words else _lines(F.col("text"), width)
    return each.select(
        "media_id", "seg_id", "pos", "text", F.array_join(F.slice(wrapped, 1, lines), "\n").alias("lines"),
        F.round(F.element_at("_t", F.col("pos") + 1)).cast("long").alias("start_ms"), F.round(F.element_at("_t", F.col("pos") + 2)).cast("long").alias("end_ms"),
    )


def anchor_words(segs: DataFrame, most_ms: int = 600) -> DataFrame:
    """segs with words(array of word, t0_ms, t1_ms): ends move to the first and last word if within most_ms."""
    a, z = F.element_at("words", 1)["t0_ms"], F.element_at("words", -1)["t1_ms"]
    start = F.when((F.size("words") > 0) & (F.abs(a - F.col("start_ms")) <= most_ms), a).otherwise(F.col("start_ms"))
    end = F.when((F.size("words") > 0) & (F.abs(z - F.col("end_ms")) <= most_ms), z).otherwise(F.col("end_ms"))
    return segs.withColumns({"new_start_ms": start, "new_end_ms": F.greatest(end, start)})


def map_words(target: DataFrame, words: DataFrame) -> DataFrame:
    """target(media_id, seg_id, pos, word) timed by the sparse words(media_id, seg_id, pos, t0_ms, t1_ms) of the same
    segment: index arithmetic, then running maxima keep times monotone."""
    seg = Window.partitionBy("media_id", "seg_id")
    t = target.withColumns({"i": F.row_number().over(seg.orderBy("pos")) - 1, "nt": F.count("*").over(seg)})
    have = words.withColumns({"j": F.row_number().over(seg.orderBy("pos")) - 1}).select("media_id", "seg_id", "j", "t0_ms", "t1_ms")
    size = have.groupBy("media_id", "seg_id").agg(F.count("*").alias("na"))
    at = t.join(size, ["media_id", "seg_id"]).withColumn("j", F.floor(F.col("i") * F.col("na") / F.col("nt")).cast("int"))
    both = at.join(have, ["media_id", "seg_id", "j"])
    upto = seg.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t0 = F.max("t0_ms").over(upto)
    return both.withColumn("t0", t0).withColumn("t1", F.greatest(F.col("t0"), F.max("t1_ms").over(upto))).select("media_id", "seg_id", "pos", "word", F.col("t0").alias("t0_ms"), F.col("t1").alias("t1_ms"))


def validate_alignment(words: DataFrame, segs: DataFrame, slack_ms: int = 350) -> DataFrame:
    """Per segment: expected word count, no negative time, t0 <= t1, monotone, and not beyond the clip."""
    w = Window.partitionBy("media_id", "seg_id").orderBy("pos")
    flow = words.withColumn("_ok", (F.col("t0_ms") >= 0) & (F.col("t0_ms") <= F.col("t1_ms")) & (F.coalesce(F.lag("t0_ms").over(w), F.lit(0)) <= F.col("t0_ms")))
    per = flow.groupBy("media_id", "seg_id").agg(F.count("*").alias("n"), F.bool_and("_ok").alias("ok"), F.max("t1_ms").alias("last"))
    want = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    both = segs.join(per, ["media_id", "seg_id"], "left")
    return both.select("media_id", "seg_id", (F.coalesce("ok", F.lit(False)) & (F.col("n") == want) & (F.col("last") <= F.col("end_ms") + slack_ms)).alias("valid"))


def acoustic_align(frames: DataFrame, segs: DataFrame, frame_ms: int = 10) -> DataFrame:
    """frames(media_id, idx, rms), segs(media_id, seg_id, start_ms, end_ms, text): one row per word, spread evenly over the
    segment's active frames (those from 8 % of its peak on, with a floor), with the confidence of that guess by peak, number of
    words and share of active time. Too few frames or too little energy: spread over the whole segment. A text without words
    gives one row without word."""
    timed = frames.select("media_id", (F.col("idx") * frame_ms).alias("b_start_ms"), (F.col("idx") * frame_ms).alias("b_end_ms"), "rms")
    inside = intervals.overlap_join(segs.select("media_id", "seg_id", "start_ms", "end_ms"), timed, ["media_id"], (F.col("b_start_ms") >= F.col("start_ms")) & (F.col("b_start_ms") < F.col("end_ms")))
    loud = inside.withColumn("peak", F.max("rms").over(Window.partitionBy("media_id", "seg_id")))
    on = F.col("rms") >= F.greatest(F.lit(ENERGY_FLOOR), ENERGY_SHARE * F.col("peak"))
    extent = loud.groupBy("media_id", "seg_id").agg(F.max("peak").alias("peak"), F.min(F.when(on, F.col("b_start_ms"))).alias("lo"), F.max(F.when(on, F.col("b_start_ms") + frame_ms)).alias("hi"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    both = segs.select("media_id", "seg_id", "start_ms", "end_ms", words.alias("_words")).join(extent, ["media_id", "seg_id"], "left")
    n, peak = F.size("_words"), F.col("peak")
    heard = F.coalesce(peak >= LEAST_PEAK, F.lit(False))
    active = F.greatest(F.lit(50), F.col("hi") - F.col("lo"))
    clip = F.col("end_ms") - F.col("start_ms")
    least = F.greatest(F.lit(50), clip)
    points = F.when(peak >= 0.08, 35).when(peak >= 0.03, 25).otherwise(10) + F.when(n == 1, 40).when(n == 2, 30).when(n <= 4, 15).otherwise(5)
    points = F.least(F.lit(99), points + F.when((100 * active >= 20 * least) & (100 * active <= 95 * least), 25).otherwise(5))
    points = F.when(n == 0, 0).when(peak.isNull(), 20).when(~heard, 15).otherwise(points)
    sure = heard & (points >= 70) & (((clip <= 1200) & (n <= 4)) | ((clip <= 1800) & (n <= 2)))
    method = F.when(n == 0, "acoustic_empty").when(peak.isNull(), "acoustic_too_short").when(sure, "acoustic_high_conf").otherwise("acoustic_low_conf")
    scored = both.withColumns({
        "confidence_pct": points, "method": method, "_n": n, "_at": F.when(heard, F.col("lo")).otherwise(F.col("start_ms")), "_span": F.when(heard, active).otherwise(clip),
    })
    each = scored.select("*", F.posexplode_outer("_words").alias("pos", "word"))

    def at(i: Column) -> Column:
        return F.col("_at") + F.floor((2 * i * F.col("_span") + F.col("_n")) / (2 * F.col("_n")))

    return each.select("media_id", "seg_id", "pos", "word", "confidence_pct", "method", at(F.col("pos")).alias("t0_ms"), at(F.col("pos") + 1).alias("t1_ms"))


def snap_range(segs: DataFrame, wanted: DataFrame, least_ms: int, most_ms: int) -> DataFrame:
    """wanted(media_id, req, a_ms, z_ms): the start goes to the nearest segment start; the end to the first segment end at
    or after z that makes least_ms, if within most_ms, else the last end within most_ms."""
    starts = segs.select("media_id", F.col("seg_id").alias("target_id"), F.col("start_ms").alias("at_ms"))
    near = intervals.nearest(wanted, starts, ["media_id"], "a_ms").drop("distance_ms")
    first = near.join(segs.select("media_id", F.col("seg_id").alias("target_id"), F.col("start_ms").alias("new_a_ms")), ["media_id", "target_id"])
    ends = segs.select("media_id", F.col("end_ms").alias("at"))
    goal = first.withColumns({"goal": F.greatest(F.col("z_ms"), F.col("new_a_ms") + least_ms) - 1, "cap": F.col("new_a_ms") + most_ms})
    one = intervals.asof(goal, ends, ["media_id"], "goal", "at").drop("before")
    two = intervals.asof(one, ends, ["media_id"], "cap", "at", "before", "later")
    z = F.when(F.col("after") <= F.col("cap"), F.col("after")).otherwise(F.when(F.col("before") > F.col("new_a_ms"), F.col("before")))
    return two.select("media_id", "req", "new_a_ms", F.coalesce(z, F.col("cap")).alias("new_z_ms"))
