"""Ordered recursions over a media's timeline, as folds: repair of overlaps, splitting, placing, greedy choice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds, intervals

L = "long"


def deoverlap(segs: DataFrame, least_ms: int = 100, block_ms: int = 600_000) -> DataFrame:
    """A start before the end of the last segment moves there; every segment lasts least_ms; numbered anew. An end is the
    greatest of its own and the end before plus least_ms, so all ends are one running maximum."""
    start = F.greatest(F.lit(0).cast(L), F.col("start_ms"))
    own = F.greatest(F.col("end_ms"), start + least_ms)
    done = folds.running_max(segs.select("media_id", "seg_id", "start_ms", "end_ms"), ["media_id"], "start_ms", ["seg_id"], own, least_ms, "_end", block_ms)
    # the end before is this end less least_ms, unless the own end is later: then it is looked up by place
    w = Window.partitionBy("media_id", F.floor(F.col("_n") / 4096)).orderBy("_n")
    edge = done.where(F.col("_n") % 4096 == 4095).select("media_id", (F.col("_n") + 1).alias("_n"), F.col("_end").alias("_edge"))
    told = done.withColumn("_prev", F.lag("_end").over(w)).join(edge, ["media_id", "_n"], "left").withColumn("_prev", F.coalesce("_prev", "_edge", F.lit(0).cast(L)))
    return told.select("media_id", "seg_id", F.col("_n").cast(L).alias("new_id"), F.greatest(start, "_prev").alias("start_ms"), F.col("_end").alias("end_ms"))


def repair_cues(cues: DataFrame, gap_ms: int = 10, least_ms: int = 200) -> DataFrame:
    """Cues in file order (``n``): one that runs into the next ends gap_ms before it; a next cue that starts within
    least_ms of this start is moved on first. The state is the cue's start and end as the cue before left them."""

    def step(held: tuple | None, x: tuple, nxt: tuple | None) -> tuple[tuple | None, tuple]:
        n, s, e = x if held is None else (x[0], *held)
        if nxt is None:
            return None, (n, s, e)
        _, ns, ne = nxt
        if e <= ns - gap_ms:
            return (ns, ne), (n, s, e)
        if ns < s + least_ms:
            ns = s + least_ms + gap_ms
            ne = max(ne, ns + least_ms)
        return (ns, ne), (n, s, min(e, ns - gap_ms))

    kinds = dict(cues.dtypes)
    return folds.carried(cues.where("start_ms IS NOT NULL AND end_ms IS NOT NULL"), ["media_id"], ["n"], ["n", "start_ms", "end_ms"], f"n {kinds['n']}, start_ms long, end_ms long", lambda: None, step)


def auto_split(segs: DataFrame, target_ms: int, gap_ms: int = 300) -> DataFrame:
    """Points in the middle of the first silence of gap_ms or more after each target length."""

    def step(begin: int, x: tuple, nxt: tuple | None) -> tuple[int, tuple | None]:
        if nxt is None or None in (x[1], nxt[0]) or x[1] - begin < target_ms or nxt[0] - x[1] < gap_ms:
            return begin, None
        point = (x[1] + nxt[0]) // 2
        return point, (point,)

    return folds.carried(segs, ["media_id"], ["start_ms", "seg_id"], ["start_ms", "end_ms"], "at_ms long", lambda: 0, step)


def plan_bounds(markers: DataFrame, lengths: DataFrame, parts: int, least_ms: int) -> DataFrame:
    """lengths(media_id, dur_ms): bounds of even parts at the marker nearest each ideal, least_ms from the bound before and
    from the end; without a candidate the planning stops."""
    own = markers.groupBy("media_id").agg(F.array_sort(F.collect_set(F.col("cut_ms").cast(L))).alias("cuts"))
    both = lengths.join(own, "media_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))

    def near(acc: Column, i: Column) -> Column:
        ideal = i * F.col("dur_ms") / parts
        ok = F.filter(F.col("cuts"), lambda c: (c > acc["cursor"] + least_ms) & (c < F.col("dur_ms") - least_ms))
        return F.array_min(F.transform(ok, lambda c: F.struct(F.abs(c - ideal).alias("d"), c.alias("c"))))["c"]

    zero = F.struct(F.lit(0).cast(L).alias("cursor"), F.lit(False).alias("stop"), F.array(F.lit(0).cast(L)).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        best = near(acc, i)
        go = ~acc["stop"] & best.isNotNull()
        return F.struct(
            F.when(go, best).otherwise(acc["cursor"]).alias("cursor"), (acc["stop"] | best.isNull()).alias("stop"),
            F.when(go, F.array_append(acc["out"], best)).otherwise(acc["out"]).alias("out"),
        )

    ideals = F.sequence(F.lit(1), F.lit(parts - 1)) if parts > 1 else F.array().cast("array<int>")
    planned = F.when(F.col("dur_ms") <= least_ms * parts, F.array(F.lit(0).cast(L))).otherwise(F.aggregate(ideals, zero, step, lambda a: a["out"]))
    return both.select("media_id", F.array_append(planned, F.col("dur_ms").cast(L)).alias("bounds"))


# Fixed values of the placement scheduler, in milliseconds or as ratios.
DRIFT, GAP, TAIL, FLOOR, RESIDUAL, SPEED, WORTH = 150, 120, 2000, 300, 50, 1.15, 1.02


def next_cuts(segs: DataFrame, cuts: DataFrame, most_ms: int) -> DataFrame:
    """segs with ``soon``, the cuts after the start up to most_ms later (one for each millisecond at most), in order, and
    ``later``, the first cut after those."""
    key = ["media_id"]
    starts = segs.select("media_id", "start_ms").distinct()
    points = cuts.select("media_id", F.col("cut_ms").cast(L).alias("b_start_ms"), F.col("cut_ms").cast(L).alias("b_end_ms")).distinct()
    reach = starts.withColumn("end_ms", F.col("start_ms") + most_ms)
    hit = intervals.overlap_join(reach, points, key, (F.col("b_start_ms") > F.col("start_ms")) & (F.col("b_start_ms") <= F.col("end_ms")))
    soon = hit.groupBy("media_id", "start_ms").agg(F.array_sort(F.collect_set("b_start_ms")).alias("soon"))
    later = intervals.asof(reach, points.select("media_id", "b_start_ms"), key, "end_ms", "b_start_ms", "_before", "later").drop("_before", "end_ms")
    return segs.join(later.join(soon, ["media_id", "start_ms"], "left"), ["media_id", "start_ms"], "left")


def place_voices(segs: DataFrame, cuts: DataFrame) -> DataFrame:
    """segs(media_id, seg_id, start_ms, end_ms, slot_ms, dub_ms): where each dubbed clip starts and how fast it plays.

    A clip starts with its segment, or a gap after the clip before, at most DRIFT late. It may use the silence up to the
    next segment's start, but not beyond the next scene cut if enough room is left; a longer clip is played faster, up to
    SPEED, and what still overruns is reported as overlap. A clip moves by DRIFT at most, so a row carries the cuts of that
    span and the first one after it. The state is the end of the last voice. A null length is no voice."""

    def step(prev: int, x: tuple, nxt: tuple | None) -> tuple[int, tuple]:
        seg, start, slot, dub, soon, later = x
        dub = dub or 0
        t = min(max(start, prev + GAP), start + DRIFT) if dub > 0 else start
        floor = max(50, min(slot, FLOOR))
        end = nxt[1] - GAP if nxt is not None else t + slot + TAIL
        scene = next((c for c in soon or () if c > t), later)
        if scene is not None and scene - 20 >= t + floor:
            end = min(end, scene - 20)
        room = max(end, t + floor) - t
        tempo = min(SPEED, dub / room) if dub > room and dub / room >= WORTH else 1.0
        played = math.ceil(dub / tempo)
        over = max(0, played - room)
        told = seg, t, t - start, room, tempo, over, max(0, prev + GAP - t) if dub > 0 else 0, over > RESIDUAL
        return max(prev, t + played) if dub > 0 else prev, told

    out = f"seg_id {dict(segs.dtypes)['seg_id']}, place_ms long, drift_ms long, room_ms long, tempo double, overrun_ms long, overlap_prev_ms long, needs_compaction boolean"
    known = next_cuts(segs.where("start_ms IS NOT NULL AND slot_ms IS NOT NULL"), cuts, DRIFT)
    return folds.carried(known, ["media_id"], ["start_ms", "seg_id"], ["seg_id", "start_ms", "slot_ms", "dub_ms", "soon", "later"], out, lambda: -1_000_000, step)


def highlight_candidates(segs: DataFrame, keywords: list[str], least_ms: int = 25_000, most_ms: int = 65_000, speaker: str = "speaker") -> DataFrame:
    """From each segment on, the first of it and those after it that ends least_ms after its start; kept if that is at most
    most_ms after it; scored by distinct keywords, changes of speaker and words per second of all segments between.

    The last segment is one that lasts over the moment least_ms after the start, or else the first to start then: a point join
    and an as-of join. Changes are counted between known speakers, and only if the first segment's is known."""
    key = ["media_id"]
    w = Window.partitionBy(*key).orderBy("start_ms", "seg_id")
    known = F.when(F.col(speaker) != "", F.col(speaker))
    rows = segs.withColumn("_known", known).withColumn("_last", F.last("_known", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumns({"rn": F.row_number().over(w), "changes": F.coalesce((F.col("_known") != F.col("_last")).cast("int"), F.lit(0))})
    rows = rows.withColumn("upto", F.sum("changes").over(w))
    goal = rows.select("media_id", F.col("rn").alias("first"), F.col("start_ms").alias("a_ms"), (F.col("start_ms") + least_ms).alias("goal"), F.when(F.col("_known").isNotNull(), F.col("upto")).alias("upto_a"))
    other = rows.select("media_id", F.col("rn").alias("last"), "upto", F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms"))
    point = goal.withColumns({"start_ms": F.col("goal"), "end_ms": F.col("goal")})
    over = intervals.overlap_join(point, other, key, (F.col("last") >= F.col("first")) & (F.col("b_start_ms") < F.col("goal")) & (F.col("b_end_ms") >= F.col("goal")))
    lasting = over.groupBy("media_id", "first").agg(F.min(F.struct("last", F.col("b_end_ms").alias("z_ms"), "upto")).alias("z1"))
    starting = other.groupBy("media_id", F.col("b_start_ms").alias("at")).agg(F.min(F.struct("last", F.col("b_end_ms").alias("z_ms"), "upto")).alias("z2"))
    found = intervals.asof(goal.withColumn("_before_goal", F.col("goal") - 1), starting, key, "_before_goal", "at").drop("before", "_before_goal")
    found = found.join(starting.withColumnRenamed("at", "after"), ["media_id", "after"], "left")
    ends = found.join(lasting, ["media_id", "first"], "left").withColumn("z", F.least("z1", "z2"))
    spans = ends.where(F.col("z.z_ms") - F.col("a_ms") <= most_ms).select("media_id", "first", F.col("a_ms").alias("start_ms"), F.col("z.z_ms").alias("end_ms"), F.col("z.last").alias("last"), F.coalesce(F.col("z.upto") - F.col("upto_a"), F.lit(0)).alias("changes"))
    texts = rows.select("media_id", "rn", F.coalesce("text", F.lit("")).alias("text"), F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms"))
    inside = intervals.overlap_join(spans, texts, key, F.col("rn").between(F.col("first"), F.col("last")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"]), " ")
    made = inside.groupBy("media_id", "first", "start_ms", "end_ms", "changes", "last").agg(text.alias("text"))
    hits = F.lit(0)
    for k in keywords:
        hits = hits + F.lower("text").contains(k.lower()).cast("int")
    rate = F.regexp_count("text", F.lit(r"\S+")) * 1000.0 / F.greatest(F.lit(1000), F.col("end_ms") - F.col("start_ms"))
    score = F.lit(60) + F.least(F.lit(25), hits * 6) + F.least(F.lit(10), F.col("changes") * 3) + F.when(rate.between(2.5, 4.5), 5).otherwise(0)
    return made.withColumn("score", F.least(F.lit(98), score).cast("int")).drop("text")


def select_clips(candidates: DataFrame, k: int) -> DataFrame:
    """Best first, leaving out clips of which more than half is already chosen; at most k per media."""
    def overlaps(chosen: Column, x: Column) -> Column:
        return F.exists(chosen, lambda c: F.least(c["end_ms"], x["end_ms"]) - F.greatest(c["start_ms"], x["start_ms"]) > (x["end_ms"] - x["start_ms"]) / 2)

    kind = "array<struct<start_ms:bigint,end_ms:bigint,score:int,first:int>>"
    grouped = folds.ordered(candidates.withColumn("worst", -F.col("score")), ["media_id"], ["worst", "first"], ["start_ms", "end_ms", "score", "first"])
    grouped = grouped.withColumn("items", F.col("items").cast(kind))
    chosen = F.aggregate(
        "items", F.array().cast(kind),
        lambda acc, x: F.when((F.size(acc) < k) & ~overlaps(acc, x), F.array_append(acc, x)).otherwise(acc),
    )
    return grouped.select("media_id", F.posexplode(chosen).alias("place", "_clip")).select("media_id", "place", "_clip.*")


def cluster_regions(boxes: DataFrame, frames: DataFrame, near: float = 0.06, occurrence: float = 0.20) -> DataFrame:
    """Leader clustering of boxes in (frame, box) order: a box joins the first cluster whose first box is near in y and h.
    Clusters seen in enough frames are kept with their hull. frames(media_id, n_frames). The state holds a leader, a hull and a
    count for each cluster, and the leaders by cells a little wider than ``near``, so a box looks at nine cells."""
    cell = near * 1.001

    def step(state: tuple[list, dict], b: tuple, _) -> tuple[tuple, None]:
        found, cells = state
        x, y, w, h = b
        i, j = math.floor(y / cell), math.floor(h / cell)
        fits = [c for p in (i - 1, i, i + 1) for q in (j - 1, j, j + 1) for c in cells.get((p, q), ()) if abs(found[c][0] - y) <= near and abs(found[c][1] - h) <= near]
        if fits:
            c = found[min(fits)]
            c[2:] = c[2] + 1, min(c[3], x), min(c[4], y), max(c[5], x + w), max(c[6], y + h)
        else:
            cells.setdefault((i, j), []).append(len(found))
            found.append([y, h, 1, x, y, x + w, y + h])
        return state, None

    whole = boxes.where(" AND ".join(f"{c} IS NOT NULL" for c in "xywh")).withColumns({c: F.col(c).cast("double") for c in "xywh"})
    out = "c int, n long, x0 double, y0 double, x1 double, y1 double"
    per = folds.carried(whole, ["media_id"], ["frame", "box"], ["x", "y", "w", "h"], out, lambda: ([], {}), step, lambda s: ((k, *c[2:]) for k, c in enumerate(s[0], 1)))
    seen = per.join(frames, "media_id").withColumn("occurrence", F.col("n") / F.col("n_frames"))
    return seen.where(F.col("occurrence") >= occurrence)


def merge_boxes(boxes: DataFrame, overlap: float = 0.5, gap: float = 0.05) -> DataFrame:
    """Greedy merge inside a frame, boxes ordered by (y, x): with the first merged box it shares half its height with and
    stands close to."""
    kind = "array<struct<x:double,y:double,w:double,h:double>>"
    grouped = folds.ordered(boxes, ["media_id", "frame"], ["y", "x", "box"], ["x", "y", "w", "h"])

    def step(acc: Column, b: Column) -> Column:
        def near(m: Column) -> Column:
            shared = F.least(m["y"] + m["h"], b["y"] + b["h"]) - F.greatest(m["y"], b["y"])
            apart = F.greatest(m["x"], b["x"]) - F.least(m["x"] + m["w"], b["x"] + b["w"])
            return (shared >= overlap * F.least(m["h"], b["h"])) & (apart <= gap)

        at = F.array_position(F.transform(acc, near), True).cast("int")

        def hull(m: Column) -> Column:
            x, y = F.least(m["x"], b["x"]), F.least(m["y"], b["y"])
            return F.struct(
                x.cast("double").alias("x"), y.cast("double").alias("y"),
                (F.greatest(m["x"] + m["w"], b["x"] + b["w"]) - x).cast("double").alias("w"), (F.greatest(m["y"] + m["h"], b["y"] + b["h"]) - y).cast("double").alias("h"),
            )

        own = F.struct(*[b[k].cast("double").alias(k) for k in "xywh"])
        return F.when(at == 0, F.array_append(acc, own)).otherwise(F.transform(acc, lambda m, i: F.when(i == at - 1, hull(m)).otherwise(m)))

    merged = F.aggregate("items", F.array().cast(kind), step)
    return grouped.select("media_id", "frame", F.posexplode(merged).alias("box", "_box")).select("media_id", "frame", "box", "_box.*")


def merge_regions(manual: DataFrame, auto: DataFrame, dx: float = 0.08, dy: float = 0.06) -> DataFrame:
    """Auto regions(media_id, n, x, y, w, h) whose centre is not near that of a manual one or of a kept auto one."""
    kind = "array<struct<cx:double,cy:double,n:bigint>>"
    centre = [(F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy")]
    fixed = manual.select("media_id", *centre).groupBy("media_id").agg(F.collect_list(F.struct("cx", "cy", F.lit(-1).cast(L).alias("n"))).cast(kind).alias("fixed"))
    rows = folds.ordered(auto.select("media_id", "n", *centre), ["media_id"], ["n"], ["cx", "cy", "n"]).join(fixed, "media_id", "left")
    zero = F.coalesce("fixed", F.array().cast(kind))

    def step(acc: Column, b: Column) -> Column:
        near = F.exists(acc, lambda m: (F.abs(m["cx"] - b["cx"]) < dx) & (F.abs(m["cy"] - b["cy"]) < dy))
        own = F.struct(b["cx"].cast("double").alias("cx"), b["cy"].cast("double").alias("cy"), b["n"].cast(L).alias("n"))
        return F.when(near, acc).otherwise(F.array_append(acc, own))

    kept = F.filter(F.aggregate(F.col("items"), zero, step), lambda m: m["n"] >= 0)
    return rows.select("media_id", F.explode(kept).alias("_kept")).select("media_id", F.col("_kept.n").alias("n"))
