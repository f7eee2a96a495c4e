"""Queries of ordered recursions. Their DuckDB checks are recursive common table expressions by row number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as S
from ..operators import timeline as T
from .registry import query


def _jittered(t):
    s = F.col("seg_id")
    return t.segments.select("media_id", "seg_id", (F.col("start_ms") - s % 4 * 700).alias("start_ms"), (F.col("end_ms") - s % 5 * 400).alias("end_ms"))


JIT = ", j AS (SELECT media_id, seg_id, start_ms - seg_id % 4 * 700 AS s, end_ms - seg_id % 5 * 400 AS e FROM segments)"


@query("e6_deoverlap", "segments", JIT + """
, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY s, seg_id) AS rn FROM j),
r AS (WITH RECURSIVE f(media_id, seg_id, rn, a, z) AS (
  SELECT media_id, seg_id, rn, greatest(0, s), greatest(e, greatest(0, s) + 100) FROM n WHERE rn = 1
  UNION ALL SELECT n.media_id, n.seg_id, n.rn, greatest(0, s, z), CASE WHEN z > greatest(0, s) THEN greatest(e, greatest(0, s) + 100, z + 100) ELSE greatest(e, greatest(0, s) + 100) END
  FROM f JOIN n ON n.media_id = f.media_id AND n.rn = f.rn + 1) SELECT * FROM f)
SELECT media_id, seg_id, rn AS new_id, a AS start_ms, z AS end_ms FROM r""")  # fmt: skip
def _(t):
    return T.deoverlap(_jittered(t))


@query("e8_repair_cues", "segments", JIT + """
, n AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_id) AS n, s, e, lead(s) OVER (PARTITION BY media_id ORDER BY seg_id) AS ns, lead(e) OVER (PARTITION BY media_id ORDER BY seg_id) AS ne FROM j),
r AS (WITH RECURSIVE f(media_id, n, s, e, cs, ce) AS (
  SELECT media_id, n, s, CASE WHEN ns IS NOT NULL AND e > ns - 10 THEN least(e, CASE WHEN ns < s + 200 THEN s + 210 ELSE ns END - 10) ELSE e END,
    CASE WHEN e > ns - 10 AND ns < s + 200 THEN s + 210 ELSE ns END, CASE WHEN e > ns - 10 AND ns < s + 200 THEN greatest(ne, s + 410) ELSE ne END FROM n WHERE n = 1
  UNION ALL SELECT n.media_id, n.n, f.cs, CASE WHEN n.ns IS NOT NULL AND f.ce > n.ns - 10 THEN least(f.ce, CASE WHEN n.ns < f.cs + 200 THEN f.cs + 210 ELSE n.ns END - 10) ELSE f.ce END,
    CASE WHEN f.ce > n.ns - 10 AND n.ns < f.cs + 200 THEN f.cs + 210 ELSE n.ns END, CASE WHEN f.ce > n.ns - 10 AND n.ns < f.cs + 200 THEN greatest(n.ne, f.cs + 410) ELSE n.ne END
  FROM f JOIN n ON n.media_id = f.media_id AND n.n = f.n + 1) SELECT * FROM f)
SELECT media_id, CAST(n AS INT) AS n, s AS start_ms, e AS end_ms FROM r""")  # fmt: skip
def _(t):
    from pyspark.sql import Window

    cues = _jittered(t).withColumn("n", F.row_number().over(Window.partitionBy("media_id").orderBy("seg_id")))
    return T.repair_cues(cues)


@query("e24_auto_split", "segments", """
, n AS (SELECT *, row_number() OVER w AS rn, lead(start_ms) OVER w AS ns FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, seg_id)),
r AS (WITH RECURSIVE f(media_id, rn, b, at_ms) AS (
  SELECT media_id, rn, CASE WHEN end_ms >= 20000 AND ns - end_ms >= 300 THEN (end_ms + ns) // 2 ELSE 0 END, CASE WHEN end_ms >= 20000 AND ns - end_ms >= 300 THEN (end_ms + ns) // 2 END FROM n WHERE rn = 1
  UNION ALL SELECT n.media_id, n.rn, CASE WHEN end_ms - b >= 20000 AND ns - end_ms >= 300 THEN (end_ms + ns) // 2 ELSE b END, CASE WHEN end_ms - b >= 20000 AND ns - end_ms >= 300 THEN (end_ms + ns) // 2 END
  FROM f JOIN n ON n.media_id = f.media_id AND n.rn = f.rn + 1) SELECT * FROM f)
SELECT media_id, at_ms FROM r WHERE at_ms IS NOT NULL""")  # fmt: skip
def _(t):
    return T.auto_split(t.segments, 20_000)


@query("e29_plan_bounds", "segments scene_cuts", """
, d AS (SELECT media_id, max(end_ms) AS dur FROM segments GROUP BY media_id),
k AS (SELECT d.media_id, dur, list_sort(list(DISTINCT CAST(cut_ms AS BIGINT))) AS cuts FROM d LEFT JOIN scene_cuts USING (media_id) GROUP BY ALL),
r AS (WITH RECURSIVE f(media_id, dur, cuts, i, cur, bounds) AS (
  SELECT media_id, dur, cuts, 0, CAST(0 AS BIGINT), CAST([0] AS BIGINT[]) FROM k
  UNION ALL SELECT media_id, dur, cuts, i + 1, best, CASE WHEN best IS NULL THEN bounds ELSE list_append(bounds, best) END FROM (
    SELECT *, list_sort(list_transform(list_filter(cuts, lambda c: c > cur + 5000 AND c < dur - 5000), lambda c: {'d': abs(c - (i + 1) * dur / 4), 'c': c}))[1].c AS best
    FROM f WHERE i < 3 AND dur > 20000 AND cur IS NOT NULL)) SELECT * FROM f),
l AS (SELECT media_id, any_value(dur) AS dur, arg_max(bounds, i) AS bounds FROM r GROUP BY media_id),
b AS (SELECT media_id, list_append(bounds, dur) AS bounds FROM l)
SELECT media_id, CAST(unnest(range(0, len(bounds))) AS INT) AS part, unnest(bounds) AS at_ms FROM b""")  # fmt: skip
def _(t):
    lengths = t.segments.groupBy("media_id").agg(F.max("end_ms").alias("dur_ms"))
    return T.plan_bounds(t.scene_cuts, lengths, 4, 5_000).select("media_id", F.posexplode("bounds").alias("part", "at_ms"))


def _dubbed(t):
    return S.annotate_slots(t.segments).withColumn("dub_ms", F.floor(F.col("dur_ms") * (60 + F.col("media_id") * 7 % 90) / 100))


PLACED = """
, n AS (SELECT media_id, seg_id, start_ms AS s, greatest(300, coalesce(lead(start_ms) OVER w - start_ms, end_ms - start_ms + 2000)) AS slot, lead(start_ms) OVER w AS nx,
    dur_ms * (60 + media_id * 7 % 90) // 100 AS dub, row_number() OVER w AS rn FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, seg_id)),
k AS (SELECT media_id, list_sort(list(DISTINCT CAST(cut_ms AS BIGINT))) AS cuts FROM scene_cuts GROUP BY media_id),
b AS (SELECT n.*, coalesce(cuts, CAST([] AS BIGINT[])) AS cuts FROM n LEFT JOIN k USING (media_id)),
r AS (WITH RECURSIVE f(media_id, rn, prev, seg_id, t, drift, room, tempo, over, before) AS (
  SELECT media_id, CAST(0 AS BIGINT), CAST(-1000000 AS BIGINT), CAST(NULL AS INT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1.0::DOUBLE, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM b WHERE rn = 1
  UNION ALL SELECT media_id, rn, CASE WHEN dub > 0 THEN greatest(prev, t + played) ELSE prev END, seg_id, t, t - s, e - t, tempo, greatest(0, t + played - e), CASE WHEN dub > 0 THEN greatest(0, prev + 120 - t) ELSE 0 END
  FROM (SELECT *, CAST(ceil(dub / tempo) AS BIGINT) AS played FROM (
    SELECT *, CASE WHEN dub > e - t AND dub::DOUBLE / (e - t) >= 1.02 THEN least(1.15::DOUBLE, dub::DOUBLE / (e - t)) ELSE 1.0::DOUBLE END AS tempo FROM (
      SELECT *, greatest(CASE WHEN scene >= t + low THEN least(e0, scene) ELSE e0 END, t + low) AS e FROM (
        SELECT *, list_min(list_filter(cuts, lambda c: c > t)) - 20 AS scene, greatest(50, least(slot, 300)) AS low, coalesce(nx - 120, t + slot + 2000) AS e0 FROM (
          SELECT b.*, f.prev, least(CASE WHEN dub > 0 THEN greatest(s, prev + 120) ELSE s END, s + 150) AS t FROM f JOIN b ON b.media_id = f.media_id AND b.rn = f.rn + 1)))))) SELECT * FROM f WHERE rn > 0)"""


@query("e7_place_voices", "segments scene_cuts", PLACED + """
SELECT media_id, seg_id, t AS place_ms, drift AS drift_ms, room AS room_ms, tempo, over AS overrun_ms, before AS overlap_prev_ms, over > 50 AS needs_compaction FROM r""")  # fmt: skip
def _(t):
    return T.place_voices(_dubbed(t), t.scene_cuts)


KEYWORDS = ["tion", "heat", "queue", "para"]


CANDIDATES = """
, q AS (SELECT media_id, seg_id, start_ms, text, CASE WHEN seg_id % 5 = 0 THEN end_ms + 30000 ELSE end_ms END AS end_ms, CASE WHEN (media_id + seg_id) % 4 = 1 THEN NULL ELSE speaker END AS speaker FROM segments),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) AS rn FROM q),
j AS (SELECT a.media_id, a.rn AS first, a.start_ms, a.speaker AS led, min(b.rn) AS last FROM r a JOIN r b ON b.media_id = a.media_id AND b.rn >= a.rn AND b.end_ms >= a.start_ms + 25000 GROUP BY ALL),
z AS (SELECT j.*, r.end_ms FROM j JOIN r ON r.media_id = j.media_id AND r.rn = j.last WHERE r.end_ms - j.start_ms <= 65000),
p AS (SELECT z.*, r.rn, r.text, r.speaker, last_value(r.speaker IGNORE NULLS) OVER (PARTITION BY z.media_id, z.first ORDER BY r.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known
  FROM z JOIN r ON r.media_id = z.media_id AND r.rn BETWEEN z.first AND z.last),
i AS (SELECT media_id, first, last, start_ms, end_ms, string_agg(text, ' ' ORDER BY rn) AS text, CASE WHEN led IS NULL THEN 0 ELSE count(*) FILTER (speaker <> known) END AS ch FROM p GROUP BY media_id, first, last, start_ms, end_ms, led),
s AS (SELECT *, len(regexp_extract_all(text, '\\S+')) * 1000.0::DOUBLE / greatest(1000, end_ms - start_ms) AS rate,
  (contains(lower(text), 'tion')::INT + contains(lower(text), 'heat')::INT + contains(lower(text), 'queue')::INT + contains(lower(text), 'para')::INT) AS hits FROM i),
h AS (SELECT media_id, CAST(first AS INT) AS first, CAST(last AS INT) AS last, start_ms, end_ms, CAST(ch AS BIGINT) AS changes,
  CAST(least(98, 60 + least(25, hits * 6) + least(10, ch * 3) + CASE WHEN rate BETWEEN 2.5 AND 4.5 THEN 5 ELSE 0 END) AS INT) AS score FROM s)"""


def _crossing(t):
    """Segments of which some last into those after them, and some have no known speaker."""
    longer = F.when(F.col("seg_id") % 5 == 0, F.col("end_ms") + 30_000).otherwise(F.col("end_ms"))
    return t.segments.withColumns({"end_ms": longer, "speaker": F.when((F.col("media_id") + F.col("seg_id")) % 4 != 1, F.col("speaker"))})


@query("f1_highlights", "segments", CANDIDATES + "SELECT * FROM h")
def _(t):
    return T.highlight_candidates(_crossing(t), KEYWORDS)


@query("f2_select_clips", "segments", CANDIDATES + """
, o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, first) AS rn FROM h),
g AS (WITH RECURSIVE f(media_id, rn, chosen) AS (
  SELECT media_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(a BIGINT, z BIGINT, score INT, first INT)[]) FROM o WHERE rn = 1
  UNION ALL SELECT o.media_id, o.rn, CASE WHEN len(chosen) < 3 AND len(list_filter(chosen, lambda c: least(c.z, end_ms) - greatest(c.a, start_ms) > (end_ms - start_ms) / 2)) = 0
    THEN list_append(chosen, {'a': start_ms, 'z': end_ms, 'score': score, 'first': o.first}) ELSE chosen END FROM f JOIN o ON o.media_id = f.media_id AND o.rn = f.rn + 1) SELECT * FROM f),
l AS (SELECT media_id, arg_max(chosen, rn) AS chosen FROM g GROUP BY media_id),
u AS (SELECT media_id, chosen, unnest(range(1, len(chosen) + 1)) AS i FROM l)
SELECT media_id, CAST(i - 1 AS INT) AS place, chosen[i].a AS start_ms, chosen[i].z AS end_ms, chosen[i].score AS score, chosen[i].first AS first FROM u""")  # fmt: skip
def _(t):
    return T.select_clips(T.highlight_candidates(_crossing(t), KEYWORDS), 3)


BOXES = ", n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY frame, box) AS rn FROM boxes)"


@query("d16_cluster_regions", "boxes", BOXES + """
, r AS (WITH RECURSIVE f(media_id, rn, lead, c, x, y, w, h) AS (
  SELECT media_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(y DOUBLE, h DOUBLE)[]), 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM n WHERE rn = 1
  UNION ALL SELECT media_id, rn, CASE WHEN hit = 0 THEN list_append(lead, {'y': y, 'h': h}) ELSE lead END, CASE WHEN hit = 0 THEN len(lead) + 1 ELSE hit END, x, y, w, h FROM (
    SELECT n.*, f.lead, coalesce(list_position(list_transform(f.lead, lambda q: abs(q.y - n.y) <= 0.06::DOUBLE AND abs(q.h - n.h) <= 0.06::DOUBLE), true), 0) AS hit FROM f JOIN n ON n.media_id = f.media_id AND n.rn = f.rn + 1)) SELECT * FROM f WHERE rn > 0),
m AS (SELECT media_id, count(DISTINCT frame) AS n_frames FROM boxes GROUP BY media_id),
g AS (SELECT media_id, c, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM r GROUP BY ALL)
SELECT media_id, CAST(c AS INT) AS c, n, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, n_frames, round(n / n_frames, 6) AS occurrence FROM g JOIN m USING (media_id) WHERE n / n_frames >= 0.20""")  # fmt: skip
def _(t):
    frames = t.boxes.groupBy("media_id").agg(F.countDistinct("frame").alias("n_frames"))
    return T.cluster_regions(t.boxes, frames).withColumns({c: F.round(c, 6) for c in ("x0", "y0", "x1", "y1", "occurrence")})


@query("d17_merge_boxes", "boxes", """
, n AS (SELECT *, row_number() OVER (PARTITION BY media_id, frame ORDER BY y, x, box) AS rn FROM boxes),
r AS (WITH RECURSIVE f(media_id, frame, rn, acc) AS (
  SELECT media_id, frame, CAST(0 AS BIGINT), CAST([] AS STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]) FROM n WHERE rn = 1
  UNION ALL SELECT media_id, frame, rn, CASE WHEN hit = 0 THEN list_append(acc, {'x': x, 'y': y, 'w': w, 'h': h}) ELSE list_transform(acc, lambda m, i: CASE WHEN i = hit THEN
      {'x': least(m.x, x), 'y': least(m.y, y), 'w': greatest(m.x + m.w, x + w) - least(m.x, x), 'h': greatest(m.y + m.h, y + h) - least(m.y, y)} ELSE m END) END FROM (
    SELECT n.*, f.acc, coalesce(list_position(list_transform(f.acc, lambda m: least(m.y + m.h, n.y + n.h) - greatest(m.y, n.y) >= 0.5::DOUBLE * least(m.h, n.h)
      AND greatest(m.x, n.x) - least(m.x + m.w, n.x + n.w) <= 0.05::DOUBLE), true), 0) AS hit FROM f JOIN n ON n.media_id = f.media_id AND n.frame = f.frame AND n.rn = f.rn + 1)) SELECT * FROM f),
l AS (SELECT media_id, frame, arg_max(acc, rn) AS acc FROM r GROUP BY ALL),
u AS (SELECT media_id, frame, acc, unnest(range(1, len(acc) + 1)) AS i FROM l)
SELECT media_id, frame, CAST(i - 1 AS INT) AS box, round(acc[i].x, 6) AS x, round(acc[i].y, 6) AS y, round(acc[i].w, 6) AS w, round(acc[i].h, 6) AS h FROM u""")  # fmt: skip
def _(t):
    return T.merge_boxes(t.boxes).withColumns({c: F.round(c, 6) for c in "xywh"})


@query("c18_merge_regions", "boxes", """
, c AS (SELECT media_id, frame, frame * 3 + box AS n, x + w / 2 AS cx, y + h / 2 AS cy FROM boxes),
k AS (SELECT media_id, list({'cx': cx, 'cy': cy, 'n': CAST(-1 AS BIGINT)}) AS fixed FROM c WHERE frame = 0 GROUP BY media_id),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY n) AS rn FROM c WHERE frame > 0),
r AS (WITH RECURSIVE f(media_id, rn, acc) AS (
  SELECT media_id, CAST(0 AS BIGINT), coalesce(fixed, CAST([] AS STRUCT(cx DOUBLE, cy DOUBLE, n BIGINT)[])) FROM n LEFT JOIN k USING (media_id) WHERE rn = 1
  UNION ALL SELECT n.media_id, n.rn, CASE WHEN len(list_filter(acc, lambda m: abs(m.cx - n.cx) < 0.08::DOUBLE AND abs(m.cy - n.cy) < 0.06::DOUBLE)) > 0 THEN acc
    ELSE list_append(acc, {'cx': n.cx, 'cy': n.cy, 'n': CAST(n.n AS BIGINT)}) END FROM f JOIN n ON n.media_id = f.media_id AND n.rn = f.rn + 1) SELECT * FROM f),
l AS (SELECT media_id, unnest(arg_max(acc, rn)) AS m FROM r GROUP BY media_id)
SELECT media_id, m.n AS n FROM l WHERE m.n >= 0""")  # fmt: skip
def _(t):
    manual, auto = t.boxes.where("frame = 0"), t.boxes.where("frame > 0").withColumn("n", (F.col("frame") * 3 + F.col("box")).cast("long"))
    return T.merge_regions(manual, auto)
