"""Queries of text and url corpus jobs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import texts as J
from .registry import query

TERMS = [("the", "THE"), ("the anea", "A-N"), ("tion", "-T-"), ("ention", "ENT"), ("und", "&")]


@query("h2_ocr_normal", "segments", r"""
SELECT media_id, seg_id, regexp_replace(text || 'A0x', '[^\p{L}\p{N}]', '', 'g') AS plain FROM segments""")  # fmt: skip
def _(t):
    return t.segments.select("media_id", "seg_id", X.ocr_normal(F.concat("text", F.lit("Ａ０ｘ"))).alias("plain"))


@query("h3_similarity", "segments ocr_segments")
def _(t):
    both = t.segments.join(t.ocr_segments.select("media_id", F.col("ocr_id").alias("seg_id"), F.col("text").alias("ocr_text")), ["media_id", "seg_id"])
    shown = F.when(F.col("seg_id") % 2 == 0, F.expr("substring(ocr_text, 3)")).otherwise(F.concat(F.lit("¡前"), "ocr_text", F.lit("後!")))
    told = both.select("media_id", "seg_id", *[x.alias(n) for n, x in X.align(F.col("text"), shown).items()])
    return told.withColumns({"ratio_milli": F.floor(F.col("similarity") * 1000)}).drop("similarity")


@query("h4_glossary", "", r"""
, k AS (SELECT source, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]') AS k FROM documents),
p AS (SELECT source, text, k, list_transform(range(1, len(k) + 1), lambda i: lower(k[i]) = 'the' AND k[i + 1] = ' ' AND lower(k[i + 2]) = 'anea') AS two FROM k),
r AS (SELECT source, text, array_to_string(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN two[i] THEN 'A-N' WHEN i > 1 AND two[i - 1] OR i > 2 AND two[i - 2] THEN ''
  ELSE CASE lower(k[i]) WHEN 'the' THEN 'THE' WHEN 'tion' THEN '-T-' WHEN 'ention' THEN 'ENT' WHEN 'und' THEN '&' ELSE k[i] END END), '') AS put FROM p)
SELECT source, count(*) AS n, count(*) FILTER (put <> text) AS changed, CAST(sum(length(put)) AS BIGINT) AS chars FROM r GROUP BY source""")  # fmt: skip
def _(t):
    return J.changed(t.documents.select("source", "text"), "text", X.glossary(F.col("text"), TERMS), "source")


@query("h5_find_replace", "", r"""
SELECT source, count(*) AS n, count(*) FILTER (t <> text) AS changed, CAST(sum(length(t)) AS BIGINT) AS chars
FROM (SELECT source, text, regexp_replace(text, 'haing', 'X$Y', 'gi') AS t FROM documents) GROUP BY source""")  # fmt: skip
def _(t):
    return J.changed(t.documents.select("source", "text"), "text", X.find_replace(F.col("text"), "haing", "X$Y"), "source")


@query("h6_hard_lock", "segments", r"""
SELECT media_id, seg_id, trim(regexp_replace(replace(replace(replace(text, 'ention', ' ENT '), 'thon', ' T '), 'tion', ' IO '), ' +', ' ', 'g')) AS locked FROM segments""")  # fmt: skip
def _(t):
    return t.segments.select("media_id", "seg_id", X.hard_lock(F.col("text"), {"tion": "IO", "ention": "ENT", "thon": "T"}).alias("locked"))


# What a segment's line ends in, by turns: {n} its start, {k} its number, {d} a day, {m} a month, {h} an hour.
FORMS = [
    "{n} kg", "{k}-9, 3,5 km", "${n}", "{h}h30", "{h}:05", "{d}/{m}/1975", "ngày {d}/{m}", "tháng {m}/2024", "{k}°C", "1/{d}", "{d}%", "{k}MB",
    "RTX {n}", "AI và CPU {k}", "{n}đ", "[Nhạc] 007", "Top {k}", "No.{k}", "a@b + {k}", "1.500 m và 2,75",
]


def spoken_lines(segs):
    """The whole text of every segment, and after it a form that the rules read."""
    k = F.col("seg_id")
    values = {"n": F.col("start_ms"), "k": k, "d": k % 28 + 1, "m": k % 12 + 1, "h": k % 24}
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.pmod(F.col("media_id") + k, F.lit(len(FORMS))) + 1).cast("int"))
    for name, v in values.items():
        form = F.replace(form, F.lit("{" + name + "}"), v.cast("string"))
    return segs.select("media_id", "seg_id", form.alias("form"), F.concat(F.coalesce("text", F.lit("")), F.lit(" ; "), form).alias("text"))


@query("h7_spoken_form", "segments")
def _(t):
    return spoken_lines(t.segments).select("media_id", "seg_id", "text", X.spoken_udf()(F.col("text")).alias("spoken"))


@query("h9_compact", "segments", r"""
SELECT media_id, seg_id, regexp_replace(replace(text || ' rất là ok', 'rất là', ''), '\s+', ' ', 'g') AS compact FROM segments""")  # fmt: skip
def _(t):
    return t.segments.select("media_id", "seg_id", X.compact(F.concat("text", F.lit(" rất là ok"))).alias("compact"))


URL_SQL = r"""
, p AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS h, lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')) AS pa,
  regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '[?&]modal_id=(\d+)', 1) AS modal FROM urls),
k AS (SELECT *, lower(array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains(['spm_id_from','spm_id','si','fbclid','feature','from_source','is_from_webapp','sender_device'], lower(split_part(x, '=', 1)))
  AND NOT (contains(h, 'bilibili.com') AND list_contains(['vd_source','share_source','from_spmid','share_medium','share_plat','share_session_id','share_tag','bbid','ts','buvid','mid'], lower(split_part(x, '=', 1))))), '&')) AS kept FROM p),
u AS (SELECT page_id, CASE WHEN contains(h, 'douyin.com') AND modal <> '' THEN 'https://www.douyin.com/video/' || modal ELSE h || pa || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canon,
  CASE WHEN regexp_extract(url, '(BV[a-zA-Z0-9]{10})', 1) <> '' THEN regexp_extract(url, '(BV[a-zA-Z0-9]{10})', 1) WHEN contains(url, 'youtube.com') THEN regexp_extract(url, '[?&]v=([^&#]+)', 1)
   WHEN modal <> '' THEN modal ELSE '' END AS vid, coalesce(nullif(regexp_extract(url, '[?&]p=([^&#]*)', 1), ''), '1') AS part FROM k)"""


@query("h10_canonical_url", "urls", URL_SQL + " SELECT page_id, canon, vid, part FROM u")
def _(t):
    u = F.col("url")
    note = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("look: "), u, F.lit(" , so good"))).otherwise(F.concat(u, F.lit("...")))
    pasted = t.urls.select("page_id", X.pasted_url(note).alias("url"))
    return pasted.select("page_id", X.canonical_url(u).alias("canon"), X.video_id(u).alias("vid"), X.url_part(u).alias("part"))


@query("c12_same_media", "urls", URL_SQL + """
, c AS (SELECT canon, max(page_id) AS m FROM u GROUP BY canon), v AS (SELECT vid, part, max(page_id) AS m FROM u WHERE vid <> '' GROUP BY ALL)
SELECT page_id, u.canon, nullif(u.vid, '') AS vid, greatest(c.m, v.m) AS media_id FROM u JOIN c ON c.canon = u.canon LEFT JOIN v ON v.vid = u.vid AND v.part = u.part""")  # fmt: skip
def _(t):
    return J.same_media(t.urls)


@query("a5_manifest", "urls", """
, l AS (SELECT page_id AS ord, url, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'voice' || page_id % 3 END AS voice FROM urls WHERE page_id % 7 > 1)
SELECT ord, url, voice FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS rn FROM l) WHERE rn = 1""")  # fmt: skip
def _(t):
    p = F.col("page_id")
    voice = F.concat(F.lit("voice"), (p % 3).cast("string"))
    sep = F.when(p % 5 == 1, " | ").when(p % 5 == 2, ", ").when(p % 5 == 3, "\t").otherwise("   ")
    line = F.when(p % 7 == 0, "  ").when(p % 7 == 1, F.concat(F.lit("# "), "url")).when(p % 5 == 0, F.col("url")).otherwise(F.concat("url", sep, voice))
    return J.read_manifest(t.urls.select(p.alias("ord"), line.alias("line")))


@query("h13_route_logs", "", r"""
, l AS (SELECT event_id AS id, event_type || ' took ' || event_id || ' ms at http://x/' || user_id || CASE WHEN event_id % 9 = 0 THEN ' Traceback' ELSE '' END AS line FROM events),
r AS (SELECT *, CASE WHEN regexp_matches(line, '^err') THEN 'failed' WHEN regexp_matches(line, '7 ms') THEN 'seven' WHEN regexp_matches(line, '^(view|click)') THEN 'seen' END AS label FROM l)
SELECT id, coalesce(label, regexp_replace(regexp_replace(line, 'https?://\S+', '<url>', 'g'), '\d+', '<n>', 'g')) AS shown FROM r WHERE label IS NOT NULL OR NOT regexp_matches(line, 'Traceback|Exception|0x[0-9a-f]')""")  # fmt: skip
def _(t):
    tail = F.when(F.col("event_id") % 9 == 0, " Traceback").otherwise("")
    line = F.concat("event_type", F.lit(" took "), F.col("event_id").cast("string"), F.lit(" ms at http://x/"), F.col("user_id").cast("string"), tail)
    rules = t.spark.sql("SELECT * FROM VALUES (1, '^err', 'failed'), (2, '7 ms', 'seven'), (3, '^(view|click)', 'seen') AS r(no, pattern, label)")
    return J.route_logs(t.events.select(F.col("event_id").alias("id"), line.alias("line")), rules).select("id", "shown")


@query("h14_salvage", "segments")
def _(t):
    row = F.to_json(F.struct(F.col("seg_id").alias("id"), "text"))
    packed = t.segments.groupBy("media_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(row)), ", "), F.lit("]")).alias("j"))
    m = F.col("media_id")
    raw = F.when(m % 4 == 0, F.col("j")).when(m % 4 == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(m % 4 == 2, F.concat(F.lit("Here: "), "j", F.lit(" done")))
    responses = packed.select(m.alias("id"), raw.otherwise(F.col("j").substr(F.lit(1), F.length("j") - 9)).alias("raw"))
    return J.salvage(responses, "array<struct<id:int,text:string>>").select("id", "how", F.size("items").alias("n_items"))


def _sql(text: str) -> str:
    """A template of a post as an SQL expression over title."""
    shown = re.sub(r"\{title:(\d+)\}", r"' || substr(title, 1, \1) || '", text.replace("{title}", "' || title || '"))
    return "('" + shown.replace("\n", "' || chr(10) || '") + "')"


def _sql_list(texts: list[str]) -> str:
    return "[" + ", ".join(map(_sql, texts)) + "]"


def _post_sql() -> str:
    """The four posts of a page by the case (page_id % 6) that says which fields are given."""
    post = {name: {"title": _sql(d["title"]), "description": _sql(d["description"]), "hashtags": _sql_list(d["hashtags"])} for name, d in J.POSTS.items()}
    post["youtube"]["title"] = "title"
    post["youtube"]["description"] = f"CASE WHEN k = 1 THEN 'about ' || url ELSE {post['youtube']['description']} END"
    post["youtube"]["hashtags"] = f"CASE WHEN k IN (2, 3) THEN ['#a', '#' || page_id % 9] ELSE {post['youtube']['hashtags']} END"
    shorts, facebook = post["youtube_shorts"], post["facebook"]
    shorts["title"] = f"CASE WHEN st = '' OR k NOT IN (3, 5) THEN {shorts['title']} WHEN k = 3 THEN st || ' #Shorts' ELSE st || ' #SHORTS' END"
    post["tiktok"]["title"] = f"CASE WHEN st <> '' AND k = 5 THEN st ELSE {post['tiktok']['title']} END"
    facebook["description"] = f"CASE WHEN k IN (1, 5) THEN 'fb ' || page_id ELSE {facebook['description']} END"
    facebook["hashtags"] = f"CASE WHEN k IN (1, 5) THEN ['#fb'] ELSE {facebook['hashtags']} END"
    lists = {"alternative_titles": _sql_list(J.ALTERNATIVES), "tags": f"CASE WHEN k IN (1, 5) THEN ['t' || page_id % 5] ELSE {_sql_list(J.TAGS)} END"}
    parts = []
    for name, d in post.items():
        own = [f"array_to_string({x}, '|')" if name == "youtube" else "CAST(NULL AS VARCHAR)" for x in lists.values()]
        parts.append(f"SELECT page_id, '{name}' AS platform, {d['title']} AS title, {d['description']} AS description, "
                     f"array_to_string({d['hashtags']}, '|') AS hashtags, {own[0]} AS alternative_titles, {own[1]} AS tags FROM z")  # fmt: skip
    return "\nUNION ALL ".join(parts)


def page_metadata(pages):
    """Pages as videos: their text is the script; five of six carry metadata of some form, with the page's own title."""
    title, k = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.col("page_id") % 6
    text = F.lit("世界")
    fields = {
        "title": F.when(k.isin(1, 5), title),
        "description": F.when(k == 1, F.concat(F.lit("about "), "url")),
        "tags": F.when(k.isin(1, 5), F.array(F.concat(F.lit("t"), (F.col("page_id") % 5).cast("string")))),
        "alternative_titles": F.when(k == 2, F.array(F.lit("A"), text)),
        "youtube": F.when(k.isin(2, 3), F.struct(F.when(k == 2, title).otherwise(text).alias("title"), F.array(F.lit("#a"), F.concat(F.lit("#"), (F.col("page_id") % 9).cast("string"))).alias("hashtags"))),
        "youtube_shorts": F.when(k == 3, F.struct(title.alias("title"))).when(k == 5, F.struct(F.when(F.trim(title) != "", F.concat(F.rtrim(title), F.lit(" #SHORTS"))).alias("title"))),
        "tiktok": F.when(k == 5, F.struct(F.concat(F.lit("  "), title, F.lit("\n")).alias("title"), text.alias("description"), F.array(F.lit("#x"), text).alias("hashtags"))),
        "facebook": F.when(k.isin(1, 5), F.struct(text.alias("title"), F.concat(F.lit("fb "), F.col("page_id").cast("string")).alias("description"), F.array(F.lit("#fb")).alias("hashtags"))),
    }
    meta = F.when(k == 4, "not json").otherwise(F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()])))
    return pages.select(F.col("page_id").alias("id"), F.regexp_replace("html", "<[^>]*>", " ").alias("script"), meta.alias("meta"))


@query("h15_metadata", "", r"""
, b AS (SELECT page_id, page_id % 6 AS k, url, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), E' \t\n\r') AS st, regexp_replace(html, '<[^>]*>', ' ', 'g') AS script FROM pages),
s AS (SELECT *, list_filter(list_transform(regexp_split_to_array(script, '[.!?\n]+'), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '') AS ss FROM b),
z AS (SELECT *, CASE WHEN st <> '' AND k IN (1, 2, 5) THEN st ELSE substr(coalesce(ss[1], '""" + J.HEADLINE + """'), 1, 65) END AS title FROM s)
""" + _post_sql())  # fmt: skip
def _(t):
    made = J.posts(page_metadata(t.pages))
    return made.select(F.col("id").alias("page_id"), "platform", "title", "description", *[F.array_join(c, "|").alias(c) for c in ("hashtags", "alternative_titles", "tags")])


@query("h17_run_keys", "segments", """
SELECT media_id, CAST(seg_id // 3 AS BIGINT) AS batch, substr(sha256(string_agg(seg_id || chr(31) || text, chr(30) ORDER BY seg_id)), 1, 16) AS key FROM segments GROUP BY ALL""")  # fmt: skip
def _(t):
    return J.run_keys(t.segments.withColumn("batch", F.floor(F.col("seg_id") / 3)), "batch")


@query("h11_episode", "")
def _(t):
    """Page titles, two in three with an episode mark of some kind, beside their urls."""
    marks = ["Tập 12", "ep.07", "1-30", "全40集", "trọn bộ", "大结局", "第一百零五集", "第十七话", "(9)", "Part 0003", "x"]
    mark = F.element_at(F.array(*map(F.lit, marks)), (F.col("page_id") % (3 * len(marks)) % len(marks) + 1).cast("int"))
    title = F.concat_ws(" ", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.when(F.col("page_id") % 3 > 0, mark))
    return t.pages.select("page_id", J.episode(title, F.col("url"), F.col("page_id") % 5 * 1000).alias("episode"))
