"""Corpus jobs over text and url tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def changed(rows: DataFrame, column: str, new: Column, key: str) -> DataFrame:
    """The column rewritten, and the number of rows per key that changed."""
    both = rows.withColumn("_new", new)
    return both.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("_new") != F.col(column)).alias("changed"), F.sum(F.length("_new")).cast("long").alias("chars"))


def same_media(urls: DataFrame) -> DataFrame:
    """urls(page_id, url) -> page_id, newest other-or-own page of the same media: same canonical url, or same video id and
    same part. Two equality keys instead of an OR join; each takes the newest page by a window-free aggregate."""
    u = F.col("url")
    keyed = urls.select("page_id", X.canonical_url(u).alias("canon"), F.nullif(X.video_id(u), F.lit("")).alias("vid"), X.url_part(u).alias("part"))
    by_canon = keyed.groupBy("canon").agg(F.max("page_id").alias("newest_c"))
    by_id = keyed.where("vid IS NOT NULL").groupBy("vid", "part").agg(F.max("page_id").alias("newest_v"))
    told = keyed.join(by_canon, "canon").join(by_id, ["vid", "part"], "left")
    return told.select("page_id", "canon", "vid", F.greatest("newest_c", "newest_v").alias("media_id"))


def read_manifest(lines: DataFrame) -> DataFrame:
    """lines(ord, line): blank and # lines skipped, split once at | , ; tab or two blanks; the first of equal urls wins."""
    t = F.trim("line")
    kept = lines.where((t != "") & ~t.startswith("#"))
    parts = F.split(t, r"\s*[|,;\t]\s*|\s{2,}", 2)
    rows = kept.select("ord", F.trim(F.get(parts, F.lit(0))).alias("url"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("voice"))
    first = F.row_number().over(Window.partitionBy("url").orderBy("ord"))
    return rows.withColumn("_rn", first).where("_rn = 1").drop("_rn")


def route_logs(lines: DataFrame, rules: DataFrame, most: int = 1000) -> DataFrame:
    """lines(id, line) with the label of the first rule(no, pattern, label) that matches; lines without one lose urls and
    numbers, and are dropped if they look technical. Rules are a short table, counted first; they become one chain of
    conditions, so a line is read once, stops at its first match, and nothing is joined."""
    few = rules.orderBy("no").limit(most + 1).collect()
    if len(few) > most:
        raise ValueError(f"more than {most} rules")
    label = F.lit(None).cast("string")
    for r in reversed(few):
        label = F.when(F.col("line").rlike(r["pattern"]), r["label"]).otherwise(label)
    scrubbed = F.regexp_replace(F.regexp_replace("line", r"https?://\S+", "<url>"), r"\d+", "<n>")
    told = lines.withColumn("label", label)
    return told.withColumn("shown", F.coalesce("label", scrubbed)).where(F.col("label").isNotNull() | ~F.col("line").rlike("Traceback|Exception|0x[0-9a-f]"))


def salvage(responses: DataFrame, schema: str) -> DataFrame:
    """responses(id, raw) -> id, how (parsed, sliced, repaired, rejected), items. Only what fails natively is repaired."""
    raw = F.trim(F.regexp_replace("raw", r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    sliced = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    tried = responses.select("id", "raw", F.from_json(raw, schema).alias("a"), F.from_json(sliced, schema).alias("b"))

    def good(c: str) -> Column:
        return F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & x["id"].isNotNull())

    ok = tried.where(good("a") | good("b")).select("id", F.when(good("a"), "parsed").otherwise("sliced").alias("how"), F.when(good("a"), F.col("a")).otherwise(F.col("b")).alias("items"))
    bad = tried.where(~(good("a") | good("b")) | F.col("raw").isNull()).select("id", F.from_json(X.repair_udf()(F.col("raw")), schema).alias("items"))
    fixed = bad.select("id", F.when(good("items"), "repaired").otherwise("rejected").alias("how"), F.when(good("items"), F.col("items")).alias("items"))
    return ok.unionByName(fixed)


# What a post says where nothing usable is given. {title} is the video's title, {title:n} its first n characters.
HEADLINE = "Siêu Phẩm Video Lồng Tiếng Mới Nhất"
ALTERNATIVES = ["Bí Mật Đằng Sau: {title:45}", "Sự Thật Bất Ngờ Trong {title:45}", "Cái Kết Bất Ngờ Của {title:45}"]
TAGS = ["review phim", "lồng tiếng", "tóm tắt phim", "phim hay", "phim mới", "shorts", "xem phim", "viral video", "thịnh hành"]
POSTS = {
    "youtube": {
        "title": "{title}",
        "description": "{title}\n\nChào mừng bạn đến với video mới nhất! Hãy xem trọn vẹn video để không bỏ lỡ những tình tiết gay cấn và hấp dẫn nhất nhé.\n\n"
        "+ Đừng quên bấm LIKE, CHIA SẺ và ĐĂNG KÝ KÊNH để ủng hộ mình và đón xem những tập tiếp theo sớm nhất!",
        "hashtags": ["#reviewphim", "#phimhay", "#tomtatphim", "#trending", "#viral", "#xuhuong"],
    },
    "youtube_shorts": {
        "title": "{title:50} #Shorts",
        "description": "Xem ngay khoảnh khắc cao trào nhất! Xem bản full đầy đủ trên kênh nhé.",
        "hashtags": ["#shorts", "#trending", "#viral", "#phimhay", "#xuhuong"],
    },
    "tiktok": {
        "title": "{title:55} | Xem ngay để biết cái kết!",
        "description": "Bạn nghĩ sao về tình huống này? Bình luận cho mình biết nhé!",
        "hashtags": ["#fyp", "#xuhuong", "#viral", "#shorts", "#phimhay", "#review"],
    },
    "facebook": {
        "title": "Mọi người đánh giá thế nào về diễn biến này? Để lại bình luận nhé!\n{title}",
        "description": "Cùng theo dõi và thảo luận những tình tiết gay cấn nhất trong video dưới đây.",
        "hashtags": ["#reels", "#trending", "#viral", "#phimhay", "#xuhuong"],
    },
}
HEADLINE_CHARS = 65
_POST = "title string, description string, hashtags array<string>"
_VIDEO = _POST + ", alternative_titles array<string>, tags array<string>"
META = _VIDEO + "".join(f", {name} struct<{_VIDEO if name == 'youtube' else _POST}>" for name in POSTS)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _filled(template: str, title: Column) -> Column:
    """template with its one {title} or {title:n} replaced by the column."""
    m = re.search(r"\{title(?::(\d+))?\}", template)
    if not m:
        return F.lit(template)
    shown = F.substring(title, 1, int(m[1])) if m[1] else title
    return F.concat(F.lit(template[: m.start()]), shown, F.lit(template[m.end() :]))


def posts(rows: DataFrame, defaults: dict[str, dict] | None = None, headline: str = HEADLINE) -> DataFrame:
    """rows(id, script, meta) -> id, platform, title, description, hashtags, alternative_titles, tags: a row for each platform.

    meta is the JSON object that a model wrote, with the video's fields at its root or under ``youtube``, and those of the
    other platforms under their names. A text that is missing, blank or holds CJK ideographs takes the platform's default, a
    list does if it is missing, empty or holds a text with such a character. The video's title is else the first sentence
    of the script, or ``headline``. Shorts say so in their title. alternative_titles and tags belong to ``youtube`` alone, and
    are null for the others.

    Null, broken or non-object JSON counts as an empty object, a field of another type as missing; a null script has no
    sentence; repeated rows are completed alike. No shuffle: one projection and one explode.
    """
    from .segments import has_cjk

    defaults = POSTS if defaults is None else defaults
    read = rows.withColumn("_meta", F.from_json("meta", META))

    def text(given: Column, default: Column) -> Column:
        clean = _stripped(F.coalesce(given, F.lit("")))
        return F.when((clean == "") | has_cjk(clean, "base"), default).otherwise(clean)

    def texts(given: Column, default: list[Column]) -> Column:
        usable = (F.size(given) > 0) & ~F.exists(given, lambda x: has_cjk(F.coalesce(x, F.lit("")), "base"))
        return F.when(F.coalesce(usable, F.lit(False)), given).otherwise(F.array(*default))

    def video(field: str) -> Column:
        """What is under youtube, else what is at the root."""
        own = F.col(f"_meta.youtube.{field}")
        given = F.size(own) > 0 if field in ("hashtags", "alternative_titles", "tags") else own != ""
        return F.when(given, own).otherwise(F.col(f"_meta.{field}"))

    sentences = F.filter(F.transform(F.split(F.coalesce("script", F.lit("")), r"[.!?\n]+"), _stripped), lambda x: x != "")
    first = F.substring(F.coalesce(F.get(sentences, F.lit(0)), F.lit(headline)), 1, HEADLINE_CHARS)
    named = read.withColumn("_title", text(video("title"), first))
    title, made = F.col("_title"), []
    for name, default in defaults.items():
        of = video if name == "youtube" else lambda field, name=name: F.col(f"_meta.{name}.{field}")
        shown = title if name == "youtube" else text(of("title"), _filled(default["title"], title))
        if name == "youtube_shorts":
            shown = F.when(F.lower(shown).contains("#shorts"), shown).otherwise(F.concat(shown, F.lit(" #Shorts")))
        listed = {"hashtags": texts(of("hashtags"), [F.lit(x) for x in default["hashtags"]])}
        for field, other in (("alternative_titles", ALTERNATIVES), ("tags", TAGS)):
            listed[field] = texts(of(field), [_filled(x, title) for x in other]) if name == "youtube" else F.lit(None).cast("array<string>")
        made.append(
            F.struct(
                F.lit(name).alias("platform"), shown.alias("title"), text(of("description"), _filled(default["description"], title)).alias("description"),
                *[v.alias(k) for k, v in listed.items()],
            )
        )
    return named.select("id", F.explode(F.array(*made)).alias("_post")).select("id", "_post.*")


def run_keys(segs: DataFrame, batch: str) -> DataFrame:
    """A key per batch: hash of its ordered (id, text) pairs."""
    pair = F.concat(F.col("seg_id").cast("string"), F.lit("\x1f"), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg_id", pair.alias("p")))), lambda x: x["p"])
    return segs.groupBy("media_id", batch).agg(F.substring(F.sha2(F.array_join(ordered, "\x1e"), 256), 1, 16).alias("key"))


# Chinese digits, and the marks by which titles and urls name an episode.
CHINESE_DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
EPISODE_MARKS = {
    "query": r"(?iu)[?&](?:p|index|ep|episode|part)=(\d+)",
    "range": r"(?iu)(?:full|tập|tap|ep|part)?\s*(\d+)\s*[-–~到至_]\s*(\d+)",
    "all": r"全\s*(\d+)\s*[集话話]",
    "whole": r"(?iu)(trọn bộ|toàn tập|full bộ|full season|合集)",
    "last": r"(?iu)(tập cuối|đại kết cục|kết thúc|final|the end|大结局|结局)",
    "numeral": r"第\s*([0-9零一二两三四五六七八九十百]+)\s*[集话話回期]",
    "single": r"(?iu)(?:tập|tap|ep|e|chương|chuong|part)\s*[\._\-\s]*0*([1-9]\d*)",
    "bracket": r"[\[\(【]0*([1-9]\d*)[\]\)】]",
}
LONGEST_RANGE, HOUR_S, HALF_HOUR_S = 2000, 3600, 1800


def chinese_number(text: Column) -> Column:
    """A number below 1000 in Arabic or Chinese digits (tens 十, hundreds 百); null if it is neither."""
    digits = F.create_map(*[F.lit(x) for pair in CHINESE_DIGITS.items() for x in pair])

    def before(unit: str) -> Column:
        digit = F.regexp_extract(text, f"([{''.join(CHINESE_DIGITS)}])?{unit}", 1)
        return F.when(~text.contains(unit), 0).when(digit == "", 1).otherwise(digits[digit])

    last = F.regexp_extract(text, f"([{''.join(CHINESE_DIGITS)}])$", 1)
    ones = F.when(last == "", 0).otherwise(digits[last])
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).when(text.rlike("^[零一二两三四五六七八九十百]+$"), F.nullif((100 * before("百") + 10 * before("十") + ones).cast("long"), F.lit(0)))


def episode(title: Column, url: Column, seconds: Column) -> Column:
    """The badge of a video: an episode, a range of them, the whole or the last one, by the first mark found in the url's
    query, then in title and url, else by length."""
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit("")))

    def found(mark: str, group: int = 1, where: Column = both) -> Column:
        return F.nullif(F.regexp_extract(where, EPISODE_MARKS[mark], group), F.lit(""))

    def one(number: Column) -> Column:
        return F.concat(F.lit("TẬP "), F.regexp_replace(number, r"^0+(?=\d)", ""))

    first, last = found("range").try_cast("long"), found("range", 2).try_cast("long")
    length = F.coalesce(seconds, F.lit(0))
    return F.coalesce(
        one(found("query", 1, F.coalesce(url, F.lit("")))),
        F.when((first < last) & (last <= LONGEST_RANGE), F.concat_ws("-", first.cast("string"), last.cast("string"))),
        F.concat(F.lit("1-"), found("all")),
        F.when(found("whole").isNotNull(), "TRỌN BỘ"),
        F.when(found("last").isNotNull(), "TẬP CUỐI"),
        one(chinese_number(found("numeral")).cast("string")),
        F.concat(F.lit("TẬP "), found("single")),
        F.concat(F.lit("TẬP "), found("bracket")),
        F.when(length >= HOUR_S, "1-100").when(length >= HALF_HOUR_S, "TRỌN BỘ").otherwise("TẬP 1"),
    )
