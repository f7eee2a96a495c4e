"""Benchmark decontamination: a broadcast hash set of benchmark word windows, matched against every word position.

Words are runs of ASCII digits, letters (A-Z lowered) and all characters beyond ASCII. A window is ``size`` consecutive
words of an item; an item of fewer words is one window of all its words. Each document position becomes a 64-bit hash
of the words from there; hashes meet the broadcast windows in a hash join and each hit is verified word by word. The
scan is one chain of generated code (explode, hash, join, verify): word arrays are carried by reference and only hits
leave it. No Python runs anywhere.

The broadcast is bounded: windows are written first and, above ``max_windows`` of them (default one million) or
``max_bytes`` of their words (256 MB), dealt by hash into blocks; the documents are scanned once per block. Only one window
that is larger by itself exceeds that, and then its item is a row of a tenth of its size at least. Hits carry no item
ids but the ``set_id`` of the items that have the window: windows of the same items share one. A document's distinct sets
are joined with their items afterwards, so a passage of many windows that many items share costs its items once.

Defined cases: null or wordless text has no words and no hits; items without words have no window; equal items all
count; every document row is judged by its own text, whatever its id; empty tables give empty results; other columns are
kept by ``decontaminate`` and never read, helper columns start with ``_dc_``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_checked, materialise, table, text_or_empty

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
MAX_WINDOWS = 1_000_000
MAX_BYTES = 256 << 20
_WORD_BYTES = 32  # what an array of words takes in memory for each word besides its bytes, about
_SUMMARY = 0  # length of the marker row that each document gets besides its windows


def words(text: Column) -> Column:
    """The words of a text, in order. Separators at either end are cut off first, so that no empty word arises."""
    split = F.split(ascii_lower(text), SEPARATORS)
    n = F.size(split)
    first = F.when(F.element_at(split, 1) == "", 2).otherwise(1)
    last = F.when((n > 1) & (F.element_at(split, -1) == ""), n - 1).otherwise(n)
    return F.slice(split, first, F.greatest(last - first + 1, F.lit(0)))


def _hash(words: str, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(length)])


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """items(item_id, text) -> length, hash, window (array of words), item_ids (sorted) and their digest set_id: one row per
    distinct window."""
    w = items.select("item_id", words(text_or_empty()).alias("words")).where(F.size("words") > 0)
    w = w.withColumn("length", F.least(F.size("words"), F.lit(size)))
    each = w.select(
        "item_id", "length",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1), lambda i: F.slice("words", i, F.col("length")))).alias("window"),
    )
    hashed = each.withColumn("hash", _by_length("length", lambda n: _hash("window", F.lit(0), n), range(1, size + 1)))
    found = hashed.groupBy("length", "hash", "window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return found.withColumn("set_id", F.unhex(F.md5(F.to_json("item_ids"))))


def _by_length(name: str, value, lengths) -> Column:
    lengths = list(lengths)
    out = F.when(F.col(name) == lengths[0], value(lengths[0]))
    for n in lengths[1:]:
        out = out.when(F.col(name) == n, value(n))
    return out


def indexed(items: DataFrame, size: int = SIZE) -> DataFrame:
    """The windows of items, written out."""
    return materialise(windows(items, size), "windows")


def hits(docs: DataFrame, known: DataFrame, size: int = SIZE, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs(_dc_row, doc_id, text), windows as of ``indexed`` -> verified hits (_dc_row, doc_id, at, length, set_id, n_words),
    and for each document one row of length 0 that carries n_words."""
    weight = F.sum(F.octet_length(F.array_join("window", "")) + F.size("window") * _WORD_BYTES)
    shape = known.groupBy("length").agg(F.count("*").alias("n"), weight.alias("bytes")).collect()  # at most ``size`` rows
    lengths = sorted(r["length"] for r in shape)
    blocks = max(1, math.ceil(sum(r["n"] for r in shape) / max_windows), math.ceil(sum(r["bytes"] for r in shape) / max_bytes))
    known = known.drop("item_ids")
    w = docs.select("_dc_row", "doc_id", words(text_or_empty()).alias("words")).withColumn("n_words", F.size("words"))
    parts = []
    for block in range(blocks):
        mine = known.where(F.pmod("hash", F.lit(blocks)) == block) if blocks > 1 else known
        summary = docs.sparkSession.range(1).select(
            F.lit(_SUMMARY).alias("length"), F.lit(0).cast("long").alias("hash"),
            F.array().cast("array<string>").alias("window"), F.lit(None).cast("binary").alias("set_id"),
        )
        mine = mine.unionByName(summary) if block == 0 else mine
        spots = w.select("_dc_row", "doc_id", "words", "n_words", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)).alias("at"))
        if len(lengths) > 1:
            of_length = F.explode(F.when(F.col("at") < 0, F.array(F.lit(_SUMMARY))).otherwise(F.array(*map(F.lit, lengths))))
            spots = spots.withColumn("length", of_length)
        else:
            spots = spots.withColumn("length", F.when(F.col("at") < 0, _SUMMARY).otherwise(lengths[0] if lengths else size))
        spots = spots.where((F.col("length") == _SUMMARY) | (F.col("at") + F.col("length") <= F.col("n_words")))
        value = F.when(F.col("length") == _SUMMARY, F.lit(0).cast("long"))
        for n in lengths:
            value = value.when(F.col("length") == n, _hash("words", F.col("at"), n))
        spots = spots.withColumn("hash", value)
        joined = spots.join(F.broadcast(mine), ["hash", "length"])
        same = (F.col("length") == _SUMMARY) | (F.slice("words", F.col("at") + 1, F.greatest("length", F.lit(1))) == F.col("window"))
        parts.append(joined.where(same).select("_dc_row", "doc_id", "at", "length", "set_id", "n_words"))
    return reduce(DataFrame.unionByName, parts)


def _with_items(sets: DataFrame, known: DataFrame, max_bytes: int) -> DataFrame:
    """sets(_dc_row, set_id) -> _dc_row, item_ids (distinct). The items of a set are broadcast where all sets take at most
    max_bytes, else joined by shuffling."""
    items = materialise(known.groupBy("set_id").agg(F.first("item_ids").alias("ids")), "item-sets")
    few = (items.agg(F.sum(F.octet_length(F.to_json("ids")))).first()[0] or 0) <= max_bytes
    each = sets.join(F.broadcast(items) if few else items.hint("merge"), "set_id").select("_dc_row", F.explode("ids").alias("item_id"))
    return each.groupBy("_dc_row").agg(F.collect_set("item_id").alias("item_ids"))


def judge(docs: DataFrame, items: DataFrame, size: int = SIZE, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document row: _dc_row, doc_id, n_words, positions (of words that are hit, sorted), item_ids (as
    sorted strings)."""
    known = indexed(items, size)
    found = hits(docs, known, size, max_windows, max_bytes)
    spans = F.collect_list(F.when(F.col("length") > 0, F.struct("at", "length")))
    per_doc = found.groupBy("_dc_row", "doc_id").agg(
        F.max("n_words").alias("n_words"), spans.alias("_dc_spans"), F.collect_set("set_id").alias("_dc_sets")
    )
    at = F.flatten(F.transform("_dc_spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    told = materialise(per_doc.select("_dc_row", "doc_id", "n_words", F.array_sort(F.array_distinct(at)).alias("positions"), "_dc_sets"), "judged")
    own = _with_items(told.select("_dc_row", F.explode("_dc_sets").alias("set_id")), known, max_bytes // 4)
    named = F.array_sort(F.transform(F.col("item_ids"), lambda i: i.cast("string")))
    return told.join(own, "_dc_row", "left").select(
        "_dc_row", "doc_id", "n_words", "positions", F.coalesce(named, F.array().cast("array<string>")).alias("item_ids")
    )


def numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_dc_row", F.monotonically_increasing_id())


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without the rows whose text holds a benchmark window; columns as given. Rows are told apart by a digest of
    their text, so a clean row stays even if another with its id goes."""
    digest = F.unhex(F.md5(F.encode(F.col("text"), "UTF-8")))
    texts = docs.where(F.col("text").isNotNull()).select(digest.alias("_dc_row"), F.lit(None).cast("long").alias("doc_id"), "text")
    bad = hits(texts, indexed(items, size), size, max_windows).where(F.col("length") > 0).select("_dc_row").distinct()
    return join_checked(docs.withColumn("_dc_row", digest), bad, ["_dc_row"], "left_anti", "leaked").select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text with the words inside hits cut out (remaining words in lower case, joined by one space). What stays
    are the stretches after each hit word and before the first, so the work is in proportion to the words."""
    rows = numbered(docs).select("_dc_row", "doc_id", "text")
    found = judge(rows, items, size).select("_dc_row", "positions")
    joined = rows.join(found, "_dc_row").withColumn("_dc_words", words(text_or_empty()))
    ends = F.array_append(F.col("positions"), F.size("_dc_words"))  # the end of the stretch before each hit word, and of the last
    starts = F.concat(F.array(F.lit(0)), F.transform("positions", lambda p: p + 1))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda s: F.slice("_dc_words", s["a"] + 1, s["z"] - s["a"])))
    clean = F.when(F.size("positions") == 0, F.col("text")).otherwise(F.array_join(kept, " "))
    return joined.select("doc_id", clean.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = judge(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return told.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("positions").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("positions") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
