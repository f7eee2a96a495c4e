"""Line-first quality rules.

Each line with a word is judged alone. It fails by
  punctuation  four words or more and no word ends a sentence;
  navigation   holds ``|`` and one for every three words at least;
  symbols      as many of ``# * $ % & < >`` as words;
  shouting     four words or more, capital ASCII letters but no small ones, or ``!!`` for every third word;
  boilerplate  holds one of ``PHRASES``.
Failing lines are removed; a document that loses more than half of its word characters with them is rejected. Documents
that fail the base rules (under 50 words; more than half of the words inside repeated 3-word windows) are rejected too.

Words are runs of characters other than space and U+0009 to U+000D. One pass of an Arrow UDF per document, whole text.

Defined cases: null and empty texts have no words and are rejected; lines without a word count for nothing and stay;
repeated rows are judged alike; an empty table gives an empty result; other columns are kept; ``_qr`` and names that
start with ``_qr_`` are helper columns and belong to the operator.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, text_or_empty

# Phrases of page furniture, in lower case.
PHRASES = [
    "all rights reserved", "click here", "cookie policy", "enable javascript", "log in", "lorem ipsum", "privacy policy",
    "sign in", "terms of service", "terms of use",
]
_WORD = re.compile(r"[^ \t-\r]+")
_END = re.compile(r"[.!?…][\"'»”)\]]*(?:[ \t-\r]|$)")
_SMALL, _CAPITAL = re.compile("[a-z]"), re.compile("[A-Z]")
_SYMBOLS, _LINE_SYMBOLS = "#*$%&|<>", "#*$%&<>"
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, removed_chars long, "
    "removed_lines long, clean_text string"
)


def line_fails(line: str, n: int, phrases: bool) -> bool:
    """line: with n words, one at least; phrases: whether the text holds any of PHRASES."""
    if n >= 4 and not _END.search(line):
        return True
    if "|" in line and 3 * line.count("|") >= n:
        return True
    if sum(map(line.count, _LINE_SYMBOLS)) >= n:
        return True
    if "!!" in line and 3 * line.count("!!") >= n:
        return True
    if n >= 4 and not _SMALL.search(line) and _CAPITAL.search(line):
        return True
    return phrases and any(p in line.lower() for p in PHRASES)


def _repeated(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def judge_text(text: str, with_text: bool = True) -> tuple:
    low = text.lower()
    phrases = any(p in low for p in PHRASES)
    words: list[str] = []
    kept: list[str] = []
    seen: set[str] = set()
    dup = removed = removed_lines = 0
    for line in text.split("\n"):
        own = _WORD.findall(line)
        if own:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            words += own
            if line_fails(line, len(own), phrases):
                removed += sum(map(len, own))
                removed_lines += 1
                continue
        if with_text:
            kept.append(line)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, _SYMBOLS))
    return len(words), chars, symbols, dup, _repeated(words), removed, removed_lines, "\n".join(kept)


def assess(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """docs with the struct ``_qr`` of all measures."""
    bounded_batches(docs.sparkSession)
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([judge_text(t, with_text) for t in texts], columns=names)

    return docs.withColumn("_qr", judge(text_or_empty(text)))


def _verdicts(judged: DataFrame) -> DataFrame:
    q = F.col("_qr")
    base = (q.n_words < 50) | (100 * q.n_repeat_words > 50 * q.n_words)
    return judged.withColumns({"_qr_base": base, "_qr_kept": ~base & (2 * q.removed_chars <= q.word_chars)})


def clean(docs: DataFrame) -> DataFrame:
    """documents without rejected ones; text without failing lines, n_chars to match; columns as given."""
    told = _verdicts(assess(docs)).where("_qr_kept")
    new = {"text": F.col("_qr.clean_text")} | ({"n_chars": F.length("_qr.clean_text").cast("long")} if "n_chars" in docs.columns else {})
    return told.withColumns(new).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _verdicts(assess(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return told.select("doc_id", *[f"_qr.{n}" for n in names], F.col("_qr_base").alias("base_failed"), F.col("_qr_kept").alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
repw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, i, ls[i] AS l, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS lw
       FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))),
lv AS (SELECT *, len(lw) AS n, length(array_to_string(lw, '')) AS c, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS rn FROM ln WHERE len(lw) > 0),
lf AS (SELECT *, (n >= 4 AND NOT regexp_matches(l, '[.!?…]["''»”)\]]*([\x20\x09-\x0D]|$)'))
   OR (contains(l, '|') AND 3 * (length(l) - length(replace(l, '|', ''))) >= n)
   OR length(l) - length(regexp_replace(l, '[#*$%&<>]', '', 'g')) >= n
   OR (contains(l, '!!') AND 3 * ((length(l) - length(replace(l, '!!', ''))) // 2) >= n)
   OR (n >= 4 AND NOT regexp_matches(l, '[a-z]') AND regexp_matches(l, '[A-Z]'))
   OR regexp_matches(lower(l), 'all rights reserved|click here|cookie policy|enable javascript|log in|lorem ipsum|privacy policy|sign in|terms of service|terms of use') AS fails FROM lv),
per AS (SELECT doc_id, count(*) FILTER (rn > 1) AS dups, coalesce(sum(c) FILTER (fails), 0) AS gone FROM lf GROUP BY doc_id),
j AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repw.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone, 0) AS gone
   FROM w LEFT JOIN per ON per.doc_id = w.doc_id LEFT JOIN repw ON repw.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * gone <= word_chars AS kept FROM j
"""
