"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of ``SLOTS`` 64-bit words holds a filter for each of up to 64 languages: bit l of a word belongs to language l.
An n-gram hashes to ``HASHES`` slots; the AND of their words is the set of all languages that hold the n-gram. Over a
text these masks are summed bit by bit. A language's filter, filled to f, answers yes to a foreign n-gram with
probability p = f^HASHES, so its count c of n is corrected to (c - p n) / (1 - p). The largest corrected count decides;
``score`` is its share of all corrected counts.

N-grams are four letters of a lower-cased text, in which runs of other characters are one space. A language keeps its
``TOP`` most frequent n-grams, except those that another language uses more than ``RATIO`` times as often; frequencies
come from at most ``max_docs`` documents per language, outside the held-out quarter: about as many are drawn by a hash of id
and text, and of those the first by that hash. A text's n-grams are hashed and counted in pieces of ``PIECE`` characters, so a
very long text takes a few times its own size.

Defined cases: null text or a text without a letter is ``und`` with score 0; documents with a null lang teach nothing;
ties go to the language first in text order; letters but no known n-gram: the language of most training documents, score
0; nothing to learn from: all ``und``; repeated rows are judged alike; an empty table gives an empty result; other
columns are kept, those named ``lang_pred`` or ``score`` as ``lang_pred_in`` and ``score_in``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, held_out, materialise, set_aside, table, text_or_empty

N = 4
SLOTS = 1 << 19
HASHES = 3
TOP = 12_000
RATIO = 4.0
MAX_DOCS = 1_500
MAX_LANGS = 64
PIECE = 1 << 19  # n-grams that are hashed at a time
_SCALE = 1 << 30
_SPACES = re.compile(r"[\W\d_]+")
#: Python's \w holds numbers such as 1/2 or Roman numerals too; letters are what isalpha says.
_NUMBERS = {c: " " for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha()}
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
UND = "und"


def gram_pieces(text: str, piece: int = PIECE) -> Iterator[np.ndarray]:
    """A 64-bit hash for each n-gram of letters, at most ``piece`` at a time; nothing if there is no letter."""
    clean = _SPACES.sub(" ", text.lower()).strip()
    if not clean.replace(" ", "").isalpha():  # rare, so the slower step is not taken by every text
        clean = _SPACES.sub(" ", clean.translate(_NUMBERS)).strip()
    if not clean:
        return
    clean = f" {clean} "
    for start in range(0, max(1, len(clean) - N + 1), piece):
        codes = np.frombuffer(clean[start : start + piece + N - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = max(1, len(codes) - N + 1)
        h = np.zeros(n, np.uint64)
        for j in range(min(N, len(codes))):
            h = (h ^ codes[j : j + n]) * _M1
            h ^= h >> np.uint64(29)
        yield h


def gram_hashes(text: str, piece: int = PIECE) -> np.ndarray:
    """All hashes of a text, in order."""
    return np.concatenate([np.empty(0, np.uint64), *gram_pieces(text, piece)])


def distinct_grams(text: str, piece: int = PIECE) -> np.ndarray:
    """The distinct hashes of a text, sorted."""
    own = np.empty(0, np.uint64)
    for h in gram_pieces(text, piece):
        own = np.union1d(own, h) if len(own) else np.unique(h)
    return own


def slots(h: np.ndarray) -> list[np.ndarray]:
    second = (h * _M2) | np.uint64(1)
    return [((h + np.uint64(i) * second) >> np.uint64(20)) % np.uint64(SLOTS) for i in range(HASHES)]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    false: np.ndarray  # false-positive rate by language
    usual: str  # the language of most training documents

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], usual: str) -> Model:
        langs = sorted(grams)
        if len(langs) > MAX_LANGS:
            raise ValueError(f"{len(langs)} languages; a mask holds {MAX_LANGS}")
        words = np.zeros(SLOTS, np.uint64)
        for i, lang in enumerate(langs):
            for s in slots(grams[lang]):
                words[s] |= np.uint64(1 << i)
        fill = np.array([float(((words >> np.uint64(i)) & np.uint64(1)).mean()) for i in range(len(langs))])
        return cls(langs, words, fill**HASHES, usual)

    def predict(self, text: str, piece: int = PIECE) -> tuple[str, float]:
        n, counts = 0, np.zeros(len(self.langs))
        for h in gram_pieces(text, piece):
            n += len(h)
            at = slots(h)
            mask = self.table[at[0]]
            for s in at[1:]:
                mask = mask & self.table[s]
            mask = mask[mask != 0]
            counts += [np.count_nonzero(mask & np.uint64(1 << i)) for i in range(len(self.langs))]
        if not n or not self.langs:
            return UND, 0.0
        corrected = np.maximum(0.0, (counts - self.false * n) / (1 - self.false))
        total = corrected.sum()
        if total <= 0:
            return self.usual, 0.0
        best = int(corrected.argmax())
        return self.langs[best], float(corrected[best] / total)


def train(docs: DataFrame, max_docs: int = MAX_DOCS, top: int = TOP) -> Model:
    """docs(doc_id, text, lang) -> model."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if not sizes:
        return Model([], np.zeros(SLOTS, np.uint64), np.zeros(0), UND)
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, max_docs / n) * _SCALE)).otherwise(share)
    drawn = known.withColumn("_li_draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SCALE))).where(F.col("_li_draw") < share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_li_draw", "doc_id"))  # a hot group of equal rows ends here
    drawn = drawn.withColumn("_li_place", place).where(F.col("_li_place") <= max_docs)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([distinct_grams(t).view(np.int64) for t in texts])

    each = drawn.select("lang", F.explode(grams(text_or_empty())).alias("g"))
    counted = each.groupBy("lang", "g").agg(F.count("*").alias("c"))  # documents of the language with the n-gram
    used = {lang: min(n, max_docs) for lang, n in sizes.items()}
    rate = F.lit(0.0)
    for lang, n in used.items():
        rate = F.when(F.col("lang") == lang, F.col("c") / n).otherwise(rate)
    rated = materialise(counted.withColumn("r", rate), "grams")
    most = rated.groupBy("g").agg(F.max("r").alias("most"))
    own = rated.where("c >= 2").join(most, "g").where(F.col("r") * RATIO >= F.col("most"))
    found = {}
    for lang in sorted(sizes):  # at most 64
        rows = own.where(F.col("lang") == lang).orderBy(F.col("r").desc(), "g").limit(top).select("g").toPandas()
        found[lang] = rows["g"].to_numpy(np.int64).view(np.uint64)
    return Model.build(found, max(sorted(sizes), key=lambda x: sizes[x]))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS words, whatever the corpus
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"])

    docs = set_aside(docs, "lang_pred", "score")
    return docs.withColumn("_li", predict(text_or_empty())).withColumns({"lang_pred": F.col("_li.lang_pred"), "score": F.col("_li.score")}).drop("_li")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    told = with_language(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
