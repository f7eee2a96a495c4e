"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words (letters, lower case), and each word's first four and five letters, so that
inflected forms meet. Terms are hashed into ``BUCKETS``; the ``KEEP`` buckets that differ most between the labels (by
chi-square, counted on the executors) become the machine's inputs, present or not:

    score = sigmoid(w0 + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2))

The factors v learn pairs of terms, such as an insult with a mention of a group, that no sum of single weights tells
apart. Training: logistic loss, AdaGrad, on at most about ``max_train`` labelled documents drawn by a hash of the id.
The model is a few hundred kilobytes whatever the corpus; every document is scored whole.

Defined cases: null, empty and wordless texts score sigmoid(w0); documents without a label are only scored; several
labels of a document: toxic if any says so; of several texts under one id one is learnt from; null labels are ignored; without both labels the score is the share of
toxic labels (0 without any); repeated rows score alike; an empty table gives an empty result; other columns are
kept, one named like the result as ``<name>_in``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, held_out, join_checked, materialise, set_aside, table, text_or_empty

BUCKETS = 1 << 18
KEEP = 2048
FACTORS = 4
MAX_TRAIN = 12_000
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 200_000
_SCALE = 1 << 30


def word_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its openings. Openings are marked, so that they differ from equal short words."""
    terms = [word]
    if len(word) >= 4:
        terms.append(word[:4] + "*")
    if len(word) >= 5:
        terms.append(word[:5] + "*")
    return tuple(zlib.crc32(t.encode()) % BUCKETS for t in terms)


class _Known(dict):
    """A bounded memo word -> what is wanted of its buckets."""

    def __init__(self, wanted):
        self.wanted = wanted

    def __missing__(self, word: str):
        if len(self) >= _MEMO:
            self.clear()
        made = self[word] = self.wanted(word_buckets(word))
        return made


def _terms(text: str, known: _Known) -> set[int]:
    found: set[int] = set()
    for word in set(_WORD.findall(text.lower())):
        if got := known[word]:
            found.update(got)
    return found


@dataclass
class Machine:
    place: np.ndarray  # bucket -> input, -1 for none
    bias: float
    w: np.ndarray
    v: np.ndarray

    def known(self) -> _Known:
        place = self.place
        return _Known(lambda buckets: tuple(int(place[b]) for b in buckets if place[b] >= 0))

    def score(self, inputs: set[int]) -> float:
        z = self.bias
        if inputs:
            at = np.fromiter(inputs, np.int64, len(inputs))
            v = self.v[at]
            z += float(self.w[at].sum()) + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_machine(rows: list[np.ndarray], y: np.ndarray, place: np.ndarray, epochs: int = 60, rate: float = 0.15, l2: float = 5e-5, seed: int = 11) -> Machine:
    """AdaGrad over small batches; rows hold the inputs that are present."""
    n_in = int(place.max()) + 1 if len(place) else 0
    share = float(y.mean()) if len(y) else 0.0
    model = Machine(place, float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(max(n_in, 1)), np.zeros((max(n_in, 1), FACTORS)))
    if not n_in or share in (0.0, 1.0):
        model.place = np.full_like(place, -1)
        return model
    rng = np.random.default_rng(seed)
    w, v = model.w, rng.normal(0, 0.01, model.v.shape)
    gw, gv, gb, b = np.full_like(w, 1e-3), np.full_like(v, 1e-3), 1e-3, model.bias
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 128):
            batch = order[at : at + 128]
            x = np.zeros((len(batch), n_in))
            for i, r in enumerate(batch):
                x[i, rows[r]] = 1.0
            cols = np.flatnonzero(x.any(0))
            x = x[:, cols]
            vc = v[cols]
            s = x @ vc
            z = b + x @ w[cols] + 0.5 * (s * s - x @ (vc * vc)).sum(1)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            dw = x.T @ e + l2 * w[cols]
            dv = x.T @ (e[:, None] * s) - vc * (x.T @ e)[:, None] + l2 * vc
            gw[cols] += dw * dw
            gv[cols] += dv * dv
            gb += e.sum() ** 2
            w[cols] -= rate * dw / np.sqrt(gw[cols])
            v[cols] -= rate * dv / np.sqrt(gv[cols])
            b -= rate * e.sum() / np.sqrt(gb)
    model.bias, model.w, model.v = float(b), w, v
    return model


def _drawn(labels: DataFrame, max_train: int) -> DataFrame:
    """At most about max_train labelled ids, by hash; (doc_id, y)."""
    each = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    each = each.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    each = each.where(~held_out())
    n = each.count()
    share = min(1.0, max_train / n) if n else 1.0
    return each.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SCALE)) < int(share * _SCALE))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, keep: int = KEEP) -> Machine:
    """docs(doc_id, text), labels(doc_id, toxic) -> machine."""
    bounded_batches(docs.sparkSession)
    drawn = join_checked(docs.select("doc_id", "text"), _drawn(labels, max_train), ["doc_id"], "inner", "drawn-labels")
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))  # of rows that repeat an id
    drawn = drawn.withColumn("_tx_one", one).where("_tx_one = 1")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Known(lambda b: b)
        for texts in batches:
            yield pd.Series([np.fromiter(s, np.int32, len(s)) for s in (_terms(t, known) for t in texts)])

    rows = materialise(drawn.select("y", buckets(text_or_empty()).alias("b")), "terms")
    n, bad = rows.agg(F.count("*"), F.sum("y")).first()
    place = np.full(BUCKETS, -1, np.int32)
    if not n or not bad or bad == n:
        return fit_machine([], np.array([1.0] if n and bad else [0.0] if n else []), place)
    per = rows.select("y", F.explode("b").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    share = bad / n
    chi = (F.col("k") - F.col("n") * share) ** 2 / (F.col("n") * share * (1 - share)) * n / F.greatest(n - F.col("n"), F.lit(1))
    best = per.where(F.col("n") >= 2).orderBy(chi.desc(), "b").limit(keep).select("b").collect()
    kept = sorted(r["b"] for r in best)
    place[kept] = np.arange(len(kept))
    chosen = rows.select("y", F.array_intersect("b", F.array(*map(F.lit, kept)) if kept else F.array().cast("array<int>")).alias("b")).toPandas()
    return fit_machine([place[np.asarray(b, np.int64)] for b in chosen["b"]], chosen["y"].to_numpy(float), place)


def with_score(docs: DataFrame, model: Machine, text: str = "text", out: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # place, w and v: fixed sizes
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        known = own.known()
        for texts in batches:
            yield pd.Series([own.score(_terms(t, known)) for t in texts], dtype=float)

    return set_aside(docs, out).withColumn(out, score(text_or_empty(text)))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more; columns as given."""
    return with_score(docs, train(docs, labels), out="_tx_score").where(F.col("_tx_score") < threshold).drop("_tx_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return with_score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
