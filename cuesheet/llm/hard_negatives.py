"""Hard negatives by Four-Russians scoring.

Components are whole numbers, floor(256 * x), so a score is an exact integer inner product. An anchor's components are cut into
groups of eight; for each group a table holds the sums of all 256 subsets. A candidate's components are cut into bit planes
(two's complement, as many planes as its largest component needs), eight components to a byte. The byte of a plane and a group
is the index into that group's table; the sum over the groups is the plane's part of the score, and the planes are added from
the top by shifting. One look-up stands for eight products, and the result is the full score, not an estimate.

Spark deals anchors and candidates over blocks of at most ``ANCHORS`` x ``ROWS``, by hashes of their ids. First the anchors of a
label meet the rows of that label and keep the best of each block as positives; then all anchors, with the score bounds of
their positives, meet all rows and keep the best negatives of each block for each positive. Blocks return top lists only, and
windows pick the first of them. No label is ever in one task: a label's rows are dealt over as many blocks as their number
needs.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of
different lengths meet as if zeros followed the shorter one; an empty vector scores 0 with all; an id names one row, so of rows
with one id that of the least label and components stands for all; components beyond a long's range are the nearest long, and
scores are right as long as they fit a long; ties go by smaller id; an anchor without positives or negatives has no rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table

GROUP = 8  # components to a byte
ANCHORS, ROWS, LEAST_ROWS = 16_384, 131_072, 2_048  # of a block
_TOGETHER, _CHUNK = 32, 8_192  # anchors and rows scored at once
_WIDE = 16  # bits; rows with larger components are scored by themselves


# --- scores -----------------------------------------------------------------------------------------------------------


def bits(codes: np.ndarray) -> int:
    """Planes that two's complement needs for these components."""
    return int(np.where(codes < 0, ~codes, codes).max(initial=0)).bit_length() + 1


def planes(codes: np.ndarray) -> tuple[int, bytes]:
    """Number of planes of a vector, and its planes from the lowest on, each packed eight components to a byte."""
    n = bits(codes)
    each = (codes[None, :] >> np.minimum(np.arange(n), 63)[:, None]) & 1
    return n, np.packbits(each.astype(np.uint8), axis=1, bitorder="little").tobytes()


def unpacked(width: np.ndarray, packed: list[bytes]) -> np.ndarray:
    """planes x groups x rows; the sign plane is repeated and zeros follow short vectors."""
    most, groups = int(width.max(initial=1)), max((len(p) // w for w, p in zip(width, packed, strict=True)), default=0)
    out = np.zeros((len(packed), most, groups), np.uint8)
    sizes = np.array([len(p) for p in packed])
    for w, size in {*zip(width.tolist(), sizes.tolist(), strict=True)}:
        at = np.nonzero((width == w) & (sizes == size))[0]
        if size:
            x = np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), w, size // w)
            out[at, :w, : size // w] = x
            out[at, w:, : size // w] = x[:, -1:, :]
    return np.ascontiguousarray(out.transpose(1, 2, 0))


def subset_sums(codes: np.ndarray, groups: int, kind: type = np.int64) -> np.ndarray:
    """anchors x components -> groups x 256 x anchors: the sums of the components that a byte's bits name."""
    wide = np.zeros((len(codes), max(groups * GROUP, codes.shape[1])), kind)
    wide[:, : codes.shape[1]] = codes
    out = np.zeros((groups, 1 << GROUP, len(codes)), kind)
    for g in range(groups):
        for k in range(GROUP):
            out[g, 1 << k : 2 << k] = out[g, : 1 << k] + wide[:, g * GROUP + k]
    return out


def scores(tables: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, rows x anchors, from groups x 256 x anchors and planes x groups x rows."""
    top = len(rows) - 1
    out = np.zeros((rows.shape[2], tables.shape[2]), tables.dtype)
    for b in range(top, -1, -1):
        part = np.zeros_like(out)
        for g in range(rows.shape[1]):
            part += tables[g].take(rows[b, g], axis=0)
        out = -part if b == top else (out << 1) + part
    return out


def _matrix(vectors) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _scored(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each anchor of x its scores with the rows of y."""
    width = y["width"].to_numpy()
    packed = y["planes"].tolist()
    parts = [(at, unpacked(width[at], [packed[i] for i in at])) for side in (width <= _WIDE, width > _WIDE) if len(at := np.nonzero(side)[0])]
    for begin in range(0, len(x), _TOGETHER):
        codes = _matrix(x["codes"].iloc[begin : begin + _TOGETHER].tolist())
        out = np.zeros((len(codes), len(y)), np.int64)
        most = float(np.abs(codes.astype(float)).sum(1).max(initial=0))
        for at, rows in parts:
            kind = np.int32 if most * 2.0 ** len(rows) < 2.0**30 else np.int64
            sums = subset_sums(codes, rows.shape[1], kind)
            for k in range(0, len(at), _CHUNK):
                out[:, at[k : k + _CHUNK]] = scores(sums, rows[:, :, k : k + _CHUNK]).T
        yield from enumerate(out, begin)


def _first(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by place."""
    at = np.arange(len(score))
    if len(score) > n:
        at = np.nonzero(score >= np.partition(score, len(score) - n)[len(score) - n])[0]
    return at[np.argsort(~score[at], kind="stable")][:n]


def _sides(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return block[block["side"]], block[~block["side"]].sort_values("vec_id")


def _table(names: list[str], parts: list[tuple]) -> pd.DataFrame:
    if not parts:
        return pd.DataFrame({n: np.empty(0, np.int64) for n in names})
    return pd.DataFrame({n: np.concatenate([p[k] for p in parts]) for k, n in enumerate(names)})


# --- Spark ------------------------------------------------------------------------------------------------------------


def quantised(rows: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """vec_id, label, codes of the rows that take part, one for each id."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    codes = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    fit = rows.where(F.col(vec_id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite)
    one = fit.groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(F.struct(label.cast("long").alias("label"), codes.alias("codes"))).alias("r"))
    return one.select("vec_id", "r.*")


def packed(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """quantised rows -> vec_id, label, width, planes, and codes of anchors; written out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = [planes(np.asarray(c, np.int64)) for c in x["codes"]]
            codes = [c if a else None for c, a in zip(x["codes"], x["anchor"], strict=True)]
            yield pd.DataFrame({"vec_id": x["vec_id"], "label": x["label"], "width": [m[0] for m in made], "planes": [m[1] for m in made], "codes": pd.Series(codes, index=x.index, dtype=object)})

    bounded_batches(rows.sparkSession, rows=10_000)
    return materialise(rows.withColumn("anchor", is_anchor).mapInPandas(run, "vec_id long, label long, width int, planes binary, codes array<long>"), "packed")


_ROW = ["vec_id", "label", "width", "planes"]


def _blocks(anchors: DataFrame, rows: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    """Anchors against all rows of a key, in blocks: groups of (key, i, j). anchors and rows know the numbers of blocks p and q."""
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kinds = dict(anchors.dtypes)
    left = anchors.select(*key, deal(F.col("p")).alias("i"), spread("q").alias("j"), F.lit(True).alias("side"), *_ROW, *carried)
    right = rows.select(*key, spread("p").alias("i"), deal(F.col("q")).alias("j"), F.lit(False).alias("side"), *_ROW, *[F.lit(None).cast(kinds[c]).alias(c) for c in carried])
    return left.unionByName(right)


def _numbers(spark: SparkSession, anchors: Column, rows: Column) -> tuple[Column, Column]:
    """Into how many blocks anchors and rows go. Few rows are still dealt over the cluster."""
    at_once = 2 * spark.sparkContext.defaultParallelism
    some = F.least(F.ceil(rows / LEAST_ROWS), F.lit(at_once))
    return F.greatest(F.lit(1), F.ceil(anchors / ANCHORS)).cast("int"), F.greatest(F.lit(1), F.ceil(rows / ROWS), some).cast("int")


def positives(known: DataFrame, first: int) -> DataFrame:
    """packed rows -> anchor_id, positive_id, score: the first rows of an anchor's label."""
    spark = known.sparkSession
    sizes = known.groupBy("label").agg(F.count("*").alias("n"), F.count("codes").alias("a")).where("a > 0 AND n > 1")
    p, q = _numbers(spark, F.col("a"), F.col("n"))
    sized = materialise(sizes.select("label", p.alias("p"), q.alias("q")), "label-sizes")
    near = known.join(sized, "label")

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x, y = _sides(block)
        ids, own, parts = y["vec_id"].to_numpy(), x["vec_id"].to_numpy(), []
        if len(x) and len(y):
            for i, s in _scored(x, y):
                at = _first(s, first + 1)
                at = at[ids[at] != own[i]][:first]
                parts.append((np.full(len(at), own[i]), ids[at], s[at]))
        return _table(["anchor_id", "positive_id", "score"], parts)

    dealt = _blocks(near.where("codes IS NOT NULL").withColumn("label_key", F.col("label")), near.withColumn("label_key", F.col("label")), ["label_key"], ["codes"])
    tops = _grouped(dealt, ["label_key", "i", "j"]).applyInPandas(run, "anchor_id long, positive_id long, score long")
    w = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    return materialise(tops.withColumn("place", F.row_number().over(w)).where(F.col("place") <= first).drop("place"), "positives")


def _grouped(dealt: DataFrame, by: list[str]):
    """Blocks mean work, not bytes: a fixed number of partitions, so that small blocks are not put together in one task."""
    n = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * dealt.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartition(n, *by).groupBy(*by)


def negatives(known: DataFrame, found: DataFrame, first: int, low: int, high: int, of: int) -> DataFrame:
    """packed rows and positives -> the first rows of other labels with low * p <= of * n <= high * p, for the scores p and n."""
    n, a = known.agg(F.count("*"), F.count("codes")).first()
    p, q = _numbers(known.sparkSession, F.lit(a), F.lit(n))
    pos = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("score", "positive_id"))).alias("pos"))
    anchors = known.where("codes IS NOT NULL").join(pos.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumns({"p": p, "q": q})
    anchors = anchors.withColumns({"p_ids": F.transform("pos", lambda s: s["positive_id"]), "p_scores": F.transform("pos", lambda s: s["score"])})

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x, y = _sides(block)
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        ids, label, own, mine, parts = y["vec_id"].to_numpy(), y["label"].to_numpy(), x["vec_id"].to_numpy(), x["label"].to_numpy(), []
        if not len(x) or not len(y):
            return _table(names, parts)
        p_ids, p_scores = x["p_ids"].tolist(), x["p_scores"].tolist()
        for i, s in _scored(x, y):
            told = [(int(u), int(v), -(-low * int(v) // of), high * int(v) // of) for u, v in zip(p_ids[i], p_scores[i], strict=True)]
            told = [t for t in told if t[2] <= t[3]]
            if not told:
                continue
            at = np.nonzero((s >= min(t[2] for t in told)) & (s <= max(t[3] for t in told)) & (label != mine[i]))[0]
            at = at[np.argsort(~s[at], kind="stable")]
            fall = ~s[at]  # rises
            for u, v, lo, hi in told:
                begin = np.searchsorted(fall, ~hi)
                got = at[begin : min(begin + first, int(np.searchsorted(fall, ~lo, "right")))]
                parts.append((np.full(len(got), own[i]), np.full(len(got), u), ids[got], np.full(len(got), v), s[got]))
        return _table(names, parts)

    dealt = _blocks(anchors, known.withColumns({"p": p, "q": q}), [], ["codes", "p_ids", "p_scores"])
    return _grouped(dealt, ["i", "j"]).applyInPandas(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")


def mine(
    rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, of: int = 100,
) -> DataFrame:
    """For each anchor (is_anchor, over vec_id) and each of its n_positives best rows of the same label, the n_negatives best
    rows of other labels that score from low/of to high/of of the positive."""
    known = packed(quantised(rows, vec_id, vector, F.col("label") if label is None else label), is_anchor)
    tops = negatives(known, positives(known, n_positives), n_negatives, low, high, of)
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = tops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


ORACLE = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND score * 100 BETWEEN 30 * positive_score AND 90 * positive_score QUALIFY rank <= 10"""  # fmt: skip
