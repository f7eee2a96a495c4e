"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Row r of N goes to position p = permute(r); its shard is p mod S and its slot p div S. Both follow from
(r, N, S, seed) alone, so any row can be located without data, and counts per shard differ by one at most
(law ``rows``). ``locate`` and ``invert`` give the two directions for numbers outside Spark.

Row numbers follow the order of (key, size, crc, hash of all columns). They come from a range partitioning,
positions inside the partitions and one running sum over partition counts: no single-partition sort. Rows that are
equal in all of these are spread by a random last sort column; they are alike, so the result is the same.

Defined cases: null key sorts first; a null text has no bytes (size 8, crc 0); repeated rows each get a slot; an
empty table gives an empty result; extra columns are kept, those named like a result as ``<name>_in``; helper columns
start with ``_fs_``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, set_aside, table, text_or_empty

ROUNDS = 6
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    """A 64-bit mix of the half block and the round key, cut to the half's width."""
    x = half + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return (x ^ (x >> np.uint64(31))) & mask


def _keys(seed: int) -> list[int]:
    return [((seed * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03 + 1) & (2**64 - 1)) for i in range(ROUNDS)]


def _network(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    with np.errstate(over="ignore"):
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ _round(left, k, mask), left
            else:
                left, right = right, left ^ _round(right, k, mask)
    return (left << shift) | right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1, or its inverse. Values outside walk on along their cycle until they are inside."""
    bits, keys = _half_bits(n), _keys(seed)
    out = _network(rows.astype(np.uint64), bits, keys, back)
    outside = out >= n
    while outside.any():
        out[outside] = _network(out[outside], bits, keys, back)
        outside = out >= n
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def invert(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(df: DataFrame, order: list[str], out: str = "row_number") -> tuple[DataFrame, int]:
    """df with gapless global numbers from 0 in the given order, and the row count.

    The ranged and sorted rows are written once, since range bounds come from a sample and may differ between two
    evaluations; then each partition's offset (one row per partition) is joined back.
    """
    ties = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumns({"_fs_tie": ties, "_fs_rand": F.rand()})
    by = [F.col(c) for c in order] + [F.col("_fs_tie"), F.col("_fs_rand")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = materialise(
        ranged.withColumn("_fs_at", F.monotonically_increasing_id()).drop("_fs_tie", "_fs_rand"), "numbered"
    ).withColumn("_fs_part", F.shiftrightunsigned("_fs_at", 33))
    counts = placed.groupBy("_fs_part").agg(F.count("*").alias("_fs_n"))
    before = Window.orderBy("_fs_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_fs_part", F.coalesce(F.sum("_fs_n").over(before), F.lit(0)).alias("_fs_start"))
    n = placed.count()
    numbered = placed.join(F.broadcast(offsets), "_fs_part")  # one row per partition
    at = F.col("_fs_at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(out, F.col("_fs_start") + at).drop("_fs_part", "_fs_at", "_fs_start"), n


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 17) -> DataFrame:
    """df with row_number, position, shard and slot."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    kept = set_aside(df, "row_number", "position", "shard", "slot")
    renamed = dict(zip(df.columns, kept.columns, strict=True))
    numbered, n = number_rows(kept, [renamed[c] for c in order])

    @F.pandas_udf(T.LongType())
    def position(r: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), n, seed))

    return (
        numbered.withColumn("position", position("row_number"))
        .withColumn("shard", F.pmod("position", F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"position div {shards}"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(text_or_empty(), "UTF-8")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text_or_empty()) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    return shard_rows(rows, ["doc_id", "size", "text_crc32"], 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
