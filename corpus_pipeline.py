"""The corpus pipeline: five stages over documents, each one operator of cuesheet.llm.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read back as the next stage's docs. All but the
last return the columns of documents; the last adds token ids and their count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm import bpe, decontaminate, neardup, quality, toxicity
from cuesheet.llm.common import materialise, set_aside, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with token_ids, n_tokens and whether decoding the ids gives the text back; columns of these names come back
    as ``<name>_in``."""
    docs = set_aside(docs, "n_tokens", "round_trip", "_decoded")
    tokenizer = bpe.public_tokenizer(spark)
    coded = bpe.with_round_trip(bpe.with_tokens(docs, tokenizer), tokenizer, out="_decoded")
    same = F.col("_decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.withColumns({"n_tokens": F.size("token_ids").cast("long"), "round_trip": same}).drop("_decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("neardup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", tokenise),
]

#: The factorization machine and ProbMinHash cannot be expressed in SQL; tests/llm/test_pipeline.py holds the run against
#: a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
