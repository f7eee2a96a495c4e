"""The queries of this subpackage, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, decontaminate, fingerprints, hard_negatives, langid, neardup, quality, sharding, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.query,
        "op2_sharding": sharding.query,
        "op3_bpe": bpe.query,
        "op4_chat": chat.query,
        "op5_decontaminate": decontaminate.query,
        "op6_toxicity": toxicity.query,
        "op7_quality": quality.query,
        "op8_langid": langid.query,
        "op9_neardup": neardup.query,
        "op10_url_filter": url_filter.query,
        "op11_alignment": alignment.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_fingerprints": fingerprints.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.ORACLE, "op4_chat": chat.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op7_quality": quality.ORACLE,
        "op12_hard_negatives": hard_negatives.ORACLE,
    }
