"""Derived inputs over the base tables: one SQL text for each, the same for Spark and for the DuckDB checks.

Base tables appear as {name}. ``load`` binds them to Parquet files; ``ctes`` writes the chain of common table
expressions that a DuckDB query needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "segments": """
WITH b AS (
  SELECT conv_id AS media_id, CAST(turn AS INT) + 1 AS seg_id, role AS speaker,
         CASE WHEN (conv_id + turn) % 7 = 0 THEN concat(text, '你好世界') ELSE text END AS text,
         GREATEST(400, CAST(LENGTH(text) AS BIGINT) * CASE WHEN turn % 5 = 4 THEN 240 ELSE 80 END) AS dur_ms,
         CAST(120 + (turn % 4) * 600 AS BIGINT) AS gap_ms
  FROM {conversations}),
c AS (SELECT *, CAST(SUM(dur_ms + gap_ms) OVER (PARTITION BY media_id ORDER BY seg_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS prev FROM b)
SELECT media_id, seg_id, speaker, text, COALESCE(prev, 0) AS start_ms, COALESCE(prev, 0) + dur_ms AS end_ms, dur_ms,
       CASE WHEN (media_id + seg_id) % 11 = 0 THEN concat(text, '世界')
            WHEN (media_id + seg_id) % 13 = 0 THEN SUBSTRING(text, 1, 5)
            WHEN (media_id + seg_id) % 5 = 0 THEN concat(text, text) ELSE text END AS text_vi
FROM c""",
    "ocr_segments": """
SELECT media_id, seg_id AS ocr_id, start_ms + (seg_id % 4) * 150 AS start_ms, end_ms + (seg_id % 4) * 150 AS end_ms,
       text, CAST(50 + (media_id * 7 + seg_id) % 50 AS DOUBLE) / 100 AS confidence FROM {segments} WHERE seg_id % 3 <> 0""",
    "scene_cuts": """
SELECT media_id, start_ms + 200 AS cut_ms FROM {segments} WHERE seg_id % 2 = 0
UNION SELECT media_id, end_ms - 100 AS cut_ms FROM {segments} WHERE seg_id % 3 = 0""",
    "usage": """
SELECT event_id, CAST(user_id AS STRING) AS fingerprint, ts AS created_at, event_type AS action,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS input_size,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
       CAST(FLOOR(value) AS BIGINT) AS credit_charged FROM {events}""",
    "ledger": """
SELECT event_id, CAST(user_id AS STRING) AS fingerprint, ts AS created_at,
       concat(CAST(user_id AS STRING), '-', CAST(CAST(FLOOR(event_id / 3.0) AS BIGINT) AS STRING)) AS idempotency_key,
       CASE WHEN event_type = 'purchase' THEN CAST(FLOOR(value) AS BIGINT)
            ELSE -CAST(FLOOR(value / 10) AS BIGINT) END AS delta FROM {events}""",
    "devices": """
SELECT fingerprint, CAST(SUM(delta) AS BIGINT) + CASE WHEN CAST(fingerprint AS BIGINT) % 17 = 0 THEN 5 ELSE 0 END AS balance,
       MIN(created_at) AS first_seen_at, MAX(created_at) AS last_seen_at FROM {ledger} GROUP BY fingerprint""",
    "paid_orders": """
SELECT o_orderkey AS order_code, o_custkey AS custkey, CAST(FLOOR(o_totalprice) AS BIGINT) AS amount_vnd, o_orderdate AS created_at,
       CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'expired' END AS status FROM {orders}""",
    "transfers": """
SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'p0' WHEN 1 THEN 'p1' ELSE 'p2' END AS platform,
       concat('h', CAST(user_id % 20 AS STRING)) AS host, CAST(FLOOR(value * 1000000) AS BIGINT) AS bytes,
       CAST(event_id % 10 AS DOUBLE) / 10 AS duration, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'rate_limited' ELSE '' END AS error_type FROM {events}""",
    "frames": """
SELECT l_suppkey AS media_id, ROW_NUMBER() OVER (PARTITION BY l_suppkey
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS idx, l_discount AS rms, l_quantity / 50 AS amp FROM {lineitem}""",
    "boxes": """
SELECT media_id, CAST(FLOOR(idx / 3.0) AS BIGINT) AS frame, idx % 3 AS box, CAST(idx * 37 % 40 AS DOUBLE) / 100 AS x,
       CASE WHEN idx % 4 = 0 THEN CAST(0.10 AS DOUBLE) ELSE CAST(0.80 AS DOUBLE) END AS y, CAST(0.30 AS DOUBLE) AS w,
       CAST(5 + idx % 3 AS DOUBLE) / 100 AS h, 0.50 + rms AS confidence
FROM {frames}""",
    "files": """
SELECT doc_id, source AS project, n_chars AS size_bytes, doc_id * 3600 AS mtime FROM {documents}""",
    "urls": """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url
       WHEN 1 THEN concat('https://www.youtube.com/watch?v=', LPAD(CAST(page_id % 50 AS STRING), 11, 'a'), '&utm_source=feed')
       WHEN 2 THEN concat('https://www.bilibili.com/video/BV', LPAD(CAST(page_id % 50 AS STRING), 10, '1'), '?p=', CAST(1 + page_id % 2 AS STRING), '&vd_source=ab12')
       ELSE concat('https://www.douyin.com/jingxuan?modal_id=', CAST(7000000000000000000 + page_id % 50 AS STRING)) END AS url FROM {pages}""",
    "voiceprints": """
SELECT vec_id % 10 AS media_id, vec_id AS seg_id, embedding, label FROM {embeddings}""",
}
_NAME = re.compile(r"\{(\w+)\}")


def _order(name: str, seen: list[str]) -> list[str]:
    for need in _NAME.findall(VIEWS.get(name, "")):
        if need in VIEWS:
            _order(need, seen)
    if name in VIEWS and name not in seen:
        seen.append(name)
    return seen


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; times without zone become timestamps in UTC sessions."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return base(spark, sf_dir, name)
    needs = {n: load(spark, sf_dir, n) for n in set(_NAME.findall(VIEWS[name]))}
    return spark.sql(VIEWS[name], **needs)


def ctes(*names: str) -> str:
    """``WITH`` clause text that defines the named views (and what they need) over the base tables."""
    order: list[str] = []
    for n in names:
        _order(n, order)
    return "WITH " + ",\n".join(f"{n} AS ({_NAME.sub(lambda m: m[1], VIEWS[n])})" for n in order)
