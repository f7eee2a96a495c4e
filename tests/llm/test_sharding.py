import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuesheet.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10**9))
def test_permutation(n, seed):
    p = sharding.permute(np.arange(n), n, seed)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(p, n, seed, back=True) == np.arange(n)).all()


def test_locate_and_invert():
    for r in range(50):
        shard, slot = sharding.locate(r, 1000, 24, 3)
        assert sharding.invert(shard, slot, 1000, 24, 3) == r


def _check(rows, got):
    n = Counter(r["shard"] for r in got)
    assert max(n.values()) - min(n[s] for s in range(24)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query(spark, sf):
    one, two = sharding.query(spark, sf).collect(), sharding.query(spark, sf).collect()
    assert Counter(one) == Counter(two)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    _check(docs, one)
    for r in one:
        assert r["size"] == len(docs[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode())


def test_edges(spark):
    rows = [(None, 8, 0)] * 3 + [(5, 9, 7)] * 40 + [(i, 8, 0) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long").selectExpr("*", "'x' AS row_number", "1 AS position", "'mine' AS shard", "2L AS slot")
    got = sharding.shard_rows(df, ["doc_id", "size", "text_crc32"], 24).collect()
    _check(rows, got)
    assert {(r["row_number_in"], r["position_in"], r["shard_in"], r["slot_in"]) for r in got} == {("x", 1, "mine", 2)}
    again = sharding.shard_rows(df.repartition(7), ["doc_id", "size", "text_crc32"], 24).collect()
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert Counter(map(key, got)) == Counter(map(key, again))
    assert sharding.shard_rows(df.limit(0), ["doc_id"], 24).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(df, ["doc_id"], 0)
