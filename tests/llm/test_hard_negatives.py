import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuesheet.llm import hard_negatives as hn
from pyspark.sql import functions as F


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(1, 20), st.integers(1, 20), st.sampled_from([1, 3, 100, 2**20, 2**28]), st.integers(0, 10**6))
def test_scores(dim, n, m, most, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-most, most, (n, dim)), rng.integers(-most, most, (m, dim))
    told = [hn.planes(r) for r in b]
    rows = hn.unpacked(np.array([w for w, _ in told]), [p for _, p in told])
    assert (hn.scores(hn.subset_sums(a, rows.shape[1]), rows) == b @ a.T).all()


def _brute(rows, anchor, k=5, m=10):
    """rows(id, label, components): the contract, pair by pair, in Python's integers."""
    best = {}
    for i, lab, v in rows:
        if i is None or lab is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        c = (lab, [min(max(int(np.floor(256.0 * x)), -(2**63)), 2**63 - 1) for x in v])
        best[i] = min(best.get(i, c), c)
    out = []
    for i, (lab, c) in best.items():
        if not anchor(i):
            continue
        told = [(-sum(x * y for x, y in zip(c, d)), j, l2) for j, (l2, d) in best.items() if j != i]  # noqa: B905  (zeros follow the shorter)
        for s, p, _ in sorted(t for t in told if t[2] == lab)[:k]:
            fit = sorted(t for t in told if t[2] != lab and 30 * -s <= 100 * -t[0] <= 90 * -s)[:m]
            out += [(i, p, r, j, -s, -t) for r, (t, j, _) in enumerate(fit, 1)]
    return Counter(out)


def _told(df):
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def test_query(spark, sf):
    got = _told(hn.query(spark, sf))
    con = duckdb.connect()
    path = f"{sf}/embeddings.parquet"
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    assert got == Counter(con.execute(hn.ORACLE).fetchall()) and got


@pytest.mark.parametrize("blocks", [(16_384, 131_072, 2_048), (3, 7, 2)])
def test_edges(spark, monkeypatch, blocks):
    for name, n in zip(("ANCHORS", "ROWS", "LEAST_ROWS"), blocks, strict=True):
        monkeypatch.setattr(hn, name, n)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(0, 1, int(rng.integers(4, 20)))]) for i in range(150)]
    same = [0.5, 0.25, -1.0]
    rows += [(200 + i, i % 2, same) for i in range(40)]  # ties
    rows += [(300, 1, None), (301, None, same), (None, 1, same), (302, 1, [1.0, None]), (303, 1, [float("nan")]), (304, 2, [float("inf")]), (305, 1, []), (306, 7, same)]
    rows += [(10, 0, same), (10, 0, same), (10, 2, same), (310, 1, [3.0e7, -2.0e6, 1.0]), (320, 0, [2.0e7, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS codes", "'x' AS width", "2 AS rank")
    got = _told(hn.mine(df, F.col("vec_id") % 10 == 0))
    assert got == _brute(rows, lambda i: i % 10 == 0) and got
    assert hn.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_returns_top_lists_only(spark):
    rows = [(i, i % 2, [float(i % 3), 1.0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = defaultdict(int)
    for (a, p, *_), n in _told(hn.mine(df, F.col("vec_id") % 500 == 0)).items():
        got[a, p] += n
    assert max(got.values(), default=0) <= 10
