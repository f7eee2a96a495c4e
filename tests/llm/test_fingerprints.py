import hashlib
import random
import re
from collections import Counter

import pytest

from cuesheet.llm import fingerprints as fp
from pyspark.sql import functions as F


def _words(text):
    return re.findall(r"[^\W_]+", text.lower())


def _anchors(texts, n=fp.ANCHORS):
    held = Counter(w for t in texts for w in set(_words(t or "")))
    return {w for w, _ in sorted(held.items(), key=lambda x: (-x[1], x[0].encode()))[:n]}


def _sigs(text, common):
    w, out = _words(text), set()
    for i, x in enumerate(w):
        chain = [y for y in w[i + 1 :] if y not in common][: fp.CHAIN] if x in common else []
        if len(chain) == fp.CHAIN:
            out.add((x, *chain))
    return out or ({text.lower()} if text else set())


def _near(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def _brute(rows, n=fp.ANCHORS):
    common = _anchors([t for _, t in rows], n)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        a, b, c = (_sigs(x, common) for x in (t, e, nxt))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), 16 * len(a), 16 * len(b), round(_near(a, b), 9), round(_near(a, c), 9)))
    return Counter(out)


def _told(df):
    got = df.collect()
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], len(r["fingerprint"]), len(r["edited_fingerprint"]), round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), got


@pytest.mark.parametrize("per", [20_000, 3])
def test_query(spark, sf, monkeypatch, per):
    monkeypatch.setattr(fp, "PER_BUCKET", per)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    told, got = _told(fp.query(spark, sf))
    assert told == _brute(docs)
    text = dict(docs)
    one = {}
    for r in got:
        assert one.setdefault(text[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]


ODD = [
    (1, "the cat of the hill and the dog"), (2, None), (3, ""), (4, "..."), (4, "..."), (4, "the the the"), (None, "no id the of a b c"), (None, None), (-5, "The CAT of the hill"),
    (9, "é the été 漢字 of 漢字 x the 1 2 3"), (10, "x" * 5000), (11, "the a b " * 400), (12, "a the"), (12, "a the"), (10**15, "last one of the line"), (7, "\U0001f600\U0001f600\U0001f600 the of x y"),
]


@pytest.mark.parametrize("per", [20_000, 1])
def test_edges(spark, monkeypatch, per):
    monkeypatch.setattr(fp, "PER_BUCKET", per)
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS next", "'x' AS sigs", "2 AS _bucket")
    common = fp.anchors(df, n=3)
    assert set(common) == _anchors([t for _, t in ODD], 3)
    told, _ = _told(fp.compared(df, common))
    assert told == _brute(ODD, 3)
    for few in (0, 1):
        assert fp.compared(df.limit(few), common).count() == few
    assert fp.signed(df.withColumn("signatures", F.lit(1)), common).columns[-2:] == ["signatures_in", "signatures"]


def test_search(spark):
    rng = random.Random(3)
    base = [[rng.choice(["the", "of", "and", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(1, 120))] for _ in range(40)]
    docs = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        for k in range(6):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = f"n{rng.randrange(9)}"
            docs.append((100 + 10 * i + k, " ".join(v)))
    common = ["the", "of", "and"]
    df = spark.createDataFrame([*docs, (9000, ""), (9001, None)], "id long, text string")
    made = fp.signed(df, common).select("id", "signatures")
    queries = made.where("id % 5 = 0")
    sets = {i: _sigs(t, set(common)) for i, t in docs}
    for least in (0.5, 0.8):
        want = {(q, d): round(_near(a, b), 9) for q, a in sets.items() if q % 5 == 0 for d, b in sets.items() if _near(a, b) >= least}
        got = {(r["query_id"], r["doc_id"]): round(r["likeness"], 9) for r in fp.search(queries, made, least).collect()}
        assert got == want and len(want) > 100
    assert fp.search(queries.limit(0), made).count() == 0


def test_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = fp.compared(docs, ["the"])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
