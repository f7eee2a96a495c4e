import random
import re

from cuesheet.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(UP))


def brute(docs, items, size=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            b = words(x)
            n = min(size, len(b))
            grams = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
        out.append((i, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=str)


def case():
    rng = random.Random(4)
    v = ["Ünder", "alpha", "B2", "c", "delta", "Éa"]
    line = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choice(v) for _ in range(n))
    items = [(1, "one two three"), (2, line(14)), (3, line(10)), (4, None), (5, "!!"), (6, line(14)), (7, "one two three"), (8, "Zeta")]
    docs = [(i, line(rng.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "ONE, two; THREE one two three"), (102, "x " * 5000 + items[1][1]), (103, items[1][1]), (103, items[1][1]), (None, items[2][1]), (None, "clean"), (104, "...zeta!"), (105, "-" * 50_000)]
    return docs, items


def frames(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' AS window", "1 AS hash", "2 AS at")
    return docs, items, d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'q' AS words")


def test_against_brute_force_and_in_blocks(spark):
    docs, items, d, b = frames(spark)
    for most, size in ((1_000_000, D.MAX_BYTES), (4, D.MAX_BYTES), (1_000_000, 1_000)):  # one block, by rows, by bytes with sets shuffled
        got = D.judge(D.numbered(d), b, max_windows=most, max_bytes=size).collect()
        assert sorted([(r["doc_id"], r["n_words"], tuple(r["positions"]), tuple(r["item_ids"])) for r in got], key=str) == brute(docs, items)


def test_removal(spark):
    docs, items, d, b = frames(spark)
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns
    clean = sorted(str(i) for i, _, hit, _ in brute(docs, items) if not hit)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == clean
    same_id = spark.createDataFrame([(1, "one two three"), (1, "clean text"), (1, None)], "doc_id long, text string")
    assert sorted(str(r["text"]) for r in D.decontaminate(same_id, b).collect()) == ["None", "clean text"]
    spans = {r["doc_id"]: r["text"] for r in D.remove_spans(d.where("doc_id = 104"), b).collect()}
    assert spans[104] == ""
    rows = [(1, "Alpha one two three beta, gamma one TWO three"), (2, "nothing here"), (3, None), (4, "zeta zeta a zeta")]
    cut = {r["doc_id"]: r["text"] for r in D.remove_spans(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()}
    assert cut == {1: "alpha beta gamma", 2: "nothing here", 3: None, 4: "a"}


def test_empty_tables_and_native(spark, sf):
    _, _, d, b = frames(spark)
    assert D.judge(D.numbered(d.limit(0)), b).count() == 0
    none = D.judge(D.numbered(d), b.limit(0)).collect()
    assert len(none) == len(case()[0]) and all(not r["positions"] for r in none)
    plan = D.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    docs = D.numbered(spark.read.parquet(f"{sf}/documents.parquet"))
    scan = D.hits(docs, D.indexed(spark.read.parquet(f"{sf}/benchmark.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in scan and "Arrow" not in scan and "BroadcastHashJoin" in scan


def test_a_shared_passage_carries_its_items_once(spark):
    """Windows that the same items have share one set; ids of any text keep their order and number."""
    passage = " ".join(f"w{i}" for i in range(60))
    items = [(f"item,{i}", passage) for i in range(300)] + [("own", passage + " tail one two three")] + [(None, "alone")]
    b = spark.createDataFrame(items, "item_id string, text string")
    known = D.indexed(b)
    assert known.groupBy("set_id").count().count() == 3 and known.count() == 51 + 4 + 1
    d = spark.createDataFrame([(1, "x " + passage + " y"), (2, passage + " tail"), (3, "w0 w1"), (4, "alone here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in D.judge(D.numbered(d), b).collect()}
    everyone = sorted([i for i, _ in items[:-1]])
    assert got[1]["item_ids"] == everyone and got[2]["item_ids"] == everyone and got[3]["item_ids"] == []
    assert len(got[1]["positions"]) == 60 and len(got[2]["positions"]) == 61
    assert got[4]["positions"] == [0] and got[4]["item_ids"] == []
    sets = D.hits(D.numbered(d), known).where("doc_id = 1 AND length > 0").select("set_id").distinct().count()
    assert sets == 1
