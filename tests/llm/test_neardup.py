import random

import numpy as np

from cuesheet.llm import neardup as N


def brute(docs):
    known = N._WordHashes()
    sets = [N.shingles(t, known) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and N.similarity(sets[i], sets[j]) >= N.THRESHOLD:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    return {frozenset(g) for g in groups.values()}


def slow_similarity(a, b):
    x, y = dict(zip(a[0].tolist(), a[1], strict=True)), dict(zip(b[0].tolist(), b[1], strict=True))
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def test_similarity_formula():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = (np.arange(0, 12, dtype=np.uint64), rng.integers(1, 5, 12).astype(float))
        b = (np.arange(6, 20, dtype=np.uint64), rng.integers(1, 5, 14).astype(float))
        assert abs(N.similarity(a, b) - slow_similarity(a, b)) < 1e-9


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(6)
    errors = []
    for _ in range(60):
        pool = rng.integers(1, 2**63, 90, dtype=np.uint64)
        pool.sort()
        a, b = (pool[:70], rng.integers(1, 4, 70).astype(float)), (pool[10:], rng.integers(1, 4, 80).astype(float))
        sig = N.signatures([a, b, (np.empty(0, np.uint64), np.empty(0))])
        errors.append((sig[0] == sig[1]).mean() - N.similarity(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def corpus():
    rng = random.Random(7)
    v = [f"{a}{b}" for a in "bcdfghklm" for b in "aeiou"]
    text = lambda n: [rng.choice(v) for _ in range(n)]
    docs = [(i, " ".join(text(rng.randrange(1, 80)))) for i in range(60)]
    for g in range(6):
        base = text(90)
        for k in range([2, 3, 5, 8, 25, 40][g]):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(v)
            docs.append((1000 * (g + 1) + k, " ".join(t)))
    docs += [(7001, docs[3][1]), (7002, docs[3][1].upper()), (7003, None), (7004, None), (7005, ""), (7006, ""), (7007, "a b c"), (7008, "a b c"), (7009, "x y " * 30_000)]
    return docs


def test_classes_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'k' AS k", "1 AS node", "2 AS a")
    got = {}
    for r in N.classes(df).collect():
        got.setdefault(r["class_id"], set()).add(r["doc_id"])
    want = {frozenset(docs[i][0] for i in g) for g in brute(docs)}
    assert {frozenset(v) for v in got.values()} == want
    assert all(k == min(v) for k, v in got.items())
    kept = N.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {min(g) for g in want}


def test_residue_index_finds_links_past_the_hub(spark):
    """x and y are far from the hub of a large bucket but close to each other."""
    rng = random.Random(8)
    v = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmn"]
    base = [rng.choice(v) for _ in range(200)]
    docs = []
    for k in range(30):
        t = list(base)
        t[rng.randrange(200)] = f"edit{k}"
        docs.append((k, " ".join(t)))
    far = list(base)
    for i in range(0, 35, 5):
        far[i] = f"far{i}"
    docs += [(100, " ".join(far)), (101, " ".join([*far[:-1], "last"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in N.classes(df).collect()}
    want = brute(docs)
    assert {frozenset(i for i in got if got[i] == c) for c in set(got.values())} == {frozenset(docs[i][0] for i in g) for g in want}


def test_long_hub_that_holds_the_shared_text(spark):
    """One bucket; its hub, the least node, holds all that x and y share, and much more that keeps it far from both."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = words(90)
    docs = [(0, " ".join(shared + words(100)))] + [(k, " ".join(words(100))) for k in range(1, 20)]
    docs += [(100, " ".join([*shared, *words(3)])), (101, " ".join([*shared, *words(4)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = N.materialise(N.nodes(df)[1].withColumn("bands", N.F.expr("transform(bands, x -> 1L)")), "one-bucket")
    ids = {r["node"]: r["doc_id"] for r in known.collect()}
    got = {frozenset((ids[r["a"]], ids[r["b"]])) for r in N.links(df, known)[0].collect()}
    assert got == {frozenset((100, 101))}


def test_links_past_the_hub_in_a_large_family(spark, monkeypatch):
    """A family of variants at 0.7 to 0.9 in one bucket gives the classes of brute force, also where blocks are small."""
    monkeypatch.setattr(N, "BLOCK", 60, raising=False)
    rng = random.Random(10)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(200)]]
    for k in range(1, 160):
        t = list(words[rng.randrange(len(words))])
        for i in rng.sample(range(200), rng.randrange(3, 7)):
            t[i] = f"edit{k}-{i}"
        words.append(t)
    docs = [(k, " ".join(t)) for k, t in enumerate(words)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = N.materialise(N.nodes(df)[1].withColumn("bands", N.F.expr("transform(bands, x -> 1L)")), "one-bucket")
    roots = {r["node"]: r["root"] for r in N.links(df, known)[1].collect()}
    groups = {}
    for r in known.select("node", "doc_id").collect():
        groups.setdefault(roots.get(r["node"], r["node"]), set()).add(r["doc_id"])
    assert {frozenset(g) for g in groups.values()} == brute(docs)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q w e r t y")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in N.keep_one(df).collect()) == ["1", "2"]
    assert N.classes(df.limit(0)).count() == 0 and N.keep_one(df.limit(0)).count() == 0


def test_repeated_ids_with_different_texts(spark):
    """Nodes are texts, so both links of id 9 stand, however the rows are dealt."""
    rng = random.Random(3)
    one, two = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    docs = [(9, one), (9, two), (5, one + " end"), (10, two + " end"), (11, None), (None, None), (None, "lonely text without an id"), (None, two)]
    for parts in (1, 2, 5):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        got = sorted((str(r["doc_id"]), r["class_id"], r["kept"]) for r in N.classes(df).collect())
        assert [g for g in got if g[0] != "None"] == [("10", 9, False), ("11", 11, True), ("5", 5, True), ("9", 5, False), ("9", 9, True)]
        assert sorted(k for i, c, k in got if i == "None") == [False, True, True] and all(c is not None for _, c, _ in got)
        kept = sorted((str(r["doc_id"]), r["text"]) for r in N.keep_one(df).collect() if r["text"])
        assert kept == sorted([("5", one + " end"), ("9", two), ("None", "lonely text without an id")])


def test_two_classes_named_by_one_id(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2)]
    docs = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " end"), (3, texts[1] + " end")]
    got = [(r["doc_id"], r["class_id"]) for r in N.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    names = sorted({c for _, c in got})
    assert len(names) == 2 and names[0] < 0 and names[1] == 1 and sorted(got)[0][1] != sorted(got)[1][1]


def test_shared_counts_and_joining():
    rng = np.random.default_rng(2)
    x, y = ([np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in sizes] for sizes in ((50, 5000, 1), (7, 6000)))
    assert (N._shared(x, y, 512) == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()
    a, b = np.array([1, 1, 2, 5]), np.array([2, 3, 3, 6])
    assert N._joining(a, b, a, b).values.tolist() == [[1, 2], [1, 3], [5, 6]]


def test_recall_in_families_of_repeating_texts(spark):
    """Families whose shingles repeat and whose members lie around the threshold: at least 0.9 of brute force's links are within
    classes; here all are."""
    rng = random.Random(12)
    v = [f"{a}{b}" for a in "bcdfghklm" for b in "aeiou"]
    docs = []
    for g in range(4):
        base = [rng.choice(v) for _ in range(70)] * (1 + g % 2)
        for k in range(70):
            t = list(base)
            for i in rng.sample(range(len(t)), rng.randrange(0, 6)):
                t[i] = f"edit{rng.randrange(9)}"
            docs.append((1000 * g + k, " ".join(t)))
    root = {r["doc_id"]: r["class_id"] for r in N.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    known = N._WordHashes()
    sets = [N.shingles(t, known) for _, t in docs]
    true = [(docs[i][0], docs[j][0]) for i in range(len(docs)) for j in range(i) if N.similarity(sets[i], sets[j]) >= N.THRESHOLD]
    found = sum(root[i] == root[j] for i, j in true)
    assert len(true) > 500 and found >= 0.9 * len(true)
    assert found == len(true)


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in N.components(e).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[102] == got[101] == 100
