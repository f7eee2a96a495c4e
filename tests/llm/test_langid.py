import numpy as np

from cuesheet.llm import langid as L


def test_held_out_accuracy(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in L.query(spark, sf).collect()]
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_no_false_negatives_and_correction():
    h = {lang: L.gram_hashes(text) for lang, text in (("a", "the quick brown fox jumps over"), ("b", "der schnelle braune fuchs springt"))}
    m = L.Model.build(h, "a")
    for i, lang in enumerate(m.langs):
        at = L.slots(h[lang])
        mask = m.table[at[0]] & m.table[at[1]] & m.table[at[2]]
        assert ((mask >> i) & 1).all()
    assert m.predict("the quick fox")[0] == "a" and m.predict("schnelle fuchs")[0] == "b"


def test_letters_only(spark):
    """Numbers that are no digits are no letters."""
    m = L.Model.build({"a": L.gram_hashes("the quick brown fox"), "b": L.gram_hashes("der schnelle fuchs")}, "a")
    assert [m.predict(t)[0] for t in ("½ ²", "Ⅷ", "①②", "12 _ !", "", "٣")] == ["und"] * 6
    assert m.predict("½ the quick fox Ⅷ")[0] == "a" and m.predict("日本")[0] == "a"


def test_pieces_make_no_difference():
    m = L.Model.build({"a": L.gram_hashes("the quick brown fox"), "b": L.gram_hashes("der schnelle fuchs")}, "a")
    for text in ("", "a", "ab", "abc", "½ 12", "the quick fox " * 40, "Der schnelle, schnelle Fuchs 日本 😀", "Ⅷ the"):
        whole = L.gram_hashes(text)
        for piece in (1, 2, 3, 7, 1000):
            parts = list(L.gram_pieces(text, piece))
            assert all(len(p) <= piece for p in parts) and (np.concatenate([whole[:0], *parts]) == whole).all()
            assert (L.distinct_grams(text, piece) == np.unique(whole)).all() and m.predict(text, piece) == m.predict(text)


def slow_prediction(m, text):
    """A filter of its own for each language, asked one by one."""
    h = L.gram_hashes(text)
    if not len(h):
        return "und", 0.0
    scores = []
    for i in range(len(m.langs)):
        own = (m.table >> np.uint64(i)) & np.uint64(1) == 1
        count = int(np.logical_and.reduce([own[s] for s in L.slots(h)]).sum())
        scores.append(max(0.0, (count - m.false[i] * len(h)) / (1 - m.false[i])))
    if sum(scores) <= 0:
        return m.usual, 0.0
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return m.langs[best], scores[best] / sum(scores)


def test_query_against_slow_predictions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = L.train(docs.select("doc_id", "text", "lang"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in L.query(spark, sf).collect():
        lang, score = slow_prediction(m, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9


def test_training_is_bounded(spark):
    rows = [(None, "guten tag mein freund", "de")] * 500 + [(i, f"hello there my friend {'abcdefgh'[i % 8]}", "en") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS lang_pred")
    got = L.with_language(df, L.train(df, max_docs=50)).collect()
    assert {(r["score_in"], r["lang_pred_in"]) for r in got} == {("x", 1)}
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"] == "en")


def test_edges(spark):
    rows = [(i, f"hello there my friend number {'abc'[i % 3]}", "en") for i in range(40)] + [(100 + i, f"guten tag mein lieber freund {'xyz'[i % 3]}", "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 34 !?", "en"), (203, "guten tag", None), (None, "hello there", "en"), (204, "日本", None), (205, "hello " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS g", "'k' AS r")
    got = {r["doc_id"]: r for r in L.with_language(df.drop("lang"), L.train(df)).collect()}
    assert len(got) == len(rows)
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and got[203]["lang_pred"] == "de" and got[205]["lang_pred"] == "en"
    assert got[204]["score"] == 0 and got[204]["lang_pred"] in ("en", "de")
    assert L.with_language(df.limit(0), L.train(df)).count() == 0
    assert [r["lang_pred"] for r in L.with_language(df.limit(3), L.train(df.limit(0))).collect()] == ["und"] * 3
