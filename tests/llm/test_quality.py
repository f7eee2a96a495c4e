import re

from cuesheet.llm import quality as Q

GOOD = "This is a fine sentence about the weather in May. " * 1 + " ".join(f"word{i} is here." for i in range(40))
CASES = [
    (1, None), (2, ""), (3, " \t\n \x0b"), (4, GOOD), (4, GOOD), (5, GOOD + "\n" + GOOD), (6, "the same thing " * 60),
    (7, "\n".join(f"Item{i} | Home{i} | About{i}" for i in range(40))), (8, " ".join(f"x{i}###" for i in range(80))),
    (9, " ".join(f"LOUD{i}!!" for i in range(80))), (10, GOOD + "\nAll rights reserved by nobody in particular."),
    (11, GOOD + "\nHome | About | Contact"), (None, GOOD), (12, " ".join(f"w{i}." for i in range(30_000))), (13, " ".join(f"nodots{i}" for i in range(80))),
]


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {i + j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)} if len(w) < 2000 else set()
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(rep)


def test_measures_and_verdicts(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'c' AS clean_text")
    got = Q._verdicts(Q.assess(df)).collect()
    assert len(got) == len(CASES)
    for r in got:
        q = r["_qr"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == base(r["text"])
    assert {r["doc_id"] for r in got if r["_qr_kept"]} == {4, 10, 11, 12, None, 5} - {5}
    assert [r["_qr"]["clean_text"] for r in got if r["doc_id"] == 11] == [GOOD]


def test_clean_keeps_columns(spark):
    df = spark.createDataFrame([(1, GOOD + "\nHome | About", "en", "s", 5), (2, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = Q.clean(df).collect()
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in got] == [(1, GOOD, len(GOOD))] and Q.clean(df).columns == df.columns
    assert Q.clean(df.limit(0)).count() == 0


def test_agrees_with_quality_labels(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in Q.query(spark, sf).collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(r["kept"] == bool(labels[r["doc_id"]]) for r in got) >= 0.97 * len(got)
