import random
import re

import pytest
from pyspark.sql import functions as F

from cuesheet.functions import sql
from cuesheet.functions import text as X
from cuesheet.operators import media
from cuesheet.plans import registry
from cuesheet.sources import views


def test_registered_functions(spark):
    sql.register(spark, [("York", "Jorvik")])
    one = spark.sql("""SELECT seq_ratio('abcd', 'bcde') AS r, spoken_form('21 kg') AS s, repair_json('x [{"id": 1}, {"id": 2') AS j, glossary_apply('York') AS g""").first()
    assert one["r"] == 0.75 and one["s"] == "hai mươi mốt kilôgam" and one["j"] == '[{"id": 1}, {"id": 2}]' and one["g"] == "Jorvik"


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(map(tuple, df.select(*sorted(want.columns)).collect()), key=repr) for df in (got, want)]
    assert len(rows[1]) > 0 and rows[0] == rows[1]


def odd_segments(spark):
    """Overlapping segments, blank and null texts, long words, marks of all kinds, word times in every other row."""
    rng, rows = random.Random(4), [(1, 900, 50, 60, None, None), (1, 901, 50, 60, "", None), (2, 902, 0, 50_000, " \t ", None), (2, 903, 0, 50_000, None, None)]
    for i in range(150):
        text = "".join("".join(rng.choice("abé ") for _ in range(rng.choice([1, 9, 20, 90]))) + rng.choice([". ", "。", ", ", "; ", " -", "… ", "\n"]) for _ in range(rng.randrange(1, 14)))
        start = rng.randrange(60_000)
        end, each = start + rng.choice([0, 900, 9000, 25_000, 40_000]), text.split()
        rows.append((i % 3, i, start, end, text, [(w, start + (end - start) * (k + 1) // len(each)) for k, w in enumerate(each)] if i % 2 else None))
    return spark.createDataFrame(rows, "media_id long, seg_id int, start_ms long, end_ms long, text string, words array<struct<word:string,t1_ms:long>>")


def test_table_functions_give_the_rows_of_the_operators(spark, sf):
    sql.register(spark)
    segs = odd_segments(spark)
    segs.createOrReplaceTempView("odd_segments")
    same(spark.sql("SELECT * FROM split_long(TABLE(odd_segments), most_ms => 8000)"), media.split_long(segs, 8000))
    same(spark.sql("SELECT * FROM split_for_display(TABLE(odd_segments))"), media.split_for_display(segs))
    for args in ((1, 0, False), (2, 3, True), (1, 5, False), (3, 0, True)):
        got = spark.sql("SELECT * FROM split_for_display(TABLE(odd_segments), lines => {}, line_words => {}, all_caps => {})".format(*args))
        same(got, media.split_for_display(segs, *args))
    views.load(spark, sf, "segments").createOrReplaceTempView("whole_segments")
    same(spark.sql("SELECT * FROM split_for_display(TABLE(whole_segments))"), registry.queries()["e15_display_cues"](spark, sf))


def test_long_segments_of_the_query(spark, sf):
    """e14_split_long row by row against the table function over the same rows."""
    from cuesheet.operators import segments as S

    sql.register(spark)
    segs = views.load(spark, sf, "segments")
    words = S.word_times(segs).groupBy("media_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "t1_ms"))).alias("words"))
    segs.join(words.withColumn("words", F.when(F.col("seg_id") % 3 > 0, F.col("words"))), ["media_id", "seg_id"], "left").createOrReplaceTempView("heard")
    same(spark.sql("SELECT * FROM split_long(TABLE(heard))"), registry.queries()["e14_split_long"](spark, sf))


def test_table_functions_refuse_other_tables(spark):
    sql.register(spark)
    spark.range(3).createOrReplaceTempView("only_ids")
    with pytest.raises(Exception, match="has no media_id"):
        spark.sql("SELECT * FROM split_long(TABLE(only_ids))").collect()


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_glossary_against_a_plain_scan(spark, case_sensitive):
    """At each place the longest term that stands alone, as a scan letter by letter finds it."""
    rng = random.Random(11)
    parts = ["a", "ab", "b", "é", "Ab", "x_1", "C++", "$", " ", ".", "b a", "中", "a-b"]
    terms = [("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))), f"<{i}$\\1>") for i in range(60)] + [(" ", "never"), ("", "never"), ("ab", "second")]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(150)] + [None, ""]
    known = {}
    for a, b in terms:
        if a.strip():
            known.setdefault(a.strip() if case_sensitive else a.strip().lower(), b)
    letter = lambda c: c == "_" or c.isalnum()

    def scan(text):
        if text is None:
            return None
        low, out, i = text if case_sensitive else text.lower(), [], 0
        while i < len(text):
            fits = [k for k in known if low.startswith(k, i) and not (i and letter(text[i - 1])) and not (i + len(k) < len(text) and letter(text[i + len(k)]))]
            best = max(fits, key=len, default=None)
            out.append(known[best] if best else text[i])
            i += len(best) if best else 1
        return "".join(out)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.glossary(F.col("t"), terms, case_sensitive).alias("g"))
    assert [r["g"] for r in df.orderBy("i").collect()] == [scan(t) for t in texts]
    assert not re.search("Python|Exchange", df._jdf.queryExecution().toString())
    assert spark.createDataFrame([("a",)], "t string").select(X.glossary(F.col("t"), [])).first()[0] == "a"


def test_ratio_bound(spark):
    from difflib import SequenceMatcher

    rng = random.Random(2)
    pairs = [("".join(rng.choice("abcé😀") for _ in range(rng.randrange(12))), "".join(rng.choice("abdé😀") for _ in range(rng.randrange(12)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.ratio_bound(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r["r"] >= SequenceMatcher(None, r["a"], r["b"]).ratio() for r in got)
    counted = lambda a, b: 2.0 * sum(min(a.count(c), b.count(c)) for c in set(a)) / (len(a) + len(b)) if a or b else 1.0
    assert all(r["r"] == counted(r["a"], r["b"]) for r in got)
