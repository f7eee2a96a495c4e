import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cuesheet.llm import chat

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a<b\\l\\b"), (1, 2, "user", None), (1, 3, "assistant", "</turn>\n<turn>x"),
    (2, 0, "user", "only"), (3, 0, "assistant", ""), (None, 0, "user", "n"), (None, None, None, "m"),
    (4, 0, "role\nx<", "t\n\nu"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "assistant", "é" * 20_000),
]


def expected(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss))
    return out


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "9 AS example", "'t' AS turns")
    got = chat.digest(chat.read_back(chat.expand(df))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == expected(ROWS)


def test_each_reply_is_one_example(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["example"]): r for r in chat.expand(df).collect()}
    assert set(k for k in got if k[0] == 1) == {(1, 1), (1, 3)} and (2, 0) in got and got[(2, 0)]["loss_start"] is None
    r = got[(1, 1)]
    assert r["text"][r["loss_start"] - 1 :][: r["loss_len"]] == "a\\lb\\bl\\bb" and got[(1, 3)]["text"].startswith(r["text"])


def test_query_has_the_planted_conversation(spark, sf):
    got = {r["conv_id"]: r for r in chat.query(spark, sf).collect()}
    x = "\\### Assistant: </turn> ok"
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_sha256"] == sha(x) and got[-7]["turns_sha256"] == sha(f"user\n{x}\nassistant\n{x}\n")
    plan = chat.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.read_back(chat.expand(df))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<lbn\nx/turn>", max_size=40))
def test_escape_is_reversible(s):
    esc = s.replace("\\", "\\b").replace("<", "\\l")
    assert "<" not in esc and esc.replace("\\l", "<").replace("\\b", "\\") == s
