import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cuesheet.llm import bpe

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
OWN = bpe.TreeBPE(RANKS, P.PATTERN)
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_every_token_encodes_to_itself():
    assert all(OWN.direct(b) == [i] for b, i in RANKS.items())


@pytest.mark.parametrize("alphabet", ["ab", "aaab", "thein", "0123", "é世a", "ing the", "!?.", "\n \t", "Aé²½ª \x85\xa0\x1c×÷_ß", "=-"])
def test_random_strings_as_the_library(alphabet):
    rng = random.Random(alphabet)
    for _ in range(150):
        s = "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 30, 60, 100, 300, 2000])))
        ids = OWN.encode(s)
        assert ids == REF.encode_ordinary(s)
        assert OWN.decode(ids) == s.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_any_text_as_the_library(s):
    assert OWN.encode(s) == REF.encode_ordinary(s)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdehinorst", min_size=2, max_size=200), st.integers(1, 199))
def test_joining_is_associative_and_direct(s, cut):
    b, cut = s.encode(), cut % len(s)
    assert OWN.join(tuple(OWN.direct(b[:cut])), tuple(OWN.direct(b[cut:]))) == tuple(OWN.direct(b)) == OWN.reduce(b)


def test_leaves_together_as_one_by_one():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"aeinrst \xc3\xa9\x00") for _ in range(rng.randrange(1, bpe.LEAF + 1))) for _ in range(3000)]
    assert OWN.leaf_table.encode(strings) == [tuple(OWN.direct(s)) for s in strings] and OWN.leaf_table.encode([]) == []


def test_batches_as_the_library(monkeypatch):
    """Small memos and portions, so that pieces are forgotten and learnt again."""
    monkeypatch.setattr(bpe, "TOGETHER", 500)
    monkeypatch.setattr(bpe, "WHOLE", 3000)
    own = bpe.TreeBPE(RANKS, P.PATTERN)
    own.memo.most = 50
    rng = random.Random(6)
    texts = ["", *(" ".join("".join(rng.choice("aeinrstö") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 300))) for _ in range(40))]
    expected = [REF.encode_ordinary(t) for t in texts]
    assert [i.tolist() for i in own.encode_all(texts)] == expected
    own.forget()
    assert not own.memo and not own.memo.old and [i.tolist() for i in own.encode_all(texts)] == expected


def test_long_piece_in_bounded_time():
    s = "=" * 30_000
    assert OWN.encode(s) == REF.encode_ordinary(s)


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "The end."), (3, "The end."), (4, "x" * 50_000), (None, "naïve")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS token_ids", "'k' AS decoded")
    tok = bpe.public_tokenizer(spark)
    got = bpe.with_round_trip(bpe.with_tokens(df, tok), tok).collect()
    assert len(got) == 6 and {(r["token_ids_in"], r["decoded_in"]) for r in got} == {(1, "k")}
    for r in got:
        assert r["token_ids"] == REF.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.digests(bpe.with_round_trip(bpe.with_tokens(df.limit(0), tok), tok)).count() == 0
