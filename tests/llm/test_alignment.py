import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuesheet.llm import alignment as al


def _matrix(m):
    out = np.zeros((len(m.ptr) - 1, m.columns), int)
    for i in range(len(m.ptr) - 1):
        out[i, m.idx[m.ptr[i] : m.ptr[i + 1]]] = 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 12), st.integers(0, 10**6), st.integers(1, 40))
def test_product(n, k, m, seed, most):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2, (n, k)), rng.integers(0, 2, (m, k))
    one, two = (al.Csr(np.concatenate([[0], np.cumsum(x.sum(1))]), np.nonzero(x)[1], k) for x in (a, b))
    assert (_matrix(al.transpose(two)) == b.T).all()
    got = np.zeros((n, m), int)
    for i, j, v in al.product(one, al.transpose(two), most):
        got[i, j] = v
    assert (got == a @ b.T).all()


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = al.byte_letters()

    def b_bytes(i):
        t = two.id_to_piece(i)
        return bytes([int(t[3:5], 16)]) if len(t) == 6 and t.startswith("<0x") else t.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return None
        a = one.encode(" " + text, add_special_tokens=False).ids
        b = two.encode(text)
        x, y = [bytes(letters[c] for c in one.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        return (a, x, b, y) if b"".join(x) == b"".join(y) == (" " + text).encode() else None

    return tokens


def _spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def _plain(tokens, texts):
    """Groups and links of whole texts, by walking the offsets."""
    rows, held = [], Counter()
    for text in texts:
        t = tokens(text)
        if t is None:
            rows.append(None)
            continue
        a, x, b, y = t
        sa, sb = _spans(x), _spans(y)
        links, j = [], 0
        for i, (lo, hi) in enumerate(sa):
            while j < len(sb) and sb[j][1] <= lo:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < hi:
                links.append((i, k, min(hi, sb[k][1]) - max(lo, sb[k][0])))
                k += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        said, shared, i, j = [], 0, 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(sa) and sa[i][1] <= c:
                ga.append(a[i])
                i += 1
            while j < len(sb) and sb[j][1] <= c:
                gb.append(b[j])
                j += 1
            shared += len(ga) * len(gb)
            said.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        held.update((a[i], b[k]) for i, k, _ in links)
        rows.append((len(a), len(b), len(cuts), links, shared, ";".join(said), [(a[i], b[k]) for i, k, _ in links]))
    best = {}
    for (_, b), n in held.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, 0, ""))
        else:
            pairs = r[6]
            out.append((*r[:3], len(r[3]), r[4], sum(held[p] == best[p[1]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(r[5].encode()).hexdigest()))
    return out, rows


def _told(r):
    return (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_shared"], r["n_best"], r["count_sum"], r["groups_sha256"])


def test_query(spark, sf, coders):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, _ = _plain(coders, docs.values())
    got = {r["doc_id"]: _told(r) for r in al.query(spark, sf).collect()}
    assert got == dict(zip(docs, want, strict=True))


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\n  b\tc", "<|endoftext|> x </s> <s> <unk> <0x0A>", "▁a ▁ b▁ c", "a▁ b", "é 漢字 😀 x", "漢字漢字 かな",
    "x" * 70 + " y", "=" * 300, "!" * 301 + " " + "ÿ" * 50, "a\x00b c", "don't we'll 's x 's", "　a  b", "\x1c a\x1c b", "a" + " " * 40 + "b", "1 22 333 4444", "same same same",
]


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_edges(spark, coders, few):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD)] + [(3, "a b"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS n_a", "'x' AS keys")
    want, _ = _plain(coders, [t for _, t in rows])
    got = al.alignment(df, al.public_pair(), few).collect()
    assert Counter((r["doc_id"], *_told(r)) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert al.alignment(df.limit(0), al.public_pair()).count() == 0


def test_links(spark, coders):
    rows = [(i, t) for i, t in enumerate(ODD)]
    _, plain = _plain(coders, ODD)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["a_pos"], r["b_pos"], r["shared"]) for r in al.link_rows(df, al.public_pair()).collect())
    assert got == Counter((i, *x) for i, r in enumerate(plain) if r for x in r[3])
    n = Counter(r["doc_id"] for r in al.link_rows(df, al.public_pair(), "group").collect())
    assert n == Counter({i: r[4] for i, r in enumerate(plain) if r})


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .\n\t'1é漢▁ \x1c\U0001f600="), max_size=30))
def test_segments(coders, text):
    pair = al._pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    want, rows = _plain(coders, [text])
    got = next(pair.measure([text]))
    assert got[:6] == (*want[0][:5], want[0][7])
    if rows[0]:
        assert dict(zip(map(int, got[6]), map(int, got[7]), strict=True)) == Counter(a << 16 | b for a, b in rows[0][6])


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(al, "MEMO", 3)
    pair = al.Pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    one = [r[5] for r in pair.measure(["a b c d e f"])]
    assert [r[5] for r in pair.measure(["a b c d e f", "z"])][:1] == one and len(pair.known) == 7 and len(pair.older) == 6
