"""Token alignment of two tokenizers by sparse products of token-byte incidence matrices.

A is the incidence matrix of the first tokenizer's tokens and the bytes of space+text, B the second one's. Both are built
in compressed sparse rows (``Csr``). The product A.B^T by Gustavson's row method has an entry wherever two tokens share
bytes: the overlap links, with the number of shared bytes. Offsets where tokens of both end cut the bytes into groups; the
product of the two token-group incidence matrices links all tokens of one group. Its entries are counted from row sizes
(the symbolic phase), and worked out in blocks only where ``link_rows`` asks for them, since a long group has many.

Segments. Neither tokenizer merges across a single space between two characters that are no white space: the first one's
pattern starts a match there, and the second one has no piece with a space after anything else (checked when it is
loaded; otherwise a text is one segment). So both have a token end there, groups and links stay inside the segment, and a
text's result is the concatenation of its segments' results. Most segments are words that repeat; a worker remembers
two generations of up to ``MEMO`` segments or ``MEMO_CHARS`` characters (and what one batch adds). The products of all new
segments of an Arrow batch are one block-diagonal product.

Counts of id pairs are added up over all documents by Spark. They come back to the documents by a broadcast join if there
are at most ``max_pairs`` of them, else by a shuffled join.

Defined cases: null and empty texts, and texts whose joined token bytes differ from space+text, have no tokens: zeros and
an empty digest; repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, join_checked, materialise, table

MEMO, MEMO_CHARS = 150_000, 3_000_000
TOGETHER = 512  # plain segments encoded at once
MOST = 1 << 22  # entries that a product makes at once
_FIELD = 40  # bits of a number of tokens; a segment's numbers are one integer, so that a text's are one sum
_MASK = (1 << _FIELD) - 1
_SHIFT = 16  # an id pair is one number: first id << _SHIFT | second id
_CUT = re.compile("(?<=[^\\s▁])(?= \\S)")
_PLAIN = re.compile(" [^\\s▁](?:.*[^\\s▁])?", re.DOTALL)  # put after one another, these are cut again where they meet


# --- sparse matrices --------------------------------------------------------------------------------------------------


class Csr(NamedTuple):
    """A 0/1 matrix: row i has ones in the columns idx[ptr[i]:ptr[i + 1]]."""

    ptr: np.ndarray
    idx: np.ndarray
    columns: int


def incidence(ends: np.ndarray) -> Csr:
    """Tokens x bytes, from the offsets where tokens end."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]).astype(np.int64), np.arange(n, dtype=np.int64), n)


def membership(group: np.ndarray, n: int) -> Csr:
    """Tokens x groups, from each token's group."""
    return Csr(np.arange(len(group) + 1, dtype=np.int64), group.astype(np.int64), n)


def transpose(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.ptr) - 1, dtype=np.int64), np.diff(m.ptr))
    ptr = np.concatenate([[0], np.cumsum(np.bincount(m.idx, minlength=m.columns))]).astype(np.int64)
    return Csr(ptr, rows[np.argsort(m.idx, kind="stable")], len(m.ptr) - 1)


def row_work(a: Csr, bt: Csr) -> np.ndarray:
    """For each row of a, how many products its row of a.bt adds up (all different ones, where a has one entry a row)."""
    run = np.concatenate([[0], np.cumsum(np.diff(bt.ptr)[a.idx])])
    return run[a.ptr[1:]] - run[a.ptr[:-1]]


def product(a: Csr, bt: Csr, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of a.bt, in blocks of rows that make at most ``most`` products (or one row)."""
    done = np.concatenate([[0], np.cumsum(row_work(a, bt))])
    lo, n = 0, len(a.ptr) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + most, "right")) - 1)
        idx = a.idx[a.ptr[lo] : a.ptr[hi]]
        begin, size = bt.ptr[idx], bt.ptr[idx + 1] - bt.ptr[idx]
        total = int(size.sum())
        if total:
            flat = np.arange(total) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            rows = np.repeat(np.repeat(np.arange(lo, hi), np.diff(a.ptr[lo : hi + 1])), size)
            cells, value = np.unique(rows * bt.columns + bt.idx[flat], return_counts=True)
            yield cells // bt.columns, cells % bt.columns, value
        lo = hi


# --- the two tokenizers -----------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The byte of each letter in a byte-level vocabulary: printable Latin-1 stands for itself, other bytes in order for
    the letters from 256 on."""
    same = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(other)}


class _Byte:
    """A byte-level BPE file; a segment begins with its space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        self.coder.no_truncation()
        letters = byte_letters()
        n = self.coder.get_vocab_size(with_added_tokens=True)
        names = [self.coder.id_to_token(i) or "" for i in range(n)]
        self.bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]

    def encode(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast(segments, add_special_tokens=False)]


class _Piece:
    """A sentencepiece file that adds the segment's space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.coder = SentencePieceProcessor(model_file=path)
        names = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        told = [re.fullmatch("<0x([0-9A-Fa-f]{2})>", t) for t in names]
        self.bytes = [bytes([int(m[1], 16)]) if m else t.replace("▁", " ").encode() for t, m in zip(names, told, strict=True)]
        kept = "".join(names[i] for i in self.coder.encode(" a ")) == "▁▁a▁"
        self.by_word = kept and not any(re.search("[^▁]▁", t) for t in names)

    def encode(self, segments: list[str]) -> list[list[int]]:
        return self.coder.encode([s[1:] for s in segments], num_threads=1)


class Aligned(NamedTuple):
    """Tokens of some segments, one after the other, with all that links them."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_at: np.ndarray  # tokens of segment i are a[a_at[i]:a_at[i + 1]]
    b_at: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    n_groups: int
    a_ends: np.ndarray
    b_ends: np.ndarray


class Pair:
    """Both tokenizers, and what the segments seen so far gave."""

    def __init__(self, path_a: str, path_b: str):
        self.one, self.two = _Byte(path_a), _Piece(path_b)
        self.len_a, self.len_b = (np.array([len(t) for t in c.bytes], np.int64) for c in (self.one, self.two))
        n, m = len(self.one.bytes), len(self.two.bytes)
        if m > 1 << _SHIFT:
            raise ValueError(f"the second vocabulary has more than {1 << _SHIFT} entries")
        names = [str(i) for i in range(max(n, m))]  # an id, then what follows it
        self.said = [f"{i}{mark}" for mark in ",|;" for i in names]
        self.width = len(names)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.chars = 0

    def segments(self, text: str) -> list[str]:
        """space+text in segments."""
        if not self.two.by_word:
            return [" " + text]
        if "▁" not in text and " ".join(text.split()) == text.replace("\n", " "):  # single spaces and line ends only: every space is a cut
            return [" " + w for w in text.split(" ")]
        return _CUT.split(" " + text)

    def _encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]] | None:
        """Tokens of each, if all give their segment's bytes back."""
        a, b = self.one.encode(segments), self.two.encode(segments)
        same = all(b"".join(map(self.one.bytes.__getitem__, x)) == s.encode() == b"".join(map(self.two.bytes.__getitem__, y)) for s, x, y in zip(segments, a, b, strict=True))
        return (a, b) if same else None

    def align(self, segments: list[str]) -> tuple[list[str], list[str], Aligned]:
        """Segments of which both tokenizers give the bytes back, the others, and the tokens of the former. Plain segments
        are encoded many at once: put together, they are cut again where they were."""
        plain = [s for s in segments if self.two.by_word and _PLAIN.fullmatch(s)]
        held = set(plain)
        todo = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)] + [[s] for s in segments if s not in held]
        good, bad, a, b = [], [], [], []
        for some in todo:
            made = self._encode(["".join(some)])
            parts = [(some, made)] if made or len(some) == 1 else [([s], self._encode([s])) for s in some]
            for each, ids in parts:
                if ids:
                    good += each
                    a += ids[0]
                    b += ids[1]
                else:
                    bad += each
        flat = [np.fromiter(chain.from_iterable(z), np.int64, sum(map(len, z))) for z in (a, b)]
        ends_a, ends_b = np.cumsum(self.len_a[flat[0]]), np.cumsum(self.len_b[flat[1]])
        stops = np.cumsum([0, *(len(s.encode()) for s in good)])
        at = [np.searchsorted(e, stops, "right") for e in (ends_a, ends_b)]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        return good, bad, Aligned(*flat, *at, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), len(cuts), ends_a, ends_b)

    def learn(self, segments: list[str]) -> None:
        """Work out segments not seen so far."""
        good, bad, x = self.align(segments)
        ga, gb = membership(x.a_group, x.n_groups), membership(x.b_group, x.n_groups)
        shared = row_work(ga, transpose(gb))
        cells = list(product(incidence(x.a_ends), transpose(incidence(x.b_ends))))
        rows, columns = (np.concatenate([c[k] for c in cells]) if cells else np.empty(0, np.int64) for k in (0, 1))
        keys = (x.a[rows] << _SHIFT | x.b[columns]).tolist()
        link_at = np.searchsorted(rows, x.a_at)
        # the tokens in the order of the groups' text: first the group's tokens of a, then those of b
        before = lambda g, h, side: np.arange(len(g)) + np.searchsorted(h, g, side)
        pa, pb = before(x.a_group, x.b_group, "left"), before(x.b_group, x.a_group, "right")
        last = lambda g: np.diff(g, append=-1) != 0
        words = np.empty(len(x.a) + len(x.b), np.int64)
        words[pa], words[pb] = x.a + self.width * last(x.a_group), x.b + 2 * self.width * last(x.b_group)
        said = list(map(self.said.__getitem__, words.tolist()))
        shared_at = np.concatenate([[0], np.cumsum(shared)])[x.a_at]
        numbers = zip(*(np.diff(z).tolist() for z in (x.a_at, x.b_at, shared_at)), strict=True)
        links, both = link_at.tolist(), (x.a_at + x.b_at).tolist()
        for i, (s, (na, nb, ns)) in enumerate(zip(good, numbers, strict=True)):
            self.known[s] = na | nb << _FIELD | ns << 2 * _FIELD, tuple(keys[links[i] : links[i + 1]]), "".join(said[both[i] : both[i + 1]])[:-1]
        self.known |= dict.fromkeys(bad)
        self.chars += sum(map(len, segments))

    def measure(self, texts: list[str | None]) -> Iterator[tuple]:
        """n_a, n_b, n_groups, n_links, n_shared, groups_sha256, id pairs, how often each."""
        if len(self.known) > MEMO or self.chars > MEMO_CHARS:
            self.known, self.older, self.chars = {}, self.known, 0
        split = [self.segments(t) if t else [] for t in texts]
        new = set(chain.from_iterable(split)) - self.known.keys()
        again = new & self.older.keys()
        self.known |= {s: self.older[s] for s in again}
        self.learn(sorted(new - again))
        for seg in split:
            found = list(map(self.known.__getitem__, seg))
            if not found or None in found:
                yield 0, 0, 0, 0, 0, "", (), ()
                continue
            numbers, pairs, groups = zip(*found, strict=True)
            n, said = sum(numbers), ";".join(groups)
            links = np.fromiter(chain.from_iterable(pairs), np.int64)
            keys, times = np.unique(links, return_counts=True)
            n_a, n_b, n_shared = n & _MASK, n >> _FIELD & _MASK, n >> 2 * _FIELD
            yield n_a, n_b, said.count("|"), len(links), n_shared, hashlib.sha256(said.encode()).hexdigest(), keys, times.astype(np.int32)

    def links(self, text: str, kind: str) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks of a_pos, b_pos, a_id, b_id and value of a text's links; the value is the number of shared bytes or groups."""
        if not text:
            return
        _, bad, x = self.align([" " + text])
        if bad:
            return
        if kind == "overlap":
            a, b = incidence(x.a_ends), incidence(x.b_ends)
        else:
            a, b = membership(x.a_group, x.n_groups), membership(x.b_group, x.n_groups)
        for i, j, value in product(a, transpose(b)):
            yield i, j, x.a[i], x.b[j], value


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    """This worker's tokenizers."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def _public(a: str, b: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(a), public_tokenizers.path(b)


# --- Spark ------------------------------------------------------------------------------------------------------------

_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def coded(docs: DataFrame, find: Callable[[], tuple[str, str]]) -> DataFrame:
    """docs(doc_id, text) -> row, doc_id, numbers of tokens, groups and links, groups_sha256, and the id pairs linked with
    how often each. find() names the two files on a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(*find())
        for x in batches:
            made = pd.DataFrame(pair.measure(x["text"].tolist()), columns=[*_NUMBERS, "groups_sha256", "keys", "times"])
            yield pd.concat([x[["row", "doc_id"]].reset_index(drop=True), made], axis=1)
        pair.forget()

    bounded_batches(docs.sparkSession, size="4m")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, f"row long, doc_id long, {', '.join(n + ' long' for n in _NUMBERS)}, groups_sha256 string, keys array<long>, times array<int>")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pairs(key, n) -> key, count, best: the number of links of an id pair, and whether it is the highest of its second id."""
    total = materialise(pairs.groupBy("key").agg(F.sum("n").alias("count")), "pair-counts")
    second = F.col("key").bitwiseAND((1 << _SHIFT) - 1)
    most = total.groupBy(second.alias("b")).agg(F.max("count").alias("most"))  # at most 2^16 rows
    return total.join(F.broadcast(most), second == F.col("b")).select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, find: Callable[[], tuple[str, str]], max_pairs: int = 2_000_000) -> DataFrame:
    """docs(doc_id, text) -> per row doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256."""
    told = materialise(coded(docs, find), "aligned")
    pairs = told.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("row", F.col("p.keys").alias("key"), F.col("p.times").alias("n"))
    met = join_checked(pairs, pair_counts(pairs), ["key"], "inner", "pair-best", max_pairs)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return told.drop("keys", "times").join(sums, "row", "left").select("doc_id", *_NUMBERS, *zero, "groups_sha256")


def link_rows(docs: DataFrame, find: Callable[[], tuple[str, str]], kind: str = "overlap") -> DataFrame:
    """docs(doc_id, text) -> one row per link: positions and ids of the two tokens, and the number of bytes (kind overlap) or
    groups (kind group) that they share."""
    names = ["a_pos", "b_pos", "a_id", "b_id", "shared"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(*find())
        for x in batches:
            for doc_id, text in zip(x["doc_id"], x["text"], strict=True):
                for block in pair.links(text, kind):
                    made = pd.DataFrame(dict(zip(names, block, strict=True)))
                    made.insert(0, "doc_id", pd.array([doc_id], "Int64").repeat(len(made)))
                    yield made

    if kind not in ("overlap", "group"):
        raise ValueError(kind)
    bounded_batches(docs.sparkSession, size="4m")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, " + ", ".join(n + " long" for n in names))


def public_pair(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Callable[[], tuple[str, str]]:
    return lambda: _public(a, b)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents").select("doc_id", "text"), public_pair())
