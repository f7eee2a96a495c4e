"""Byte-level BPE by monoid tree reduction.

A piece (one match of the pre-split pattern) that is no token itself is halved down to leaves of ``LEAF`` bytes, leaves are
merged directly, and neighbours are joined: the bytes around the seam are encoded anew in a window that grows until the
tokens at its edges are stable. The leaves of many pieces are merged at once, as rows of a numpy matrix.

Stability. Call a pair of tokens (a, b) stable if encoding bytes(a)+bytes(b) gives exactly [a, b]. A token sequence is
the encoding of its bytes if and only if all its neighbours are stable, given that every token encodes to itself: a merge
across a seam would have to be the lowest-ranked one at some step, and which merges happen on the two sides of a seam
before that is decided by the two tokens next to it alone. Inside both halves neighbours are stable by induction, inside
the window too; so a window whose two outer seams are stable ends the search. Should a window reach both ends, it is the
direct encoding. ``tests/llm/test_bpe.py`` holds this against the tiktoken library.

Joining is associative with the empty sequence as neutral element, so the tree's shape doesn't matter. Decoding
concatenates byte strings up a tree of halves, from runs of ``RUN`` tokens.

The ranks are broadcast (a fixed vocabulary, about a megabyte). Pieces repeat, so each worker keeps the tokens of up to
``MEMO`` pieces.

Defined cases: a null or empty text has no tokens and decodes to no bytes; repeated rows are encoded alike; an empty
table gives an empty result; other columns stay, one named like the result as ``<name>_in``.
"""

from __future__ import annotations

import base64
import gc
import heapq
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, set_aside, table, text_or_empty

LEAF = 24  # bytes
MEMO = 200_000
RUN = 256  # tokens that decoding concatenates at once
_LONG = 96  # bytes from which merging uses a heap
_NO_MERGE = 1 << 62
TOGETHER = 1 << 20
WHOLE = 1 << 22  # texts above this many characters are pre-split piece by piece, without a list of all pieces


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# The general pre-split pattern, and the same with its classes spelled out for the first 256 characters,
# which the standard library matches faster. There, words come first: nothing before them can match at the same place.
_GENERAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \t\n\r\f\v\x85\xa0"
_LATIN_1 = f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class _Memo(dict):
    """Results of ``make`` for keys met so far, in two generations: when the young one is full it becomes the old one, so
    frequent keys stay and memory is bounded. Keys longer than ``longest`` are not kept."""

    def __init__(self, make, longest: int, most: int):
        self.make, self.longest, self.most, self.old = make, longest, most, {}

    def __missing__(self, key):
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
            if len(key) > self.longest:
                return made
        self.put(key, made)
        return made

    def put(self, key, made) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = made


class _LeafTable:
    """Merges many short byte strings at once: each is a row of tokens beside a row of the ranks of its neighbours; every
    step merges the lowest-ranked, leftmost pair of each row. Ranks of pairs come from an open-addressing table."""

    EMPTY = -1

    def __init__(self, first: list[int], merges: dict[int, int]):
        self.bits = bits = max(10, (2 * len(merges)).bit_length())  # at most half full
        self.first = np.array(first, np.int64)
        keys = np.fromiter(merges, np.int64, len(merges))
        values = np.fromiter(merges.values(), np.int64, len(merges))
        self.keys, self.values = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, np.int64)
        at = self._slot(keys)
        while len(keys):  # of those that want a free slot the first gets it, the others go on
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << bits) - 1)
        pairs = self.first[:, None] << 32 | self.first[None, :]
        self.bytes = self.rank(pairs.ravel()).reshape(256, 256)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """What the two tokens of each key merge into, or _NO_MERGE."""
        out = np.full(len(keys), _NO_MERGE)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            seen = self.keys[at]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (seen != self.EMPTY)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def encode(self, strings: list[bytes]) -> list[tuple[int, ...]]:
        if not strings:
            return []
        out: list[tuple[int, ...]] = [()] * len(strings)
        n = np.array([len(s) for s in strings])
        width = int(n.max())
        raw = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
        row, ids = np.arange(len(strings)), self.first[raw]
        ranks = np.full(raw.shape, _NO_MERGE)  # its last column stays: the last token has no right neighbour
        ranks[:, :-1] = np.where(np.arange(1, width) < n[:, None], self.bytes[raw[:, :-1], raw[:, 1:]], _NO_MERGE)
        while len(row):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(row)), at]
            done = best == _NO_MERGE
            if done.any():
                for r, tokens, k in zip(row[done].tolist(), ids[done].tolist(), n[done].tolist(), strict=True):
                    out[r] = tuple(tokens[:k])
                on = ~done
                row, ids, ranks, n, at, best = row[on], ids[on], ranks[on], n[on], at[on], best[on]
                if not len(row):
                    break
            every, place = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            moved = place + (place > at[:, None])
            ids = np.take_along_axis(ids, moved, 1)
            ids[every, at] = best
            n = n - 1
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), 1)
            ranks[every, at] = _NO_MERGE
            r = np.flatnonzero(at + 1 < n)
            ranks[r, at[r]] = self.rank(best[r] << 32 | ids[r, at[r] + 1])
            r = np.flatnonzero(at > 0)
            ranks[r, at[r] - 1] = self.rank(ids[r, at[r] - 1] << 32 | best[r])
        return out


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.memo = _Memo(self.piece, _LONG, MEMO // 2)
        self.first = [ranks[bytes([b])] for b in range(256)]  # a byte-level vocabulary has all of them
        self.quick = re.compile(_LATIN_1) if pattern == _GENERAL else None
        self.seams: dict[tuple[int, int], bool] = {}

    @cached_property
    def leaf_table(self) -> _LeafTable:
        return _LeafTable(self.first, self.merges)

    @cached_property
    def merges(self) -> dict[int, int]:
        """Two neighbouring tokens as one number -> the token they merge into, which is its rank. Decoding never asks."""
        ranks = self.ranks
        return {
            ranks[b[:k]] << 32 | ranks[b[k:]]: i for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks
        }

    def direct(self, data: bytes) -> list[int]:
        """Merges the lowest-ranked neighbours, leftmost first, until none is left."""
        if len(data) > _LONG:
            return self._by_heap(data)
        merge, none = self.merges.get, _NO_MERGE
        ids = [self.first[b] for b in data]
        pairs = [merge(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            ids[i] = best
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = merge(best << 32 | ids[i + 1], none)
            if i:
                pairs[i - 1] = merge(ids[i - 1] << 32 | best, none)
        return ids

    def _by_heap(self, data: bytes) -> list[int]:
        """The same for long windows: linked neighbours and a heap of possible merges."""
        n, ranks = len(data), self.ranks
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(both + part[k])) is not None:
                    heapq.heappush(heap, (r, i, both + part[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + both)) is not None:
                heapq.heappush(heap, (r, h, part[h] + both))
        return [ranks[p] for p in part if p is not None]

    def stable(self, a: int, b: int) -> bool:
        key = (a, b)
        if (known := self.seams.get(key)) is None:
            if len(self.seams) >= MEMO:
                self.seams.clear()
            known = self.seams[key] = self.direct(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = tuple(self.direct(b"".join(map(self.bytes.__getitem__, left[len(left) - i :] + right[:j]))))
            ok_left = i == len(left) or self.stable(left[len(left) - i - 1], window[0])
            ok_right = j == len(right) or self.stable(window[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + window + right[j:]
            i = i if ok_left else min(2 * i, len(left))
            j = j if ok_right else min(2 * j, len(right))

    def reduce(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF:
            return tuple(self.direct(data))
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.reduce(data)

    def pieces(self, text: str):
        if len(text) >= WHOLE:
            return (m[0] for m in self.split.finditer(text))
        if self.quick is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.split.findall(text)
            return self.quick.findall(text)
        return self.split.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Puts the tokens of pieces into the memo, those of one leaf together."""
        memo, ranks, leaves = self.memo, self.ranks, []
        for p in pieces:
            if p in memo or p in memo.old:
                continue
            data = p.encode()
            if (whole := ranks.get(data)) is not None:
                memo.put(p, (whole,))
            elif len(data) <= LEAF:
                leaves.append((p, data))
        leaves.sort(key=lambda x: len(x[1]))
        for at in range(0, len(leaves), 4096):
            part = leaves[at : at + 4096]
            for (p, _), made in zip(part, self.leaf_table.encode([d for _, d in part]), strict=True):
                memo.put(p, made)

    def forget(self) -> None:
        self.memo.clear()
        self.memo.old = {}
        self.seams.clear()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text))))

    def encode_all(self, texts) -> list[np.ndarray]:
        """Token ids of each text; the pieces of about ``TOGETHER`` characters are learnt together."""
        out: list[np.ndarray] = []
        held: list[list[str]] = []
        size = 0

        def flush() -> None:
            if held:
                self.learn(set().union(*held))
            out.extend(np.array(list(chain.from_iterable(map(self.memo.__getitem__, pieces))), dtype=np.int32) for pieces in held)
            held.clear()

        for t in texts:
            if len(t) >= WHOLE:
                flush()
                out.append(np.array(self.encode(t), dtype=np.int32))
                continue
            held.append(self.pieces(t))
            size += len(t)
            if size >= TOGETHER:
                flush()
                size = 0
        flush()
        return out

    def decode(self, ids) -> bytes:
        n = len(ids)
        if n <= RUN:
            return b"".join(map(self.bytes.__getitem__, ids))
        return self.decode(ids[: n // 2]) + self.decode(ids[n // 2 :])


_LIVE: dict[int, TreeBPE] = {}


def _worker(shared) -> TreeBPE:
    """One encoder per worker process and broadcast. What it remembers goes at the end of a task: idle workers, and those
    that only decode next time, hold tables of fixed size and nothing else."""
    if shared.id not in _LIVE:
        _LIVE.clear()
        _LIVE[shared.id] = TreeBPE(*shared.value)
    return _LIVE[shared.id]


class _Shared:
    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.held = spark.sparkContext.broadcast((ranks, pattern))
        self.id = self.held._jbroadcast.id()

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self):
        return self.held.value


class Tokenizer:
    """encode(column) -> array of ids, decode(column) -> binary, on the executors."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        shared = _Shared(spark, load_ranks(path), pattern)
        bounded_batches(spark)

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = _worker(shared)
            try:
                for texts in batches:
                    gc.disable()  # the memo is large and without cycles; tracing it again and again costs a sixth of the time
                    try:
                        ids = own.encode_all(texts)
                    finally:
                        gc.enable()
                    yield pd.Series(ids)
            finally:
                own.forget()

        @F.pandas_udf(T.BinaryType())
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = _worker(shared)
            for ids in batches:
                yield pd.Series([own.decode(x.tolist()) if x is not None else b"" for x in ids])

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)


def public_tokenizer(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def with_tokens(df: DataFrame, tokenizer: Tokenizer, text: str = "text", out: str = "token_ids") -> DataFrame:
    return set_aside(df, out).withColumn(out, tokenizer.encode(text_or_empty(text)))


def with_round_trip(df: DataFrame, tokenizer: Tokenizer, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    return set_aside(df, out).withColumn(out, tokenizer.decode(F.col(ids)))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, token_ids, decoded -> the digest columns."""
    return df.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizer(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(with_round_trip(with_tokens(docs, tokenizer), tokenizer))
