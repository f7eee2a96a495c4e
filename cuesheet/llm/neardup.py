"""Near-duplicate classes by ProbMinHash over weighted five-word shingles, banding, and exact verification.

Similarity of two texts is the probability Jaccard index of their shingle counts,
``sum_i 1 / sum_j max(a_j / a_i, b_j / b_i)`` over shared shingles; for shingles that occur once it is the plain Jaccard
index. Texts with 0.8 or more are linked; classes are the connected components of links.

1. Signature. Every shingle is a Poisson process of rate = its count; an arrival falls into one of ``REGISTERS``
   registers, and each register keeps the shingle that arrives first. Two texts agree in a register with probability =
   their similarity. A shingle stops as soon as its next arrival is later than all registers, so most stop after a
   few draws. Vectorised over the documents of an Arrow batch.
2. Equal texts become one node, numbered by text and not by id, so copies cost one row each and no pair.
3. Banding: ``BANDS`` bands of ``ROWS`` registers; at similarity 0.8 a pair shares one with probability 0.999998.
4. Candidates. Buckets of up to ``SMALL`` nodes test all their pairs. A larger bucket first tests its nodes against one
   hub, the node with most company in all its buckets; that joins most of a family in one class, whose inner pairs need no
   test. The pairs still between two classes are left. Every node of a large bucket has a home, the hub with most company
   among those of its buckets; a family has one home as a rule.
   Same home: the home's nodes outside its largest class meet all its nodes in blocks, with their shingles. A block finds
   the pairs with ``AGREE`` of 100 registers in common (a pair at 0.8 has them but for 1 in 69 million), works out their
   exact similarity, and returns only the links that join two classes: never more rows than nodes.
   Different homes: two homes that share a bucket are compared in the same way, once for each pair of homes.
   So no pair of a bucket is left out, whatever its similarity to a hub, save those already in one class.
5. Links are verified on whole texts, classes found by alternating large-star and small-star steps, each written out.

Nothing is collected; buckets are only aggregated (size, hub, largest class) and joined, joins on hot nodes can be split by
Spark, and a large group is dealt over blocks of at most about ``BLOCK`` nodes and ``BLOCK_ITEMS`` shingles a side. The
work inside the blocks of a home is quadratic in those of its nodes that link neither to the hub nor through it.

Defined cases: null, empty and wordless texts are classes of their own; a text of under five words is one shingle; a class
is named by its least doc_id; where that names several classes, since an id came with several texts, the class of the
least text digest has it, and the others, like classes without any id, have a negative number made from their least text
digest; repeated rows share a class and ``keep_one`` keeps one of them; an empty table gives an empty result; other columns
are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, join_checked, materialise, table

WORDS = 5
REGISTERS, ROWS = 100, 4
BANDS = REGISTERS // ROWS
THRESHOLD = 0.8
SMALL = 16
AGREE = 56  # registers in common from which a pair of a larger bucket is verified
BLOCK, BLOCK_ITEMS = 512, 4_000_000
_MEMO = 200_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text and their counts."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = _mix(out * _A + h[j : j + len(out)])
    found, counts = np.unique(out, return_counts=True)
    return found, counts.astype(float)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ProbMinHash of several weighted sets at once: array of len(sets) x REGISTERS; zeros for an empty set."""
    sig = np.zeros(len(sets) * REGISTERS, np.uint64)
    first = np.full(len(sets) * REGISTERS, np.inf)
    item = np.concatenate([s[0] for s in sets]) if sets else np.empty(0, np.uint64)
    weight = np.concatenate([s[1] for s in sets]) if sets else np.empty(0)
    doc = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    at, step = np.zeros(len(item)), 0
    while len(item):
        step += 1
        draw = _mix(item + np.uint64(step * int(_A) % 2**64))
        at = at - np.log(((draw >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53) / weight
        where = doc * REGISTERS + (_mix(draw ^ _C) % np.uint64(REGISTERS)).astype(np.int64)
        early = at < first[where]
        np.minimum.at(first, where[early], at[early])
        won = early & (at == first[where])
        sig[where[won]] = item[won]
        on = at < first.reshape(len(sets), REGISTERS).max(1)[doc]
        item, weight, doc, at = item[on], weight[on], doc[on], at[on]
    return sig.reshape(len(sets), REGISTERS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _A, parts.shape[:2]).copy()
    for j in range(ROWS):
        key = _mix(key * _A + parts[:, :, j])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard index of two weighted sets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if a[1].max() == b[1].max() == 1:  # the plain Jaccard index
        return len(both) / (len(a[0]) + len(b[0]) - len(both))
    x, y = a[1][i], b[1][j]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y  # at shingle i the denominator is sum_j max(x_j / x_i, y_j / y_i), shared and unshared j
    order = np.argsort(ratio)
    ratio, xs, ys = ratio[order], x[order], y[order]
    below_y = np.concatenate([[0.0], np.cumsum(ys)])  # shared j with a lower ratio count by y
    above_x = np.concatenate([np.cumsum(xs[::-1])[::-1], [0.0]])
    k = np.arange(len(both))
    return float((1.0 / ((above_x[k] + only_a) / xs + (below_y[k] + only_b) / ys)).sum())


@F.pandas_udf(T.StructType().add("bands", T.ArrayType(T.LongType())).add("sketch", T.BinaryType()))
def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Band keys, and the low byte of every register."""
    known = _WordHashes()
    for texts in batches:
        sets = [shingles(t, known) for t in texts]
        sig = signatures(sets)
        low = sig.astype(np.uint8)
        out = [(k, b.tobytes()) if len(s[0]) else (None, None) for k, b, s in zip(band_keys(sig), low, sets, strict=True)]
        yield pd.DataFrame({"bands": pd.Series([x[0] for x in out], dtype=object), "sketch": pd.Series([x[1] for x in out], dtype=object)})


@F.pandas_udf(T.DoubleType())
def _compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity of two texts."""
    known = _WordHashes()
    for hubs, others in batches:
        out, text, own = [], None, None
        for hub, other in zip(hubs, others, strict=True):
            if hub != text or own is None:
                text, own = hub, shingles(hub, known)
            out.append(similarity(own, shingles(other, known)))
        yield pd.Series(out, dtype=float)


@F.pandas_udf(T.StructType().add("items", T.ArrayType(T.LongType())).add("counts", T.ArrayType(T.FloatType())))
def _shingled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Sorted shingle hashes; counts only where a shingle repeats."""
    known = _WordHashes()
    for texts in batches:
        sets = [shingles(t, known) for t in texts]
        counts = [c.astype(np.float32) if len(c) and c.max() > 1 else None for _, c in sets]
        yield pd.DataFrame({"items": pd.Series([h.view(np.int64) for h, _ in sets], dtype=object), "counts": pd.Series(counts, dtype=object)})


def _text_key(c: str = "text"):
    return F.unhex(F.md5(F.encode(F.col(c), "UTF-8")))


def _synthetic(k: str):
    return -1 - F.pmod(F.xxhash64(k), F.lit(1 << 60))


def nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> rows(doc_id, k, bands, sketch) and nodes(node, doc_id, k, bands, sketch), both written out; k is
    the text's digest, a node's doc_id the least with that text."""
    bounded_batches(docs.sparkSession)
    signed = docs.select("doc_id", _text_key().alias("k"), _signed("text").alias("s"))
    rows = materialise(signed.select("doc_id", "k", "s.bands", "s.sketch"), "signatures")
    least = rows.where(F.col("bands").isNotNull()).groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("bands", "sketch")).alias("m"))
    return rows, materialise(least.select(F.monotonically_increasing_id().alias("node"), "doc_id", "k", "m.bands", "m.sketch"), "nodes")


def candidates(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members(key, node) -> all pairs (a, b) of small buckets, (a = hub, b) of larger ones, and large(key, node, home).
    Sizes and hubs are written before they are joined: a join straight onto an aggregate shares its partitioning, and Spark
    could not split a hot bucket there."""
    sizes = materialise(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    held = materialise(members.join(sizes, "key"), "buckets")
    small, large = held.where(F.col("n") <= SMALL), held.where(F.col("n") > SMALL)
    pairs = small.withColumnRenamed("node", "a").join(small.select("key", F.col("node").alias("b")), "key").where("a < b")
    company = large.groupBy("node").agg(F.sum("n").alias("company"))
    first = F.max(F.struct("company", (-F.col("node")).alias("minus")))
    led = materialise(large.join(company, "node").groupBy("key").agg(first.alias("hub")), "hubs")
    starred = materialise(large.select("key", "node").join(led, "key"), "stars")
    homes = materialise(starred.groupBy("node").agg((-F.max("hub")["minus"]).alias("home")), "homes")
    stars = starred.select((-F.col("hub.minus")).alias("a"), F.col("node").alias("b")).where("a <> b")
    return pairs.select("a", "b").distinct(), stars.distinct(), starred.select("key", "node").join(homes, "node")


def _agreeing(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
    """For every two rows, whether AGREE registers are the same and the roots differ."""
    sx, sy = (np.frombuffer(b"".join(z["sketch"]), np.uint8).reshape(len(z), REGISTERS) for z in (x, y))
    same = np.zeros((len(x), len(y)), np.uint8)
    for r in range(REGISTERS):
        same += sx[:, r, None] == sy[None, :, r]
    return (same >= AGREE) & (x["root"].to_numpy()[:, None] != y["root"].to_numpy()[None, :])


def _shared(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Number of items in common for each of x and each of y: products of 0/1 matrices over ``width`` items at a time."""
    allx, ally = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(allx, ally)
    out = np.zeros((len(x), len(y)), np.float32)
    if not len(both):
        return out
    placed = []
    for side, items in ((x, allx), (y, ally)):
        row, at = np.repeat(np.arange(len(side)), [len(s) for s in side]), np.searchsorted(both, items)
        known = both[np.minimum(at, len(both) - 1)] == items
        order = np.argsort(at[known], kind="stable")
        placed.append((row[known][order], at[known][order]))
    for start in range(0, len(both), width):
        parts = []
        for side, (row, at) in zip((x, y), placed, strict=True):
            i, j = np.searchsorted(at, [start, start + width])
            part = np.zeros((len(side), width), np.float32)
            part[row[i:j], at[i:j] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _joining(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> pd.DataFrame:
    """Those of the links (a, b), with roots, that join two classes not yet joined."""
    up: dict[int, int] = {}

    def top(r: int) -> int:
        while (u := up.get(r, r)) != r:
            up[r] = up.get(u, u)
            r = u
        return r

    kept = []
    for p, (i, j) in enumerate(zip(ra.tolist(), rb.tolist(), strict=True)):
        i, j = top(i), top(j)
        if i != j:
            up[max(i, j)] = min(i, j)
            kept.append(p)
    return pd.DataFrame({"a": a[kept], "b": b[kept]})


def _block_links(block: pd.DataFrame) -> pd.DataFrame:
    """Links between the block's left and right nodes that join two classes."""
    x, y = block[block["left"]], block[~block["left"]]
    none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
    if not len(x) or not len(y):
        return none
    near = _agreeing(x, y)
    some, other = near.any(1), near.any(0)
    if not some.any():
        return none
    x, y, near = x[some], y[other], near[some][:, other]
    hx, hy = ([np.asarray(i, np.int64).view(np.uint64) for i in z["items"]] for z in (x, y))
    cx, cy = ([None if c is None else np.asarray(c, float) for c in z["counts"]] for z in (x, y))
    shared = _shared(hx, hy)
    whole = np.array([len(i) for i in hx])[:, None] + np.array([len(i) for i in hy])[None, :] - shared
    linked = near & (shared / whole >= THRESHOLD)
    repeats = near & (np.array([c is not None for c in cx])[:, None] | np.array([c is not None for c in cy])[None, :])
    for i, j in zip(*np.nonzero(repeats), strict=True):
        one, two = ((h, np.ones(len(h)) if c is None else c) for h, c in ((hx[i], cx[i]), (hy[j], cy[j])))
        linked[i, j] = similarity(one, two) >= THRESHOLD
    i, j = np.nonzero(linked)
    return _joining(*(z[c].to_numpy()[k] for c in ("node", "root") for z, k in ((x, i), (y, j))))


def _dealt(full: DataFrame, parts: DataFrame, aside: str, columns: list[str]) -> DataFrame:
    """full(key, ...) in blocks: those whose ``aside`` is not the group's most frequent one (left) against all (right).
    parts(key, most, p, q): that value, and into how many parts the two sides go."""
    placed = full.join(materialise(parts, "parts"), "key")
    dealt = F.xxhash64("node")
    i, j = F.sequence(F.lit(0), F.col("p") - 1), F.sequence(F.lit(0), F.col("q") - 1)
    left = placed.where(F.col(aside) != F.col("most"))
    left = left.select("key", F.pmod(dealt, "p").cast("int").alias("i"), F.explode(j).alias("j"), F.lit(True).alias("left"), *columns)
    right = placed.select("key", F.explode(i).alias("i"), F.pmod(dealt, "q").cast("int").alias("j"), F.lit(False).alias("left"), *columns)
    return left.union(right).groupBy("key", "i", "j")


def _parts(full: DataFrame, aside: str, others: str, items: Column) -> DataFrame:
    """For every key with several values of aside and of others: the most frequent value of aside, and numbers of parts."""
    per = full.groupBy("key", aside).agg(F.count("*").alias("c"), F.sum(items).alias("s"), F.min(others).alias("o1"), F.max(others).alias("o2"))
    led = per.groupBy("key").agg(
        F.count("*").alias("values"), F.sum("c").alias("n"), F.sum("s").alias("w"), F.max(F.struct("c", "s", aside)).alias("m"),
        F.min("o1").alias("o1"), F.max("o2").alias("o2"),
    ).where((F.col("values") > 1) & (F.col("o1") < F.col("o2")))
    number = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_ITEMS)).cast("int")
    return led.select("key", F.col(f"m.{aside}").alias("most"), number(F.col("n") - F.col("m.c"), F.col("w") - F.col("m.s")).alias("p"), number(F.col("n"), F.col("w")).alias("q"))


def within_homes(homes: DataFrame, roots: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """homes(node, home), roots so far -> further links (a, b) between nodes of one home and different classes."""
    rooted = homes.join(roots, "node", "left").select("node", F.col("home").alias("key"), F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("key")
    members = materialise(rooted.join(materialise(mixed, "mixed"), "key"), "mixed-homes")
    made = _shingle_table(members.select("node"), docs, known, "homes")
    full = members.join(made, "node").join(known.select("node", "sketch"), "node")
    parts = _parts(members.join(made.select("node", F.size("items").alias("size")), "node"), "root", "root", F.col("size"))
    groups = _dealt(full, parts, "root", ["node", "root", "sketch", "items", "counts"])
    return materialise(groups.applyInPandas(_block_links, "a long, b long").distinct(), "home-links")


def across_homes(large: DataFrame, roots: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """large(key, node, home), roots so far -> further links (a, b) between nodes that share a bucket, of different homes and
    classes. Homes that meet in a bucket make a pair of homes; of both, the nodes of such buckets are compared in blocks, once
    for the pair, however many buckets they share."""
    per = materialise(large.select("key", "home").distinct(), "bucket-homes")
    two = materialise(per.join(per.select("key", F.col("home").alias("other")), "key").where("home < other"), "home-pairs")
    rooted = materialise(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    left = rooted.join(two, ["key", "home"]).select("home", "other", "node", "root", F.lit(True).alias("left"))
    turned = two.select("key", F.col("home").alias("one"), F.col("other").alias("home"))
    right = rooted.join(turned, ["key", "home"]).select(F.col("one").alias("home"), F.col("home").alias("other"), "node", "root", F.lit(False).alias("left"))
    members = materialise(left.union(right).distinct(), "across-members")
    mixed = members.groupBy("home", "other").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("home", "other")
    members = materialise(members.join(materialise(mixed, "mixed"), ["home", "other"]), "across-mixed")
    made = _shingle_table(members.select("node").distinct(), docs, known, "across")
    number = lambda side: F.greatest(F.lit(1), F.ceil(F.greatest(F.sum(side) / BLOCK, F.sum(F.when(side == 1, F.col("size"))) / BLOCK_ITEMS))).cast("int")
    is_left = F.col("left").cast("int")
    sized = members.join(made.select("node", F.size("items").alias("size")), "node")
    parts = materialise(sized.groupBy("home", "other").agg(number(is_left).alias("p"), number(1 - is_left).alias("q")), "across-parts")
    full = members.join(made, "node").join(known.select("node", "sketch"), "node").join(parts, ["home", "other"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("left"), F.col("p")).otherwise(F.col("q"))).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.when(F.col("left"), F.col("q")).otherwise(F.col("p")) - 1))
    placed = full.select("home", "other", own.alias("_own"), met.alias("_met"), "left", "node", "root", "sketch", "items", "counts")
    i, j = F.when(F.col("left"), F.col("_own")).otherwise(F.col("_met")), F.when(F.col("left"), F.col("_met")).otherwise(F.col("_own"))
    blocks = placed.withColumns({"i": i, "j": j}).drop("_own", "_met")
    return materialise(blocks.groupBy("home", "other", "i", "j").applyInPandas(_block_links, "a long, b long").distinct(), "across-links")


def _texts(ids: DataFrame, docs: DataFrame, known: DataFrame, label: str) -> DataFrame:
    """ids(node) -> node, text; written out. Of copies only rows with the least id are read on."""
    wanted = ids.distinct().join(known.select("node", "k", F.col("doc_id").alias("least")), "node")
    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", "text", _text_key().alias("k"))
    found = join_checked(keyed, wanted, ["k"], "inner", f"{label}-ids").where(F.col("doc_id").eqNullSafe(F.col("least")))
    return materialise(found.select("node", "text").dropDuplicates(["node"]), f"{label}-texts")


def _shingle_table(ids: DataFrame, docs: DataFrame, known: DataFrame, label: str) -> DataFrame:
    """ids(node) -> node, items, counts; written out."""
    made = _texts(ids, docs, known, label).select("node", _shingled("text").alias("s"))
    return materialise(made.select("node", "s.items", "s.counts"), f"{label}-shingles")


def verify(pairs: DataFrame, docs: DataFrame, known: DataFrame, label: str) -> DataFrame:
    """pairs(a, b) -> those that are links; written out."""
    texts = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, known, label)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    told = materialise(both.select("a", "b", _compare("ta", "tb").alias("similarity")), f"{label}-verified")
    return told.where(F.col("similarity") >= THRESHOLD).select("a", "b")


def links(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between nodes, all that join two classes; and their components (node, root)."""
    pairs, stars, large = candidates(known.select("node", F.explode("bands").alias("key")))
    large = materialise(large, "large")
    good = verify(materialise(pairs.union(stars).distinct(), "pairs"), docs, known, "first")
    roots = components(good)
    if large.isEmpty():
        return good, roots
    more = within_homes(large.select("node", "home").distinct(), roots, docs, known)
    if not more.isEmpty():
        good = good.union(more)
        roots = components(good)
    rest = across_homes(large, roots, docs, known)
    if not rest.isEmpty():
        good = good.union(rest)
        roots = components(good)
    return good, roots


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, root = least node of its component, for every node with an edge."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(new)
        both = now.union(now.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.union(lower).distinct(), "edges")


def _named(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, k, class_id, worded, kept per row; kept: the row is the class's least by (id, text digest)."""
    docs = docs.select("doc_id", "text")
    rows, known = nodes(docs)
    _, roots = links(docs, known)
    rooted = materialise(known.select("node", "doc_id", "k").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("first")
    least = materialise(rooted.groupBy("root").agg(place, F.min("k").alias("least_k")).withColumn("id", F.col("first.doc_id")), "least")
    shared = least.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n"), F.min("least_k").alias("owner_k")).where("n > 1")
    owned = join_checked(least, shared.select("id", "owner_k"), ["id"], "left", "shared-ids")
    owner = F.col("id").isNotNull() & (F.col("owner_k").isNull() | (F.col("owner_k") == F.col("least_k")))
    named = owned.select("root", "first", F.when(owner, F.col("id")).otherwise(_synthetic("least_k")).alias("class_id"))
    told = materialise(rooted.select("k", "root").join(materialise(named, "names"), "root").select("k", "class_id", "first"), "named")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k") == F.col("first.k"))
    return rows.select("doc_id", "k").join(told, "k", "left").select(
        "doc_id", "k", F.coalesce("class_id", "doc_id", _synthetic("k"), F.lit(-1)).alias("class_id"),
        F.col("first").isNotNull().alias("worded"), F.when(F.col("first").isNull(), True).otherwise(is_first).alias("kept"),
    )


def classes(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id, kept per row. Rows alike in id and text are kept alike."""
    return _named(docs).select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least id; columns as given. Of rows alike in id and text one stays."""
    rows = materialise(_named(docs), "classes")  # an aggregate straight on its join would keep Spark from splitting a hot text
    per = rows.where("worded").groupBy("doc_id", "k", "kept").agg(F.count("*").alias("n")).where("NOT kept OR n > 1")
    told = materialise(per.select(F.col("doc_id").alias("_nd_id"), F.col("k").alias("_nd_k"), "kept"), "copies")
    keyed = docs.withColumn("_nd_text", _text_key())

    def meeting(how: str, which: DataFrame) -> DataFrame:
        few = which.count() <= 500_000
        same = (F.col("_nd_text") == F.col("_nd_k")) & F.col("doc_id").eqNullSafe(F.col("_nd_id"))
        return keyed.join(F.broadcast(which) if few else which.hint("merge"), same, how)

    once = meeting("left_anti", told.select("_nd_id", "_nd_k")).select(*docs.columns)
    repeated = meeting("left_semi", told.where("kept").select("_nd_id", "_nd_k")).dropDuplicates(["doc_id", "_nd_text"])
    return once.union(repeated.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
