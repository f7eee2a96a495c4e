"""Document fingerprints by SpotSigs, in DataFrame functions only.

Anchors are the ``ANCHORS`` words that most documents of the corpus hold. Every occurrence of an anchor gives one signature: the
anchor and the chain of the next ``CHAIN`` content words (words that are no anchors) after it. A text's fingerprint is the set
of its signatures; two are compared by the Jaccard index of the sets. Sets are partitioned by length, in classes so wide that
sets of more than one class apart can't reach the wanted likeness; inside, the ratio of the lengths, an upper bound of the index,
prunes before sets are intersected. ``search`` finds all texts near to given ones that way; the registered query compares the
pairs that it states (a text and its edited copy, a text and the next one) and wants every likeness, so there only the bound of
an empty set prunes.

The next document needs an order over all rows. Bounds from a percentile sketch of the ids cut them into buckets of about
``PER_BUCKET`` rows, found by binary search in a row; one shuffle brings a bucket together, with a copy of the first row of the
bucket after it, so no row waits for another bucket and no task sees more than its own.

Defined cases: words are runs of letters and digits, in lower case; a text without a complete chain has one signature, its
lower-case whole; a null or empty text has none, and an empty fingerprint; two empty fingerprints are alike (1), an empty one
and another are not (0); rows of equal id are ordered by text, descending; rows without an id come last and share a bucket, as
rows of one id do; a single row is its own next one; repeated rows count each; an empty table gives an empty result; other
columns are ignored, or kept by ``signed``, which renames one named like the result to ``<name>_in``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import set_aside, table, text_or_empty

ANCHORS, CHAIN = 64, 2
PER_BUCKET, MOST_BUCKETS = 20_000, 65_536


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def anchors(docs: DataFrame, text: str = "text", n: int = ANCHORS) -> list[str]:
    """The n words that most documents hold, ties in order of the words."""
    each = docs.select(F.explode(F.array_distinct(words(text_or_empty(text)))).alias("word"))
    top = each.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)
    return [r["word"] for r in top.collect()]  # n rows


def signatures(text: Column, common: list[str]) -> Column:
    """The set of a text's signatures, as sorted hashes. text isn't null."""

    def is_anchor(w: Column) -> Column:
        return w.isin(common) if common else F.lit(False)

    def chains(w: Column, content: Column) -> Column:
        spots = F.filter(F.transform(w, lambda x, i: F.when(is_anchor(x), i)), lambda i: i.isNotNull())

        def chain(i: Column, j: Column) -> Column:  # j anchors and i - j content words stand before place i
            return F.when(i - j + CHAIN <= F.size(content), F.xxhash64(F.get(w, i), *[F.get(content, i - j + k) for k in range(CHAIN)]))

        return F.array_sort(F.array_compact(F.array_distinct(F.transform(spots, chain))))

    found = _let(words(text), lambda w: _let(F.filter(w, lambda x: ~is_anchor(x)), lambda content: chains(w, content)))
    whole = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.lower(text))))
    return _let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(whole))


def as_text(sigs: Column) -> Column:
    """A fingerprint as a string: 16 hexadecimal digits for each signature, in their order."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard index of two sets; 0 where the lengths alone show that it is below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    index = _let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(large == 0, 1.0).when((small == 0) | (small < large * least), 0.0).otherwise(index)


def length_class(size: Column, least: float) -> Column:
    """Sets whose classes differ by more than 1 have a likeness below ``least``."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / -math.log(least) + 1e-9).cast("int")


def signed(docs: DataFrame, common: list[str], text: str = "text") -> DataFrame:
    """docs with ``signatures``."""
    kept = set_aside(docs, "signatures") if text.lower() != "signatures" else docs
    return kept.withColumn("signatures", signatures(text_or_empty(text), common))


def search(queries: DataFrame, docs: DataFrame, least: float = 0.8) -> DataFrame:
    """queries and docs(id, signatures) -> query_id, doc_id, likeness of all pairs with likeness >= least (0 < least < 1) and
    non-empty sets. A document meets a query through one of the first signatures of both, in their order: sets of which neither's
    first size - least * size + 1 are shared can't be that near."""

    def listed(df: DataFrame, name: str) -> DataFrame:
        size = F.size("signatures")
        first = F.slice("signatures", 1, (size - F.ceil(size * least - 1e-9) + 1).cast("int"))
        return df.where(size > 0).select(F.col("id").alias(name), length_class(size, least).alias("class"), F.explode(first).alias("signature"))

    near = listed(queries, "query_id").withColumn("class", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])))
    met = near.join(listed(docs, "doc_id"), ["class", "signature"]).select("query_id", "doc_id").distinct()
    both = met.join(queries.select(F.col("id").alias("query_id"), F.col("signatures").alias("a")), "query_id")
    both = both.join(docs.select(F.col("id").alias("doc_id"), F.col("signatures").alias("b")), "doc_id")
    return both.select("query_id", "doc_id", likeness(F.col("a"), F.col("b"), least).alias("likeness")).where(F.col("likeness") >= least)


def _listed(values: list[int]) -> Column:
    """A constant array, folded to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def with_next(docs: DataFrame, carried: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """docs(doc_id, text) with ``next``: the columns of the document after it by descending id; the first follows the last.
    carried adds columns after the shuffle, which both sides get."""
    spark = docs.sparkSession
    n = docs.select("doc_id").count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MOST_BUCKETS, max(math.ceil(n / PER_BUCKET), min(4 * partitions, math.ceil(n / 256))), max(n, 1))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)] or [0.5], max(1000, 20 * wanted)).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    halves = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)] if cuts else [1]
    held = _listed(cuts)
    place = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda i, s: F.when(F.get(held, i + s - 1) <= F.col("doc_id"), i + s).otherwise(i))
    placed = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place))
    heads = {r["_bucket"]: r["head"] for r in placed.select("_bucket", "doc_id").groupBy("_bucket").agg(F.max("doc_id").alias("head")).collect()}  # MOST_BUCKETS rows
    down = sorted(heads, reverse=True)
    before = {b: down[i - 1] for i, b in enumerate(down)}
    size = len(cuts) + 2  # buckets from -1 on
    head, target = _listed([heads.get(b) or 0 for b in range(-1, size - 1)]), _listed([before.get(b, 0) for b in range(-1, size - 1)])
    at = F.col("_bucket") + 1
    leads = F.when(F.col("_bucket") == -1, True).otherwise(F.get(head, at) == F.col("doc_id"))
    own = F.struct(F.col("_bucket").cast("long").alias("b"), F.lit(False).alias("copy"))
    copy = F.struct(F.get(target, at).alias("b"), F.lit(True).alias("copy"))
    sent = placed.withColumn("_to", F.explode(F.when(leads, F.array(own, copy)).otherwise(F.array(own)))).withColumns({"_bucket": F.col("_to.b"), "_copy": F.col("_to.copy")}).drop("_to")
    met = carried(sent.repartition(max(partitions, min(wanted, 4 * partitions)), "_bucket"))
    w = Window.partitionBy("_bucket").orderBy("_copy", F.desc_nulls_last("doc_id"), F.desc("text"))
    names = [c for c in met.columns if c not in ("_bucket", "_copy")]
    return met.withColumn("next", F.lead(F.struct(*names)).over(w)).where("NOT _copy").select(*names, "next")


def edited(text: Column, other: Column) -> Column:
    """text with its last third of code points replaced by the first as many (or all) of other."""
    return _let(F.floor(F.length(text) / 3).cast("int"), lambda m: F.concat(F.substring(text, F.lit(1), F.length(text) - m), F.substring(other, F.lit(1), m)))


def compared(docs: DataFrame, common: list[str]) -> DataFrame:
    """docs(doc_id, text) -> per row its fingerprint, that of its edited text, and the likeness to both of the others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    both = with_next(rows, lambda df: df.withColumn("sigs", signatures(F.col("text"), common)))
    made = both.select("doc_id", "sigs", F.col("next.sigs").alias("next_sigs"), F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next.text")).alias("edited"))
    told = made.withColumn("edited_sigs", signatures(F.col("edited"), common))
    return told.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), F.size("sigs").alias("n_signatures"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compared(docs, anchors(docs))
