"""URL filter: explicit host/path rules first, gradient-boosted trees on lexical features for the rest.

Features of a url: lengths of url, host, path and query; host labels; path depth; digit, hyphen and upper-case ratios;
longest host label; character entropy of the host; query parameters; and suffix statistics (share of all urls under the
host's last label and their rate of positive labels, with a prior). The trees are Spark's GBTClassifier.

Labels: ``labelled(url, label)`` if given. The given tables have none, and nothing in ``pages`` besides the url tells such
pages apart, so the registered query labels urls weakly, by spam terms in the host (``SEED_TERMS``). The terms themselves
are no features: the trees must find the shape of such hosts, and generalise no further than that.

The trees are fitted on distinct urls, at most about ``max_train`` / 2 of either label, drawn by hash, each with the weight
of what it stands for; a url that makes up a third of all rows is one of them. Suffix statistics cover all rows. Distinct
urls, their counts and features are written once.

All on DataFrame expressions and Spark ML's JVM stages.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged on its features
(null as empty text); repeated urls get equal verdicts; ties between rules of one length take the first in text order;
without labels of both kinds every url that no rule decides is allowed; a url labelled twice is positive if any label says
so; an empty table gives an empty result; other columns are kept, those named like a result as ``<name>_in``; helper columns
start with ``_uf_``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, materialise, set_aside, table

# Terms in host names that mark a url as spam for training.
SEED_TERMS = ["casino", "bets", "pills", "adult", "ads-track", "spam", "porn", "viagra", "poker", "lottery"]
MAX_TRAIN = 20_000
_SCALE = 1_000_000_000
NUMERIC = [
    "n_url", "n_host", "n_path", "n_query", "labels", "depth", "digit_ratio", "hyphen_ratio", "upper_ratio",
    "longest_label", "host_hyphens", "host_entropy", "params", "suffix_share", "suffix_rate",
]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; empty for null and for a url without ``://``."""
    u = F.coalesce(url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(u, shape, 1), upper, small), F.regexp_extract(u, shape, 2)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text))[::-1]:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _ratio(c: Column, kind: str) -> Column:
    return F.regexp_count(c, F.lit(kind)) / F.greatest(F.length(c), F.lit(1))


def _entropy(c: Column) -> Column:
    """Bits per character, over the characters of host names."""
    n = F.greatest(F.length(c), F.lit(1))
    out = F.lit(0.0)
    for ch in "abcdefghijklmnopqrstuvwxyz0123456789-.":
        p = (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))) / n
        out = out - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return out


def features(urls: DataFrame) -> DataFrame:
    """urls(url, host, path, ...) with the lexical features and the suffix, each as ``_uf_<name>``."""
    u = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    made = {
        "n_url": F.length(u), "n_host": F.length("host"), "n_path": F.length("path"), "n_query": F.length(query),
        "labels": F.size(labels), "depth": F.regexp_count("path", F.lit("/")), "digit_ratio": _ratio(u, "[0-9]"),
        "hyphen_ratio": _ratio(u, "-"), "upper_ratio": _ratio(u, "[A-Z]"),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))),
        "host_hyphens": F.regexp_count("host", F.lit("-")), "host_entropy": _entropy(F.col("host")),
        "params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1), "suffix": F.substring_index("host", ".", -1),
    }
    return urls.withColumns({f"_uf_{k}": v for k, v in made.items()})


def seeded(host: Column, seeds: list[str]) -> Column:
    """1.0 where the host holds one of the terms, else 0.0."""
    return reduce(lambda a, b: a | b, [host.contains(s) for s in seeds], F.lit(False)).cast("double")


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """rows(_uf_suffix, _uf_n, _uf_label) -> _uf_suffix, _uf_suffix_share, _uf_suffix_rate over all urls, written out."""
    bad = F.sum(F.coalesce("_uf_label", F.lit(0.0)) * F.col("_uf_n"))
    stats = rows.groupBy("_uf_suffix").agg(F.sum("_uf_n").alias("n"), bad.alias("bad"))
    whole = stats.agg(F.sum("n").alias("all"), F.sum("bad").alias("all_bad"))
    prior = F.col("all_bad") / F.col("all")
    return stats.crossJoin(F.broadcast(whole)).select(  # one row
        "_uf_suffix", (F.col("n") / F.col("all")).alias("_uf_suffix_share"), ((F.col("bad") + 20 * prior) / (F.col("n") + 20)).alias("_uf_suffix_rate")
    )


def fit(rows: DataFrame, max_train: int = MAX_TRAIN, trees: int = 12, depth: int = 4, seed: int = 5):
    """Trees from rows(url, _uf_label, features), distinct urls with a label; None where one label is missing."""
    sizes = {r["_uf_label"]: r["n"] for r in rows.groupBy("_uf_label").agg(F.count("*").alias("n")).collect()}  # two rows
    if set(sizes) != {0.0, 1.0}:
        return None
    share, weight = F.lit(0), F.lit(0.0)
    for label, n in sizes.items():
        own = max(1, int(min(1.0, max_train / 2 / n) * _SCALE))
        share = F.when(F.col("_uf_label") == label, own).otherwise(share)
        weight = F.when(F.col("_uf_label") == label, _SCALE / own).otherwise(weight)
    drawn = rows.where(F.pmod(F.xxhash64("url"), F.lit(_SCALE)) < share).withColumn("_uf_weight", weight)
    made = VectorAssembler(inputCols=[f"_uf_{c}" for c in NUMERIC], outputCol="_uf_features").transform(drawn)
    made = materialise(made.select("_uf_label", "_uf_weight", "_uf_features"), "url-sample")
    if made.select("_uf_label").distinct().count() < 2:
        return None
    model = GBTClassifier(
        labelCol="_uf_label", featuresCol="_uf_features", weightCol="_uf_weight", predictionCol="_uf_prediction",
        maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed,
    ).setRawPredictionCol("_uf_raw").setProbabilityCol("_uf_probability")
    made = made.coalesce(4).cache()
    try:
        return model.fit(made)
    finally:
        made.unpersist()


def filter_urls(
    urls: DataFrame, rules: list[Rule] | None = None, seeds: list[str] | None = None, labelled: DataFrame | None = None, max_train: int = MAX_TRAIN
) -> DataFrame:
    """urls(url, ...) with host, path, rule, verdict and spam_score. labelled(url, label 0 or 1) takes the place of seeds."""
    kept = set_aside(urls, "host", "path", "rule", "verdict", "spam_score")
    host, path = parts(F.col("url"))
    each = urls.groupBy("url").agg(F.count("*").alias("_uf_n"))
    if labelled is None:
        each = each.withColumn("_uf_label", seeded(host, SEED_TERMS if seeds is None else seeds))
    else:
        own = labelled.where(F.col("label").isNotNull()).groupBy("url").agg(F.max("label").cast("double").alias("_uf_label"))
        each = each.join(own, "url", "left")
    each = materialise(features(each.withColumns({"host": host, "path": path})), "urls")
    stats = suffix_statistics(each)
    model = fit(join_checked(each.where(F.col("_uf_label").isNotNull()), stats, ["_uf_suffix"], "inner", "suffixes"), max_train)
    text, verdict = longest_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = join_checked(features(kept.withColumns({"host": host, "path": path})), stats, ["_uf_suffix"], "inner", "suffixes")
    if model is None:
        scored = rows.withColumn("spam_score", F.lit(0.0))
    else:
        scored = model.transform(VectorAssembler(inputCols=[f"_uf_{c}" for c in NUMERIC], outputCol="_uf_features").transform(rows))
        scored = scored.withColumn("spam_score", F.get(vector_to_array("_uf_probability"), F.lit(1)))
    learned = F.when(F.col("spam_score") >= 0.5, "block").otherwise("allow")
    return scored.select(*kept.columns, "host", "path", text.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "spam_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
