"""Wallets, ledgers, usage, orders and transfer metrics: aggregates, reconciliation, replay, retention.

Money is whole numbers. Every time limit is a parameter; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import carried


def total(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def overview(orders: DataFrame, devices: DataFrame, ledger: DataFrame, usage: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row of KPIs over the last ``days`` (1 to 90) before as_of. Each source is aggregated once; only single rows meet."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {min(90, max(1, days))} DAYS")
    new = F.col("created_at") >= since
    o = orders.agg(
        total(F.when((F.col("status") == "paid") & new, F.col("amount_vnd"))).alias("revenue_vnd"),
        *[F.count_if((F.col("status") == s) & new).alias(f"orders_{s}") for s in ("paid", "pending", "expired")],
    )
    d = devices.agg(
        F.count("*").alias("devices"), F.count_if(F.col("first_seen_at") >= since).alias("devices_new"),
        F.count_if(F.col("last_seen_at") >= since).alias("devices_active"), total("balance").alias("outstanding"),
    )
    flow = ledger.where(new).agg(*signed_split())
    u = usage.where(new).agg(F.count("*").alias("requests"), total("input_size").alias("sentences"))
    return o.crossJoin(d).crossJoin(flow).crossJoin(u)  # one row each


def signed_split(c: str = "delta") -> list[Column]:
    return [
        total(F.when(F.col(c) > 0, F.col(c))).alias("issued"),
        total(F.when(F.col(c) < 0, -F.col(c))).alias("consumed"),
    ]


def usage_daily(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("created_at").alias("day"), "action").agg(
        F.count("*").alias("requests"), total("input_size").alias("sentences"), total("credit_charged").alias("credit")
    )


def host_health(transfers: DataFrame, newest: int = 50, unknown: float = 80.0) -> DataFrame:
    """Success percentage of the newest transfers of a host, less ten for each rate-limited one, within 0 to 100."""
    w = Window.partitionBy("platform", "host").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = transfers.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= newest)
    limited = F.count_if(F.coalesce(F.col("error_type"), F.lit("")).contains("rate_limit"))
    rate = F.sum("success") * 100.0 / F.count("*") - limited * 10
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), rate))
    return last.groupBy("platform", "host").agg(F.count("*").alias("n"), F.coalesce(clamped, F.lit(unknown)).alias("health"))


def with_speed(transfers: DataFrame) -> DataFrame:
    return transfers.withColumn("speed", F.when(F.col("duration") > 0, F.col("bytes") / F.col("duration")).otherwise(0.0))


def fastest_hosts(transfers: DataFrame, k: int = 3, least_rate: float = 0.7) -> DataFrame:
    per = with_speed(transfers).groupBy("platform", "host").agg(
        F.avg("speed").alias("avg_speed"), (F.sum("success") / F.count("*")).alias("success_rate")
    )
    w = Window.partitionBy("platform").orderBy(F.col("avg_speed").desc(), "host")
    good = per.where(F.col("success_rate") >= least_rate).withColumn("place", F.row_number().over(w))
    return good.where(F.col("place") <= k)


def reconcile(devices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Devices whose balance is not the sum of their ledger rows, with the difference; a device without a balance is one."""
    sums = ledger.groupBy("fingerprint").agg(total("delta").alias("ledger_sum"))
    both = devices.join(sums, "fingerprint", "left").withColumn("ledger_sum", F.coalesce("ledger_sum", F.lit(0)))
    return both.where(~F.col("balance").eqNullSafe(F.col("ledger_sum"))).select(
        "fingerprint", "balance", "ledger_sum", (F.col("balance") - F.col("ledger_sum")).alias("diff")
    )


def reconcile_checked(devices: DataFrame, ledger: DataFrame, newer_devices: DataFrame, newer_ledger: DataFrame, folder: str, run: str) -> tuple[DataFrame, DataFrame]:
    """Wallets that differ in a snapshot and again, by any amount, in a newer one, which only the suspects are looked up in; and
    an audit row (run, checked, suspects, confirmed, total_diff, unknown). Both are written below the run's own folders, so a run
    that is done again replaces them; wallets without a balance are counted as unknown."""
    spark, top = devices.sparkSession, folder.rstrip("/")
    kind = reconcile(devices, ledger)
    kind.write.mode("overwrite").parquet(f"{top}/suspects/run={run}")
    suspects = spark.read.schema(kind.schema).parquet(f"{top}/suspects/run={run}").select("fingerprint")
    again = reconcile(newer_devices.join(suspects, "fingerprint", "left_semi"), newer_ledger.join(suspects, "fingerprint", "left_semi"))
    again.write.mode("overwrite").parquet(f"{top}/confirmed/run={run}")
    confirmed = spark.read.schema(again.schema).parquet(f"{top}/confirmed/run={run}")
    count = F.count(F.lit(1))
    sums = confirmed.agg(count.alias("confirmed"), F.coalesce(F.sum(F.abs("diff")), F.lit(0)).alias("total_diff"), F.count_if(F.col("diff").isNull()).alias("unknown"))
    row = devices.agg(count.alias("checked")).crossJoin(suspects.agg(count.alias("suspects"))).crossJoin(sums)  # one row each
    audit = row.select(F.lit(run).alias("run"), "checked", "suspects", "confirmed", "total_diff", "unknown")
    audit.write.mode("overwrite").parquet(f"{top}/audit/run={run}")
    return confirmed, spark.read.schema(audit.schema).parquet(f"{top}/audit/run={run}")


def newest_per_key(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)


def device_detail(devices: DataFrame, ledger: DataFrame, usage: DataFrame, n: int = 50) -> DataFrame:
    """Each device with its newest n ledger and usage rows, newest first."""
    newest = [F.col("created_at").desc(), F.col("event_id").desc()]

    def collected(rows: DataFrame, out: str) -> DataFrame:
        last = newest_per_key(rows, ["fingerprint"], newest, n)
        return last.groupBy("fingerprint").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "event_id"))), lambda x: x["event_id"]).alias(out))

    return devices.join(collected(ledger, "ledger_ids"), "fingerprint", "left").join(collected(usage, "usage_ids"), "fingerprint", "left")


def search(rows: DataFrame, text: str | None, columns: list[str], equal: dict[str, str], order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a listing: case-insensitive containment in any column, equality filters, total order."""
    found = rows
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower()))
        found = found.where(hit)
    for c, v in equal.items():
        found = found.where(F.col(c) == v)
    return found.orderBy(*order).offset(page * size).limit(size)


def replay_ledger(requests: DataFrame) -> DataFrame:
    """requests(fingerprint, event_id, idempotency_key, delta) in event order: the first of a key counts, a charge above
    the balance is denied, and denials feed back into the balance. One row per counted request."""
    first = Window.partitionBy("fingerprint", "idempotency_key").orderBy("event_id")
    kept = requests.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1)

    def step(balance: int, x: tuple, _) -> tuple[int, tuple]:
        event, delta = x
        after = balance + (delta or 0)
        held = after if after >= 0 else balance
        return held, (held, event, None if delta is None else after >= 0)

    return carried(kept, ["fingerprint"], ["event_id"], ["event_id", "delta"], "balance long, event_id long, accepted boolean", lambda: 0, step)


def ip_recent(devices: DataFrame, seconds: int = 86_400, cap: int = 3) -> DataFrame:
    """Other devices first seen from the same address in the seconds before; a trial is allowed below the cap."""
    w = Window.partitionBy("ip").orderBy(F.unix_timestamp("first_seen_at")).rangeBetween(-seconds, 0)
    n = F.count("*").over(w) - 1
    return devices.withColumns({"recent": n, "trial": n < cap})


def evict(files: DataFrame, now: int, max_age: int, budget: int, key: list[str], slice_s: int = 86_400) -> DataFrame:
    """Files with the reason to remove them: too old, else beyond the budget counted from the newest. The running size is that
    of all newer slices of time (one row per key and slice) plus that inside the file's own slice, so a key that holds most
    rows is spread over its slices."""
    marked = files.withColumns({"old": F.lit(now) - F.col("mtime") > max_age, "slice": F.floor(F.col("mtime") / slice_s)})
    young = marked.where("NOT old")
    sums = young.groupBy(*key, "slice").agg(F.sum("size_bytes").alias("in_slice"))
    newer = Window.partitionBy(*key).orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*key, "slice", F.coalesce(F.sum("in_slice").over(newer), F.lit(0)).alias("newer"))
    own = Window.partitionBy(*key, "slice").orderBy(F.col("mtime").desc(), F.col("doc_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    beyond = young.join(before, [*key, "slice"]).where(F.col("newer").isNotNull()).withColumn("upto", F.col("newer") + F.sum("size_bytes").over(own))
    over = beyond.where(F.col("upto") > budget).select(*files.columns, F.lit("budget").alias("reason"))
    return marked.where("old").select(*files.columns, F.lit("age").alias("reason")).unionByName(over)


def retry_plan(attempts: DataFrame, base: float = 1.0, cap: float = 30.0, most: int = 5) -> DataFrame:
    """attempts(job, at, error, status_code) -> attempt number, kind, whether to retry and after how long."""
    n = F.row_number().over(Window.partitionBy("job").orderBy("at")) - 1
    numbered = attempts.withColumns({"n": n, "kind": error_kind(F.col("error"), F.col("status_code"))})
    delay = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.col("n")))
    delay = F.when(F.col("kind") == "rate_limited", F.greatest(delay, 2.0 * (F.col("n") + 1))).otherwise(delay)
    final = F.col("kind").isin("not_found", "cancelled", "invalid_media", "missing_audio")
    retry = ~final & (F.col("n") + 1 < most) & ((F.col("kind") != "auth") | (F.col("n") < 2))
    return numbered.withColumns({"retry": retry, "delay_s": F.when(retry, delay)})


# Ordered substring rules of error texts.
ERROR_RULES = [
    ("cancelled", ["cancel"]),
    ("auth", ["403", "forbidden", "cookie", "unauthorized"]),
    ("range", ["416", "range not satisfiable"]),
    ("rate_limited", ["429", "too many requests", "rate limit"]),
    ("not_found", ["404", "not found"]),
    ("timeout", ["timeout", "timed out"]),
    ("reset", ["connection reset", "connection_reset", "remotedisconnected", "broken pipe"]),
    ("missing_audio", ["missing audio", "audio stream required"]),
    ("invalid_media", ["corrupt", "invalid media", "truncated", "moov atom"]),
    ("network", ["connectionerror", "failed to establish", "network is unreachable"]),
]


def error_kind(error: Column, status: Column) -> Column:
    """The status code decides first, then the first rule with a substring in the error text."""
    e = F.lower(error)
    kind = F.when(status == 403, "auth").when(status == 416, "range").when(status == 429, "rate_limited").when(status == 404, "not_found")
    kind = kind.when(status.between(500, 599), "network").when(error.isNull(), "unknown")
    for name, parts in ERROR_RULES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | e.contains(p)
        kind = kind.when(hit, name)
    return kind.otherwise("unknown")


def project_status(facts: DataFrame) -> DataFrame:
    """Status by priority of boolean facts."""
    s = F.when(F.col("has_output"), "completed").when(F.col("has_pending"), "pending").when(F.col("is_running"), "processing")
    s = s.when(F.col("has_error"), "failed").when(F.col("is_locked"), "locked").when(F.col("n_segments") > 0, "processing")
    return facts.withColumn("status", s.otherwise("queued"))


def rank_candidates(probes: DataFrame) -> DataFrame:
    """probes(job, host, latency_ms, status_code, ranges, error) -> score and place, best first."""
    answered = F.when(F.col("status_code").isin(200, 206), 10000.0 / F.greatest(F.lit(1.0), F.col("latency_ms")) + F.when(F.col("ranges"), 50.0).otherwise(0.0))
    score = F.when(F.col("status_code").isNull(), 0.0).when(F.col("error"), -500.0).otherwise(F.coalesce(answered, F.lit(-100.0)))
    scored = probes.withColumn("score", score)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("job").orderBy(F.col("score").desc(), "host")))


def estimate_cost(jobs: DataFrame, base: int, auto: int, metadata: int) -> DataFrame:
    """jobs(n, auto_translate, with_metadata) -> cost in whole units."""
    per = F.lit(base) + F.when(F.col("auto_translate"), auto).otherwise(0)
    return jobs.withColumn("cost", F.greatest(F.lit(0), F.col("n")) * per + F.when(F.col("with_metadata"), metadata).otherwise(0))


def purchase_units(orders: DataFrame, amount: str, rate: int, least: int, most: int) -> DataFrame:
    """Custom purchase: the amount is floored to thousands, rejected outside least..most, times the rate."""
    floored = F.floor(F.col(amount) / 1000).cast("long") * 1000
    ok = floored.between(least, most)
    return orders.withColumns({"paid": floored, "accepted": ok, "units": F.when(ok, F.floor(floored / 1000).cast("long") * rate)})


def progress_eta(ticks: DataFrame, weights: dict[str, int], samples: int = 3) -> DataFrame:
    """ticks(job, tick, step, current, total, elapsed) -> percent over weighted steps and time left in the step."""
    names = list(weights)
    before = F.lit(0)
    weight = F.lit(0)
    upto = 0
    for s in names:
        before, weight = F.when(F.col("step") == s, upto).otherwise(before), F.when(F.col("step") == s, weights[s]).otherwise(weight)
        upto += weights[s]
    share = F.when(F.col("total") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("current") / F.col("total")))).otherwise(0.0)
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(before + weight * share).cast("int")))
    no = (F.col("current") < samples) | (F.col("total") <= F.col("current")) | (F.col("elapsed") <= 0)
    eta = F.when(no, 0.0).otherwise(F.col("elapsed") / F.col("current") * (F.col("total") - F.col("current")))
    return ticks.withColumns({"percent": percent, "eta_s": eta})
