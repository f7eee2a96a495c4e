"""Queries over wallets, ledgers, usage, orders, files and transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as A
from .registry import query

AS_OF = "2024-01-31"


@query("d1_overview", "paid_orders devices ledger usage", f"""
, o AS (SELECT CAST(coalesce(sum(amount_vnd) FILTER (status = 'paid'), 0) AS BIGINT) AS revenue_vnd,
     count(*) FILTER (status = 'paid') AS orders_paid, count(*) FILTER (status = 'pending') AS orders_pending,
     count(*) FILTER (status = 'expired') AS orders_expired FROM paid_orders WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS),
d AS (SELECT count(*) AS devices, count(*) FILTER (first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS) AS devices_new,
     count(*) FILTER (last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS) AS devices_active, CAST(sum(balance) AS BIGINT) AS outstanding FROM devices),
l AS (SELECT CAST(sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS BIGINT) AS issued, CAST(sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS BIGINT) AS consumed
     FROM ledger WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS),
u AS (SELECT count(*) AS requests, CAST(sum(input_size) AS BIGINT) AS sentences FROM usage WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS)
SELECT * FROM o, d, l, u""")  # fmt: skip
def _(t):
    return A.overview(t.paid_orders, t.devices, t.ledger, t.usage, AS_OF, 30)


@query("d2_ledger_flow", "ledger", """
SELECT fingerprint, CAST(sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS BIGINT) AS issued,
  CAST(sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS BIGINT) AS consumed FROM ledger GROUP BY fingerprint""")  # fmt: skip
def _(t):
    return t.ledger.groupBy("fingerprint").agg(*A.signed_split())


@query("d3_usage_daily", "usage", """
SELECT strftime(created_at, '%Y-%m-%d') AS day, action, count(*) AS requests, CAST(sum(input_size) AS BIGINT) AS sentences,
  CAST(sum(credit_charged) AS BIGINT) AS credit FROM usage GROUP BY 1, 2""")  # fmt: skip
def _(t):
    return A.usage_daily(t.usage).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("d4_by_status", "usage paid_orders", """
SELECT 'usage' AS source, status, count(*) AS n, CAST(sum(credit_charged) AS BIGINT) AS amount FROM usage GROUP BY status
UNION ALL SELECT 'orders', status, count(*), CAST(sum(amount_vnd) AS BIGINT) FROM paid_orders GROUP BY status""")  # fmt: skip
def _(t):
    def one(df, source, amount):
        return df.groupBy("status").agg(F.count("*").alias("n"), A.total(amount).alias("amount")).select(F.lit(source).alias("source"), "status", "n", "amount")

    return one(t.usage, "usage", "credit_charged").unionByName(one(t.paid_orders, "orders", "amount_vnd"))


@query("d5_host_health", "transfers", """
, r AS (SELECT *, row_number() OVER (PARTITION BY platform, host ORDER BY ts DESC, event_id DESC) AS rn FROM transfers)
SELECT platform, host, count(*) AS n, greatest(0.0, least(100.0, sum(success) * 100.0::DOUBLE / count(*)
   - 10 * count(*) FILTER (contains(error_type, 'rate_limit'))))::DOUBLE AS health FROM r WHERE rn <= 50 GROUP BY platform, host""")  # fmt: skip
def _(t):
    return A.host_health(t.transfers)


@query("d6_fastest_hosts", "transfers", """
, p AS (SELECT platform, host, avg(CASE WHEN duration > 0 THEN bytes / duration ELSE 0 END) AS s, sum(success) / count(*) AS r FROM transfers GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY s DESC, host) AS place FROM p WHERE r >= 0.7)
SELECT platform, host, CAST(floor(s / 1000) AS BIGINT) AS kb_s, place FROM q WHERE place <= 3""")  # fmt: skip
def _(t):
    return A.fastest_hosts(t.transfers).select("platform", "host", F.floor(F.col("avg_speed") / 1000).alias("kb_s"), F.col("place").cast("long").alias("place"))


@query("d13_summary", "paid_orders", """
SELECT custkey, count(*) AS total, count(*) FILTER (status = 'paid') AS completed, count(*) FILTER (status = 'expired') AS failed,
  CAST(sum(amount_vnd) AS BIGINT) AS amount, CAST(count(*) FILTER (status = 'paid') * 100 // nullif(count(*) FILTER (status <> 'pending'), 0) AS BIGINT) AS success_pct
FROM paid_orders GROUP BY custkey""")  # fmt: skip
def _(t):
    done, bad = F.count_if(F.col("status") == "paid"), F.count_if(F.col("status") == "expired")
    return t.paid_orders.groupBy("custkey").agg(
        F.count("*").alias("total"), done.alias("completed"), bad.alias("failed"), A.total("amount_vnd").alias("amount"),
        F.floor(F.try_divide(done * 100, done + bad)).alias("success_pct"),
    )


@query("d14_usage_rollup", "files", """
SELECT project, doc_id % 7 AS category, count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files GROUP BY ROLLUP (project, doc_id % 7)""")  # fmt: skip
def _(t):
    rows = t.files.withColumn("category", F.pmod("doc_id", F.lit(7)))
    return rows.rollup("project", "category").agg(F.count("*").alias("entries"), A.total("size_bytes").alias("bytes"))


@query("d18_duplicates", "", """
SELECT md5(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")  # fmt: skip
def _(t):
    groups = t.documents.groupBy(F.md5(F.encode("text", "UTF-8")).alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return groups.where("copies > 1")


@query("d18_batch_summary", "paid_orders", """
SELECT custkey, count(*) AS total, count(*) FILTER (status = 'paid') AS success, count(*) FILTER (status = 'expired') AS failed,
  count(*) FILTER (status = 'pending') AS skipped FROM paid_orders GROUP BY custkey""")  # fmt: skip
def _(t):
    s = F.col("status")
    return t.paid_orders.groupBy("custkey").agg(
        F.count("*").alias("total"), F.count_if(s == "paid").alias("success"), F.count_if(s == "expired").alias("failed"), F.count_if(s == "pending").alias("skipped")
    )


@query("d20_hold_margin", "usage", """
, h AS (SELECT fingerprint, CAST(sum(credit_charged) AS BIGINT) AS used, CAST(max(credit_charged) AS BIGINT) * 20 AS estimated FROM usage GROUP BY fingerprint),
a AS (SELECT fingerprint, action, CAST(sum(credit_charged) AS BIGINT) AS by_action FROM usage GROUP BY ALL)
SELECT fingerprint, action, estimated, used, greatest(0, estimated - used) AS remaining, by_action FROM h JOIN a USING (fingerprint)""")  # fmt: skip
def _(t):
    by = t.usage.groupBy("fingerprint", "action").agg(A.total("credit_charged").alias("by_action"), F.max("credit_charged").alias("top"))
    held = by.groupBy("fingerprint").agg(A.total("by_action").alias("used"), (F.max("top") * 20).alias("estimated"))
    return by.join(held, "fingerprint").select("fingerprint", "action", "estimated", "used", F.greatest(F.lit(0), F.col("estimated") - F.col("used")).alias("remaining"), "by_action")


@query("c14_reconcile", "ledger devices", """
, s AS (SELECT fingerprint, CAST(sum(delta) AS BIGINT) AS ledger_sum FROM ledger GROUP BY fingerprint)
SELECT fingerprint, balance, coalesce(ledger_sum, 0) AS ledger_sum, balance - coalesce(ledger_sum, 0) AS diff
FROM devices LEFT JOIN s USING (fingerprint) WHERE balance <> coalesce(ledger_sum, 0)""")  # fmt: skip
def _(t):
    return A.reconcile(t.devices, t.ledger)


@query("c15_device_detail", "ledger devices usage", """
, l AS (SELECT fingerprint, string_agg(event_id::VARCHAR, ',' ORDER BY created_at DESC, event_id DESC) AS ledger_ids FROM
   (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY created_at DESC, event_id DESC) AS rn FROM ledger) WHERE rn <= 50 GROUP BY fingerprint),
u AS (SELECT fingerprint, string_agg(event_id::VARCHAR, ',' ORDER BY created_at DESC, event_id DESC) AS usage_ids FROM
   (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY created_at DESC, event_id DESC) AS rn FROM usage) WHERE rn <= 50 GROUP BY fingerprint)
SELECT fingerprint, balance, ledger_ids, usage_ids FROM devices LEFT JOIN l USING (fingerprint) LEFT JOIN u USING (fingerprint)""")  # fmt: skip
def _(t):
    told = A.device_detail(t.devices, t.ledger, t.usage)
    return told.select("fingerprint", "balance", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ledger_ids", "usage_ids")])


@query("b12_search", "paid_orders", """
SELECT order_code, status, amount_vnd FROM paid_orders WHERE contains(lower(order_code::VARCHAR), '12') AND status = 'paid'
ORDER BY amount_vnd DESC, order_code LIMIT 20 OFFSET 20""")  # fmt: skip
def _(t):
    return A.search(t.paid_orders, "12", ["order_code"], {"status": "paid"}, [F.col("amount_vnd").desc(), F.col("order_code")], 1, 20).select("order_code", "status", "amount_vnd")


@query("b13_project_status", "", """
SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 'completed' WHEN n_chars % 7 = 0 THEN 'pending' WHEN n_chars % 11 = 0 THEN 'processing'
  WHEN n_chars % 3 = 0 THEN 'failed' WHEN n_chars % 13 = 0 THEN 'locked' WHEN n_chars % 2 > 0 THEN 'processing' ELSE 'queued' END AS status FROM documents""")  # fmt: skip
def _(t):
    n = F.col("n_chars")
    facts = t.documents.select(
        "doc_id", (n % 5 == 0).alias("has_output"), (n % 7 == 0).alias("has_pending"), (n % 11 == 0).alias("is_running"),
        (n % 3 == 0).alias("has_error"), (n % 13 == 0).alias("is_locked"), (n % 2).alias("n_segments"),
    )
    return A.project_status(facts).select("doc_id", "status")


@query("g3_dedup_first", "ledger", """
SELECT fingerprint, idempotency_key, event_id, delta FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY event_id) AS rn FROM ledger) WHERE rn = 1""")  # fmt: skip
def _(t):
    return A.newest_per_key(t.ledger, ["idempotency_key"], [F.col("event_id")], 1).select("fingerprint", "idempotency_key", "event_id", "delta")


@query("e25_replay_ledger", "ledger", """
, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint, idempotency_key ORDER BY event_id) AS d FROM ledger) WHERE d = 1),
n AS (SELECT fingerprint, event_id, delta, row_number() OVER (PARTITION BY fingerprint ORDER BY event_id) AS rn FROM k),
r AS (WITH RECURSIVE f(fingerprint, event_id, rn, balance, accepted) AS (
  SELECT fingerprint, event_id, rn, CASE WHEN delta >= 0 THEN delta ELSE 0 END, delta >= 0 FROM n WHERE rn = 1
  UNION ALL SELECT n.fingerprint, n.event_id, n.rn, CASE WHEN f.balance + n.delta >= 0 THEN f.balance + n.delta ELSE f.balance END, f.balance + n.delta >= 0
  FROM f JOIN n ON n.fingerprint = f.fingerprint AND n.rn = f.rn + 1) SELECT * FROM f)
SELECT fingerprint, event_id, balance, accepted FROM r""")  # fmt: skip
def _(t):
    return A.replay_ledger(t.ledger)


@query("e26_ip_recent", "devices", """
, d AS (SELECT fingerprint, first_seen_at, CAST(fingerprint AS BIGINT) % 11 AS ip, epoch(date_trunc('second', first_seen_at)) AS e FROM devices)
SELECT fingerprint, count(*) OVER w - 1 AS recent, count(*) OVER w - 1 < 3 AS trial FROM d
WINDOW w AS (PARTITION BY ip ORDER BY e RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def _(t):
    return A.ip_recent(t.devices.withColumn("ip", F.col("fingerprint").cast("long") % 11)).select("fingerprint", "recent", "trial")


@query("e22_evict", "files", """
, m AS (SELECT *, 3600000 - mtime > 2000000 AS old FROM files),
u AS (SELECT *, sum(size_bytes) OVER (PARTITION BY project, old ORDER BY mtime DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM m)
SELECT doc_id, project, size_bytes, mtime, CASE WHEN old THEN 'age' ELSE 'budget' END AS reason FROM u WHERE old OR upto > 20000""")  # fmt: skip
def _(t):
    return A.evict(t.files, 3_600_000, 2_000_000, 20_000, ["project"])


@query("e23_keep_last", "files", """
SELECT doc_id, project FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY mtime DESC, doc_id DESC) AS rn FROM files) WHERE rn <= 3""")  # fmt: skip
def _(t):
    return A.newest_per_key(t.files, ["project"], [F.col("mtime").desc(), F.col("doc_id").desc()], 3).select("doc_id", "project")


@query("e28_retry_plan", "", """
, a AS (SELECT event_id, user_id AS job, ts AS tt, event_id % 7 AS m FROM events WHERE event_type = 'error'),
k AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY tt, event_id) - 1 AS n, CASE m WHEN 0 THEN 'auth' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'network'
   WHEN 3 THEN 'timeout' WHEN 4 THEN 'not_found' WHEN 5 THEN 'reset' ELSE 'unknown' END AS kind FROM a),
r AS (SELECT *, kind <> 'not_found' AND n + 1 < 5 AND (kind <> 'auth' OR n < 2) AS retry FROM k)
SELECT event_id, n, kind, retry, CASE WHEN retry THEN CASE WHEN kind = 'rate_limited' THEN greatest(least(30.0, 2.0 ** n), 2.0 * (n + 1)) ELSE least(30.0, 2.0 ** n) END::DOUBLE END AS delay_s FROM r""")  # fmt: skip
def _(t):
    m = F.col("event_id") % 7
    text = F.when(m == 3, "Read timed out").when(m == 4, "404 Not Found").when(m == 5, "Broken pipe").otherwise("odd")
    code = F.when(m == 0, 403).when(m == 1, 429).when(m == 2, 503)
    bad = t.events.where("event_type = 'error'").select("event_id", F.col("user_id").alias("job"), F.struct("ts", "event_id").alias("at"), text.alias("error"), code.alias("status_code"))
    return A.retry_plan(bad).select("event_id", F.col("n").cast("long").alias("n"), "kind", "retry", "delay_s")


@query("f5_rank_candidates", "transfers", """
, p AS (SELECT event_id, platform, host, CASE WHEN event_id % 11 = 0 THEN 0.0 WHEN event_id % 13 = 0 THEN -500.0
   WHEN success = 1 THEN 10000.0 / greatest(1.0, event_id % 400) + CASE WHEN event_id % 2 = 0 THEN 50.0 ELSE 0.0 END ELSE -100.0 END::DOUBLE AS score FROM transfers)
SELECT event_id, CAST(round(score * 1000) AS BIGINT) AS score_milli FROM p""")  # fmt: skip
def _(t):
    e = F.col("event_id")
    probes = t.transfers.select(
        "event_id", F.col("platform").alias("job"), "host", (e % 400).cast("double").alias("latency_ms"), (e % 2 == 0).alias("ranges"), (e % 13 == 0).alias("error"),
        F.when(e % 11 == 0, None).when(F.col("success") == 1, 206).otherwise(500).alias("status_code"),
    )
    return A.rank_candidates(probes).select("event_id", F.round(F.col("score") * 1000).cast("long").alias("score_milli"))


@query("h12_error_kinds", "", """
SELECT event_type, CASE WHEN value < 50 THEN 'auth' WHEN value < 100 THEN 'network' WHEN event_type = 'error' THEN 'timeout'
  WHEN event_type = 'click' THEN 'reset' ELSE 'unknown' END AS kind, count(*) AS n FROM events GROUP BY ALL""")  # fmt: skip
def _(t):
    code = F.when(F.col("value") < 50, 403).when(F.col("value") < 100, 502)
    text = F.when(F.col("event_type") == "error", "Connection timed out").when(F.col("event_type") == "click", "RemoteDisconnected").otherwise("odd")
    return t.events.select("event_type", A.error_kind(text, code).alias("kind")).groupBy("event_type", "kind").agg(F.count("*").alias("n"))


@query("h16_pricing", "usage paid_orders", """
SELECT order_code, amount_vnd // 1000 * 1000 AS paid, amount_vnd // 1000 * 1000 BETWEEN 20000 AND 300000 AS accepted,
  CASE WHEN amount_vnd // 1000 * 1000 BETWEEN 20000 AND 300000 THEN amount_vnd // 1000 * 12 END AS units,
  order_code % 50 * (3 + CASE WHEN order_code % 2 = 0 THEN 2 ELSE 0 END) + CASE WHEN order_code % 3 = 0 THEN 40 ELSE 0 END AS cost FROM paid_orders""")  # fmt: skip
def _(t):
    bought = A.purchase_units(t.paid_orders, "amount_vnd", 12, 20_000, 300_000)
    code = F.col("order_code")
    jobs = bought.withColumns({"n": code % 50, "auto_translate": code % 2 == 0, "with_metadata": code % 3 == 0})
    return A.estimate_cost(jobs, 3, 2, 40).select("order_code", "paid", "accepted", "units", "cost")


@query("a10_append_transfers", "transfers", """
SELECT event_id, CAST(floor(CASE WHEN duration > 0 THEN bytes / duration ELSE 0 END) AS BIGINT) AS bytes_s FROM transfers""")  # fmt: skip
def _(t):
    return A.with_speed(t.transfers).select("event_id", F.floor("speed").alias("bytes_s"))


@query("e27_progress_eta", "", """
, s AS (SELECT event_id, event_id % 4 AS k, event_id % 23 AS cur, 20 AS tot, value AS el FROM events)
SELECT event_id, CAST(round_even(CASE k WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 45 ELSE 80 END
   + CASE k WHEN 0 THEN 10 WHEN 1 THEN 35 WHEN 2 THEN 35 ELSE 20 END * least(1.0, cur / 20.0)::DOUBLE, 0) AS INT) AS percent,
  CAST(floor(CASE WHEN cur < 3 OR tot <= cur OR el <= 0 THEN 0 ELSE el / cur * (tot - cur) END) AS BIGINT) AS eta_s FROM s""")  # fmt: skip
def _(t):
    e = F.col("event_id")
    k = e % 4
    step = F.when(k == 0, "download").when(k == 1, "transcribe").when(k == 2, "translate").otherwise("export")
    ticks = t.events.select("event_id", step.alias("step"), (e % 23).alias("current"), F.lit(20).alias("total"), F.col("value").alias("elapsed"))
    told = A.progress_eta(ticks, {"download": 10, "transcribe": 35, "translate": 35, "export": 20})
    return told.select("event_id", "percent", F.floor("eta_s").alias("eta_s"))
