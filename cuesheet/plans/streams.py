"""Streaming queries: each runs its stream over all events that are there (availableNow) and returns what it wrote.

The state machines get the events as they might arrive: each up to an hour late, in ``SLOTS`` micro-batches by time of arrival,
shuffled inside. A closing mark after the last event lets the watermark pass all of them.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import views
from ..streaming import machines as M
from .registry import query


def work_folder(spark) -> str:
    """Below the shared folder of the session; a temporary folder only for a local master without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"


def live(t) -> DataFrame:
    """The events table as a stream, with event time in seconds and a number."""
    path = f"{t.sf_dir}/events.parquet"
    source = t.spark.readStream.schema(t.spark.read.parquet(path).schema)
    p = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        source, path = source.option("pathGlobFilter", "events.parquet"), t.sf_dir  # a file source wants a folder
    return shaped(source.parquet(path))


def shaped(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.select("event_id", "user_id", "event_type", "value", "props", ts.alias("ts")).withColumns({"at": F.unix_micros("ts") / 1e6, "ord": F.col("event_id")})


SLOTS, DELAY_S = 5, 3600


def arriving(events: DataFrame, folder: str, late_s: int = DELAY_S, close: bool = True) -> tuple[DataFrame, float]:
    """shaped events as a stream in order of arrival (each up to late_s after its time, by its number), and the time of the
    last one. Every slot of arrival is written as the same number of files, which a micro-batch takes together."""
    spark = events.sparkSession
    files = spark.sparkContext.defaultParallelism
    timed = events.where("ts IS NOT NULL").withColumn("_arrives", F.col("at") + F.pmod(F.col("event_id") * 7919, F.lit(late_s)))
    first, last, newest = timed.agg(F.min("_arrives"), F.max("_arrives"), F.max("at")).first()
    names = [c for c in timed.columns if c != "_arrives"]
    if first is None:
        timed.select(names).write.parquet(folder)
        return spark.readStream.schema(timed.select(names).schema).parquet(folder), 0.0
    slot = F.floor((F.col("_arrives") - first) / (last - first + 1) * SLOTS)
    for k in range(SLOTS):
        timed.where(slot == k).repartition(files).select(names).write.mode("append").parquet(folder)
    if close:
        end = F.timestamp_micros(F.lit(math.ceil((newest + DELAY_S) * 1e6) + 2000))
        timed.limit(1).withColumns({"ts": end, "at": F.lit(newest + DELAY_S + 0.002)}).select(names).write.mode("append").parquet(folder)
    return spark.readStream.schema(timed.select(names).schema).option("maxFilesPerTrigger", files).parquet(folder), newest


def hold_events(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "commit").otherwise("accrue")
    return e.withColumns({"hold_id": F.floor(F.col("event_id") / 8), "kind": kind, "job": F.col("event_id") % 5, "amount": F.floor("value").cast("long"), "ok": F.col("event_type") != "error"})


def wallet_events(e: DataFrame) -> DataFrame:
    return e.withColumn("fingerprint", F.col("user_id").cast("string"))


def order_events(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "pay").otherwise("create")
    return e.withColumns({"order_code": F.floor(F.col("event_id") / 3), "kind": kind, "amount": (F.col("event_id") % 6).cast("long")})


def host_events(e: DataFrame) -> DataFrame:
    ok = F.col("event_type") != "error"
    return e.withColumns({"host": F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")), "ok": ok, "limited": ~ok & (F.col("event_id") % 2 == 0), "speed": F.col("value")})


def tick_events(e: DataFrame) -> DataFrame:
    return e.withColumns({"job": F.col("user_id").cast("string"), "kind": F.col("event_type"), "final": F.col("event_id") % 10 == 0, "current": F.col("event_id") % 50, "total": F.lit(50)})


def _rows(*names: str):
    keep = ["ts", "at", "ord", *names]
    return lambda df: df.select(*keep)


MACHINES = {
    "s1_hold_lifecycle": (M.hold_lifecycle(), lambda e: hold_events(e).select("ts", "at", "ord", "hold_id", "kind", "job", "amount", "ok")),
    "s3_deferred_grant": (M.deferred_grant(3600, 50), lambda e: wallet_events(e).select("ts", "at", "ord", "fingerprint")),
    "s4_payment": (M.payment(900), lambda e: order_events(e).select("ts", "at", "ord", "order_code", "kind", "amount")),
    "s5_sliding_quota": (M.sliding_quota(36_000, 2, 600), lambda e: wallet_events(e).select("ts", "at", "ord", "fingerprint")),
    "s6_throttle": (M.throttle(3_600), lambda e: tick_events(e).select("ts", "at", "ord", "job", "kind", "final")),
    "s7_concurrency": (M.concurrency(), lambda e: host_events(e).select("ts", "at", "ord", "host", "ok", "speed")),
    "s8_rolling_health": (M.rolling_health(), lambda e: host_events(e).select("ts", "at", "ord", "host", "ok", "limited")),
    "s11_online_eta": (M.online_eta(), lambda e: tick_events(e).select("ts", "at", "ord", "job", "current", "total")),
}


#: Event time as in the streams, and where the closing mark moves the watermark; the checks are written from the rules, not the step functions.
TIMED = """, v AS (SELECT *, epoch_us(ts) / 1e6::DOUBLE AS tm FROM events), wm AS (SELECT max(tm) AS mark FROM v)"""
JOBS = TIMED + """
, n AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, event_type AS kind, event_id % 10 = 0 AS final, event_id % 50 AS cur, tm, row_number() OVER (PARTITION BY user_id ORDER BY tm, event_id) AS rn FROM v)"""
HOSTS = TIMED + """
, n AS (SELECT 'h' || user_id % 20 AS host, event_id, event_type <> 'error' AS ok, value AS speed, event_type = 'error' AND event_id % 2 = 0 AS limited, tm, row_number() OVER (PARTITION BY user_id % 20 ORDER BY tm, event_id) AS rn FROM v)"""
CHECKS = {
    "s1_hold_lifecycle": TIMED + """
, h AS (SELECT event_id // 8 AS hold_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'commit' ELSE 'accrue' END AS kind, event_id % 5 AS job,
    CAST(floor(value) AS BIGINT) AS amount, event_type <> 'error' AS ok, tm, row_number() OVER (PARTITION BY event_id // 8 ORDER BY tm, event_id) AS rn FROM v),
c AS (SELECT hold_id, arg_min(amount, rn) AS est, arg_min(tm, rn) + 172800 AS due, min(rn) AS first FROM h WHERE kind = 'create' GROUP BY hold_id),
e AS (SELECT hold_id, max(tm) AS last_at FROM h GROUP BY hold_id),
m AS (SELECT c.hold_id, min(rn) AS rn, arg_min(tm, rn) AS tm FROM c JOIN h ON h.hold_id = c.hold_id AND kind = 'commit' AND rn > first AND tm < due GROUP BY c.hold_id),
z AS (SELECT c.*, m.rn AS stop, CASE WHEN m.rn IS NOT NULL THEN 'committed' WHEN due <= greatest(last_at, mark) THEN 'expired' END AS status, coalesce(m.tm, due) AS tm
  FROM c JOIN e USING (hold_id) LEFT JOIN m USING (hold_id), wm),
j AS (SELECT z.hold_id, job, arg_min(amount, rn) AS amount FROM z JOIN h ON h.hold_id = z.hold_id AND kind = 'accrue' AND ok AND rn > first AND h.tm < due AND (stop IS NULL OR rn < stop) GROUP BY ALL),
u AS (SELECT hold_id, sum(amount) AS used, count(*) AS jobs FROM j GROUP BY hold_id)
SELECT hold_id, status, est AS estimated, CAST(coalesce(used, 0) AS BIGINT) AS used, CAST(greatest(0, est - coalesce(used, 0)) AS BIGINT) AS remaining, coalesce(jobs, 0) AS jobs, tm AS "at" FROM z LEFT JOIN u USING (hold_id) WHERE status IS NOT NULL""",
    "s3_deferred_grant": TIMED + """
SELECT CAST(user_id AS VARCHAR) AS fingerprint, CAST(50 AS BIGINT) AS amount, min(tm) + 3600 AS "at" FROM v, wm GROUP BY user_id, mark HAVING min(tm) + 3600 <= greatest(max(tm), mark)""",
    "s4_payment": TIMED + """
, n AS (SELECT event_id // 3 AS order_code, event_type = 'purchase' AS pay, event_id % 6 AS amount, tm, row_number() OVER (PARTITION BY event_id // 3 ORDER BY tm, event_id) AS rn FROM v),
o AS (SELECT order_code, min(tm) + 900 AS due, max(tm) AS last_at, min(rn) FILTER (NOT pay) AS made, arg_min(amount, rn) FILTER (NOT pay) AS want FROM n GROUP BY order_code),
p AS (SELECT n.*, made > rn OR made IS NULL OR amount = want AS good FROM n JOIN o USING (order_code) WHERE pay),
f AS (SELECT order_code, min(rn) AS rn, arg_min(tm, rn) AS tm FROM p WHERE good GROUP BY order_code)
SELECT order_code, 'paid' AS status, tm AS "at" FROM f
UNION ALL SELECT p.order_code, 'mismatch', p.tm FROM p LEFT JOIN f USING (order_code) WHERE NOT good AND (f.rn IS NULL OR p.rn < f.rn)
UNION ALL SELECT order_code, 'expired', due FROM o LEFT JOIN f USING (order_code), wm WHERE (f.tm IS NULL OR f.tm >= due) AND due <= greatest(last_at, mark)""",
    "s5_sliding_quota": JOBS + """
, r AS (WITH RECURSIVE f(key, rn, event_id, t, ok) AS (
  SELECT key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS DOUBLE[]), false FROM n WHERE rn = 1
  UNION ALL SELECT key, rn, event_id, CASE WHEN ok THEN list_append(t, tm) ELSE t END, ok FROM (
    SELECT *, len(t) < 2 AND (len(t) = 0 OR tm - t[-1] >= 600) AS ok FROM (SELECT n.*, list_filter(f.t, lambda x: x > n.tm - 36000) AS t FROM f JOIN n ON n.key = f.key AND n.rn = f.rn + 1))) SELECT * FROM f WHERE rn > 0)
SELECT key AS fingerprint, event_id, ok AS allowed FROM r""",
    "s6_throttle": JOBS + """
, r AS (WITH RECURSIVE f(key, rn, event_id, kind, tm, shown) AS (
  SELECT key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', -1e18::DOUBLE, false FROM n WHERE rn = 1
  UNION ALL SELECT n.key, n.rn, n.event_id, CASE WHEN n.kind <> f.kind OR final OR n.tm - f.tm >= 3600 THEN n.kind ELSE f.kind END, CASE WHEN n.kind <> f.kind OR final OR n.tm - f.tm >= 3600 THEN n.tm ELSE f.tm END,
    n.kind <> f.kind OR final OR n.tm - f.tm >= 3600 FROM f JOIN n ON n.key = f.key AND n.rn = f.rn + 1) SELECT * FROM f WHERE shown)
SELECT key AS job, event_id, kind FROM r""",
    "s7_concurrency": HOSTS + """
, r AS (WITH RECURSIVE f(host, rn, event_id, k, good, best, changed) AS (
  SELECT host, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 4, 0, 0.0::DOUBLE, -1e18::DOUBLE FROM n WHERE rn = 1
  UNION ALL SELECT host, rn, event_id, CASE WHEN NOT ok THEN CASE WHEN free THEN greatest(1, k // 2) ELSE k END WHEN up THEN k + 1 ELSE k END, CASE WHEN NOT ok OR up THEN 0 ELSE g END, best,
    CASE WHEN (NOT ok AND free) OR (ok AND up) THEN tm ELSE changed END FROM (
    SELECT *, g >= 3 AND free AND k < 16 AS up FROM (
      SELECT *, CASE WHEN speed >= 0.75::DOUBLE * best THEN good + 1 ELSE 0 END AS g, tm - changed >= 3 AS free FROM (
        SELECT n.*, f.k, f.good, greatest(f.best, n.speed) AS best, f.changed FROM f JOIN n ON n.host = f.host AND n.rn = f.rn + 1)))) SELECT * FROM f WHERE rn > 0)
SELECT host, event_id, CAST(k AS INT) AS connections FROM r""",
    "s8_rolling_health": HOSTS + """
SELECT host, event_id, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * sum(ok::INT) OVER w / count(*) OVER w - 10 * sum(limited::INT) OVER w)) AS health
FROM n WINDOW w AS (PARTITION BY host ORDER BY rn ROWS 49 PRECEDING)""",
    "s11_online_eta": JOBS + """
SELECT key AS job, event_id, CASE WHEN cur < 3 OR tm - since <= 0 THEN 0.0::DOUBLE ELSE (tm - since) / cur * (50 - cur) END AS eta_s FROM (SELECT *, first_value(tm) OVER (PARTITION BY key ORDER BY rn) AS since FROM n)""",
}


def _register(name: str) -> None:
    machine, shape = MACHINES[name]

    @query(name, "", CHECKS[name])
    def _(t):
        folder = work_folder(t.spark)
        events, newest = arriving(shaped(t.events), f"{folder}/arrivals")
        return M.written(t.spark, M.stream(shape(events), machine, f"{DELAY_S} seconds", newest), folder)


for _name in MACHINES:
    _register(_name)


@query("s2_unique_events", "", """
SELECT user_id || '-' || event_id // 3 AS idempotency_key FROM events GROUP BY 1""")  # fmt: skip
def _(t):
    keyed = live(t).select("ts", F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 3).cast("string")).alias("idempotency_key"))
    return M.written(t.spark, M.unique_events(keyed, "idempotency_key", "60 days"), work_folder(t.spark)).select("idempotency_key")


@query("s9_daily_usage", "usage", """
, d AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, action, count(*) AS requests, CAST(sum(input_size) AS BIGINT) AS sentences, CAST(sum(credit_charged) AS BIGINT) AS credit FROM usage GROUP BY 1, 2)
SELECT * FROM d WHERE day < (SELECT strftime(max(created_at) - INTERVAL 1 HOUR, '%Y-%m-%d') FROM usage)""")  # fmt: skip
def _(t):
    rows = live(t).select(
        "ts", F.col("event_type").alias("action"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("input_size"), F.floor("value").alias("credit_charged")
    )
    return M.written(t.spark, M.daily_usage(rows), work_folder(t.spark))


@query("s10_reconcile_changes", "ledger devices", """
, s AS (SELECT fingerprint, CAST(sum(delta) AS BIGINT) AS ledger_sum FROM ledger GROUP BY fingerprint)
SELECT fingerprint, balance, ledger_sum, balance - ledger_sum AS diff FROM devices JOIN s USING (fingerprint) WHERE balance <> ledger_sum""")  # fmt: skip
def _(t):
    folder = work_folder(t.spark)
    t.devices.select("fingerprint", "balance").write.parquet(f"{folder}/devices")  # a table, not the view over the ledger
    events, _ = arriving(shaped(t.events), f"{folder}/arrivals", close=False)
    delta = F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(-F.floor(F.col("value") / 10)).cast("long")
    ledger = events.select(F.col("user_id").cast("string").alias("fingerprint"), delta.alias("delta"))
    M.run_stream(t.spark, M.reconcile_changes(ledger, t.spark.read.parquet(f"{folder}/devices"), folder))
    return M.open_drift(t.spark, folder)


@query("s12_late_events", "", """
WITH v AS (SELECT event_id, epoch_us(ts) / 1e6::DOUBLE AS tm, epoch_us(ts) / 1e6::DOUBLE + event_id * 7919 % 10800 AS arrives FROM events),
b AS (SELECT *, CAST(floor((arrives - (SELECT min(arrives) FROM v)) / ((SELECT max(arrives) - min(arrives) FROM v) + 1) * 5) AS INTEGER) AS batch FROM v),
m AS (SELECT batch, max(max(tm)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM b GROUP BY batch)
SELECT event_id, batch, mark FROM b JOIN m USING (batch) WHERE tm < mark - 3600""")  # fmt: skip
def _(t):
    folder = work_folder(t.spark)
    events, _ = arriving(shaped(t.events), f"{folder}/arrivals", late_s=3 * DELAY_S, close=False)
    M.run_stream(t.spark, M.divert_late(events.select("event_id", "ts", "at"), folder, DELAY_S))
    return t.spark.read.parquet(f"{folder}/late").select("event_id", "batch", "mark")


__all__ = ["MACHINES", "live", "shaped", "views"]
