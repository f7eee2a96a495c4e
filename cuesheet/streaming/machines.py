"""Keyed state machines for Structured Streaming, each with a batch twin over the same step function.

A machine's ``step`` takes the state (a dict, or None for a new key), one event and the key's names, and gives output rows and
the next state; ``due`` names the event time at which the machine acts by itself, and ``fire`` what it does then.

Order. Events may arrive in any order within the watermark's delay. They wait in list state until the watermark passes them; a
timer then hands them to the machine of their key by event time, between the times at which it is due. So rows do not depend on
how events are split into micro-batches, and are those of the batch twin. Later events are too late for the machine;
``divert_late`` writes them to a table of their own.

State is kept in RocksDB. Every call to it from Python costs as much as several events, so keys share state by ``groups``, dealt
by hash: a group has one list of the waiting events of the last delay and one value with the small dicts of its keys, which
are read and written together; a micro-batch costs some calls a group and none a key. For machines that must know which names
they have met (a hold its jobs), the first ``NEAR`` names of a key lie in its dict and further ones in map state, one entry
each, so that a name costs one look-up however many there are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

Event = dict
State = dict
GROUPS, NEAR = 256, 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Names:
    """Names that a key has met; in memory for the batch twin."""

    def __init__(self):
        self.met: set[str] = set()

    def add(self, name: str) -> bool:
        """Whether the name is new."""
        new = name not in self.met
        self.met.add(name)
        return new

    def clear(self) -> None:
        self.met.clear()


class _KeptNames(Names):
    """The same with the first NEAR names beside the state of a key and the others in map state, both by name and by number."""

    def __init__(self, key: str | None, near: list[str], n: int, by_name, by_number):
        self.met, self.n, self.key, self.by_name, self.by_number = set(near), n, json.dumps(key), by_name, by_number

    def add(self, name: str) -> bool:
        if name in self.met or (self.n > NEAR and self.by_name.containsKey((self.key, name))):
            return False
        if self.n < NEAR:
            self.met.add(name)
        else:
            self.by_name.updateValue((self.key, name), (1,))
            self.by_number.updateValue((self.key, self.n), (name,))
        self.n += 1
        return True

    def clear(self) -> None:
        for i in range(NEAR, self.n):
            self.by_name.removeKey((self.key, self.by_number.getValue((self.key, i))[0]))
            self.by_number.removeKey((self.key, i))
        self.met, self.n = set(), 0


@dataclass(frozen=True)
class Machine:
    key: str
    out: str  # DDL of the output rows, first the key
    step: Callable[[State | None, Event, Names], tuple[list[tuple], State | None]]
    due: Callable[[State], float | None] = lambda s: None
    fire: Callable[[State, Names], tuple[list[tuple], State | None]] = lambda s, names: ([], None)


def _columns(m: Machine) -> list[str]:
    return [f.strip().split()[0] for f in m.out.split(",")]


def _feed(m: Machine, key, state: State | None, events: list[Event], names: Names, upto: float | None) -> tuple[list[tuple], State | None]:
    """Events by time, then number, each after what is due before it; then what is due up to ``upto``."""
    rows: list[tuple] = []

    def fire(until: float) -> None:
        nonlocal state
        while state is not None and (t := m.due(state)) is not None and t <= until:
            out, state = m.fire(state, names)
            rows.extend((key, *o) for o in out)

    for e in sorted(events, key=lambda e: (e["at"], e["ord"])):
        fire(e["at"])
        out, state = m.step(state, e, names)
        rows += [(key, *o) for o in out]
    if upto is not None:
        fire(upto)
    return rows, state


class _Ordered(StatefulProcessor):
    """Keeps the events of a group of keys until the watermark has passed them, then feeds each key's machine."""

    def __init__(self, m: Machine):
        self.m = m

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at double, key string, event string")
        self.held = handle.getValueState("states", "json string")
        self.next_at = handle.getValueState("next", "at double")
        self.names = handle.getMapState("names", "key string, name string", "n int"), handle.getMapState("numbers", "key string, n int", "name string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = math.inf
        for x in rows:
            keys, events = x["key_text"], x.drop(columns=["group_no", "key_text", "ts"]).to_dict("records")
            self.waiting.appendList([(float(e["at"]), k, json.dumps(e, default=lambda v: v.item())) for k, e in zip(keys, events, strict=True)])
            first = min(first, float(x["at"].min()))
        if not self.next_at.exists() or first < self.next_at.get()[0]:
            self._wake(first, timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        if not self.next_at.exists() or self.next_at.get()[0] > passed:
            return
        ready: dict[str | None, list[Event]] = {}
        later = []
        for x in self.waiting.get():
            if x[0] <= passed:
                ready.setdefault(x[1], []).append(json.loads(x[2]))
            else:
                later.append(x)
        states = {k: rest for k, *rest in json.loads(self.held.get()[0])} if self.held.exists() else {}
        due = lambda k: self.m.due(states[k][0]) if k in states else None
        for k in states:
            if k not in ready and (t := due(k)) is not None and t <= passed:
                ready[k] = []
        out = []
        for k, events in ready.items():
            state, near, n = states.get(k, (None, [], 0))
            names = _KeptNames(k, near, n, *self.names)
            rows, state = _feed(self.m, k, state, events, names, passed)
            out += rows
            if state is None:
                states.pop(k, None)
            else:
                states[k] = (state, sorted(names.met), names.n)
        if any(ready.values()):
            self.waiting.put(later) if later else self.waiting.clear()
        if states:
            self.held.update((json.dumps([(k, *rest) for k, rest in states.items()]),))
        else:
            self.held.clear()
        ahead = [x[0] for x in later] + [t for k in states if (t := due(k)) is not None]
        if ahead:
            self._wake(min(ahead), timerValues)
        else:
            self.next_at.clear()
        if out:
            yield pd.DataFrame(out, columns=_columns(self.m))

    def _wake(self, at: float, timerValues) -> None:
        self.next_at.update((float(at),))
        self.handle.registerTimer(max(math.ceil(at * 1000), timerValues.getCurrentWatermarkInMs() + 1))


def stream(events: DataFrame, m: Machine, delay: str = "1 hour", until: float | None = None, groups: int = GROUPS) -> DataFrame:
    """events(ts timestamp, at double seconds, ord, key, ...) as a stream -> the machine's rows, append mode. Events without a
    time are left out. Events after ``until`` only move the watermark. ``groups`` stays as it is for the life of a checkpoint:
    a group's states are written with every micro-batch that touches it, so its keys should be tens of thousands at most."""
    timed = events.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
    if until is not None:
        timed = timed.where(F.unix_micros("ts") / 1e6 <= until)
    kind = dict(events.dtypes)[m.key]
    dealt = timed.withColumns({"group_no": F.pmod(F.xxhash64(m.key), F.lit(groups)), "key_text": F.col(m.key).cast("string")}).drop(m.key)
    told = ", ".join([f"{m.key} string", *m.out.split(",")[1:]])  # a key as text is exact and may be null
    made = dealt.groupBy("group_no").transformWithStateInPandas(_Ordered(m), told, "append", "eventTime")
    return made.withColumn(m.key, F.col(m.key).cast(kind))


def batch(events: DataFrame, m: Machine, upto: float | None = None) -> DataFrame:
    """The same rows from a bounded table; machines due by ``upto`` fire at the end."""
    names = _columns(m)

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_feed(m, key[0], None, df.to_dict("records"), Names(), upto)[0], columns=names)

    return events.groupBy(m.key).applyInPandas(run, m.out)


def run_stream(spark: SparkSession, writer) -> None:
    """Run to the end of what is there, with state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there into Parquet and read it."""
    run_stream(spark, df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state"))
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def divert_late(events: DataFrame, folder: str, delay_s: float = 3600):
    """A writer that puts events(ts, at, ...) into ``folder``/in_time and ``folder``/late. An event is late if it is more than
    delay_s behind the newest one of all micro-batches before its own; late rows have that mark beside them. A stream over
    in_time with that delay loses none. Each micro-batch writes folders of its own, the newest time last, so one that is run
    again after a failure replaces what it wrote."""
    spark = events.sparkSession

    def put(part: DataFrame, no: int) -> None:
        marks = spark.read.schema("newest double, batch long").option("recursiveFileLookup", "true").parquet(f"{folder}/marks") if no else None
        mark = marks.where(F.col("batch") < no).agg(F.max("newest")).first()[0] if no else None
        part = part.persist()
        try:
            late = F.col("at") < mark - delay_s if mark is not None else F.lit(False)
            for name, rows in (("in_time", part.where(~F.coalesce(late, F.lit(False)))), ("late", part.where(late).withColumn("mark", F.lit(mark).cast("double")))):
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={no}")
            newest = part.agg(F.max("at").alias("newest"), F.lit(no).cast("long").alias("batch"))
            newest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={no}")
        finally:
            part.unpersist()

    return events.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/divert")


# --- the machines -----------------------------------------------------------------------------------------------------


def hold_lifecycle(ttl_s: float = 48 * 3600) -> Machine:
    """Events kind create (amount = estimate), accrue (job, amount, ok), commit. Creating twice or accruing a job twice
    changes nothing; a hold is committed on request or after its time to live. The jobs of an open hold are its names."""

    def close(s: State, at: float, how: str, names: Names) -> tuple[list[tuple], State | None]:
        names.clear()
        return [(how, s["estimated"], s["used"], max(0, s["estimated"] - s["used"]), s["jobs"], at)], {**s, "closed": True}

    def step(s: State | None, e: Event, names: Names):
        if s is None:
            return [], {"estimated": int(e["amount"]), "since": e["at"], "used": 0, "jobs": 0, "closed": False} if e["kind"] == "create" else None
        if s["closed"] or e["kind"] == "create":
            return [], s
        if e["kind"] == "commit":
            return close(s, e["at"], "committed", names)
        if e["ok"] and names.add(str(e["job"])):
            s = {**s, "used": s["used"] + int(e["amount"]), "jobs": s["jobs"] + 1}
        return [], s

    return Machine(
        "hold_id", "hold_id long, status string, estimated long, used long, remaining long, jobs long, at double", step,
        lambda s: None if s["closed"] else s["since"] + ttl_s, lambda s, names: close(s, s["since"] + ttl_s, "expired", names),
    )


def deferred_grant(wait_s: float, amount: int) -> Machine:
    """One grant, wait_s after a key is first seen."""

    def step(s: State | None, e: Event, names: Names):
        return [], s or {"since": e["at"], "done": False}

    return Machine(
        "fingerprint", "fingerprint string, amount long, at double", step,
        lambda s: None if s["done"] else s["since"] + wait_s, lambda s, names: ([(amount, s["since"] + wait_s)], {**s, "done": True}),
    )


def payment(ttl_s: float) -> Machine:
    """Orders: pending, expired after ttl_s; a payment wins even late; a wrong amount gives an audit row."""

    def step(s: State | None, e: Event, names: Names):
        s = s or {"due": e["at"] + ttl_s, "want": None, "status": "pending"}
        if e["kind"] == "create":
            return [], {**s, "want": int(e["amount"])} if s["want"] is None else s
        if s["status"] == "paid":
            return [], s
        if s["want"] is not None and int(e["amount"]) != s["want"]:
            return [("mismatch", e["at"])], s
        return [("paid", e["at"])], {**s, "status": "paid"}

    return Machine(
        "order_code", "order_code long, status string, at double", step,
        lambda s: s["due"] if s["status"] == "pending" else None, lambda s, names: ([("expired", s["due"])], {**s, "status": "expired"}),
    )


def sliding_quota(window_s: float = 60, most: int = 30, spacing_s: float = 0.5) -> Machine:
    """A verdict per request: allowed if fewer than ``most`` were allowed in the window and the last is spacing_s ago."""

    def step(s: State | None, e: Event, names: Names):
        times = [t for t in (s or {"t": []})["t"] if t > e["at"] - window_s]
        ok = len(times) < most and (not times or e["at"] - times[-1] >= spacing_s)
        return [(int(e["ord"]), ok)], {"t": [*times, e["at"]] if ok else times}

    return Machine("fingerprint", "fingerprint string, event_id long, allowed boolean", step)


def throttle(least_s: float = 0.1) -> Machine:
    """Progress ticks of a key within least_s of the last one passed are dropped, except state changes and final ticks."""

    def step(s: State | None, e: Event, names: Names):
        new = s is None or s["kind"] != e["kind"] or bool(e["final"]) or e["at"] - s["at"] >= least_s
        return ([(int(e["ord"]), e["kind"])], {"at": e["at"], "kind": e["kind"]}) if new else ([], s)

    return Machine("job", "job string, event_id long, kind string", step)


def concurrency(start: int = 4, most: int = 16, streak: int = 3, cooldown_s: float = 3.0, guard: float = 0.75) -> Machine:
    """Recommended connections of a host: one more after ``streak`` good transfers that keep ``guard`` of the best speed,
    half after a bad one, at most one change in cooldown_s."""

    def step(s: State | None, e: Event, names: Names):
        s = s or {"n": start, "good": 0, "best": 0.0, "changed": -1e18}
        n, good, best, changed = s["n"], s["good"], max(s["best"], e["speed"]), s["changed"]
        free = e["at"] - changed >= cooldown_s
        if not e["ok"]:
            good = 0
            if free:
                n, changed = max(1, n // 2), e["at"]
        else:
            good = good + 1 if e["speed"] >= guard * best else 0
            if good >= streak and free and n < most:
                n, good, changed = n + 1, 0, e["at"]
        return [(int(e["ord"]), n)], {"n": n, "good": good, "best": best, "changed": changed}

    return Machine("host", "host string, event_id long, connections int", step)


def rolling_health(newest: int = 50) -> Machine:
    """Health of a host after each transfer, on its newest ones."""

    def step(s: State | None, e: Event, names: Names):
        last = [*(s or {"l": []})["l"], [int(e["ok"]), int(e["limited"])]][-newest:]
        rate = 100.0 * sum(a for a, _ in last) / len(last) - 10 * sum(b for _, b in last)
        return [(int(e["ord"]), max(0.0, min(100.0, rate)))], {"l": last}

    return Machine("host", "host string, event_id long, health double", step)


def online_eta(samples: int = 3) -> Machine:
    """Seconds left of a job by the pace since its first tick; 0 until there are enough samples."""

    def step(s: State | None, e: Event, names: Names):
        s = s or {"since": e["at"]}
        cur, total, spent = int(e["current"]), int(e["total"]), e["at"] - s["since"]
        eta = 0.0 if cur < samples or total <= cur or spent <= 0 else spent / cur * (total - cur)
        return [(int(e["ord"]), eta)], s

    return Machine("job", "job string, event_id long, eta_s double", step)


def unique_events(events: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def daily_usage(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    win = F.window("ts", "1 day")
    per = events.withWatermark("ts", delay).groupBy(win, "action").agg(F.count("*").alias("requests"), F.sum("input_size").alias("sentences"), F.sum("credit_charged").alias("credit"))
    return per.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "action", "requests", "sentences", "credit")


class _Drift(StatefulProcessor):
    """A wallet's running sum and its last difference from the balance; a row whenever the difference changes."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("sum", "total long, told boolean, diff long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, told, last = self.held.get() if self.held.exists() else (0, False, None)
        balance = None
        for x in rows:
            total += int(x["delta"].fillna(0).sum())
            balance = x["balance"].iloc[-1]
        balance = None if pd.isna(balance) else int(balance)
        diff = None if balance is None else balance - total
        new = diff != last if told else diff != 0
        self.held.update((total, told or new, diff if new else last))
        if new:
            yield pd.DataFrame({"fingerprint": [key[0]], "balance": pd.array([balance], "Int64"), "ledger_sum": [total], "diff": pd.array([diff], "Int64")})


def reconcile_changes(ledger: DataFrame, devices: DataFrame, folder: str):
    """A writer of changes of drift: ledger(fingerprint, delta) as a stream, devices(fingerprint, balance) as a table. The sum of
    a wallet is kept in state, so a micro-batch reads its own rows only. A row (batch, fingerprint, balance, ledger_sum, diff)
    tells a new difference, 0 when it has gone, null when there is no balance. A micro-batch that is run again replaces its rows."""
    met = ledger.select("fingerprint", "delta").join(devices.select("fingerprint", F.col("balance").cast("long").alias("balance")), "fingerprint", "left")
    drift = met.groupBy("fingerprint").transformWithStateInPandas(_Drift(), "fingerprint string, balance long, ledger_sum long, diff long", "update", "none")

    def put(part: DataFrame, no: int) -> None:
        part.write.mode("overwrite").parquet(f"{folder}/drift/batch={no}")

    return drift.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state")


def open_drift(spark: SparkSession, folder: str) -> DataFrame:
    """The last difference of each wallet, where there is one."""
    told = spark.read.parquet(f"{folder}/drift").groupBy("fingerprint").agg(F.max_by(F.struct("balance", "ledger_sum", "diff"), "batch").alias("r"))
    return told.select("fingerprint", "r.*").where(~F.col("diff").eqNullSafe(F.lit(0)))
