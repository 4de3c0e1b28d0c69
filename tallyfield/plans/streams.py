"""Streams that keep state: built-in aggregates in update mode, merged by key as they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyfield.functions.orders import stop_loss
from tallyfield.plans.base import query
from tallyfield.session import table
from tallyfield.streaming.run import drain


def newest():
    """What orders the updates of a key."""
    return F.struct("ts", "event_id")


#: State of event time is dropped so long after the newest event.
LATE = "2 days"
STALE_SECONDS = 5 * 86400
JOB_SECONDS = 3 * 86400


def timed(events):
    """With ``day`` and ``at``, an event time for watermarks: the clock time read as UTC, whatever the session's zone."""
    clock = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return events.withColumn("day", F.to_date("ts")).withColumn("at", F.timestamp_seconds(F.unix_date("day") * F.lit(86400).cast("long") + clock))


#: Files that a batch takes at most; all that are there if None.
FILES_PER_BATCH = None


def _events(spark, sf_dir, build, keys=None, **more):
    return drain(spark, f"{sf_dir}/events.parquet", build, "update" if keys else "append", keys, FILES_PER_BATCH, **more)


def day_of_2024(days):
    """The start of the day so many days after 2024-01-01, as an event time."""
    return F.timestamp_seconds((F.unix_date(F.lit("2024-01-01").cast("date")) + days.cast("int")).cast("long") * 86400)


def ms(at) -> int:
    return at.value // 1_000_000


@query("""SELECT user_id, arg_max(event_id, struct_pack(ts, event_id)) AS event_id,
arg_max(value, struct_pack(ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id""")
def st01_latest(spark, sf_dir):
    """O-ST1: newest value of each key; batches write the keys they change, which are merged by key."""

    def build(e):
        new = F.max_by(F.struct("event_id", "value", "ts"), newest()).alias("new")
        return e.groupBy("user_id").agg(new).select("user_id", "new.*")

    return _events(spark, sf_dir, build, ["user_id"])


@query("""WITH s AS (SELECT user_id, event_type, CAST(round(arg_max(value, struct_pack(ts, event_id)) * 100) AS BIGINT) AS v
FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT user_id, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS marks FROM s GROUP BY 1""")
def st02_map_state(spark, sf_dir):
    """O-ST2: live state as a map; an update overrides its own entry, one without a value none."""

    def build(e):
        cents = F.round(F.max_by("value", newest()) * 100).cast("long").alias("v")
        return e.where("value is not null").groupBy("user_id", "event_type").agg(cents)

    state = _events(spark, sf_dir, build, ["user_id", "event_type"])
    entry = F.concat_ws("=", "event_type", "v")
    return state.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), ";").alias("marks"))


@query("""SELECT event_id, o_orderkey, CAST(round(value * 100) AS BIGINT) AS mark_cents,
CAST(round(value * 100) AS BIGINT) - CAST(floor(o_totalprice) AS BIGINT) AS gain_cents
FROM events JOIN orders ON o_custkey = user_id WHERE event_type = 'view' AND o_orderstatus = 'O'""")
def st03_marks(spark, sf_dir):
    """O-ST3: each update of a market is kept as history and marks the open orders on it."""
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    held = held.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.floor("o_totalprice").cast("long").alias("paid"))

    def build(e):
        mark = F.round(F.col("value") * 100).cast("long")
        marked = e.where("event_type = 'view'").join(held, "user_id")
        return marked.select("event_id", "o_orderkey", mark.alias("mark_cents"), (mark - F.col("paid")).alias("gain_cents"))

    return _events(spark, sf_dir, build)


@query("""WITH c AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS old,
TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(c_custkey % 20 AS BIGINT) AS start FROM customer),
n AS (SELECT user_id, arg_max(value, struct_pack(ts, event_id)) AS new FROM events JOIN c USING (user_id)
WHERE ts < start OR old IS NULL GROUP BY 1)
SELECT user_id, coalesce(new, old) AS value, new IS NULL AS frozen FROM c LEFT JOIN n USING (user_id)""")
def st04_freeze(spark, sf_dir):
    """O-ST4, O-M4: updates after the start are ignored, unless there is no value yet."""
    key = F.col("c_custkey")
    start = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + 86400 * (key % 20))
    old = F.when(key % 5 != 0, F.col("c_acctbal"))
    known = table(spark, sf_dir, "customer").select(key.alias("user_id"), old.alias("old"), start.alias("start"))

    def build(e):
        taken = e.join(known, "user_id").where("ts < start or old is null")
        return taken.groupBy("user_id").agg(F.max_by("value", newest()).alias("new"))

    new = _events(spark, sf_dir, build, ["user_id"])
    return known.join(new, "user_id", "left").select("user_id", F.coalesce("new", "old").alias("value"), F.col("new").isNull().alias("frozen"))


class _Freeze(StatefulProcessor):
    """A key's newest update before its start, its first one after, and how many came after; told and dropped later."""

    spec = "user_id long, value double, late long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        half = "{0}_ts timestamp_ntz, {0}_event long, {0}_value double"
        self.state = handle.getValueState("updates", f"old double, {half.format('before')}, {half.format('after')}, n_after long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old, *known = self.state.get() if self.state.exists() else (None, None, None, None, None, None, None, 0)
        before, after, n = tuple(known[:3]), tuple(known[3:6]), known[6]
        for part in rows:
            if n == 0 and before[0] is None:  # nothing known yet
                self.handle.registerTimer(ms(part["closed"].iloc[0]))
                old = None if pd.isna(part["old"].iloc[0]) else float(part["old"].iloc[0])
            part = part.sort_values(["ts", "event_id"])
            told = lambda r: (r["ts"].to_pydatetime(), int(r["event_id"]), float(r["value"]))
            early, rest = part[part["early"]], part[~part["early"]]
            if len(early) and (before[0] is None or told(early.iloc[-1])[:2] > before[:2]):
                before = told(early.iloc[-1])
            if len(rest) and (after[0] is None or told(rest.iloc[0])[:2] < after[:2]):
                after = told(rest.iloc[0])
            n += len(rest)
        self.state.update((old, *before, *after, n))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old, _, _, before, _, _, after, n = self.state.get()
        self.state.clear()
        value = before if before is not None else old if old is not None else after
        late = n - (before is None and old is None and n > 0)
        yield pd.DataFrame({"user_id": [key[0]], "value": [value], "late": [late]}).astype({"value": "float64"})

    def close(self) -> None:
        pass


GRACE_DAYS = 2


def frozen_values(spark, sf_dir, **more) -> tuple[DataFrame, DataFrame]:
    """The keys (user_id, old, start) and user_id, value, late of those with updates, told when their time is up."""
    key = F.col("c_custkey")
    known = table(spark, sf_dir, "customer").select(key.cast("long").alias("user_id"), F.when(key % 5 != 0, F.col("c_acctbal")).alias("old"), day_of_2024(key % 20).alias("start"), day_of_2024(key % 20 + GRACE_DAYS).alias("closed"))

    def build(e):
        updates = timed(e.where("value is not null")).withWatermark("at", "1 day").join(known, "user_id").where("at < closed")
        slim = updates.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "at", "event_id", "value", "old", "closed", (F.col("at") < F.col("start")).alias("early"))
        return slim.groupBy("user_id").transformWithStateInPandas(_Freeze(), _Freeze.spec, "append", "EventTime")

    return known, _events(spark, sf_dir, build, own_state=True, **more)


@query(f"""WITH c AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS old,
TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(c_custkey % 20 AS BIGINT) AS start FROM customer),
u AS (SELECT user_id, arg_max(value, struct_pack(ts, event_id)) FILTER (ts < start) AS before, arg_min(value, struct_pack(ts, event_id)) FILTER (ts >= start) AS after,
count(*) FILTER (ts >= start) AS n FROM events JOIN c USING (user_id) WHERE value IS NOT NULL AND ts < start + INTERVAL {GRACE_DAYS} DAY GROUP BY 1)
SELECT user_id, coalesce(before, old, after) AS value, CAST(coalesce(n, 0) - CASE WHEN before IS NULL AND old IS NULL AND n > 0 THEN 1 ELSE 0 END AS BIGINT) AS late
FROM c LEFT JOIN u USING (user_id)""")
def st04_bounded(spark, sf_dir):
    """O-ST4: values frozen at the start, late updates counted for two days; state goes once the watermark is past them.

    A key without any value takes the first update after its start.
    """
    known, told = frozen_values(spark, sf_dir)
    return known.join(told, "user_id", "left").select("user_id", F.coalesce("value", "old").alias("value"), F.coalesce("late", F.lit(0)).alias("late"))


#: Keys are dealt to so many states by hash: a call of a processor handles all of a state's keys with rows, not one key.
STATES = 2048
NEVER, NO_TIMER = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def state_of(key: str):
    return F.pmod(F.xxhash64(key), F.lit(STATES)).cast("int").alias("state")


def micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


class _Timed(StatefulProcessor):
    """Keys of a state with the time at which each is due; one timer, for the earliest."""

    def set(self, due: np.ndarray, timer: int) -> int:
        """Move the timer from ``timer`` (0: none is set) to the earliest time due; returns that."""
        first = int(due.min(initial=NO_TIMER))
        first = 0 if first == NO_TIMER else max(first, 1)
        if first != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if first:
                self.handle.registerTimer(first)
        return first

    def close(self) -> None:
        pass


class _Staleness(_Timed):
    """Last checks of keys and which are told to be stale; a timer tells it without a new check."""

    spec = "user_id long, ts timestamp_ntz, stale boolean"

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # at: the last check, in microseconds
        self.state = handle.getValueState("last", "users array<long>, at array<long>, stale array<boolean>, timer long")

    def _get(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        users, at, stale, timer = self.state.get() if self.state.exists() else ([], [], [], 0)
        return np.array(users, np.int64), np.array(at, np.int64), np.array(stale, bool), timer

    def _due(self, at: np.ndarray, stale: np.ndarray) -> np.ndarray:
        """When keys get stale, in milliseconds: those never checked as soon as there is a time."""
        due = np.where(at == NEVER, 1, at // 1_000_000 * 1000 + self.seconds * 1000 + 1)
        return np.where(stale, NO_TIMER, due)

    def _put(self, users: np.ndarray, at: np.ndarray, stale: np.ndarray, timer: int) -> None:
        timer = self.set(self._due(at, stale), timer)
        self.state.update((users.tolist(), at.tolist(), stale.tolist(), timer))

    def _rows(self, users: np.ndarray, at: np.ndarray, stale: bool) -> pd.DataFrame:
        return pd.DataFrame({"user_id": users, "ts": at.astype("datetime64[us]"), "stale": np.full(len(users), stale)})

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        users, at, stale, timer = self._get()
        more = np.setdiff1d(initialState["user_id"].to_numpy(np.int64), users)
        self._put(np.append(users, more), np.append(at, np.full(len(more), NEVER)), np.append(stale, np.zeros(len(more), bool)), timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        users, at, stale, timer = self._get()
        newest = pd.concat([part.groupby("user_id")["ts"].max() for part in rows]).groupby(level=0).max()
        given, ts = newest.index.to_numpy(np.int64), micros(newest)
        more = np.setdiff1d(given, users)
        users, at, stale = np.append(users, more), np.append(at, np.full(len(more), NEVER)), np.append(stale, np.zeros(len(more), bool))
        of = pd.Index(users).get_indexer(given)
        newer = ts > at[of]
        if not newer.any():
            return
        of, ts = of[newer], ts[newer]
        told = stale[of] | (at[of] == NEVER)
        at[of], stale[of] = ts, False
        self._put(users, at, stale, timer)
        yield self._rows(users[of][told], ts[told], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        users, at, stale, timer = self._get()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if fired != timer:
            return
        over = self._due(at, stale) < max(fired + 1, timerValues.getCurrentWatermarkInMs())
        stale |= over
        self._put(users, at, stale, 0)  # the timer that fired goes by itself
        yield self._rows(users[over], at[over], True)


def stale_keys(spark, sf_dir, seconds: int = STALE_SECONDS, checks_are: str = "true", **more) -> DataFrame:
    """user_id, ts, stale: the newest word on each key; never-checked ones are stale from the first batch's end."""
    keys = table(spark, sf_dir, "customer").select(state_of("c_custkey"), F.col("c_custkey").cast("long").alias("user_id")).groupBy("state")

    def build(e):
        checks = timed(e).withWatermark("at", "0 seconds").where(checks_are).where("user_id is not null and ts is not null")
        checks = checks.select(state_of("user_id"), "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "at")
        return checks.groupBy("state").transformWithStateInPandas(_Staleness(seconds), _Staleness.spec, "update", "EventTime", initialState=keys)

    return _events(spark, sf_dir, build, ["user_id"], own_state=True, **more)


@query(f"""WITH l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
SELECT c_custkey AS user_id, ts FROM customer LEFT JOIN l ON user_id = c_custkey, m
WHERE ts IS NULL OR epoch(now) - epoch(ts) > {STALE_SECONDS}""")
def st05_stale(spark, sf_dir):
    """O-ST5: keys whose last check is older than five days, or never was; a timer of each key tells it as time passes."""
    told = stale_keys(spark, sf_dir).where("stale")
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id"))
    return told.join(keys, "user_id", "left_semi").select("user_id", "ts")


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def st06_dedup(spark, sf_dir):
    """O-ST6: repeats of a day are no-ops; keys are forgotten when the watermark has passed them."""

    def build(e):
        return timed(e).withWatermark("at", LATE).dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")

    return _events(spark, sf_dir, build)


def _jobs(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One account's open job: (event, seconds, amount); done when a later balance shows it, stale by age."""
    out = []
    job = state.get if state.exists else None
    if state.hasTimedOut:
        out.append((job[0], "stale"))
        job = None
        state.remove()
    else:
        rows = pd.concat(list(batches))
        for r in rows.sort_values(["at", "event_id"]).itertuples():
            at = r.at.timestamp()
            if job and at - job[1] > JOB_SECONDS:
                out.append((job[0], "stale"))
                job = None
            if job and r.event_type == "signup" and r.value >= job[2]:
                out.append((job[0], "credited"))
                job = None
            elif not job and r.event_type == "purchase":
                job = (int(r.event_id), at, float(r.value))
        if job:
            state.update(job)
            state.setTimeoutTimestamp(max(int((job[1] + JOB_SECONDS) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
    done = pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": [x for x, _ in out], "outcome": [x for _, x in out]})
    yield done.astype({"user_id": "int64", "event_id": "int64", "outcome": "object"})


@query()
def st07_payouts(spark, sf_dir):
    """O-ST7: reconciliation of payouts: an open job for each account, credited or stale, with a timer for the age."""

    def build(e):
        facts = e.where("event_type in ('purchase', 'signup') and value is not null")
        facts = timed(facts).withWatermark("at", "1 second")
        kept = facts.select("user_id", "event_id", "at", "event_type", "value").groupBy("user_id")
        return kept.applyInPandasWithState(_jobs, "user_id long, event_id long, outcome string", "event long, at double, amount double", "append", "EventTimeTimeout")

    return _events(spark, sf_dir, build)


class _FirstAlert(_Timed):
    """Writes an order's first alert and never another; what it remembers goes when the game is over."""

    spec = "o_orderkey long, alerted timestamp_ntz"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # orders with an alert, and when their game is over, in milliseconds
        self.told = handle.getValueState("told", "orders array<long>, over array<long>, timer long")

    def _get(self) -> tuple[np.ndarray, np.ndarray, int]:
        orders, over, timer = self.told.get() if self.told.exists() else ([], [], 0)
        return np.array(orders, np.int64), np.array(over, np.int64), timer

    def _put(self, orders: np.ndarray, over: np.ndarray, timer: int) -> None:
        timer = self.set(over, timer)
        self.told.update((orders.tolist(), over.tolist(), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        orders, over, timer = self._get()
        kept = {"ts": "min", "over": "first"}
        firsts = pd.concat([part.groupby("o_orderkey").agg(kept) for part in rows]).groupby(level=0).agg(kept)
        new = firsts[~firsts.index.isin(orders)]
        if new.empty:
            return
        keys = new.index.to_numpy(np.int64)
        self._put(np.append(orders, keys), np.append(over, new["over"].to_numpy(np.int64)), timer)
        yield pd.DataFrame({"o_orderkey": keys, "alerted": micros(new["ts"]).astype("datetime64[us]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        orders, over, timer = self._get()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if fired == timer:
            left = over >= max(fired + 1, timerValues.getCurrentWatermarkInMs())
            if left.any():
                self._put(orders[left], over[left], 0)  # the timer that fired goes by itself
            else:
                self.told.clear()
        yield from ()


def first_alerts(spark, sf_dir, **more) -> DataFrame:
    """o_orderkey, alerted: each open order's first alert, written in the batch that brings it."""
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    side = F.when(F.col("o_orderkey") % 2 == 0, "home").otherwise("away")
    held = held.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").alias("user_id"), side.alias("side"), day_of_2024(10 + F.col("o_custkey") % 15).alias("over"))

    def build(e):
        n = F.col("event_id")
        live = timed(e).withWatermark("at", LATE)
        live = live.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "at", (7 + n % 3).alias("inning"), (n * 7 % 12).alias("home"), (n * 11 % 12).alias("away"), (8.0 + n % 4).alias("total"))
        out = stop_loss(F.col("side"), F.col("inning"), F.col("home"), F.col("away"), F.col("total"))
        # rows that ask for no alert, and games that are over, don't reach the state
        asks = live.join(held, "user_id").where(out & (F.col("at") < F.col("over")))
        asks = asks.select(state_of("o_orderkey"), "o_orderkey", "ts", "at", F.unix_millis("over").alias("over"))
        return asks.groupBy("state").transformWithStateInPandas(_FirstAlert(), _FirstAlert.spec, "append", "EventTime")

    return _events(spark, sf_dir, build, own_state=True, **more)


@query("""WITH s AS (SELECT user_id, ts, 7 + event_id % 3 AS inning, event_id * 7 % 12 AS home, event_id * 11 % 12 AS away,
8e0 + event_id % 4 AS total FROM events),
o AS (SELECT o_orderkey, o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'home' ELSE 'away' END AS side,
TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(10 + o_custkey % 15 AS BIGINT) AS over FROM orders WHERE o_orderstatus = 'O'),
j AS (SELECT o_orderkey, ts, CASE WHEN side = 'home' THEN away - home ELSE home - away END AS behind,
CASE inning WHEN 7 THEN 5 WHEN 8 THEN 4 ELSE 3 END + CASE WHEN total >= 10 THEN 1 ELSE 0 END AS need FROM o JOIN s USING (user_id) WHERE ts < over)
SELECT o_orderkey, min(ts) AS alerted FROM j WHERE behind > 0 AND behind >= need GROUP BY 1""")
def st08_alerts(spark, sf_dir):
    """O-ST8, O-F14: stop-loss alerts of open orders on live games, one for each order, at its first moment."""
    return first_alerts(spark, sf_dir)


@query("""SELECT user_id, CAST(ts AS DATE) AS day, arg_min(value, struct_pack(ts, event_id)) AS first_value,
round(arg_max(value, struct_pack(ts, event_id)) - arg_min(value, struct_pack(ts, event_id)), 6) AS change
FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def st09_daily(spark, sf_dir):
    """O-ST9: first balance of each account's day and the change since; a day's state goes with the watermark."""

    def build(e):
        by = timed(e.where("value is not null")).withWatermark("at", LATE).groupBy(F.window("at", "1 day"), "day", "user_id")
        ends = by.agg(F.min_by("value", newest()).alias("first_value"), F.max_by("value", newest()).alias("last"))
        return ends.select("user_id", "day", "first_value", F.round(F.col("last") - F.col("first_value"), 6).alias("change"))

    return _events(spark, sf_dir, build, ["user_id", "day"])


@query("""SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2""")
def st10_windows(spark, sf_dir):
    """O-ST9: counts and sums of a stream's days by type."""

    def build(e):
        by = timed(e).withWatermark("at", LATE).groupBy(F.window("at", "1 day"), "day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
        return by.select("day", "event_type", "n", "v")

    return _events(spark, sf_dir, build, ["day", "event_type"])
