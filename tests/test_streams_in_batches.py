"""Streams over several files, one a batch, rows late and out of order: state, timers, snapshots."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallyfield.plans import streams
from tallyfield.registry import ORACLES, QUERIES
from tallyfield.sources.store import shared_folder
from tallyfield.streaming import run

SF = "/root/testdata/sf0.001"
FILES = 6


@pytest.fixture(scope="module")
def several(spark, tmp_path_factory):
    """The tables with events in files of five days each; a tenth of the last day's rows of a file come with the next."""
    top = tmp_path_factory.mktemp("several")
    for name in os.listdir(SF):
        if not name.startswith("events"):
            os.symlink(f"{SF}/{name}", f"{top}/{name}")
    os.mkdir(f"{top}/events.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet")
    day = F.dayofmonth("ts") - 1
    late = (day % 5 == 4) & (F.hour("ts") >= 12) & (F.col("event_id") % 10 == 3) & (day < 25)
    placed = events.withColumn("file", F.least(F.floor(day / 5) + late.cast("int"), F.lit(FILES - 1)))
    assert placed.where(late).count() > 3
    for i in range(FILES):
        placed.where(F.col("file") == i).drop("file").orderBy(F.desc("event_id")).coalesce(1).write.parquet(f"{top}/part{i}")
        part = next(f for f in os.listdir(f"{top}/part{i}") if f.endswith(".parquet"))
        shutil.move(f"{top}/part{i}/{part}", f"{top}/events.parquet/{i}.parquet")
        os.utime(f"{top}/events.parquet/{i}.parquet", (1_700_000_000 + 60 * i,) * 2)  # files are taken by age
        shutil.rmtree(f"{top}/part{i}")
    return str(top)


@pytest.fixture
def one_file_a_batch(monkeypatch):
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 1)


def plain(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


def twin(name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.execute(f'select * from ({ORACLES[name]}) t')


@pytest.mark.parametrize("name", ["st01_latest", "st02_map_state", "st03_marks", "st04_freeze", "st04_bounded", "st05_stale", "st06_dedup", "st09_daily", "st10_windows"])
def test_many_batches_give_what_sql_gives(spark, several, one_file_a_batch, name):
    want = twin(name)
    cols = [c[0] for c in want.description]
    assert plain(map(tuple, QUERIES[name](spark, several).select(*cols).collect())) == plain(want.fetchall())


def test_an_order_is_alerted_once_and_forgotten(spark, several, one_file_a_batch):
    progress = []
    rows = streams.first_alerts(spark, several, progress=progress).collect()
    want = dict(twin("st08_alerts").fetchall())
    assert len(progress) >= FILES and len(rows) == len({r["o_orderkey"] for r in rows})
    assert {r["o_orderkey"] for r in rows} == set(want)
    assert all(r["alerted"] >= want[r["o_orderkey"]] for r in rows)  # a late row changes no alert that is out
    held = [p["stateOperators"][-1]["numRowsTotal"] for p in progress]
    assert max(held) > 0 and held[-1] == 0


def test_frozen_values_leave_no_state(spark, several, one_file_a_batch):
    progress = []
    _, told = streams.frozen_values(spark, several, progress=progress)
    assert told.count() > 0 and max(p["stateOperators"][-1]["numRowsTotal"] for p in progress) > 0
    assert progress[-1]["stateOperators"][-1]["numRowsTotal"] == 0


def test_a_key_is_told_stale_in_the_batch_in_which_it_becomes_so(spark, several, one_file_a_batch, monkeypatch):
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    streams.stale_keys(spark, several, seconds=86400, checks_are="event_type = 'signup'", compact_every=1000).count()
    base = shared_folder(spark).removeprefix("file:")
    (stream,) = [d for d in set(os.listdir(base)) - before if d.startswith("stream-")]
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/{stream}/out").select("batch", "user_id", "ts", "stale").collect()]
    never = {u for b, u, ts, stale in rows if ts is None}
    assert never and {b for b, u, ts, stale in rows if ts is None} == {1}  # once there is a time at all, without input
    seen = {u for _, u, ts, _ in rows if ts is not None}
    again = [u for b, u, ts, stale in rows if stale and ts is not None and b < FILES]
    assert seen and again  # told while the stream went on, before its end
    for u in set(again):
        told = sorted((b, stale) for b, v, ts, stale in rows if v == u)
        assert all(x[1] != y[1] for x, y in zip(told, told[1:], strict=False))  # told at changes only


@pytest.mark.parametrize("every", [1, 2, 4])
def test_snapshots_hold_each_keys_newest_row(spark, several, every):
    def build(e):
        return e.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"))

    base = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(base))
    got = run.drain(spark, f"{several}/events.parquet", build, "update", ["user_id"], files_per_batch=1, compact_every=every)
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.max("event_id"), F.count("*")).collect()
    assert plain(map(tuple, got.collect())) == plain(map(tuple, want))
    (stream,) = [d for d in set(os.listdir(base)) - before if d.startswith("stream-")]
    left = [d for d in os.listdir(f"{base}/{stream}/out") if d.startswith("batch=")]
    kept = [d for d in os.listdir(f"{base}/{stream}/snapshots") if d.startswith("upto=")]
    assert len(left) == FILES % every and len(kept) == 1


def test_many_keys_share_a_state_for_staleness(spark, several, one_file_a_batch, monkeypatch):
    """Two states hold all keys; what is told is the same as with a key a state."""
    monkeypatch.setattr(streams, "STATES", 2)
    progress = []
    got = streams.stale_keys(spark, several, progress=progress).where("stale").select("user_id", "ts").collect()
    assert max(p["stateOperators"][-1]["numRowsTotal"] for p in progress) <= 2 * 2  # states and their timers
    keys = {r["c_custkey"] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    assert plain(tuple(r) for r in got if r["user_id"] in keys) == plain(twin("st05_stale").fetchall())


def test_many_orders_share_a_state_for_alerts(spark, several, one_file_a_batch, monkeypatch):
    """Two states hold all orders with an alert, and are empty when all games are over."""
    monkeypatch.setattr(streams, "STATES", 2)
    progress = []
    rows = streams.first_alerts(spark, several, progress=progress).collect()
    want = dict(twin("st08_alerts").fetchall())
    assert len(rows) == len(want) > 4 and {r["o_orderkey"] for r in rows} == set(want)
    held = [p["stateOperators"][-1]["numRowsTotal"] for p in progress]
    assert 0 < max(held) <= 2 * 2 and held[-1] == 0
