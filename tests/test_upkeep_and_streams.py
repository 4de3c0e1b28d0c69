"""Queries of upkeep and of streams against DuckDB, the payout stream against a plain fold, fingerprints."""

import datetime as dt

import pytest

from tallyfield.operators.quality import fingerprint
from tallyfield.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "customer", "lineitem", "part", "supplier", "nation", "region")
NAMES = [n for n, f in QUERIES.items() if f.__module__.endswith((".upkeep", ".streams", ".variants")) and n in ORACLES] + ["st02_live_state", "io02_open_schema", "r04_lineups", "w16_roles", "w17_travel"]


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f'select {", ".join(cols)} from ({ORACLES[name]}) t').fetchall()
    assert plain(map(tuple, got.select(*cols).collect())) == plain(want)


def test_payout_jobs_match_a_fold(spark):
    """Each account's facts in order: a purchase opens a job, a balance as high credits it, age makes it stale."""
    facts = spark.read.parquet(f"{SF}/events.parquet").where("event_type in ('purchase', 'signup') and value is not null").orderBy("ts", "event_id").collect()
    second = lambda t: t.replace(microsecond=0)
    job, want, end = {}, [], max(second(r["ts"]) for r in facts)
    age = dt.timedelta(days=3)
    for r in facts:
        u, t = r["user_id"], second(r["ts"])
        if u in job and t - job[u][1] > age:
            want.append((u, job.pop(u)[0], "stale"))
        if u in job and r["event_type"] == "signup" and r["value"] >= job[u][2]:
            want.append((u, job.pop(u)[0], "credited"))
        elif u not in job and r["event_type"] == "purchase":
            job[u] = (r["event_id"], t, r["value"])
    # the timer: what the watermark, a second behind the newest fact, has passed
    want += [(u, e, "stale") for u, (e, t, _) in job.items() if t + age < end - dt.timedelta(seconds=1)]
    got = [tuple(r) for r in QUERIES["st07_payouts"](spark, SF).select("user_id", "event_id", "outcome").collect()]
    assert sorted(got) == sorted(want) and {o for *_, o in got} == {"stale", "credited"}


def test_fingerprint_tells_where_a_null_is(spark):
    one = lambda rows: fingerprint(spark.createDataFrame(rows, "x string, y string")).first()["fingerprint"]
    a, b = (None, "a"), ("a", None)
    assert one([a]) != one([b]) and one([a, b]) == one([b, a]) and one([a]) != one([a, a])


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch, spark):
    from tallyfield.sources import store

    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://far:7077"

        def getConf(self):  # noqa: N802
            return Conf()

        def getCheckpointDir(self):  # noqa: N802
            return None

    with pytest.raises(RuntimeError):
        store.shared_folder(type("S", (), {"sparkContext": Context()})())


def test_ledger_is_an_ordered_fold(spark):
    """Bankrolls against plain arithmetic, bet by bet."""
    from decimal import ROUND_HALF_UP, Decimal

    from tallyfield.plans.market import priced

    cents = lambda x: float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    bank = {}
    for r in priced(spark, SF).where("r is not null").orderBy("game_date", "game_pk").collect():
        key = (r["home_team"], r["season"])
        had = bank.get(key, 1000.0)
        bank[key] = cents(had + cents(had * r["f"]) * r["r"])
    got = {(r["account"], r["season"]): r["bankroll"] for r in QUERIES["w21_ledger"](spark, SF).collect()}
    assert set(got) == set(bank) and all(abs(got[k] - bank[k]) <= 0.02 for k in got)


@pytest.mark.parametrize("name", ["e02_walk_forward", "e03_trees", "e08_stacked", "e05_offset", "e06_calibration", "e16_stability", "e17_permutation", "p01_slate"])
def test_models_run_and_agree_with_themselves(spark, name):
    """What is fitted has no SQL twin: rows are there, numbers are finite, and a second run gives the same."""
    first, second = ([tuple(r) for r in QUERIES[name](spark, SF).collect()] for _ in "ab")
    assert first and plain(first) == plain(second)
    assert all(v == v and abs(v) != float("inf") for r in first for v in r if isinstance(v, float))


def test_slate_stakes_are_the_best_allowed(spark):
    """No feasible change of a slate's stakes raises its expected log growth."""
    import numpy as np

    from tallyfield.plans.market import priced

    facts = {r["game_pk"]: (r["sp"], r["sd"] - 1) for r in priced(spark, SF).where("side is not null").select("game_pk", "sp", "sd").collect()}
    slates = {}
    for r in QUERIES["p01_slate"](spark, SF).collect():
        slates.setdefault(r["game_date"], []).append((r["stake"], *facts[r["game_pk"]]))
    rng = np.random.default_rng(3)
    for rows in list(slates.values())[:200]:
        f, p, b = (np.array(x) for x in zip(*rows, strict=True))
        growth = lambda x: float((p * np.log1p(x * b) + (1 - p) * np.log1p(-x)).sum())  # noqa: E731, B023
        assert f.min() >= 0 and f.max() <= 0.05 + 1e-9 and f.sum() <= 0.25 + 1e-6
        for _ in range(20):
            other = np.clip(f + rng.normal(0, 0.01, len(f)), 0, 0.05)
            other *= min(1.0, 0.25 / max(other.sum(), 1e-12))
            assert growth(other) <= growth(f) + 2e-5
