"""Literal fixtures for single operators, and the registered queries against DuckDB."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import odds as X
from tallyfield.functions import scalars as S
from tallyfield.operators import joins as J
from tallyfield.operators.quality import Contract, audit, broken_rules, check_sql, fingerprint
from tallyfield.operators.windows import prior, with_streak

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_odds(spark):
    lit = F.lit
    got = one(spark, X.implied(lit(-150.0)), X.implied(lit(120.0)), X.implied(lit(0.0)), X.implied(lit(float("nan"))), X.implied(lit(50.0), strict=True), X.decimal(lit(-200.0)), X.devig(lit(0.6), lit(0.5)), X.devig(lit(0.0), lit(0.0)))
    assert got == [0.6, pytest.approx(100 / 220), None, None, None, 1.5, pytest.approx(0.6 / 1.1), None]


def test_kelly_is_capped_and_never_negative(spark):
    got = one(spark, X.stake_fraction(F.lit(0.9), F.lit(2.0)), X.stake_fraction(F.lit(0.4), F.lit(2.0)), X.stake_fraction(F.lit(0.52), F.lit(2.0)))
    assert got == [0.05, 0.0, pytest.approx(0.02)]


def test_parses(spark):
    lit = F.lit
    got = one(spark, S.innings(lit("10.2")), S.innings(lit("10.1")), S.innings(lit("x")), S.percent(lit("23.1%")), S.percent(lit("n/a")), S.in_range(lit("112"), 10, 300), S.in_range(lit("0.392"), 10, 300), S.in_range(lit("bad"), 10, 300))
    assert got == [pytest.approx(32 / 3), pytest.approx(31 / 3), None, pytest.approx(0.231), None, 112.0, None, None]
    assert one(spark, S.fip(lit(1), lit(2), lit(1), lit(8), lit(10.0), 3.1))[0] == pytest.approx(3.7)
    assert one(spark, S.date_code(lit(dt.date(2026, 4, 27))), S.status(lit("Postponed: rain")), S.plain_name(lit("A & B-Co."))) == ["26APR27", "postponed", "a and b co"]


def test_streak_and_prior(spark):
    rows = [("a", i, w) for i, w in enumerate([1, 1, 0, 0, 0, 1])]
    df = with_streak(spark.createDataFrame(rows, "team string, day int, win int"), "win", ["team"], ["day"])
    df = df.withColumn("m", prior("avg", "win", ["team"], ["day"], 3, 2))
    got = [(r["streak"], r["m"]) for r in df.orderBy("day").collect()]
    assert [g[0] for g in got] == [0, 1, 2, -1, -2, -3]
    assert got[1][1] is None and got[2][1] == 1.0


def test_asof_takes_equal_times_and_upsert_follows_rules(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1)], "id int, k string, ts int")
    right = spark.createDataFrame([("k", 5, 50), ("k", 2, 20)], "k string, ts int, v int")
    got = {r["id"]: r["v"] for r in J.asof_backward(left, right, ["k"], "ts", ["v"]).collect()}
    assert got == {1: 50, 2: None}
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, a string, b string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "z")], "k int, a string, b string")
    got = sorted(map(tuple, J.upsert(old, new, ["k"], {"b": J.keep_old}).collect()))
    assert got == [(1, "a", None), (2, "b", "x"), (3, "c", "z")]


def test_contracts(spark):
    df = spark.createDataFrame([(100.0,), (5.0,), (None,), (250.0,), (400.0,)], "wrc double")
    rule = Contract("wrc", 10, 300, 0.5)
    assert [bool(r[0]) for r in df.select(F.size(broken_rules([rule])) > 0).collect()] == [False, True, False, False, True]
    assert audit(df, [rule]).first()["severity"] == "warning"
    assert df.where(check_sql(rule)).count() == 3


def test_fingerprint_ignores_order_and_sees_values(spark):
    f = lambda rows: fingerprint(spark.createDataFrame(rows, "k int, v string")).first()["fingerprint"]
    assert f([(1, "a"), (2, "b")]) == f([(2, "b"), (1, "a")]) != f([(1, "a"), (2, "c")])


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import glob

    import numpy as np
    import pandas as pd

    from tallyfield.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")

    def norm(d):
        text = lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v) else f"{float(v):.6g}" if isinstance(v, (int, float, np.number, np.bool_)) else str(v)[:10] if hasattr(v, "year") else str(v)
        d = d[sorted(d.columns)].apply(lambda c: c.map(text))
        return sorted(map(tuple, d.to_numpy().tolist()))

    for name in ("flagship", "w01_prior_windows", "w18_standings", "x04_bet_selection", "e10_roi", "m01_upsert", "j09_asof", "a09_profile", "q01_audit", "st09_daily"):
        assert norm(QUERIES[name](spark, SF).toPandas()) == norm(con.execute(ORACLES[name]).df()), name


def test_orders(spark):
    from tallyfield.functions.orders import final_result, payout, stop_loss

    lit = F.lit
    none = lit(None).cast("int")
    rule = lambda *x: stop_loss(lit("home"), *x)
    got = one(spark, rule(lit(7), lit(0), lit(5), lit(8)), rule(lit(7), lit(0), lit(5), lit(10)), rule(lit(6), lit(0), lit(9), lit(8)), rule(lit(10), lit(1), lit(4), lit(8)), rule(none, lit(0), lit(9), lit(8)), rule(lit(8), none, lit(4), lit(8)))
    assert got == [True, False, False, True, False, False]
    assert one(spark, payout(none, lit(10.0), lit(-2.5), lit(100)), payout(lit(3), lit(10.0), lit(1.0), lit(1)), payout(none, lit(10.0), lit(None).cast("double"), lit(250))) == [7.5, 3.0, 2.5]
    assert one(spark, final_result(lit("final"), lit(3), lit(3)), final_result(lit("final"), lit(3), lit(4)), final_result(lit("live"), lit(3), lit(4))) == [None, "away", None]


def test_rules_match_sql_too(spark):
    pytest.importorskip("duckdb")
    import duckdb

    from tallyfield.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("events", "orders", "customer", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("j05_worklist", "j19_market_codes", "f03_contract", "f14_stop_loss", "a07_mix_fit", "s05_oldest_due"):
        got = QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]}) t").fetchall()
        plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
        assert plain(map(tuple, got.select(*cols).collect())) == plain(want), name


def test_prune_keeps_one_of_close_columns(spark):
    from tallyfield.plans.learning import prune

    rows = [(float(i), float(i) * 2 + (i % 3) * 0.01, float(i * 7 % 11), float(i % 2), 1.0, None if i % 4 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, flat double, thin double")
    kept = prune(df, ["a", "b", "c", "flat", "thin"], "y", least=10)
    assert len({"a", "b", "thin"} & set(kept)) == 1 and {"c", "flat"} <= set(kept)


def test_routing_and_bootstrap_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tallyfield.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("e07_routing", "e14_bootstrap"):
        got = QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]}) t").fetchall()
        plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
        assert plain(map(tuple, got.select(*cols).collect())) == plain(want), name
