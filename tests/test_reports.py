"""Reports, box scores and Sharpe stakes against SQL, pinned figures and searches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.plans import reports
from tallyfield.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a19_performance", "q05_report", "io07_box", "p01_sharpe", "w21_ledger", "e13_quantile_rule", "a18_median_split"])
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(map(tuple, got.select(*cols).collect())) == plain(con.execute(f"select {', '.join(cols)} from ({ORACLES[name]}) t").fetchall())


ORDERS = "game_pk long, side string, home_win int, model_prob double, market double, status string, stake double, contracts double, booked double"


def test_settled_orders(spark):
    rows = [
        (1, "home", 1, 0.6, 0.55, "filled", 10.0, 18.0, None),  # won: 18 back for 10
        (2, "away", 1, 0.42, 0.5, "filled", 12.0, None, None),  # lost
        (3, "away", 0, 0.4, 0.6, "filled", 4.0, None, None),  # won at the market's odds of the away side
        (4, "home", 1, 0.4, 0.0, "filled", 4.0, None, None),  # no probability: the stake comes back
        (5, "away", 0, 0.4, 1.0, "filled", 4.0, None, None),
        (6, "home", 1, 0.4, 0.5, "exited", 4.0, None, None),  # ended early, nothing booked: lost, whatever the game
        (7, "home", 0, 0.4, 0.5, "stopped", 4.0, None, 1.5),
        (8, "home", 0, 0.4, 0.5, "filled", 4.0, None, 2.0),  # a booked profit stands
        (9, "home", 1, 0.4, 0.5, "voided", 4.0, None, None),
        (10, "home", 1, 0.4, 0.5, "filled", 0.0, None, None),
    ]
    got = {r["game_pk"]: (r["won"], round(r["pnl"], 6)) for r in reports.settled(spark.createDataFrame(rows, ORDERS)).collect()}
    assert got == {1: (True, 8.0), 2: (False, -12.0), 3: (True, 6.0), 4: (True, 0.0), 5: (True, 0.0), 6: (False, -4.0), 7: (True, 1.5), 8: (False, 2.0)}
    two = reports.settled(spark.createDataFrame(rows[:2], ORDERS)).agg(F.round(100 * F.sum("pnl") / F.sum("stake"), 2).alias("roi")).first()
    assert two["roi"] == -18.18


def test_readiness_of_no_rows_and_of_many_examples(spark):
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(i), 1, 0.5, None if i % 2 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "game_pk long, game_date date, home_win int, market double, x double")
    said = reports.readiness(df, {"odd": F.expr("x is null"), "never": F.expr("market > 1")}, ["home_win", "market"], ["x"])
    told = {(r["section"], r["name"]): r for r in said.collect()}
    assert told["rows", "ready"]["n"] == 40 and told["null_rate", "x"]["share"] == 0.5 and ("all_null", "x") not in told
    odd = told["issue", "odd"]
    assert (odd["n"], odd["first_day"], odd["last_day"], odd["examples"]) == (20, dt.date(2024, 1, 2), dt.date(2024, 2, 9), "1,3,5,7,9,11,13,15,17,19")
    assert told["issue", "never"]["n"] == 0 and told["issue", "never"]["examples"] is None
    none = {(r["section"], r["name"]): r["n"] for r in reports.readiness(df.limit(0), {"odd": F.expr("x is null")}, ["home_win"], ["x"]).collect()}
    assert none["rows", "raw"] == 0 and none["issue", "odd"] == 0


def test_boxes_that_are_broken_or_of_other_types(spark):
    docs = [(1, None), (2, "{"), (3, "[]"), (4, '{"gameData": {"status": 5, "venue": {"elevation": "high", "roofType": "DOME"}}, "home": {"players": {"ID7": {"battingOrder": "901"}, "ID8": {"battingOrder": "100", "batSide": {"code": "S"}, "position": {"abbreviation": "C"}}, "ID9": {}}, "pitchers": [{"id": 3, "stats": {"inningsPitched": "1.2"}}, null, {"id": "4"}]}}')]
    got = {r["game_pk"]: r for r in reports.flat_boxes(spark.createDataFrame(docs, "game_pk long, doc string")).collect()}
    assert len(got) == 4 and all(got[k]["lhb"] is None and got[k]["pitchers"] == 0 for k in (1, 2, 3))
    r = got[4]
    assert (r["elevation"], r["roof_possible"], r["roof_closed"], r["lhb"], r["rhb"], r["catcher"], r["pitchers"], r["starter"], r["outs"]) == (None, 1.0, 1.0, 0.5, 0.5, 8, 3, 3, 5)


@pytest.mark.parametrize("rho", [0.0, 0.1, 0.5])
def test_sharpe_stakes_are_the_best(spark, rho):
    """No other stakes of a slate have a greater ratio of mean to deviation."""
    rng = np.random.default_rng(int(rho * 10))
    rows = [(s, 100 * s + i, float(p), float(round((1 / p) * rng.uniform(0.85, 1.3), 3))) for s in range(12) for i, p in enumerate(rng.uniform(0.2, 0.8, rng.integers(1, 9)))]
    got = reports.sharpe_stakes(spark.createDataFrame(rows, "slate long, game_pk long, prob double, decimal double"), "slate", rho).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("slate"):
        mu, sigma, w = (g[c].to_numpy() for c in ("mu", "sigma", "stake"))
        cov = np.outer(sigma, sigma) * (rho + (1 - rho) * np.eye(len(g)))
        ratio = lambda x: x @ mu / np.sqrt(max(x @ cov @ x, 1e-300))  # noqa: E731, B023
        assert w.min() >= 0 and w.max() <= reports.MOST + 1e-12 and w.sum() <= reports.CAP + 1e-12
        if mu.max() <= 0:
            assert w.sum() == 0
            continue
        assert abs(w.max() - reports.MOST) < 1e-9 or abs(w.sum() - reports.CAP) < 1e-9
        # first-order conditions: the gradient is none where there is a stake, and not upward where there is none
        lead = (cov @ w) * (w @ mu) / (w @ cov @ w)
        assert np.allclose(mu[w > 0], lead[w > 0], atol=1e-9) and (mu[w == 0] <= lead[w == 0] + 1e-9).all()
        for _ in range(50):
            assert ratio(np.clip(w * rng.uniform(0.5, 1.5, len(w)) + rng.uniform(0, 0.01, len(w)) * (rng.random(len(w)) < 0.3), 0, None)) <= ratio(w) + 1e-9


def test_boxes_are_made_and_parsed_once(spark):
    """One scan of each table and one parse; a document of neither players nor pitchers keeps its row."""
    plan = QUERIES["io07_box"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem.parquet") <= 1 and plan.lower().count("parse_json") + plan.count("parseJson") == 1
    docs = [(1, None), (2, "{"), (3, '{"home": {"players": {}, "pitchers": [], "bench": [1, 2]}}'), (4, '{"gameData": {"status": "F"}, "home": {"pitchers": [{"id": 7, "stats": {"inningsPitched": "1.2", "pitches": 9}}, null]}}')]
    got = {r["game_pk"]: r for r in reports.flat_boxes(spark.createDataFrame(docs, "game_pk long, doc string")).collect()}
    assert set(got) == {1, 2, 3, 4} and all(got[k]["pitchers"] == 0 and got[k]["lhb"] is None and got[k]["outs"] is None for k in (1, 2, 3))
    assert (got[4]["pitchers"], got[4]["starter"], got[4]["outs"], got[4]["pitches"], got[4]["status"]) == (2, 7, 5, 9, "F")
