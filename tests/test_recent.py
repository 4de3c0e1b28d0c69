"""Best keys of each day by the days before, against a plain search; what the w16 queries shuffle."""

import datetime as dt
import math
import random

import pytest

from tallyfield.operators import recent
from tallyfield.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("share, block", [(512, 256), (2, 40)])
def test_candidates_hold_the_best_two(spark, monkeypatch, share, block):
    """Shares and blocks of any size: ties, gaps of years, days before 1970, NaN and keys of one play."""
    monkeypatch.setattr(recent, "SHARE", share)
    monkeypatch.setattr(recent, "BLOCK_DAYS", block)
    rng, start = random.Random(5), dt.date(1969, 11, 20)
    days = [start + dt.timedelta(days=i) for i in range(90)] + [dt.date(2400, 1, 1), dt.date(2400, 1, 31), dt.date(2400, 2, 1)]
    plays = [(t, p, d, float(rng.randint(1, 3))) for t in (1, 2) for p in range(-3, 9) for d in rng.sample(days, 20) for _ in range(rng.randint(1, 2))]
    plays += [(3, 7, start, 1.0), (3, 9, start, math.nan), (3, 8, start, 5.0), (3, 5, None, 1.0), (None, 5, start, 1.0)]

    def best(ids, of):
        load = recent.trailing(of["load"], 30, 30)
        return recent.top(load, among=recent.trailing(of["n"], 30, 30) > 0, n=2), {"load": load}

    df = spark.createDataFrame(plays, "team int, p long, d date, load double").selectExpr("*", "1d AS n")
    sizes = df.groupBy("team").agg({"p": "count"}).selectExpr("team", "12L AS __keys")
    got = {}
    for r in recent.candidates(df, sizes, "team", "p", "d", ["load", "n"], 30, best, "load double").collect():
        got.setdefault((r["team"], r["day"]), []).append((r["load"], r["p"]))
    seen = set()
    for team, p, d, _ in plays:
        for k in range(1, 31) if team and d else ():
            day = d + dt.timedelta(days=k)
            if (team, day) not in seen:
                seen.add((team, day))
                sums = {}
                for t, q, e, load in plays:
                    if t == team and e and day - dt.timedelta(days=30) <= e < day:
                        sums[q] = sums.get(q, 0.0) + load
                order = lambda x: (-(math.inf if math.isnan(x[0]) else x[0]), x[1])
                want = sorted(((s, q) for q, s in sums.items()), key=order)[:2]
                have = sorted(got[team, day], key=order)
                assert repr(have[:2]) == repr(want) and len(have) <= 2 * 6 + 1
    assert set(got) == seen


@pytest.mark.parametrize("name", ["w16_roles", "w16_bullpen"])
def test_no_join_repeats_plays_for_each_day_after(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "date_sub" not in plan and "applyInArrow" in plan.replace("FlatMapGroupsInArrow", "applyInArrow")
