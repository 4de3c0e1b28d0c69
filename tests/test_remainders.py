"""The variants in ``remainders`` against their DuckDB twins and literal cases."""

import pytest
from pyspark.sql import functions as F

from tallyfield.plans import remainders as R
from tallyfield.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
HERE = sorted(n for n, f in QUERIES.items() if f.__module__ == R.__name__) + ["a18_median_split", "x09_air_density"]


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", HERE)
def test_query_matches_its_twin(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({ORACLES[name]}) t").fetchall()
    plain = lambda rows: sorted(repr([round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else str(v) for v in r]) for r in rows)
    have = plain(map(tuple, got.select(*cols).collect()))
    assert have and have == plain(want)


def test_live_text(spark):
    lit, none = F.lit, F.lit(None).cast("string")
    no_outs = F.lit(None).cast("int")
    told = [
        R.live_text(lit("Warmup"), lit("Live"), lit("Top"), lit("1st"), lit(0)),
        R.live_text(lit("In Progress"), lit("Live"), lit("Top"), lit("5th"), lit(1)),
        R.live_text(lit("In Progress"), lit("Live"), lit("Middle"), lit("5th"), lit(2)),
        R.live_text(none, lit("Live"), none, none, no_outs),
        R.live_text(lit(""), lit("Final"), none, none, no_outs),
        R.live_text(none, none, none, none, no_outs),
    ]
    assert list(spark.range(1).select(*told).first()) == ["Warmup", "Top 5th 1 out", "Middle 5th", "Live", "Final", ""]


def test_first_number(spark):
    got = spark.range(1).select(R.first_number(F.lit("n/a"), F.lit(None).cast("string"), F.lit("0.4")), R.first_number(F.lit(""))).first()
    assert list(got) == [0.4, None]


def test_refitted_models_agree_with_plain_fits(spark):
    """The replicas' scores against Newton's method on the same weights."""
    import hashlib

    import numpy as np

    from tallyfield.plans import learning as L

    rows = L.examples(spark, SF).toPandas()
    first = sorted(rows.year.unique())[-L.LATE]
    x, train = rows[L.FEATURES].to_numpy(float), (rows.year < first).to_numpy()
    y, scores = rows.label.to_numpy(float), []
    for b in range(8):
        u = np.array([int(hashlib.md5(f"{k}:{b}".encode()).hexdigest()[:8], 16) / 4294967296 for k in rows.game_pk])
        n = sum((u >= p).astype(float) for p in L.POISSON)[train]
        xt, yt = x[train], y[train]
        mean = np.average(xt, axis=0, weights=n)
        var = (n[:, None] * (xt - mean) ** 2).sum(0) / (n.sum() - 1)
        z = np.column_stack([np.ones(len(xt)), (xt - mean) / np.sqrt(var)])
        w = np.zeros(z.shape[1])
        ridge = np.diag([0.0, *[0.01] * (z.shape[1] - 1)])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ w))
            grad = z.T @ (n * (p - yt)) / n.sum() + ridge @ w
            w -= np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z / n.sum() + ridge, grad)
        scores.append(1 / (1 + np.exp(-(w[0] + (x[~train] - mean) / np.sqrt(var) @ w[1:]))))
    want = dict(zip(rows.game_pk[~train], zip(np.mean(scores, 0), np.std(scores, 0), strict=True), strict=True))
    got = QUERIES["e14_refits"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["mean"], r["std"]) == pytest.approx(want[r["game_pk"]], abs=2e-3)
