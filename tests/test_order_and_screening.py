"""Global numbers, ordered folds, exact quantiles, Gram matrices, permutations and stacks against plain versions."""

from math import floor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators.gram import correlations
from tallyfield.operators.order import numbered, ordered_fold
from tallyfield.operators.quantiles import exact_quantiles
from tallyfield.plans import learning
from tallyfield.plans.market import next_bank

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def examples(spark):
    return learning.examples(spark, SF).cache()


def test_numbers_are_the_global_order(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 11).alias("a"), F.xxhash64("id").alias("b"), "id")
    got = numbered(rows, ["a", "b"], "n")
    want = sorted((r["a"], r["b"], r["id"]) for r in rows.collect())
    assert [(r["a"], r["b"], r["id"], r["n"]) for r in got.orderBy("n").collect()] == [(*w, i) for i, w in enumerate(want, 1)]
    assert numbered(rows.limit(0), ["a", "b"]).count() == 0


def test_ledger_of_a_million_bets(spark):
    u = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    bets = spark.range(1_000_000).select((F.col("id") % 1000 == 7).alias("small"), "id", (u * 0.05).alias("f"), F.when(u * 7 % 1 < 0.52, u + 0.4).otherwise(-1.0).alias("r"))
    got = {r["small"]: (r["n"], r["state"]) for r in ordered_fold(bets, ["small"], ["id"], ["f", "r"], 100_000, next_bank).collect()}
    want = {True: (0, 100_000), False: (0, 100_000)}
    rows = bets.orderBy("id").toPandas()
    for small, f, r in zip(rows["small"].tolist(), rows["f"].tolist(), rows["r"].tolist(), strict=True):
        n, cents = want[small]
        want[small] = n + 1, cents + floor(floor(cents * f + 0.5) * r + 0.5)
    assert got == want


def test_fold_with_every_step_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 2, 5), (None, 1, None), ("a", 1, 1), ("a", 2, 2)], "k string, o int, v long")
    step = lambda s, v: s * 2 + (v or 0)
    got = ordered_fold(rows, ["k"], ["o"], ["v"], 1, step, every=True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, 1, 1, 2), (None, 2, 2, 9), ("a", 1, 1, 3), ("a", 2, 2, 8)], key=repr)
    assert ordered_fold(rows.limit(0), ["k"], ["o"], ["v"], 1, step).count() == 0


def test_quantiles_are_exact(spark):
    rows = spark.range(2_000_000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") / 1e9).alias("v"))
    ties = spark.range(50_000).select(F.lit(9).cast("long").alias("g"), F.when(F.col("id") % 5 > 0, (F.col("id") % 4).cast("double")).alias("v"))
    few = spark.createDataFrame([(10, 3.0), (10, 1.0), (11, 2.5), (12, None)], "g long, v double")
    both = rows.unionByName(ties).unionByName(few)
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(both, "v", probs, ["g"]).collect()}
    want = {(g, p): np.quantile(v.dropna(), p) for g, v in both.toPandas().groupby("g")["v"] if v.notna().any() for p in probs}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)
    whole = {r["prob"]: r["quantile"] for r in exact_quantiles(rows, "v", [0.25]).collect()}
    assert whole == pytest.approx({0.25: np.quantile(rows.toPandas()["v"], 0.25)})
    assert exact_quantiles(rows.limit(0), "v", [0.5]).count() == 0


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(4)
    n, d = 1200, 300
    x = rng.normal(size=(n, 20)) @ rng.normal(size=(20, d)) + rng.normal(size=(n, d)) + 1e6
    x[rng.random((n, d)) < 0.3] = np.nan
    x[:, 5] = 7.5
    x[100:, 6] = np.nan
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(d)])
    got = correlations(spark.createDataFrame(frame).repartition(5), list(frame.columns)).toPandas()
    want = frame.corr(min_periods=100)
    assert len(got) == d * (d - 1) // 2
    r = np.array([want.at[a, b] for a, b in zip(got["first"], got["second"], strict=True)])
    flat = (got["first"] == "c5") | (got["second"] == "c5")
    assert got["r"][flat].isna().all()
    mine, theirs = got["r"][~flat].to_numpy(float), r[~flat.to_numpy()]
    assert (np.isnan(mine) == np.isnan(theirs)).all() and np.nanmax(np.abs(mine - theirs)) < 1e-6
    assert np.isnan(mine[(got["first"] == "c6")[~flat].to_numpy()]).all()


def test_prune_ignores_pairs_with_few_rows(spark):
    rows = [(float(i), float(i) if i < 50 else None, float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    assert set(learning.prune(df, ["a", "b"], "y")) == {"a", "b"}
    assert len(learning.prune(df, ["a", "b"], "y", least=10)) == 1


def test_permutation_equals_numpy(spark, examples):
    """The same orders in numpy, scored by the model's weights."""
    from pyspark.ml.classification import LogisticRegression

    first = learning.seasons(examples)[-3]
    model = LogisticRegression(regParam=0.01, maxIter=50).fit(learning._vector(examples.where(F.col("year") < first)))
    late = examples.where(F.col("year") >= first)
    got = {r["feature"]: (r["increase"], r["spread"]) for r in learning.permutation_importance(model, late, learning.FEATURES, "game_pk").collect()}
    hashes = late.select("game_pk", "label", *learning.FEATURES, *[F.xxhash64("game_pk", F.lit(i)).alias(f"h{i}") for i in range(6)]).toPandas()
    w, b = model.coefficients.toArray(), model.intercept
    y = hashes["label"].to_numpy()

    def loss(x):
        p = np.clip(1 / (1 + np.exp(-(x @ w + b))), 1e-6, 1 - 1e-6)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    x = hashes[learning.FEATURES].to_numpy()
    orders = [np.lexsort((hashes["game_pk"], hashes[f"h{i}"])) for i in range(6)]
    for j, feature in enumerate(learning.FEATURES):
        grown = []
        for o in orders[1:]:
            other = x.copy()
            other[orders[0], j] = x[o, j]
            grown.append(loss(other) - loss(x))
        assert got[feature] == pytest.approx((np.mean(grown), np.std(grown)), abs=1e-9)


def newton(x, y, ridge):
    """Weights of a logistic regression with a ridge on all but the intercept."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    d = np.diag([ridge] * (len(w) - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(x) + d, x.T @ (p - y) / len(x) + d @ w)
    return w


def test_stack_sees_only_scores_of_models_that_had_not_seen_the_row(spark, examples):
    years = learning.seasons(examples)[2:5]
    x = examples.where(F.col("year") <= years[-1])
    folds = learning.out_of_fold(x, years)
    assert folds.count() == x.where(F.col("year").isin(years)).count() and folds.where("p_linear is null or p_trees is null").count() == 0
    # a base score of a season doesn't change with that season's answers, nor with later ones
    other = learning.out_of_fold(x.withColumn("label", F.when(F.col("year") < years[1], F.col("label")).otherwise(1 - F.col("label"))), [years[1]])
    a, b = (f.where(F.col("year") == years[1]).select("game_pk", "p_linear", "p_trees").orderBy("game_pk").toPandas().to_numpy(float) for f in (folds, other))
    assert np.allclose(a, b, atol=1e-9)
    told = learning.stacked(folds.withColumn("market", F.when(F.col("game_pk") % 97 > 0, F.col("market"))), years[1:]).toPandas()
    rows = folds.toPandas()
    rows.loc[rows["game_pk"] % 97 == 0, "market"] = rows["p_linear"]
    for year in years[1:]:
        train, late = rows[rows["year"] < year], rows[rows["year"] == year].sort_values("game_pk")
        w = newton(train[["p_linear", "p_trees", "market"]].to_numpy(), train["label"].to_numpy(), 0.01)
        p = 1 / (1 + np.exp(-(late[["p_linear", "p_trees", "market"]].to_numpy() @ w[:-1] + w[-1])))
        mine = told[told["year"] == year].sort_values("game_pk")["p_stacked"].to_numpy()
        assert len(mine) == len(p) and np.abs(mine - p).max() < 1e-4
    few = learning.stacked(folds, [years[1]], least=10**9).toPandas()
    assert np.allclose(few["p_stacked"], few[["p_linear", "p_trees", "p_market"]].mean(axis=1))
