"""Models, calibration, uncertainty and feature screening at table scale (O-E3, E5..E7, E14..E18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyfield.functions.odds import logit
from tallyfield.operators.gram import correlations
from tallyfield.operators.order import numbered, stored
from tallyfield.plans.base import query
from tallyfield.plans.market import O_SQL, priced
from tallyfield.plans.views import LOG_SQL, games, team_log
from tallyfield.session import table

FEATURES = ["market", "move", "prior"]
SEASONS_BACK = 2  # seasons before the first fold
LATE = 3  # last seasons, which calibrated and offset models are scored on


def examples(spark, sf_dir) -> DataFrame:
    """Settled games with three features, a label and the fold start they belong to."""
    g = priced(spark, sf_dir).where("home_win is not null")
    return g.select("game_pk", "game_date", F.year("game_date").alias("year"), F.col("home_win").cast("double").alias("label"), "market", (F.col("ch") - F.col("oh")).alias("move"), F.col("model_prob").alias("prior"))


def seasons(x: DataFrame) -> list[int]:
    """The seasons that the data have (one row each comes to the driver)."""
    return sorted(r["year"] for r in x.select("year").distinct().collect())


def log_loss(p: str):
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    return F.round(F.avg(-(F.col("label") * F.log(c) + (1 - F.col("label")) * F.log(1 - c))), 6)


def _positive(scored: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return scored.withColumn("p", vector_to_array("probability")[1])


def _vector(df: DataFrame, cols=FEATURES) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


@query()
def e03_trees(spark, sf_dir):
    """O-E3, E18: boosted trees by fold, importances averaged over the folds."""
    from pyspark.ml.classification import GBTClassifier

    x = _vector(stored(examples(spark, sf_dir)))
    gains, out = [], None
    for year in seasons(x)[SEASONS_BACK:]:
        model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(x.where(F.col("year") < year))
        gains.append(model.featureImportances.toArray())
        s = _positive(model.transform(x.where(F.col("year") == year))).agg(F.count("*").alias("n"), log_loss("p").alias("value")).select(F.lit(f"log loss {year}").alias("what"), "n", "value")
        out = s if out is None else out.unionByName(s)
    mean = [(f"gain {c}", len(gains), round(float(sum(g[i] for g in gains) / len(gains)), 6)) for i, c in enumerate(FEATURES)]
    return out.unionByName(spark.createDataFrame(mean, "what string, n long, value double"))


@query()
def e05_offset(spark, sf_dir):
    """O-E5: what the features add to the market's logit."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    x = _vector(stored(examples(spark, sf_dir)).withColumn("offset", logit(F.col("market"))), ["move", "prior"])
    first = seasons(x)[-LATE:][0]
    model = GeneralizedLinearRegression(family="binomial", link="logit", offsetCol="offset", regParam=0.01, maxIter=15).fit(x.where(F.col("year") < first))
    return model.transform(x.where(F.col("year") >= first)).groupBy("year").agg(F.count("*").alias("n"), log_loss("prediction").alias("log_loss"), log_loss("market").alias("market_loss"))


@query()
def e06_calibration(spark, sf_dir):
    """O-E6: isotonic and Platt maps, fitted on the years before and applied to later ones."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import IsotonicRegression

    x = stored(examples(spark, sf_dir)).withColumn("z", logit(F.col("prior")))
    first = seasons(x)[-LATE:][0]
    train, later = x.where(F.col("year") < first), x.where(F.col("year") >= first)
    iso = IsotonicRegression(featuresCol="prior").fit(train).transform(later).withColumnRenamed("prediction", "isotonic")
    platt = LogisticRegression().fit(_vector(train, ["z"])).transform(_vector(iso, ["z"]))
    return _positive(platt).groupBy("year").agg(F.count("*").alias("n"), log_loss("prior").alias("raw"), log_loss("isotonic").alias("isotonic"), log_loss("p").alias("platt"))


@query(f"""{O_SQL}, {LOG_SQL}, c AS (SELECT game_pk, row_number() OVER (PARTITION BY team, season ORDER BY game_date, game_pk) - 1 AS played FROM l), e AS (SELECT game_pk, min(played) < 20 AS early FROM c GROUP BY 1),
r AS (SELECT early, CASE WHEN early THEN 0.5e0 * (model_prob + market) ELSE model_prob END AS p, home_win AS y FROM k JOIN e USING (game_pk) WHERE home_win IS NOT NULL) SELECT early, CAST(count(*) AS BIGINT) AS n, round(avg((p - y) * (p - y)), 9) AS brier FROM r GROUP BY early""")
def e07_routing(spark, sf_dir):
    """O-E7: games early in either side's season use another score."""
    w = Window.partitionBy("team", "season").orderBy("game_date", "game_pk")
    early = team_log(games(spark, sf_dir)).select("game_pk", (F.row_number().over(w) - 1).alias("played")).groupBy("game_pk").agg((F.min("played") < 20).alias("early"))
    x = examples(spark, sf_dir).join(early, "game_pk")
    d = F.when(F.col("early"), 0.5 * (F.col("prior") + F.col("market"))).otherwise(F.col("prior")) - F.col("label")
    return x.groupBy("early").agg(F.count("*").alias("n"), F.round(F.avg(d * d), 9).alias("brier"))


#: Cumulative odds of a Poisson count with mean 1.
POISSON = [0.367879, 0.735759, 0.919699, 0.981012, 0.996340]


@query(f"""{O_SQL}, rep AS (SELECT home_team AS team, home_win AS y, b, CAST('0x' || substr(md5(CAST(game_pk AS VARCHAR) || ':' || CAST(b AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM k, generate_series(0, 7) t(b) WHERE home_win IS NOT NULL),
drawn AS (SELECT team, b, y, {' + '.join(f'CASE WHEN u >= {x} THEN 1 ELSE 0 END' for x in POISSON)} AS n FROM rep), each AS (SELECT team, b, sum(n * y) / CAST(sum(n) AS DOUBLE) AS p FROM drawn GROUP BY 1, 2 HAVING sum(n) > 0)
SELECT team, round(avg(p), 9) AS mean, round(stddev_pop(p), 9) AS std, abs(avg(p) - 0.48e0) - stddev_pop(p) > 0.01e0 AS bet, round(1 / (1 + 5 * stddev_pop(p)), 9) AS damp FROM each GROUP BY team""")
def e14_bootstrap(spark, sf_dir):
    """O-E14: mean and spread over bootstrap replicas by Poisson weights from a hash; edge less spread; damped stake."""
    g = games(spark, sf_dir).where("home_win is not null").select(F.col("home_team").alias("team"), F.col("home_win").alias("y"), "game_pk", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "game_pk", "b")), 1, 8), 16, 10).cast("double") / 4294967296.0
    g = g.withColumn("u", u).withColumn("n", sum(((F.col("u") >= x).cast("int") for x in POISSON[1:]), (F.col("u") >= POISSON[0]).cast("int")))
    m = g.groupBy("team", "b").agg(F.sum(F.col("n") * F.col("y")).alias("s"), F.sum("n").alias("n")).where("n > 0").withColumn("p", F.col("s") / F.col("n"))
    r = m.groupBy("team").agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("s"))
    return r.select("team", F.round("m", 9).alias("mean"), F.round("s", 9).alias("std"), (F.abs(F.col("m") - 0.48) - F.col("s") > 0.01).alias("bet"), F.round(1 / (1 + 5 * F.col("s")), 9).alias("damp"))


@query()
def e14_refits(spark, sf_dir):
    """O-E14: a model refitted on eight Poisson-weighted replicas; mean and spread of its scores, edge less spread, damped stake.

    The replicas' weights come from a hash of the game, so no rows are drawn or copied; all models score in one pass.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    x = _vector(stored(examples(spark, sf_dir)))
    first = seasons(x)[-LATE:][0]
    train, later = x.where(F.col("year") < first), x.where(F.col("year") >= first)
    scores, at = [], vector_to_array(F.col("features"))
    for b in range(8):
        u = F.conv(F.substring(F.md5(F.concat_ws(":", "game_pk", F.lit(b))), 1, 8), 16, 10).cast("double") / 4294967296.0
        n = sum(((u >= x_).cast("double") for x_ in POISSON[1:]), (u >= POISSON[0]).cast("double"))
        model = LogisticRegression(regParam=0.01, maxIter=15, weightCol="n").fit(train.withColumn("n", n).where("n > 0"))
        margin = sum((float(w) * F.col("at")[i] for i, w in enumerate(model.coefficients.toArray())), F.lit(float(model.intercept)))
        scores.append(1 / (1 + F.exp(-margin)))
    told = later.withColumn("at", at).select("game_pk", "market", F.array(*scores).alias("p"))
    total = lambda of: F.aggregate(F.transform("p", of), F.lit(0.0), lambda s, v: s + v)
    told = told.withColumn("mean", total(lambda v: v) / len(scores))
    told = told.withColumn("std", F.sqrt(total(lambda v: (v - F.col("mean")) * (v - F.col("mean"))) / len(scores)))
    bet = F.abs(F.col("mean") - F.col("market")) - F.col("std") > 0.05
    return told.select("game_pk", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), bet.alias("bet"), F.round(1 / (1 + 5 * F.col("std")), 6).alias("damp"))


def prune(df: DataFrame, cols: list[str], target: str, threshold: float = 0.85, least: int = 100) -> list[str]:
    """Columns by their correlation with the target, without those too close to one already kept.

    All pairs come from one pass; only the matrix, one number a pair, is walked here.  NULLs drop out pair by
    pair; pairs with fewer than ``least`` rows in common and constant columns count as uncorrelated.
    """
    r = {frozenset((x["first"], x["second"])): abs(x["r"] or 0.0) for x in correlations(df, [*cols, target], least).collect()}
    kept: list[str] = []
    for c in sorted(cols, key=lambda c: (-r[frozenset((c, target))], c)):
        if all(r[frozenset((c, k))] < threshold for k in kept):
            kept.append(c)
    return kept


@query()
def e15_prune(spark, sf_dir):
    """O-E15: greedy prune of correlated columns."""
    l = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    kept = prune(l, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"], "y")
    return spark.createDataFrame(list(enumerate(kept, 1)), "place int, feature string")


#: Base models of the stack: their name, features and whether they are trees.
BASES = {"linear": (["move", "prior"], False), "trees": (["market", "move", "prior"], True)}


def out_of_fold(x: DataFrame, years: list[int]) -> DataFrame:
    """The rows of these seasons with each base model's score by a model that has seen earlier seasons only."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    out = None
    for year in years:
        train, rows = x.where(F.col("year") < year), x.where(F.col("year") == year)
        for name, (cols, trees) in BASES.items():
            learner = GBTClassifier(maxIter=5, maxDepth=3, seed=1) if trees else LogisticRegression(regParam=0.01, maxIter=50)
            scored = _positive(learner.fit(_vector(train, cols)).transform(_vector(rows, cols)))
            rows = scored.withColumnRenamed("p", f"p_{name}").drop("features", "rawPrediction", "probability", "prediction")
        out = rows if out is None else out.unionByName(rows)
    return stored(out)


def stacked(folds: DataFrame, years: list[int], least: int = 300) -> DataFrame:
    """``folds`` of these seasons with p_stacked: a second stage over the base scores and the market.

    For each season it learns from the out-of-fold scores of the seasons before, so nothing that it sees was
    scored by a model that knew the answer.  A missing market counts as the first base score.  With fewer
    than ``least`` rows to learn from the mean of base scores and market is taken.
    """
    from pyspark.ml.classification import LogisticRegression

    scores = [f"p_{name}" for name in BASES]
    folds = folds.withColumn("p_market", F.coalesce("market", scores[0]))
    second, out = LogisticRegression(regParam=0.01, standardization=False, maxIter=100, tol=1e-10), None
    known = {r["year"]: r["count"] for r in folds.groupBy("year").count().collect()}  # one row a season
    for year in years:
        rows = folds.where(F.col("year") == year)
        if sum(n for y, n in known.items() if y < year) < least:
            rows = rows.withColumn("p_stacked", sum((F.col(c) for c in scores), F.col("p_market")) / (len(scores) + 1))
        else:
            model = second.fit(_vector(folds.where(F.col("year") < year), [*scores, "p_market"]))
            rows = _positive(model.transform(_vector(rows, [*scores, "p_market"]))).withColumnRenamed("p", "p_stacked")
            rows = rows.drop("features", "rawPrediction", "probability", "prediction")
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def e08_stacked(spark, sf_dir):
    """O-E8: base models by walk-forward folds, their blend with the market, and a second stage over scores and market."""
    x = stored(examples(spark, sf_dir))
    years = seasons(x)[SEASONS_BACK:]
    told = stacked(out_of_fold(x, years), years[1:]).withColumn("p_blend", 0.5 * F.col("p_linear") + 0.5 * F.col("p_market"))
    return told.groupBy("year").agg(F.count("*").alias("n"), *[log_loss(f"p_{c}").alias(f"loss_{c}") for c in ("linear", "trees", "market", "blend", "stacked")])


@query()
def e16_stability(spark, sf_dir):
    """O-E16: features with a weight other than zero in at least half of the folds' L1 fits, recent seasons weighing more."""
    from pyspark.ml.classification import LogisticRegression

    x = _vector(stored(examples(spark, sf_dir)))
    years = seasons(x)[SEASONS_BACK:]
    x = x.withColumn("year", F.col("year").cast("double"))
    lasso = LogisticRegression(regParam=0.005, elasticNetParam=1.0, maxIter=20, weightCol="weight")
    # a season counts half as much as the one after it
    fits = [lasso.fit(x.where(F.col("year") < y).withColumn("weight", F.pow(F.lit(0.5), y - 1 - F.col("year")))).coefficients.toArray() for y in years]
    times = [(c, sum(int(abs(w[i]) > 1e-9) for w in fits)) for i, c in enumerate(FEATURES)]
    return spark.createDataFrame([(c, n, 2 * n >= len(years)) for c, n in times], "feature string, folds int, kept boolean")


def permutation_importance(model, rows: DataFrame, features: list[str], key: str, repeats: int = 5) -> DataFrame:
    """feature, increase, spread: how much a fitted model's log loss grows when a column is permuted over all rows.

    A repeat is one permutation: the rows by a hash of their key and the repeat's number.  All repeats are
    put in order in one shuffle, number 0 is the order in which they are dealt out again; a row of it meets
    its donor of each repeat by number.  All columns, repeats and the plain rows are then scored in one pass.
    """
    named = F.array(F.lit(""), *[F.lit(c) for c in features])
    slim = rows.select(F.col(key).alias("key"), "label", F.array(*features).alias("x"))
    copies = slim.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats)))).withColumn("h", F.xxhash64("key", "repeat"))
    ranked = numbered(copies, ["repeat", "h", "key"])
    # every repeat has as many rows, so a number tells the place in it
    size = rows.count()
    place = F.pmod(F.col("n") - 1, F.lit(max(size, 1))).alias("place")
    base = ranked.where("repeat = 0").select(place, "label", "x")
    donors = ranked.where("repeat > 0").select(place, "repeat", F.col("x").alias("given"))
    met = base.join(donors, "place")
    each = met.select("label", "repeat", "x", "given", F.posexplode(named).alias("of", "feature")).where("of > 0 or repeat = 1")
    swapped = each.select("label", "repeat", "feature", F.transform("x", lambda v, i: F.when(i + 1 == F.col("of"), F.get("given", i)).otherwise(v)).alias("x"))
    vector = swapped.select("label", "repeat", "feature", *[F.get("x", i).alias(c) for i, c in enumerate(features)])
    scored = _positive(model.transform(_vector(vector, features)))
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    loss = F.avg(-(F.col("label") * F.log(c) + (1 - F.col("label")) * F.log(1 - c)))
    by = scored.groupBy("feature", "repeat").agg(loss.alias("loss"))
    plain = by.where("feature = ''").select(F.col("loss").alias("plain"))  # one row
    grown = by.where("feature <> ''").crossJoin(F.broadcast(plain)).withColumn("d", F.col("loss") - F.col("plain"))
    return grown.groupBy("feature").agg(F.avg("d").alias("increase"), F.stddev_pop("d").alias("spread"))


@query()
def e17_permutation(spark, sf_dir):
    """O-E17: how much a fitted model's loss on the late seasons grows when a feature is permuted, five times."""
    from pyspark.ml.classification import LogisticRegression

    x = stored(examples(spark, sf_dir))
    first = seasons(x)[-LATE:][0]
    model = LogisticRegression(regParam=0.01, maxIter=50).fit(_vector(x.where(F.col("year") < first)))
    told = permutation_importance(model, x.where(F.col("year") >= first), FEATURES, "game_pk")
    return told.select("feature", F.round("increase", 9).alias("increase"), F.round("spread", 9).alias("spread"))
