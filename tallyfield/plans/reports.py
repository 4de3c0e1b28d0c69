"""Performance of orders, readiness of the training rows, nested box scores, joint stakes by Sharpe ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfield.operators.windows import latest
from tallyfield.plans.base import query
from tallyfield.plans.market import O_SQL, priced
from tallyfield.session import table

#: States in which an order ended before its game did, and those that don't count.
EXITED, VOIDED = ["exited", "stopped"], ["voided", "cancelled"]


def orders_frame(spark, sf_dir) -> DataFrame:
    """Settled games as orders: some exited early or voided, some without contracts or a booked profit."""
    n, c = F.col("game_pk"), F.col
    o = priced(spark, sf_dir).where("side is not null and home_win is not null")
    status = F.when(n % 13 == 0, "voided").when(n % 11 == 0, "exited").otherwise("filled")
    stake = F.floor(c("model_prob") * 10) + 1.0
    booked = F.when(n % 22 == 0, stake * 0.25 - 1).when(n % 7 == 3, stake * 0.5)
    return o.select("game_pk", "side", "home_win", "model_prob", "market", status.alias("status"), stake.alias("stake"), F.when(n % 3 > 0, F.floor(stake * 2) + 0.0).alias("contracts"), booked.alias("booked"))


ORDERS_SQL = f"""{O_SQL}, orders_frame AS (SELECT game_pk, side, home_win, model_prob, market, floor(model_prob * 10) + 1e0 AS stake,
 CASE WHEN game_pk % 13 = 0 THEN 'voided' WHEN game_pk % 11 = 0 THEN 'exited' ELSE 'filled' END AS status,
 CASE WHEN game_pk % 3 > 0 THEN floor((floor(model_prob * 10) + 1e0) * 2) END AS contracts,
 CASE WHEN game_pk % 22 = 0 THEN (floor(model_prob * 10) + 1e0) * 0.25e0 - 1 WHEN game_pk % 7 = 3 THEN (floor(model_prob * 10) + 1e0) * 0.5e0 END AS booked
 FROM k WHERE side IS NOT NULL AND home_win IS NOT NULL),
t1 AS (SELECT *, CASE WHEN status IN ('exited', 'stopped') THEN coalesce(booked > 0, FALSE) ELSE (side = 'home') = (home_win = 1) END AS won,
 coalesce(contracts, stake * CASE WHEN side = 'home' AND market > 0 THEN 1 / market WHEN side = 'away' AND market > 0 AND market < 1 THEN 1 / (1 - market) ELSE 1e0 END) AS returned
 FROM orders_frame WHERE status NOT IN ('voided', 'cancelled')),
s1 AS (SELECT *, coalesce(booked, CASE WHEN won AND status NOT IN ('exited', 'stopped') THEN returned - stake ELSE -stake END) AS pnl FROM t1)"""


def settled(orders: DataFrame) -> DataFrame:
    """Orders that count, with won, returned and pnl.

    An order that ended before its game is won if it was left with a profit, and lost if none is booked.
    A booked profit goes before a computed one; without contracts the return follows from the market's
    probability of the side, or is the stake where that is no probability.
    """
    c, exited = F.col, F.col("status").isin(EXITED)
    on_side = F.when(c("side") == "home", c("market")).otherwise(1 - c("market"))
    odds = F.when((on_side > 0) & ((c("side") == "home") | (on_side < 1)), 1 / on_side).otherwise(1.0)
    won = F.when(exited, F.coalesce(c("booked") > 0, F.lit(False))).otherwise((c("side") == "home") == (c("home_win") == 1))
    rows = orders.where(~c("status").isin(VOIDED) & (c("stake") > 0)).withColumns({"won": won, "returned": F.coalesce("contracts", c("stake") * odds)})
    return rows.withColumn("pnl", F.coalesce("booked", F.when(c("won") & ~exited, c("returned") - c("stake")).otherwise(-c("stake"))))


@query(f"""{ORDERS_SQL} SELECT 'all' AS bin, CAST(count(*) AS BIGINT) AS bets, CAST(count(*) FILTER (won) AS BIGINT) AS wins, CAST(count(*) FILTER (NOT won) AS BIGINT) AS losses,
 round(avg(CAST(won AS DOUBLE)), 6) AS accuracy, round(sum(stake), 2) AS wagered, round(100 * sum(pnl) / sum(stake), 6) AS roi_pct FROM s1
UNION ALL SELECT CAST(CAST(floor(model_prob * 10) AS BIGINT) AS VARCHAR), count(*), count(*) FILTER (won), count(*) FILTER (NOT won), round(avg(CAST(won AS DOUBLE)), 6), round(sum(stake), 2),
 round(100 * sum(pnl) / sum(stake), 6) FROM s1 GROUP BY floor(model_prob * 10)""")
def a19_performance(spark, sf_dir):
    """O-A19: bets, wins, staked, return with exits' own profit and odds where none is booked; all, and by tenths of the probability."""
    rows = settled(orders_frame(spark, sf_dir))
    tenth = F.floor(F.col("model_prob") * 10).cast("string")
    both = rows.withColumn("bin", F.explode(F.array(F.lit("all"), tenth)))
    return both.groupBy("bin").agg(
        F.count("*").alias("bets"), F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.round(F.avg(F.col("won").cast("double")), 6).alias("accuracy"),
        F.round(F.sum("stake"), 2).alias("wagered"), F.round(100 * F.sum("pnl") / F.sum("stake"), 6).alias("roi_pct"),
    )


#: What the readiness report looks at.
REQUIRED, FEATURES, TOP_RATES, EXAMPLES = ["home_win", "market"], ["move", "prior", "never", "wrc"], 20, 10


def training_rows(spark, sf_dir) -> DataFrame:
    """Games with features of which some are missing, one always, and one out of scale at times."""
    n, c = F.col("game_pk"), F.col
    g = priced(spark, sf_dir)
    return g.select(
        "game_pk", "game_date", "home_win", F.when(n % 23 > 0, c("market")).alias("market"), F.when(n % 19 > 0, c("close_home_ml")).alias("close_home_ml"), "close_away_ml", (c("ch") + c("ca")).alias("overround"),
        F.when(n % 17 > 0, c("ch") - c("oh")).alias("move"), c("model_prob").alias("prior"), F.lit(None).cast("double").alias("never"), F.when(n % 5 > 0, (n % 330).cast("double")).alias("wrc"),
    )


def readiness(rows: DataFrame, issues: dict[str, Column], required: list[str], features: list[str], label: str = "home_win") -> DataFrame:
    """section, name, n, share, first_day, last_day, examples: counts, null rates and issues of a training table.

    One pass counts rows and nulls of all features; the other looks only at rows with an issue.  Examples are
    the ``EXAMPLES`` least keys: the row-number filter is pushed below the shuffle, so no issue is gathered.
    """
    ready = F.lit(True)
    for c in required:
        ready = ready & F.col(c).isNotNull()
    counted = rows.agg(F.count("*").alias("raw"), F.count(label).alias("settled"), F.count_if(ready).alias("ready"), *[F.count_if(ready & F.col(c).isNull()).alias(f"null_{c}") for c in features])
    line = lambda section, name, n, share: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), n.cast("long").alias("n"), share.cast("double").alias("share"))
    none = F.lit(None)
    rates = [line("null_rate", c, F.col(f"null_{c}"), F.try_divide(f"null_{c}", F.col("ready"))) for c in features]
    told = counted.select(F.inline(F.array(*[line("rows", c, F.col(c), none) for c in ("raw", "settled", "ready")], *rates)))
    # as many rows as there are features
    by_rate = Window.partitionBy("section").orderBy(F.desc_nulls_last("share"), "name")
    told = told.withColumn("place", F.row_number().over(by_rate)).where((F.col("section") != "null_rate") | (F.col("place") <= TOP_RATES)).drop("place")
    empty = told.where("section = 'null_rate' and share = 1").withColumn("section", F.lit("all_null"))
    dated = [F.lit(None).cast("date").alias(c) for c in ("first_day", "last_day")]
    told = told.unionByName(empty).select("*", *dated, F.lit(None).cast("string").alias("examples"))

    found = rows.select("game_pk", "game_date", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in issues.items()]))).alias("name"))
    sums = found.groupBy("name").agg(F.count("*").alias("n"), F.min("game_date").alias("first_day"), F.max("game_date").alias("last_day"))
    least = latest(found.select("name", "game_pk"), ["name"], ["game_pk"], EXAMPLES).groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("game_pk")), lambda k: k.cast("string")), ",").alias("examples"))
    named = rows.sparkSession.createDataFrame([(k,) for k in issues], "name string")  # the issues asked for
    issue = named.join(sums, "name", "left").join(least, "name", "left")
    issue = issue.select(F.lit("issue").alias("section"), "name", F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("double").alias("share"), "first_day", "last_day", "examples")
    return told.unionByName(issue)


ISSUES_SQL = {"missing_close": "close_home_ml IS NULL OR close_away_ml IS NULL", "thin_market": "home_win IS NOT NULL AND overround < 1.001e0", "scale_wrc": "wrc < 10 OR wrc > 300", "scale_prior": "prior < 0 OR prior > 1"}


@query(f"""{O_SQL}, f AS (SELECT game_pk, game_date, home_win, CASE WHEN game_pk % 23 > 0 THEN market END AS market, CASE WHEN game_pk % 19 > 0 THEN close_home_ml END AS close_home_ml, close_away_ml,
 ch + ca AS overround, CASE WHEN game_pk % 17 > 0 THEN ch - oh END AS move, model_prob AS prior, CAST(NULL AS DOUBLE) AS never, CASE WHEN game_pk % 5 > 0 THEN CAST(game_pk % 330 AS DOUBLE) END AS wrc FROM k),
r AS (SELECT * FROM f WHERE home_win IS NOT NULL AND market IS NOT NULL),
u AS (SELECT name, v FROM r UNPIVOT INCLUDE NULLS (v FOR name IN (move, prior, never, wrc))),
nulls AS (SELECT name, count(*) - count(v) AS n, (count(*) - count(v)) / CAST(count(*) AS DOUBLE) AS share FROM u GROUP BY name),
names(name) AS (VALUES {', '.join(f"('{k}')" for k in ISSUES_SQL)}),
i AS ({' UNION ALL '.join(f"SELECT '{k}' AS name, * FROM f WHERE {v}" for k, v in ISSUES_SQL.items())}),
e AS (SELECT name, string_agg(CAST(game_pk AS VARCHAR), ',' ORDER BY game_pk) AS examples
      FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY game_pk) AS p FROM i) t WHERE p <= {EXAMPLES} GROUP BY name),
d AS (SELECT name, count(*) AS n, min(game_date) AS first_day, max(game_date) AS last_day FROM i GROUP BY name)
SELECT 'rows' AS section, 'raw' AS name, CAST((SELECT count(*) FROM f) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS share, CAST(NULL AS DATE) AS first_day, CAST(NULL AS DATE) AS last_day, CAST(NULL AS VARCHAR) AS examples
UNION ALL SELECT 'rows', 'settled', (SELECT count(home_win) FROM f), NULL, NULL, NULL, NULL
UNION ALL SELECT 'rows', 'ready', (SELECT count(*) FROM r), NULL, NULL, NULL, NULL
UNION ALL SELECT 'null_rate', name, n, share, NULL, NULL, NULL FROM nulls
UNION ALL SELECT 'all_null', name, n, share, NULL, NULL, NULL FROM nulls WHERE share = 1
UNION ALL SELECT 'issue', names.name, coalesce(n, 0), NULL, first_day, last_day, examples FROM names LEFT JOIN d USING (name) LEFT JOIN e USING (name)""")
def q05_report(spark, sf_dir):
    """O-Q5: the readiness report: rows, null rates, features without any value, missing odds, thin markets, broken scales."""
    return readiness(training_rows(spark, sf_dir), {k: F.expr(v) for k, v in ISSUES_SQL.items()}, REQUIRED, FEATURES)


def box_scores(spark, sf_dir) -> DataFrame:
    """Orders and their lines as box-score documents: scalars, objects keyed by player and arrays of objects mixed."""
    c = F.col
    # line numbers repeat within an order: its lines are counted anew
    lines = table(spark, sf_dir, "lineitem")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))
    lines = lines.withColumn("n", at)
    hand = F.element_at(F.array(F.lit("L"), F.lit("R"), F.lit("S")), (c("l_partkey") % 3 + 1).cast("int"))
    player = F.struct(F.when(c("n") % 4 > 0, (c("n") * 100).cast("string")).alias("battingOrder"), F.struct(hand.alias("code")).alias("batSide"), F.struct(F.when(c("l_partkey") % 5 == 0, "C").otherwise("P").alias("abbreviation")).alias("position"))
    stats = F.struct(F.concat(F.floor("l_quantity").cast("string"), F.lit("."), (c("n") % 3).cast("string")).alias("inningsPitched"), F.floor(c("l_quantity") * 2).cast("long").alias("pitches"))
    pitcher = F.struct("n", c("l_suppkey").alias("id"), stats.alias("stats"))
    # an order has a handful of lines
    teams = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("ID"), "n"), player)))).alias("players"), F.array_sort(F.collect_list(F.when(c("l_returnflag") != "N", pitcher))).alias("pitchers"))
    o = table(spark, sf_dir, "orders").join(teams, c("o_orderkey") == c("l_orderkey"), "left")
    venue = F.struct(F.when(c("o_custkey") % 4 > 0, c("o_custkey").cast("string")).alias("elevation"), F.when(c("o_custkey") % 3 == 0, "Dome").when(c("o_custkey") % 3 == 1, "Retractable").otherwise("Open").alias("roofType"))
    doc = F.struct(F.struct(c("o_orderkey").alias("pk"), c("o_orderstatus").alias("status"), venue.alias("venue")).alias("gameData"), F.struct("players", "pitchers").alias("home"))
    return o.select(c("o_orderkey").alias("game_pk"), F.to_json(doc).alias("doc"))


def flat_boxes(docs: DataFrame) -> DataFrame:
    """One row a document: scalars, hand counts of the batting order, the catcher, the pitchers' sums.

    The document is made and parsed once into a VARIANT column, from which paths are read; a value of another type
    than asked for, or a broken document, is NULL.  Objects keyed by player and arrays are exploded together as rows
    of the document and summed by it, so a document of many players is no long array of another kind.
    """
    c = F.col
    v = docs.select("game_pk", F.monotonically_increasing_id().alias("doc"), F.try_parse_json("doc").alias("v"))
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    v = v.select("game_pk", "doc", at("$.gameData.status", "string").alias("status"), at("$.gameData.venue.elevation", "double").alias("elevation"), F.lower(at("$.gameData.venue.roofType", "string")).alias("roof"), at("$.home", "variant").alias("home"))
    # a document without players or pitchers keeps a row
    rows = docs.sparkSession.sql(
        "SELECT game_pk, doc, status, elevation, roof, h.key AS part, x.pos, x.key, x.value FROM {v}, LATERAL variant_explode_outer(home) h, "
        "LATERAL variant_explode_outer(CASE WHEN h.key IN ('players', 'pitchers') THEN h.value END) x",
        v=v,
    )
    is_bat, is_arm = c("part") == "players", (c("part") == "pitchers") & c("pos").isNotNull()
    of = lambda part, path, kind: F.when(part, F.try_variant_get("value", path, kind))
    text = F.split(of(is_arm, "$.stats.inningsPitched", "string"), "\\.")
    told = rows.select(
        "game_pk", "doc", "status", "elevation", "roof", is_arm.alias("arm"), "pos", "key", of(is_bat, "$.battingOrder", "int").alias("place"), of(is_bat, "$.batSide.code", "string").alias("hand"),
        of(is_bat, "$.position.abbreviation", "string").alias("role"), of(is_arm, "$.id", "long").alias("id"), of(is_arm, "$.stats.pitches", "long").alias("thrown"), text.alias("text"),
    )
    player = F.try_to_number(F.substring("key", 3, 20), F.lit("99999999")).cast("long")
    bat = (c("place") > 0) & (c("place") <= 900)
    hands = lambda side: F.sum(F.when(bat, F.when(c("hand") == side, 1.0).when(c("hand") == "S", 0.5).otherwise(0.0)))
    outs = F.get("text", F.lit(0)).cast("long") * 3 + F.coalesce(F.get("text", F.lit(1)).cast("long"), F.lit(0))
    flat = told.groupBy("game_pk", "doc", "status", "elevation", "roof").agg(
        hands("L").alias("lhb"), hands("R").alias("rhb"), F.min(F.when(bat & (c("role") == "C"), player)).alias("catcher"),
        F.count(F.when(c("arm"), 1)).alias("pitchers"), F.min_by("id", F.when(c("arm"), c("pos"))).alias("starter"), F.sum(outs).alias("outs"), F.sum("thrown").alias("pitches"),
    )
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    roof = c("roof")
    scalars = ["game_pk", "status", "elevation", flag(roof.contains("retractable") | roof.contains("dome")).alias("roof_possible"), F.when(roof.contains("dome"), 1.0).alias("roof_closed")]
    return flat.select(*scalars, "lhb", "rhb", "catcher", "pitchers", "starter", "outs", "pitches")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS n FROM lineitem),
b AS (SELECT l_orderkey, sum(CASE l_partkey % 3 WHEN 0 THEN 1e0 WHEN 2 THEN 0.5e0 ELSE 0e0 END) AS lhb, sum(CASE l_partkey % 3 WHEN 1 THEN 1e0 WHEN 2 THEN 0.5e0 ELSE 0e0 END) AS rhb,
 min(CASE WHEN l_partkey % 5 = 0 THEN CAST(n AS BIGINT) END) AS catcher FROM n WHERE n % 4 > 0 AND n <= 9 GROUP BY 1),
p AS (SELECT l_orderkey, count(*) AS pitchers, arg_min(l_suppkey, n) AS starter, CAST(sum(CAST(floor(l_quantity) AS BIGINT) * 3 + n % 3) AS BIGINT) AS outs,
 CAST(sum(CAST(floor(l_quantity * 2) AS BIGINT)) AS BIGINT) AS pitches FROM n WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT o_orderkey AS game_pk, o_orderstatus AS status, CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey AS DOUBLE) END AS elevation, CASE WHEN o_custkey % 3 < 2 THEN 1e0 ELSE 0e0 END AS roof_possible,
 CASE WHEN o_custkey % 3 = 0 THEN 1e0 END AS roof_closed, lhb, rhb, catcher, coalesce(pitchers, 0) AS pitchers, starter, outs, pitches
FROM orders LEFT JOIN b ON b.l_orderkey = o_orderkey LEFT JOIN p ON p.l_orderkey = o_orderkey""")
def io07_box(spark, sf_dir):
    """O-IO7: box-score documents of scalars, keyed objects and arrays, flattened through VARIANT paths."""
    return flat_boxes(box_scores(spark, sf_dir))


#: Correlation between any two bets of a slate, the most for a bet and for a slate.
RHO, MOST, CAP = 0.1, 0.05, 0.25


def sharpe_stakes(bets: DataFrame, slate: str, rho: float = RHO) -> DataFrame:
    """``bets`` (slate, game_pk, prob, decimal) with stake: of all stakes from 0 the slate's greatest Sharpe ratio.

    A stake's mean is prob * decimal - 1 and its variance prob * (1 - prob) * decimal²; any two bets have the
    correlation ``rho`` (from 0 to below 1).  The first-order conditions then hold for the bets of the highest
    mean by deviation, down to a cut-off that their own sum sets: no search is needed, two windows over a
    slate find it.  The ratio doesn't change with the scale; stakes are as large as the bounds for a bet and a
    slate allow.  Bets without a positive mean or a deviation get nothing.
    """
    c = F.col
    rows = bets.withColumns({"mu": c("prob") * c("decimal") - 1, "sigma": F.sqrt(c("prob") * (1 - c("prob"))) * c("decimal")})
    rows = rows.withColumn("ratio", F.when((c("mu") > 0) & (c("sigma") > 0), c("mu") / c("sigma")))
    down = Window.partitionBy(slate).orderBy(F.desc_nulls_last("ratio"), "game_pk").rowsBetween(Window.unboundedPreceding, 0)
    upto = rho * F.sum("ratio").over(down) / (1 - rho + rho * F.count("ratio").over(down))
    # the cut-off is that of the last bet that lies above its own
    rows = rows.withColumn("upto", upto)
    in_ = c("ratio") > c("upto")
    cut = F.min(F.when(in_, F.struct(c("ratio").alias("r"), (-c("game_pk")).alias("k"), c("upto").alias("upto")))).over(Window.partitionBy(slate))["upto"]
    rows = rows.withColumn("cut", cut).withColumn("z", F.when(in_, (c("ratio") - c("cut")) / c("sigma")).otherwise(0.0))
    whole = Window.partitionBy(slate)
    scale = F.least(MOST / F.max("z").over(whole), CAP / F.sum("z").over(whole))
    return rows.withColumn("scale", F.when(F.max("z").over(whole) > 0, scale)).withColumn("stake", F.coalesce(c("z") * c("scale"), F.lit(0.0))).drop("upto", "cut", "z", "scale", "ratio")


@query(f"""{O_SQL}, b1 AS (SELECT game_date, game_pk, sp * sd - 1 AS mu, sqrt(sp * (1 - sp)) * sd AS sigma FROM k WHERE side IS NOT NULL),
r AS (SELECT *, CASE WHEN mu > 0 THEN mu / sigma END AS ratio FROM b1),
u AS (SELECT *, {RHO}e0 * sum(ratio) OVER w / ({1 - RHO}e0 + {RHO}e0 * count(ratio) OVER w) AS upto FROM r
      WINDOW w AS (PARTITION BY game_date ORDER BY ratio DESC NULLS LAST, game_pk ROWS UNBOUNDED PRECEDING)),
t AS (SELECT game_date, arg_min(upto, struct_pack(r := ratio, k := -game_pk)) AS cut FROM u WHERE ratio > upto GROUP BY game_date),
z AS (SELECT game_date, game_pk, CASE WHEN ratio > upto THEN (ratio - cut) / sigma ELSE 0e0 END AS z FROM u LEFT JOIN t USING (game_date))
SELECT game_date, game_pk, round(coalesce(z * CASE WHEN max(z) OVER d > 0 THEN least({MOST}e0 / max(z) OVER d, {CAP}e0 / sum(z) OVER d) END, 0), 9) AS stake FROM z WINDOW d AS (PARTITION BY game_date)""")
def p01_sharpe(spark, sf_dir):
    """O-P1: joint stakes of a slate's bets by the Sharpe ratio with correlated outcomes."""
    bets = priced(spark, sf_dir).where("side is not null").select("game_date", "game_pk", F.col("sp").alias("prob"), F.col("sd").alias("decimal"))
    return sharpe_stakes(bets, "game_date").select("game_date", "game_pk", F.round("stake", 9).alias("stake"))
