"""Odds, bet selection, settlement, ledgers and evaluation (O-X*, O-M*, O-E*, O-F*)."""

from __future__ import annotations

from math import floor

from pyspark.sql import Window, functions as F

from tallyfield.functions import odds as X
from tallyfield.functions.scalars import air_density, date_code, innings, percent, plain_name, status, wind_out
from tallyfield.operators.joins import keep_old, prefer_new, replace, upsert
from tallyfield.operators.order import ordered_fold, stored
from tallyfield.operators.quantiles import exact_quantiles
from tallyfield.plans.base import query
from tallyfield.plans.views import GAMES_SQL, games
from tallyfield.session import table

G = f"WITH {GAMES_SQL}"
IMP = "CASE WHEN {0} < 0 THEN -{0} / (-{0} + 100e0) WHEN {0} > 0 THEN 100e0 / ({0} + 100e0) END"
DEC = "CASE WHEN {0} < 0 THEN 1e0 + 100e0 / -{0} WHEN {0} > 0 THEN 1e0 + {0} / 100e0 END"
O_SQL = f"""{G}, o AS (SELECT *, {IMP.format('open_home_ml')} AS oh, {IMP.format('open_away_ml')} AS oa, {IMP.format('close_home_ml')} AS ch, {IMP.format('close_away_ml')} AS ca,
 {DEC.format('close_home_ml')} AS dh, {DEC.format('close_away_ml')} AS da FROM g),
p AS (SELECT *, ch / (ch + ca) AS market, model_prob - ch / (ch + ca) AS edge FROM o),
b AS (SELECT *, CASE WHEN abs(edge) > 0.05e0 AND abs(edge) <= 0.25e0 AND edge > 0 AND close_home_ml <= 250 AND model_prob * (dh - 1) - (1 - model_prob) > 0 THEN 'home'
   WHEN abs(edge) > 0.05e0 AND abs(edge) <= 0.25e0 AND edge < 0 AND close_away_ml <= 250 AND (1 - model_prob) * (da - 1) - model_prob > 0 THEN 'away' END AS side FROM p),
s AS (SELECT *, CASE WHEN side = 'home' THEN model_prob WHEN side = 'away' THEN 1 - model_prob END AS sp, CASE WHEN side = 'home' THEN dh WHEN side = 'away' THEN da END AS sd FROM b),
k AS (SELECT *, greatest(0e0, least((sp - (1 - sp) / (sd - 1)) * 0.5e0, 0.05e0)) AS f, CASE WHEN home_win IS NOT NULL AND side IS NOT NULL THEN CASE WHEN (side = 'home') = (home_win = 1) THEN sd - 1 ELSE -1 END END AS r FROM s)"""


def step(df, cols):
    """Columns added behind a boundary, so that filters and projections above don't repeat their arithmetic."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns], *[v.alias(k) for k, v in cols.items()]))))


def priced(spark, sf_dir):
    """Games with market columns, the banded side, stake fraction f and return r of a unit stake."""
    c = F.col
    g = step(games(spark, sf_dir), {"oh": X.implied(c("open_home_ml")), "oa": X.implied(c("open_away_ml")), "ch": X.implied(c("close_home_ml")), "ca": X.implied(c("close_away_ml")), "dh": X.decimal(c("close_home_ml")), "da": X.decimal(c("close_away_ml"))})
    g = step(g, {"market": X.devig(c("ch"), c("ca")), "edge": c("model_prob") - X.devig(c("ch"), c("ca"))})
    g = step(g, {"side": X.banded_side(c("model_prob"), c("edge"), c("close_home_ml"), c("close_away_ml"), c("dh"), c("da"), 0.05, 0.25, 250.0)})
    g = step(g, {"sp": X.side_probability(c("side"), c("model_prob")), "sd": F.when(c("side") == "home", c("dh")).when(c("side") == "away", c("da"))})
    won = (c("side") == "home") == (c("home_win") == 1)
    return step(g, {"f": X.stake_fraction(c("sp"), c("sd")), "r": F.when(c("home_win").isNotNull() & c("side").isNotNull(), F.when(won, c("sd") - 1).otherwise(F.lit(-1.0)))})


@query(f"{O_SQL} SELECT game_pk, ch AS implied_home, dh AS decimal_home, market, ch + ca AS overround, ch - oh AS line_move, abs(ch - oh) >= 0.03e0 AS sharp, CASE WHEN abs(close_home_ml) >= 100 THEN ch END AS strict_home FROM p")
def x01_odds_columns(spark, sf_dir):
    """O-X1, X2, X3: implied, decimal, devig, overround, line move."""
    g = priced(spark, sf_dir)
    return g.select("game_pk", F.col("ch").alias("implied_home"), F.col("dh").alias("decimal_home"), "market", X.overround(F.col("ch"), F.col("ca")).alias("overround"), X.line_move(F.col("oh"), F.col("ch")).alias("line_move"), X.sharp(F.col("oh"), F.col("ch")).alias("sharp"), X.implied(F.col("close_home_ml"), strict=True).alias("strict_home"))


@query(f"{O_SQL} SELECT game_pk, edge, side, CASE WHEN model_prob * (dh - 1) - (1 - model_prob) > 0 AND edge > 0.05e0 THEN 'home' WHEN (1 - model_prob) * (da - 1) - model_prob > 0 AND -edge > 0.05e0 THEN 'away' END AS home_first, f AS fraction, greatest(0.01e0, least(0.99e0, sp - 0.05e0)) AS highest_price FROM k WHERE side IS NOT NULL")
def x04_bet_selection(spark, sf_dir):
    """O-X4, X5, X18, X24: side, Kelly fraction, highest acceptable price."""
    g = priced(spark, sf_dir).where("side is not null")
    return g.select("game_pk", "edge", "side", X.home_first_side(F.col("model_prob"), F.col("market"), F.col("dh"), F.col("da"), 0.05).alias("home_first"), F.col("f").alias("fraction"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("sp") - 0.05)).alias("highest_price"))


@query(f"{O_SQL} SELECT season, side, CAST(count(*) AS BIGINT) AS bets, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(sum(r), 6) AS pnl, round(sum(r) / count(*), 9) AS roi, round(sum(f * r) / sum(f), 9) AS kelly_roi, round(avg(sd), 9) AS mean_odds, round(avg(abs(edge)), 9) AS mean_edge FROM k WHERE r IS NOT NULL GROUP BY season, side")
def e10_roi(spark, sf_dir):
    """O-E10, E11, O-A20: flat and fractional-Kelly returns by season and side."""
    g = priced(spark, sf_dir).where("r is not null")
    return g.groupBy("season", "side").agg(F.count("*").alias("bets"), F.count_if(F.col("r") > 0).alias("wins"), F.round(F.sum("r"), 6).alias("pnl"), F.round(F.avg("r"), 9).alias("roi"), F.round(F.sum(F.col("f") * F.col("r")) / F.sum("f"), 9).alias("kelly_roi"), F.round(F.avg("sd"), 9).alias("mean_odds"), F.round(F.avg(F.abs("edge")), 9).alias("mean_edge"))


@query(f"""{O_SQL}, grid AS (SELECT t / 100e0 AS t, kf / 10e0 AS kf FROM generate_series(0, 30) a(t), generate_series(1, 5) c(kf)),
x AS (SELECT t, kf, count(*) AS bets, sum(least(0.05e0, greatest(0, (sp - (1 - sp) / (sd - 1)) * kf)) * r) / sum(least(0.05e0, greatest(0, (sp - (1 - sp) / (sd - 1)) * kf))) AS roi FROM k, grid WHERE r IS NOT NULL AND abs(edge) > t GROUP BY t, kf)
SELECT t AS threshold, kf AS kelly, CAST(bets AS BIGINT) AS bets, round(roi, 9) AS roi FROM x WHERE bets >= 10""")
def e12_grid(spark, sf_dir):
    """O-E12: every threshold and Kelly factor of a fixed 31 x 5 grid over the settled frame."""
    s = priced(spark, sf_dir).where("r is not null").select("edge", "sp", "sd", "r")
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda t: t / 100.0))
    ks = F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: k / 10.0))
    x = s.withColumn("threshold", grid).where("abs(edge) > threshold").withColumn("kelly", ks)
    stake = F.least(F.lit(0.05), F.greatest(F.lit(0.0), X.kelly(F.col("sp"), F.col("sd")) * F.col("kelly")))
    x = x.groupBy("threshold", "kelly").agg(F.count("*").alias("bets"), (F.sum(stake * F.col("r")) / F.sum(stake)).alias("roi"))
    return x.where("bets >= 10").withColumn("roi", F.round("roi", 9))


@query(f"{O_SQL}, q AS (SELECT greatest(quantile_cont(edge, 0.9), quantile_cont(-edge, 0.9)) AS t FROM k WHERE r IS NOT NULL) SELECT round(max(t), 9) AS threshold, CAST(count(*) AS BIGINT) AS bets, round(sum(r), 6) AS pnl FROM k, q WHERE r IS NOT NULL AND abs(edge) > t")
def e13_quantile_rule(spark, sf_dir):
    """O-E13: threshold from quantiles of the signed edge."""
    s = stored(priced(spark, sf_dir).where("r is not null").select("edge", "r"))
    # the upper tenth of the edge, or of its opposite
    t = exact_quantiles(s, "edge", [0.1, 0.9]).agg(F.max(F.when(F.col("prob") > 0.5, F.col("quantile")).otherwise(-F.col("quantile"))).alias("t"))
    return s.join(F.broadcast(t), F.abs("edge") > F.col("t")).agg(F.round(F.max("t"), 9).alias("threshold"), F.count("*").alias("bets"), F.round(F.sum("r"), 6).alias("pnl"))


@query(f"{O_SQL}, c AS (SELECT greatest(1e-6, least(1 - 1e-6, model_prob)) AS p, market AS m, CAST(home_win AS DOUBLE) AS y, year(game_date) AS yr, month(game_date) AS mo FROM p WHERE home_win IS NOT NULL) SELECT CAST(yr AS INT) AS year, CAST(mo AS INT) AS month, CAST(count(*) AS BIGINT) AS n, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss, round(avg(CASE WHEN (p > 0.5) = (y > 0.5) THEN 1e0 ELSE 0e0 END), 9) AS accuracy, round(avg((m - y) * (m - y)), 9) AS market_brier FROM c GROUP BY yr, mo")
def a13_monthly_metrics(spark, sf_dir):
    """O-A13, O-E9: proper scores of model and market by month."""
    c = priced(spark, sf_dir).where("home_win is not null").select(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("model_prob"))).alias("p"), F.col("market").alias("m"), F.col("home_win").cast("double").alias("y"), F.year("game_date").alias("year"), F.month("game_date").alias("month"))
    p, y, m = F.col("p"), F.col("y"), F.col("m")
    return c.groupBy("year", "month").agg(F.count("*").alias("n"), F.round(F.avg((p - y) * (p - y)), 9).alias("brier"), F.round(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))), 9).alias("log_loss"), F.round(F.avg(((p > 0.5) == (y > 0.5)).cast("double")), 9).alias("accuracy"), F.round(F.avg((m - y) * (m - y)), 9).alias("market_brier"))


@query(f"{G} SELECT floor(model_prob * 10) / 10 AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(home_win), 9) AS rate FROM g WHERE home_win IS NOT NULL GROUP BY 1")
def a15_calibration(spark, sf_dir):
    """O-A15: calibration table."""
    return games(spark, sf_dir).where("home_win is not null").groupBy((F.floor(F.col("model_prob") * 10) / 10).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("home_win"), 9).alias("rate"))


@query("""WITH r AS (SELECT d.n_chars AS s, l.toxic AS y FROM documents d JOIN labels l USING (doc_id)), t AS (SELECT s, sum(y) AS pos, count(*) AS n FROM r GROUP BY s),
k AS (SELECT pos, n, sum(n) OVER (ORDER BY s) - n + (n + 1) / 2e0 AS rk FROM t) SELECT round((sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))), 9) AS auc, CAST(sum(n) AS BIGINT) AS n FROM k""")
def e09_rank_auc(spark, sf_dir):
    """O-E9, E19: AUC by average ranks, over distinct scores."""
    r = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    t = r.groupBy(F.col("n_chars").alias("s")).agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    # ranks in two levels: bands of scores are summed first, so no window holds all distinct scores
    t = t.withColumn("band", F.floor(F.log2(F.col("s") + 1) * 64))
    bands = t.groupBy("band").agg(F.sum("n").alias("bn"))
    bands = bands.withColumn("before", F.sum("bn").over(Window.orderBy("band")) - F.col("bn")).drop("bn")
    k = t.join(bands, "band").withColumn("rk", F.col("before") + F.sum("n").over(Window.partitionBy("band").orderBy("s")) - F.col("n") + (F.col("n") + 1) / 2.0)
    pos, n = F.sum("pos"), F.sum("n")
    return k.agg(F.round((F.sum(F.col("rk") * F.col("pos")) - pos * (pos + 1) / 2) / (pos * (n - pos)), 9).alias("auc"), n.alias("n"))


@query(f"""{O_SQL}, d AS (SELECT game_date, sum(r) AS pnl, count(*) AS staked FROM k WHERE r IS NOT NULL GROUP BY game_date)
SELECT game_date, round(sum(pnl) OVER w, 6) AS pnl, CAST(sum(staked) OVER w AS BIGINT) AS staked, round(sum(pnl) OVER w / sum(staked) OVER w, 9) AS roi, round(1000 - (sum(pnl) OVER () - sum(pnl) OVER w), 6) AS balance FROM d WINDOW w AS (ORDER BY game_date)""")
def w19_running_roi(spark, sf_dir):
    """O-W19, W20, O-A27: running return and a balance anchored at its end; days are summed first."""
    d = priced(spark, sf_dir).where("r is not null").groupBy("game_date").agg(F.sum("r").alias("p"), F.count("*").alias("s"))
    w, after = Window.orderBy("game_date"), Window.orderBy("game_date").rowsBetween(1, Window.unboundedFollowing)
    return d.select("game_date", F.round(F.sum("p").over(w), 6).alias("pnl"), F.sum("s").over(w).alias("staked"), F.round(F.sum("p").over(w) / F.sum("s").over(w), 9).alias("roi"), F.round(1000 - F.coalesce(F.sum("p").over(after), F.lit(0.0)), 6).alias("balance"))


def next_bank(cents: int, f: float, r: float) -> int:
    """The bankroll after a bet of the fraction f that returns r for each unit; stake and profit in whole cents."""
    return cents + floor(floor(cents * f + 0.5) * r + 0.5)


@query(f"""{O_SQL.replace("WITH", "WITH RECURSIVE", 1)}, q AS (SELECT home_team AS account, season, f, r, row_number() OVER (PARTITION BY home_team, season ORDER BY game_date, game_pk) AS i
 FROM k WHERE r IS NOT NULL),
w AS (SELECT DISTINCT account, season, CAST(0 AS BIGINT) AS i, CAST(100000 AS BIGINT) AS cents FROM q
 UNION ALL SELECT account, season, q.i, CAST(cents + floor(floor(cents * f + 0.5e0) * r + 0.5e0) AS BIGINT) FROM w JOIN q USING (account, season) WHERE q.i = w.i + 1)
SELECT account, season, max(i) AS bets, arg_max(cents, i) / 100e0 AS bankroll FROM w GROUP BY account, season""")
def w21_ledger(spark, sf_dir):
    """O-W21, E21: bankroll per account (home team), in whole cents after each bet; an exact ordered fold."""
    bets = priced(spark, sf_dir).where("r is not null").select(F.col("home_team").alias("account"), "season", "game_date", "game_pk", "f", "r")
    out = ordered_fold(bets, ["account", "season"], ["game_date", "game_pk"], ["f", "r"], 100_000, next_bank)
    return out.select("account", "season", F.col("n").alias("bets"), (F.col("state") / 100.0).alias("bankroll"))


@query(f"{O_SQL} SELECT home_team AS account, season, round(exp(sum(ln(1 + f * r))), 9) AS growth FROM k WHERE r IS NOT NULL GROUP BY 1, 2")
def w21_growth(spark, sf_dir):
    """O-W21: the unrounded twin of the ledger."""
    return priced(spark, sf_dir).where("r is not null").groupBy(F.col("home_team").alias("account"), "season").agg(F.round(F.exp(F.sum(F.log(1 + F.col("f") * F.col("r")))), 9).alias("growth"))


@query(f"{O_SQL} SELECT game_pk, side, 100 * CAST(floor(model_prob * 10) AS BIGINT) AS stake_cents, CASE WHEN home_win IS NULL THEN NULL WHEN r > 0 THEN CAST(floor(100 * floor(model_prob * 10) * r + 0.5e0) AS BIGINT) ELSE -100 * CAST(floor(model_prob * 10) AS BIGINT) END AS profit_cents, CASE WHEN game_status IN ('postponed', 'cancelled') THEN 'voided' WHEN home_win IS NULL THEN 'open' ELSE 'settled' END AS order_status FROM k WHERE side IS NOT NULL")
def m06_settlement(spark, sf_dir):
    """O-M6..M9, O-F13, O-M15: settle orders from games, void inactive ones, cents."""
    k = priced(spark, sf_dir).where("side is not null")
    stake = 100 * F.floor(F.col("model_prob") * 10).cast("long")
    profit = F.when(F.col("home_win").isNull(), None).when(F.col("r") > 0, F.floor(stake * F.col("r") + 0.5).cast("long")).otherwise(-stake)
    state = F.when(F.col("game_status").isin("postponed", "cancelled"), "voided").when(F.col("home_win").isNull(), "open").otherwise("settled")
    return k.select("game_pk", "side", stake.alias("stake_cents"), profit.alias("profit_cents"), state.alias("order_status"))


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS a, o_orderstatus AS b, o_orderpriority AS c FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT o_orderkey AS k, o_totalprice + 1 AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'new' END AS b, 'n' || o_orderpriority AS c FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 7 = 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN n.a WHEN n.k IS NULL THEN o.a ELSE coalesce(o.a, n.a) END AS a, CASE WHEN o.k IS NULL THEN n.b WHEN n.k IS NULL THEN o.b ELSE coalesce(n.b, o.b) END AS b, CASE WHEN o.k IS NULL THEN n.c WHEN n.k IS NULL THEN o.c ELSE n.c END AS c FROM o FULL OUTER JOIN n ON o.k = n.k""")
def m01_upsert(spark, sf_dir):
    """O-M1, M2, M4, M5, M14: keyed upsert with a survivorship rule for each column."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("a"), F.col("o_orderstatus").alias("b"), F.col("o_orderpriority").alias("c"))
    new = o.where("o_orderkey % 4 = 0 or o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, "new").alias("b"), F.concat(F.lit("n"), "o_orderpriority").alias("c"))
    return upsert(old, new, ["k"], {"a": keep_old, "b": prefer_new, "c": replace})


@query(f"{G} SELECT game_pk, CASE WHEN abs(open_home_ml) <= 300 THEN open_home_ml END AS ml, greatest(10e0, least(300e0, 100 * home_score / (SELECT avg(home_score) FROM g))) AS proxy, CASE WHEN game_pk % 10 = 0 THEN open_home_ml ELSE close_home_ml END AS close_home_ml FROM g WHERE game_status NOT IN ('postponed')")
def m10_repairs(spark, sf_dir):
    """O-M10, M11, M12, O-J18, O-F2: null-out, proxy against the league mean, reset close to open for listed keys."""
    g = games(spark, sf_dir)
    mean = g.agg(F.avg("home_score").alias("league"))
    g = g.crossJoin(F.broadcast(mean)).where(~F.coalesce("game_status", F.lit("")).isin("postponed"))  # one row
    return g.select("game_pk", F.when(F.abs("open_home_ml") <= 300, F.col("open_home_ml")).alias("ml"), F.greatest(F.lit(10.0), F.least(F.lit(300.0), 100 * F.col("home_score") / F.col("league"))).alias("proxy"), F.when(F.col("game_pk") % 10 == 0, F.col("open_home_ml")).otherwise(F.col("close_home_ml")).alias("close_home_ml"))


@query(f"{O_SQL} SELECT CAST(count(*) AS BIGINT) AS bets, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(sum(r) / count(*), 9) AS roi, CAST(count(CASE WHEN edge > 0.1 THEN 1 END) AS BIGINT) AS big_edges, CAST(count(CASE WHEN close_home_ml NOT BETWEEN -300 AND 300 THEN 1 END) AS BIGINT) AS long_lines FROM k WHERE r IS NOT NULL")
def a19_summary(spark, sf_dir):
    """O-A19, A21: performance summary and conditional counters."""
    return priced(spark, sf_dir).where("r is not null").agg(F.count("*").alias("bets"), F.count_if(F.col("r") > 0).alias("wins"), F.round(F.avg("r"), 9).alias("roi"), F.count_if(F.col("edge") > 0.1).alias("big_edges"), F.count_if(~F.col("close_home_ml").between(-300, 300)).alias("long_lines"))


@query(f"{O_SQL} SELECT CASE WHEN abs(edge) <= 0.1 THEN '(0.05,0.10]' WHEN abs(edge) <= 0.15 THEN '(0.10,0.15]' ELSE '(0.15,0.25]' END AS bucket, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END), 9) AS win_rate FROM k WHERE r IS NOT NULL GROUP BY 1")
def a17_edge_buckets(spark, sf_dir):
    """O-A17: right-closed buckets of the edge."""
    e = F.abs("edge")
    b = F.when(e <= 0.1, "(0.05,0.10]").when(e <= 0.15, "(0.10,0.15]").otherwise("(0.15,0.25]")
    return priced(spark, sf_dir).where("r is not null").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("r") > 0).cast("double")), 9).alias("win_rate"))


@query(f"{G}, f AS (SELECT * FROM (VALUES (1, DATE '1995-01-01', DATE '1996-01-01'), (2, DATE '1996-01-01', DATE '1997-01-01'), (3, DATE '1997-01-01', DATE '1998-01-01')) v(fold, a, b)) SELECT fold, CASE WHEN game_date < a THEN 'train' ELSE 'validate' END AS role, CAST(count(*) AS BIGINT) AS n, round(sum(pow(0.5e0, greatest(0, CAST(date_diff('day', game_date, a) AS DOUBLE)) / 365e0)), 6) AS weight FROM g, f WHERE home_win IS NOT NULL AND game_date < b GROUP BY 1, 2")
def j14_folds(spark, sf_dir):
    """O-J14, O-E1, O-X16: rows to fold roles, recency weights."""
    folds = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(f"{y}-01-01").cast("date").alias("a"), F.lit(f"{y + 1}-01-01").cast("date").alias("b")) for i, y in ((1, 1995), (2, 1996), (3, 1997))]))
    g = games(spark, sf_dir).where("home_win is not null").withColumn("f", folds).select("game_date", "f.*").where("game_date < b")
    return g.groupBy("fold", F.when(F.col("game_date") < F.col("a"), "train").otherwise("validate").alias("role")).agg(F.count("*").alias("n"), F.round(F.sum(X.recency_weight(F.datediff("a", "game_date"), 365.0)), 6).alias("weight"))


@query("""SELECT c_custkey, upper(strftime(DATE '1995-01-01' + CAST(c_custkey % 900 AS INT), '%y%b%d')) AS code, (c_custkey % 20 + 1) + (c_custkey % 3) / 3e0 AS ip, (c_custkey % 999) / 1000e0 AS share, trim(regexp_replace(regexp_replace(replace(lower(c_name), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name,
 CASE WHEN c_mktsegment LIKE 'B%' THEN 'postponed' WHEN c_mktsegment LIKE 'A%' THEN 'final' ELSE trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') END AS state FROM customer""")
def x10_parses(spark, sf_dir):
    """O-X10..X14, X22: innings, percent, name, status and date-code texts."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ip = innings(F.concat((k % 20 + 1).cast("string"), F.lit("."), (k % 3).cast("string")))
    share = percent(F.concat(F.format_string("%.1f", (k % 999) / 10.0), F.lit("%")))
    text = F.when(F.col("c_mktsegment").startswith("B"), "Postponed - rain").when(F.col("c_mktsegment").startswith("A"), " FINAL ").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", date_code(F.date_add(F.lit("1995-01-01").cast("date"), (k % 900).cast("int"))).alias("code"), ip.alias("ip"), F.when(k % 999 <= 10, (k % 999) / 1000.0).otherwise(share).alias("share"), plain_name(F.col("c_name")).alias("name"), status(text).alias("state"))


@query(f"{G} SELECT game_pk, round(sin(radians(game_pk % 360)), 9) + 0e0 AS dir_sin, round(cos(radians(game_pk % 360)), 9) + 0e0 AS dir_cos, round((game_pk % 30) * cos(radians(game_pk % 360 - 35e0)), 9) + 0e0 AS wind_out, CAST(month(game_date) AS INT) AS month, CAST(isodow(game_date) - 1 AS INT) AS weekday, round(ln(model_prob / (1 - model_prob)), 9) AS logit, CASE WHEN home_score + away_score > 0 THEN round(CAST(home_score AS DOUBLE) * home_score / (home_score * home_score + away_score * away_score), 9) END AS pythagorean FROM g")
def x07_physics(spark, sf_dir):
    """O-X6, X7, X9, X15, X17, O-F10: circular, wind, calendar, logit and Pythagorean columns."""
    from tallyfield.functions.scalars import circle

    g = games(spark, sf_dir)
    deg = F.col("game_pk") % 360
    s, c = circle(deg)
    return g.select("game_pk", (F.round(s, 9) + 0.0).alias("dir_sin"), (F.round(c, 9) + 0.0).alias("dir_cos"), (F.round(wind_out(F.col("game_pk") % 30, deg, 35.0), 9) + 0.0).alias("wind_out"), F.month("game_date").alias("month"), F.weekday("game_date").alias("weekday"), F.round(X.logit(F.col("model_prob")), 9).alias("logit"), F.round(X.pythagorean(F.col("home_score").cast("double"), F.col("away_score").cast("double")), 9).alias("pythagorean"))


@query("SELECT p_partkey, round((1013e0 - v) * 100 / (287.05e0 * k) + v * 100 / (461.495e0 * k), 9) AS density FROM (SELECT p_partkey, (p_size % 40) + 273.15e0 AS k, 0.5e0 * 6.1094e0 * exp(17.625e0 * (p_size % 40) / ((p_size % 40) + 243.04e0)) AS v FROM part) t")
def x09_air_density(spark, sf_dir):
    """O-X9: moist-air density."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(air_density((F.col("p_size") % 40).cast("double"), F.lit(1013.0), F.lit(50.0)), 9).alias("density"))
