"""Further aggregates, guards and settlement rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators.quantiles import exact_quantiles
from tallyfield.plans.base import query
from tallyfield.plans.views import GAMES_SQL, games
from tallyfield.session import table

G = f"WITH {GAMES_SQL}"


@query(f"{G} SELECT round(avg(x), 9) AS mean_score, CAST(count(x) AS BIGINT) AS n FROM (SELECT home_score AS x FROM g UNION ALL SELECT away_score FROM g) t")
def r09_stacked(spark, sf_dir):
    """O-R9: both sides stacked for one mean."""
    return games(spark, sf_dir).select(F.explode(F.array("home_score", "away_score")).alias("x")).agg(F.round(F.avg("x"), 9).alias("mean_score"), F.count("x").alias("n"))


@query("SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN value END), -1) AS purchase, coalesce(max(CASE WHEN event_type = 'signup' THEN value END), -1) AS signup FROM events GROUP BY user_id")
def r10_key_values(spark, sf_dir):
    """O-R10: key/value rows to one row an entity, with defaults."""
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["purchase", "signup"]).agg(F.max("value"))
    return wide.select("user_id", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("purchase", "signup")])


@query(f"{G}, m AS (SELECT year(game_date) AS y, month(game_date) AS mo, avg((model_prob - home_win) * (model_prob - home_win)) AS v, count(*) AS n FROM g WHERE home_win IS NOT NULL GROUP BY 1, 2) SELECT CAST(mo AS INT) AS month, round(sum(v * n) / sum(n), 9) AS brier, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY mo")
def a14_reweighted(spark, sf_dir):
    """O-A14: months of the year from monthly figures, weighted by count."""
    d = F.col("model_prob") - F.col("home_win")
    m = games(spark, sf_dir).where("home_win is not null").groupBy(F.year("game_date").alias("y"), F.month("game_date").alias("month")).agg(F.avg(d * d).alias("v"), F.count("*").alias("n"))
    return m.groupBy("month").agg(F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 9).alias("brier"), F.sum("n").alias("n"))


@query("WITH u AS (SELECT 'l_quantity' AS feature, l_quantity AS v, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem UNION ALL SELECT 'l_tax', l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END FROM lineitem), m AS (SELECT feature, quantile_cont(v, 0.5) AS med FROM u GROUP BY 1) SELECT feature, round(avg(CASE WHEN v >= med THEN CAST(y AS DOUBLE) END), 9) AS high_rate, round(avg(CASE WHEN v < med THEN CAST(y AS DOUBLE) END), 9) AS low_rate FROM u JOIN m USING (feature) GROUP BY 1 HAVING count(*) FILTER (v >= med) > 10 AND count(*) FILTER (v < med) > 10")
def a18_median_split(spark, sf_dir):
    """O-A18: rates above and below each feature's median, for features with more than ten rows on either side."""
    long = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in ("l_quantity", "l_tax")])).alias("x")).select("y", "x.*")
    med = exact_quantiles(long, "v", [0.5], ["feature"]).select("feature", F.col("quantile").alias("med"))
    sides = [F.count_if(F.col("v") >= F.col("med")).alias("high"), F.count_if(F.col("v") < F.col("med")).alias("low")]
    rates = long.join(F.broadcast(med), "feature").groupBy("feature").agg(*sides, F.round(F.avg(F.when(F.col("v") >= F.col("med"), F.col("y"))), 9).alias("high_rate"), F.round(F.avg(F.when(F.col("v") < F.col("med"), F.col("y"))), 9).alias("low_rate"))  # two rows
    return rates.where("high > 10 and low > 10").drop("high", "low")


@query(f"{G}, c AS (SELECT season, sum(13 * home_score + 3 * away_score) / CAST(sum(9) AS DOUBLE) AS raw FROM g WHERE home_win IS NOT NULL GROUP BY 1) SELECT season, round(4.2e0 - raw, 9) AS fip_constant FROM c")
def a22_league_constant(spark, sf_dir):
    """O-A22: a league constant from season totals."""
    return games(spark, sf_dir).where("home_win is not null").groupBy("season").agg(F.round(4.2 - F.sum(13 * F.col("home_score") + 3 * F.col("away_score")) / F.sum(F.lit(9.0)), 9).alias("fip_constant"))


@query("SELECT l_orderkey AS order_id, CASE WHEN count(CASE WHEN l_returnflag = 'R' THEN 1 END) > 0 AND count(CASE WHEN l_returnflag <> 'R' THEN 1 END) > 0 THEN CAST(sum(CASE WHEN l_returnflag = 'R' THEN floor(l_extendedprice * 100) ELSE -floor(l_extendedprice * 100) END) AS BIGINT) END AS pnl_cents FROM lineitem GROUP BY 1")
def a24_fill_pnl(spark, sf_dir):
    """O-A24: sells less buys in cents; NULL unless both sides are filled."""
    sell, cents = F.col("l_returnflag") == "R", F.floor(F.col("l_extendedprice") * 100).cast("long")
    both = (F.count_if(sell) > 0) & (F.count_if(~sell) > 0)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.when(both, F.sum(F.when(sell, cents).otherwise(-cents))).alias("pnl_cents"))


@query("WITH b AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'signup'), l AS (SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM b) t WHERE k = 1), p AS (SELECT user_id, sum(value) AS due FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT l.user_id, round(l.value + coalesce(due, 0), 6) AS balance FROM l LEFT JOIN p USING (user_id)")
def a26_effective_balance(spark, sf_dir):
    """O-A26: latest balance and what is still due."""
    e = table(spark, sf_dir, "events")
    r = e.groupBy("user_id").agg(F.max_by(F.when(F.col("event_type") == "signup", F.col("value")), F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))).alias("last"), F.count_if(F.col("event_type") == "signup").alias("n"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("due"))
    return r.where("n > 0").select("user_id", F.round(F.col("last") + F.coalesce("due", F.lit(0.0)), 6).alias("balance"))


@query(f"{G} SELECT game_pk, CAST(greatest(1, floor(floor(model_prob * 2000) / (ch * 100))) AS BIGINT) AS contracts FROM (SELECT *, CASE WHEN close_home_ml < 0 THEN -close_home_ml / (-close_home_ml + 100e0) ELSE 100e0 / (close_home_ml + 100e0) END AS ch FROM g) t")
def x25_contracts(spark, sf_dir):
    """O-X25, M13: whole contracts of a stake at a limit price, one at least."""
    from tallyfield.functions.odds import implied

    g = games(spark, sf_dir)
    return g.select("game_pk", F.greatest(F.lit(1), F.floor(F.floor(F.col("model_prob") * 2000) / (implied(F.col("close_home_ml")) * 100))).cast("long").alias("contracts"))


@query("WITH b AS (SELECT user_id, ts AS t, max(value) AS v FROM events WHERE event_type = 'signup' GROUP BY 1, 2) SELECT o.event_id, coalesce((SELECT max(v) FROM b WHERE b.user_id = o.user_id AND b.t >= o.ts) - (SELECT arg_max(v, t) FROM b WHERE b.user_id = o.user_id AND b.t < o.ts) >= o.value, false) AS credited FROM events o WHERE o.event_type = 'purchase'")
def j13_credited(spark, sf_dir):
    """O-J13, ST7: did a later balance exceed the one before by the payout?  One window, no pairs."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    b = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("value").alias("v")).withColumn("side", F.lit(1))
    o = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("value").alias("due"), F.lit(0).alias("side"))
    both = o.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy("user_id").orderBy("ts", "side")  # an order comes before balances of its own time
    before = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.max("v").over(w.rowsBetween(1, Window.unboundedFollowing))
    r = both.select("event_id", "side", F.coalesce(after - before >= F.col("due"), F.lit(False)).alias("credited"))
    return r.where("side = 0").select("event_id", "credited")


@query("SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, o.w FROM (SELECT o_orderkey AS k, o_totalprice AS v, o_custkey AS w FROM orders) o LEFT JOIN (SELECT o_orderkey AS k, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 3 = 0) n ON n.k = o.k")
def j16_prefer_right(spark, sf_dir):
    """O-J16: overlapping columns take the right value, else the left one."""
    from tallyfield.operators.joins import prefer_right

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_custkey").alias("w"))
    return prefer_right(o, o.where("k % 3 = 0").select("k", (F.col("v") * 2).alias("v")), ["k"])
