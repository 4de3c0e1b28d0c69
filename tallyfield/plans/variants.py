"""Further variants of the inventory's rows: folds, daily ledger, fall backs, rates, aliases, chunks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tallyfield.plans.base import query
from tallyfield.plans.views import GAMES_SQL, LOG_SQL, games, team_log
from tallyfield.session import table
from tallyfield.sources.store import shared_folder

G = f"WITH {GAMES_SQL}"
LEAST_TRAIN = 200
SEASONS_BACK = 2


@query(f"""{G}, y AS (SELECT CAST(season AS BIGINT) AS season, count(*) AS n, max(game_date) AS last FROM g WHERE home_win IS NOT NULL GROUP BY 1),
b AS (SELECT season, n, last, CAST(coalesce(sum(n) OVER (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_train, row_number() OVER (ORDER BY season) AS k, max(season) OVER () AS newest FROM y)
SELECT season AS fold, n_train, CAST(n AS BIGINT) AS n_test, season = newest AS open, CASE WHEN season = newest THEN last ELSE CAST(season || '-12-31' AS DATE) END AS upto FROM b WHERE k > {SEASONS_BACK} AND n_train >= {LEAST_TRAIN}""")
def e01_folds(spark, sf_dir):
    """O-E1: one fold for each season with two before it and enough rows; the newest is open, up to the last game."""
    g = games(spark, sf_dir).where("home_win is not null")
    y = g.groupBy(F.col("season").cast("long").alias("season")).agg(F.count("*").alias("n"), F.max("game_date").alias("last"))
    order = Window.orderBy("season")  # one row a season
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    b = y.withColumns({"n_train": before, "k": F.row_number().over(order), "newest": F.max("season").over(Window.partitionBy())})
    upto = F.when(F.col("season") == F.col("newest"), F.col("last")).otherwise(F.make_date(F.col("season").cast("int"), F.lit(12), F.lit(31)))
    b = b.where((F.col("k") > SEASONS_BACK) & (F.col("n_train") >= LEAST_TRAIN))
    return b.select(F.col("season").alias("fold"), "n_train", F.col("n").alias("n_test"), (F.col("season") == F.col("newest")).alias("open"), upto.alias("upto"))


STAKE = 0.02


@query(f"""{G}, d AS (SELECT CAST(season AS BIGINT) AS season, game_date, count(*) AS bets, sum(CASE WHEN (model_prob > 0.5) = (home_win = 1) THEN 0.9e0 ELSE -1e0 END) AS units FROM g WHERE home_win IS NOT NULL GROUP BY 1, 2)
SELECT season, game_date, CAST(bets AS BIGINT) AS bets, round(1000 * exp(sum(ln(greatest(1e-6, 1 + {STAKE} * least(1e0, 20e0 / bets) * units))) OVER (PARTITION BY season ORDER BY game_date)), 4) AS bankroll FROM d""")
def e21_daily(spark, sf_dir):
    """O-E21: a day's bets are staked on the bankroll at its start, within a day's limit; seasons begin anew."""
    hit = (F.col("model_prob") > 0.5) == (F.col("home_win") == 1)
    g = games(spark, sf_dir).where("home_win is not null")
    d = g.groupBy(F.col("season").cast("long").alias("season"), "game_date").agg(F.count("*").alias("bets"), F.sum(F.when(hit, 0.9).otherwise(-1.0)).alias("units"))
    growth = F.log(F.greatest(F.lit(1e-6), 1 + STAKE * F.least(F.lit(1.0), 20.0 / F.col("bets")) * F.col("units")))
    w = Window.partitionBy("season").orderBy("game_date")  # at most 366 rows
    return d.select("season", "game_date", "bets", F.round(1000 * F.exp(F.sum(growth).over(w)), 4).alias("bankroll"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE ts END AS seen, CAST(ts AS DATE) AS day FROM events)
SELECT event_id, coalesce(CAST(seen - INTERVAL 5 HOUR AS DATE), day) AS local_day FROM e WHERE coalesce(CAST(seen - INTERVAL 5 HOUR AS DATE), day) = DATE '2024-01-10'""")
def f05_fallback(spark, sf_dir):
    """O-F5: rows of a local day; where the time is missing the date column stands in."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 6 != 0, F.col("ts")).alias("at"), F.to_date("ts").alias("day"))
    local = F.coalesce(F.to_date(F.col("at") - F.expr("interval 5 hours")), F.col("day"))
    return e.select("event_id", local.alias("local_day")).where("local_day = date '2024-01-10'")


@query(f"""{G}, {LOG_SQL}, w AS (SELECT team, season, game_pk, sum(allowed) OVER p AS runs, sum(scored + 3) OVER p AS outs, game_date - lag(game_date) OVER q AS gap, count(*) OVER p AS k FROM l
WINDOW q AS (PARTITION BY team, season ORDER BY game_date, game_pk), p AS (PARTITION BY team, season ORDER BY game_date, game_pk ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT CAST(team AS BIGINT) AS team, game_pk, CASE WHEN k = 3 AND outs > 0 THEN round(9e0 * runs / outs, 9) END AS form, CAST(gap AS BIGINT) AS days_since FROM w""")
def w12_form(spark, sf_dir):
    """O-W12, W15: a ratio of two sums over the last three, times nine, and the days since the last one."""
    q = Window.partitionBy("team", "season").orderBy("game_date", "game_pk")
    p = q.rowsBetween(-3, -1)
    l = team_log(games(spark, sf_dir)).withColumns({"runs": F.sum("allowed").over(p), "outs": F.sum(F.col("scored") + 3).over(p), "k": F.count("*").over(p), "gap": F.datediff("game_date", F.lag("game_date").over(q))})
    form = F.when((F.col("k") == 3) & (F.col("outs") > 0), F.round(9.0 * F.col("runs") / F.col("outs"), 9))
    return l.select(F.col("team").cast("long").alias("team"), "game_pk", form.alias("form"), F.col("gap").cast("long").alias("days_since"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 7 END AS sort_order FROM orders),
m AS (SELECT o_custkey, max(sort_order) AS top FROM o GROUP BY 1),
r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM o WHERE sort_order IS NULL)
SELECT o.o_orderkey, CAST(coalesce(sort_order, coalesce(top, 0) + k) AS BIGINT) AS sort_order FROM o JOIN m USING (o_custkey) LEFT JOIN r ON r.o_orderkey = o.o_orderkey""")
def w24_fill_order(spark, sf_dir):
    """O-W24: rows without an order come after the others, by date; those that have one keep it."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(k % 3 != 0, k % 7).alias("sort_order"))
    missing = F.col("sort_order").isNull()
    nth = F.row_number().over(Window.partitionBy("o_custkey", missing).orderBy("o_orderdate", "o_orderkey"))
    top = F.coalesce(F.max("sort_order").over(Window.partitionBy("o_custkey")), F.lit(0))
    return o.withColumns({"nth": nth, "top": top}).select("o_orderkey", F.coalesce("sort_order", F.col("top") + F.col("nth")).cast("long").alias("sort_order"))


ALIASES = (("ALMOND ANTIQUE", "almond"), ("BLUSH", "rose"), ("NAVY", "blue"))


@query(f"""WITH a(alias, name) AS (VALUES {", ".join(map(str, ALIASES))}),
p AS (SELECT p_partkey, upper(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS plain FROM part)
SELECT p_partkey, coalesce(name, lower(plain)) AS name FROM p LEFT JOIN a ON alias = plain""")
def x13_alias(spark, sf_dir):
    """O-X13: plain names, then the alias table's name where it lists one."""
    a = spark.createDataFrame(ALIASES, "alias string, name string")  # a fixed, short list
    plain = F.upper(F.trim(F.regexp_replace("p_name", "[^A-Za-z0-9]+", " ")))
    p = table(spark, sf_dir, "part").select("p_partkey", plain.alias("plain"))
    return p.join(F.broadcast(a), F.col("plain") == F.col("alias"), "left").select("p_partkey", F.coalesce("name", F.lower("plain")).alias("name"))


@query("""SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS season, round((13e0 * sum(l_linenumber) + 3e0 * count(*) FILTER (WHERE l_returnflag = 'R') - 2e0 * count(*) FILTER (WHERE l_returnflag = 'A')) / nullif(sum(l_quantity), 0) + 3.1e0, 9) AS fip,
round(9e0 * count(*) FILTER (WHERE l_returnflag = 'A') / nullif(sum(l_quantity), 0), 9) AS per9 FROM lineitem GROUP BY 1, 2""")
def x10_rates(spark, sf_dir):
    """O-X10: fielding-independent figure and a rate for nine innings, by entity and season."""
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    innings = F.nullif(F.sum("l_quantity"), F.lit(0.0))
    fip = (13.0 * F.sum("l_linenumber") + 3.0 * flag("R") - 2.0 * flag("A")) / innings + 3.1
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("season"))
    return by.agg(F.round(fip, 9).alias("fip"), F.round(9.0 * flag("A") / innings, 9).alias("per9"))


@query(f"""{G} SELECT game_pk, CAST(dayofyear(game_date) AS BIGINT) AS day, CAST(quarter(game_date) AS BIGINT) AS quarter, isodow(game_date) >= 6 AS weekend,
round(sin(2 * pi() * dayofyear(game_date) / 365.25e0), 9) AS season_sin, CAST(game_date - make_date(season, 4, 1) AS BIGINT) AS since_opening FROM g""")
def x15_calendar(spark, sf_dir):
    """O-X15: day of the year, quarter, weekend, the season as a circle, days since the first of April."""
    d = F.col("game_date")
    circle = F.sin(2 * F.pi() * F.dayofyear(d) / 365.25)
    opening = F.make_date(F.col("season").cast("int"), F.lit(4), F.lit(1))
    return games(spark, sf_dir).select("game_pk", F.dayofyear(d).cast("long").alias("day"), F.quarter(d).cast("long").alias("quarter"), (F.weekday(d) >= 5).alias("weekend"),
                                       F.round(circle, 9).alias("season_sin"), F.datediff(d, opening).cast("long").alias("since_opening"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_totalprice AS before, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 15 = 1 THEN round(o_totalprice / 100, 2) ELSE o_totalprice END AS after FROM orders)
SELECT k, before, after, CASE WHEN after IS NULL THEN 'cleared' ELSE 'scaled' END AS repair FROM r WHERE before IS DISTINCT FROM after""")
def q07_differences(spark, sf_dir):
    """O-Q7: what each repair changed: the value before and after."""
    k = F.col("o_orderkey")
    after = F.when(k % 10 == 0, None).when(k % 15 == 1, F.round(F.col("o_totalprice") / 100, 2)).otherwise(F.col("o_totalprice"))
    r = table(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_totalprice").alias("before"), after.alias("after"))
    return r.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("repair", F.when(F.col("after").isNull(), "cleared").otherwise("scaled"))


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, CAST(CASE WHEN year(o_orderdate) < 1995 THEN 1 ELSE 2 END AS BIGINT) AS run FROM orders GROUP BY 1, 4""")
def io06_chunks(spark, sf_dir):
    """O-IO6: a reduced table written by chunks; a later run leaves out the chunks that are there."""
    import uuid

    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    reduced = table(spark, sf_dir, "orders").withColumn("chunk", F.year("o_orderdate").cast("long")).groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    schema = "n long, total double, run long, chunk long"
    for run, chunks in ((1, "chunk < 1995"), (2, "true")):
        new = reduced.where(chunks).withColumn("run", F.lit(run).cast("long"))
        if run > 1:
            there = spark.read.schema(schema).parquet(path).select("chunk").distinct()
            new = new.join(there, "chunk", "left_anti")
        new.write.mode("append").partitionBy("chunk").parquet(path)
    return spark.read.schema(schema).parquet(path).select("chunk", "n", "total", "run")
