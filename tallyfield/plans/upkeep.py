"""Survivorship, freezes, changed-only updates, as-of fills, audits and rankings."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfield.operators import joins as J
from tallyfield.plans.base import query
from tallyfield.plans.views import GAMES_SQL, games
from tallyfield.session import table

G = f"WITH {GAMES_SQL}"
DAY = 86400

# two feeds of the same rows: old and new
FEEDS_SQL = """o AS (SELECT o_orderkey AS k, o_orderdate AS start, o_orderstatus AS status,
CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 < 2 THEN 'book' ELSE 'feed' END AS origin,
o_orderpriority AS note FROM orders),
n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice + 1 END AS price,
CASE WHEN o_orderkey % 4 < 2 THEN 'book' ELSE 'feed' END AS origin, 'new' AS note FROM orders WHERE o_orderkey % 2 = 0)"""


def feeds(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    origin = lambda c: F.when(c < 2, "book").otherwise("feed").alias("origin")
    old = o.select(k.alias("k"), F.col("o_orderdate").alias("start"), F.col("o_orderstatus").alias("status"),
                   F.when(k % 3 != 0, F.col("o_totalprice")).alias("price"), origin(k % 5), F.col("o_orderpriority").alias("note"))
    new = o.where(k % 2 == 0).select(k.alias("k"), F.when(k % 7 != 0, F.col("o_totalprice") + 1).alias("price"), origin(k % 4), F.lit("new").alias("note"))
    return old, new.select("k", *[F.col(c).alias(f"n_{c}") for c in ("price", "origin", "note")], F.lit(True).alias("met"))


@query(f"""WITH {FEEDS_SQL}, j AS (SELECT o.k, status, o.price, n.price AS n_price, o.origin, n.origin AS n_origin FROM o LEFT JOIN n USING (k)),
w AS (SELECT *, n_price IS NOT NULL AND (price IS NULL OR n_origin = 'book' OR origin = 'feed') AS wins FROM j)
SELECT k, CASE WHEN status = 'P' THEN NULL WHEN wins THEN n_price ELSE price END AS price,
CASE WHEN status = 'P' THEN NULL WHEN wins THEN n_origin ELSE origin END AS origin FROM w""")
def m02_survivorship(spark, sf_dir):
    """O-M2: the source of higher authority wins, an equal one if it is newer; postponed rows lose both."""
    old, new = feeds(spark, sf_dir)
    rank = lambda c: F.when(F.col(c) == "book", 2).otherwise(1)
    wins = F.col("n_price").isNotNull() & (F.col("price").isNull() | (rank("n_origin") >= rank("origin")))
    pick = lambda c: F.when(F.col("status") == "P", None).when(wins, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return old.join(new, "k", "left").select("k", pick("price"), pick("origin"))


@query(f"""WITH {FEEDS_SQL}, j AS (SELECT o.k, o.price, n.price AS n_price, o.price IS NOT NULL AND (start < TIMESTAMP '1997-01-01' OR o.k % 11 = 0) AS frozen
FROM o LEFT JOIN n USING (k)) SELECT k, frozen, CASE WHEN frozen THEN price ELSE coalesce(n_price, price) END AS price FROM j""")
def m04_freeze(spark, sf_dir):
    """O-M4: rows that have started or were predicted keep their odds, unless they have none."""
    old, new = feeds(spark, sf_dir)
    frozen = F.col("price").isNotNull() & ((F.col("start") < F.lit("1997-01-01").cast("timestamp")) | (F.col("k") % 11 == 0))
    return old.join(new, "k", "left").select("k", frozen.alias("frozen"), F.when(frozen, F.col("price")).otherwise(F.coalesce("n_price", "price")).alias("price"))


@query(f"""WITH {FEEDS_SQL} SELECT o.k, coalesce(n.price, o.price) AS price, coalesce(n.note, o.note) AS note, o.origin
FROM o LEFT JOIN n USING (k)""")
def m05_restricted(spark, sf_dir):
    """O-M5: only the listed columns change, and only to values that are there."""
    old, new = feeds(spark, sf_dir)
    mutable = ("price", "note")
    cols = [F.coalesce(f"n_{c}", c).alias(c) if c in mutable else F.col(c) for c in ("price", "note", "origin")]
    return old.join(new, "k", "left").select("k", *cols)


@query(f"""{G}, s AS (SELECT game_pk, CASE WHEN game_pk % 4 = 0 THEN NULL WHEN game_pk % 9 = 0 THEN 'home' ELSE CASE home_win WHEN 1 THEN 'home' WHEN 0 THEN 'away' END END AS old,
CASE home_win WHEN 1 THEN 'home' WHEN 0 THEN 'away' END AS result FROM g) SELECT game_pk, old, result FROM s WHERE old IS DISTINCT FROM result""")
def m06_changed(spark, sf_dir):
    """O-M6: settlement writes the rows that it changes only; two nulls are no change."""
    g = games(spark, sf_dir)
    result = F.when(F.col("home_win") == 1, "home").when(F.col("home_win") == 0, "away")
    old = F.when(F.col("game_pk") % 4 == 0, None).when(F.col("game_pk") % 9 == 0, "home").otherwise(result)
    return g.select("game_pk", old.alias("old"), result.alias("result")).where(~F.col("old").eqNullSafe(F.col("result")))


@query(f"""{G} SELECT l_orderkey, l_linenumber, CASE WHEN game_status = 'postponed' THEN NULL ELSE l_discount END AS prediction
FROM lineitem JOIN g ON game_pk = l_orderkey WHERE game_status <> 'scheduled'""")
def m12_cleared(spark, sf_dir):
    """O-M12: derived rows of games that haven't started go, those of postponed ones are reset."""
    g = games(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_pk"), "l_orderkey", "l_linenumber", "l_discount")
    left = rows.join(g.where("game_status = 'scheduled'").select("game_pk"), "game_pk", "left_anti")
    off = g.where("game_status = 'postponed'").select("game_pk", F.lit(True).alias("off"))
    return left.join(off, "game_pk", "left").select("l_orderkey", "l_linenumber", F.when(F.col("off").isNull(), F.col("l_discount")).alias("prediction"))


@query("""WITH u AS (SELECT 'o_totalprice' AS money, o_totalprice AS dollars, CASE WHEN o_orderkey % 100 = 0 THEN 0 ELSE CAST(floor(o_totalprice * 100 + 0.5e0) AS BIGINT) END AS cents FROM orders
UNION ALL SELECT 'l_extendedprice', l_extendedprice, CAST(floor(l_extendedprice * 100 + 0.5e0) AS BIGINT) FROM lineitem)
SELECT money, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE CAST(floor(dollars * 100 + 0.5e0) AS BIGINT) IS DISTINCT FROM cents) AS BIGINT) AS mismatches FROM u GROUP BY 1""")
def m15_parity(spark, sf_dir):
    """O-M15: cents beside dollars, and how many rows of each column disagree."""
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    o = table(spark, sf_dir, "orders")
    stored = F.when(F.col("o_orderkey") % 100 == 0, F.lit(0).cast("long")).otherwise(cents("o_totalprice"))
    rows = o.select(F.lit("o_totalprice").alias("money"), F.col("o_totalprice").alias("dollars"), stored.alias("cents"))
    l = table(spark, sf_dir, "lineitem").select(F.lit("l_extendedprice").alias("money"), F.col("l_extendedprice").alias("dollars"), cents("l_extendedprice").alias("cents"))
    return rows.unionByName(l).groupBy("money").agg(F.count("*").alias("n"), F.count_if(~cents("dollars").eqNullSafe(F.col("cents"))).alias("mismatches"))


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS level FROM events WHERE event_type = 'signup' AND user_id % 10 = 0 AND ts >= TIMESTAMP '2024-01-05' GROUP BY 1),
j AS (SELECT event_id, s.day, level, row_number() OVER (PARTITION BY event_id ORDER BY s.day DESC) AS k FROM events e JOIN s ON s.day <= CAST(e.ts AS DATE) WHERE event_type = 'purchase'),
f AS (SELECT arg_min(level, day) AS level, min(day) AS day FROM s)
SELECT e.event_id, coalesce(j.day, f.day) AS day, coalesce(j.level, f.level) AS level FROM events e LEFT JOIN j ON j.event_id = e.event_id AND k = 1, f WHERE event_type = 'purchase'""")
def j09_snapshot(spark, sf_dir):
    """O-J9: the latest snapshot up to a day, else the earliest; an equi-join with the days that each snapshot is good for."""
    e = table(spark, sf_dir, "events").withColumn("on", F.to_date("ts"))
    s = e.where("event_type = 'signup' and user_id % 10 = 0 and ts >= '2024-01-05'").groupBy(F.col("on").alias("day")).agg(F.round(F.avg("value"), 6).alias("level"))
    days = e.agg(F.max("on").alias("end"))  # one row
    upto = F.coalesce(F.date_sub("next", 1), F.greatest("end", "day"))
    good = s.withColumn("next", F.lead("day").over(Window.orderBy("day"))).crossJoin(F.broadcast(days))  # one row a day
    good = good.withColumn("on", F.explode(F.sequence("day", upto))).select("on", "day", "level")
    first = s.agg(F.min("day").alias("day0"), F.min_by("level", "day").alias("level0"))
    p = e.where("event_type = 'purchase'").join(good, "on", "left").crossJoin(F.broadcast(first))
    return p.select("event_id", F.coalesce("day", "day0").alias("day"), F.coalesce("level", "level0").alias("level"))


@query("""WITH p AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id, ts AS rts, max(value) AS seen FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
j AS (SELECT event_id, seen, row_number() OVER (PARTITION BY event_id ORDER BY rts DESC) AS k FROM p JOIN s USING (user_id) WHERE rts <= ts AND value IS NULL)
SELECT event_id, coalesce(value, seen) AS value, value IS NULL AND seen IS NOT NULL AS filled FROM p LEFT JOIN (SELECT * FROM j WHERE k = 1) USING (event_id)""")
def j10_fill(spark, sf_dir):
    """O-J10: the latest earlier value of the same entity, only where the target is missing."""
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    seen = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("value").alias("seen"))
    gaps = J.asof_backward(p.where("value is null").select("event_id", "user_id", "ts"), seen, ["user_id"], "ts", ["seen"])
    filled = gaps.select("event_id", F.col("seen").alias("value"), F.col("seen").isNotNull().alias("filled"))
    return p.where("value is not null").select("event_id", "value", F.lit(False).alias("filled")).unionByName(filled)


def value_counts(rows: DataFrame, *group: str) -> DataFrame:
    """Of each group: n (rows with a value ``v``), d (different values) and top (the largest without sign)."""
    by = rows.where("v is not null").groupBy(*group, "v").agg(F.count("*").alias("n"))
    return by.groupBy(*group).agg(F.sum("n").alias("n"), F.count("*").alias("d"), F.max(F.abs("v")).alias("top"))


FEATURES = ("l_quantity", "l_tax", "l_linenumber", "supplier_season")


@query("""WITH l AS (SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS season, l_quantity, l_tax, l_linenumber, l_suppkey * 10000 + year(l_shipdate) AS supplier_season FROM lineitem),
u AS (SELECT 'l_quantity' AS feature, l_suppkey, season, CAST(l_quantity AS DOUBLE) AS v FROM l UNION ALL SELECT 'l_tax', l_suppkey, season, l_tax FROM l
UNION ALL SELECT 'l_linenumber', l_suppkey, season, CAST(l_linenumber AS DOUBLE) FROM l UNION ALL SELECT 'supplier_season', l_suppkey, season, CAST(supplier_season AS DOUBLE) FROM l),
g AS (SELECT feature, l_suppkey, season, count(DISTINCT v) AS d, max(abs(v)) AS top FROM u WHERE v IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10)
SELECT feature, CAST(count(*) AS BIGINT) AS n_groups, round(avg(CASE WHEN d = 1 AND top > 0 THEN 1e0 ELSE 0e0 END), 9) AS constant_share, quantile_cont(d, 0.5) AS median_distinct FROM g GROUP BY 1""")
def a25_constancy(spark, sf_dir):
    """O-A25: how often a feature has one value, not zero, all through an entity's season of ten rows or more."""
    season = F.year("l_shipdate").cast("long")
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", season.alias("season"), "l_quantity", "l_tax", "l_linenumber", (F.col("l_suppkey") * 10000 + season).alias("supplier_season"))
    # a feature at a time, first by value: no group's values are held at once, and a task's table of counts has the rows of its split once, not once a feature
    parts = [value_counts(l.select("l_suppkey", "season", F.col(c).cast("double").alias("v")), "l_suppkey", "season").withColumn("feature", F.lit(c)) for c in FEATURES]
    by = functools.reduce(DataFrame.unionByName, parts).where("n >= 10")
    constant = ((F.col("d") == 1) & (F.col("top") > 0)).cast("double")
    return by.groupBy("feature").agg(F.count("*").alias("n_groups"), F.round(F.avg(constant), 9).alias("constant_share"), F.percentile("d", F.lit(0.5)).alias("median_distinct"))


LEAKS = "score|margin|result|final"


@query(f"""{G}, u AS (SELECT 'model_prob' AS feature, round(model_prob, 4) AS v, home_win AS y FROM g UNION ALL SELECT 'open_home_ml', open_home_ml, home_win FROM g
UNION ALL SELECT 'home_score', home_score, home_win FROM g UNION ALL SELECT 'home_margin', home_score - away_score, home_win FROM g),
c AS (SELECT feature, v, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS q FROM u WHERE y IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2),
w AS (SELECT feature, p, q, coalesce(sum(q) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT feature, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM w GROUP BY 1)
SELECT feature, round(greatest(auc, 1 - auc), 9) AS auc, greatest(auc, 1 - auc) >= 0.995 AS by_auc, regexp_matches(feature, '{LEAKS}') AS by_name FROM a""")
def e19_leakage(spark, sf_dir):
    """O-E19: features that tell the outcome by themselves, or whose names say that they do."""
    g = games(spark, sf_dir).where("home_win is not null")
    cols = {"model_prob": F.round("model_prob", 4), "open_home_ml": F.col("open_home_ml"), "home_score": F.col("home_score"), "home_margin": F.col("home_score") - F.col("away_score")}
    u = g.select(F.col("home_win").cast("double").alias("y"), *[c.cast("double").alias(n) for n, c in cols.items()]).unpivot(["y"], list(cols), "feature", "v").where("v is not null")
    c = u.groupBy("feature", "v").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("feature").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    a = c.withColumn("below", below).groupBy("feature").agg((F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("a"))
    auc = F.greatest(F.col("a"), 1 - F.col("a"))
    return a.select("feature", F.round(auc, 9).alias("auc"), (auc >= 0.995).alias("by_auc"), F.col("feature").rlike(LEAKS).alias("by_name"))


COLUMNS_SQL = """WITH d AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS quantity, l_discount AS discount, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_tax * 100 END AS tax, l_extendedprice AS price FROM lineitem),
s AS (SELECT 'quantity' AS col, avg(CASE WHEN quantity IS NULL THEN 1e0 ELSE 0e0 END) AS nulls, count(*) FILTER (WHERE quantity NOT BETWEEN 2 AND 50) AS bad, true AS critical FROM d
UNION ALL SELECT 'discount', avg(CASE WHEN discount IS NULL THEN 1e0 ELSE 0e0 END), count(*) FILTER (WHERE discount NOT BETWEEN 0 AND 0.05), false FROM d
UNION ALL SELECT 'tax', avg(CASE WHEN tax IS NULL THEN 1e0 ELSE 0e0 END), count(*) FILTER (WHERE tax NOT BETWEEN 0 AND 100), false FROM d
UNION ALL SELECT 'price', avg(CASE WHEN price IS NULL THEN 1e0 ELSE 0e0 END), count(*) FILTER (WHERE price NOT BETWEEN 0 AND 1e9), true FROM d)"""
RANGES = {"quantity": (2, 50, True), "discount": (0, 0.05, False), "tax": (0, 100, False), "price": (0, 1e9, True)}


def column_report(spark, sf_dir):
    """col, nulls (share), bad (values out of range), critical: one pass over the table."""
    k = F.col("l_orderkey") % 10
    d = table(spark, sf_dir, "lineitem").select(F.when(k != 0, F.col("l_quantity")).alias("quantity"), F.col("l_discount").alias("discount"),
                                                F.when(F.col("l_orderkey") % 4 != 0, F.col("l_tax") * 100).alias("tax"), F.col("l_extendedprice").alias("price"))
    stats = [x for c, (lo, hi, _) in RANGES.items() for x in (F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_n"), F.count_if(~F.col(c).between(lo, hi)).alias(f"{c}_b"))]
    rows = [F.struct(F.lit(c).alias("col"), F.col(f"{c}_n").alias("nulls"), F.col(f"{c}_b").alias("bad"), F.lit(crit).alias("critical")) for c, (_, _, crit) in RANGES.items()]
    return d.agg(*stats).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(f"""{COLUMNS_SQL}, c AS (SELECT col, CASE WHEN (bad > 0 OR nulls > 0.05) AND critical THEN 'critical' WHEN bad > 0 OR nulls > 0.05 THEN 'warning' ELSE 'ok' END AS severity FROM s)
SELECT severity, CAST(count(*) AS BIGINT) AS n, string_agg(col, ',' ORDER BY col) AS cols FROM c GROUP BY 1""")
def q02_severities(spark, sf_dir):
    """O-Q2: how many columns of each severity, and which."""
    off = (F.col("bad") > 0) | (F.col("nulls") > 0.05)
    c = column_report(spark, sf_dir).select("col", F.when(off & F.col("critical"), "critical").when(off, "warning").otherwise("ok").alias("severity"))
    return c.groupBy("severity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("col")), ",").alias("cols"))


@query(f"{COLUMNS_SQL} SELECT col, round(nulls, 9) AS nulls, CAST(bad AS BIGINT) AS bad FROM s WHERE nulls > 0.05 OR bad > 0 ORDER BY nulls DESC, bad DESC, col LIMIT 20")
def s03_offenders(spark, sf_dir):
    """O-S3: the twenty columns with most nulls, then most values out of range."""
    r = column_report(spark, sf_dir).where("nulls > 0.05 or bad > 0").orderBy(F.desc("nulls"), F.desc("bad"), "col").limit(20)
    return r.select("col", F.round("nulls", 9).alias("nulls"), "bad")


CATALOGUE = (("quantity", "volume", "ready"), ("discount", "price", "planned"), ("weather", "context", "planned"))


@query(f"""{COLUMNS_SQL}, k(col, family, planned) AS (VALUES {", ".join(map(str, CATALOGUE))})
SELECT coalesce(k.col, s.col) AS col, family, CASE WHEN s.col IS NULL THEN 'missing' WHEN k.col IS NULL THEN 'unlisted' WHEN nulls > 0.05 THEN 'sparse' ELSE planned END AS status,
round(1 - nulls, 9) AS coverage FROM k FULL OUTER JOIN s ON s.col = k.col""")
def q10_catalogue(spark, sf_dir):
    """O-Q10: what the catalogue lists against what the table has."""
    k = spark.createDataFrame(CATALOGUE, "listed string, family string, planned string")
    s = column_report(spark, sf_dir)
    status = F.when(F.col("col").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("nulls") > 0.05, "sparse").otherwise(F.col("planned"))
    j = k.join(s, F.col("listed") == F.col("col"), "full")
    return j.select(F.coalesce("listed", "col").alias("col"), "family", status.alias("status"), F.round(1 - F.col("nulls"), 9).alias("coverage"))


def implied_sql(c: str) -> str:
    return f"CASE WHEN {c} < 0 THEN -{c} / (100e0 - {c}) ELSE 100e0 / (100e0 + {c}) END"


def implied(c: str) -> Column:
    return F.when(F.col(c) < 0, -F.col(c) / (100.0 - F.col(c))).otherwise(100.0 / (100.0 + F.col(c)))


@query(f"""{G}, r AS (SELECT *, {implied_sql("open_home_ml")} + {implied_sql("open_away_ml")} AS overround FROM g)
SELECT CAST(season AS BIGINT) AS season, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(home_win) AS BIGINT) AS settled, CAST(count(*) FILTER (WHERE home_win IS NOT NULL AND overround >= 0.99) AS BIGINT) AS ready,
CAST(count(*) FILTER (WHERE overround < 0.99) AS BIGINT) AS thin, min(CASE WHEN overround < 0.99 THEN game_date END) AS first_thin, max(CASE WHEN overround < 0.99 THEN game_date END) AS last_thin,
min(CASE WHEN overround < 0.99 THEN game_pk END) AS example FROM r GROUP BY 1""")
def q05_readiness(spark, sf_dir):
    """O-Q5: rows there, settled and ready by season, and those of too thin a market with dates and an example."""
    g = games(spark, sf_dir).withColumn("overround", implied("open_home_ml") + implied("open_away_ml"))
    thin, won = F.col("overround") < 0.99, F.col("home_win").isNotNull()
    return g.groupBy(F.col("season").cast("long").alias("season")).agg(
        F.count("*").alias("n_rows"), F.count("home_win").alias("settled"), F.count_if(won & ~thin).alias("ready"), F.count_if(thin).alias("thin"),
        F.min(F.when(thin, F.col("game_date"))).alias("first_thin"), F.max(F.when(thin, F.col("game_date"))).alias("last_thin"), F.min(F.when(thin, F.col("game_pk"))).alias("example"),
    )


@query(f"""{G}, m AS (SELECT CASE WHEN game_pk % 2 = 0 THEN 'home' ELSE 'away' END AS side, * FROM g WHERE home_win IS NOT NULL)
SELECT game_pk, game_date, side, round(CASE side WHEN 'home' THEN model_prob ELSE 1 - model_prob END, 9) AS side_prob,
CASE side WHEN 'home' THEN open_home_ml ELSE open_away_ml END AS price, (side = 'home') = (home_win = 1) AS won FROM m ORDER BY game_date DESC, game_pk DESC LIMIT 20""")
def s06_receipts(spark, sf_dir):
    """O-S6: the twenty latest settled rows, seen from the side that was taken."""
    home = F.col("game_pk") % 2 == 0
    m = games(spark, sf_dir).where("home_win is not null").orderBy(F.desc("game_date"), F.desc("game_pk")).limit(20)
    return m.select("game_pk", "game_date", F.when(home, "home").otherwise("away").alias("side"), F.round(F.when(home, F.col("model_prob")).otherwise(1 - F.col("model_prob")), 9).alias("side_prob"),
                    F.when(home, F.col("open_home_ml")).otherwise(F.col("open_away_ml")).alias("price"), (home == (F.col("home_win") == 1)).alias("won"))


@query(f"""{G}, u AS (SELECT 'model_prob' AS feature, model_prob AS v, home_win AS y FROM g UNION ALL SELECT 'open_home_ml', open_home_ml, home_win FROM g UNION ALL SELECT 'home_score', home_score, home_win FROM g UNION ALL SELECT 'away_score', away_score, home_win FROM g)
SELECT feature, round(abs(corr(v, y)), 6) AS importance FROM u WHERE y IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def s01_importance(spark, sf_dir):
    """O-S1: the three features that go along most with the outcome."""
    cols = ["model_prob", "open_home_ml", "home_score", "away_score"]
    g = games(spark, sf_dir).where("home_win is not null")
    u = g.select(F.col("home_win").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["y"], cols, "feature", "v")
    return u.groupBy("feature").agg(F.round(F.abs(F.corr("v", "y")), 6).alias("importance")).orderBy(F.desc("importance"), "feature").limit(3)


@query("""SELECT o_orderkey, o_totalprice, CAST((SELECT count(*) FROM orders) AS BIGINT) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def io12_browse(spark, sf_dir):
    """O-IO12: one page of a table in the table's own order, with the count of all rows."""
    o = table(spark, sf_dir, "orders")
    page = o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)
    return page.select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))  # one row


MOST_KEYS = 1000


@query("SELECT event_id, user_id, json_extract_string(props, '$.k') AS props_k FROM events")
def io02_all_keys(spark, sf_dir):
    """O-IO2: every key of an open column as a column of its own; the keys are learnt from the table."""
    e = table(spark, sf_dir, "events").withColumn("map", F.from_json("props", "map<string,string>"))
    keys = [r[0] for r in e.select(F.explode(F.map_keys("map")).alias("key")).distinct().orderBy("key").limit(MOST_KEYS + 1).collect()]
    if len(keys) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: an open column of that many isn't a set of columns")
    return e.select("event_id", "user_id", *[F.col("map")[k].alias(f"props_{k}") for k in keys])


@query("""SELECT event_id, user_id, ts, CAST(value AS DOUBLE) AS value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND props IS NOT NULL""")
def f01_complete(spark, sf_dir):
    """O-F1: rows whose listed key columns are all there."""
    return table(spark, sf_dir, "events").dropna(subset=["user_id", "ts", "value", "props"]).select("event_id", "user_id", "ts", "value")
