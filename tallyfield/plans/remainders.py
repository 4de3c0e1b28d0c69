"""Rows of the inventory that their shared queries show in part only: travel zones, weather, prices, texts, roles."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from tallyfield.functions.odds import implied, logit
from tallyfield.functions.scalars import air_density, in_range
from tallyfield.operators.quality import Contract, check_sql
from tallyfield.operators.recent import candidates, top, trailing
from tallyfield.operators.windows import lagged
from tallyfield.plans.base import query
from tallyfield.plans.views import GAMES_SQL, LOG_SQL, games, pitched, team_log
from tallyfield.session import table

G = f"WITH {GAMES_SQL}"
IMPLIED = "CASE WHEN close_home_ml < 0 THEN -close_home_ml / (-close_home_ml + 100e0) ELSE 100e0 / (close_home_ml + 100e0) END"
LEAST_EDGE = 0.05
KEYS, ORDER = ["team", "season"], ["game_date", "game_pk"]
W = "PARTITION BY team, season ORDER BY game_date, game_pk"


@query(f"""{G}, p AS (SELECT game_pk, model_prob, home_score, away_score, home_score - away_score AS diff, {IMPLIED} AS market FROM g)
SELECT game_pk, round(diff * model_prob, 9) AS product, CASE WHEN away_score <> 0 THEN round(home_score / CAST(away_score AS DOUBLE), 9) END AS ratio,
round(0.5e0 * model_prob + 0.3e0 * market + 0.2e0 * (home_score / 13e0), 9) AS composite, round(ln(market / (1 - market)) - ln(model_prob / (1 - model_prob)), 9) AS logit_gap FROM p""")
def f10_interactions(spark, sf_dir):
    """O-F10: a product, a ratio that is null over nothing, a weighted composite and a gap of logits."""
    c = F.col
    p = games(spark, sf_dir).withColumn("market", implied(c("close_home_ml")))
    return p.select(
        "game_pk",
        F.round((c("home_score") - c("away_score")) * c("model_prob"), 9).alias("product"),
        F.round(F.try_divide(c("home_score").cast("double"), c("away_score")), 9).alias("ratio"),
        F.round(0.5 * c("model_prob") + 0.3 * c("market") + 0.2 * (c("home_score") / 13.0), 9).alias("composite"),
        F.round(logit(c("market")) - logit(c("model_prob")), 9).alias("logit_gap"),
    )


@query(f"""{G}, {LOG_SQL}, z AS (SELECT *, CASE WHEN is_home = 1 THEN team ELSE opponent END % 4 - 8 AS zone FROM l),
s AS (SELECT *, coalesce(zone - lag(zone) OVER ({W}), 0) AS shift FROM z)
SELECT game_pk, CAST(sum(CASE WHEN is_home = 1 THEN -shift ELSE shift END) AS BIGINT) AS zone_shift FROM s GROUP BY game_pk""")
def w17_time_zones(spark, sf_dir):
    """O-W17: hours of time zone that the guests crossed since their last park, less those of the hosts."""
    log = team_log(games(spark, sf_dir))
    park = F.when(F.col("is_home") == 1, F.col("team")).otherwise(F.col("opponent"))
    log = log.withColumn("zone", park % 4 - 8)
    log = log.withColumn("shift", F.coalesce(F.col("zone") - lagged("zone", KEYS, ORDER), F.lit(0)))
    signed = F.when(F.col("is_home") == 1, -F.col("shift")).otherwise(F.col("shift"))
    return log.groupBy("game_pk").agg(F.sum(signed).cast("long").alias("zone_shift"))


@query("""WITH w AS (SELECT p_partkey, p_size % 40 + 273.15e0 AS k, 0.5e0 * 6.1094e0 * exp(17.625e0 * (p_size % 40) / (p_size % 40 + 243.04e0)) AS v, p_partkey % 30 AS wind, p_partkey % 360 AS comes FROM part),
d AS (SELECT *, (1013e0 - v) * 100 / (287.05e0 * k) + v * 100 / (461.495e0 * k) AS density FROM w)
SELECT p_partkey, round((1.225e0 - density) * 9000, 6) AS density_altitude, round(wind * cos(radians(comes + 180e0 - 40)), 9) + 0e0 AS to_center,
round(wind * cos(radians(comes + 180e0 - 5)), 9) + 0e0 AS to_left, round(wind * cos(radians(comes + 180e0 - 75)), 9) + 0e0 AS to_right FROM d""")
def x09_density_altitude(spark, sf_dir):
    """O-X9: density altitude, and the wind along a field's axis and 35 degrees to either side of it."""
    part = table(spark, sf_dir, "part")
    density = air_density((F.col("p_size") % 40).cast("double"), F.lit(1013.0), F.lit(50.0))
    wind, to = F.col("p_partkey") % 30, F.col("p_partkey") % 360 + 180.0
    along = lambda axis: F.round(wind * F.cos(F.radians(to - axis)), 9) + 0.0
    return part.select(
        "p_partkey",
        F.round((1.225 - density) * 9000, 6).alias("density_altitude"),
        along(40).alias("to_center"),
        along(40 - 35).alias("to_left"),
        along(40 + 35).alias("to_right"),
    )


@query(f"""{G}, t AS (SELECT *, CASE WHEN game_pk % 3 = 0 THEN NULL ELSE CAST(game_date AS TIMESTAMP) + to_hours(game_pk % 24) END AS starts FROM g)
SELECT game_pk, coalesce(starts - INTERVAL 5 MINUTE, CAST(game_date AS TIMESTAMP) + INTERVAL 86399 SECOND) AS expires, round(greatest(0.01e0, least(0.99e0, model_prob - {LEAST_EDGE}e0)), 4) AS highest_price FROM t""")
def x24_signals(spark, sf_dir):
    """O-X24: a signal holds until five minutes before the start, without a time to the day's last second."""
    day = F.col("game_date").cast("timestamp_ntz")
    hours = lambda n: F.make_dt_interval(hours=n)
    starts = F.when(F.col("game_pk") % 3 != 0, day + hours((F.col("game_pk") % 24).cast("int")))
    expires = F.coalesce(starts - F.expr("interval 5 minutes"), day + F.expr("interval 86399 seconds"))
    price = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("model_prob") - LEAST_EDGE))
    return games(spark, sf_dir).select("game_pk", expires.alias("expires"), F.round(price, 4).alias("highest_price"))


def first_number(*texts: Column) -> Column:
    """The first text that is a number."""
    return F.coalesce(*[t.try_cast("double") for t in texts])


@query(f"""{G}, t AS (SELECT *, {IMPLIED} AS m, CASE WHEN game_pk % 4 = 0 THEN 'n/a' WHEN game_pk % 4 = 1 THEN NULL ELSE CAST(floor(model_prob * 80) AS BIGINT)::VARCHAR END AS a FROM g),
n AS (SELECT *, coalesce(TRY_CAST(a AS DOUBLE), round(m, 6)) AS raw FROM t), p AS (SELECT *, CASE WHEN raw > 1 THEN raw / 100 ELSE raw END AS price FROM n),
k AS (SELECT *, greatest(0e0, least(0.05e0, 0.5e0 * (model_prob - price) / (1 - price))) AS live FROM p WHERE price > 0 AND price < 1)
SELECT game_pk, round(price, 9) AS price, round(model_prob - price, 9) AS live_edge, round(least(0.04e0, live), 9) AS fraction,
CAST(greatest(1, floor(round(1000 * least(0.04e0, live) / price, 6))) AS BIGINT) AS contracts FROM k""")
def x25_prices(spark, sf_dir):
    """O-X25: first price that can be read, cents as dollars, live edge, the lesser of two fractions, whole contracts."""
    c = F.col
    g = games(spark, sf_dir)
    offered = F.when(c("game_pk") % 4 == 0, "n/a").when(c("game_pk") % 4 != 1, F.floor(c("model_prob") * 80).cast("string"))
    raw = first_number(offered, F.round(implied(c("close_home_ml")), 6).cast("string"))
    g = g.withColumn("raw", raw).withColumn("price", F.when(c("raw") > 1, c("raw") / 100).otherwise(c("raw"))).where("price > 0 and price < 1")
    live = F.greatest(F.lit(0.0), F.least(F.lit(0.05), 0.5 * (c("model_prob") - c("price")) / (1 - c("price"))))
    g = g.withColumn("fraction", F.least(F.lit(0.04), live))
    contracts = F.greatest(F.lit(1), F.floor(F.round(1000 * c("fraction") / c("price"), 6)))
    return g.select("game_pk", F.round("price", 9).alias("price"), F.round(c("model_prob") - c("price"), 9).alias("live_edge"), F.round("fraction", 9).alias("fraction"), contracts.cast("long").alias("contracts"))


def live_text(detailed: Column, abstract: Column, state: Column, ordinal: Column, outs: Column) -> Column:
    """What a scoreboard shows of a game."""
    told = F.when(outs.isNotNull() & state.isin("Top", "Bottom"), F.concat(outs.cast("string"), F.when(outs == 1, " out").otherwise(" outs")))
    parts = F.concat_ws(" ", F.nullif(state, F.lit("")), F.nullif(ordinal, F.lit("")), told)
    plain = F.coalesce(F.nullif(detailed, F.lit("")), F.nullif(abstract, F.lit("")), F.lit(""))
    live = F.coalesce(F.nullif(parts, F.lit("")), F.nullif(detailed, F.lit("")), F.lit("Live"))
    return F.when(F.lower(detailed).isin("warmup", "pre-game", "scheduled"), detailed).when(abstract == "Live", live).otherwise(plain)


@query(f"""{G}, t AS (SELECT game_pk, CASE game_status WHEN 'scheduled' THEN 'Warmup' WHEN 'postponed' THEN 'In Progress' ELSE '' END AS detailed, CASE game_status WHEN 'final' THEN 'Final' ELSE 'Live' END AS abstract,
CASE game_pk % 4 WHEN 0 THEN 'Top' WHEN 1 THEN 'Bottom' WHEN 2 THEN 'Middle' END AS state, CASE WHEN game_pk % 5 > 0 THEN CAST(game_pk % 5 + 3 AS VARCHAR) || 'th' END AS inning, CASE WHEN game_pk % 7 > 0 THEN game_pk % 3 END AS outs FROM g)
SELECT game_pk, CASE WHEN detailed = 'Warmup' THEN detailed WHEN abstract = 'Live' THEN coalesce(nullif(concat_ws(' ', state, inning,
CASE WHEN state IN ('Top', 'Bottom') AND outs = 1 THEN '1 out' WHEN state IN ('Top', 'Bottom') THEN CAST(outs AS VARCHAR) || ' outs' END), ''), detailed) ELSE abstract END AS shown FROM t""")
def x26_live_text(spark, sf_dir):
    """O-X26: live status text put together from its parts."""
    pk, status = F.col("game_pk"), F.col("game_status")
    return games(spark, sf_dir).select("game_pk", live_text(
        F.when(status == "scheduled", "Warmup").when(status == "postponed", "In Progress").otherwise(""),
        F.when(status == "final", "Final").otherwise("Live"),
        F.when(pk % 4 == 0, "Top").when(pk % 4 == 1, "Bottom").when(pk % 4 == 2, "Middle"),
        F.when(pk % 5 > 0, F.concat((pk % 5 + 3).cast("string"), F.lit("th"))),
        F.when(pk % 7 > 0, pk % 3),
    ).alias("shown"))


@query(f"""{G}, {LOG_SQL} SELECT team, season, CAST(count(*) FILTER (is_home = 1) AS BIGINT) AS home_games, CAST(sum(win) FILTER (is_home = 1) AS BIGINT) AS home_wins,
CAST(count(*) FILTER (is_home = 0) AS BIGINT) AS away_games, CAST(sum(win) FILTER (is_home = 0) AS BIGINT) AS away_wins, CAST(sum(scored) AS BIGINT) AS runs, round(avg(win), 9) AS pct FROM l GROUP BY 1, 2""")
def a23_home_and_away(spark, sf_dir):
    """O-A23: games and wins of each team at home and away."""
    at = lambda home, c: F.sum(F.when(F.col("is_home") == home, c)).cast("long")
    sides = [x for home, name in ((1, "home"), (0, "away")) for x in (F.count_if(F.col("is_home") == home).alias(f"{name}_games"), at(home, F.col("win")).alias(f"{name}_wins"))]
    return team_log(games(spark, sf_dir)).groupBy("team", "season").agg(*sides, F.sum("scored").cast("long").alias("runs"), F.round(F.avg("win"), 9).alias("pct"))


@query("""WITH f AS (SELECT o_custkey AS place, CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
SELECT o.o_orderkey AS k, c_name AS name, n_name AS nation, f.mean, CAST(l.n AS BIGINT) AS lines FROM orders o LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 7 > 0
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN f ON f.place = o.o_custkey AND f.d = CAST(o.o_orderdate AS DATE)
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o.o_orderkey""")
def j01_assembly(spark, sf_dir):
    """O-J1: rows with what four sources know of them; none is lost where a source knows nothing."""
    o, day = table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    feed = o.where("o_orderstatus <> 'P'").groupBy("o_custkey", day.alias("d")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    who = table(spark, sf_dir, "customer").where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    rows = o.withColumn("d", day).join(who, "o_custkey", "left").join(nation, "c_nationkey", "left")
    rows = rows.join(feed, ["o_custkey", "d"], "left").join(lines, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("k"), "name", "nation", "mean", "lines")


@query("""WITH h AS (SELECT user_id % 50 AS place, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS v FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
c AS (SELECT e.event_id, h.v, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch(e.ts) - epoch(h.hour)), h.hour) AS k FROM events e JOIN h ON h.place = e.user_id % 50
AND CAST(h.hour AS DATE) BETWEEN CAST(e.ts AS DATE) - 1 AND CAST(e.ts AS DATE) + 1 WHERE e.event_type = 'purchase')
SELECT e.event_id, c.v AS reading FROM events e LEFT JOIN c ON c.event_id = e.event_id AND k = 1 WHERE e.event_type = 'purchase'""")
def j12_nearest_hour(spark, sf_dir):
    """O-J12: the hourly reading of a place that is nearest to a row, of its day or a day beside it; the earlier of two.

    A place's three days are one array of 72 readings at most, so that rows aren't multiplied.
    """
    e = table(spark, sf_dir, "events").withColumn("place", F.col("user_id") % 50)
    hours = e.where("event_type = 'signup'").groupBy("place", F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("v"))
    near = hours.withColumn("day", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda n: F.date_add(F.to_date("hour"), n))))
    near = near.groupBy("place", "day").agg(F.collect_list(F.struct(F.unix_micros(F.col("hour").cast("timestamp")).alias("at"), "v")).alias("readings"))
    rows = e.where("event_type = 'purchase'").withColumn("day", F.to_date("ts")).join(near, ["place", "day"], "left")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    best = F.array_min(F.transform("readings", lambda r: F.struct(F.abs(r["at"] - at).alias("gap"), r["at"].alias("at"), r["v"].alias("v"))))
    return rows.select("event_id", best["v"].alias("reading"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS slot FROM lineitem WHERE l_suppkey % 7 > 0)
SELECT l_orderkey, CAST(slot AS INT) AS slot, l_suppkey AS player FROM t WHERE slot <= 9""")
def r05_slots(spark, sf_dir):
    """O-R5: members of an array with their slots, nulls skipped before slots are numbered, nine at most."""
    player = F.when(F.col("l_suppkey") % 7 > 0, F.col("l_suppkey")).alias("player")
    line_up = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", player))).alias("ids"))
    known = F.slice(F.filter(F.col("ids.player"), lambda x: x.isNotNull()), 1, 9)
    return line_up.select("l_orderkey", F.posexplode(known).alias("slot", "player")).withColumn("slot", F.col("slot") + 1)


@query("""SELECT l_orderkey AS k, CAST(l_linenumber AS INT) AS line, CASE WHEN l_linenumber % 3 > 0 THEN CAST(floor(l_quantity) AS BIGINT) END AS pitches,
CASE WHEN l_linenumber % 4 > 0 AND l_quantity BETWEEN 10 AND 40 THEN CAST(l_quantity AS DOUBLE) END AS plus FROM lineitem""")
def r06_coerced(spark, sf_dir):
    """O-R6, X12: rows of an array of structs, their texts coerced; what is no number or out of range is null."""
    text = F.floor("l_quantity").cast("string")
    dirty = F.when(F.col("l_linenumber") % 3 == 0, F.lit("-.--")).otherwise(text)
    plus = F.when(F.col("l_linenumber") % 4 == 0, F.lit("bad")).otherwise(F.col("l_quantity").cast("string"))
    seen = F.struct(F.col("l_linenumber").cast("string").alias("line"), dirty.alias("pitches"), plus.alias("plus"))
    nested = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(seen).alias("seen"))
    rows = nested.select("k", F.inline_outer("seen"))
    return rows.select("k", F.col("line").try_cast("int").alias("line"), F.col("pitches").try_cast("long").alias("pitches"), in_range(F.col("plus"), 10, 40).alias("plus"))


@query("""SELECT o_orderkey AS k, CAST(1 + (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT AS INT) AS n, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS customer,
o_orderkey % 3 = 0 AS has_price FROM orders""")
def io03_fold(spark, sf_dir):
    """O-IO3: columns outside of the direct set fold into one JSON map without nulls; read back by key."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    more = {"status": F.col("o_orderstatus"), "customer": F.when(k % 2 == 0, F.col("o_custkey").cast("string")), "price": F.when(k % 3 == 0, F.col("o_totalprice").cast("string"))}
    folded = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, more)), F.array(*more.values())), lambda _, v: v.isNotNull())
    stored = o.select(k.alias("k"), F.to_json(folded).alias("features"))
    back = F.from_json("features", "map<string,string>")
    return stored.select("k", F.size(back).alias("n"), back["status"].alias("status"), back["customer"].cast("long").alias("customer"), F.map_contains_key(back, F.lit("price")).alias("has_price"))


@query("""WITH a AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS line FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
b AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, min(o_totalprice) AS total FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)
SELECT d AS day, CAST(count(*) AS BIGINT) AS n, CAST(count(line) AS BIGINT) AS with_line, CAST(count(total) AS BIGINT) AS with_total, round(sum(coalesce(line, 0) - coalesce(total, 0)), 2) AS gap FROM a FULL JOIN b USING (k, d) GROUP BY 1""")
def io09_two_feeds(spark, sf_dir):
    """O-IO9: two feeds merged into one record a day, a map of key to what either feed has; read back."""
    o = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "k"}).withColumn("day", F.to_date("o_orderdate"))
    lines = o.where("o_orderstatus = 'F'").groupBy("k", "day").agg(F.max("o_totalprice").alias("line"))
    totals = o.where("o_orderkey % 2 = 0").groupBy("k", "day").agg(F.min("o_totalprice").alias("total"))
    both = lines.join(totals, ["k", "day"], "full_outer")
    record = both.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("line", "total").alias("odds")))).alias("games"))
    back = record.select("day", F.explode("games").alias("k", "odds")).select("day", "odds.*")
    gap = F.sum(F.coalesce("line", F.lit(0.0)) - F.coalesce("total", F.lit(0.0)))
    return back.groupBy("day").agg(F.count("*").alias("n"), F.count("line").alias("with_line"), F.count("total").alias("with_total"), F.round(gap, 2).alias("gap"))


@query("""SELECT event_type AS part, sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(epoch_us(max(ts)) AS VARCHAR)) AS stamp FROM events GROUP BY 1""")
def q08_stamp(spark, sf_dir):
    """O-Q8: a stamp of row count and newest time for each part of a table: equal stamps, nothing to derive anew."""
    newest = F.unix_micros(F.max("ts").cast("timestamp")).cast("string")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("part")).agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), newest), 256).alias("stamp"))


WEIGHTS = {"model_prob": 0.8, "home_score": 0.3, "away_score": -0.4}


@query(f"""{G}, m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in WEIGHTS)} FROM g),
z AS (SELECT game_pk, {', '.join(f'{w}e0 * ({c} - m_{c}) / s_{c} AS {c}' for c, w in WEIGHTS.items())} FROM g, m)
SELECT game_pk, CASE WHEN game_pk % 2 = 0 THEN 'home' ELSE 'away' END AS side, feature, round(CASE WHEN game_pk % 2 = 0 THEN v ELSE -v END, 6) + 0e0 AS share,
round(1 / (1 + exp(-CASE WHEN game_pk % 2 = 0 THEN t ELSE -t END)), 6) AS probability FROM (SELECT game_pk, {' + '.join(WEIGHTS)} AS t, unnest([{', '.join(f"'{c}'" for c in WEIGHTS)}]) AS feature, unnest([{', '.join(WEIGHTS)}]) AS v FROM z) u""")
def e20_contributions(spark, sf_dir):
    """O-E20: weight times standardized value of each feature, and the probability, both seen from the side taken."""
    g = games(spark, sf_dir)
    told = g.agg(*[f(c).alias(f"{n}_{c}") for c in WEIGHTS for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    share = {c: w * (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c, w in WEIGHTS.items()}
    sign = F.when(F.col("game_pk") % 2 == 0, 1.0).otherwise(-1.0)
    rows = g.crossJoin(F.broadcast(told)).select("game_pk", sign.alias("sign"), *[v.alias(c) for c, v in share.items()])  # one row of moments
    total = sum((F.col(c) for c in list(WEIGHTS)[1:]), F.col(next(iter(WEIGHTS))))
    long = rows.select("game_pk", "sign", total.alias("t"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in WEIGHTS])))
    side = F.when(F.col("sign") > 0, "home").otherwise("away")
    return long.select("game_pk", side.alias("side"), "feature", (F.round(F.col("sign") * F.col("v"), 6) + 0.0).alias("share"), F.round(1 / (1 + F.exp(-F.col("sign") * F.col("t"))), 6).alias("probability"))


@query("""WITH a AS (SELECT s_nationkey AS team, l_suppkey AS p, CAST(l_shipdate AS DATE) AS d, count(*) FILTER (l_returnflag = 'R') AS saves, count(*) FILTER (l_returnflag = 'A') AS holds, count(*) AS games, sum(l_quantity) AS pitches FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3),
t AS (SELECT DISTINCT team, d FROM a),
s AS (SELECT t.team, t.d, p, sum(saves) * 3 + sum(games) + sum(holds) * 0.25e0 AS closing, sum(holds) * 3 + sum(games) * 0.25e0 AS setting, coalesce(sum(pitches) FILTER (a.d >= t.d - 2), 0) <= 35 AS fresh FROM t JOIN a ON a.team = t.team AND a.d < t.d AND a.d >= t.d - 30 GROUP BY 1, 2, 3),
c AS (SELECT *, row_number() OVER (PARTITION BY team, d ORDER BY closing DESC, p) AS k FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY team, d ORDER BY k = 1, setting DESC, p) AS j, row_number() OVER (PARTITION BY team, d, p % 3 = 0 ORDER BY closing DESC, p) AS h FROM c)
SELECT team, d AS day, max(p) FILTER (k = 1) AS closer, bool_or(fresh) FILTER (k = 1) AS closer_fresh, max(p) FILTER (j = 1 AND k > 1) AS setup, bool_or(fresh) FILTER (j = 1 AND k > 1) AS setup_fresh,
max(p) FILTER (h = 1 AND p % 3 = 0) AS best_left, max(p) FILTER (h = 1 AND p % 3 > 0) AS best_right FROM u GROUP BY 1, 2""")
def w16_bullpen(spark, sf_dir):
    """O-W16: closer, set-up man and best of either hand by scores over 30 days, and who is fresh: 35 pitches in two days.

    Ties go to the lowest id.  At most four candidates of each share of a team's pitchers and day are left to compare;
    picks are then made in a window over these.
    """
    c = F.col
    plays, sizes, days = pitched(spark, sf_dir)
    flag = lambda f: F.coalesce(c("l_returnflag") == f, F.lit(False)).cast("double")
    plays = plays.select("team", c("pitcher").alias("p"), "d", flag("R").alias("saves"), flag("A").alias("holds"), F.lit(1.0).alias("games"), F.coalesce("l_quantity", F.lit(0.0)).alias("pitches"))

    def picked(ids, of):
        saves, holds, games = (trailing(of[v], 30, 30) for v in ("saves", "holds", "games"))
        closing, setting, fresh = saves * 3 + games + holds * 0.25, holds * 3 + games * 0.25, trailing(of["pitches"], 2, 30) <= 35
        left, there = (ids % 3 == 0)[:, None], games > 0
        marks = top(closing, among=there & left) | top(closing, among=there & ~left) | top(setting, among=there, n=2)
        return marks, {"closing": closing, "setting": setting, "fresh": fresh}

    s = candidates(plays, sizes, "team", "p", "d", ["saves", "holds", "games", "pitches"], 30, picked, "closing double, setting double, fresh boolean")
    s = s.join(days, ["team", "day"], "left_semi")
    # best by score, then lowest id; the second best set-up man stands in where the best one is the closer
    of = lambda score: F.struct(c(score), (-c("p")).alias("low"), "fresh")
    best = lambda score, when: F.max(F.when(when, of(score)))
    left = c("p") % 3 == 0
    s = s.withColumn("one", F.max(of("closing")).over(Window.partitionBy("team", "day")))
    picks = s.groupBy("team", "day").agg(F.max("one").alias("one"), best("closing", left).alias("lefty"), best("closing", ~left).alias("righty"), best("setting", c("p") != -c("one.low")).alias("two"))
    return picks.select(
        "team", "day", (-c("one.low")).alias("closer"), c("one.fresh").alias("closer_fresh"), (-c("two.low")).alias("setup"), c("two.fresh").alias("setup_fresh"),
        (-c("lefty.low")).alias("best_left"), (-c("righty.low")).alias("best_right"),
    )


CHECKED = [Contract("l_quantity", 1, 45), Contract("l_tax", 0, 0.06), Contract("l_extendedprice", 0, 50000)]


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 45 AND l_tax BETWEEN 0 AND 0.06e0 AND l_extendedprice BETWEEN 0 AND 50000)""")
def q04_checks(spark, sf_dir):
    """O-Q4: rows that fail a table's CHECK expression as it is made from the contracts."""
    check = " AND ".join(f"({check_sql(c)})" for c in CHECKED)
    return table(spark, sf_dir, "lineitem").where(f"NOT ({check})").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")


NUMBERS = ["l_orderkey", "l_quantity", "l_tax", "l_discount", "half", "flat"]
EXCLUDED = "(_id|key)$"


@query(f"""WITH t AS (SELECT *, CASE WHEN l_linenumber > 1 THEN l_tax END AS half, 1e0 AS flat FROM lineitem),
u AS (SELECT unnest([{', '.join(f"'{c}'" for c in NUMBERS)}]) AS feature, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in NUMBERS)}]) AS v FROM t)
SELECT feature, round(count(v) / CAST(count(*) AS DOUBLE), 9) AS coverage, round(stddev_samp(v), 6) AS spread FROM u WHERE NOT regexp_matches(feature, '{EXCLUDED}')
GROUP BY 1 HAVING count(v) >= 0.6e0 * count(*) AND min(v) < max(v) AND stddev_samp(v) > 1e-6""")
def a09_candidates(spark, sf_dir):
    """O-A9: numeric columns with enough values, two of them at least and a spread, whose names aren't those of keys."""
    t = table(spark, sf_dir, "lineitem").withColumns({"half": F.when(F.col("l_linenumber") > 1, F.col("l_tax")), "flat": F.lit(1.0)})
    cols = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in NUMBERS])
    u = t.select(F.inline(cols)).where(~F.col("feature").rlike(EXCLUDED))
    s = u.groupBy("feature").agg((F.count("v") / F.count("*")).alias("coverage"), F.stddev_samp("v").alias("spread"), F.min("v").alias("low"), F.max("v").alias("high"))
    return s.where("coverage >= 0.6 and low < high and spread > 1e-6").select("feature", F.round("coverage", 9).alias("coverage"), F.round("spread", 6).alias("spread"))
