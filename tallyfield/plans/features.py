"""Window features over the team log and event logs (O-W*, O-R*)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tallyfield.functions.scalars import haversine
from tallyfield.operators.recent import candidates, top, trailing
from tallyfield.operators.windows import days_prior, lagged, latest, over, prior, with_streak
from tallyfield.plans.base import query
from tallyfield.plans.views import GAMES_SQL, LOG_SQL, games, pitched, team_log
from tallyfield.session import table

GL = f"WITH {GAMES_SQL}, {LOG_SQL}"
KEYS, ORDER = ["team", "season"], ["game_date", "game_pk"]
W = "PARTITION BY team, season ORDER BY game_date, game_pk"


@query(f"""{GL},
r AS (SELECT *, CASE WHEN count(win) OVER w >= 5 THEN avg(win) OVER w END AS win_pct_15,
             row_number() OVER ({W}) - row_number() OVER (PARTITION BY team, season, win ORDER BY game_date, game_pk) AS isl
      FROM l WINDOW w AS ({W} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, row_number() OVER (PARTITION BY team, season, win, isl ORDER BY game_date, game_pk) AS runlen FROM r)
SELECT game_pk, team, is_home, win_pct_15,
       COALESCE(lag(CASE WHEN win = 1 THEN runlen ELSE -runlen END) OVER ({W}), 0) AS streak FROM s""")
def flagship(spark, sf_dir):
    """O-R1, O-W2, O-W5: form and streak going into each game."""
    log = team_log(games(spark, sf_dir))
    log = with_streak(log.withColumn("win_pct_15", prior("avg", "win", KEYS, ORDER, 15, 5)), "win", KEYS, ORDER)
    return log.select("game_pk", "team", "is_home", "win_pct_15", "streak")


@query(f"""{GL}
SELECT game_pk, team, lag(win) OVER ({W}) AS win_lag1, lag(scored) OVER ({W}) AS scored_lag1,
  CASE WHEN count(scored) OVER w >= 3 THEN avg(scored) OVER w END AS scored_10,
  CASE WHEN count(scored) OVER w >= 5 THEN stddev_samp(scored) OVER w END AS scored_std_10,
  avg(win) OVER e AS win_before, count(win) OVER e AS games_before,
  CAST(coalesce(sum(scored - allowed) OVER e, 0) AS BIGINT) AS diff_before,
  CASE WHEN count(scored) OVER t >= 1 THEN avg(scored) OVER t END AS scored_3
FROM l WINDOW w AS ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), e AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def w01_prior_windows(spark, sf_dir):
    """O-W1, W3, W4, W10, W12, W15: lag, rolling and expanding priors; one exchange for all."""
    log = team_log(games(spark, sf_dir))
    before = over(KEYS, ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return log.select("game_pk", "team", lagged("win", KEYS, ORDER).alias("win_lag1"), lagged("scored", KEYS, ORDER).alias("scored_lag1"),
        prior("avg", "scored", KEYS, ORDER, 10, 3).alias("scored_10"), prior("stddev_samp", "scored", KEYS, ORDER, 10, 5).alias("scored_std_10"),
        F.avg("win").over(before).alias("win_before"), F.count("win").over(before).alias("games_before"),
        F.coalesce(F.sum(F.col("scored") - F.col("allowed")).over(before), F.lit(0)).alias("diff_before"), prior("avg", "scored", KEYS, ORDER, 3).alias("scored_3"))


@query(f"""{GL}, o AS (SELECT team, game_pk, game_date, win, season, row_number() OVER (PARTITION BY team ORDER BY game_date DESC, game_pk DESC) AS n FROM l),
c AS (SELECT *, max(CASE WHEN win <> w0 THEN n END) OVER (PARTITION BY team) AS dummy FROM (SELECT *, first_value(win) OVER (PARTITION BY team ORDER BY n) AS w0 FROM o) a),
k AS (SELECT team, min(CASE WHEN win <> w0 THEN n END) AS brk, max(n) AS total, max(w0) AS w0 FROM c GROUP BY team)
SELECT team, CAST(count(CASE WHEN n <= 10 AND win = 1 THEN 1 END) AS BIGINT) AS last10_wins, CAST(count(CASE WHEN n <= 10 AND win = 0 THEN 1 END) AS BIGINT) AS last10_losses,
  max(CASE WHEN w0 = 1 THEN 'W' ELSE 'L' END || CAST(coalesce(brk - 1, total) AS VARCHAR)) AS streak FROM o JOIN k USING (team) GROUP BY team""")
def w06_last_ten(spark, sf_dir):
    """O-W6: last-10 record and current streak text."""
    log = team_log(games(spark, sf_dir))
    back = Window.partitionBy("team").orderBy(F.desc("game_date"), F.desc("game_pk"))
    o = log.withColumn("n", F.row_number().over(back)).withColumn("w0", F.first("win").over(back))
    run = F.coalesce(F.min(F.when(F.col("win") != F.col("w0"), F.col("n"))) - 1, F.max("n"))
    return o.groupBy("team").agg(F.count_if((F.col("n") <= 10) & (F.col("win") == 1)).alias("last10_wins"), F.count_if((F.col("n") <= 10) & (F.col("win") == 0)).alias("last10_losses"),
        F.concat(F.when(F.max("w0") == 1, "W").otherwise("L"), run.cast("string")).alias("streak"))


@query(f"""{GL}
SELECT game_pk, team, CAST(least(coalesce(date_diff('day', lag(game_date) OVER ({W}), game_date), 4), 7) AS INT) AS rest_days,
  CAST(CASE WHEN is_home = 1 THEN CASE WHEN lead(opponent) OVER (PARTITION BY team, season, is_home ORDER BY game_date, game_pk) = opponent THEN 0 ELSE 1 END END AS INT) AS series_finale FROM l""")
def w07_rest_and_finale(spark, sf_dir):
    """O-W7, W8: capped rest days; last home game against an opponent."""
    log = team_log(games(spark, sf_dir))
    rest = F.least(F.coalesce(F.datediff("game_date", lagged("game_date", KEYS, ORDER)), F.lit(4)), F.lit(7))
    nxt = F.lead("opponent").over(over(["team", "season", "is_home"], ORDER))
    return log.select("game_pk", "team", rest.alias("rest_days"), F.when(F.col("is_home") == 1, F.when(nxt == F.col("opponent"), 0).otherwise(1)).alias("series_finale"))


@query(f"""WITH {GAMES_SQL}, s AS (SELECT game_pk, game_date, 'home' AS side, home_starter_id AS p FROM g UNION ALL SELECT game_pk, game_date, 'away', away_starter_id FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY game_date, game_pk, side) - 1 AS k, least(date_diff('day', lag(game_date) OVER (PARTITION BY p ORDER BY game_date, game_pk, side), game_date), 14) AS gap FROM s)
SELECT game_pk, CAST(max(CASE WHEN side = 'home' THEN k END) AS INT) AS home_starts, CAST(max(CASE WHEN side = 'away' THEN k END) AS INT) AS away_starts,
  CAST(max(CASE WHEN side = 'home' THEN CASE WHEN k <= 5 THEN 1 ELSE 0 END END) - max(CASE WHEN side = 'away' THEN CASE WHEN k <= 5 THEN 1 ELSE 0 END END) AS INT) AS rookie_diff,
  CAST(max(CASE WHEN side = 'home' THEN gap END) AS INT) AS home_gap FROM n GROUP BY game_pk""")
def w09_career_ordinal(spark, sf_dir):
    """O-W9, O-R2: start number over both sides, pivoted back to one row a game."""
    g = games(spark, sf_dir)
    s = g.select("game_pk", "game_date", F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"{x}_starter_id").alias("p")) for x in ("home", "away")])).alias("s")).select("game_pk", "game_date", "s.side", "s.p")
    w = over(["p"], ["game_date", "game_pk", "side"])
    n = s.withColumn("k", F.row_number().over(w) - 1).withColumn("gap", F.least(F.datediff("game_date", F.lag("game_date").over(w)), F.lit(14)))
    wide = n.groupBy("game_pk").pivot("side", ["home", "away"]).agg(F.max("k").alias("k"), F.max("gap").alias("gap"))
    rookie = lambda x: (F.col(f"{x}_k") <= 5).cast("int")
    return wide.select("game_pk", F.col("home_k").alias("home_starts"), F.col("away_k").alias("away_starts"), (rookie("home") - rookie("away")).alias("rookie_diff"), F.col("home_gap").alias("home_gap"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS d, value FROM events),
d AS (SELECT user_id, d, sum(value) AS v, count(*) AS n FROM e GROUP BY user_id, d)
SELECT user_id, d AS day, round(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0), 6) AS value_30,
 CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS events_14 FROM d""")
def w13_calendar_windows(spark, sf_dir):
    """O-W13, W14: sums over the days before, day by day (peers are added up first)."""
    e = table(spark, sf_dir, "events")
    d = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return d.select("user_id", "day", F.round(F.coalesce(days_prior("sum", F.col("v"), ["user_id"], F.col("day"), 30), F.lit(0.0)), 6).alias("value_30"), F.coalesce(days_prior("sum", F.col("n"), ["user_id"], F.col("day"), 14), F.lit(0)).alias("events_14"))


@query(f"""{GL}, days AS (SELECT team, game_date AS d, count(*) AS n FROM l GROUP BY 1, 2), b AS (SELECT team, min(d) AS a, max(d) AS z FROM days GROUP BY team),
spine AS (SELECT team, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS d FROM b),
f AS (SELECT team, d, coalesce(n, 0) AS n FROM spine LEFT JOIN days USING (team, d))
SELECT team, d AS day, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (PARTITION BY team ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS load_3 FROM f""")
def r07_dense_days(spark, sf_dir):
    """O-R7, O-W14: fill a team's missing days, then row windows are day windows."""
    days = team_log(games(spark, sf_dir)).groupBy("team", F.col("game_date").alias("day")).agg(F.count("*").alias("n"))
    spine = days.groupBy("team").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    f = spine.join(days, ["team", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return f.withColumn("load_3", F.coalesce(F.sum("n").over(over(["team"], ["day"]).rowsBetween(-3, -1)), F.lit(0)))


@query("""WITH a AS (SELECT s_nationkey AS team, l_suppkey AS pitcher, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS load, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3),
t AS (SELECT DISTINCT team, d FROM a), s AS (SELECT t.team, t.d, a.pitcher, sum(a.n) AS n, sum(a.load) AS load FROM t JOIN a ON a.team = t.team AND a.d < t.d AND a.d >= t.d - 30 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY team, d ORDER BY n DESC, load DESC, pitcher) AS k FROM s)
SELECT team, d AS day, max(CASE WHEN k = 1 THEN pitcher END) AS closer, max(CASE WHEN k = 2 THEN pitcher END) AS setup, CAST(max(CASE WHEN k = 1 THEN n END) AS BIGINT) AS closer_games FROM r WHERE k <= 2 GROUP BY team, d""")
def w16_roles(spark, sf_dir):
    """O-W16: the two busiest of the last 30 days for each team and day.  Ties go to the lowest id.

    Two candidates of each share of a team's pitchers and day; only these are compared in a window.
    """
    plays, sizes, days = pitched(spark, sf_dir)
    plays = plays.select("team", "pitcher", "d", F.lit(1.0).alias("n"), F.coalesce("l_quantity", F.lit(0.0)).alias("load"), F.col("l_quantity").isNotNull().cast("double").alias("told"))

    def busiest(ids, of):
        n, load, told = (trailing(of[v], 30, 30) for v in ("n", "load", "told"))
        # a sum of nulls only comes after all numbers
        return top(n, told > 0, load, among=n > 0, n=2), {"n": n.astype("int64"), "load": load, "told": told > 0}

    s = candidates(plays, sizes, "team", "pitcher", "d", ["n", "load", "told"], 30, busiest, "n long, load double, told boolean")
    s = s.join(days, ["team", "day"], "left_semi").withColumn("load", F.when(F.col("told"), F.col("load")))
    r = s.withColumn("k", F.row_number().over(over(["team", "day"], [F.desc("n"), F.desc("load"), "pitcher"]))).where("k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return r.groupBy("team", "day").agg(pick(1, "pitcher").alias("closer"), pick(2, "pitcher").alias("setup"), pick(1, "n").alias("closer_games"))


@query(f"""{GL}, p AS (SELECT *, lag(CASE WHEN is_home = 1 THEN team ELSE opponent END) OVER ({W}) AS prev, CASE WHEN is_home = 1 THEN team ELSE opponent END AS here, date_diff('day', lag(game_date) OVER ({W}), game_date) AS gap FROM l),
q AS (SELECT *, 25e0 + prev AS la, -120e0 + 2 * prev AS lo, 25e0 + here AS lb, -120e0 + 2 * here AS lp FROM p)
SELECT game_pk, team, round(miles, 6) AS miles, coalesce(gap <= 1 AND miles > 100, false) AS getaway FROM (SELECT *, 2 * 3958.8e0 * asin(sqrt(least(1e0, pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(lp - lo) / 2), 2)))) AS miles FROM q) z""")
def w17_travel(spark, sf_dir):
    """O-W17, O-X8: miles from the previous park."""
    log = team_log(games(spark, sf_dir)).withColumn("here", F.when(F.col("is_home") == 1, F.col("team")).otherwise(F.col("opponent")))
    prev, gap = lagged("here", KEYS, ORDER), F.datediff("game_date", lagged("game_date", KEYS, ORDER))
    log = log.withColumn("prev", prev).withColumn("gap", gap)
    miles = haversine(25.0 + F.col("prev"), -120.0 + 2 * F.col("prev"), 25.0 + F.col("here"), -120.0 + 2 * F.col("here"))
    return log.withColumn("m", miles).select("game_pk", "team", F.round("m", 6).alias("miles"), F.coalesce((F.col("gap") <= 1) & (F.col("m") > 100), F.lit(False)).alias("getaway"))


@query(f"""{GL}, t AS (SELECT team, n_regionkey AS division, CAST(sum(win) AS BIGINT) AS wins, CAST(count(*) - sum(win) AS BIGINT) AS losses, CAST(sum(scored - allowed) AS BIGINT) AS diff FROM l JOIN nation ON n_nationkey = team GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS division_rank, first_value(wins) OVER w AS lw, first_value(losses) OVER w AS ll FROM t WINDOW w AS (PARTITION BY division ORDER BY wins / CAST(wins + losses AS DOUBLE) DESC, wins DESC, losses, diff DESC, team))
SELECT team, division, wins, losses, diff, CAST(division_rank AS INT) AS division_rank, ((lw - wins) + (losses - ll)) / 2e0 AS games_back FROM r""")
def w18_standings(spark, sf_dir):
    """O-A23, O-W18: standings with a full tie-break, games back from the leader."""
    log = team_log(games(spark, sf_dir))
    t = log.groupBy("team").agg(F.sum("win").cast("long").alias("wins"), F.sum(1 - F.col("win")).cast("long").alias("losses"), F.sum(F.col("scored") - F.col("allowed")).alias("diff"))
    t = t.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), F.col("n_regionkey").alias("division")), "team")
    w = over(["division"], [F.desc(F.col("wins") / (F.col("wins") + F.col("losses"))), F.desc("wins"), "losses", F.desc("diff"), "team"])
    lead = F.first(F.struct("wins", "losses")).over(w)
    return t.select("team", "division", "wins", "losses", "diff", F.row_number().over(w).alias("division_rank"), ((lead["wins"] - F.col("wins") + F.col("losses") - lead["losses"]) / 2.0).alias("games_back"))


@query(f"""{GL} SELECT team, opponent, game_pk, avg(scored) OVER (PARTITION BY team, opponent ORDER BY game_date, game_pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pair_mean FROM l""")
def w23_pair_mean(spark, sf_dir):
    """O-W23: prior mean over pairs."""
    return team_log(games(spark, sf_dir)).select("team", "opponent", "game_pk", prior("avg", "scored", ["team", "opponent"], ORDER).alias("pair_mean"))


@query(f"""WITH {GAMES_SQL}, t AS (SELECT game_pk, game_date, game_status, home_win, home_team AS team FROM g UNION ALL SELECT game_pk, game_date, game_status, home_win, away_team FROM g),
a AS (SELECT team, game_pk, row_number() OVER (PARTITION BY team ORDER BY game_date DESC, game_pk DESC) AS k FROM t WHERE home_win IS NOT NULL),
b AS (SELECT team, game_pk, row_number() OVER (PARTITION BY team ORDER BY game_date, game_pk) AS k FROM t WHERE game_status = 'scheduled')
SELECT team, a.game_pk AS last_game, b.game_pk AS next_game FROM (SELECT DISTINCT team FROM t) x LEFT JOIN (SELECT * FROM a WHERE k = 1) a USING (team) LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (team)""")
def w25_last_and_next(spark, sf_dir):
    """O-W25: last completed and next scheduled game, without a window."""
    g = games(spark, sf_dir)
    t = g.select("game_pk", "game_date", "game_status", "home_win", F.explode(F.array("home_team", "away_team")).alias("team"))
    key = F.struct("game_date", "game_pk")
    return t.groupBy("team").agg(F.max(F.when(F.col("home_win").isNotNull(), key))["game_pk"].alias("last_game"), F.min(F.when(F.col("game_status") == "scheduled", key))["game_pk"].alias("next_game"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_type, event_id, CAST(k AS INT) AS version FROM r WHERE k <= 5""")
def w22_newest_versions(spark, sf_dir):
    """O-W22, O-W24: keep the newest five of each kind."""
    w = over(["event_type"], [F.desc("ts"), F.desc("event_id")])
    return table(spark, sf_dir, "events").withColumn("version", F.row_number().over(w)).where("version <= 5").select("event_type", "event_id", "version")


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT user_id, max(CASE WHEN event_type = 'click' THEN n / t END) AS mix_click, max(CASE WHEN event_type = 'purchase' THEN n / t END) AS mix_purchase, max(CASE WHEN event_type = 'signup' THEN n / t END) AS mix_signup
FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS t FROM p) q GROUP BY user_id""")
def r03_pivot_mix(spark, sf_dir):
    """O-R3, O-A4: share of each kind as columns."""
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("t"), *[F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "purchase", "signup")])
    return p.select("user_id", *[F.when(F.col(k) > 0, F.col(k) / F.col("t")).alias(f"mix_{k}") for k in ("click", "purchase", "signup")])


@query("""WITH s AS (SELECT l_orderkey AS game, l_partkey AS player, min(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY seq, player) AS slot FROM s)
SELECT n.game, CAST(n.slot AS INT) AS slot, n.player, avg(p_retailprice) OVER (PARTITION BY n.game) AS lineup_mean, avg(CASE WHEN slot <= 4 THEN p_retailprice END) OVER (PARTITION BY n.game) AS top4_mean FROM n JOIN part ON p_partkey = n.player WHERE slot <= 9""")
def r04_lineups(spark, sf_dir):
    """O-R4, R5, O-A6: first nine of each game as an array, exploded with positions, group means."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game"), F.col("l_partkey").alias("player")).agg(F.min("l_linenumber").alias("seq"))
    first = s.groupBy("game").agg(F.slice(F.sort_array(F.collect_list(F.struct("seq", "player"))), 1, 9).alias("ids"))
    slots = first.select("game", F.posexplode("ids").alias("pos", "x")).select("game", (F.col("pos") + 1).alias("slot"), F.col("x.player").alias("player"))
    v = slots.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), "p_retailprice"), "player")
    w = Window.partitionBy("game")
    return v.select("game", "slot", "player", F.avg("p_retailprice").over(w).alias("lineup_mean"), F.avg(F.when(F.col("slot") <= 4, F.col("p_retailprice"))).over(w).alias("top4_mean"))
