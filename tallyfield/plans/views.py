"""The driver's tables seen as sports data, as DataFrames and as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfield.session import table

GAMES_SQL = """g AS (
SELECT game_pk, game_date, season, home_team, away_team, home_starter_id, away_starter_id,
       home_score, away_score, game_status,
       CASE WHEN game_status <> 'final' OR home_score = away_score THEN NULL
            WHEN home_score > away_score THEN 1 ELSE 0 END AS home_win,
       CASE WHEN game_pk % 2 = 0 THEN -(101e0 + om) ELSE 100e0 + om END AS open_home_ml,
       CASE WHEN game_pk % 2 = 0 THEN 100e0 + om ELSE -(101e0 + om) END AS open_away_ml,
       CASE WHEN game_pk % 2 = 0 THEN -(101e0 + cm) ELSE 100e0 + cm END AS close_home_ml,
       CASE WHEN game_pk % 2 = 0 THEN 100e0 + cm ELSE -(101e0 + cm) END AS close_away_ml,
       0.05e0 + 0.9e0 * (pm / 997e0) AS model_prob
FROM (SELECT o_orderkey AS game_pk, CAST(o_orderdate AS DATE) AS game_date,
             CAST(year(o_orderdate) AS INT) AS season, c_nationkey AS home_team,
             CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INT) AS away_team,
             o_custkey AS home_starter_id, (o_custkey * 31 + 7) % 1500 AS away_starter_id,
             CAST(floor(o_totalprice) AS BIGINT) % 13 AS home_score,
             CAST(floor(o_totalprice / 13e0) AS BIGINT) % 13 AS away_score,
             CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'P' THEN 'postponed' ELSE 'final' END AS game_status,
             CAST(floor(o_totalprice * 11e0) AS BIGINT) % 300 AS om,
             CAST(floor(o_totalprice * 7e0) AS BIGINT) % 300 AS cm,
             CAST(floor(o_totalprice * 100e0) AS BIGINT) % 997 AS pm
      FROM orders JOIN customer ON c_custkey = o_custkey) t)"""

LOG_SQL = """l AS (
SELECT game_pk, game_date, season, home_team AS team, away_team AS opponent, CAST(home_win AS DOUBLE) AS win, 1 AS is_home, home_score AS scored, away_score AS allowed FROM g WHERE home_win IS NOT NULL
UNION ALL
SELECT game_pk, game_date, season, away_team, home_team, CAST(1 - home_win AS DOUBLE), 0, away_score, home_score FROM g WHERE home_win IS NOT NULL)"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and customer as two-sided games."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    price = F.col("o_totalprice")
    whole = lambda c: F.floor(c).cast("long")
    g = o.select(
        F.col("o_orderkey").alias("game_pk"),
        F.to_date("o_orderdate").alias("game_date"),
        F.year("o_orderdate").alias("season"),
        F.col("c_nationkey").alias("home_team"),
        ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("int").alias("away_team"),
        F.col("o_custkey").alias("home_starter_id"),
        ((F.col("o_custkey") * 31 + 7) % 1500).alias("away_starter_id"),
        (whole(price) % 13).alias("home_score"),
        (whole(price / 13.0) % 13).alias("away_score"),
        F.when(F.col("o_orderstatus") == "O", "scheduled").when(F.col("o_orderstatus") == "P", "postponed").otherwise("final").alias("game_status"),
        (whole(price * 11.0) % 300).alias("om"),
        (whole(price * 7.0) % 300).alias("cm"),
        (whole(price * 100.0) % 997).alias("pm"),
    )
    even = F.col("game_pk") % 2 == 0
    minus, plus = (lambda m: -(101.0 + F.col(m))), (lambda m: 100.0 + F.col(m))
    win = F.when((F.col("game_status") != "final") | (F.col("home_score") == F.col("away_score")), None).when(F.col("home_score") > F.col("away_score"), 1).otherwise(0)
    lines = {f"{when}_{side}_ml": F.when(even, minus(m) if side == "home" else plus(m)).otherwise(plus(m) if side == "home" else minus(m)) for when, m in (("open", "om"), ("close", "cm")) for side in ("home", "away")}
    return g.withColumns({"home_win": win, **lines, "model_prob": 0.05 + 0.9 * (F.col("pm") / 997.0)}).drop("om", "cm", "pm")


def team_log(games_: DataFrame) -> DataFrame:
    """Two rows a settled game, one for each team."""
    s = games_.where("home_win is not null")
    side = lambda me, other, win, home: s.select("game_pk", "game_date", "season", F.col(f"{me}_team").alias("team"), F.col(f"{other}_team").alias("opponent"), win.cast("double").alias("win"), F.lit(home).alias("is_home"), F.col(f"{me}_score").alias("scored"), F.col(f"{other}_score").alias("allowed"))
    return side("home", "away", F.col("home_win"), 1).unionByName(side("away", "home", 1 - F.col("home_win"), 0))


def pitched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines with their supplier's team as a pitcher's plays on a day d, each team's number of pitchers, and its days with plays."""
    staff = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pitcher"), F.col("s_nationkey").alias("team"))
    plays = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pitcher"), F.to_date("l_shipdate").alias("d"), "l_quantity", "l_returnflag").join(staff, "pitcher")
    return plays, staff.groupBy("team").agg(F.count("*").alias("__keys")), plays.select("team", F.col("d").alias("day")).distinct()
