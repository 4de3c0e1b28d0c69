"""Names looked up in a list of full names, and flags of the calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.scalars import days_since, era_flags, folded_name, listed_code, night
from tallyfield.plans.base import query
from tallyfield.plans.views import GAMES_SQL, games
from tallyfield.session import table

#: Full names and their codes; of several that fit in part the first counts.
LISTED = {"red widget": "RW", "blue bolt": "BB", "hot gear": "HG", "small gizmo": "SG", "small and ring": "SR", "cold plate": "CP"}

#: The middle of each season; one season is unknown.
MIDDLE = {1992: "1992-07-14", 1993: "1993-07-13", 1994: "1994-07-12", 1996: "1996-07-09", 1997: "1997-07-08", 1998: "1998-07-07"}

#: Named eras of the games: first and last season, None where it is open.
ERAS = {"post_rule_change": (1997, None), "post_dh_era": (1996, None), "short_era": (1994, 1994)}

ZONE = "America/New_York"


@query(f"""WITH a(i, full_name, code) AS (VALUES {", ".join(f"({i}, '{f}', '{c}')" for i, (f, c) in enumerate(LISTED.items()))}),
r AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN replace(p_name, ' ', ' & ') WHEN 3 THEN split_part(p_name, ' ', 1)
             WHEN 4 THEN '  The ' || upper(p_name) || '.' WHEN 5 THEN ' ' END AS raw FROM part),
t AS (SELECT p_partkey, raw, trim(raw) AS name FROM r),
near AS (SELECT p_partkey, arg_min(code, i) AS code FROM t JOIN a ON name <> '' AND (contains(lower(full_name), lower(name)) OR contains(lower(name), lower(full_name))) GROUP BY 1)
SELECT t.p_partkey, trim(replace(translate(lower(raw), '-.''', ' '), '&', 'and')) AS folded, coalesce(a.code, near.code) AS code
FROM t LEFT JOIN a ON a.full_name = t.name LEFT JOIN near ON near.p_partkey = t.p_partkey""")
def x13_listed(spark, sf_dir):
    """O-X13: folded names (& as and), and the code of the listed name that is equal, else of the first that holds the name or is held by it."""
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = (
        F.when(k % 7 == 0, name)
        .when(k % 7 == 1, F.replace(name, F.lit(" "), F.lit("-")))
        .when(k % 7 == 2, F.replace(name, F.lit(" "), F.lit(" & ")))
        .when(k % 7 == 3, F.split_part(name, F.lit(" "), F.lit(1)))
        .when(k % 7 == 4, F.concat(F.lit("  The "), F.upper(name), F.lit(".")))
        .when(k % 7 == 5, " ")
    )
    r = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return r.select("p_partkey", folded_name(F.col("raw")).alias("folded"), listed_code(F.col("raw"), LISTED).alias("code"))


@query(f"""WITH {GAMES_SQL}, m(season, middle) AS (VALUES {", ".join(f"({y}, DATE '{d}')" for y, d in MIDDLE.items())})
SELECT game_pk, CAST(month(game_date) AS INT) AS month, CAST(isodow(game_date) - 1 AS INT) AS day_of_week, CAST(greatest(coalesce(game_date - middle, 0), 0) AS INT) AS since_middle,
CAST(g.season >= 1997 AS INT) AS post_rule_change, CAST(g.season >= 1996 AS INT) AS post_dh_era, CAST(g.season = 1994 AS INT) AS short_era
FROM g LEFT JOIN m ON m.season = g.season""")
def x15_season(spark, sf_dir):
    """O-X15: month, weekday from Monday, days since the season's middle (0 before it and where it is unknown), era flags."""
    d, season = F.col("game_date"), F.col("season")
    eras = [c.alias(name) for name, c in era_flags(season, ERAS).items()]
    return games(spark, sf_dir).select("game_pk", F.month(d).alias("month"), F.weekday(d).alias("day_of_week"), days_since(d, season, MIDDLE).alias("since_middle"), *eras)


@query(f"""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 1 ELSE CAST(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}') >= 17 AS INT) END AS night FROM events""")
def x15_night(spark, sf_dir):
    """O-X15: whether something begins at 17 o'clock or later where it takes place; a missing time counts as night."""
    ts = F.when(F.col("event_id") % 17 != 0, F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", night(ts, ZONE).alias("night"))
