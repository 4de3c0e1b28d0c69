"""Projections, work lists, repairs, marks and stateful updates (O-F*, O-IO*, O-J*, O-M*, O-S*, O-X*)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from tallyfield.functions.orders import final_result, payout, stop_loss
from tallyfield.functions.scalars import date_code, humanise
from tallyfield.plans.base import query
from tallyfield.plans.market import O_SQL, priced
from tallyfield.plans.views import GAMES_SQL, games
from tallyfield.session import table
from tallyfield.sources.store import shared_folder

G = f"WITH {GAMES_SQL}"


@query("SELECT o_orderkey AS k, o_totalprice AS v, 'none' AS status FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 <> 0")
def io04_csv_union(spark, sf_dir):
    """O-IO4, O-U1: history as CSV files, read with a schema, united with current rows that have one column more."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("status"))
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    o.where("k % 2 = 0").drop("status").write.option("header", True).csv(path)
    history = spark.read.schema("k long, v double").option("header", True).csv(path)
    return history.unionByName(o.where("k % 2 <> 0"), allowMissingColumns=True).fillna("none", ["status"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'long line' AS reason, CAST(count(CASE WHEN abs({c}) > 300 THEN 1 END) AS BIGINT) AS rows_affected, round(avg(abs({c})), 6) AS before, round(avg(CASE WHEN abs({c}) <= 300 THEN abs({c}) END), 6) AS after FROM g".replace("FROM g", f"FROM ({G} SELECT * FROM g) t") for c in ("open_home_ml", "close_home_ml")))
def io10_repair_log(spark, sf_dir):
    """O-IO10, Q7: one nested record a repair, appended to a table."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    g = games(spark, sf_dir)
    for c in ("open_home_ml", "close_home_ml"):
        size = F.abs(c)
        details = F.struct(F.round(F.avg(size), 6).alias("before"), F.round(F.avg(F.when(size <= 300, size)), 6).alias("after"))
        g.agg(F.count_if(size > 300).alias("rows_affected"), details.alias("details")).select(F.lit(c).alias("column"), F.lit("long line").alias("reason"), "rows_affected", "details").write.mode("append").parquet(path)
    return spark.read.parquet(path).select("column", "reason", "rows_affected", "details.before", "details.after")


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND CAST(c.ts AS DATE) = CAST(p.ts AS DATE) AND (day(c.ts) <= 20 OR hour(c.ts) >= 12))")
def io11_fetch_list(spark, sf_dir):
    """O-IO11: needed keys without a cached row; rows of volatile days count only if they are fresh."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    cached = e.where("event_type = 'click'").where((F.dayofmonth("ts") <= 20) | (F.hour("ts") >= 12))
    return e.where("event_type = 'purchase'").select("user_id", "day").distinct().join(cached, ["user_id", "day"], "left_anti")


@query(f"{G} SELECT game_pk, home_score - away_score AS score_diff, home_starter_id - away_starter_id AS starter_diff, CASE WHEN home_team = 3 AND game_date >= DATE '1995-06-01' THEN 99 ELSE home_team END AS venue, coalesce(nullif(home_score, 0), away_score) AS first_known, CASE WHEN home_score <> 0 OR away_score <> 0 THEN home_score ELSE -1 END AS filled, -1e0 AS humidity FROM g WHERE game_date < DATE '1997-01-01' AND NOT coalesce(abs(open_home_ml) > 390 OR abs(close_home_ml) > 390, false)")
def f03_contract(spark, sf_dir):
    """O-F3, F4, F6..F9, F11: implausible rows, cut-off, patch, differences, fallback, group fill, padded schema."""
    g = games(spark, sf_dir).where("game_date < date '1997-01-01'").where(~F.coalesce((F.abs("open_home_ml") > 390) | (F.abs("close_home_ml") > 390), F.lit(False)))
    known = {s: F.nullif(F.col(f"{s}_score"), F.lit(0)) for s in ("home", "away")}
    pairs = [("score_diff", "home_score", "away_score"), ("starter_diff", "home_starter_id", "away_starter_id")]
    pad = F.col("humidity") if "humidity" in g.columns else F.lit(None).cast("double")
    return g.select(
        "game_pk",
        *[(F.col(a) - F.col(b)).alias(n) for n, a, b in pairs],
        F.when((F.col("home_team") == 3) & (F.col("game_date") >= F.lit("1995-06-01").cast("date")), 99).otherwise(F.col("home_team")).alias("venue"),
        F.coalesce(known["home"], F.col("away_score")).alias("first_known"),
        F.when(F.coalesce(*known.values()).isNotNull(), F.coalesce(known["home"], F.lit(0))).otherwise(-1).alias("filled"),
        F.coalesce(pad, F.lit(-1.0)).alias("humidity"),
    )


@query("SELECT event_id, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS local_day FROM events WHERE CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-11'")
def f05_local_day(spark, sf_dir):
    """O-F5: rows of two days of a user's calendar; the scan prunes by a bound in UTC first."""
    day = F.to_date(F.from_utc_timestamp("ts", "America/New_York"))
    near = F.col("ts").between(F.lit("2024-01-09").cast("timestamp"), F.lit("2024-01-13").cast("timestamp"))
    return table(spark, sf_dir, "events").where(near).select("event_id", day.alias("local_day")).where("local_day between date '2024-01-10' and date '2024-01-11'")


@query(f"{G} SELECT game_pk FROM (SELECT game_pk, CASE WHEN game_pk % 5 <> 0 THEN home_starter_id END AS listed, CASE WHEN game_pk % 11 <> 0 THEN home_starter_id + CASE WHEN game_pk % 7 = 0 THEN 1 ELSE 0 END END AS actual FROM g) t WHERE NOT (listed IS NOT NULL AND actual IS NOT NULL AND listed <> actual)")
def f12_same_starter(spark, sf_dir):
    """O-F12: games whose listed starter played; unknown counts as unchanged."""
    k, s = F.col("game_pk"), F.col("home_starter_id")
    t = games(spark, sf_dir).select("game_pk", F.when(k % 5 != 0, s).alias("listed"), F.when(k % 11 != 0, s + F.when(k % 7 == 0, 1).otherwise(0)).alias("actual"))
    return t.where(F.coalesce(F.col("listed") == F.col("actual"), F.lit(True))).select("game_pk")


@query(f"{G}, t AS (SELECT game_pk, game_pk % 10 + 1 AS inning, game_pk % 5 + 7 AS total, CASE WHEN game_pk % 2 = 0 THEN away_score - home_score ELSE home_score - away_score END AS behind FROM g) SELECT game_pk, coalesce(behind > 0 AND behind >= CASE WHEN inning = 7 THEN 5 WHEN inning = 8 THEN 4 WHEN inning >= 9 THEN 3 END + CASE WHEN total >= 10 THEN 1 ELSE 0 END, false) AS stop FROM t")
def f14_stop_loss(spark, sf_dir):
    """O-F14: stop-loss rule of an order on live state."""
    k = F.col("game_pk")
    side = F.when(k % 2 == 0, "home").otherwise("away")
    return games(spark, sf_dir).select("game_pk", stop_loss(side, k % 10 + 1, F.col("home_score"), F.col("away_score"), k % 5 + 7).alias("stop"))


@query("WITH d AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' AND value > 60 THEN value END) AS prediction, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, max(ts) AS tried FROM events GROUP BY 1) SELECT c_custkey, CASE WHEN user_id IS NULL THEN 'new' WHEN prediction IS NULL THEN 'empty' WHEN errors > 15 THEN 'retry' ELSE 'stale' END AS reason FROM customer LEFT JOIN d ON user_id = c_custkey WHERE user_id IS NULL OR prediction IS NULL OR errors > 15 OR tried < TIMESTAMP '2024-01-28'")
def j05_worklist(spark, sf_dir):
    """O-J5, ST5: no decision, an empty one, a retryable one or a stale one; facts are aggregated before the join."""
    e = table(spark, sf_dir, "events")
    d = e.groupBy("user_id").agg(F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), F.col("value"))).alias("prediction"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("tried"))
    j = table(spark, sf_dir, "customer").join(d, F.col("c_custkey") == F.col("user_id"), "left")
    reason = F.when(F.col("user_id").isNull(), "new").when(F.col("prediction").isNull(), "empty").when(F.col("errors") > 15, "retry").when(F.col("tried") < F.lit("2024-01-28").cast("timestamp"), "stale")
    return j.select("c_custkey", reason.alias("reason")).where("reason is not null")


_CODE = "upper(strftime(game_date, '%y%b%d')) || lpad(CAST(away_team AS VARCHAR), 2, '0') || lpad(CAST(home_team AS VARCHAR), 2, '0')"


@query(f"""{G}, m AS (SELECT DISTINCT 'KX-' || {_CODE} || '-T' || CAST(game_pk % 4 AS VARCHAR) AS ticker FROM g WHERE game_pk % 3 = 0),
r AS (SELECT game_pk, count(*) AS n, count(CASE WHEN ticker LIKE '%-T' || CAST(game_pk % 4 AS VARCHAR) THEN 1 END) AS nt, min(ticker) AS t1, min(CASE WHEN ticker LIKE '%-T' || CAST(game_pk % 4 AS VARCHAR) THEN ticker END) AS t2 FROM g JOIN m ON contains(ticker, {_CODE}) GROUP BY 1)
SELECT game_pk, CASE WHEN n = 1 THEN t1 ELSE t2 END AS ticker FROM r WHERE n = 1 OR nt = 1""")
def j19_market_codes(spark, sf_dir):
    """O-J19, X22: codes are parsed into columns, so containment becomes an equi-join; the time code settles doubles."""
    team = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    g = games(spark, sf_dir).select("game_pk", F.concat(date_code(F.col("game_date")), team("away_team"), team("home_team")).alias("code"), (F.col("game_pk") % 4).cast("string").alias("slot"))
    m = g.where("game_pk % 3 = 0").select(F.concat(F.lit("KX-"), "code", F.lit("-T"), "slot").alias("ticker")).distinct()
    m = m.select("ticker", F.regexp_extract("ticker", r"^KX-(\w+)-T(\d+)$", 1).alias("code"), F.regexp_extract("ticker", r"^KX-(\w+)-T(\d+)$", 2).alias("at"))
    same = F.col("at") == F.col("slot")
    r = g.join(m, "code").groupBy("game_pk").agg(F.count("*").alias("n"), F.count_if(same).alias("nt"), F.min("ticker").alias("t1"), F.min(F.when(same, F.col("ticker"))).alias("t2"))
    return r.where("n = 1 or nt = 1").select("game_pk", F.when(F.col("n") == 1, F.col("t1")).otherwise(F.col("t2")).alias("ticker"))


@query("WITH v AS (SELECT l_suppkey AS k, l_returnflag AS t, avg(l_discount) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), m AS (SELECT l_suppkey AS k, l_returnflag AS t, count(*) AS m FROM lineitem WHERE l_quantity > 30 GROUP BY 1, 2) SELECT k, round(sum(v * m) / sum(m), 9) AS fit FROM v JOIN m USING (k, t) GROUP BY k")
def a07_mix_fit(spark, sf_dir):
    """O-A7: values by type weighted with the other side's mix, over the types both have; one scan."""
    l = table(spark, sf_dir, "lineitem")
    x = l.groupBy(F.col("l_suppkey").alias("k"), "l_returnflag").agg(F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_discount"))).alias("v"), F.count_if(F.col("l_quantity") > 30).alias("m"))
    return x.where("v is not null and m > 0").groupBy("k").agg(F.round(F.sum(F.col("v") * F.col("m")) / F.sum("m"), 9).alias("fit"))


@query("WITH p AS (SELECT event_id, sum(value) OVER w AS exposure, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, round(9 * n / exposure, 9) AS per_nine FROM p WHERE exposure >= 200")
def w11_exposure(spark, sf_dir):
    """O-W11: rate to date, from a least exposure on."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    p = table(spark, sf_dir, "events").select("event_id", F.sum("value").over(w).alias("exposure"), F.sum((F.col("event_type") == "purchase").cast("int")).over(w).alias("n"))
    return p.where("exposure >= 200").select("event_id", F.round(9 * F.col("n") / F.col("exposure"), 9).alias("per_nine"))


#: Weights of a linear score, by feature.
WEIGHTS = {"l_quantity": 0.31, "l_extendedprice": -0.47, "l_discount": 0.23, "l_tax": 0.59}


_X = {c: f"({w} * ({c} - m_{c}) / s_{c})" for c, w in WEIGHTS.items()}
_BY_SIGN = {n: "array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'x': {sign}{x}, 'f': '{c}'}}" for c, x in _X.items()) + "], lambda s: s.x < 0))[1:2], lambda s: s.f), ',')" for n, sign in (("raises", "-"), ("lowers", ""))}


@query("WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in WEIGHTS) + f" FROM lineitem) SELECT l_orderkey, l_linenumber, round({' + '.join(_X.values())}, 6) AS logit, {_BY_SIGN['raises']} AS raises, {_BY_SIGN['lowers']} AS lowers FROM lineitem, m")
def s02_contributions(spark, sf_dir):
    """O-S2, E20: weight times standardised value, the strongest two of each sign; arrays in the row, no shuffle of rows."""
    l = table(spark, sf_dir, "lineitem")
    m = l.agg(*[x for c in WEIGHTS for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    j = l.crossJoin(F.broadcast(m))  # one row
    parts = F.array(*[F.struct((F.lit(w) * (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias("x"), F.lit(c).alias("feature")) for c, w in WEIGHTS.items()])
    j = j.select("l_orderkey", "l_linenumber", parts.alias("p"))
    strongest = lambda sign: F.array_join(F.transform(F.slice(F.array_sort(F.transform(F.filter("p", lambda s: s["x"] * sign > 0), lambda s: F.struct((-sign * s["x"]).alias("x"), s["feature"].alias("feature")))), 1, 2), lambda s: s["feature"]), ",")
    return j.select("l_orderkey", "l_linenumber", F.round(F.aggregate("p", F.lit(0.0), lambda a, s: a + s["x"]), 6).alias("logit"), strongest(1).alias("raises"), strongest(-1).alias("lowers"))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-20' AND value < 100 ORDER BY ts, event_id LIMIT 25")
def s05_oldest_due(spark, sf_dir):
    """O-S5: the oldest due jobs that may be tried again; a top-k report."""
    return table(spark, sf_dir, "events").where("event_type = 'error' and ts <= timestamp '2024-01-20' and value < 100").orderBy("ts", "event_id").select("event_id", "user_id", "ts").limit(25)


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'new' END, json_extract_string(props, '$.k')) AS k, event_type AS kind, CAST(len(list_distinct(coalesce(json_keys(props), []) || ['kind'] || CASE WHEN event_id % 3 = 0 THEN ['k'] ELSE [] END)) AS INT) AS n_keys FROM events")
def m03_map_merge(spark, sf_dir):
    """O-M3: old and new map merged; keys that the new one has without a value stay as they were."""
    new = F.map_filter(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.when(F.col("event_id") % 3 == 0, "new")), lambda k, v: v.isNotNull())
    old = F.coalesce(F.from_json("props", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    e = table(spark, sf_dir, "events").select("event_id", new.alias("new"), old.alias("old"))
    both = F.map_concat(F.map_filter("old", lambda k, v: ~F.map_contains_key("new", k)), "new")
    return e.withColumn("m", both).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"), F.size("m").alias("n_keys"))


@query("WITH p AS (SELECT user_id, arg_max(value, struct_pack(ts, event_id)) / 500 AS price FROM events WHERE event_type = 'view' GROUP BY 1) SELECT o_orderkey, round(q * price, 6) AS value, round(q * price - o_totalprice, 6) AS unrealised FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 10e0 ELSE o_totalprice / 0.5e0 END AS q FROM orders WHERE o_orderstatus = 'O') o JOIN p ON user_id = o_custkey")
def m13_mark(spark, sf_dir):
    """O-M13, O-X18: open orders at the latest price of their market."""
    p = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg((F.max_by("value", F.struct("ts", "event_id")) / 500).alias("price"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").withColumn("q", F.when(F.col("o_orderkey") % 2 == 0, 10.0).otherwise(F.col("o_totalprice") / 0.5))
    value = F.col("q") * F.col("price")
    return o.join(p, F.col("user_id") == F.col("o_custkey")).select("o_orderkey", F.round(value, 6).alias("value"), F.round(value - F.col("o_totalprice"), 6).alias("unrealised"))


@query(f"{O_SQL} SELECT game_pk, CASE WHEN game_pk % 3 = 0 THEN game_pk % 40 + 1e0 WHEN r IS NOT NULL THEN round(10 * (1 + r), 6) ELSE game_pk % 1000 / 100e0 END AS payout, CASE WHEN game_status = 'final' AND home_score <> away_score THEN CASE WHEN home_score > away_score THEN 'home' ELSE 'away' END ELSE 'none' END AS result FROM k")
def x19_payout(spark, sf_dir):
    """O-X19, X26: payout from contracts, else stake and profit, else cents; a result only of a final game without a tie."""
    k = F.col("game_pk")
    return priced(spark, sf_dir).select("game_pk", payout(F.when(k % 3 == 0, k % 40 + 1), F.lit(10.0), 10.0 * F.col("r"), k % 1000).alias("payout"), F.coalesce(final_result(F.col("game_status"), F.col("home_score"), F.col("away_score")), F.lit("none")).alias("result"))


@query("SELECT p_partkey, upper(substr(lower(p_type), 1, 1)) || substr(lower(p_type), 2) AS label FROM part")
def x23_labels(spark, sf_dir):
    """O-X23: readable labels of column-like names."""
    return table(spark, sf_dir, "part").select("p_partkey", humanise(F.regexp_replace("p_type", " ", "_")).alias("label"))


@query(f"{O_SQL} SELECT game_pk, CASE WHEN abs(close_home_ml) <= 300 AND ch + ca BETWEEN 1e0 AND 1.2e0 AND open_home_ml <> close_home_ml THEN 'updated' ELSE 'skipped' END AS state FROM k WHERE game_pk % 4 = 0 AND game_status = 'final'")
def q06_repair_set(spark, sf_dir):
    """O-Q6: candidates with a valid and moved line are updated, the others listed."""
    valid = (F.abs("close_home_ml") <= 300) & (F.col("ch") + F.col("ca")).between(1.0, 1.2) & (F.col("open_home_ml") != F.col("close_home_ml"))
    return priced(spark, sf_dir).where("game_pk % 4 = 0 and game_status = 'final'").select("game_pk", F.when(valid, "updated").otherwise("skipped").alias("state"))


@query("SELECT user_id, arg_max(value, struct_pack(ts, event_id)) FILTER (WHERE event_type = 'view') AS price, arg_max(event_id, struct_pack(ts, event_id)) AS last_event FROM events GROUP BY 1")
def st02_live_state(spark, sf_dir):
    """O-ST2: live state of a stream; an update without a value leaves the old one."""
    from tallyfield.streaming.run import drain

    at = F.struct("ts", "event_id")
    view = F.col("event_type") == "view"
    return drain(spark, f"{sf_dir}/events.parquet", lambda e: e.groupBy("user_id").agg(F.max_by(F.when(view, F.col("value")), F.when(view, at)).alias("price"), F.max_by("event_id", at).alias("last_event")), "update", ["user_id"])
