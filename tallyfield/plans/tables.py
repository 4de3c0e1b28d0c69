"""Scans, joins, aggregates, sets, order, quality, learning and streams (O-IO*, O-J*, O-A*, O-U*, O-S*, O-Q*, O-E*, O-ST*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import joins as J
from tallyfield.operators.order import stored
from tallyfield.operators.quality import Contract, audit, broken_rules, fingerprint
from tallyfield.plans.base import query
from tallyfield.plans.market import priced
from tallyfield.plans.views import GAMES_SQL, games
from tallyfield.session import table

G = f"WITH {GAMES_SQL}"


@query(f"{G} SELECT game_pk, game_date, home_team FROM g WHERE season = 1996 AND home_win IS NULL AND game_status NOT IN ('postponed', 'cancelled')")
def io01_scan(spark, sf_dir):
    """O-IO1, O-F1, F2: pushed predicates, unsettled and active games."""
    return games(spark, sf_dir).where("season = 1996 and home_win is null").where(~F.col("game_status").isin("postponed", "cancelled")).select("game_pk", "game_date", "home_team")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(coalesce(json_array_length(json_keys(props)), 0) AS INT) AS n_keys FROM events")
def io02_open_schema(spark, sf_dir):
    """O-IO2, O-X20: a JSON map's keys as columns."""
    e = table(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.size(F.map_keys(m)), F.lit(0)).alias("n_keys"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, min(CASE WHEN turn = 0 THEN role END) AS first_role FROM conversations GROUP BY conv_id")
def io07_nested(spark, sf_dir):
    """O-IO3, IO7, O-R6: fold rows to nested JSON, parse it again with a schema, explode, aggregate."""
    c = table(spark, sf_dir, "conversations")
    doc = c.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role", "text"))).alias("doc"))
    rows = doc.select("conv_id", F.inline_outer(F.from_json("doc", "array<struct<turn:bigint,role:string,text:string>>")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min(F.when(F.col("turn") == 0, F.col("role"))).alias("first_role"))


@query("WITH r AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 9 END, event_id) AS k FROM events WHERE value IS NOT NULL) SELECT user_id, event_type, event_id FROM r WHERE k = 1")
def io08_preferred_book(spark, sf_dir):
    """O-IO8: first preferred source with a value."""
    pref = F.array_position(F.array(F.lit("purchase"), F.lit("signup")), F.col("event_type"))
    order = F.struct(F.when(pref > 0, pref).otherwise(9).alias("p"), "event_id")
    return table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.min(F.struct(order.alias("o"), "event_type", "event_id")).alias("r")).select("user_id", "r.event_type", "r.event_id")


@query("SELECT l_shipmode_day AS day, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(l_shipdate AS DATE) AS l_shipmode_day FROM lineitem WHERE year(l_shipdate) = 1996 AND month(l_shipdate) <= 3) t GROUP BY 1")
def io05_partitioned(spark, sf_dir):
    """O-IO5, IO6: daily files in a partitioned dataset of the shared folder, read back with pruning."""
    from tallyfield.sources.store import partitioned

    x = table(spark, sf_dir, "lineitem").where("year(l_shipdate) = 1996").select("l_orderkey", F.to_date("l_shipdate").alias("day"))
    return partitioned(x.withColumn("month", F.month("day")), "month").where("month <= 3").groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_quantity > 45)")
def j03_semi_anti(spark, sf_dir):
    """O-J2..J5: EXISTS and NOT EXISTS."""
    o, l = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem")
    on = F.col("o_orderkey") == F.col("l_orderkey")
    return o.join(l.where("l_returnflag = 'R'"), on, "left_semi").join(l.where("l_linestatus = 'O' and l_quantity > 45"), on, "left_anti")


@query(f"{G} SELECT game_pk, h.n_name AS home_name, a.n_name AS away_name, p.wins AS home_prior_wins FROM g JOIN nation h ON h.n_nationkey = home_team JOIN nation a ON a.n_nationkey = away_team LEFT JOIN (SELECT home_team AS t, season AS s, CAST(sum(home_win) AS BIGINT) AS wins FROM g GROUP BY 1, 2) p ON p.t = home_team AND p.s = season - 1")
def j06_double_lookup(spark, sf_dir):
    """O-J1, J6, J7: one dimension twice, prior season."""
    g, n = games(spark, sf_dir), table(spark, sf_dir, "nation")
    prior = g.groupBy(F.col("home_team"), (F.col("season") + 1).alias("season")).agg(F.sum("home_win").alias("home_prior_wins"))
    for side in ("home", "away"):
        g = g.join(n.select(F.col("n_nationkey").alias(f"{side}_team"), F.col("n_name").alias(f"{side}_name")), f"{side}_team")
    return g.join(prior, ["home_team", "season"], "left").select("game_pk", "home_name", "away_name", "home_prior_wins")


@query("WITH a AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CAST(suppliers AS BIGINT) AS suppliers, CAST(customers AS BIGINT) AS customers FROM a FULL OUTER JOIN b ON a.k = b.k")
def j08_full_outer(spark, sf_dir):
    """O-J8, IO9: full-outer merge of two dimension sources."""
    a = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full_outer")


@query("WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'signup' GROUP BY 1, 2) SELECT p.event_id, p.user_id, s.ts AS right_ts, s.value AS seen FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts")
def j09_asof(spark, sf_dir):
    """O-J9, J10: backward as-of join in one shuffle."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("value").alias("seen"))
    return J.asof_backward(left, right, ["user_id"], "ts", ["seen"]).select("event_id", "user_id", "right_ts", "seen")


@query("WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), s AS (SELECT event_id AS other, user_id, ts AS rts FROM events WHERE event_type = 'click'), j AS (SELECT p.event_id, s.other, abs(epoch(date_trunc('second', p.ts)) - epoch(date_trunc('second', s.rts))) AS gap, s.rts FROM p JOIN s USING (user_id)), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, rts, other) AS k FROM j WHERE gap <= 86400) SELECT event_id, other, CAST(gap AS BIGINT) AS gap FROM r WHERE k = 1")
def j11_nearest(spark, sf_dir):
    """O-J11, J12: nearest in time with a tolerance."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("rts"))
    return J.nearest(left, right, ["user_id"], "event_id", "ts", "rts", 86400, "other").select("event_id", "other", "gap")


@query(f"{G}, k AS (SELECT game_date, home_team, away_team, max(game_pk) AS game_pk FROM g GROUP BY 1, 2, 3 HAVING count(*) = 1) SELECT k.game_pk, o.n AS feed FROM k JOIN (SELECT home_team, away_team, game_date, count(*) AS n FROM g WHERE game_status = 'final' GROUP BY 1, 2, 3) o USING (home_team, away_team, game_date)")
def j15_guarded(spark, sf_dir):
    """O-J15: join only where the key is unique on the left."""
    g = games(spark, sf_dir)
    key = ["home_team", "away_team", "game_date"]
    feed = g.where("game_status = 'final'").groupBy(*key).agg(F.count("*").alias("feed"))
    return J.unambiguous(g.select("game_pk", *key), feed, key).select("game_pk", "feed")


@query("SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k GROUP BY 1")
def j17_key_overlap(spark, sf_dir):
    """O-J17, U2, U3: overlap of two key sets."""
    o = table(spark, sf_dir, "orders")
    return J.key_overlap(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), ["o_custkey"])


@query("SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 9) AS mean_purchase, max(value) AS top FROM events GROUP BY 1, 2")
def a01_event_rollup(spark, sf_dir):
    """O-A1, A2, A3: indicator sums, filtered means and distinct counts in one aggregate."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 9).alias("mean_purchase"), F.max("value").alias("top"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS weighted_price, round(sum(l_discount) / nullif(sum(l_tax), 0), 9) AS ratio, round(avg((coalesce(l_discount, 0) + coalesce(nullif(l_tax, 0), 0)) / (1 + CASE WHEN l_tax <> 0 THEN 1 ELSE 0 END)), 9) AS row_mean FROM lineitem GROUP BY 1")
def a04_weighted(spark, sf_dir):
    """O-A4, A5, A8: weighted mean, null-safe ratio, mean of available values."""
    from tallyfield.functions.scalars import mean_of

    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * q) / F.sum(q), 6).alias("weighted_price"), F.round(F.try_divide(F.sum("l_discount"), F.nullif(F.sum("l_tax"), F.lit(0.0))), 9).alias("ratio"), F.round(F.avg(mean_of(F.col("l_discount"), F.when(F.col("l_tax") != 0, F.col("l_tax")))), 9).alias("row_mean"))


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(year(l_shipdate) AS INT) AS season, round(avg(CASE WHEN nullif({c}, 0) IS NOT NULL THEN 1e0 ELSE 0e0 END), 9) AS coverage, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, round(stddev_samp({c}), 6) AS std FROM lineitem GROUP BY 2" for c in COLS))
def a09_profile(spark, sf_dir):
    """O-A9, A10, A25, Q10: coverage, distinct values and spread of each feature by season; one pass."""
    l = table(spark, sf_dir, "lineitem")
    long = l.select(F.year("l_shipdate").alias("season"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in COLS])).alias("x")).select("season", "x.*")
    return long.groupBy("feature", "season").agg(F.round(F.avg((F.col("v") != 0).cast("double")), 9).alias("coverage"), F.countDistinct("v").alias("n_distinct"), F.round(F.stddev_samp("v"), 6).alias("std"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) SELECT user_id, CAST(ts AS DATE) AS day, event_id, value FROM r WHERE k = 1")
def a11_first_of_day(spark, sf_dir):
    """O-A11, A12: first row of each day under a total order."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "day", "r.event_id", "r.value")


@query("WITH m AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem) SELECT CAST(least(floor((l_extendedprice - a) / ((b - a) / 40e0)), 39) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem, m GROUP BY 1")
def a16_histogram(spark, sf_dir):
    """O-A16: 40 equal bins, the last closed."""
    l = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    m = l.agg(F.min("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("b"))
    x = l.crossJoin(F.broadcast(m))  # one row
    return x.groupBy(F.least(F.floor((F.col("l_extendedprice") - F.col("a")) / ((F.col("b") - F.col("a")) / 40.0)), F.lit(39)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, o_totalprice AS v, 'old' AS src FROM orders o WHERE o_orderkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderkey = o.o_orderkey AND n.o_orderkey % 2 = 0) UNION ALL SELECT o_orderkey, o_totalprice * 2, 'new' FROM orders WHERE o_orderkey % 2 = 0")
def u04_cache_merge(spark, sf_dir):
    """O-U1, U4, R8: new rows win, the rest stays."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit("old").alias("src"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("v"), F.lit("new").alias("src"))
    return old.join(new, "k", "left_anti").unionByName(new, allowMissingColumns=True)


@query(f"{G}, s AS (SELECT min(game_date) AS d FROM g WHERE game_status = 'scheduled' AND game_date >= DATE '1996-07-01') SELECT game_pk, game_date FROM g, s WHERE game_date = d AND game_status = 'scheduled'")
def s04_next_slot(spark, sf_dir):
    """O-S4: all games of the earliest qualifying slot, ties kept."""
    g = games(spark, sf_dir).where("game_status = 'scheduled'").select("game_pk", "game_date")
    s = g.where("game_date >= date '1996-07-01'").agg(F.min("game_date").alias("d"))
    return g.join(F.broadcast(s), F.col("game_date") == F.col("d")).drop("d")


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 20")
def s06_recent(spark, sf_dir):
    """O-S1, S3, S5, S6, IO12: a top-k report."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").select("event_id", "user_id", "ts").limit(20)


RULES = [Contract("l_quantity", 1, 45, 0.1), Contract("l_discount", 0, 0.1, 0.0, True), Contract("l_tax", 0, 0.06, 0.0, True), Contract("l_extendedprice", 0, 50000)]


@query(" UNION ALL ".join(f"SELECT '{c.column}' AS \"column\", avg(CASE WHEN {c.column} IS NULL THEN 1e0 ELSE 0e0 END) AS null_share, CAST(count(CASE WHEN {c.column} < {c.low} OR {c.column} > {c.high} THEN 1 END) AS BIGINT) AS violations, CASE WHEN count(CASE WHEN {c.column} < {c.low} OR {c.column} > {c.high} THEN 1 END) > 0 THEN '{'critical' if c.critical else 'warning'}' ELSE 'ok' END AS severity FROM lineitem" for c in RULES))
def q01_audit(spark, sf_dir):
    """O-Q1, Q2, Q4, Q5: contract audit in one pass."""
    return audit(table(spark, sf_dir, "lineitem"), RULES)


@query("SELECT rules, CAST(count(*) AS BIGINT) AS n FROM (SELECT concat_ws(',', CASE WHEN l_quantity > 45 OR l_quantity < 1 THEN 'l_quantity' END, CASE WHEN l_discount > 0.1 OR l_discount < 0 THEN 'l_discount' END, CASE WHEN l_tax > 0.06 OR l_tax < 0 THEN 'l_tax' END, CASE WHEN l_extendedprice > 50000 OR l_extendedprice < 0 THEN 'l_extendedprice' END) AS rules FROM lineitem) t WHERE rules <> '' GROUP BY 1")
def q03_quarantine(spark, sf_dir):
    """O-Q3: violation rows with the list of broken rules."""
    r = table(spark, sf_dir, "lineitem").select(F.array_join(broken_rules(RULES), ",").alias("rules"))
    return r.where("rules <> ''").groupBy("rules").agg(F.count("*").alias("n"))


@query("SELECT CAST((SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS BIGINT) AS orphans, CAST((SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) t) AS BIGINT) AS repeated_keys, CAST((SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) AS BIGINT) AS bad_status")
def q09_keys(spark, sf_dir):
    """O-Q9: foreign keys, unique keys and enums as checks."""
    o, l, c = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "customer"))
    orphans = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("orphans"))
    again = l.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.count("*").alias("repeated_keys"))
    bad = o.agg(F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("bad_status"))
    return orphans.crossJoin(again).crossJoin(bad)  # one row each


@query()
def x21_fingerprint(spark, sf_dir):
    """O-X21, Q8: order-free content hash of a table."""
    return fingerprint(table(spark, sf_dir, "lineitem"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 9) AS quantity_price, round(corr(l_discount, l_extendedprice), 9) AS discount_price, round(corr(l_tax, l_quantity), 9) AS tax_quantity FROM lineitem")
def e15_correlations(spark, sf_dir):
    """O-E15: pairwise correlations in one pass (the greedy prune walks this small matrix)."""
    r = lambda a, b: F.round(F.corr(a, b), 9)
    return table(spark, sf_dir, "lineitem").agg(r("l_quantity", "l_extendedprice").alias("quantity_price"), r("l_discount", "l_extendedprice").alias("discount_price"), r("l_tax", "l_quantity").alias("tax_quantity"))


@query()
def e02_walk_forward(spark, sf_dir):
    """O-E2, E4, E8: logistic model for each year with enough games before it, recency weights, blend with the market, scores."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    g = priced(spark, sf_dir).where("home_win is not null").select("game_date", F.col("home_win").cast("double").alias("label"), "market", (F.col("ch") - F.col("oh")).alias("move"), F.col("model_prob").alias("prior"))
    g = stored(g)  # each fold's steps read it, and so do the scores
    sizes = sorted((r["year"], r["count"]) for r in g.groupBy(F.year("game_date").alias("year")).count().collect())  # one row a year
    folds = [(y, sum(n for before, n in sizes if before < y), n) for y, n in sizes]
    out = None
    for year in [y for y, n_train, n_test in folds if n_train >= 200 and n_test >= 20]:  # the newest is open
        start = F.lit(f"{year}-01-01").cast("date")
        train = g.where(F.col("game_date") < start).withColumn("w", F.pow(F.lit(0.5), F.datediff(start, "game_date") / 730.0))
        steps = [Imputer(inputCols=["market", "move", "prior"], outputCols=["a", "b", "c"], strategy="median"), VectorAssembler(inputCols=["a", "b", "c"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(weightCol="w", regParam=0.01, elasticNetParam=0.5, maxIter=20)]
        scored = Pipeline(stages=steps).fit(train).transform(g.where((F.col("game_date") >= start) & (F.year("game_date") == year)))
        p = F.get(_array("probability"), 1)
        s = scored.select(F.lit(year).alias("fold"), p.alias("p"), "market", "label").withColumn("blend", 0.5 * F.col("p") + 0.5 * F.col("market"))
        loss = lambda c: F.avg(-(F.col("label") * F.log(c) + (1 - F.col("label")) * F.log(1 - F.col(c))))
        s = s.groupBy("fold").agg(F.count("*").alias("n"), F.round(loss("p"), 6).alias("log_loss"), F.round(loss("blend"), 6).alias("blend_loss"))
        out = s if out is None else out.unionByName(s)
    return out


def _array(c):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(c)


@query()
def p01_slate(spark, sf_dir):
    """O-P1: joint stakes of a slate's bets by projected gradient on expected log growth; slates in parallel."""
    import numpy as np

    def size(pdf):
        p, b = pdf.sp.to_numpy(), pdf.sd.to_numpy() - 1
        f = np.zeros(len(p))
        for _ in range(200):
            f += 0.05 * (p * b / (1 + f * b) - (1 - p) / (1 - f))
            f = np.clip(f, 0, 0.05)
            if f.sum() > 0.25:  # project to the cap by one common shift
                lo, hi = 0.0, f.max()
                for _ in range(30):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if np.clip(f - mid, 0, 0.05).sum() > 0.25 else (lo, mid)
                f = np.clip(f - hi, 0, 0.05)
        return pdf[["game_date", "game_pk"]].assign(stake=f)

    s = priced(spark, sf_dir).where("side is not null").select("game_date", "game_pk", "sp", "sd")
    return s.groupBy("game_date").applyInPandas(size, "game_date date, game_pk long, stake double")
