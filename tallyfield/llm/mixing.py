"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

A source's target over its size is the (fractional) number of copies of each of its documents.  The
whole part is given to all; the fractional parts are rounded by the pivotal method, weighted by size:
two documents exchange mass so that ``size1 * p1 + size2 * p2`` stays, at random in the direction that
keeps both expectations, until one is 0 or 1.  One document of each pair is settled and the other goes
on, so a block of documents folds to one residual; residuals of blocks meet in the next level of the
tree, until a source has one residual.  About ``RESERVE`` documents of each source, chosen by hash, wait
for it at the root.  There, from the longest on, each exchanges mass with all shorter ones together, as
if they were one document: their common number of copies, anything from 0 to MOST, changes a little, the
document is settled at the whole number above or below, and so on down to the shortest.  Shorter documents
thus make up for a long one by copies more or less than their share's two whole numbers; a source's taken
words miss its target by about its shortest documents.  A document's expected copies are its share, but for
those of the root whose two whole numbers the shorter ones can't both make up for: there the target decides.

Blocks come from hashes of doc_id, so a hot source has as many blocks as it needs and no window or
group holds more than about ``BLOCK`` or ``RESERVE`` documents; random numbers are hashes too, so reruns
agree.  The order of sources takes one task: tens or thousands of sources, not one for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 64
RESERVE = 512
MOST_SOURCES = 100_000  # rows of a table that is broadcast; beyond it joins by source are salted
SALTS = 64
MOST = 3  # a document's size counts at most so many times
SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF, CR; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - edges).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target: one row for each source of ``sizes`` (source, size).

    Sources in code-point order, null last, take ``weights`` in turn.  A target is the least of MOST
    times the source's size and a common level times its weight, the level being such that the
    targets add up to all sizes: what resharing the excess by weight ends at.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(one) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", w).withColumn("cap", MOST * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    done, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(done), F.lit(0.0)))
    # the level at which this source is the first not capped; the true one is the first that its own ratio reaches
    by = by.withColumn("level", level).withColumn("at", F.row_number().over(order)).withColumn("true", F.min(F.when(F.col("ratio") >= F.col("level") * (1 - 1e-12), F.struct("at", "level"))).over(all_)["level"])
    return by.select("source", "source_size", F.least("cap", F.coalesce(F.col("true"), F.lit(0.0)) * F.col("weight")).alias("target"))


def _unit(*cols) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


DOC = ("doc_id", "nth", "u", "size")
SETTLED = "array<struct<p:double,doc_id:bigint,nth:bigint,u:bigint,size:bigint>>"


def _doc(x: Column) -> list[Column]:
    return [x[c].alias(c) for c in DOC]


def _fold(items: Column, seed: int) -> Column:
    """Pivotal rounding of an array of (p, doc): struct of the residual and the settled ones."""

    def step(state: Column, x: Column) -> Column:
        c = state["held"]
        sc, sx = c["size"].cast("double"), x["size"].cast("double")
        # up: c gains what x can give; down: c gives what x can take
        up = F.least(sc * (1 - c["p"]), sx * x["p"])
        down = F.least(sc * c["p"], sx * (1 - x["p"]))
        whole = (up + down) <= 0
        rise = _unit(F.lit(seed), c["u"], x["u"]) * (up + down) < down
        gain = F.when(whole, 0.0).when(rise, up).otherwise(-down)
        settles_c = F.when(whole, (c["p"] <= 0) | (c["p"] >= 1)).when(rise, sc * (1 - c["p"]) <= sx * x["p"]).otherwise(sc * c["p"] <= sx * (1 - x["p"]))
        c_up = F.when(whole, c["p"]).when(rise, 1.0).otherwise(0.0)  # where c settles
        x_up = F.when(whole, x["p"]).when(rise, 0.0).otherwise(1.0)  # where x settles
        settled = F.struct(F.when(settles_c, c_up).otherwise(x_up).alias("p"), *_doc(F.when(settles_c, F.struct(*_doc(c))).otherwise(F.struct(*_doc(x)))))
        p = F.when(settles_c, x["p"] - gain / sx).otherwise(c["p"] + gain / sc)
        left = F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), *_doc(F.when(settles_c, F.struct(*_doc(x))).otherwise(F.struct(*_doc(c)))))
        return F.struct(left.alias("held"), F.concat(state["done"], F.array(settled)).alias("done"))

    start = F.struct(F.element_at(items, 1).alias("held"), F.array().cast(SETTLED).alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def _root(held: Column, items: Column, p: Column, base: Column, seed: int) -> Column:
    """The residual (or null) and the reserve, an array of docs of equal probability ``p``: all, with whole numbers.

    Numbers are copies beyond ``base``; those of the reserve may be any from ``-base`` to ``MOST - base``.
    """
    total = F.aggregate(items, F.lit(0).cast("long"), lambda n, x: n + x["size"])
    first = F.when(held.isNull(), F.array().cast(SETTLED)).otherwise(F.array(held))
    # those of the reserve have no probability of their own: the group's
    queue = F.concat(first, F.transform(F.sort_array(items, asc=False), lambda x: F.struct(F.lit(None).cast("double").alias("p"), *_doc(x))))
    least, most = -base.cast("double"), MOST - base.cast("double")

    def step(state: Column, x: Column) -> Column:
        size, q = x["size"].cast("double"), F.coalesce(x["p"], state["p"])
        whole = F.floor(q + 1e-9).cast("double")
        part = F.greatest(q - whole, F.lit(0.0))
        rest = F.when(x["p"].isNull(), state["left"] - x["size"]).otherwise(state["left"]).cast("double")
        up = F.least(size * (1 - part), rest * (state["p"] - least))
        down = F.least(size * part, rest * (most - state["p"]))
        none = part <= 1e-9
        up_all, down_all = size * (1 - part) - up <= 1e-6, size * part - down <= 1e-6
        # where the shorter ones can make up for one way only, it is that; where for none, the nearer one
        drawn = _unit(F.lit(seed), F.lit("root"), x["u"]) < part
        rise = F.when(up_all & down_all, drawn).when(up_all | down_all, up_all).otherwise(size * (1 - part) - up <= size * part - down)
        one = F.when(~none & rise, 1.0).otherwise(0.0)
        after = F.when(none | (rest <= 0), state["p"]).otherwise(state["p"] - F.when(rise, up).otherwise(-down) / rest)
        settled = F.struct((whole + one).alias("p"), *_doc(x))
        return F.struct(rest.cast("long").alias("left"), F.greatest(least, F.least(most, after)).alias("p"), F.concat(state["done"], F.array(settled)).alias("done"))

    start = F.struct(total.alias("left"), p.alias("p"), F.array().cast(SETTLED).alias("done"))
    return F.aggregate(queue, start, step)["done"]


def by_source(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` joined with ``rates`` (one row for each source, in column ``of``).

    Rates are broadcast if their count allows it; else both sides are salted, so no source is one task.
    """
    if rates.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        return rows.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    many = rates.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
    return salted.join(many, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")), "left").drop("of", "salt", "salt_of")


def mix_sources(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, sourced: bool = False) -> DataFrame:
    """Copies of each document: ``sizes`` (doc_id, size, source) -> doc_id, size, source_size, target, copies, taken
    (and source, if ``sourced``).

    Null sizes count as 0, null sources are a source of their own (last), documents of no words take
    nothing.  Repeated rows are documents of their own: equal (doc_id, source, size) rows are counted
    and numbered before blocks are dealt.  An empty table gives an empty result.
    """
    from tallyfield.llm.common import stash

    docs = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    docs = docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    docs = stash(docs.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "source", "size", "nth")))
    targets = stash(source_targets(docs.select("source", "size"), weights))
    counts = docs.where("size > 0").groupBy("source").agg(F.count("*").alias("k"))
    rates = targets.join(counts, targets["source"].eqNullSafe(counts["source"]), "left").select(targets["source"].alias("of"), "source_size", "target", F.coalesce("k", F.lit(0)).alias("k"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = stash(rates.withColumn("base", F.floor(rate).cast("long")).withColumn("p", rate - F.floor(rate)))

    # the reserve waits for the root; of the others, level 0 has blocks by hash, and each further level
    # blocks of residuals, until one is left for each source
    told = by_source(docs, rates.select("of", "k", "p", "base")).withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0))
    waits = F.pmod(F.xxhash64(F.lit(seed), F.lit("wait"), "u"), F.greatest(F.lit(1), F.ceil(F.col("k") / RESERVE)).cast("long")) == 0
    told = stash(told.withColumn("waits", waits))
    plain = told.where("p = 0").select("source", F.lit(0.0).alias("p"), "doc_id", "nth", "u", "size")
    settled, root = [plain], None
    level = told.where("p > 0 and not waits").select("source", "k", "p", "doc_id", "nth", "u", "size")
    while level.limit(1).count():
        blocks = F.greatest(F.lit(1), F.ceil(F.col("k") / BLOCK)).cast("long")
        depth = len(settled)
        grouped = level.withColumn("blocks", blocks).groupBy("source", "blocks", F.pmod(F.xxhash64(F.lit(seed + depth), "u"), F.col("blocks")).alias("block"))
        folded = grouped.agg(F.sort_array(F.collect_list(F.struct("u", "p", "doc_id", "nth", "size"))).alias("items"))
        folded = stash(folded.withColumn("out", _fold(F.transform("items", lambda x: F.struct(x["p"].alias("p"), *_doc(x))), seed + depth)).select("source", "blocks", "out"))
        settled.append(folded.select("source", F.explode("out.done").alias("d")).select("source", "d.*"))
        held = folded.where("blocks = 1").select("source", F.col("out.held").alias("held"))
        root = held if root is None else root.unionByName(held)
        level = folded.where("blocks > 1").select("source", F.col("blocks").alias("k"), "out.held.*")
    waiting = told.where("p > 0 and waits").groupBy("source").agg(F.max("p").alias("p"), F.max("base").alias("base"), F.collect_list(F.struct("size", "u", "doc_id", "nth")).alias("items"))
    if root is not None:
        # a source has at most one residual; one without reserve is rounded by itself
        root = root.withColumnRenamed("source", "of")
        ends = waiting.join(root, F.col("source").eqNullSafe(F.col("of")), "full").select(F.coalesce("source", "of").alias("source"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("items", F.array().cast("array<struct<size:bigint,u:bigint,doc_id:bigint,nth:bigint>>")).alias("items"), "held")
    else:
        ends = waiting.withColumn("held", F.lit(None).cast(SETTLED[6:-1]))
    settled.append(stash(ends.withColumn("done", _root(F.col("held"), F.col("items"), F.col("p"), F.col("base"), seed)).select("source", F.explode("done").alias("d"))).select("source", "d.*"))
    decided = settled[0]
    for x in settled[1:]:
        decided = decided.unionByName(x)
    out = by_source(decided, rates.select("of", "source_size", "target", "base"))
    copies = F.when(F.col("size") > 0, F.col("base") + F.round("p").cast("long")).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("copies", F.when(F.col("source_size") > 0, copies).otherwise(F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["source"] if sourced else []))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """``docs`` (text, source, ...) with each row repeated as often as the mix takes it.

    Rows are told apart by their number, not by doc_id, so ids may be null or repeated; for that ``docs``
    must be a table that is read in the same order each time, as Parquet files are.
    """
    from tallyfield.llm.common import unused

    row, copies = unused("__row", docs), unused("__copies", docs)
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    plan = mix_sources(rows.select(F.col(row).alias("doc_id"), "source", words(F.col("text")).alias("size")), weights, seed)
    kept = rows.join(plan.where("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias(copies)), row)
    each = F.sequence(F.lit(1).cast("long"), F.col(copies))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(each).alias(copies)).drop(copies)
