"""Exact quantiles of any number of distinct values in bounded memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyfield.operators.order import numbered, stored

#: The sketch's rank error is one part in so many.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, prob, quantile: between the two neighbouring values as ``quantile_cont`` takes it; nulls don't count,
    nor do rows of a null group.

    Pass 1: a mergeable sketch with a guaranteed rank error gives for each quantile two values that enclose
    it.  Pass 2 counts what lies below the lower one and keeps what lies between, some ``4 / ACCURACY`` of
    the rows, as distinct values with counts.  These few are put in order (numbers over ranges, no window
    over a group) and the two that are wanted are picked by rank.  A group's targets, as many rows as it has
    ``probs``, are joined by group; no group is gathered in one buffer.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v is not null")
    wide = 2.0 / ACCURACY
    sides = [x for p in probs for x in (max(0.0, p - wide), min(1.0, p + wide))]
    ends = F.min("__v").alias("__min"), F.max("__v").alias("__max")
    told = rows.groupBy(*by).agg(F.count("*").alias("__all"), F.percentile_approx("__v", sides, ACCURACY).alias("__q"), *ends)

    def around(i: int, p: float):
        # the sketch's own 0 and 1 are near the ends, not at them, and a neighbour must lie within: few rows count all
        few = F.col("__all") < 2 * ACCURACY
        lo = F.col("__min") if p <= wide else F.when(few, F.col("__min")).otherwise(F.get("__q", 2 * i))
        hi = F.col("__max") if p >= 1 - wide else F.when(few, F.col("__max")).otherwise(F.get("__q", 2 * i + 1))
        return F.struct(F.lit(float(p)).alias("prob"), lo.alias("__lo"), hi.alias("__hi"))

    each = F.explode(F.array(*[around(i, p) for i, p in enumerate(probs)]))
    targets = told.select(*by, "__all", each.alias("__t")).select(*by, "__all", "__t.*")
    rank = F.col("prob") * (F.col("__all") - 1)
    targets = stored(targets.withColumns({"__rank": rank, "__floor": F.floor(rank), "__ceil": F.ceil(rank)}).where("__all > 0"))
    met = rows.join(targets.select(*by, "prob", "__lo", "__hi"), [*by]) if by else rows.crossJoin(F.broadcast(targets.select("prob", "__lo", "__hi")))  # a row for each prob
    near = met.where("__v <= __hi").select(*by, "prob", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__v"))
    near = stored(near.groupBy(*by, "prob", "__v").agg(F.count("*").alias("__n")))
    below = near.where("__v is null").select(*by, "prob", F.col("__n").alias("__below"))
    inside = numbered(near.where("__v is not null"), [*by, "prob", "__v"], "__at")
    upto = _running(inside, [*by, "prob"])
    found = upto.join(targets.select(*by, "prob", "__rank", "__floor", "__ceil"), [*by, "prob"]).join(below, [*by, "prob"], "left")
    last = F.coalesce("__below", F.lit(0)) + F.col("__upto")  # rows up to and with this value
    holds = lambda k: (F.col(k) < last) & (F.col(k) >= last - F.col("__n"))
    picked = found.groupBy(*by, "prob").agg(*[F.max(F.when(holds(k), F.col("__v"))).alias(k) for k in ("__floor", "__ceil")], F.max("__rank").alias("__rank"))
    part = F.col("__rank") - F.floor("__rank")
    return picked.select(*by, "prob", (F.col("__floor") + (F.col("__ceil") - F.col("__floor")) * part).alias("quantile"))


def _running(rows: DataFrame, by: list[str]) -> DataFrame:
    """With __upto, the sum of __n up to each row in its group, by __at: blocks of numbers are summed first."""
    from pyspark.sql import Window

    rows = rows.withColumn("__block", F.shiftright("__at", 12))
    sums = rows.groupBy(*by, "__block").agg(F.sum("__n").alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    here = F.sum("__n").over(Window.partitionBy(*by, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__here", here).join(sums, [*by, "__block"]).withColumn("__upto", F.col("__before") + F.col("__here"))
