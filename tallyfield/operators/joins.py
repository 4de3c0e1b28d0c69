"""As-of, nearest, guarded and keyed joins, upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """Latest right values at or before each left row, per key: one shuffle, no pairs.

    ``right`` is unique per (keys, ts).
    """
    pack = F.struct(F.col(ts).alias("__at"), *values)
    r = right.select(*keys, ts, pack.alias("__r"), F.lit(0).alias("__side"))
    cols = left.columns
    both = left.withColumn("__side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return got.select(*cols, F.col("__r.__at").alias(f"right_{ts}"), *[F.col(f"__r.{v}").alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, lts: str, rts: str, tolerance: int, tie: str) -> DataFrame:
    """The right row of least absolute gap within ``tolerance`` seconds.

    Buckets as wide as the tolerance keep the join to neighbours in time, whatever a key's size.
    """
    sec = lambda c: F.unix_timestamp(c)
    l = left.withColumn("__b", F.floor(sec(lts) / tolerance))
    r = right.withColumn("__b", F.explode(F.array(*[F.floor(sec(rts) / tolerance) + d for d in (-1, 0, 1)])))
    gap = F.abs(sec(lts) - sec(rts))
    j = l.join(r, [*keys, "__b"]).withColumn("gap", gap).where(F.col("gap") <= tolerance)
    w = Window.partitionBy(left_id).orderBy("gap", rts, tie)
    return j.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__b")


def unambiguous(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join for left keys that occur once, with one right row a key."""
    once = left.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n = 1").drop("__n")
    return once.join(right.dropDuplicates(list(keys)), list(keys))


def prefer_right(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join; columns of both take the right value, else the left one."""
    both = [c for c in left.columns if c in right.columns and c not in keys]
    r = right.select(*keys, *[F.col(c).alias(f"__r_{c}") if c in both else F.col(c) for c in right.columns if c not in keys])
    j = left.join(r, list(keys), "left")
    for c in both:
        j = j.withColumn(c, F.coalesce(f"__r_{c}", c)).drop(f"__r_{c}")
    return j


Rule = Callable[[Column, Column], Column]
replace: Rule = lambda old, new: new
keep_old: Rule = lambda old, new: F.coalesce(old, new)
prefer_new: Rule = lambda old, new: F.coalesce(new, old)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, Rule] | None = None, default: Rule = prefer_new) -> DataFrame:
    """Full-outer merge by key; each column follows its rule where both sides have the row."""
    rules = rules or {}
    o = old.select(*[F.col(k).alias(f"__ok_{k}") for k in keys], *[F.col(c).alias(f"__o_{c}") for c in old.columns if c not in keys], F.lit(True).alias("__old"))
    n = new.select(*[F.col(k).alias(f"__nk_{k}") for k in keys], *[F.col(c).alias(f"__n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("__new"))
    j = o.join(n, [F.col(f"__ok_{k}") == F.col(f"__nk_{k}") for k in keys], "full_outer")
    out = [F.coalesce(f"__ok_{k}", f"__nk_{k}").alias(k) for k in keys]
    for c in old.columns:
        if c in keys:
            continue
        if c not in new.columns:
            out.append(F.col(f"__o_{c}").alias(c))
            continue
        a, b = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        out.append(F.when(F.col("__old").isNull(), b).when(F.col("__new").isNull(), a).otherwise(rules.get(c, default)(a, b)).alias(c))
    return j.select(*out)


def key_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of keys on both sides, only left, only right."""
    l, r = left.select(*keys).distinct().withColumn("__l", F.lit(1)), right.select(*keys).distinct().withColumn("__r", F.lit(1))
    j = l.join(r, list(keys), "full_outer")
    where = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return j.groupBy(where.alias("side")).agg(F.count("*").alias("n"))
