"""Leak-free windows over entity logs: the current row never enters its own feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def over(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def prior(fn: str, c: Column | str, keys: Sequence[str], order: Sequence[str | Column], rows: int | None = None, least: int = 1) -> Column:
    """Aggregate of the ``rows`` rows before the current one (all if None); NULL under ``least`` values."""
    w = over(keys, order).rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)
    x = F.col(c) if isinstance(c, str) else c
    value = getattr(F, fn)(x).over(w)
    return F.when(F.count(x).over(w) >= least, value)


def lagged(c: Column | str, keys: Sequence[str], order: Sequence[str | Column], n: int = 1) -> Column:
    return F.lag(c, n).over(over(keys, order))


def days_prior(fn: str, c: Column, keys: Sequence[str], day: Column, days: int) -> Column:
    """Aggregate over the ``days`` days before the row's day."""
    w = Window.partitionBy(*keys).orderBy(F.datediff(day, F.lit("1970-01-01"))).rangeBetween(-days, -1)
    return getattr(F, fn)(c).over(w)


def with_streak(df: DataFrame, win: str, keys: Sequence[str], order: Sequence[str | Column], out: str = "streak") -> DataFrame:
    """Signed length of the run that ends before the row; 0 at the start."""
    w = over(keys, order)
    isle = F.row_number().over(w) - F.row_number().over(over([*keys, win], order))
    df = df.withColumn("__isle", isle)
    df = df.withColumn("__run", F.row_number().over(over([*keys, win, "__isle"], order)))
    signed = F.when(F.col(win) == 1, F.col("__run")).otherwise(-F.col("__run"))
    return df.withColumn(out, F.coalesce(F.lag(signed).over(w), F.lit(0)).cast("long")).drop("__isle", "__run")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given total order."""
    return df.withColumn("__n", F.row_number().over(over(keys, order))).where(F.col("__n") <= n).drop("__n")
