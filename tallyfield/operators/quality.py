"""Declarative contracts: audits, violation rows, expressions, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Contract:
    column: str
    low: float
    high: float
    most_null: float = 1.0
    critical: bool = False


def check_sql(c: Contract) -> str:
    return f"{c.column} IS NULL OR ({c.column} >= {c.low} AND {c.column} <= {c.high})"


def breaks(c: Contract) -> Column:
    """True where a value is there and outside its range."""
    return F.coalesce(~F.col(c.column).between(c.low, c.high), F.lit(False))


def audit(df: DataFrame, contracts: Sequence[Contract]) -> DataFrame:
    """One row a contract: NULL share, violations, severity.  One pass over the table."""
    stats = [x for c in contracts for x in (F.avg(F.col(c.column).isNull().cast("double")).alias(f"{c.column}__n"), F.count_if(breaks(c)).alias(f"{c.column}__b"))]
    rows = F.explode(F.array(*[F.struct(F.lit(c.column).alias("column"), F.col(f"{c.column}__n").alias("null_share"), F.col(f"{c.column}__b").alias("violations"), F.lit(c.most_null).alias("most"), F.lit(c.critical).alias("critical")) for c in contracts]))
    r = df.agg(*stats).select(rows.alias("r")).select("r.*")
    bad = (F.col("violations") > 0) | (F.col("null_share") > F.col("most"))
    return r.select("column", "null_share", "violations", F.when(bad & F.col("critical"), "critical").when(bad, "warning").otherwise("ok").alias("severity"))


def broken_rules(contracts: Sequence[Contract]) -> Column:
    return F.array_compact(F.array(*[F.when(breaks(c), F.lit(c.column)) for c in contracts]))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash of a table, with its schema; a null is told apart from its neighbours' values."""
    cols = sorted(df.columns)
    h = F.xxhash64(*[x for c in cols for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum((h % 1_000_003).cast("long")).alias("s")).select("n", F.sha2(F.concat_ws("|", F.lit(",".join(f"{c}:{dict(df.dtypes)[c]}" for c in cols)), "n", "x", "s"), 256).alias("fingerprint"))
