"""Session settings and table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tallyfield", master: str | None = None) -> SparkSession:
    """A session as the jobs expect it: adaptive plans, skew joins, UTC."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    return (b.master(master) if master else b).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
