"""Pairwise-complete correlations of many columns from one pass: partial Gram matrices, summed by pair."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_SUMS = ("n", "a", "b", "aa", "bb", "ab")
#: Rows that are read to choose what is taken from each column against cancellation; any choice is right.
SHIFT_ROWS = 1000


def _partials(columns: int, shift: np.ndarray):
    """Each task's sums over the rows where both columns of a pair are there, one row for each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_SUMS), columns, columns))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            here = np.isfinite(x)
            x, m = np.where(here, x, 0.0), here.astype(float)
            first, second = x.T @ m, (x * x).T @ m
            total += np.stack([m.T @ m, first, first.T, second, second.T, x.T @ x])
        for i in range(columns):
            named = {s: total[k, i].tolist() for k, s in enumerate(_SUMS)}
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32())} | {s: pa.array([v], pa.list_(pa.float64())) for s, v in named.items()})

    return run


def correlations(df: DataFrame, columns: Sequence[str], least: int = 100) -> DataFrame:
    """first, second, n, r of each pair of columns (first before second in the list given).

    r is Pearson's over the rows where both have a finite value, NULL if there are fewer than ``least`` of
    them or one is constant there.  A task sends six numbers a pair, whatever its rows; they are added up by
    column in Spark.
    """
    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    some = x.limit(SHIFT_ROWS).agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]).first()
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in some])
    parts = x.mapInArrow(_partials(len(columns), shift), "i int, " + ", ".join(f"{s} array<double>" for s in _SUMS))
    pairs = parts.select("i", F.posexplode(F.arrays_zip(*_SUMS)).alias("j", "s")).where("j > i")
    t = pairs.groupBy("i", "j").agg(*[F.sum(f"s.{s}").alias(s) for s in _SUMS])
    spread = lambda s, ss: F.col("n") * F.col(ss) - F.col(s) * F.col(s)
    # what is left of a constant column is rounding
    there = lambda s, ss: spread(s, ss) > 1e-12 * F.col("n") * F.col(ss)
    r = (F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(spread("a", "aa")) / F.sqrt(spread("b", "bb"))
    names = F.array(*[F.lit(c) for c in columns])
    known = (F.col("n") >= least) & there("a", "aa") & there("b", "bb")
    return t.select(F.get(names, F.col("i")).alias("first"), F.get(names, F.col("j")).alias("second"), F.col("n").cast("long").alias("n"), F.when(known, r).alias("r"))
