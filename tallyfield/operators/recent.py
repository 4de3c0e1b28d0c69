"""The best keys of each day by what they did in the days before."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Days of a block, and keys of a share of a group: what a task holds at once is a matrix of both.
BLOCK_DAYS, SHARE = 256, 512


def trailing(m: np.ndarray, days: int, most: int) -> np.ndarray:
    """``m`` has a row a key and a column a day, the first ``most`` before the block: sums over the ``days`` days before each day of it."""
    return sum(m[:, most - back : m.shape[1] - back] for back in range(1, days + 1))


def top(*scores: np.ndarray, among: np.ndarray, n: int = 1) -> np.ndarray:
    """Marks the ``n`` best rows of each column: the highest first score, then the next ones, then the first row."""
    among, marks, columns = among.copy(), np.zeros(among.shape, bool), np.arange(among.shape[1])
    for _ in range(n):
        left = among.copy()
        for s in scores:
            s = np.where(left, np.where(np.isnan(s), np.inf, s), -np.inf)  # as in SQL no number is above NaN
            left &= s == s.max(axis=0)
        row, some = left.argmax(axis=0), left.any(axis=0)
        marks[row[some], columns[some]] = True
        among &= ~marks
    return marks


def candidates(plays: DataFrame, sizes: DataFrame, group: str, key: str, day: str, values: Sequence[str], most: int, best: Callable[[np.ndarray, dict], tuple[np.ndarray, dict]], out: str) -> DataFrame:
    """Of each group and day, the keys that can be the best by their plays of the days before; one row each.

    ``plays`` has a row a play with ``values`` as doubles, ``sizes`` the number of keys of each group.  A group's keys
    are dealt to shares and its days to blocks; plays of the ``most`` days before a block come with it.  ``best`` is
    given a share's key ids, ascending, and a matrix (key, day) for each value, with ``most`` days before the block;
    it marks the days' best keys among these and returns the columns ``out`` (DDL) as matrices.  What is best of all
    shares is best of its own, so what is left to compare are a few rows a share.  Plays are added up as they
    stream in, so a hot key needs no more memory.
    """
    c = F.col
    shares = F.greatest(F.lit(1), F.ceil(c("__keys") / SHARE))
    share = F.pmod(F.xxhash64(key), shares.cast("long")).cast("int")
    at = F.datediff(day, F.lit("1970-01-01"))
    block = lambda n: F.floor((at + n) / BLOCK_DAYS).cast("int")
    dealt = plays.where(c(day).isNotNull() & c(group).isNotNull()).join(F.broadcast(sizes), group)  # one row a group
    dealt = dealt.select(group, share.alias("__share"), F.explode(F.array_distinct(F.array(block(1), block(most)))).alias("__block"), c(key).cast("long").alias(key), at.alias("__at"), *values)

    def run(of: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        team, first = of[0], of[2].as_py() * BLOCK_DAYS - most
        ids, held = np.empty(0, np.int64), {v: np.zeros((0, most + BLOCK_DAYS)) for v in values}
        for batch in batches:
            given, on = batch[key].to_numpy(zero_copy_only=False), batch["__at"].to_numpy(zero_copy_only=False) - first
            both = np.union1d(ids, given)
            if len(both) > len(ids):
                known = np.searchsorted(both, ids)
                for v, m in held.items():
                    held[v] = np.zeros((len(both), m.shape[1]))
                    held[v][known] = m
                ids = both
            row = np.searchsorted(ids, given)
            for v in values:
                np.add.at(held[v], (row, on), batch[v].to_numpy(zero_copy_only=False))
        marks, told = best(ids, held)
        row, on = np.nonzero(marks)
        fixed = [pa.array([team.as_py()] * len(row), arrow.field(0).type), pa.array((first + most + on).astype(np.int32)).cast(pa.date32()), pa.array(ids[row])]
        yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(m[row, on]).cast(f.type) for m, f in zip(told.values(), list(arrow)[3:], strict=True))], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = dict(plays.dtypes)
    schema = StructType.fromDDL(f"`{group}` {kinds[group]}, day date, `{key}` long, {out}")
    arrow = to_arrow_schema(schema)
    run.__annotations__ = {"of": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return dealt.groupBy(group, "__share", "__block").applyInArrow(run, schema)
