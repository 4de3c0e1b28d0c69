"""Global order without a window over all rows: row numbers, and folds that run in order."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyfield.sources.store import shared_folder

_PLACE_BITS = 33  # monotonically_increasing_id has the row's place in its partition in so many low bits


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[str], out: str = "n") -> DataFrame:
    """Rows with their number (from 1) in the order of these columns, which should tell all rows apart.

    Rows are dealt to partitions by range and sorted there; a partition's rows are counted and the counts
    of the partitions before it, one row each, are added to the places in it.  One shuffle, no window but
    over the partitions' counts.
    """
    tagged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()))
    part = F.shiftright(out, _PLACE_BITS)
    sizes = tagged.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    place = F.col(out).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    # one row a partition
    joined = tagged.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return joined.withColumn(out, F.col("__before") + place + 1).drop("__part", "__before")


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], start: int, step: Callable[..., int], every: bool = False) -> DataFrame:
    """Each key's rows folded in order: ``state = step(state, *values)``, from ``start``, all states whole numbers.

    Gives the keys, n (rows folded) and state: of the last row, or with ``every`` after each row, with the
    order columns.  A key's rows come sorted to one task, as a fold must, and stream through it: what is held
    is one Arrow batch and one state, carried from batch to batch.  Null values are given to ``step`` as None.
    """
    named = [*keys, *order] if every else [*keys]
    schema = df.select(*named).withColumns({"n": F.lit(0).cast("long"), "state": F.lit(0).cast("long")}).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, width = to_arrow_schema(schema), len(keys)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*rows, strict=True), strict=True)), arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, state, done = None, 0, start, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            whole = list(zip(*columns[: len(keys) + len(order)], strict=True)) if every else None
            for i, (key, *given) in enumerate(zip(zip(*columns[:width], strict=True), *columns[len(keys) + len(order) :], strict=True)):
                if key != now:
                    if now is not None and not every:
                        done.append((*now, n, state))
                    now, n, state = key, 0, start
                n, state = n + 1, step(state, *given)
                if every:
                    done.append((*whole[i], n, state))
                if len(done) >= 20_000:
                    yield made(done)
                    done = []
        if now is not None and not every:
            done.append((*now, n, state))
        if done:
            yield made(done)

    dealt = df.select(*keys, *order, *values).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)
