"""Turns of conversations: their order, and hashes over ordered strings of any length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Turn numbers in one task's share of a conversation, as a power of two.
SHARE_BITS = 10


def turn_key(role: Column, text: Column) -> Column:
    """A digest of role and text that tells where the one ends and the other begins."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def in_order(rows: DataFrame, tie: str) -> DataFrame:
    """``rows`` with pos, the place (from 1) in their conversation by turn, nulls first, then ``tie``.

    A conversation is numbered in shares of 1,024 turn numbers, whose sizes are summed first: a very long
    one is not one task's work.  Rows of a null conv_id are one conversation.
    """
    rows = rows.withColumn("share", F.coalesce(F.shiftright("turn", SHARE_BITS), F.lit(-(2**63))))
    sizes = rows.groupBy(F.col("conv_id").alias("of_conv"), F.col("share").alias("of_share")).agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("of_conv").orderBy("of_share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size")
    here = F.row_number().over(Window.partitionBy("conv_id", "share").orderBy(F.col("turn").asc_nulls_first(), tie))
    numbered = rows.withColumn("here", here).join(sizes, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("share") == F.col("of_share")))
    return numbered.withColumn("pos", F.col("before") + F.col("here")).drop("share", "here", "of_conv", "of_share", "before")


def hashed(rows: DataFrame, keys: list[str], order: list[str], part: str, between: str) -> DataFrame:
    """The keys and ``digest``: SHA-256 of each key's parts in order, joined by ``between``.

    A digest of this kind can only be taken from its first byte to its last, so a key's parts pass through
    one task; they stream through it, it holds one Arrow batch and the state of one digest.
    """
    spec = rows.select(*keys)
    schema = spec.withColumn("digest", F.lit("")).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, glue = to_arrow_schema(schema), between.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            named = [batch.column(i).to_pylist() for i in range(len(keys))]
            for *key, text in zip(*named, batch.column(len(keys)).to_pylist(), strict=True):
                if state is None or key != now:
                    if state is not None:
                        done.append([*now, state.hexdigest()])
                    now, state = key, hashlib.sha256()
                else:
                    state.update(glue)
                state.update(text.encode())
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*done, strict=True), strict=True)), arrow)
                done = []
        if state is not None:
            done.append([*now, state.hexdigest()])
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*done, strict=True), strict=True)), arrow)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, part)
    return dealt.mapInArrow(run, schema)
