"""Line dedup: levelled sorted runs of line digests, merge-anti-joined by each new batch of documents.

Every text is split at line feeds; a line's key is the line without white space at its ends, A-Z in lower
case.  An index holds how many documents have a key, as runs: tables dealt into buckets by the key's digest
and sorted in each bucket, so that runs meet in merge joins without a shuffle.  A new batch's keys are
anti-joined with the keys that some run already knows to be frequent (nothing more need be known of them),
and what is left becomes a run of level 0.  When a level has two runs they are merged into one run of the
next level, counts added up, so n batches leave at most log2(n) + 1 runs.  After the last batch these are
merged too, the small ones first; the keys whose counts reach ``least`` lose their lines in all documents.

Digests have 128 bits (xxh3).  Texts themselves are shuffled at most once, to meet the numbers of their
dropped lines; a hot line is counted before it is shuffled, and the join that brings frequent keys back to
lines is one that adaptive execution may split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfield.llm.common import as_bytes, fresh_path, remove, rowwise, shared_dir, stash, unused

SPACE = b" \t\n\x0b\x0c\r"
#: Documents that must have a line before it is dropped from all of them.
LEAST = 10
#: Batches in which a whole table is brought into an index.
BATCHES = 5
#: Lines in one Arrow batch, about.
ROWS = 50_000

_LINES = pa.schema([("row", pa.int64()), ("pos", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("first", pa.bool_())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row, text) to one row for each line that has a key; first: the text had no such key before."""
    rows, places, keys, firsts = [], [], [], []

    def made() -> pa.RecordBatch:
        both = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
        out = pa.record_batch([pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(firsts, pa.bool_())], schema=_LINES)
        for x in (rows, places, keys, firsts):
            x.clear()
        return out

    for batch in batches:
        for part in rowwise(batch):
            for row, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                seen = set()
                for pos, line in enumerate(text.split(b"\n")):
                    key = line.strip(SPACE).lower()
                    if key:
                        rows.append(row)
                        places.append(pos)
                        keys.append(digest := xxhash.xxh3_128_digest(key))
                        firsts.append(digest not in seen)
                        seen.add(digest)
                        if len(rows) >= ROWS:
                            yield made()
    if rows:
        yield made()


def line_digests(docs: DataFrame, row: Column) -> DataFrame:
    """row, pos (from 0), hi, lo, first for each line with a key of the column ``text``; null texts have none."""
    spec = "row long, pos int, hi long, lo long, first boolean"
    return docs.select(row.alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(_digests, spec)


class LineRuns:
    """How many documents have each line, as levelled sorted runs in the shared folder.

    Counts stop at ``least``: what is beyond makes no difference.  Runs are bucketed external tables of the
    session, written whole; a lost executor costs only its tasks.  ``close`` removes tables and folders.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST, buckets: int | None = None):
        self.spark, self.least = spark, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._home = shared_dir(spark)

    def runs(self) -> list[str]:
        """The runs' tables, newest and smallest first."""
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of documents' ``line_digests``: count, leave out what is known, write a run."""
        new = lines.where("first").groupBy("hi", "lo").agg(F.least(F.count("*"), F.lit(self.least)).alias("n"))
        for name in self.runs():
            known = self.spark.table(name).where(F.col("n") >= self.least).select(F.col("hi").alias("h"), F.col("lo").alias("l"))
            # that n is asked for keeps the join above the count: below it every line would be shuffled
            new = new.join(known.hint("merge"), (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & (F.col("n") > 0), "left_anti")
        run = self._write(new)
        for level in self.levels:
            if not level:
                level.append(run)
                return
            run = self._merge(level.pop(), run)
        self.levels.append([run])

    def frequent(self) -> DataFrame:
        """hi, lo of the lines that at least ``least`` documents have; merges all runs into one."""
        if not self.runs():
            return self.spark.createDataFrame([], "hi long, lo long")
        one, *more = self.runs()
        for other in more:
            one = self._merge(other, one)
        self.levels = [*[[] for _ in self.levels[1:]], [one]]
        return self.spark.table(one).where(F.col("n") >= self.least).select("hi", "lo")

    def close(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.levels = []

    def _merge(self, a: str, b: str) -> str:
        """One run of two: a merge join of tables with the same buckets, nothing is shuffled."""
        # not a union: Spark 4.1 takes a union of bucketed scans as dealt by key even when it reads them unbucketed
        x = self.spark.table(a).withColumnRenamed("n", "n_a")
        y = self.spark.table(b).withColumnRenamed("n", "n_b")
        both = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
        run = self._write(x.join(y.hint("merge"), ["hi", "lo"], "full").select("hi", "lo", F.least(both, F.lit(self.least)).alias("n")))
        self._drop(a)
        self._drop(b)
        return run

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", f"{self._home}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self._home}/{name}")


def without(text: Column, drops: Column) -> Column:
    """The text without the lines of these numbers; the text itself where there are none (null drops)."""

    def left(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    # the split is bound to a lambda's name: else it would be made again for each line
    cut = F.get(F.transform(F.array(F.split(text, "\n")), left), 0)
    return F.when(drops.isNull(), text).otherwise(cut)


def dedup_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """The columns of ``docs``, ``text`` without lines that at least ``least`` rows have, n_lines, n_dropped.

    Rows count as documents, whatever their doc_id: null, repeated and tied ids are nothing special, and a
    text's own repeats of a line count once.  A null text is the empty text, one empty line.  Lines without
    a key (white space only) always stay.  An empty table gives no rows.  Columns of ``docs`` that are named
    n_lines or n_dropped are replaced; others pass.  ``docs`` must be read in the same order each time, as
    Parquet files are.
    """
    spark, number = docs.sparkSession, F.monotonically_increasing_id()
    folder = fresh_path(spark, "lines")
    line_digests(docs, number).withColumn("batch", F.pmod("row", F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema("row long, pos int, hi long, lo long, first boolean, batch int").parquet(folder)
    index = LineRuns(spark, least)
    for i in range(batches):
        index.add(lines.where(F.col("batch") == i))
    keys_path = fresh_path(spark)
    keys = stash(index.frequent(), keys_path)
    index.close()
    drops = stash(lines.select("row", "pos", "hi", "lo").join(keys, ["hi", "lo"], "left_semi").groupBy("row").agg(F.collect_list("pos").alias("drops")))
    remove(spark, folder)
    remove(spark, keys_path)

    row, gone = unused("row", docs), unused("drops", docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the same join at every size: the drops of a large table are no broadcast
    joined = docs.withColumn(row, number).join(drops.select(F.col("row").alias(row), F.col("drops").alias(gone)).hint("merge"), row, "left")
    kept = {
        "n_lines": (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        "text": without(text, F.col(gone)),
    }
    return joined.withColumns(kept).drop(row, gone)
