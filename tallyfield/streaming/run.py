"""Streams over files, run to their end."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfield.sources.store import shared_folder


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Keyed results are merged into one snapshot every so many batches.
COMPACT_EVERY = 16


def drain(spark: SparkSession, path: str, build, mode: str = "append", keys: Sequence[str] | None = None, files_per_batch: int | None = None, own_state: bool = False, progress: list | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Stream the Parquet files at ``path`` through ``build``; the result when all are read.

    Every batch writes a folder of its own, so a batch that runs again replaces what it wrote.
    ``append`` results are all batches' rows; ``update`` results are each key's row of the newest batch
    that changed it, so a batch writes changed keys only, and what many batches wrote is merged into a
    snapshot by key from time to time; ``complete`` results are the last batch's.  ``files_per_batch`` bounds
    a batch.  ``own_state``: ``build`` has a stateful processor, whose state is kept in RocksDB.
    ``progress`` gets each batch's progress report.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    stream = source.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, path) else source.parquet(path)
    out = build(stream)
    snapshots = _Snapshots(spark, base, out, keys) if mode == "update" else None

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{'all' if mode == 'complete' else f'batch={number}'}")
        if snapshots and (number + 1) % compact_every == 0:
            snapshots.compact(number)

    before = spark.conf.get(PROVIDER, None)
    if own_state:
        spark.conf.set(PROVIDER, ROCKS)
    try:
        q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    finally:
        if own_state:
            spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    q.awaitTermination()
    if progress is not None:
        progress.extend(q.recentProgress)
    if mode == "complete":
        return spark.read.parquet(f"{base}/out/all")
    if mode == "append":
        return spark.read.schema(f"{_ddl(out)}, batch long").parquet(f"{base}/out").drop("batch")
    return snapshots.newest().select(*out.columns)


class _Snapshots:
    """What the batches of a keyed stream wrote: their folders, and the newest snapshot of those before.

    Snapshot i holds each key's newest row up to batch i, with its batch.  It is complete once Spark has
    marked it so; only then what it holds is deleted, so that a batch that runs again finds one or the other.
    """

    def __init__(self, spark: SparkSession, base: str, out: DataFrame, keys: Sequence[str]):
        self.spark, self.base, self.keys, self.columns = spark, base, list(keys), out.columns
        self.ddl = f"{_ddl(out)}, batch long"
        p = spark._jvm.org.apache.hadoop.fs.Path(base)
        self.fs = p.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _numbers(self, name: str) -> list[int]:
        """Numbers of the folders name/..=number."""
        at = self._path(name)
        return sorted(int(s.getPath().getName().split("=")[1]) for s in self.fs.listStatus(at) if "=" in s.getPath().getName()) if self.fs.exists(at) else []

    def _upto(self) -> int:
        return max((n for n in self._numbers("snapshots") if self.fs.exists(self._path(f"snapshots/upto={n}/_SUCCESS"))), default=-1)

    def newest(self) -> DataFrame:
        upto, parts = self._upto(), []
        if upto >= 0:
            parts.append(self.spark.read.schema(self.ddl).parquet(f"{self.base}/snapshots/upto={upto}"))
        if later := [n for n in self._numbers("out") if n > upto]:
            paths = [f"{self.base}/out/batch={n}" for n in later]
            parts.append(self.spark.read.schema(self.ddl).option("basePath", f"{self.base}/out").parquet(*paths))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else self.spark.createDataFrame([], self.ddl)
        values = [c for c in self.columns if c not in self.keys]
        of = F.max_by(F.struct(*values), "batch").alias("of")
        top = rows.groupBy(*self.keys).agg(of, F.max("batch").alias("batch"))
        return top.select(*[F.col(c) if c in self.keys else F.col(f"of.{c}") for c in self.columns], "batch")

    def compact(self, number: int) -> None:
        if self._upto() < number:
            self.newest().write.mode("overwrite").parquet(f"{self.base}/snapshots/upto={number}")
        for n in self._numbers("out"):
            if n <= number:
                self.fs.delete(self._path(f"out/batch={n}"), True)
        for n in self._numbers("snapshots"):
            if n < number:
                self.fs.delete(self._path(f"snapshots/upto={n}"), True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
