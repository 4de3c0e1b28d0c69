"""Helpers shared by the text operators: table reads, shared-folder tables, hashing, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

# One mixing constant per word of a shingle (odd 64-bit numbers).
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the session is local (tests) a temporary folder is made and set; on a
    cluster it would be one machine's own, so it is an error.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not told:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = tempfile.mkdtemp(prefix="tallyfield-")
        sc.setCheckpointDir(told)
        told = sc.getCheckpointDir()
    return told.rstrip("/")


def fresh_path(spark: SparkSession, what: str = "stash") -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here.

    Who gives the ``path`` can ``remove`` the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, wherever that is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores until no column of the tables has it (names differ by more than case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


class WordHashes(dict):
    """64-bit hash of each word, remembered; cleared when it holds ``limit`` words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; of the whole sequence if it is shorter; nothing for no words."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        s = np.uint64(n)
        with np.errstate(over="ignore"):
            for j in range(n):
                s = mix(np.array([s * _P[1] + h[j]], np.uint64))[0]
        return np.array([s], np.uint64)
    s = h[: n - k + 1] * _P[0]
    for j in range(1, k):
        s += (h[j : n - k + 1 + j] ^ (h[j : n - k + 1 + j] >> np.uint64(23 + j))) * _P[j % 5]
        s ^= s >> np.uint64(29)
    return mix(s)


def distinct_sorted(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def rowwise(batch: pa.RecordBatch, rows: int = 512):
    """Parts of a batch, so that what is made from it stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Smallest id reachable by links, for each id that has a link: columns id, label.

    Each round takes the least label among neighbours and then follows the label's own label
    (pointer jumping), so rounds grow with the logarithm of a chain's length.  Every round's
    labels are a table in the shared folder; the driver sees only a count of changed labels.
    """
    edges = stash(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = stash(both.groupBy(F.col("u").alias("id")).agg(F.min(F.least("u", "v")).alias("label")))
    for _ in range(most):
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        up = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        new = stash(step.join(up, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components: labels still changed after {most} rounds")
