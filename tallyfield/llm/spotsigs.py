"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

Every common word is an anchor: the next ``CHAIN`` words that aren't common form a chain, hashed with it.
Where no anchor is among the ``GAP`` words before (beginnings, lists, texts of other languages), one content word in
``EVERY``, told by its hash, is a spot as well, so that an edit moves only the spots near it.  A document's
signatures are the set of these hashes.

Likeness is the Jaccard value itself, for every pair that is asked for.  Whether two sets are ``alike`` is
decided before that: sets are partitioned by their length, in steps of one over the threshold, so that a
set can only be alike to sets of its own partition and the two beside it; there the lengths, and then block
by block of the sorted lists the most that can still be shared, end a comparison as soon as it can't
succeed.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.common import as_bytes, distinct_sorted, mix, rowwise

# Common words that are skipped when a chain is built.
COMMON = "the of and to in is that it for on with as are be was at by this from or an a he der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an le la les de des et en un une du que pour dans par au sur ne pas il elle est avec qui el los las y que se del una con para su al lo como más no".split()
CHAIN = 2
GAP = 12
EVERY = 4
ALIKE = 0.8
BLOCK = 256  # signatures between two looks at what can still be shared
MOST_RANGES = 20_000  # ranges of documents that the driver knows boundaries of; beyond it ranges grow


class Words(dict):
    """Word -> hash with its lowest bit telling common words."""

    limit = 300_000

    def __init__(self):
        super().__init__()
        self.common = {w.encode() for w in COMMON}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        w = word.rstrip(b".,;:!?")
        v = self[word] = xxhash.xxh3_64_intdigest(w) & ~1 | (w in self.common or not w)
        return v


def signatures(text: bytes, words: Words) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a text (UTF-8; ASCII case is ignored).

    The text's start is a spot, so any text with a word has a signature; without words the set is empty.
    """
    split = text.lower().split()
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    common = (h & np.uint64(1)) == 1
    content = h[~common]
    if not len(h):
        return np.zeros(0, np.uint32)
    if not len(content):
        return np.array([mix(h.sum(dtype=np.uint64, keepdims=True))[0] >> np.uint64(32)], np.uint32)
    place = np.arange(len(h))
    far = place - np.maximum.accumulate(np.where(common, place, -GAP - 1)) > GAP
    at = np.flatnonzero(common | far & ((h >> np.uint64(1)) % np.uint64(EVERY) == 0))
    after = np.cumsum(~common)[at]  # content words up to the spot: the chain begins after them
    spot = np.concatenate(([np.uint64(7)], h[at]))
    after = np.concatenate(([0], after))
    padded = np.concatenate((content, np.zeros(CHAIN, np.uint64)))
    whole = after < len(content)
    s = mix(spot[whole])
    for j in range(CHAIN):
        s = mix(s + padded[after[whole] + j] * np.uint64(2 * j + 3))
    return distinct_sorted((s >> np.uint64(32)).astype(np.uint32))


def length_partition(n: int, threshold: float = ALIKE) -> int:
    """Partition of sets of ``n`` signatures: lengths from one power of 1 / threshold to the next."""
    return int(math.log(max(n, 1)) / -math.log(threshold) + 1e-9)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def alike(a: np.ndarray, b: np.ndarray, threshold: float = ALIKE) -> bool:
    """Whether the Jaccard of two sorted sets is at least ``threshold``, left as soon as it can't be."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return not len(b)
    if length_partition(len(b), threshold) - length_partition(len(a), threshold) > 1 or len(a) < threshold * len(b) * (1 - 1e-12):
        return False
    # shared / (len(a) + len(b) - shared) >= threshold
    need = threshold * (len(a) + len(b)) / (1 + threshold) * (1 - 1e-12)
    shared = 0
    for i in range(0, len(a), BLOCK):
        part = a[i : i + BLOCK]
        lo, hi = np.searchsorted(b, part[0]), np.searchsorted(b, part[-1], "right")
        if shared + min(len(a) - i, len(b) - lo) < need:
            return False
        places = np.searchsorted(b[lo:hi], part)
        shared += int((b[lo:hi][np.minimum(places, hi - lo - 1)] == part).sum()) if hi > lo else 0
    return shared >= need


def fingerprint(s: np.ndarray) -> str:
    """Set length, then the sorted signatures (little-endian 32 bits, base 64)."""
    return f"{len(s)}:{base64.b64encode(s.astype('<u4').tobytes()).decode()}"


def _neighbours(batches: Iterable[pa.RecordBatch]):
    """Rows by range in descending order of doc_id, then the next range's first row (``ahead``)."""
    words, held = Words(), None
    for batch in batches:
        for part in rowwise(batch, 256):
            out: list[list] = [[] for _ in NAMES]
            for doc, raw, bucket, ahead in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), part.column("bucket").to_pylist(), part.column("ahead").to_pylist(), strict=True):
                own, text = signatures(raw, words), raw.decode("utf-8", "replace")
                if held and held[0] == bucket:
                    _, id_, before, s = held
                    half = len(before) // 2
                    edited = (before[: len(before) - half] + text[:half]).encode()
                    e = signatures(edited, words)
                    row = (id_, len(before), hashlib.sha256(edited).hexdigest(), fingerprint(s), fingerprint(e), likeness(s, e), likeness(s, own), alike(s, e), alike(s, own), length_partition(len(s)))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                held = None if ahead else (bucket, doc, text, own)
            if out[1]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TYPES, strict=True)], names=NAMES)


def neighbour_fingerprints(docs: DataFrame, rows_in_range: int = 5000) -> DataFrame:
    """Fingerprints of each text and of its half replaced by the next document's beginning.

    Rows are in descending doc_id (null last, ties by text); after the last comes the first, and a
    single row is its own next.  Null texts count as empty.  Ranges of doc_id are dealt out with their
    texts once; each range also gets a copy of the next range's first row.  The driver learns one
    boundary for each range of about ``rows_in_range`` rows (more where there would be more than
    MOST_RANGES ranges), no texts.  Bytes that aren't UTF-8 are replaced.  Only doc_id and text are read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = d.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"))
    n = known.count()
    spark = docs.sparkSession
    parts = max(1, min(MOST_RANGES, -(-n // rows_in_range)))
    bounds = sorted({int(b) for b in known.approxQuantile("at", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    at = F.coalesce("doc_id", F.lit(-(1 << 63)))
    bucket = F.lit(0)
    if bounds:  # places of doc_id among the boundaries, largest ids first, in two steps: runs of boundaries, then one run
        run = math.isqrt(len(bounds)) + 1
        runs = [bounds[i : i + run] for i in range(0, len(bounds), run)]
        table = spark.createDataFrame([([r[0] for r in runs], runs)], "firsts array<bigint>, runs array<array<bigint>>")
        d = d.crossJoin(F.broadcast(table))  # one row
        before = F.size(F.filter("firsts", lambda b: b <= at))
        upto = F.when(before > 0, (before - 1) * run + F.size(F.filter(F.get("runs", before - 1), lambda b: b <= at))).otherwise(0)
        bucket = F.lit(len(bounds)) - upto
    d = d.select("doc_id", "text", bucket.cast("int").alias("bucket"))
    heads = sorted((r["bucket"], r["at"]) for r in d.groupBy("bucket").agg(F.max(at).alias("at")).collect())  # one for each range
    if not heads:
        return d.mapInArrow(_neighbours, SCHEMA)
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}  # the first range's head follows the last range
    follow = spark.createDataFrame([(b, a, before[b]) for b, a in heads], "bucket int, at bigint, to int")
    firsts = d.withColumn("at", at).join(F.broadcast(follow), ["bucket", "at"]).groupBy("bucket", "to").agg(F.min(F.struct("text", "doc_id")).alias("r")).select(F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"), F.col("to").alias("bucket"), F.lit(True).alias("ahead"))
    rows = d.select("doc_id", "text", "bucket", F.lit(False).alias("ahead")).unionByName(firsts)
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(_neighbours, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "alike_edited", "alike_next", "length_partition"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.int32()]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, alike_edited boolean, alike_next boolean, length_partition int"
