"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digests of runs of chunks.

The gear hash runs over words: ``h = (h << 1) + G[word]``; a chunk ends where the ``BITS`` highest of its
low ``REACH`` bits are zero.  They depend on the last ``REACH`` words alone (some forty bytes, as much as
a gear hash of 32 bits over bytes sees), so an insertion moves no boundary beyond them; a wider reach
would leave that much more of each passage's head behind.  A chunk alone is no evidence: what is compared are runs, from each chunk the shortest of ``LEAST`` words
or more that begins there and the shortest that ends there.  Together they cover all chunks of a
longer repeated run.  Of each digest the first run, by (doc_id, place), stays; chunks inside a later
run are cut out.  Shorter repetitions are common phrases and stay.  Digests have 79 bits: 64 by which
they are dealt out, and 15 more that are compared.

Runs of one batch that share a digest are settled before anything is dealt out: only the batch's
first goes to the digest's partition, the others are marked and dealt by themselves.  A passage that a
third of all texts hold thus sends one row for each batch.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.common import WordHashes, as_bytes, mix, rowwise, unused

BITS, REACH = 2, 6
LONGEST = 64  # words of a chunk
LEAST = 20  # words of a run that is cut out
SPAN = 20  # low bits of a run's place: its chunks less one; above them its first chunk,
TAG = 45  # and above that 17 bits of its text, for texts that share a doc_id
PART_WORDS = 1 << 20  # words of texts that are chunked together
AGAIN = -1  # in place of the digest's further bits: an earlier text of its part has this run
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def gear(h: np.ndarray, bits: int = BITS, reach: int = REACH) -> np.ndarray:
    """The ``bits`` highest of the low ``reach`` bits of the rolling hash after each word."""
    g = h >> np.uint64(17)
    out = g.copy()
    for j in range(1, reach):
        out[j:] += g[:-j] << np.uint64(j)
    return out >> np.uint64(reach - bits) & np.uint64((1 << bits) - 1)


def chunk_starts(h: np.ndarray) -> np.ndarray:
    """First word of each chunk of a text whose words hash to ``h``."""
    if not len(h):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(gear(h)[:-1] == 0) + 1))
    sizes = np.diff(np.append(starts, len(h)))
    if sizes.max() > LONGEST:
        starts = np.concatenate([np.arange(a, a + n, LONGEST) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
    return starts


@functools.lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse mod 2^64."""
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate((one, np.cumprod(np.full(n, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def tag(h: np.ndarray) -> int:
    return int(mix(mix(h ^ mix(np.arange(len(h), dtype=np.uint64))).sum(dtype=np.uint64, keepdims=True))[0]) & (1 << 17) - 1


def runs(h: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests (64 bits and 15 more) and places of the shortest runs of ``least`` words or more from and up to each chunk."""
    ends, at = np.append(starts[1:], len(h)), np.arange(len(starts))
    last, first = np.searchsorted(ends, starts + least), np.searchsorted(starts, ends - least, "right") - 1
    ahead = last < len(starts)
    back = first >= 0
    back[back] = last[first[back]] != at[back]  # else it begins as a run of the other kind
    i, j = np.concatenate((at[ahead], first[back])), np.concatenate((last[ahead], at[back]))
    up, down = _powers(1 << len(h).bit_length())
    a, b = starts[i], ends[j]

    def digest(x: np.ndarray) -> np.ndarray:
        total = np.append(np.uint64(0), np.cumsum(x * up[: len(h)], dtype=np.uint64))
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))

    more = (digest(mix(h ^ np.uint64(0xD6E8FEB86659FD93))) >> np.uint64(49)).astype(np.int16)
    return digest(mix(h)), more, tag(h) << TAG | i << SPAN | j - i


def _settled(found: list[tuple]):
    """Rows of the runs of some texts: of equal ones only the first goes to its digest's partition."""
    digest, more, doc, seq = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((seq, doc, more, digest))
    digest, more, doc, seq = digest[order], more[order], doc[order], seq[order]
    again = np.concatenate(([False], (digest[1:] == digest[:-1]) & (more[1:] == more[:-1])))
    # the same place of a repeated row isn't a repetition
    again &= ~np.concatenate(([False], (doc[1:] == doc[:-1]) & (seq[1:] == seq[:-1])))
    key = np.where(again, mix(doc.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + seq.astype(np.uint64)), digest).view(np.int64)
    more = np.where(again, np.int16(AGAIN), more)
    order = np.argsort(order)  # as they came: rows of one text lie together, which packs them better
    key, more, doc, seq = key[order], more[order], doc[order], seq[order]
    for lo in range(0, len(key), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(more[s]), pa.array(doc[s]), pa.array(seq[s])], names=["key", "more", "doc", "seq"])


def _chunks(least: int, batches):
    hashes = WordHashes()
    for batch in batches:
        found, words = [], 0
        for part in rowwise(batch):
            for doc, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                h = hashes.of(text.split())
                starts = chunk_starts(h)
                if len(starts):
                    d, more, place = runs(h, starts, least)
                    found.append((d, more, np.full(len(d), doc, np.int64), place))
                    words += len(h)
                if words >= PART_WORDS:
                    yield from _settled(found)
                    found, words = [], 0
        if found:
            yield from _settled(found)


def _later(batches):
    """Rows sorted by (key, more, doc, seq) -> all but each digest's first, and all marked ones."""
    last = None  # key, more, doc and seq of the digest's first
    for batch in batches:
        if not batch.num_rows:
            continue
        key, more, doc, seq = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "more", "doc", "seq"))
        new = np.concatenate(([last is None or key[0] != last[0] or more[0] != last[1]], (key[1:] != key[:-1]) | (more[1:] != more[:-1])))
        place = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first_doc = np.where(place >= 0, doc[place], last[2] if last else 0)
        first_seq = np.where(place >= 0, seq[place], last[3] if last else 0)
        out = (more == AGAIN) | (doc != first_doc) | (seq != first_seq)
        last = (key[-1], more[-1], first_doc[-1], first_seq[-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(seq[out])], names=["doc", "seq"])


def spans(text: bytes, repeated: set[int], hashes: WordHashes) -> list[tuple[int, int]]:
    """Byte spans of the chunks that lie in repeated runs."""
    words = list(_WORD.finditer(text))
    h = hashes.of([m.group() for m in words])
    starts, mine = chunk_starts(h).tolist(), tag(h)
    ends = [*starts[1:], len(words)]
    out, upto = [], -1  # the last chunk of the span that is open
    for place in sorted(repeated):
        a = (place & (1 << TAG) - 1) >> SPAN
        z = a + (place & (1 << SPAN) - 1)
        if place >> TAG != mine or z >= len(starts):
            continue
        if a <= upto + 1 and out:
            upto = max(upto, z)
            out[-1][1] = upto
        else:
            out.append([a, z])
            upto = z
    return [(words[starts[a]].start(), words[ends[z]].start() if ends[z] < len(words) else len(text)) for a, z in out]


def _edited(cut_name: str, batches):
    hashes = WordHashes()
    for batch in batches:
        for part in rowwise(batch):
            texts, cut = [], []
            for raw, seqs in zip(part.column(part.num_columns - 2).cast(pa.binary()).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                gone = spans(raw, set(seqs), hashes) if raw and seqs else []
                if gone:
                    at, keep = 0, []
                    for a, b in gone:
                        keep.append(raw[at:a])
                        at = b
                    raw = b"".join([*keep, raw[at:]]).rstrip()
                texts.append(raw)
                cut.append([{"start": a, "end": b} for a, b in gone])
            names = [*part.schema.names[:-2], "text", cut_name]
            spans_ = pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(texts, pa.binary()).cast(pa.string()), spans_], names=names)


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc, seqs: places of the runs of chunks of each text whose digest an earlier run has."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = rows.mapInArrow(functools.partial(_chunks, least), "key long, more short, doc long, seq long")
    later = chunks.repartition("key").sortWithinPartitions("key", "more", "doc", "seq").mapInArrow(_later, "doc long, seq long")
    return later.groupBy("doc").agg(F.collect_set("seq").alias("seqs"))


def dedup_substrings(docs: DataFrame, least: int = LEAST, cut: str = "cut") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and ``cut``: their byte spans in the old text.

    Needs doc_id and text; other columns pass through (one named as ``cut`` says is replaced).
    Words are compared byte by byte, white space between them isn't.  Of a repeated passage the text
    with the smallest doc_id keeps its copy (in one text, the first place).  A text that is all
    repetition becomes empty and stays as a row; texts without repetition are unchanged, nulls stay
    null.  Rows that repeat a doc_id with the same text keep it, others are texts of their own; a null doc_id takes no part.
    """
    plain = docs.drop(cut)
    keep, doc, seqs = [c for c in plain.columns if c != "text"], unused("__doc", plain), unused("seqs", plain)
    told = repeated_runs(plain, least).withColumnsRenamed({"doc": doc, "seqs": seqs})
    joined = plain.join(told, F.col("doc_id") == F.col(doc), "left").select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text"), F.col(seqs))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "text"), f"text string, `{cut}` array<struct<start:bigint,end:bigint>>"])
    out = joined.mapInArrow(functools.partial(_edited, cut), fields)
    return out.select(*[F.col(f"`{c}`") for c in plain.columns], F.col(f"`{cut}`"))
