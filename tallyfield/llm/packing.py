"""Order-preserving packing of token streams into windows by dynamic programming.

Documents keep their doc_id order: they are dealt out by ranges of it and each range is one stream of
tokens.  A window may end at a document's end (free), at a sentence's end (a small penalty for the
truncated document) or, inside a sentence longer than ``HARD`` tokens, at a hard cut (a larger one).
With ``g(i) = best(i) + i`` the cost of ending a window at ``j`` is
``best(j) = penalty(j) + window - j + min g(i)`` over the cuts at most ``window`` tokens back: a sliding
minimum, kept in a monotone queue, so the plan is linear in the number of cuts.  The queue goes on
through a range from its first token to its last: every ``STRETCH`` windows those are written that all
places in the queue have behind them, which no later token can change, so a range's plan is the best
there is.  Its remainder is cut at powers of two, which need no padding, wherever these fall.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_left
from collections import deque
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.common import as_bytes

WINDOW = 4096
SENTENCE, CUT = 6, 64  # penalties, in tokens of padding
HARD = 256
#: Letters, signs (no apostrophe near) or one digit; else the rest of the word.
_RUNS = re.compile(r"[^\W\d_]++(?!')|(?:[^\w\s']|_)++(?!')|\d|\S+").findall
#: Capitals with a lower case of their own at a word's end or of two characters; separators that aren't white space to all.
_UNUSUAL = re.compile("[\u03a3\u0130\x1c-\x1f]")
STRETCH = 48  # windows after which what is certain is written
#: Texts that tell whether a tokenizer lowers, parts and marks words as Encoder takes for granted.
PROBES = ["", "Don't stop: 12 ABC's, x1y2 (really?!) \t\n end.", "L'\u00e9t\u00e9  na\u00efve caf\u00e9_bar--42.5% \u4e2d\u6587 we'll o'clock 'tis!", "a b  c\u00a0d <|endoftext|> </w> e"]
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Encoder:
    """Token ids of texts, through a cache of their runs of letters, of signs, and of single digits.

    The tokenizer lowers, drops white space and parts letters, digits and signs before it merges, so a
    text's ids are its runs' ids in a row.  A word is left whole from where an apostrophe may join signs
    to letters; texts that are lowered or normalised in another way than Python's are encoded as they are.
    Cached runs are encoded many at a time and told apart by their last token's end-of-word mark.
    """

    limit = 800_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        vocabulary = self.t.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.sentence = np.zeros(len(self.ends), bool)
        self.sentence[[i for w, i in vocabulary.items() if w.endswith("</w>") and set(w[:-4]) <= set(".!?") and w != "</w>"]] = True
        if not self.sentence.any():
            self.sentence[[i for w, i in vocabulary.items() if w.strip("\u0120\u2581") and set(w.strip("\u0120\u2581")) <= set(".!?")]] = True
        self.runs: dict[str, bytes] = {}
        added = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)  # texts with one are encoded as they are
        # a tokenizer of another kind encodes whole texts
        self.plain = False
        self.plain = [x.tolist() for x in self.encode([x.encode() for x in PROBES])] != [e.ids for e in self.t.encode_batch(PROBES, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        single = [x for x in new if x.isalpha()]
        other = [x for x in new if not x.isalpha()]
        ids = np.array(self.t.encode(" ".join(single), add_special_tokens=False).ids, np.uint32)
        at = np.flatnonzero(self.ends[ids]) + 1
        if single and len(at) == len(single) and at[-1] == len(ids):
            data, at = ids.tobytes(), (at * 4).tolist()
            self.runs.update(zip(single, (data[a:b] for a, b in zip([0, *at], at, strict=False)), strict=True))
        else:
            other += single
        self.runs.update(zip(other, self._each(other), strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        whole = [t.decode("utf-8", "replace") for t in texts]
        if self.plain:
            return [np.frombuffer(x, np.uint32) for x in self._each(whole)]
        usual = [_UNUSUAL.search(x) is None and unicodedata.is_normalized("NFC", x) and self.added.search(x) is None for x in whole]
        split = [_RUNS(x.lower()) if u else [] for x, u in zip(whole, usual, strict=True)]
        new = list(set().union(*split).difference(self.runs))
        if new:
            self._learn(new)
        get = self.runs.__getitem__
        out = [np.frombuffer(b"".join(map(get, runs)) if u else self._each([x])[0], np.uint32) for x, u, runs in zip(whole, usual, split, strict=True)]
        if len(self.runs) > self.limit:  # frequent runs are met first: they stay
            self.runs = dict(islice(self.runs.items(), self.limit // 2))
        return out


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker process: what one task learns serves the next."""
    return Encoder(path)


def cuts(ids: np.ndarray, doc_ends: list[int], sentence: np.ndarray, at: int = 0) -> tuple[list[int], list[int]]:
    """Places where a window may end, in order, and what ending there costs."""
    ends = np.asarray(doc_ends, np.int64)
    inner = np.flatnonzero(sentence[np.minimum(ids, len(sentence) - 1)]) + 1
    inner = np.setdiff1d(inner, ends, assume_unique=False)
    place = np.concatenate((ends, inner))
    cost = np.concatenate((np.zeros(len(ends), np.int64), np.full(len(inner), SENTENCE, np.int64)))
    order = np.argsort(place, kind="stable")
    place, cost = place[order], cost[order]
    gaps = np.diff(np.concatenate(([0], place)))
    wide = np.flatnonzero(gaps > HARD)
    if len(wide):
        hard = np.concatenate([np.arange(place[i] - gaps[i] + HARD, place[i], HARD) for i in wide])
        place, cost = np.concatenate((place, hard)), np.concatenate((cost, np.full(len(hard), CUT, np.int64)))
        order = np.argsort(place, kind="stable")
        place, cost = place[order], cost[order]
    return place.tolist(), cost.tolist()


class Planner:
    """Ends of the windows of least total padding plus penalties, of a stream that comes in parts.

    The last window isn't charged padding.  No gap between cuts may exceed ``window``.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        # of each cut since the last settled one: place, least cost of a window's end there, that plus place, cut before
        self.where, self.best, self.value, self.back = [0], [0], [0], [0]
        self.queue: deque[int] = deque([0])

    def extend(self, place: list[int], cost: list[int]) -> None:
        where, best, value, back, queue = self.where, self.best, self.value, self.back, self.queue
        for x, c in zip(place, cost, strict=True):
            while where[queue[0]] < x - self.window:
                queue.popleft()
            i = queue[0]
            b = c + self.window - x + value[i]
            v = b + x
            while queue and value[queue[-1]] >= v:
                queue.pop()
            queue.append(len(where))
            where.append(x)
            best.append(b)
            value.append(v)
            back.append(i)

    def _ends(self, i: int) -> list[int]:
        ends = []
        while i:
            ends.append(self.where[i])
            i = self.back[i]
        return ends[::-1]

    def settled(self) -> list[int]:
        """Ends that whatever comes can't change; they are forgotten.  A cut of later days goes back to one in the queue."""
        live = sorted(set(self.queue))
        while len(live) > 1:
            i = self.back[live.pop()]
            if (at := bisect_left(live, i)) == len(live) or live[at] != i:
                live.insert(at, i)
        root = live[0]
        ends = self._ends(root)
        if root:
            first = self.best[root]
            self.where, self.best, self.value = self.where[root:], [x - first for x in self.best[root:]], [x - first for x in self.value[root:]]
            self.back = [0] + [i - root if i > root else 0 for i in self.back[root + 1 :]]
            self.queue = deque(i - root for i in self.queue)
        return ends

    def rest(self) -> list[int]:
        """Ends up to the last cut: the last window, which is free, starts where the rest is cheapest."""
        last = len(self.where) - 1
        if not last:
            return []
        i = min(range(bisect_left(self.where, self.where[last] - self.window), last), key=lambda i: (self.best[i], -i))
        return [*self._ends(i), self.where[last]]


def plan(place: list[int], cost: list[int], window: int = WINDOW) -> list[int]:
    """Ends of the windows of a whole stream; ``place`` ends with its length."""
    p = Planner(window)
    p.extend(place, cost)
    return p.rest()


def _packed(path: str, end_id: int, window: int, batches):
    encoder, part = encoder_of(path), TaskContext.get().partitionId()
    planner, fresh = Planner(window), []
    ids: list[np.ndarray] = []  # from ``begin`` on
    docs: list[list[int]] = []  # doc_id, start in its document, length here, tokens of the document
    ends: list[int] = []  # of the documents in ``fresh``
    begin = known = total = 0  # the stream's places that are written, planned and read
    sequence = part << 40

    def emit(upto: list[int]):
        nonlocal sequence, docs, ids, begin
        if not upto:
            return
        stream = np.concatenate(ids)
        out: list[tuple] = []
        at, k = begin, 0
        for end in upto:
            offset = 0
            while at < end:
                doc, start, length, tokens = docs[k]
                take = min(length, end - at)
                out.append((doc, start, take, tokens, sequence, offset, stream[at - begin : at - begin + take].tobytes()))
                at, offset = at + take, offset + take
                if take == length:
                    k += 1
                else:
                    docs[k] = [doc, start + take, length - take, tokens]
            sequence += 1
        docs, ids, begin = docs[k:], [stream[at - begin :].copy()], at
        for lo in range(0, len(out), 2048):
            columns = list(zip(*out[lo : lo + 2048], strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names=[x.split()[0] for x in PIECE.split(", ")])

    def flush(final: bool):
        nonlocal fresh, ends, known
        if fresh:
            place, cost = cuts(np.concatenate(fresh), [x - known for x in ends], encoder.sentence)
            planner.extend([x + known for x in place], cost)
            fresh, ends, known = [], [], total
        if not final:
            yield from emit(planner.settled())
            return
        upto = planner.rest()[:-1]
        x = upto[-1] if upto else begin
        while rest := total - x:
            x += 1 << (min(rest, window).bit_length() - 1)
            upto.append(x)
        yield from emit(upto)

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            small = batch.slice(lo, 256)
            for doc, x in zip(small.column("doc_id").to_pylist(), encoder.encode(as_bytes(small.column("text"))), strict=True):
                x = np.append(x, np.uint32(end_id))
                ids.append(x)
                fresh.append(x)
                docs.append([doc, 0, len(x), len(x)])
                total += len(x)
                ends.append(total)
                if total - known >= STRETCH * window:
                    yield from flush(False)
    yield from flush(True)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens, with their ids (little-endian uint32).

    ``docs`` needs doc_id and text; ``tokenizer`` is the path of a tokenizer file on every executor
    (one that lowers and marks words' ends is read through a cache of runs; others encode whole texts).
    A document is its text's ids and ``end_id``; null and empty texts are that one id.  Repeated rows
    are documents of their own, a null doc_id is kept as null; other columns aren't read.  Sequences
    are full windows with little padding, or, at a range's end, powers of two without any.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.withColumn("tie", F.rand(7)).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return ranged.mapInArrow(functools.partial(_packed, tokenizer, end_id, window), PIECE)
