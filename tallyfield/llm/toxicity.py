"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters with word features (how much likelier it is in toxic texts, how often it was seen)
and character features (the same for its character 4-grams, capitals, signs, length).  A text is cut
into overlapping windows of ``WIDTH`` words, ``STEP`` apart, to its very end; every window runs through
a GRU in both directions, attention pools its states, and the text's logit is its highest window's.
Training picks each text's highest window anew in every epoch and learns from it by back-propagation.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.common import as_bytes, rowwise
from tallyfield.llm.quality_classifier import held_out

WIDTH, STEP, HIDDEN, INPUTS = 24, 16, 8, 8
GRAM, BUCKET_BITS = 4, 18
EPOCHS, RATE, BATCH = 10, 0.015, 48
SAMPLE = 800  # most labelled rows of each class that a model learns from
_SMALL = bytes(sorted(set(range(256)) - set(range(65, 91))))  # all but capitals
EDGE = b".,;:!?\"'()*$%&#|"


def normal(word: bytes) -> bytes:
    return word.lower().strip(EDGE)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character GRAM-grams of <word>, all words in a row, and where each word's begin."""
    data = b"".join([b"<" + (w or b"_") + b">____"[: 1 + max(0, GRAM - 2 - len(w or b"_"))] for w in words])
    sizes = np.array([max(len(w or b"_") + 2, GRAM) for w in words], np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    code = b[: len(b) - GRAM + 1].copy()
    for j in range(1, GRAM):
        code |= b[j : len(b) - GRAM + 1 + j] << np.uint32(8 * j)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    inside = np.ones(len(bucket) + GRAM - 1, bool)
    for j in range(1, GRAM):
        inside[ends - j] = False  # grams that would run into the next word
    counts = sizes - GRAM + 1
    return bucket[inside[: len(bucket)]].astype(np.int64), np.cumsum(counts) - counts


def odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log ratio of the shares of toxic and clean texts that hold a thing, shrunk where it is rare."""
    seen = toxic + clean
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.where(seen > 1, ratio * seen / (seen + 3.0), 0.0)


class Features:
    """Feature rows of words, remembered; row 0 stands for padding."""

    limit = 250_000

    def __init__(self, words: dict[bytes, tuple[float, float]], pieces: np.ndarray):
        self.words, self.pieces = words, pieces
        self.reset()

    def reset(self) -> None:
        self.places: dict[bytes, int] = {}
        self.table = np.zeros((1, INPUTS), np.float32)

    def __getstate__(self):
        return {"words": self.words, "pieces": self.pieces}

    def __setstate__(self, state):
        self.__init__(**state)

    def learn(self, new: list[bytes]) -> None:
        cores = [normal(w) for w in new]
        bucket, starts = grams(cores)
        g = self.pieces[bucket]
        sizes = np.diff(np.append(starts, len(g)))
        n = np.fromiter(map(len, new), np.float32, len(new))
        x = np.empty((len(new), INPUTS), np.float32)
        x[:, :2] = [self.words.get(c, (0.0, 0.0)) for c in cores]
        x[:, 2], x[:, 3], x[:, 4] = np.add.reduceat(g, starts) / sizes, np.maximum.reduceat(g, starts), np.minimum.reduceat(g, starts)
        x[:, 5] = [len(w.translate(None, _SMALL)) for w in new]
        x[:, 5] /= n
        x[:, 6] = 1 - np.fromiter(map(len, cores), np.float32, len(new)) / n
        x[:, 7] = np.minimum(n, 30) / 10
        at = len(self.table)
        self.places.update(zip(new, range(at, at + len(new)), strict=True))
        self.table = np.concatenate((self.table, x))

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        every = set().union(*texts)
        new = list(every.difference(self.places))
        if new and len(self.table) + len(new) > self.limit:
            self.reset()
            new = list(every)
        if new:
            self.learn(new)
        get = self.places.__getitem__
        return [np.fromiter(map(get, w), np.int64, len(w)) for w in texts]

    def array(self) -> np.ndarray:
        return self.table


def windows(n: int) -> np.ndarray:
    """Places of the words of each window, -1 after the text's end; at least one window."""
    last = max(0, n - WIDTH)
    starts = np.arange(0, last + 1, STEP)
    if starts[-1] != last:
        starts = np.append(starts, last)
    at = starts[:, None] + np.arange(WIDTH)
    return np.where(at < n, at, -1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        s = lambda *d: (r.standard_normal(d) / np.sqrt(d[0])).astype(np.float32)
        self.p = {}
        for d in "fb":  # forward, backward: input, recurrent, bias; gates z, r, candidate
            self.p |= {f"W{d}": s(INPUTS, 3 * HIDDEN), f"U{d}": s(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": s(2 * HIDDEN, HIDDEN), "a": s(HIDDEN), "o": s(2 * HIDDEN), "b": np.full(1, -1.0, np.float32)}

    def run(self, inputs: dict[str, np.ndarray], at: np.ndarray, keep: bool = False):
        """Logits of windows; ``inputs`` are the projected feature rows, ``at`` rows of them (0: padding)."""
        n, w, hid = len(at), at.shape[1], HIDDEN
        states, memory = np.empty((n, w, 2 * hid), np.float32), {}
        for k, d in enumerate("fb"):
            u, h = self.p[f"U{d}"], np.zeros((n, hid), np.float32)
            for t in range(w) if d == "f" else range(w - 1, -1, -1):
                x, hu = inputs[d][at[:, t]], h @ u
                zr = sigmoid(x[:, : 2 * hid] + hu[:, : 2 * hid])
                z, r = zr[:, :hid], zr[:, hid:]
                c = np.tanh(x[:, 2 * hid :] + r * hu[:, 2 * hid :])
                if keep:
                    memory[d, t] = (h, z, r, c, hu[:, 2 * hid :])
                h = c + z * (h - c)
                states[:, t, k * hid : (k + 1) * hid] = h
        m = np.tanh(states @ self.p["A"])
        e = np.where(at > 0, m @ self.p["a"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=1, keepdims=True)) * (at > 0)
        weight = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=1)
        logit = pooled @ self.p["o"] + self.p["b"][0]
        return (logit, states, memory, m, weight, pooled) if keep else logit

    def inputs(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss over windows ``at`` of feature rows ``x``."""
        hid, p = HIDDEN, self.p
        logit, states, memory, m, weight, pooled = self.run(self.inputs(x), at, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = (sigmoid(logit) - y) * cost
        g["o"], g["b"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["o"]
        ds = weight[:, :, None] * dp[:, None, :]
        dw = (states * dp[:, None, :]).sum(axis=2)
        de = weight * (dw - (weight * dw).sum(axis=1, keepdims=True))
        g["a"] = np.einsum("nw,nwh->h", de, m)
        dm = de[:, :, None] * p["a"] * (1 - m * m)
        g["A"] = np.einsum("nws,nwh->sh", states, dm)
        ds += dm @ p["A"].T
        w = at.shape[1]
        for k, way in enumerate("fb"):
            u, dh = p[f"U{way}"], np.zeros((len(at), hid), np.float32)
            for t in range(w - 1, -1, -1) if way == "f" else range(w):
                h, z, r, c, hn = memory[way, t]
                dh = dh + ds[:, t, k * hid : (k + 1) * hid]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * hn * r * (1 - r)
                dx = np.concatenate((dz, dr, dc), axis=1)
                du = np.concatenate((dz, dr, dc * r), axis=1)
                g[f"U{way}"] += h.T @ du
                g[f"W{way}"] += x[at[:, t]].T @ dx
                g[f"c{way}"] += dx.sum(axis=0)
                dh = dh * z + du @ u.T
        return g


@dataclass
class Model:
    features: Features
    network: Network
    shift: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        split = [t.split() for t in texts]
        places = self.features.of(split)
        inputs = self.network.inputs(self.features.array())
        return top_windows(self.network, inputs, places)[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1; 0.3 lies where the learnt texts' classes part best."""
        return sigmoid(np.clip(self.logits(texts).astype(float) - self.shift, -30, 30) + np.log(0.3 / 0.7))


def top_windows(network: Network, inputs: dict[str, np.ndarray], places: list[np.ndarray], most: int = 8192) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's highest logit and that window's rows; all windows of all texts are run."""
    rows = []
    for p in places:
        w = windows(len(p))
        rows.append(np.append(p, 0)[w])
    cut = np.cumsum([0, *(len(r) for r in rows)])
    every = np.concatenate(rows)
    logit = np.concatenate([network.run(inputs, every[lo : lo + most]) for lo in range(0, len(every), most)])
    top = np.maximum.reduceat(logit, cut[:-1])
    best = [every[a + int(np.argmax(logit[a:b]))] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return top, best


def learn(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> Model | None:
    """Fit on labelled texts; None if a class is missing."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    split = [t.split() for t in texts]
    counts = {0: Counter(), 1: Counter()}
    pieces = np.zeros((2, 1 << BUCKET_BITS))
    for words, k in zip(split, y.astype(int), strict=True):
        unique = {normal(w) for w in words}
        counts[k].update(unique)
        if unique:
            pieces[k][np.unique(grams(list(unique))[0])] += 1
    keys = list(counts[0].keys() | counts[1].keys())
    seen_in = [np.array([counts[k][x] for x in keys], float) for k in (0, 1)]

    def tables(own: int | None) -> Features:
        """As seen by a text of class ``own`` that leaves itself out; by others if None."""
        less = [np.maximum(c - (own == k), 0) for k, c in enumerate(seen_in)]
        small = [np.maximum(c - (own == k), 0) for k, c in enumerate(pieces)]
        n = (n0 - (own == 0), n1 - (own == 1))
        v, seen = odds(less[1], less[0], n[1], n[0]), np.log1p(less[0] + less[1]) / np.log1p(len(y))
        words = {k: (a, b) for k, a, b in zip(keys, v.tolist(), seen.tolist(), strict=True) if abs(a) > 0.05 or b > 0.3}
        return Features(words, odds(small[1], small[0], n[1], n[0]).astype(np.float32))

    loo = {k: tables(k) for k in (0, 1)}
    for f in loo.values():
        f.limit = 1 << 62
    places = [np.zeros(0, np.int64)] * len(y)
    for k in (0, 1):
        mine = np.flatnonzero(y == k)
        for i, p in zip(mine, loo[k].of([split[i] for i in mine]), strict=True):
            places[i] = p
    shift0 = len(loo[0].array())
    x = np.concatenate((loo[0].array(), loo[1].array()))
    places = [np.where(p > 0, p + shift0, 0) if k else p for p, k in zip(places, y, strict=True)]
    network, rng = Network(seed), np.random.default_rng(seed)
    cost = np.where(y > 0, 0.5 / n1, 0.5 / n0).astype(np.float32) * len(y)
    first, second = ({k: np.zeros_like(v) for k, v in network.p.items()} for _ in range(2))
    steps = 0
    for epoch in range(EPOCHS):
        if epoch == 0:  # windows of the highest summed word odds, until the network has learnt to choose
            best = []
            for p in places:
                w = np.append(p, 0)[windows(len(p))]
                best.append(w[int(np.argmax(x[w][:, :, 0].max(axis=1) + 0.1 * x[w][:, :, 3].max(axis=1)))])
        else:
            best = top_windows(network, network.inputs(x), places)[1]
        rows = np.array(best)
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            g = network.gradients(x, rows[at], y[at], cost[at] / len(at))
            steps += 1
            for k, v in network.p.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] * g[k]
                v -= (RATE * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
    logit = top_windows(network, network.inputs(x), places)[0].astype(float)
    order = np.argsort(-logit)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + n1)
    k = int(np.argmax(f1))
    shift = (logit[order[k]] + logit[order[k + 1]]) / 2 if k + 1 < len(y) else logit[order[k]] - 1.0
    return Model(tables(None), network, float(shift))


def _scored(told, batches):
    model = told.value
    for batch in batches:
        for part in rowwise(batch, 128):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(as_bytes(part.column("text"))))], names=["doc_id", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; whole texts.

    ``labels`` has doc_id and toxic (0/1); rows whose crc32(doc_id as text) mod ``folds`` is ``held``
    teach nothing.  At most ``sample`` labelled rows of each class, chosen by a hash of doc_id, are
    learnt from (their texts come to the driver, so this bound is also the driver's).  Null and empty
    texts get the score of an empty window; without rows of both classes every score is 0.5 times the
    threshold.  Repeated rows are scored each; only the named columns are read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = held_out("doc_id", folds, held)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~out).dropDuplicates(["doc_id"])
    chosen = known.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionByName(known.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).collect()  # at most 2 * sample rows
    rows.sort(key=lambda r: r["doc_id"])
    model = learn([(r["text"] or "").encode() for r in rows], np.array([r["label"] for r in rows]))
    if model is None:
        scored = texts.select("doc_id", F.lit(0.5 * threshold).alias("score"))
    else:
        told = docs.sparkSession.sparkContext.broadcast(model)
        scored = texts.mapInArrow(functools.partial(_scored, told), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
