"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a short vector of transformed statistics (log and logit scales).  Class means
and covariances come from distributed sums over all learnable rows; a class covariance is shrunk
towards the pooled one and towards its own diagonal.  A score is the logistic of the difference of the
two classes' log densities, the Mahalanobis terms using Cholesky factors computed once.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.common import as_bytes, rowwise, stash

NAMES = ["log_words", "symbols", "upper", "repeats", "adjacent", "dup_lines", "word_length", "variety", "punctuation", "digits", "bars", "short_words", "long_words", "non_ascii", "line_words"]
POOL, DIAGONAL, RIDGE = 0.10, 0.10, 0.05
_SYMBOLS, _PUNCTUATION, _DIGITS = (bytes(sorted(set(range(256)) - set(x))) for x in (b"#*$%&|<>^~=+@\\{}[]", b".,;:!?'\"()-", b"0123456789"))
_UPPER, _LOWER = (bytes(sorted(set(range(256)) - set(x))) for x in (bytes(range(65, 91)), bytes(range(97, 123))))
_HIGH = bytes(range(128))


def _share(part: float, whole: float) -> float:
    """Logit of a smoothed share."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 2.0)))


def statistics(text: bytes) -> list[float]:
    """The vector of one whole text (UTF-8)."""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    total = int(lengths.sum())
    grams = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower = len(text.translate(None, _UPPER)), len(text.translate(None, _LOWER))
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)),
        _share(len(text.translate(None, _SYMBOLS)), size),
        _share(upper, upper + lower),
        _share(len(grams) - len(set(grams)), len(grams)),
        _share(adjacent, n),
        _share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(total / max(n, 1))),
        _share(n - len(set(words)), n) - 0.5 * float(np.log1p(n)),
        _share(len(text.translate(None, _PUNCTUATION)), size),
        _share(len(text.translate(None, _DIGITS)), size),
        _share(text.count(b"|"), size),
        _share(int((lengths <= 2).sum()), n),
        _share(int((lengths > 15).sum()), n),
        _share(len(text.translate(None, _HIGH)), size),
        float(np.log1p(n / max(len(lines), 1))),
    ]


def _vectors(batches):
    for batch in batches:
        for part in rowwise(batch):
            x = [statistics(t) for t in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*part.schema.names[:-1], "x"])


@dataclass
class Discriminant:
    """Per class: mean, Cholesky factor of the covariance, log determinant, log prior."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    shift: float = 0.0
    scale: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        dens = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            dens.append(constant - 0.5 * (z * z).sum(axis=0))
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.logit(x) - self.shift), -30, 30)))


def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant:
    """From each class's count, sums and sums of products."""
    n = np.maximum(n.astype(float), 1e-9)
    means = sums / n[:, None]
    cov = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (n[:, None, None] * cov).sum(axis=0) / n.sum()
    factors, constants = [], []
    for k in range(2):
        few = min(0.9, POOL + len(NAMES) / (len(NAMES) + n[k]))
        c = (1 - few) * cov[k] + few * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(len(NAMES))
        f = np.linalg.cholesky(c)
        factors.append(f)
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(f)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


def _scored(model: Discriminant, batches):
    for batch in batches:
        if batch.num_rows:
            x = np.array(batch.column("x").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], names=[*batch.schema.names[:-1], "score"])


def learn_quality(vectors: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fit on rows of ``vectors`` (doc_id, x) that have a label (doc_id, label).

    The driver gets one row of sums for each class: its size doesn't grow with the input.  None when
    a class has no row.
    """
    d = len(NAMES)
    rows = vectors.join(labels.where("label in (0, 1)").select("doc_id", "label"), "doc_id")

    def sums(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for pdf in batches:
            for k in (0, 1):
                x = np.array(pdf.x[pdf.label == k].tolist()).reshape(-1, d)
                n[k] += len(x)
                s[k] += x.sum(axis=0)
                q[k] += x.T @ x
        yield pd.DataFrame({"label": [0, 1], "n": n, "s": [*s], "q": [*q.reshape(2, -1)]})

    parts = rows.mapInPandas(sums, "label int, n double, s array<double>, q array<double>")
    add = lambda c, size: F.array(*[F.sum(F.get(F.col(c), i)) for i in range(size)]).alias(c)
    got = {r["label"]: r for r in parts.groupBy("label").agg(F.sum("n").alias("n"), add("s", d), add("q", d * d)).collect()}
    if len(got) < 2 or not all(got[k]["n"] for k in (0, 1)):
        return None
    return fit(np.array([got[k]["n"] for k in (0, 1)]), np.array([got[k]["s"] for k in (0, 1)]), np.array([got[k]["q"] for k in (0, 1)]).reshape(2, d, d))


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, row: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, and its column ``row`` (long) if named.

    ``labels`` has doc_id and quality (0/1); rows whose crc32(doc_id as text) mod ``folds`` is ``held``
    teach nothing.  Null and empty texts have a vector and so a score; with no learnable rows of either
    class every score is 0.5.  Null labels are skipped; repeated rows are scored each; of each table
    only the named columns are read.
    """
    more, field = ([row], f"{row} long, ") if row else ([], "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))
    vectors = stash(texts.mapInArrow(_vectors, f"doc_id long, {field}x array<double>"))
    out = held_out("doc_id", folds, held)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(~out)
    model = learn_quality(vectors, known)
    if model is None:
        scored = vectors.select("doc_id", *more, F.lit(0.5).alias("score"))
    else:
        scored = vectors.mapInArrow(functools.partial(_scored, model), f"doc_id long, {field}score double")
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def held_out(doc_id: str, folds: int, held: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == held
