"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are taken from whole texts, transformed (logarithms of counts, logits of shares) to be near normal. Labelled
rows give each class's count, mean and second moments as distributed sums, over all labelled rows; covariances are
shrunk toward their pooled diagonal, factored once (Cholesky), and scores are the posterior from the difference of
Mahalanobis log densities.

Edge cases: null or empty text has zero statistics and gets the score that these have; repeated rows score alike; label
rows with null id or quality are ignored, repeated labels count each; with one class only, the score is that class's
label; with none, 0.5. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, Scratch, as_bytes, bound_batches, enter

SHRINK, RIDGE, THRESHOLD = 0.1, 1e-3, 0.3
NAMES = ("log_words", "word_length", "upper", "symbols", "digits", "marks", "distinct_words", "repeated_triples", "repeated_lines", "line_words")
_UPPER, _SYMBOL, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>", b"0123456789"
_MARK = b"!?;:\"'()[]{}@^~`\\/_=+-"


def _logit(part: float, of: float) -> float:
    return float(np.log((part + 0.5) / (of - part + 0.5))) if of >= part else 0.0


def statistics(text: bytes | None) -> list[float]:
    t = text or b""
    words = t.lower().split()
    lines = [x for x in t.split(b"\n") if x.strip()]
    count = np.bincount(np.frombuffer(t, np.uint8), minlength=256) if t else np.zeros(256, np.int64)
    some = lambda chars: int(count[list(chars)].sum())
    solid = len(t) - some(b" \t\n\r\x0b\x0c")
    n, triples = len(words), max(0, len(words) - 2)
    return [
        float(np.log1p(n)), float(np.log1p(solid / n)) if n else 0.0, _logit(some(_UPPER), solid), _logit(some(_SYMBOL), solid), _logit(some(_DIGIT), solid), _logit(some(_MARK), solid),
        _logit(len(set(words)), n), _logit(triples - len(set(zip(words, words[1:], words[2:]))), triples), _logit(len(lines) - len(set(lines)), len(lines)), float(np.log1p(n / max(1, len(lines)))),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): transformed statistics of each row's whole text."""

    def run(batches):
        for b in batches:
            x = [statistics(t) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def _forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a lower triangular system, by forward substitution over all columns."""
    z = np.empty_like(right)
    for i in range(len(factor)):
        z[i] = (right[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Discriminant:
    """Log prior, mean and Cholesky factor of each class; NAMES order."""

    classes: dict[int, tuple[float, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if len(self.classes) < 2:
            return np.full(len(x), float(next(iter(self.classes), 0.5)))
        log = {}
        for y, (prior, mean, factor) in self.classes.items():
            z = _forward(factor, (x - mean).T)
            log[y] = prior - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(0)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(labelled: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """Discriminant of (x, quality) rows, from sums that Spark takes over all of them."""
    d = len(NAMES)
    sums = [F.sum(F.col("x")[i]) for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(d) for j in range(i + 1)]
    got = {int(r[0]): r for r in labelled.where("quality in (0, 1)").groupBy("quality").agg(F.count("*"), *sums).collect()}
    total = sum(r[1] for r in got.values())
    moments = {}
    for y, r in got.items():
        n, mean = r[1], np.array(r[2 : 2 + d]) / r[1]
        second = np.zeros((d, d))
        second[np.tril_indices(d)] = np.array(r[2 + d :]) / n
        second = np.tril(second) + np.tril(second, -1).T
        moments[y] = n, mean, second - np.outer(mean, mean)
    pooled = sum(n * c for n, _, c in moments.values()) / max(1, total) if moments else None
    out = {}
    for y, (n, mean, c) in moments.items():
        c = (1 - shrink) * c + shrink * np.diag(np.diag(pooled)) + ridge * np.eye(d)
        out[y] = float(np.log(n / total)), mean, np.linalg.cholesky(c)
    return Discriminant(out)


def classify(x: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of (doc_id, x) rows."""

    def run(batches):
        for b in batches:
            m = np.array(b.column("x").to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(m), pa.float64())], names=["doc_id", "score"])

    return x.mapInArrow(run, "doc_id long, score double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score): trained on labels (doc_id, quality), applied to every row of docs."""
    scratch = Scratch(docs.sparkSession, "quality")
    x = scratch.keep(features(docs))
    labelled = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").join(x, "doc_id")
    return classify(x, fit(labelled))


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Discriminant of all labelled documents; statistics are taken of no others, but for what the id filter lets by."""
    labels = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    wanted = Bits(labels.select("doc_id"))
    bound_batches(docs.sparkSession)

    def run(batches):
        enter("quality")
        for b in batches:
            ids = b.column(0).to_pylist()
            at = [i for i in wanted.passing(ids).tolist() if ids[i] is not None]
            x = [statistics(t) for t in as_bytes(b.column(1).take(pa.array(at, pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")
    return fit(labels.join(x, "doc_id"))


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Rows of docs, as they are, whose text scores at least the threshold. Decided row by row, where the row is."""
    at = docs.columns.index(text_col)
    bound_batches(docs.sparkSession)

    def run(batches):
        enter("quality")
        for b in batches:
            x = np.array([statistics(t) for t in as_bytes(b.column(at))], float).reshape(-1, len(NAMES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
