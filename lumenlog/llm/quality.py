"""Document quality by regularised quadratic discriminant analysis.

Whole-text statistics are transformed to near-normal columns; each class has a mean and
a covariance shrunk towards the pooled one and a multiple of the identity. A score is
the difference of Mahalanobis log-densities, from Cholesky factors that are computed
once, put on the scale of a probability by a one-variable logistic fit.

Defined results: null text counts as empty and is scored like any other; null ids are
not held out; repeated rows stay; without training rows of both classes every score is
the share of label 1 (0.5 if there are no labels); other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import add_columns, held_out, labelled, map_batches
from lumenlog.llm.linear import fit_logistic, probability

#: Labelled rows that the model is fitted on at most.
FIT_ROWS = 20_000
THRESHOLD = 0.7
SHRINK_POOLED, SHRINK_IDENTITY = 0.2, 0.05
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-|")
NAMES = ("length", "upper", "shout", "symbols", "bars", "digits", "lines", "word_length", "distinct", "echo", "pairs", "top", "stops", "line_echo", "long_words")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text, NAMES in order."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    marks = max(1, chars - text.count(" ") - text.count("\n"))
    raw = text.encode("utf-8", "replace")
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    m = max(1, n)
    bare = [w.strip(".,;:!?*#$%&|").lower() for w in words]
    count = Counter(bare)
    pairs = len(set(zip(bare, bare[1:]))) / max(1, n - 1) if n > 1 else 1.0
    lines = text.split("\n")
    logit = lambda p: np.log((p + 0.002) / (1.002 - min(p, 1.0)))
    return [
        np.log1p(n),
        logit(upper / marks),
        logit(min(1.0, text.count("!") / m)),
        logit(min(1.0, (len(raw) - len(raw.translate(None, SYMBOLS))) / m)),
        logit(min(1.0, text.count("|") / m)),
        logit(min(1.0, (len(raw) - len(raw.translate(None, b"0123456789"))) / chars)),
        logit(min(1.0, len(lines) / m)),
        np.log1p(sum(map(len, bare)) / m),
        (len(count) - n) / m if n < 2 else np.log(len(count)) / np.log(n),
        logit(sum(map(str.__eq__, bare, bare[1:])) / m),
        logit(1 - pairs),
        logit(max(count.values(), default=0) / m),
        logit(min(1.0, (text.count(".") + text.count(",")) / m)),
        logit(1 - len(set(lines)) / len(lines)),
        logit(sum(len(w) > 12 for w in count) / max(1, len(count))),
    ]


class Gaussian(NamedTuple):
    mean: np.ndarray
    whiten: np.ndarray  # inverse of the Cholesky factor
    log_scale: float  # half the log determinant, less the log prior


class Model(NamedTuple):
    constant: float | None
    center: np.ndarray
    scale: np.ndarray
    classes: tuple[Gaussian, ...]
    link: tuple | None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        density = [-0.5 * (((z - g.mean) @ g.whiten.T) ** 2).sum(1) - g.log_scale for g in self.classes]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return probability(self.link, squash(self.log_odds(x)))


def squash(odds: np.ndarray) -> np.ndarray:
    """Signed logarithm: the tails of a quadratic are far too sure."""
    return (np.sign(odds) * np.log1p(np.abs(odds)))[:, None]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    nothing = np.zeros(0)
    if len(y) == 0 or min(np.bincount(y, minlength=2)[:2]) < 2:
        return Model(float(y.mean()) if len(y) else 0.5, nothing, nothing, (), None)
    center, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - center) / scale, -8, 8)
    means = [z[y == c].mean(0) for c in (0, 1)]
    pooled = sum((z[y == c] - means[c]).T @ (z[y == c] - means[c]) for c in (0, 1)) / len(y)
    classes = []
    for c in (0, 1):
        d = z[y == c] - means[c]
        own = d.T @ d / len(d)
        own = (1 - SHRINK_POOLED) * own + SHRINK_POOLED * pooled
        own = (1 - SHRINK_IDENTITY) * own + SHRINK_IDENTITY * np.trace(own) / len(own) * np.eye(len(own))
        factor = np.linalg.cholesky(own)
        classes.append(Gaussian(means[c], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum() - np.log((y == c).mean()))))
    model = Model(None, center, scale, tuple(classes), None)
    return model._replace(link=fit_logistic(squash(model.log_odds(x)), y.astype(float)))


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model:
    """Fit on the statistics of at most ``limit`` labelled rows that are not held out."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"x": pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())), "y": batch.column("y")}

    rows = map_batches(labelled(docs, labels, "quality", limit).select("text", "y"), run, "x array<double>, y int").toArrow()
    x = np.array(rows["x"].to_pylist(), dtype=float).reshape(-1, len(NAMES))
    y = rows["y"].to_numpy().astype(int)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order in which rows arrive
    return fit(x[order], y[order])


def quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of a table with doc_id and text: doc_id, score, predicted."""
    src = docs.select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> dict:
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()], dtype=float)
        score = model.score(x)
        return {"doc_id": batch.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return map_batches(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, score double, predicted int")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns, then quality_score."""
    fn = lambda texts: {"quality_score": pa.array(model.score(np.array([statistics(t) for t in texts], dtype=float)))}
    return add_columns(docs, "text", fn, "quality_score double")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
