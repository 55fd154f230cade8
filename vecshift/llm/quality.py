"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

A text becomes a set of n-gram indicators. Its characters are reduced to classes (small letter, capital,
digit, blank, line end, or the sign itself), runs of letters, digits and blanks to one class, and what is
counted are trigrams of classes, joined by word n-grams that repeat (the same word twice running, with one
word between, a word seen before). An indicator says that an n-gram makes up at least a given share of the
text, so that it means the same in texts of ten words and of a hundred thousand.

The fit takes a bounded, documented number of labelled rows: log-count ratios of the two classes scale the
indicators, dual coordinate descent fits a linear hinge-loss model to them, and margins out of fold, weighted
to the class counts of all labelled rows, calibrate the score. Scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, whole_text

#: Shares of a text from which an indicator holds: 4**-0 ... 4**-(LEVELS-1).
LEVELS = 6
SMALL, CAPITAL, DIGIT, BLANK, LINE, OTHER = range(6)
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BASE = 6 + len(SIGNS)
#: After the trigram codes: three codes of repeated words.
CODES = BASE ** 3 + 3
DIMENSIONS = CODES * LEVELS


def _class_table() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[np.arange(ord("a"), ord("z") + 1)] = SMALL
    t[np.arange(0x80, 0x100)] = SMALL
    t[np.arange(ord("A"), ord("Z") + 1)] = CAPITAL
    t[np.arange(ord("0"), ord("9") + 1)] = DIGIT
    t[[0x20, 0x09, 0x0B, 0x0C]] = BLANK
    t[[0x0A, 0x0D]] = LINE
    for i, sign in enumerate(SIGNS):
        t[ord(sign)] = 6 + i
    return t


CLASS = _class_table()


def _repeats(words: list[bytes]) -> list[float]:
    n = len(words)
    if n < 3:
        return [0.0, 0.0, 0.0]
    running = sum(map(bytes.__eq__, words, words[1:]))
    apart = sum(map(bytes.__eq__, words, words[2:]))
    return [running / n, apart / n, 1.0 - len(set(words)) / n]


def indicators(text: str) -> np.ndarray:
    """The indicators that hold for a text: sorted, distinct numbers under DIMENSIONS; none if it is empty."""
    data = text.encode("utf-8", "replace")
    if not data:
        return np.zeros(0, np.int32)
    c = CLASS[np.frombuffer(data, np.uint8)]
    fresh = np.ones(len(c), bool)
    fresh[1:] = (c[1:] != c[:-1]) | (c[1:] > OTHER)
    c = np.concatenate(([LINE], c[fresh], [LINE])).astype(np.int32)
    grams = (c[:-2] * BASE + c[1:-1]) * BASE + c[2:]
    codes, counts = np.unique(grams, return_counts=True)
    shares = counts / len(grams)
    codes = np.concatenate((codes, np.arange(BASE ** 3, CODES)))
    shares = np.concatenate((shares, _repeats(data.split())))
    low = np.minimum(np.ceil(-np.log2(np.maximum(shares, 1e-9)) / 2), LEVELS).astype(np.int64)  # holds from here on
    out = [codes[low <= level] * LEVELS + level for level in range(LEVELS)]
    return np.sort(np.concatenate(out)).astype(np.int32)


@dataclass
class Model:
    """``margin = weight[indicators].sum() / sqrt(len) + bias``; ``score = sigmoid(slope * margin + offset)``."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weight[r].sum() / np.sqrt(max(len(r), 1)) for r in rows]) + self.bias

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(rows) + self.offset, -40, 40)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    up, down = np.full(DIMENSIONS, smooth), np.full(DIMENSIONS, smooth)
    for r, label in zip(rows, y):
        (up if label > 0 else down)[r] += 1
    return np.log((up / up.sum()) / (down / down.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                            epochs: int = 25, seed: int = 5, tol: float = 1e-3) -> np.ndarray:
    """Weights (the last one the bias) of the L2-regularised hinge loss, by its dual.

    One dual variable a row, between 0 and the row's cost; each step solves for one variable exactly and
    moves the weights along its row. It ends when no variable's projected gradient is over ``tol``.
    """
    w, a = np.zeros(DIMENSIONS + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in draw.permutation(len(rows)):
            gradient = y[i] * (values[i] @ w[rows[i]] + w[-1]) - 1.0
            move = min(max(a[i] - gradient / norm[i], 0.0), cost[i]) - a[i]
            if move:
                worst = max(worst, abs(gradient))
                w[rows[i]] += move * y[i] * values[i]
                w[-1] += move * y[i]
                a[i] += move
        if worst <= tol:
            break
    return w


def _fit_margin(rows: list[np.ndarray], y: np.ndarray, c: float) -> Model:
    ratio = log_count_ratios(rows, y)
    values = [ratio[r] / np.sqrt(max(len(r), 1)) for r in rows]
    n_up, n_down = max((y > 0).sum(), 1), max((y < 0).sum(), 1)
    cost = c * np.where(y > 0, len(y) / (2 * n_up), len(y) / (2 * n_down))
    w = dual_coordinate_descent(rows, values, y, cost)
    return Model(w[:-1] * ratio, float(w[-1]), 1.0, 0.0)


def _calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid, by Newton steps on the weighted log loss, lightly held to slope 1."""
    x, t = np.stack([margin, np.ones_like(margin)], 1), np.where(y > 0, 1.0, 0.0)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        g = x.T @ (weight * (p - t)) + 1e-2 * (b - [1.0, 0.0])
        h = (x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(b[0]), 1e-3), float(b[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, totals: tuple[int, int] | None = None, c: float = 1.0, folds: int = 3) -> Model:
    """A model of the rows. ``totals``: how many rows of class 0 and 1 they stand for.

    Without rows of both classes every text scores the share of class 1 (0.5 if there are no rows).
    """
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    n = totals or (int((y < 0).sum()), int((y > 0).sum()))
    if not (y > 0).any() or not (y < 0).any():
        share = (n[1] + 1) / (sum(n) + 2) if len(y) else 0.5
        return Model(np.zeros(DIMENSIONS), 0.0, 1.0, float(np.log(share / (1 - share))))
    weight = np.where(y > 0, n[1] / (y > 0).sum(), n[0] / (y < 0).sum())
    part, margin = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        here = part == k
        if (y[~here] > 0).any() and (y[~here] < 0).any():
            margin[here] = _fit_margin([r for r, x in zip(rows, here) if not x], y[~here], c).margin([r for r, x in zip(rows, here) if x])
    model = _fit_margin(rows, y, c)
    model.slope, model.offset = _calibrate(margin, y, weight)
    return model


def _indicator_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "label": b["label"], "found": [indicators(t).tobytes() for t in b["text"]]})


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                allowed: Column | None = None, per_class: int = 1500) -> Model:
    """Fit on up to ``per_class`` labelled documents of each class (by hash of the id) where ``allowed`` holds.

    ``allowed`` is a condition on ``labels``' doc_id. Only indicators of these rows reach the driver.
    """
    usable = labels.filter(allowed) if allowed is not None else labels
    counts = dict(usable.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect())
    chosen = bounded_labels(usable, label, per_class)
    rows = (docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
            .join(F.broadcast(chosen), "doc_id").mapInPandas(_indicator_rows, "doc_id string, label int, found binary").collect())
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["found"])))
    found = [np.frombuffer(bytes(r["found"]), np.int32) for r in rows]
    return fit_rows(found, np.array([r["label"] for r in rows]), (counts.get(0, 0), counts.get(1, 0)))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the column ``out`` (0 to 1, higher: label 1 likelier). Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS doubles, whatever the input

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for t in texts:
            yield pd.Series(m.score([indicators(x) for x in t]), dtype="float64")

    return docs.withColumn(out, score(whole_text(text_col)))


def not_held_out(remainder: int = 0, folds: int = 5, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds != remainder


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit: object) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; labels of held-out rows are never read.

    Null and empty texts have no indicator and get the score of the bias. A null id is not held out.
    Repeated rows get equal scores; an empty ``docs`` gives an empty result, an empty ``labels`` 0.5 for all.
    Columns of ``docs`` by the names of the new ones are replaced.
    """
    model = fit_quality(docs, labels, allowed=not_held_out(), **fit)
    held = F.coalesce(~not_held_out(), F.lit(False))
    scored = score_quality(docs, model, out="score")
    return scored.withColumns({"held_out": held, "predicted": (F.col("score") >= threshold).cast("int")})
