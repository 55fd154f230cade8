"""Quality rules: statistics of every text, base limits, and an isolation forest on the statistics.

The base statistics and limits are exact counts of the whole text. The forest isolates documents whose mix of
rule statistics is rare: trees split random statistics at random places, and a document that few splits set
apart (a short path) is anomalous. Every tree grows on all labelled documents; the score at which a document goes
is set from all of them. Every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import whole_text

SYMBOLS = b"#*$%&|<>"
SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
#: All but the bytes that continue a code point in UTF-8.
NOT_CONTINUATION = bytes(set(range(256)) - set(range(0x80, 0xC0)))
UPPER = re.compile(rb"[A-Z]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW, N_SHARES = 5, 7
#: Above any score: nothing is rejected.
NO_THRESHOLD = 1.1
#: Base limits: fewer words than this, or more than this percentage of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEAT_PERCENT = 10, 20


def _repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of five that the text has twice or more, each counted once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    twice = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    edge[:n] += twice
    edge[WINDOW:WINDOW + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five base counts of a text and the shares that the forest sees.

    Shares: characters a word, symbols a word, words with a symbol, words of signs alone, signs a character,
    repeated lines, capitals a character. Words in repeated windows have a limit of their own.
    """
    data = text.encode("utf-8", "replace")
    words = data.split()
    n_words = len(words)
    word_chars = sum(len(w) for w in words) - len(data.translate(None, NOT_CONTINUATION))
    n_symbols = len(data.translate(None, NOT_SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.split(None, 1)] if n_words else []
    n_dup_lines = len(lines) - len(set(lines))
    counts = [n_words, word_chars, n_symbols, n_dup_lines, _repeated_words(words)]
    w, c = max(n_words, 1), max(word_chars, 1)
    marked = sum(x.translate(None, SYMBOLS) != x for x in words) if n_symbols else 0
    bare = sum(not x.translate(None, SIGNS) for x in words)
    signs = len(data) - len(data.translate(None, SIGNS))
    shares = [word_chars / w, n_symbols / w, marked / w, bare / w, signs / c, n_dup_lines / max(len(lines), 1),
              len(UPPER.findall(data)) / c]
    return counts, shares


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEAT_PERCENT * n_words


@dataclass
class Forest:
    """Trees as arrays: ``feature`` (-1 at a leaf), ``cut``, children, and ``depth`` (of a leaf, with what its rows would add)."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    norm: float
    threshold: float = 1.0

    def walk(self, t: int, x: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row in tree ``t``, ``depth`` splits down at most."""
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            f = self.feature[t][node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[np.arange(len(x)), np.maximum(f, 0)] >= self.cut[t][node]
            node = np.where(inner, self.child[t][node] + right, node)
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / its expectation), to four decimals: near 1 isolated at once, under 0.5 ordinary."""
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            total += self.depth[t][self.walk(t, x, int(np.log2(self.feature.shape[1] + 1)))]
        return np.round(2.0 ** -(total / max(len(self.feature), 1) / self.norm), 4)


def _unsplit(n: float) -> float:
    """Mean path length of a search tree of n rows; n is an expected number, so between whole ones too."""
    return max(n - 1, 0.0) if n < 2 else max(2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n, 1.0)


def _node_ranges(forest: Forest, depth: int):
    """A pass that gives, for each tree's nodes of ``depth``, the rows of each class there and the range of each share."""
    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, first, nodes = len(forest.feature), 2 ** depth - 1, 2 ** depth
        low = np.full((trees, nodes, N_SHARES), np.inf)
        high, count = -low, np.zeros((trees, nodes, 2), np.int64)
        for b in batches:
            x, y = np.array(b["shares"].tolist()).reshape(len(b), N_SHARES), b["label"].to_numpy()
            for t in range(trees):
                node = forest.walk(t, x, depth) - first
                here = np.flatnonzero(node >= 0)
                here = here[np.argsort(node[here], kind="stable")]
                at, starts = np.unique(node[here], return_index=True)
                if len(at):
                    low[t, at] = np.minimum(low[t, at], np.minimum.reduceat(x[here], starts))
                    high[t, at] = np.maximum(high[t, at], np.maximum.reduceat(x[here], starts))
                    count[t] += np.bincount(node[here] * 2 + y[here], minlength=nodes * 2).reshape(nodes, 2)
        t, node = np.nonzero(count.sum(axis=2))
        yield pd.DataFrame({"t": t, "node": node + first, "n0": count[t, node, 0], "n1": count[t, node, 1],
                            **{f"low{f}": low[t, node, f] for f in range(N_SHARES)}, **{f"high{f}": high[t, node, f] for f in range(N_SHARES)}})
    return ranges


def grow(rows: DataFrame, trees: int = 100, size: int = 256, rare: float = 0.02, seed: int = 3) -> Forest:
    """A forest of trees that each grow on all of ``rows`` (``label, shares``), level by level, one pass a level for all trees.

    A node splits a random share between the least and greatest of all its rows. Its rows count as those that ``size``
    rows would be expected to have there if class 0 made up ``rare`` of them; a node of one of those or less is set apart.
    """
    most = int(np.ceil(np.log2(max(size, 2))))
    shape = (trees, 2 ** (most + 1) - 1)
    heap = np.broadcast_to(2 * np.arange(shape[1]) + 1, shape)
    forest = Forest(np.full(shape, -1), np.zeros(shape), heap, np.zeros(shape), max(_unsplit(size), 1e-9))
    bounds = [f"{side}{f}" for side in ("low", "high") for f in range(N_SHARES)]
    schema = "t int, node int, n0 bigint, n1 bigint, " + ", ".join(f"{c} double" for c in bounds)
    total = None
    for depth in range(most + 1):
        merged = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in bounds]
        # at most trees x 2 ** depth rows come back, whatever the input
        found = rows.mapInPandas(_node_ranges(forest, depth), schema).groupBy("t", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *merged).collect()
        if depth == 0:
            total = np.array([found[0]["n0"], found[0]["n1"]]) if found else np.zeros(2)
            weight = size * np.array([rare, 1 - rare]) / np.maximum(total, 1)
        for r in found:
            low, high = np.array([r[c] for c in bounds]).reshape(2, N_SHARES)
            n, usable = float(weight @ (r["n0"], r["n1"])), np.flatnonzero(high > low)
            if depth >= most or n <= 1 or not len(usable):
                forest.depth[r["t"], r["node"]] = depth + _unsplit(n)
                continue
            draw = np.random.default_rng([seed, r["t"], r["node"]])
            f = draw.choice(usable)
            forest.feature[r["t"], r["node"]] = f
            forest.cut[r["t"], r["node"]] = high[f] - (high[f] - low[f]) * draw.random()  # never the least value: both sides have rows
    return forest


def calibrate(score: np.ndarray, label: np.ndarray, weight: np.ndarray, most_lost: float = 0.01) -> float:
    """The score from which a document goes: the best balanced accuracy that loses at most this share of class 1."""
    up, down = weight * (label == 1), weight * (label == 0)
    if not up.sum() or not down.sum():
        return NO_THRESHOLD
    best, at = -1.0, float(score.max()) + 1e-9
    for cut in np.unique(score)[::-1]:
        lost, caught = up[score >= cut].sum() / up.sum(), down[score >= cut].sum() / down.sum()
        if lost > most_lost:
            break
        if caught - lost > best + 1e-12:
            best, at = caught - lost, float(cut)
    below = score[score < at]
    return (at + float(below.max())) / 2 if len(below) else at


def _statistics(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for t in texts:
        found = [statistics(x) for x in t]
        yield pd.DataFrame({"n_words": [c[0] for c, _ in found], "n_repeat_words": [c[4] for c, _ in found], "shares": [s for _, s in found]})


def fit_forest(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
               trees: int = 100, subsample: int = 256, rare: float = 0.02) -> Forest:
    """Forest and threshold from all labelled documents.

    Rows that fail the base limits go anyway and take no part. Every tree grows on all the others (:func:`grow`), with
    class 0 as ``rare`` of what ``subsample`` rows would be. Scores have four decimals, so the threshold comes from the
    counts of all rows by score and class. Without labels of both classes the forest rejects nothing.
    """
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label")))
    # the numbers meet the labels, not the texts
    numbers = F.pandas_udf(_statistics, "n_words bigint, n_repeat_words bigint, shares array<double>")
    stats = docs.select(F.col(id_col).alias("doc_id"), numbers(whole_text(text_col)).alias("r"))
    rows = materialize(stats.join(known, "doc_id").select("label", "r.*"), "rule-statistics")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.filter(~failed).select("label", "shares")
    forest = grow(rows, trees, subsample, rare)
    forest.threshold = NO_THRESHOLD

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"score": forest.score(np.array(b["shares"].tolist()).reshape(len(b), N_SHARES)), "label": b["label"]})

    # two rows for each of 10,001 scores at most
    found = rows.mapInPandas(scores, "score double, label int").groupBy("score", "label").count().orderBy("score", "label").collect()
    if found:
        forest.threshold = calibrate(*(np.array([r[c] for r in found]) for c in ("score", "label", "count")))
    return forest


def apply_rules(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``kept`` and ``anomaly`` for every row of ``docs``.

    Null texts count as empty: no words, so base_failed. Repeated rows get equal results. Only the id
    and the text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # trees x 2 * subsample nodes, whatever the input

    @F.pandas_udf(", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for t in texts:
            found = [statistics(x) for x in t]
            out = pd.DataFrame([c for c, _ in found], columns=COUNTS, dtype="int64")
            failed = np.array([base_failed(c[0], c[4]) for c, _ in found], bool)
            score = f.score(np.array([s for _, s in found]).reshape(len(found), N_SHARES))
            out["base_failed"], out["kept"], out["anomaly"] = failed, ~failed & (score < f.threshold), score
            yield out

    return docs.select(F.col(id_col).alias("doc_id"), rate(whole_text(text_col)).alias("r")).select("doc_id", "r.*")
