"""Language identification by a small byte convolutional network.

Every byte of the lower-cased text is a symbol. Filters of several widths slide over fixed-length windows,
each keeps its largest response in the window, and a softmax over these maxima gives the languages' odds.
Because the input is one symbol a place, a filter is a table per offset and its response a sum of looked-up
numbers; two offsets share one table of symbol pairs. Windows cover the whole text, overlap by the widest
filter, and a document's odds are the mean over its windows. Training is numpy on a bounded number of
labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

LETTER = r"\p{L}"  # one rule for training and prediction, both in the JVM
WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
OVERLAP = max(WIDTHS) - 1
#: Symbols: 0 anything that is no letter; a-z; other bytes of UTF-8 folded to 37 values.
SYMBOLS = 64


def _symbol_table() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[ord("a"):ord("z") + 1] = np.arange(1, 27)
    high = np.arange(0x80, 0x100)
    t[high] = 27 + (high - 0x80) % 37
    return t


SYMBOL = _symbol_table()


def windows(text: str) -> np.ndarray:
    """The whole text as windows of symbols, one row each; runs of non-letters are one symbol.

    A text has at least one window; the last one is padded.
    """
    s = SYMBOL[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    if len(s):
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    step = WINDOW - OVERLAP
    n = max(1, -(-max(len(s) - OVERLAP, 1) // step))
    padded = np.zeros(n * step + OVERLAP, np.int64)
    padded[:len(s)] = s
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


@dataclass
class Network:
    """``filters[w]``: (w, SYMBOLS, FILTERS); ``dense``: (widths x FILTERS, languages)."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> list[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each width its tables: of symbol pairs at an offset, and of single symbols where one is left."""
        out = []
        for w in WIDTHS:
            f, parts = self.filters[w].astype(np.float32), []
            for k in range(0, w - 1, 2):
                parts.append((k, (f[k][:, None, :] + f[k + 1][None, :, :]).reshape(SYMBOLS * SYMBOLS, FILTERS)))
            if w % 2:
                parts.append((w - 1, f[w - 1]))
            out.append((w, parts))
        return out

    def odds(self, rows: np.ndarray, tables: list | None = None) -> np.ndarray:
        """Softmax over languages for each window."""
        pairs = rows[:, :-1] * SYMBOLS + rows[:, 1:]
        pooled = []
        for w, parts in tables or self.tables():
            n = rows.shape[1] - w + 1
            z = None
            for k, t in parts:
                at = pairs[:, k:k + n] if len(t) > SYMBOLS else rows[:, k:k + n]
                z = t[at] if z is None else z + t[at]
            pooled.append(z.max(1))
        h = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        logits = h @ self.dense + self.dense_bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 14, batch: int = 64, rate: float = 0.02,
          per_text: int = 2, seed: int = 9) -> Network:
    """Adam on the cross entropy of single windows; up to ``per_text`` windows of each text an epoch."""
    languages = sorted(set(labels))
    draw = np.random.default_rng(seed)
    wide = len(WIDTHS) * FILTERS
    p: dict[object, np.ndarray] = {w: draw.normal(0, 0.3, (w, SYMBOLS, FILTERS)) for w in WIDTHS}
    p |= {"bias": np.zeros(wide), "dense": draw.normal(0, 0.3, (wide, max(len(languages), 1))), "dense_bias": np.zeros(max(len(languages), 1))}
    net = lambda: Network(languages, {w: p[w] for w in WIDTHS}, p["bias"], p["dense"], p["dense_bias"])
    cut = [windows(t) for t in texts if t]
    target = np.array([languages.index(x) for x, t in zip(labels, texts) if t], int)
    if len(languages) < 2 or not cut:
        return net()
    mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    share = np.bincount(target, minlength=len(languages))
    cost = np.where(share > 0, len(target) / np.maximum(share, 1) / len(languages), 0)
    for _ in range(epochs):
        rows = np.concatenate([c[draw.integers(0, len(c), min(per_text, len(c)))] for c in cut])
        ys = np.concatenate([np.full(min(per_text, len(c)), t) for c, t in zip(cut, target)])
        order = draw.permutation(len(rows))
        for at in range(0, len(order), batch):
            x, y = rows[order[at:at + batch]], ys[order[at:at + batch]]
            n = len(x)
            pooled, where = [], []
            for w in WIDTHS:
                span = WINDOW - w + 1
                z = sum(p[w][k][x[:, k:k + span]] for k in range(w))
                top = z.argmax(1)
                where.append(top)
                pooled.append(np.take_along_axis(z, top[:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + p["bias"]
            h = np.maximum(raw, 0)
            logits = h @ p["dense"] + p["dense_bias"]
            e = np.exp(logits - logits.max(1, keepdims=True))
            d = e / e.sum(1, keepdims=True)
            d[np.arange(n), y] -= 1
            d *= (cost[y] / n)[:, None]
            back = (d @ p["dense"].T) * (raw > 0)
            g: dict[object, np.ndarray] = {"dense": h.T @ d, "dense_bias": d.sum(0), "bias": back.sum(0)}
            for i, w in enumerate(WIDTHS):
                part, g[w] = back[:, i * FILTERS:(i + 1) * FILTERS], np.zeros_like(p[w])
                for k in range(w):
                    symbol = np.take_along_axis(x, where[i] + k, 1)
                    np.add.at(g[w][k], (symbol, np.broadcast_to(np.arange(FILTERS), symbol.shape)), part)
            step += 1
            for k in p:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.999 * square[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return net()


def fit_language(docs: DataFrame, allowed: Column, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
                 per_language: int = 400, most_chars: int = 20_000, stretches: int = 16, **fit: object) -> Network:
    """Train on up to ``per_language`` documents of each language (by hash of the id) where ``allowed`` holds.

    A training text of over ``most_chars`` characters gives ``stretches`` pieces of equal length, spread evenly from its
    start to its end; predictions read whole texts. Of documents that repeat an id and language, one is learned.
    """
    from pyspark.sql import Window

    usable = docs.filter(allowed & F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = usable.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, F.lit(23)).alias("h"))
    shard = ids.withColumn("shard", F.pmod("h", F.lit(64)))
    # the first ones of each shard, then of them all: no language is sorted in one task
    first = shard.withColumn("r", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("h", "doc_id"))).filter(F.col("r") <= per_language)
    chosen = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language).select("doc_id", "lang")
    length, each = F.length(text_col), most_chars // stretches
    spread = F.transform(F.sequence(F.lit(0), F.lit(stretches - 1)), lambda i: F.substring(
        F.col(text_col), (1 + F.floor(i * (length - each) / max(stretches - 1, 1))).cast("int"), F.lit(each)))
    text = F.when(length <= most_chars, F.col(text_col)).otherwise(F.array_join(spread, " "))
    rows = (usable.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
            .join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect())
    rows.sort(key=lambda r: (str(r["doc_id"]), r["lang"], r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **fit)


def predict_language(docs: DataFrame, net: Network, text_col: str = "text", block: int = 512) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the mean odds of its language over all windows of the text.

    Null texts and texts without a letter get ``und`` and score 0, as does every text if no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        tables = model.tables()
        for t in texts:
            usable = t.notna().to_numpy() & bool(model.languages)
            total, n = np.zeros((len(t), max(len(model.languages), 1))), np.zeros(len(t))
            pending, owner = [], []

            def flush() -> None:
                if pending:
                    who = np.concatenate(owner)
                    np.add.at(total, who, model.odds(np.concatenate(pending), tables))
                    np.add.at(n, who, 1)
                    pending.clear(), owner.clear()
            held = 0
            for i in np.flatnonzero(usable):
                cut = windows(t.iloc[i])
                for at in range(0, len(cut), block):
                    pending.append(cut[at:at + block])
                    owner.append(np.full(len(pending[-1]), i))
                    held += len(pending[-1])
                    if held >= block:
                        flush()
                        held = 0
            flush()
            mean = total / np.maximum(n, 1)[:, None]
            top = mean.argmax(1)
            yield pd.DataFrame({"lang_pred": [model.languages[k] if u else "und" for k, u in zip(top, usable)],
                                "score": np.where(usable, np.clip(mean.max(1), 0, 1), 0.0)})

    found = fresh(docs, "predicted_")
    out = docs.drop("lang_pred", "score").withColumn(found, predict(F.when(F.col(text_col).rlike(LETTER), F.col(text_col))))
    return out.withColumns({c: F.col(f"{found}.{c}") for c in ("lang_pred", "score")}).drop(found)


def identify_language(docs: DataFrame, **fit: object) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; held-out rows take no part in training.

    A null id is neither held out nor learned from.
    """
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    net = fit_language(docs, third != 1, **fit)
    return predict_language(docs, net).withColumn("held_out", F.coalesce(third == 1, F.lit(False)))
