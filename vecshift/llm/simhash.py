"""SimHash near-duplicates over a Gray-order hierarchical index.

Every document gets a 64-bit fingerprint of its word shingles; fingerprints at most ``radius`` bits apart are
linked, and a component of links is a group. Distinct fingerprints are dealt to buckets: the 64 bits form
``radius + 2`` blocks, two fingerprints within the radius agree on at least two of them, so each fingerprint
goes to a bucket for every pair of blocks, keyed by the bits of the pair. Inside a bucket they stand in the
order of their Gray rank, where neighbours share long bit patterns. A tree over that order keeps for every
node the bits that all its fingerprints share; a search adds up, level by level, the differences to the newly
shared bits and leaves out whole nodes once they exceed the radius. Nodes that are already in the searching
fingerprint's component are left out as well, so a bucket yields a spanning forest, not all its pairs.

A bucket of more than ``bucket_rows`` fingerprints is dealt to chunks by hash, and every pair of chunks is a
bucket of its own, so no task holds more than two chunks and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, small, whole_text
from .components import connected_components

BITS = 64
FAN_OUT = 16
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, shingle: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit number; 0 if it has no word."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(p, 42) for p in parts], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in Gray order under a tree of shared bit patterns; ``links`` joins those within a radius."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        ones, any_ = self.codes, self.codes  # of each node: bits that all its codes have, and that any has
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up: value and mask of the shared bits
        while len(ones) > FAN_OUT:
            cut = np.arange(0, len(ones), FAN_OUT)
            ones, any_ = np.bitwise_and.reduceat(ones, cut), np.bitwise_or.reduceat(any_, cut)
            self.levels.append((ones, ones | ~any_))

    def _labels_of_nodes(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        low, high, out = label, label, []
        for ones, _ in self.levels:
            cut = np.arange(0, len(low), FAN_OUT)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            out.append((low, high))
        return out

    def search(self, who: np.ndarray, radius: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i in ``who`` and j > i, within the radius and not yet under one label."""
        nodes = self._labels_of_nodes(label)
        top = len(self.levels)
        n_top = len(self.levels[-1][0]) if top else len(self.codes)
        q, node = np.repeat(who, n_top), np.tile(np.arange(n_top), len(who))
        apart = np.zeros(len(q), np.int64)
        known = np.zeros(len(q), np.uint64)
        for depth in range(top - 1, -1, -1):
            value, mask = self.levels[depth]
            low, high = nodes[depth]
            apart = apart + np.bitwise_count((self.codes[q] ^ value[node]) & mask[node] & ~known)
            last = (node + 1) * FAN_OUT ** (depth + 1) - 1
            live = (apart <= radius) & (last > q) & ~((low[node] == label[q]) & (high[node] == label[q]))
            q, node, apart, known = q[live], node[live], apart[live], mask[node[live]]
            below = len(self.levels[depth - 1][0]) if depth else len(self.codes)
            child = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            q, apart, known = np.repeat(q, FAN_OUT), np.repeat(apart, FAN_OUT), np.repeat(known, FAN_OUT)
            real = child < below
            q, node, apart, known = q[real], child[real], apart[real], known[real]
        ahead = node > q
        q, node, apart, known = q[ahead], node[ahead], apart[ahead], known[ahead]
        apart = apart + np.bitwise_count((self.codes[q] ^ self.codes[node]) & ~known)
        near = (apart <= radius) & (label[q] != label[node])
        return q[near], node[near]

    def components(self, radius: int, block: int = 512) -> np.ndarray:
        """For each code (in Gray order) the place of the first code of its component."""
        label = np.arange(len(self.codes))
        for at in range(0, len(self.codes), block):
            a, b = self.search(np.arange(at, min(at + block, len(self.codes))), radius, label)
            while len(a):
                la, lb = label[a], label[b]
                differ = la != lb
                if not differ.any():
                    break
                np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up
        return label


def forest(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, first code of its component) of distinct codes: those of every component but the first."""
    index = GrayIndex(codes)
    label = index.components(radius)
    rest = label != np.arange(len(label))
    return index.codes[rest], index.codes[label[rest]]


def block_masks(radius: int) -> list[int]:
    """The bits of each pair of ``radius + 2`` blocks, as signed numbers."""
    edge = [BITS * k // (radius + 2) for k in range(radius + 3)]
    part = [((1 << (edge[k + 1] - edge[k])) - 1) << edge[k] for k in range(radius + 2)]
    masks = [part[a] | part[b] for a, b in combinations(range(radius + 2), 2)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    @F.pandas_udf("bigint")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([fingerprint(x, shingle) for x in t], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("digest"), of(whole_text(text_col)).alias("code"))


def links(codes: DataFrame, radius: int = 3, bucket_rows: int = 2048) -> DataFrame:
    """Links ``a, b`` among distinct ``code`` values whose components are those of all pairs within ``radius``."""
    masks = F.array(*(F.lit(m).cast("long") for m in block_masks(radius)))
    dealt = codes.select("code", F.posexplode(masks).alias("part", "mask")).select("code", "part", F.col("code").bitwiseAND(F.col("mask")).alias("key"))
    many = dealt.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = dealt.join(many, ["part", "key"])
    chunks = F.ceil(F.col("n") / bucket_rows).cast("int")
    own = F.pmod(F.xxhash64("code"), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")
    buckets = shared.select("part", "key", "code", own.alias("own"), other)
    buckets = buckets.select("part", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "code")
    key = ["part", "key", "x", "y"]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def linked(rows: pd.DataFrame) -> pd.DataFrame:
            k = rows[key].to_numpy(np.int64)
            cut = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]))
            code = rows["code"].to_numpy(np.int64).view(np.uint64)
            found = [forest(code[s:e], radius) for s, e in zip(cut[:-1], cut[1:]) if e - s > 1]
            a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
            b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[key] == rows[key].iloc[-1]).all(axis=1).to_numpy()
            first = int(np.argmax(last))  # rows are sorted: the last bucket may go on
            held = rows.iloc[first:]
            yield linked(rows.iloc[:first])
        if held is not None:
            yield linked(held)

    return buckets.repartition(*key).sortWithinPartitions(*key).mapInPandas(join, "a bigint, b bigint")


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """``code, root, component_id`` of every distinct ``code``: the component's least code, and its least doc_id."""
    codes = materialize(rows.groupBy("code").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    stars = connected_components(links(codes.select("code"), radius))
    members = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    reached = members.join(codes, F.col("node") == F.col("code")).select("node", "root", "least")
    best = reached.groupBy("root").agg(F.min("least").alias("best"))
    grouped = materialize(reached.join(best, "root").select("node", "root", "best"), "simhash-groups")
    return codes.join(small(grouped), F.col("code") == F.col("node"), "left").select(
        "code", F.coalesce("root", "code").alias("root"), F.coalesce("best", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the least doc_id reachable over links. Null texts and texts without a word have
    fingerprint 0, linked like any other; a text of fewer words than a shingle is one shingle. Rows that
    repeat an id stay rows; a null id is never the least. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col).drop("digest"), "simhash-codes")
    named = _components(rows, radius).drop("root")
    return rows.join(named, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_row(docs: DataFrame, *, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of near-duplicates; a row that is near no other always stays.

    Decided by row, not by id: of a group the row of the least id stays (null ids last), of several texts of that
    id the one of the least hash, of rows that repeat id and text the one whose columns hash least. Unrelated
    rows that share an id, null ids too, are groups of their own.
    """
    other_id, other_digest, mine, order = (fresh(docs, c) for c in ("id_", "digest_", "mine_", "order_"))
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-codes")
    found = materialize(rows.join(_components(rows, radius), "code").select("doc_id", "digest", "root", "component_id"), "simhash-found")
    leads = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # the groups in which more than one row has the least id
    several = found.filter(leads).groupBy(F.col("root").alias("several")).agg(F.min("digest").alias("first"), F.count("*").alias("n"))
    several = materialize(several.filter("n > 1").drop("n"), "simhash-several")
    leaders = found.filter(leads).join(small(several), F.col("root") == F.col("several"))
    key = [F.col("doc_id").alias(other_id), F.col("digest").alias(other_digest)]
    gone = found.filter(~leads).select(*key).unionByName(leaders.filter("digest != first").select(*key)).distinct()
    again = leaders.filter("digest = first").groupBy(*key).count().filter("count > 1").drop("count")
    gone, again = materialize(gone, "simhash-gone"), materialize(again, "simhash-again")
    same = F.col(id_col).eqNullSafe(F.col(other_id)) & (F.xxhash64(whole_text(text_col)) == F.col(other_digest))
    kept = docs.join(small(gone), same, "left_anti")
    n_again = again.count()
    if not n_again:
        return kept
    repeated = small(again, n_again)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = kept.join(repeated, same, "left_semi").select(row.alias(mine), F.xxhash64(F.to_json(row)).alias(order))
    one = one.groupBy(F.col(f"{mine}.{id_col}"), F.xxhash64(whole_text(f"{mine}.{text_col}"))).agg(F.min_by(mine, order).alias(mine))
    return kept.join(repeated, same, "left_anti").unionByName(one.select(f"{mine}.*"))
