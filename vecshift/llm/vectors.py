"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors are compared only with those of the same label and length. Exact copies become one representative with a
weight. The ``n`` representatives of a label are dealt to ``k`` chunks by hash, ``k`` growing as the square root of
``n`` (faster once a chunk would pass ``tile_bytes``), and every pair of chunks is a task group of its own: groups grow
in number with ``n``, none holds a whole label, and nothing depends on how large a label is.

A group works in tiles. Each unit vector ``x`` is held as ``s * q``, ``q`` of int8, with the exact length ``e`` of
what that loses. By Cauchy and Schwarz the cosine of ``x`` and ``y`` lies within ``e_x + e_y + e_x * e_y`` of
``s_x * s_y * (q_x . q_y)``, so a pair that falls short of the threshold by more than that is no link; only the
others are computed again, in double precision. (The int8 products are summed exactly: as float32 while the sums
stay under 2**24, else as float64.)

A group gives, for each of its vectors, the weight of its links, and a spanning forest of the links instead of all of
them; components come from the forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import small
from .components import connected_components

TILE = 1024
#: More than the rounding of double dot products and norms can amount to.
ROUNDING = 1e-9
#: Values of exact products that are held at a time.
RECOMPUTED = 1 << 22


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of their largest component, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``q, s, e`` of unit rows: int8 codes, scales, and the length of ``x - s * q``."""
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None])
    lost = x - s[:, None] * q
    return q.astype(np.int8), s, np.sqrt(np.einsum("ij,ij->i", lost, lost))


def tile_links(x: np.ndarray, y: np.ndarray, qx: tuple, qy: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``i`` of ``x`` and ``j`` of ``y`` whose cosine is at least ``threshold``, found by their codes."""
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    (cx, sx, ex), (cy, sy, ey) = qx, qy
    product = (cx.astype(kind) @ cy.astype(kind).T).astype(np.float64) * sx[:, None] * sy
    possible = product + (ex[:, None] * (1 + ey) + ey) >= threshold - ROUNDING
    i, j = np.nonzero(possible)
    step = max(1, RECOMPUTED // x.shape[1])
    sure = [np.einsum("ij,ij->i", x[i[at:at + step]], y[j[at:at + step]]) >= threshold for at in range(0, len(i), step)]
    keep = np.concatenate(sure) if sure else np.zeros(0, bool)
    return i[keep], j[keep]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each node's least known relative) after linking every ``a`` with its ``b``."""
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


def group_links(x: np.ndarray, weight: np.ndarray, first: np.ndarray, threshold: float, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row the weight of its links, and the first row of its component.

    ``first`` marks the rows of one chunk; links between the two chunks count, or, where there is only one (``alone``), inside it.
    """
    x = unit_rows(x)
    n, codes = len(x), quantise(x)
    count, label = np.zeros(n, np.int64), np.arange(n)
    left = np.flatnonzero(first)
    right = left if alone else np.flatnonzero(~first)
    for s in range(0, len(left), TILE):
        rows = left[s:s + TILE]
        qx = tuple(c[rows] for c in codes)
        for t in range(s if alone else 0, len(right), TILE):
            cols = right[t:t + TILE]
            i, j = tile_links(x[rows], x[cols], qx, tuple(c[cols] for c in codes), threshold)
            a, b = rows[i], cols[j]
            if alone:
                once = a < b  # rows of one tile meet twice, and themselves
                a, b = a[once], b[once]
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])
            label = join_labels(label, a, b)
    return count, label


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that isn't zero."""
    real = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(real & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_vectors(vectors: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label", tile_rows: int = 512, tile_bytes: int = 32 << 20) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Rows are linked when their labels are equal and not null and their cosine is at least ``threshold``; exact copies
    and rows that repeat an id are rows of their own and link like others. Vectors that are null, empty, zero or hold a
    null or non-finite component, vectors without a label, and vectors of different lengths link with nothing.
    ``component_id`` is the least id reachable, null ids aside (null if there is no other), and ``kept`` marks the
    rows that have it. Other columns are not read; an empty table gives an empty result.
    """
    kind = dict(vectors.dtypes)[vec_col]
    vector = F.col(f"`{vec_col}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), vector.alias("v"))
    linkable = F.col("label").isNotNull() & usable(F.col("v"))
    digest = [F.xxhash64("label", "v").alias("h1"), F.xxhash64("v", "label", F.lit(7)).alias("h2")]
    whole = rows.filter(linkable)
    reps = whole.groupBy("label", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("rep"), "label", "v", F.size("v").alias("dim"), "weight", "least", *digest), "vectors")

    sizes = materialize(reps.groupBy(F.col("label").alias("of"), F.col("dim").alias("long")).agg(F.count("*").alias("n")), "vector-sizes")
    chunks = F.greatest(F.ceil(F.sqrt(F.col("n") / tile_rows)), F.ceil(F.col("n") * F.col("dim") * 8 / tile_bytes)).cast("int")
    dealt = (reps.join(small(sizes), (F.col("label") == F.col("of")) & (F.col("dim") == F.col("long")))
             .select("rep", "label", "dim", "v", "weight", chunks.alias("k"), F.pmod(F.xxhash64("rep", F.lit(3)), chunks).cast("int").alias("own")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    key = ["label", "dim", "x", "y"]
    pairs = pairs.select("label", "dim", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "weight", "v")

    def join(group: pa.Table) -> pa.Table:
        x, y, dim = (group[c][0].as_py() for c in ("x", "y", "dim"))
        rep, weight = group["rep"].to_numpy(), group["weight"].to_numpy()
        v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group["v"].chunks])
        count, label = group_links(v.astype(np.float64).reshape(-1, dim), weight, group["own"].to_numpy() == x, threshold, x == y)
        some, tied = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": np.concatenate((rep[some], rep[tied])),
                         "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rep[label[tied]], pa.int64())]),
                         "n": np.concatenate((count[some], np.zeros(len(tied), np.int64)))})

    found = materialize(pairs.groupBy(*key).applyInArrow(join, "a bigint, b bigint, n bigint"), "vector-links")
    linked = found.groupBy(F.col("a").alias("linked")).agg(F.sum("n").alias("others"))
    stars = connected_components(found.filter("b is not null").select("a", "b"))
    members = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    reached = members.join(reps.select("rep", "least"), F.col("node") == F.col("rep")).select("node", "root", "least")
    best = reached.groupBy("root").agg(F.min("least").alias("best"))
    named = reps.drop("v").join(linked, F.col("rep") == F.col("linked"), "left").join(
        reached.join(best, "root").select("node", "best"), F.col("rep") == F.col("node"), "left")
    named = materialize(named.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                                     F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("best")).alias("component_id")), "vectors-named")

    out = ["vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")]
    alone = rows.filter(~linkable).withColumns({"n_links": F.lit(0), "component_id": F.col("vec_id")})
    return whole.select("vec_id", *digest).join(named, ["h1", "h2"]).select(*out).unionByName(alone.select(*out))
