"""Column expressions on dense vectors stored as ``array<float|double>``.

These are higher-order SQL functions, so they stay inside whole-stage codegen;
arithmetic is done in double and only the stored form is float.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def as_float_vector(v) -> Column:
    """Storage form: ``array<float>``."""
    return _col(v).cast("array<float>")


def sum_sq(v) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def l2_norm(v) -> Column:
    return F.sqrt(sum_sq(v))


def l2_normalize(v, eps: float = 1e-12) -> Column:
    """``v / max(||v||, eps)``; a zero vector stays zero."""
    v = as_double(v)
    norm = F.greatest(l2_norm(v), F.lit(eps))
    return F.transform(v, lambda x: x / norm)


def dot(a, b) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_dist(a, b) -> Column:
    diffs = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def row_mse(pred, target) -> Column:
    """Mean squared element error of one row (equal dims)."""
    return sq_dist(pred, target) / F.size(_col(pred))


def scale(v, factor: float) -> Column:
    return F.transform(as_double(v), lambda x: x * F.lit(float(factor)))


def argmax_prefix(v, k: int) -> Column:
    """0-based index of the largest of the first ``k`` elements; lowest index on ties."""
    head = F.slice(as_double(v), 1, int(k))
    best = F.array_max(head)
    return (F.array_position(head, best) - 1).cast("int")


def affine(v, weights: list[list[float]], bias: list[float] | None) -> Column:
    """JVM-only ``W·v + b`` with W and b inlined as literals.

    Meant for small maps (the literals become part of the plan); the Arrow
    form in :mod:`vecshift.operators.project` is the one for large maps.
    """
    x = as_double(v)
    outs = []
    for i, row in enumerate(weights):
        w = F.array(*[F.lit(float(a)) for a in row])
        acc = F.aggregate(F.zip_with(w, x, lambda p, q: p * q), F.lit(0.0).cast("double"),
                          lambda s, t: s + t)
        if bias is not None:
            acc = acc + F.lit(float(bias[i]))
        outs.append(acc)
    return F.array(*outs)
