"""Fitting the affine map by least squares.

The element-wise MSE of ``W·x + b`` against the teacher is quadratic in
``Θ = [W, b]ᵀ``, so everything needed — loss, gradient, exact optimum — is a
function of the sufficient statistics ``G = AᵀA``, ``C = AᵀY``, ``ΣY²`` and
``n`` with ``A = [X, 1]``. One distributed pass computes them: each partition
folds its Arrow batches with BLAS, then the per-partition partials are summed
row by row in the JVM. Only the (d+1) × (d+1+d_out) total reaches the driver:
its size depends on the dimensions, never on the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .project import AdapterModel


@dataclass
class GramStats:
    gram: np.ndarray      # (p, p), p = d_in (+1 with bias)
    cross: np.ndarray     # (p, d_out)
    yy: float             # Σ y²
    n: int
    bias: bool

    @property
    def d_in(self) -> int:
        return self.gram.shape[0] - (1 if self.bias else 0)

    @property
    def d_out(self) -> int:
        return self.cross.shape[1]

    def loss(self, theta: np.ndarray) -> float:
        """Mean squared element error of ``A·Θ`` against Y."""
        if self.n == 0:
            return float("nan")
        sse = np.einsum("ij,ij->", theta, self.gram @ theta) - 2 * np.einsum("ij,ij->", theta, self.cross) \
            + self.yy
        return float(max(sse, 0.0) / (self.n * self.d_out))

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        return 2.0 / (self.n * self.d_out) * (self.gram @ theta - self.cross)


def gram_stats(df: DataFrame, x_col: str = "base", y_col: str = "teacher", bias: bool = True,
               groups: int = 64) -> GramStats:
    """One pass over ``(x, y)`` rows → :class:`GramStats`.

    Every task of the input's own partitioning gives one partial sum. They are added up in two levels, first in
    ``groups`` groups of tasks, so that no task adds up all partials however many tasks there are.
    """
    data = df.select(F.col(x_col).cast("array<double>").alias("x"), F.col(y_col).cast("array<double>").alias("y"))
    def partials(batches):
        g = c = None
        yy, n = 0.0, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["x"].to_numpy())
            y = np.stack(pdf["y"].to_numpy())
            a = np.hstack([x, np.ones((x.shape[0], 1))]) if bias else x
            if g is None:
                g = np.zeros((a.shape[1], a.shape[1]))
                c = np.zeros((a.shape[1], y.shape[1]))
            g += a.T @ a
            c += a.T @ y
            yy += float((y * y).sum())
            n += x.shape[0]
        if g is None:
            return
        p, q = g.shape[0], c.shape[1]
        group = TaskContext.get().partitionId() % groups
        rows = [np.concatenate([g[i], c[i]]) for i in range(p)]
        tail = np.zeros(p + q)
        tail[0], tail[1] = n, yy
        rows.append(tail)
        yield pd.DataFrame({"i": np.arange(p + 1, dtype=np.int32), "g": np.int32(group), "row": rows})

    summed = (data.mapInPandas(partials, "i INT, g INT, row ARRAY<DOUBLE>")
              .groupBy("i", "g").agg(Summarizer.sum(array_to_vector("row")).alias("v"))
              .select("i", vector_to_array("v").alias("row"))
              .groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("s"))
              .select("i", vector_to_array("s").alias("row"))
              .collect())
    if not summed:
        raise ValueError("no rows to fit")
    summed.sort(key=lambda r: r["i"])
    mat = np.array([r["row"] for r in summed], dtype=np.float64)
    p = mat.shape[0] - 1
    g, c = mat[:p, :p], mat[:p, p:]
    n, yy = int(round(mat[p, 0])), float(mat[p, 1])
    return GramStats(g, c, yy, n, bias)


def _penalised_gram(stats: GramStats, l2: float, dropout: float) -> np.ndarray:
    g = stats.gram.copy()
    d = stats.d_in
    diag = np.arange(d)
    if dropout > 0:
        if dropout >= 1:
            raise ValueError("dropout must be < 1")
        # expected squared loss under inverted dropout = plain loss + p/(1-p)·Σ_j w_j² (XᵀX)_jj
        g[diag, diag] += dropout / (1.0 - dropout) * stats.gram[diag, diag]
    if l2 > 0:
        g[diag, diag] += l2 * stats.n
    return g


def solve_normal(stats: GramStats, l2: float = 0.0, dropout: float = 0.0) -> np.ndarray:
    """Exact minimiser Θ; minimum-norm least squares when the Gram is singular."""
    g = _penalised_gram(stats, l2, dropout)
    try:
        cond = np.linalg.cond(g)
        if not np.isfinite(cond) or cond > 1e12:
            raise np.linalg.LinAlgError("ill-conditioned")
        return np.linalg.solve(g, stats.cross)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(g, stats.cross, rcond=None)[0]


def theta_to_model(theta: np.ndarray, bias: bool, params: dict | None = None) -> AdapterModel:
    if bias:
        return AdapterModel(theta[:-1].T, theta[-1], params)
    return AdapterModel(theta.T, None, params)


def model_to_theta(model: AdapterModel) -> np.ndarray:
    if model.bias is not None:
        return np.vstack([model.weights.T, model.bias[None, :]])
    return model.weights.T.copy()


# ---------------------------------------------------------------- optimisers (M2, M3)
class _Optimizer:
    def __init__(self, name: str, lr: float = 1e-3, **kw):
        self.name = name.lower()
        if self.name not in ("adam", "adamw", "sgd"):
            raise ValueError(f"no optimizer is called {name}")
        self.lr = float(lr)
        self.kw = kw
        self.t = 0
        self.m = self.v = self.buf = None

    def step(self, theta: np.ndarray, grad: np.ndarray, lr: float, decay_mask: np.ndarray) -> np.ndarray:
        self.t += 1
        wd = float(self.kw.get("weight_decay", 0.01 if self.name == "adamw" else 0.0))
        if self.name == "sgd":
            mom = float(self.kw.get("momentum", 0.0))
            damp = float(self.kw.get("dampening", 0.0))
            g = grad + wd * theta * decay_mask
            if mom:
                self.buf = g.copy() if self.buf is None else mom * self.buf + (1 - damp) * g
                g = g + mom * self.buf if self.kw.get("nesterov", False) else self.buf
            return theta - lr * g
        b1, b2 = self.kw.get("betas", (0.9, 0.999))
        eps = float(self.kw.get("eps", 1e-8))
        g = grad
        if self.name == "adamw":
            theta = theta - lr * wd * theta * decay_mask
        elif wd:
            g = grad + wd * theta * decay_mask
        self.m = (1 - b1) * g if self.m is None else b1 * self.m + (1 - b1) * g
        self.v = (1 - b2) * g * g if self.v is None else b2 * self.v + (1 - b2) * g * g
        mh = self.m / (1 - b1 ** self.t)
        vh = self.v / (1 - b2 ** self.t)
        return theta - lr * mh / (np.sqrt(vh) + eps)


def scheduled_lr(base_lr: float, epoch: int, scheduler: dict | None) -> float:
    """Learning rate of an epoch under ``cosine`` (T_max, eta_min) or ``step`` (step_size, gamma)."""
    if not scheduler:
        return base_lr
    cfg = dict(scheduler)
    name = str(cfg.pop("name")).lower()
    if name == "cosine":
        t_max = float(cfg.get("T_max", 10))
        eta_min = float(cfg.get("eta_min", 0.0))
        return eta_min + (base_lr - eta_min) * (1 + math.cos(math.pi * epoch / t_max)) / 2
    if name == "step":
        return base_lr * float(cfg.get("gamma", 0.1)) ** (epoch // int(cfg["step_size"]))
    raise ValueError(f"no schedule is called {name}")


def init_theta(d_in: int, d_out: int, bias: bool, seed: int) -> np.ndarray:
    """Uniform(±1/√d_in) start, like a default linear layer."""
    rng = np.random.default_rng(seed)
    k = 1.0 / math.sqrt(d_in)
    w = rng.uniform(-k, k, size=(d_in, d_out))
    if bias:
        return np.vstack([w, rng.uniform(-k, k, size=(1, d_out))])
    return w


def gd_epochs(stats: GramStats, epochs: int = 10, batch_size: int = 64, optimizer: dict | None = None,
              scheduler: dict | None = None, seed: int = 42, l2: float = 0.0, dropout: float = 0.0,
              theta0: np.ndarray | None = None):
    """Yield ``(epoch, theta, train_loss, lr)`` after each epoch of full-batch descent.

    ``ceil(n / batch_size)`` steps per epoch, gradients from the sufficient
    statistics (no rescans). Same objective as mini-batch training; the
    trajectory is not bit-equal to it.
    """
    opt_cfg = dict(optimizer or {"name": "adam", "lr": 1e-3})
    name = opt_cfg.pop("name", "adam")
    opt = _Optimizer(name, **opt_cfg)
    theta = init_theta(stats.d_in, stats.d_out, stats.bias, seed) if theta0 is None else theta0.copy()
    g_pen = _penalised_gram(stats, l2, dropout)
    pen = GramStats(g_pen, stats.cross, stats.yy, stats.n, stats.bias)
    decay_mask = np.ones_like(theta)
    if stats.bias:
        decay_mask[-1] = 0.0
    steps = max(1, math.ceil(stats.n / int(batch_size)))
    for epoch in range(int(epochs)):
        lr = scheduled_lr(opt.lr, epoch, scheduler)
        for _ in range(steps):
            theta = opt.step(theta, pen.gradient(theta), lr, decay_mask)
        yield epoch, theta, stats.loss(theta), lr


def fit_adapter(df: DataFrame, x_col: str = "base", y_col: str = "teacher", bias: bool = True,
                solver: str = "normal", l2: float = 0.0, dropout: float = 0.0, epochs: int = 10,
                batch_size: int = 64, optimizer: dict | None = None, scheduler: dict | None = None,
                seed: int = 42, stats: GramStats | None = None) -> tuple[AdapterModel, GramStats]:
    """Fit ``W·x + b`` to the teacher on ``df`` (M1/M2). Returns the model and the train statistics."""
    stats = stats or gram_stats(df, x_col, y_col, bias)
    if solver == "normal":
        theta = solve_normal(stats, l2, dropout)
    elif solver == "gd":
        theta = None
        for _, theta, _, _ in gd_epochs(stats, epochs, batch_size, optimizer, scheduler, seed, l2, dropout):
            pass
    else:
        raise ValueError(f"solver must be normal or gd, not {solver}")
    model = theta_to_model(theta, bias, {"solver": solver, "l2": l2, "dropout": dropout})
    return model, stats
