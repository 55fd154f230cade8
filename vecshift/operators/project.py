"""The affine adapter ``y = W·x + b`` as a model object and its projection.

Weights are model-sized (d_out × d_in), never data-sized, so they are shipped
once per executor as a broadcast variable; each Arrow batch is one BLAS matmul.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import affine
from ..session import path_exists

MAX_BROADCAST_BYTES = 512 * 1024 * 1024
# the JVM form inlines every weight as a literal of the plan: small maps only
MAX_JVM_WEIGHTS = 65_536


class AdapterModel:
    """Weights ``W[d_out, d_in]`` and optional bias ``b[d_out]`` (float64)."""

    def __init__(self, weights, bias=None, params: dict | None = None):
        self.weights = np.asarray(weights, dtype=np.float64)
        self.bias = None if bias is None else np.asarray(bias, dtype=np.float64)
        self.params = dict(params or {})

    @property
    def input_dim(self) -> int:
        return int(self.weights.shape[1])

    @property
    def output_dim(self) -> int:
        return int(self.weights.shape[0])

    @classmethod
    def identity(cls, dim: int, bias: bool = True) -> "AdapterModel":
        return cls(np.eye(dim), np.zeros(dim) if bias else None)

    def nbytes(self) -> int:
        return self.weights.nbytes + (0 if self.bias is None else self.bias.nbytes)

    def content_hash(self) -> str:
        """MD5 of shape, weights and bias: another map under the same path is another hash."""
        parts = [str(self.weights.shape).encode(), self.weights.tobytes()] + ([] if self.bias is None else [b"b", self.bias.tobytes()])
        return hashlib.md5(b"".join(parts)).hexdigest()

    # -------------------------------------------------------------- projection
    def project_col(self, spark: SparkSession, col, as_float: bool = True) -> Column:
        """Arrow UDF column ``W·x + b`` (one matmul per batch)."""
        if self.nbytes() > MAX_BROADCAST_BYTES:
            raise ValueError(f"adapter of {self.nbytes()} bytes exceeds the broadcast limit")
        bc = spark.sparkContext.broadcast((self.weights, self.bias))
        out_type = T.ArrayType(T.FloatType() if as_float else T.DoubleType())
        dtype = np.float32 if as_float else np.float64

        @F.pandas_udf(out_type)
        def _project(vectors: pd.Series) -> pd.Series:
            w, b = bc.value
            if len(vectors) == 0:
                return pd.Series([], dtype=object)
            x = np.stack(vectors.to_numpy()).astype(np.float64, copy=False)
            y = x @ w.T
            if b is not None:
                y += b
            return pd.Series(list(y.astype(dtype)))

        # evaluated once per row: never duplicated into inferred filters
        return _project.asNondeterministic()(F.col(col) if isinstance(col, str) else col)

    def project_jvm_col(self, col) -> Column:
        """Same map as higher-order SQL functions with inlined weights (small maps)."""
        if self.weights.size > MAX_JVM_WEIGHTS:
            raise ValueError(f"{self.weights.size} weights are too many to inline in a plan "
                             f"(limit {MAX_JVM_WEIGHTS}); use mode='arrow'")
        return affine(col, self.weights.tolist(), None if self.bias is None else self.bias.tolist())

    def transform(self, df: DataFrame, input_col: str = "embedding", output_col: str = "adapted",
                  mode: str = "arrow") -> DataFrame:
        spark = df.sparkSession
        if mode == "arrow":
            return df.withColumn(output_col, self.project_col(spark, input_col))
        if mode == "jvm":
            return df.withColumn(output_col, self.project_jvm_col(input_col))
        raise ValueError(f"mode must be arrow or jvm, not {mode}")

    # -------------------------------------------------------------- storage
    def to_frame(self, spark: SparkSession) -> DataFrame:
        """``(out_idx, weights, bias)``: one row per output dimension."""
        rows = [(i, self.weights[i].tolist(), None if self.bias is None else float(self.bias[i]))
                for i in range(self.output_dim)]
        schema = "out_idx INT, weights ARRAY<DOUBLE>, bias DOUBLE"
        return spark.createDataFrame(rows, schema)

    def save(self, spark: SparkSession, path: str) -> str:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        params = dict(self.params, input_dim=self.input_dim, output_dim=self.output_dim,
                      bias=self.bias is not None)
        spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params STRING") \
            .coalesce(1).write.mode("overwrite").text(f"{path}/params")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "AdapterModel":
        if not path_exists(spark, f"{path}/weights"):
            raise FileNotFoundError(f"no adapter is stored at {path}")
        rows = spark.read.parquet(f"{path}/weights").orderBy("out_idx").collect()
        params = json.loads(spark.read.text(f"{path}/params").first()[0])
        w = np.array([r["weights"] for r in rows], dtype=np.float64)
        b = np.array([r["bias"] for r in rows], dtype=np.float64) if params.get("bias") else None
        return cls(w, b, params)


def analytic_teacher_model(dim: int, bias_value: float = 0.25) -> AdapterModel:
    """Fixture map ``W[i,j] = sin(i·dim + j + 1)/8``, ``b = 0.25`` (FIXTURES.md §3)."""
    i = np.arange(dim, dtype=np.float64)[:, None]
    j = np.arange(dim, dtype=np.float64)[None, :]
    return AdapterModel(np.sin(i * dim + j + 1) / 8.0, np.full(dim, bias_value))
