"""Vector files: parquet sink, ``.npy`` shards and one-JSON-per-row folders."""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import sorted_rank
from ..session import local_path
from .npy import read_npy, write_npy

EMBEDDING_SCHEMA = "row_id LONG, embedding ARRAY<FLOAT>"


def write_embeddings(df: DataFrame, path: str, kind: str | None = None, id_col: str = "row_id",
                     vec_col: str = "embedding") -> str:
    """Parquet ``(row_id, embedding float[])`` under ``path/kind``."""
    target = f"{path}/{kind}" if kind else path
    df.select(F.col(id_col).cast("long").alias("row_id"),
              F.col(vec_col).cast("array<float>").alias("embedding")) \
        .write.mode("overwrite").parquet(target)
    return target


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _posix_folder(path: str) -> str:
    """Local form of a ``file:`` or plain path; other schemes cannot be written with ``os`` calls."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path}: .npy/JSON shards are written through a POSIX mount of the shared folder; "
                         "use write_embeddings (parquet) for object stores and HDFS")
    return local_path(path)


def write_npy_shards(df: DataFrame, path: str, order_col: str, vec_col: str = "embedding", shards: int | None = None) -> str:
    """Vectors as ``part-NNNNN.npy`` shards in ``order_col`` order, under a commit (:mod:`vecshift.sources.npy`)."""
    return write_npy(df, path, order_col, vec_col, "vectors", shards)


def read_npy_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, embedding)`` from all ``*.npy`` in a folder, sorted by name, stacked (S6); a file is read by ranges of rows.

    Raises ``FileNotFoundError`` when the folder has no ``.npy`` files.
    """
    return read_npy(spark, folder, "vectors")


def write_json_vectors(df: DataFrame, path: str, name_col: str, vec_col: str = "embedding") -> str:
    """One ``{"embedding": [...]}`` file per row, named ``<name>.json`` (fixture writer for S7)."""
    target = _posix_folder(path)

    def write(batches):
        os.makedirs(target, exist_ok=True)
        n = 0
        for pdf in batches:
            for name, vec in zip(pdf[name_col], pdf[vec_col]):
                with open(os.path.join(target, f"{name}.json"), "w", encoding="utf-8") as fp:
                    json.dump({"embedding": [float(x) for x in vec]}, fp)
                n += 1
        yield pd.DataFrame({"files": [n]})

    df.select(F.col(name_col).cast("string").alias(name_col), vec_col) \
        .mapInPandas(write, "files LONG").collect()
    return path


def read_json_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, embedding)`` from one-object-per-file JSON, in file-name order.

    Row ids come from an exact distributed rank of the file names.
    """
    df = (spark.read.schema("embedding ARRAY<FLOAT>").option("multiLine", "true")
          .option("pathGlobFilter", "*.json").json(folder)
          .select(F.col("_metadata.file_name").alias("file_name"), "embedding"))
    ranked = sorted_rank(df, ["file_name"], "row_id")
    return ranked.select("row_id", "embedding")


def load_vector_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``.npy`` shards if any, else JSON files, else our own parquet, else ``FileNotFoundError``."""
    files = spark.read.format("binaryFile").load(folder).select(F.lower(F.element_at(F.split("path", r"[.]"), -1)).alias("kind"))
    kinds = {r["kind"] for r in files.filter(F.col("kind").isin("npy", "json", "parquet")).distinct().collect()}
    if "npy" in kinds:
        return read_npy_embeddings(spark, folder)
    if "json" in kinds:
        return read_json_vectors(spark, folder)
    if "parquet" in kinds:
        return read_embeddings(spark, folder)
    raise FileNotFoundError(f"{folder} holds neither .npy nor .json nor parquet vectors")


def synthetic_pairs(ids: DataFrame, input_dim: int, output_dim: int, seed: int = 42,
                    noise: float = 0.05, id_col: str = "row_id") -> DataFrame:
    """``(row_id, base, target)``: base ~ N(0,1), target = base·Tᵀ + noise·N(0,1).

    Draws are keyed by ``(seed, row_id)`` so they do not depend on partitioning;
    T (output × input) is drawn once from ``seed`` and broadcast.
    """
    spark = ids.sparkSession
    t = np.random.default_rng(seed).standard_normal((output_dim, input_dim)).astype(np.float32)
    bc = spark.sparkContext.broadcast(t)

    def gen(batches):
        tm = bc.value
        for pdf in batches:
            base, target = [], []
            for rid in pdf[id_col].to_numpy():
                rng = np.random.Generator(np.random.Philox(key=[seed, int(rid)]))
                b = rng.standard_normal(input_dim).astype(np.float32)
                base.append(b)
                target.append((tm @ b + noise * rng.standard_normal(output_dim)).astype(np.float32))
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "base": base, "target": target})

    return ids.select(F.col(id_col).cast("long").alias(id_col)).mapInPandas(
        gen, f"{id_col} LONG, base ARRAY<FLOAT>, target ARRAY<FLOAT>")
