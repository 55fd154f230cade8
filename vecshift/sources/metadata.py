"""Run records: metadata, fingerprints, metric log, cache probes."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_path, path_exists

# fixed values: the fields of the two records and their names; the last ones are our own
PREPROCESS_SCHEMA = (
    "dataset STRING, instruction STRING, model STRING, num_samples LONG, embedding_dim INT, "
    "base_prompt STRING, instruct_prompt STRING, base_encode_seconds DOUBLE, instruct_encode_seconds DOUBLE, "
    "base_latency_ms DOUBLE, instruct_latency_ms DOUBLE, max_samples LONG, content_hash STRING, cache_key STRING")

INFERENCE_SCHEMA = (
    "source_csv STRING, file_hash STRING, text_column STRING, num_samples LONG, instruction STRING, "
    "embedding_model STRING, adapter_checkpoint STRING, adapter_latency_sec DOUBLE, "
    "base_encode_seconds DOUBLE, teacher_encode_seconds DOUBLE, latency_speedup DOUBLE, "
    "end_to_end_speedup DOUBLE, cache_key STRING")

METRICS_SCHEMA = "run_id STRING, stage STRING, epoch INT, metric STRING, value DOUBLE, logged_at DOUBLE"


def _record(spark: SparkSession, values: dict, schema: str) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], schema)


def preprocess_metadata(spark: SparkSession, values: dict) -> DataFrame:
    """One-row preprocess record (S10); per-row ms are null when there are no rows."""
    v = dict(values)
    n = v.get("num_samples") or 0
    for secs, ms in (("base_encode_seconds", "base_latency_ms"), ("instruct_encode_seconds", "instruct_latency_ms")):
        if v.get(secs) is not None and ms not in v:
            v[ms] = v[secs] / n * 1e3 if n else None
    return _record(spark, v, PREPROCESS_SCHEMA)


def inference_metadata(spark: SparkSession, values: dict) -> DataFrame:
    """One-row inference record (S11); teacher fields only when the teacher ran."""
    v = dict(values)
    t, a, b = v.get("teacher_encode_seconds"), v.get("adapter_latency_sec"), v.get("base_encode_seconds")
    if t is not None:
        v.setdefault("latency_speedup", t / a if a else None)
        v.setdefault("end_to_end_speedup", t / (a + b) if (a or 0) + (b or 0) > 0 else None)
    return _record(spark, v, INFERENCE_SCHEMA)


def write_metadata(df: DataFrame, path: str) -> str:
    """Single JSON object file; absent (null) fields stay absent."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    return path


def read_metadata(spark: SparkSession, path: str, schema: str) -> dict | None:
    """The stored record, or None when missing or malformed."""
    if not path_exists(spark, path):
        return None
    try:
        df = (spark.read.schema(schema + ", _corrupt_record STRING")
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
              .json(path))
        rows = df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record").limit(1).collect()
    except Exception:  # noqa: BLE001 - unreadable counts as absent
        return None
    return rows[0].asDict() if rows else None


def _md5_streamed(batches):
    """MD5 of each listed file, read in 8 MB chunks (no file is held whole in memory)."""
    import pandas as pd
    for pdf in batches:
        out = []
        for p in pdf["path"]:
            h = hashlib.md5()
            with open(local_path(p), "rb") as fh:
                for chunk in iter(lambda: fh.read(8 << 20), b""):
                    h.update(chunk)
            out.append(h.hexdigest())
        yield pd.DataFrame({"path": pdf["path"], "h": out})


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """MD5 hex of a file's bytes; for a folder of parts, MD5 over the sorted part hashes.

    Each file is hashed by one task. On a POSIX path (local or a shared mount)
    the task streams the file in chunks, so size is no limit; other schemes
    read it through ``binaryFile`` (one value per file, under 2 GB).
    """
    listing = spark.read.format("binaryFile").load(path)
    if "://" in path and not path.startswith("file:"):
        files = listing.select(F.col("path"), F.md5("content").alias("h"))
    else:
        # the listing reads no content; one file per row, hashed where the row lands
        paths = listing.select("path")
        files = paths.repartition(max(1, spark.sparkContext.defaultParallelism)) \
            .mapInPandas(_md5_streamed, "path STRING, h STRING")
    rows = files.orderBy("path").collect()  # one row per file
    if not rows:
        raise FileNotFoundError(path)
    if len(rows) == 1:
        return rows[0]["h"]
    return hashlib.md5("".join(r["h"] for r in rows).encode()).hexdigest()


def content_fingerprint(df: DataFrame, columns: list[str], group_cols: list[str] | None = None) -> DataFrame:
    """``num_samples, content_hash`` of the rows' ``columns``, the same for any order of rows.

    Sums of two independent 64-bit row hashes (modulo 2^61): equal rows add up instead of cancelling out, and
    with a row id among the columns the order and every value count. One scan, no sort.
    """
    mask = F.lit((1 << 61) - 1)
    # a null and where values end are part of a row's hash
    row = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    sums = [F.sum(F.xxhash64(F.lit(salt), *row).bitwiseAND(mask).cast("decimal(38,0)")) % F.lit(1 << 61).cast("decimal(38,0)") for salt in (1, 2)]
    text = F.concat_ws("-", *(F.lpad(F.hex(F.coalesce(x, F.lit(0)).cast("long")), 16, "0") for x in sums))
    return df.groupBy(*(group_cols or [])).agg(F.count(F.lit(1)).cast("long").alias("num_samples"), F.lower(text).alias("content_hash"))


def cache_key(content_hash: str, **settings) -> str:
    """One key for what a run depends on: its rows and every setting."""
    record = json.dumps({"content": content_hash, **settings}, sort_keys=True, default=str)
    return hashlib.md5(record.encode()).hexdigest()


def is_cached(spark: SparkSession, key: str, metadata_path: str, schema: str, outputs: list[str]) -> dict | None:
    """The stored record if it was written under ``key`` and every output folder is complete, else None."""
    stored = read_metadata(spark, metadata_path, schema)
    if not stored or not all(path_exists(spark, f"{o}/_SUCCESS") for o in outputs):
        return None
    request = spark.createDataFrame([(key,)], "cache_key STRING")
    known = spark.createDataFrame([(stored.get("cache_key"),)], "cache_key STRING")
    return stored if cache_probe(request, known, ["cache_key"]).first()["hit"] else None


def cache_probe(requests: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Each request with ``hit`` = an equal stored record exists on all ``keys``.

    Null never equals null here, like a missing metadata field.
    """
    s = stored.select(*keys).dropDuplicates().withColumn("_hit", F.lit(True))
    return requests.join(s, keys, "left").withColumn("hit", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def uncached_rows(df: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key (e.g. text fingerprint, instruction, model) is not yet in the cache."""
    return df.join(cache.select(*keys), keys, "left_anti")


class MetricLog:
    """Append-only metric table ``(run_id, stage, epoch, metric, value)`` plus params."""

    def __init__(self, spark: SparkSession, path: str | None = None, run_id: str | None = None):
        self.spark = spark
        self.path = path
        self.run_id = run_id or uuid.uuid4().hex[:12]
        self.rows: list[tuple] = []
        self.params: dict = {}

    def log(self, metric: str, value, stage: str = "train", epoch: int | None = None) -> None:
        if value is None:
            return
        self.rows.append((self.run_id, stage, epoch, metric, float(value), time.time()))

    def log_params(self, **params) -> None:
        self.params.update(params)

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, METRICS_SCHEMA)

    def flush(self) -> DataFrame:
        df = self.frame()
        if self.path:
            df.coalesce(1).write.mode("append").parquet(f"{self.path}/metrics")
            self.spark.createDataFrame([(self.run_id, json.dumps(self.params, sort_keys=True, default=str))],
                                       "run_id STRING, params STRING") \
                .coalesce(1).write.mode("append").parquet(f"{self.path}/params")
        return df
