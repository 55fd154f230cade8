"""Preprocess pipeline (C1-C3): ingest → clean → head N → write → cache check → encode twice → codes → metadata."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import resolve_instruction
from ..operators.clean import clean_corpus
from ..operators.encode import Encoder
from ..operators.labels import encode_labels, factor_codes, label_mapping_json
from ..session import materialize, remove_table
from ..sources.corpus import jsonl_in_order, load_split_files, read_corpus_csv, write_corpus_csv, write_corpus_jsonl
from ..sources.metadata import (PREPROCESS_SCHEMA, cache_key, content_fingerprint, is_cached, preprocess_metadata,
                                write_metadata)
from ..sources.vector_cache import write_encoded

OUTPUTS = ("base", "instruct", "labels", "label_mapping")


def ingest_corpus(spark: SparkSession, split_paths: dict[str, str], requested: list[str] | None,
                  out_path: str) -> str:
    """The requested splits one after the other as one CSV of their data columns."""
    df = load_split_files(spark, split_paths, requested)
    own = [c for c in df.columns if c not in ("_file", "_pos", "_order", "split", "split_ordinal")]
    # one shuffle by input order: the part files follow it, whatever the sizes of the files read
    return write_corpus_csv(df.orderBy("_order").select(*own), out_path)


def corpus_state(spark: SparkSession, cleaned: DataFrame, emb_dir: str, encoder: Encoder,
                 instruction: str | None) -> tuple[str, str, int, dict | None]:
    """``(key, content hash, rows, stored record or None)``.

    A hit means: the same ids, texts and targets in the same places, the same instruction and encoder, and every
    output there in full.
    """
    fp = content_fingerprint(cleaned, ["row_id", "text", "target"]).first()
    n, content = int(fp["num_samples"]), fp["content_hash"]
    key = cache_key(content, rows=n, instruction=instruction, model=encoder.name)
    stored = is_cached(spark, key, f"{emb_dir}/metadata", PREPROCESS_SCHEMA, [f"{emb_dir}/{o}" for o in OUTPUTS])
    return key, content, n, stored


def preprocess_corpus(spark: SparkSession, corpus: DataFrame, out_dir: str, encoder: Encoder,
                      instruction: str | None, text_col: str = "text", target_col: str = "target",
                      order_col: str = "row_id", max_samples: int | None = None, dataset: str = "",
                      default_instruction: str | None = None, vector_cache: str | None = None) -> dict:
    """Clean, write JSONL, encode base and instruct vectors of every row (of the first ``max_samples``, if given), write CSV.

    ``corpus`` is any table with a text, a target and an order column (for a
    CSV read with :func:`read_corpus_csv` that is ``_order``). ``instruction``
    falls back to ``default_instruction``. With ``vector_cache`` (a folder), only
    texts that no earlier run encoded go to the encoder
    (:mod:`vecshift.sources.vector_cache`). Returns paths, the metadata dict,
    whether the run's outputs were there, and else the texts encoded for each kind.
    """
    instruction = resolve_instruction(instruction, default_instruction)
    cleaned = clean_corpus(corpus, text_col, target_col, order_col=order_col, head=max_samples)
    # written once in row order; the JSON lines, the key, both encodings and the codes read it back
    cleaned = materialize(cleaned.select("row_id", "text", "target"), "preprocess-input", order="row_id")
    processed = f"{out_dir}/processed"
    emb_dir = f"{out_dir}/embeddings"
    key, content, n, stored = corpus_state(spark, cleaned, emb_dir, encoder, instruction)
    if stored:
        remove_table(cleaned)
        return {"cached": True, "embeddings": emb_dir, "metadata": stored}
    write_corpus_jsonl(cleaned.orderBy("row_id").select("text", "target"), f"{processed}/corpus_clean.jsonl")

    t0 = time.perf_counter()
    encoded = {"base": write_encoded(cleaned.select("row_id", "text"), encoder, None, emb_dir, "base", vector_cache, n)}
    base_s = time.perf_counter() - t0
    t0 = time.perf_counter()
    encoded["instruct"] = write_encoded(cleaned.select("row_id", "text"), encoder, instruction, emb_dir, "instruct", vector_cache, n)
    instruct_s = time.perf_counter() - t0

    # the code table is written once; labels and the JSON mapping read it back
    factor_codes(cleaned).write.mode("overwrite").parquet(f"{emb_dir}/label_mapping")
    codes = spark.read.parquet(f"{emb_dir}/label_mapping")
    encode_labels(cleaned.select("row_id", "target"), codes).select("row_id", "label").write.mode("overwrite").parquet(f"{emb_dir}/labels")
    label_mapping_json(codes).coalesce(1).write.mode("overwrite").text(f"{emb_dir}/label_mapping_json")

    # both plain files take 3 x the table: the CSV comes last, from the JSON lines, with neither the table nor a shuffle beside it
    remove_table(cleaned)
    write_corpus_csv(jsonl_in_order(spark, f"{processed}/corpus_clean.jsonl", "text STRING, target STRING"), f"{processed}/corpus_clean.csv")

    dim = spark.read.parquet(f"{emb_dir}/base").agg(F.max(F.size("embedding"))).first()[0]
    meta = {
        "dataset": dataset, "instruction": instruction, "model": encoder.name, "num_samples": n,
        "embedding_dim": dim, "base_prompt": None, "instruct_prompt": instruction,
        "base_encode_seconds": base_s, "instruct_encode_seconds": instruct_s,
        "max_samples": max_samples if max_samples is not None else n, "content_hash": content, "cache_key": key,
    }
    meta_df = preprocess_metadata(spark, meta)
    write_metadata(meta_df, f"{emb_dir}/metadata")
    return {"cached": False, "embeddings": emb_dir, "metadata": meta_df.first().asDict(), "encoded": encoded}


def preprocess_splits(spark: SparkSession, split_paths: dict[str, str], requested: list[str] | None, out_dir: str,
                      encoder: Encoder, instruction: str | None, **options) -> dict:
    """Ingest split files into one CSV and preprocess it (C1 → C2)."""
    path = ingest_corpus(spark, split_paths, requested, f"{out_dir}/raw/corpus.csv")
    return preprocess_corpus(spark, read_corpus_csv(spark, path), out_dir, encoder, instruction, order_col="_order", **options)
