"""Streaming form of the stateless per-row operators.

The reference has no stream source or stateful operator (SURVEY §2.11); the
per-row steps (null rule, prompt, encode, normalise, project) are plain
``DataFrame → DataFrame`` functions, so they apply unchanged to a streaming
DataFrame. This module wires them to a file stream with a checkpointed sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import null_if_token
from ..operators.encode import Encoder, encode_text
from ..operators.project import AdapterModel
from ..session import is_file


def stream_corpus(spark: SparkSession, folder: str, schema: str, glob: str | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files of ``folder`` as a stream; one file is taken from the folder that it is in, as a stream's path is a folder."""
    if is_file(spark, folder):
        folder, glob = folder.rsplit("/", 1)
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(folder)


def encode_stream(stream: DataFrame, encoder: Encoder, text_col: str = "text", id_col: str = "doc_id",
                  prompt: str | None = None, model: AdapterModel | None = None) -> DataFrame:
    """Drop missing texts, encode (with an optional prompt) and optionally project, row by row."""
    rows = stream.select(id_col, null_if_token(text_col).alias("text")).where(F.col("text").isNotNull())
    out = encode_text(rows, encoder, "text", prompt=prompt)
    if model is not None:
        out = model.transform(out, "embedding", "adapted")
    return out.drop("text")


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str) -> str:
    """Process everything available now into parquet (exactly-once via the checkpoint), then stop."""
    q = (stream.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path
