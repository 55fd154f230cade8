"""Vectors by content: a text is encoded once for an encoder and a prompt, whatever corpora hold it.

The store is a folder for each encoder and prompt, with a generation (a Parquet folder of ``key, embedding``) for every
run that had new texts. A run joins narrow keys (SHA-256 of the text) to find the texts that are not there, encodes
those, each once, and commits them as the next generation; then its rows take their vectors by key. A generation counts
when its ``_SUCCESS`` file is there, so a run that failed leaves nothing behind that is read.

Generations are numbered after those a run saw. Two runs at a time may encode the same text; their numbers are then
equal, and readers keep one vector a key. Otherwise no key is there twice and none is looked for.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import Encoder, encode_text
from ..session import list_folders, materialize, path_exists
from .vectors import write_embeddings

STORE_SCHEMA = "key STRING, embedding ARRAY<FLOAT>"


@dataclass
class Cached:
    """Rows with their vectors, and how many texts were encoded for them."""

    rows: DataFrame
    encoded: int


def text_key(text: str) -> Column:
    """SHA-256 of a text; null texts have a key of their own."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


class VectorCache:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def space(self, encoder: Encoder, prompt: str | None) -> str:
        """The folder of an encoder with all its settings and a prompt (none and the empty one are the same)."""
        record = json.dumps([encoder.identity(), prompt or None], default=str)
        return f"{self.path}/{hashlib.md5(record.encode()).hexdigest()}"

    def generations(self, space: str) -> list[str]:
        """The names of the committed generations, in order."""
        if not path_exists(self.spark, space):
            return []
        return [g for g in list_folders(self.spark, space) if g.startswith("gen-") and path_exists(self.spark, f"{space}/{g}/_SUCCESS")]

    def stored(self, space: str, generations: list[str]) -> DataFrame:
        """``key, embedding`` of the generations, a row a key."""
        if not generations:
            return self.spark.createDataFrame([], STORE_SCHEMA)
        df = self.spark.read.schema(STORE_SCHEMA).parquet(*(f"{space}/{g}" for g in generations))
        numbers = [g.split("-")[1] for g in generations]
        return df if len(set(numbers)) == len(numbers) else df.dropDuplicates(["key"])

    def encode(self, df: DataFrame, encoder: Encoder, id_col: str = "row_id", text_col: str = "text", prompt: str | None = None,
               out: str = "embedding") -> Cached:
        """``df`` with ``out`` as :func:`~vecshift.operators.encode.encode_text` gives it, from the store where it is there.

        ``id_col`` must be unique and not null; ``df`` is read several times, so pass a written table. Equal texts, and null
        ones, are encoded once. A text that a large share of the rows hold moves as rows of ids; Spark's skew join splits them.
        """
        space = self.space(encoder, prompt)
        before = self.generations(space)
        keyed = df.select("*", text_key(text_col).alias("_key"))
        known = self.stored(space, before).select(F.col("key").alias("_key"))
        # one row stands for each new text; only keys and ids are shuffled
        fresh = keyed.groupBy("_key").agg(F.min(id_col).alias("_id")).join(known, "_key", "left_anti")
        fresh = materialize(fresh.select(F.col("_id").alias(id_col)), "fresh-texts")
        n = fresh.count()
        if n:
            number = 1 + max((int(g.split("-")[1]) for g in before), default=0)
            texts = keyed.select(id_col, text_col, "_key").join(fresh, id_col, "left_semi")
            vectors = encode_text(texts, encoder, text_col, prompt, out="embedding")
            name = f"gen-{number:08d}-{uuid.uuid4().hex[:12]}"
            vectors.select(F.col("_key").alias("key"), F.col("embedding").cast("array<float>").alias("embedding")).write.parquet(f"{space}/{name}")
            before = before + [name]
        vectors = self.stored(space, before).select(F.col("key").alias("_key"), F.col("embedding").alias(out))
        return Cached(keyed.join(vectors, "_key", "left").drop("_key"), n)


def write_encoded(df: DataFrame, encoder: Encoder, prompt: str | None, path: str, kind: str, vector_cache: str | None, n: int) -> int:
    """Write the vectors of ``df``'s ``n`` rows (``row_id, text``) as ``path/kind``; the number of texts encoded for it."""
    if vector_cache is None:
        write_embeddings(encode_text(df, encoder, prompt=prompt), path, kind)
        return n
    cached = VectorCache(df.sparkSession, vector_cache).encode(df, encoder, prompt=prompt)
    write_embeddings(cached.rows, path, kind)
    return cached.encoded
