"""Text → vector encoding through a pluggable encoder (P5-P10).

A model encoder runs inside an iterator Arrow UDF, so it is loaded once per
task and sees whole Arrow batches; Spark partitions the corpus across
executors. Any model with ``load()`` / ``encode(list[str]) -> ndarray`` plugs
in. The shipped :class:`HashEncoder` is a deterministic signed feature-hashing
encoder (no model weights are available), whose result SQL can reproduce: its
prompt and lower-casing are JVM expressions; tokens, their hashes and sums are
taken from the bytes of Arrow batches, a bounded number of bytes at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import with_prompt
from ..session import ensure_parallelism

#: The bytes of ``functions.text.WHITESPACE``; none of them is part of another character in UTF-8.
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\r\f"))
SLICE_BYTES = 1 << 20  # of texts that the hash encoder takes at a time
MD5_BYTES, MD5_TOKENS = 55, 1 << 13  # longest token that is one block of MD5, and tokens hashed at a time
MD5_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
MD5_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
MD5_WORDS = [(m * i + n) % 16 for m, n in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


class Encoder:
    """Protocol: ``name``, ``dim``, ``load()`` once per worker, ``encode(texts)``; ``identity()`` where more settings count."""

    name = "encoder"
    dim = 0

    def load(self) -> "Encoder":
        return self

    def identity(self) -> list:
        """Everything that a text's vector depends on; stored vectors are found by it."""
        return [self.name, self.dim]

    def encode(self, texts: list[str]) -> np.ndarray:  # pragma: no cover - protocol
        raise NotImplementedError


def _md5_blocks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of messages of one block each (16 words by messages)."""
    a, b, c, d = (np.full(blocks.shape[1], x, np.uint32) for x in MD5_START)
    for i in range(64):
        if i < 16:
            mix = d ^ (b & (c ^ d))
        elif i < 32:
            mix = c ^ (d & (b ^ c))
        elif i < 48:
            mix = b ^ c ^ d
        else:
            mix = c ^ (b | ~d)
        mix += a
        mix += blocks[MD5_WORDS[i]]
        mix += MD5_ADDED[i]
        a, d, c = d, c, b
        b = b + ((mix << MD5_SHIFTS[i]) | (mix >> (np.uint32(32) - MD5_SHIFTS[i])))
    return a + MD5_START[0], b + MD5_START[1]


def md5_heads(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of the MD5 of each token (binary, no nulls): its first eight hex digits as a number, and its fifth byte."""
    offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset:tokens.offset + len(tokens) + 1]
    chars = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
    first, second = np.zeros(len(tokens), np.uint32), np.zeros(len(tokens), np.uint32)
    size = np.diff(offsets)
    short = np.flatnonzero(size <= MD5_BYTES)
    for at in range(0, len(short), MD5_TOKENS):
        part = short[at:at + MD5_TOKENS]
        begin, length, row = offsets[part], size[part], np.arange(len(part)) * 64
        block = np.zeros(len(part) * 64, np.uint8)
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        block[np.repeat(row, length) + inside] = chars[np.repeat(begin, length) + inside]
        block[row + length] = 0x80
        block[row + 56], block[row + 57] = (length * 8) & 0xFF, (length * 8) >> 8
        a, b = _md5_blocks(np.ascontiguousarray(block.view("<u4").reshape(-1, 16).T))
        first[part], second[part] = a.byteswap(), b & 0xFF
    for i in np.flatnonzero(size > MD5_BYTES):
        digest = hashlib.md5(chars[offsets[i]:offsets[i + 1]].tobytes()).digest()
        first[i], second[i] = int.from_bytes(digest[:4], "big"), digest[4]
    return first, second


class HashEncoder(Encoder):
    """Signed feature hashing of lower-cased whitespace tokens.

    token → md5 hex h; bucket = int(h[0:8], 16) mod dim; sign = +1 when
    int(h[8], 16) < 8 else −1; signs are summed per bucket, then the vector is
    L2-normalised (a zero vector stays zero). ``max_tokens`` keeps the first
    tokens only, like a model's sequence limit; None uses the whole text.
    """

    def __init__(self, dim: int = 64, max_tokens: int | None = None, normalize: bool = True):
        self.dim = int(dim)
        self.max_tokens = max_tokens
        self.normalize = normalize
        self.name = f"hash-md5-{self.dim}"

    def identity(self) -> list:
        return [self.name, self.dim, self.max_tokens, self.normalize]

    def codes(self, tokens: pa.Array) -> np.ndarray:
        """``bucket * 2 + (1 if the sign is negative)`` of each token."""
        first, second = md5_heads(tokens)
        return first.astype(np.int64) % self.dim * 2 + (second >= 0x80)

    def sums(self, texts: pa.Array) -> np.ndarray:
        """One vector per lower-cased text (no nulls): each distinct token of the texts is hashed once."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        chars = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        ends = offsets - offsets[0]
        dark = ~IS_SPACE[chars]
        first = dark.copy()
        first[1:] &= ~dark[:-1]
        begins = ends[:-1][ends[:-1] < len(chars)]
        first[begins] = dark[begins]  # a text begins a token, whatever the text before it ends with
        starts = np.flatnonzero(first)
        per_text = np.diff(np.searchsorted(starts, ends))
        # the characters of all tokens one after the other, and where each token begins
        at = np.concatenate([[0], np.cumsum(dark)])[np.append(starts, len(chars))] if len(chars) else np.zeros(1, np.int64)
        tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(chars[dark])])
        rows = np.repeat(np.arange(len(texts), dtype=np.int64), per_text)
        if self.max_tokens is not None:
            place = np.arange(len(starts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            keep = place < self.max_tokens
            tokens, rows = tokens.filter(pa.array(keep)), rows[keep]
        words = tokens.dictionary_encode()
        c = self.codes(words.dictionary)[words.indices.to_numpy()]
        flat = np.bincount(rows * self.dim + (c >> 1), weights=1.0 - 2.0 * (c & 1), minlength=len(texts) * self.dim)
        out = flat.reshape(len(texts), self.dim)
        if self.normalize:
            norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out = out / np.maximum(norms, 1e-12)
        return out


def slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``most`` bytes, one text at least."""
    size = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


def encode_text(df: DataFrame, encoder: Encoder, text_col: str = "text", prompt: str | None = None,
                out: str = "embedding", as_float: bool = True, spread: bool = True) -> DataFrame:
    """Add ``out`` = encoder(prompt + text).

    ``spread`` spreads a small input over all task slots first
    (:func:`~vecshift.session.ensure_parallelism`); pass False when adding a
    second encoding to a frame that was already spread.

    Filter and limit *before* calling this: the encoder column is marked
    non-deterministic so Catalyst never copies the expensive call into an
    inferred filter, and for the same reason a filter written after it is not
    pushed below it (every row would be encoded first).
    """
    elem = T.FloatType() if as_float else T.DoubleType()
    dtype = np.float32 if as_float else np.float64

    hashed = isinstance(encoder, HashEncoder)

    @F.pandas_udf(T.ArrayType(elem))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder.load()
        for rows in batches:
            yield pd.Series(list(model.encode(rows.tolist()).astype(dtype)))

    @F.arrow_udf(T.ArrayType(elem))
    def _hash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encoder.load()
        for texts in batches:
            texts = texts.cast(pa.large_string())
            # a bounded number of bytes at a time, so that a task's memory does not follow its batches
            vecs = [model.sums(part).astype(dtype) for part in slices(texts, SLICE_BYTES)]
            flat = np.concatenate([np.zeros(0, dtype), *(v.ravel() for v in vecs)])
            yield pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * model.dim, flat)

    # non-deterministic for the optimiser only: keeps Catalyst from copying the
    # (expensive) call into inferred filters, e.g. below an explode
    text = with_prompt(text_col, prompt)
    if hashed:
        vector = _hash.asNondeterministic()(F.coalesce(F.lower(text), F.lit("")))
    else:
        vector = _encode.asNondeterministic()(text)
    return (ensure_parallelism(df) if spread else df).withColumn(out, vector)
