import hashlib

import numpy as np
import pyarrow as pa

from vecshift.operators import encode
from vecshift.operators.encode import HashEncoder, encode_text, md5_heads, slices

TEXTS = ["", "  ", "a b a", "trail ", " lead", "x\x0by\fz", "été \U0001f600", "w" * 54, "w" * 55, "w" * 56, "w" * 300 + " a"]


def test_md5_heads_of_short_and_long_tokens():
    tokens = [b"t" * n for n in range(130)]
    first, second = md5_heads(pa.array(tokens, pa.large_binary()))
    digests = [hashlib.md5(t).digest() for t in tokens]
    assert first.tolist() == [int.from_bytes(d[:4], "big") for d in digests]
    assert second.tolist() == [d[4] for d in digests]


def test_texts_are_taken_a_bounded_number_of_bytes_at_a_time():
    texts = pa.array(["ab"] * 50 + ["x" * 500] + [""] * 3, pa.large_string())
    parts = list(slices(texts, 20))
    assert [t for p in parts for t in p.to_pylist()] == texts.to_pylist()
    assert all(len(p) == 1 or sum(map(len, p.to_pylist())) <= 20 for p in parts)


def test_vectors_are_the_sums_of_signed_hashes(spark, monkeypatch):
    monkeypatch.setattr(encode, "SLICE_BYTES", 16)
    def want(text):
        v = np.zeros(8)
        for t in [t for t in text.lower().replace("\f", " ").split(" ") if t][:3]:
            h = hashlib.md5(t.encode()).hexdigest()
            v[int(h[:8], 16) % 8] += 1 if int(h[8], 16) < 8 else -1
        return (v / max(np.sqrt((v * v).sum()), 1e-12)).tolist()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + [None])], "id LONG, text STRING")
    got = {r.id: r.embedding for r in encode_text(df, HashEncoder(8, 3), as_float=False).collect()}
    assert got == {i: want(t or "") for i, t in enumerate(TEXTS + [None])}
