"""Vectors by content: only new texts are encoded, and rows get the encoder's own vectors."""

import numpy as np
import pytest

from vecshift.operators.encode import Encoder, HashEncoder, encode_text
from vecshift.plans.preprocess import preprocess_corpus
from vecshift.session import scratch_path
from vecshift.sources.vector_cache import VectorCache


def letters(fails=False):
    class Letters(Encoder):  # in here, so that workers get the class itself
        """Counts of 26 letters, from the texts themselves."""

        name, dim = "letters", 26

        def encode(self, texts):
            if fails:
                raise RuntimeError("no model")
            return np.array([[(t or "").lower().count(chr(97 + i)) for i in range(26)] for t in texts], np.float32).reshape(len(texts), 26)
    return Letters()


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id LONG, text STRING")


def vectors(df):
    return {r.row_id: list(r.embedding) for r in df.collect()}


@pytest.mark.parametrize("encoder, other", [(letters(), HashEncoder(8, max_tokens=1)), (HashEncoder(8), HashEncoder(8, max_tokens=1))])
def test_only_new_texts_are_encoded(spark, encoder, other):
    cache = VectorCache(spark, scratch_path(spark, "t-vc"))
    a = table(spark, ["one two", None, "", "one two", "three"])
    got = cache.encode(a, encoder)
    assert got.encoded == 4 and vectors(got.rows) == vectors(encode_text(a, encoder))
    b = table(spark, ["new", "three", None, "new", "one two"] + ["hot"] * 300)
    got = cache.encode(b, encoder)
    assert got.encoded == 2 and got.rows.count() == 305 and vectors(got.rows) == vectors(encode_text(b, encoder))
    assert cache.encode(a, encoder).encoded == 0
    assert cache.encode(a, encoder, prompt="q ").encoded == 4 and cache.encode(a, encoder, prompt="").encoded == 0
    assert cache.encode(a, other).encoded == 4
    empty = cache.encode(a.limit(0), encoder)
    assert empty.encoded == 0 and empty.rows.count() == 0 and empty.rows.columns == ["row_id", "text", "embedding"]


def test_failed_and_simultaneous_runs(spark):
    cache, enc = VectorCache(spark, scratch_path(spark, "t-vc")), letters()
    rows = table(spark, ["a", "b"])
    with pytest.raises(Exception, match="no model"):
        cache.encode(rows, letters(fails=True))
    space = cache.space(enc, None)
    assert cache.generations(space) == []
    assert cache.encode(rows, enc).encoded == 2
    # a second run that began when nothing was there commits the same texts under the same number
    other = VectorCache(spark, cache.path)
    real, other.generations = other.generations, lambda s: []
    assert other.encode(rows, enc).encoded == 2
    assert len(real(space)) == 2
    assert vectors(cache.encode(rows, enc).rows) == vectors(encode_text(rows, enc)) and cache.encode(rows, enc).rows.count() == 2


def test_preprocessing_encodes_what_was_appended(spark):
    store, enc = scratch_path(spark, "t-vc"), HashEncoder(8)
    corpus = spark.range(110).selectExpr("id AS row_id", "concat('text ', id) AS text", "id % 3 AS target")
    first = preprocess_corpus(spark, corpus.where("row_id < 100"), scratch_path(spark, "t-vp"), enc, "q ", vector_cache=store)
    again = preprocess_corpus(spark, corpus, scratch_path(spark, "t-vp"), enc, "q ", vector_cache=store)
    assert first["encoded"] == {"base": 100, "instruct": 100} and again["encoded"] == {"base": 10, "instruct": 10}
    plain = preprocess_corpus(spark, corpus, scratch_path(spark, "t-vp"), enc, "q ")
    for kind in ("base", "instruct"):
        assert vectors(spark.read.parquet(f"{again['embeddings']}/{kind}")) == vectors(spark.read.parquet(f"{plain['embeddings']}/{kind}"))
