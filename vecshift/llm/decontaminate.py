"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

A document leaks an item if one of its windows of the item's length in words is near the item: weighted Jaccard
similarity of their five-word shingles (weights: repeats) of 0.8 or more. Three steps, none of which loses one:

1. Windows. Two sets of m shingles that similar share at least 8/9 of m, so a window can only matter if it
   holds that many places whose shingle the item has, and the best one begins at such a place or ends with
   the text. One scan finds the places; windows that hold enough of them get a SimHash of their shingles.
2. Multi-index Hamming blocks. Item fingerprints are filed under each of eight blocks of bits and under all
   values that differ from it in up to ``radius // 8`` bits. Fingerprints within the radius agree with that
   in one block at least, so a window looks up its eight blocks and meets every item within the radius.
3. The exact weighted similarity of window and item decides.

The radius is that of the similarity: 0.8 is an angle of 27 degrees, where 64 bits differ in about 10 places
(standard deviation 2.9); the default of 20 lies 3.5 deviations beyond.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, small, whole_text, words

SHINGLE = 5
BLOCKS, BLOCK_BITS = 8, 8


def _shingles(hashes: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words, from the words' hashes; none if there are fewer."""
    last = F.size(hashes) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k))))).otherwise(
        F.array().cast("array<bigint>"))


def _word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def simhash(shingles: DataFrame, key: list[str], h: str = "h") -> DataFrame:
    """``key, code``: the SimHash of each key's hashes, one row each, repeats included.

    A sum counts two bits at once, in the two halves of a long, so 32 sums count 64 bits.
    """
    lanes = [F.sum(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(0x100000001))).alias(f"s{b}") for b in range(32)]
    sums = shingles.groupBy(*key).agg(F.count("*").alias("m"), *lanes)
    code = F.lit(0).cast("long")
    for b in range(32):
        for lane, bit in ((F.col(f"s{b}").bitwiseAND(F.lit(0xFFFFFFFF)), b), (F.shiftrightunsigned(f"s{b}", 32), b + 32)):
            code = code.bitwiseOR(F.when(2 * lane > F.col("m"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return sums.select(*key, code.alias("code"))


def _block(code: Column, b: int) -> Column:
    return F.shiftrightunsigned(code, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _variants(bits: int) -> list[int]:
    """All block patterns of up to ``bits`` ones."""
    return [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(BLOCK_BITS), n)]


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, item, n, k, m, hs``: key of the words, their number, shingle length, number of shingles and their hashes.

    ``item`` depends on the text only, so an id (null too) may have several texts and a text several ids. Items
    without a word are left out.
    """
    rows = benchmark.select(F.col(id_col).alias("item_id"), _word_hashes(whole_text(text_col)).alias("w")).filter(F.size("w") > 0)
    rows = rows.withColumn("n", F.size("w")).withColumn("k", F.least(F.col("n"), F.lit(SHINGLE)))
    hs = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        hs = F.when(F.col("k") == k, _shingles(F.col("w"), k)).otherwise(hs)
    return rows.select("item_id", F.xxhash64("w").alias("item"), "n", "k", (F.col("n") - F.col("k") + 1).alias("m"), hs.alias("hs")).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", similarity: float = 0.8, radius: int = 20) -> DataFrame:
    """``doc_id, digest, item_id, start_word, n_words, similarity``: each document's best window for each item that it leaks.

    ``digest`` hashes the text; rows that repeat an id and a text are one. Words are lower-cased and split at
    ASCII white space. An item of fewer than five words is one shingle, as is a window of its length; a text
    shorter than the item is one window. Null and empty texts and items leak nothing. Ties go to the first window.
    Every distinct text of an item is searched for by itself; an ``item_id`` of several texts (null is one) gets the
    best window of any.
    """
    named = materialize(benchmark_items(benchmark, item_col, item_text_col), "leak-named")
    items = materialize(named.dropDuplicates(["item"]).drop("item_id"), "leak-items")
    ks = [r["k"] for r in items.select("k").distinct().collect()]  # at most five numbers
    places = materialize(items.select("k", F.explode("hs").alias("h"), "item", "n", "m").distinct(), "leak-places")
    n_places = places.count()
    text = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text_"))
    hashed = text.select("doc_id", F.xxhash64("text_").alias("digest"), _word_hashes(F.col("text_")).alias("w"))
    found = None
    for k in ks:
        # the scan: one hash a word, looked up among the items' hashes
        runs = hashed.select("doc_id", "digest", F.size("w").alias("n_doc"), F.posexplode(_shingles(F.col("w"), k)).alias("p", "h"))
        mine = runs.join(small(places.filter(F.col("k") == k), n_places), "h").select("doc_id", "digest", "n_doc", "k", "item", "n", "m", "p")
        found = mine if found is None else found.unionByName(mine)
    if found is None:  # no item has a word
        empty = text.limit(0).select("doc_id", F.lit(0).cast("long").alias("digest"), F.lit(None).cast(named.schema["item_id"].dataType).alias("item_id"))
        return empty.withColumns({"start_word": F.lit(0), "n_words": F.lit(0), "similarity": F.lit(0.0)})
    by_item = found.groupBy("doc_id", "digest", "n_doc", "k", "item", "n", "m").agg(F.array_sort(F.collect_set("p")).alias("at"))
    # shared shingles that a window (of m2 <= m shingles) needs: s / (1 + s) of both together
    span = F.least(F.col("m"), F.col("n_doc") - F.col("k") + 1)
    need = F.greatest(F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("m") + span) - 1e-9).cast("int"), F.lit(1))
    enough = F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda i: F.get("at", i + need - 1) - F.get("at", i) < span)
    start = F.transform(enough, lambda i: F.least(F.get("at", i), F.col("n_doc") - F.col("k") + 1 - span))
    windows = by_item.select("doc_id", "digest", "k", "n", span.alias("span"), F.explode(start).alias("start")).distinct()
    windows = materialize(windows, "leak-windows")
    # the shingles of the windows, from the texts that have any
    texts = windows.groupBy(F.col("doc_id").alias("id_"), F.col("digest").alias("digest_")).agg(F.collect_set(F.struct("k", "n", "span", "start")).alias("ws"))
    texts = materialize(texts, "leak-texts")
    back = hashed.join(small(texts), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_")))
    shingled = None
    for k in ks:
        part = back.select("doc_id", "digest", F.explode(F.filter("ws", lambda x: x["k"] == k)).alias("x"), _shingles(F.col("w"), k).alias("hs"))
        part = part.select("doc_id", "digest", "x.k", "x.n", "x.start", F.slice("hs", F.col("x.start") + 1, F.col("x.span")).alias("hs")).distinct()
        shingled = part if shingled is None else shingled.unionByName(part)
    window = ["doc_id", "digest", "k", "n", "start"]
    shingled = materialize(shingled, "leak-shingles")
    one = shingled.select(*window, F.explode("hs").alias("h"))
    codes = materialize(simhash(one, window), "leak-codes")
    item_codes = simhash(items.select("item", "n", "k", F.explode("hs").alias("h")), ["item", "n", "k"])
    # every item under each block and every pattern within its share of the radius
    variants = F.array(*map(F.lit, _variants(min(radius // BLOCKS, BLOCK_BITS))))
    blocks = lambda: F.posexplode(F.array(*(_block(F.col("code"), b) for b in range(BLOCKS)))).alias("b", "v")
    filed = item_codes.select("item", "n", "k", F.col("code").alias("item_code"), blocks())
    filed = filed.select("item", "n", "k", "item_code", "b", F.explode(F.transform(variants, lambda x: F.col("v").bitwiseXOR(x))).alias("v"))
    filed = materialize(filed, "leak-index")
    met = codes.select(*window, "code", blocks()).join(small(filed), ["n", "k", "b", "v"])
    near = met.filter(F.bit_count(F.col("code").bitwiseXOR(F.col("item_code"))) <= radius).select(*window, "item").distinct()
    near = materialize(near, "leak-near")
    # exact weighted similarity
    weights = items.select("item", "m", F.explode("hs").alias("h")).groupBy("item", "m", "h").agg(F.count("*").alias("c"))
    mine = one.join(small(near.select(*(F.col(c).alias(f"{c}_") for c in window), "item")),
                    F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("digest") == F.col("digest_")) & (F.col("k") == F.col("k_"))
                    & (F.col("n") == F.col("n_")) & (F.col("start") == F.col("start_")))
    mine = mine.groupBy(*window, "item", "h").agg(F.count("*").alias("d"))
    sizes = shingled.select(*window, F.size("hs").alias("m2"))
    both = mine.join(weights, ["item", "h"]).groupBy(*window, "item", "m").agg(F.sum(F.least("c", "d")).alias("shared"))
    exact = both.join(sizes.select(*(F.col(c).alias(f"{c}_") for c in window), "m2"),
                      F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("digest") == F.col("digest_")) & (F.col("k") == F.col("k_"))
                      & (F.col("n") == F.col("n_")) & (F.col("start") == F.col("start_")))
    exact = exact.withColumn("similarity", F.col("shared") / (F.col("m") + F.col("m2") - F.col("shared"))).filter(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (F.col("m2") + F.col("k") - 1).alias("n_words"))).alias("best")
    # the ids of the texts come back last
    found = materialize(exact.groupBy("doc_id", "digest", "item").agg(best), "leak-best")
    ids = materialize(named.select("item", "item_id").distinct(), "leak-ids")
    return found.join(small(ids), "item").groupBy("doc_id", "digest", "item_id").agg(F.max("best").alias("best")).select(
        "doc_id", "digest", "item_id", (-F.col("best.s")).alias("start_word"), "best.n_words", "best.similarity")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """``docs`` without the rows that leak a benchmark item."""
    other_id, other_digest = fresh(docs, "id_"), fresh(docs, "digest_")
    found = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias(other_id), F.col("digest").alias(other_digest)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.xxhash64(whole_text("text")) == F.col(other_digest))
    return docs.join(small(materialize(found, "leaks")), same, "left_anti")
