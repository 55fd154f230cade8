"""Phrase collocations by direct-address tiles of frequency-ranked ids.

The frequent words of a language get ids by falling frequency, at most ``HEAD`` of them over all languages. A pair of words
is then an address, ``first * HEAD + second``. Each task splits its addresses into tiles of ``SIDE`` times ``SIDE`` ids: the
tiles of frequent ids are dense and are counted with one bincount over the whole tile, in the others the addresses are
sorted and runs counted (coordinates). Spark adds up the tasks' counts, an address at a time, so no tile or pair
meets in one task. Frequent pairs are ranked in turn, and a phrase of three words is the address of its first pair's
rank and its last word; longer ones go on that way.

What the tables of ids do not hold is counted exactly by its text in the same job: phrases with a frequent word (or
beginning with a frequent phrase) outside the first ``HEAD``, or with a word of over ``LONGEST`` bytes. A phrase with a part that is not
frequent can't be frequent and is passed over: parts are looked up in the tables of ids and, for what is outside of them, in a Bloom
filter of fixed size, whose false hits cost a count and change nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Most ids of a length, over all languages, and the longest word that has one: what is sent to the tasks is at most HEAD * (LONGEST + 8) bytes.
HEAD_BITS, LONGEST = 18, 64
HEAD = 1 << HEAD_BITS
SIDE_BITS = 10
#: Addresses counted at a time, and the share of a tile's cells from which its addresses are dense.
BUFFER, DENSE = 1 << 18, 1 / 32
#: Bytes of text taken at a time, and rows.
TEXT_BYTES, TEXT_ROWS = 1 << 20, 256
#: Bits of a Bloom filter.
FILTER_BITS = 25
# the kinds of bytes: of words, blanks, ends of pieces
WORD, BLANK, END = 0, 1, 2
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = BLANK
KINDS[list(b".,;:!?\n\x0b\x0c\r")] = END
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def tokenise(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, A-Z in small letters, and the number of the piece that each is in."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    kind = KINDS[data]
    breaks = kind == END
    first = at[:-1][at[:-1] < at[-1]] - at[0]  # of each text
    letter = kind == WORD
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    starts[first] = letter[first]
    stops = letter.copy()
    stops[:-1] &= ~letter[1:]
    stops[first[1:] - 1] = letter[first[1:] - 1]
    breaks[first] = True
    starts = np.flatnonzero(starts)
    piece = np.searchsorted(np.flatnonzero(breaks), starts, side="right")
    offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(stops) + 1 - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(SMALL[data[letter]]))
    return words, piece


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit number for each word: a polynomial of its bytes, mixed."""
    at = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1]
    sums = np.ones(at[-1] + 1 if len(at) else 1, np.uint64)
    sums[1:] += np.frombuffer(words.buffers()[2] or b"", np.uint8)[:len(sums) - 1]
    up, down = powers(max(20, (len(sums) - 1).bit_length()))
    sums[1:] *= up[:len(sums) - 1]
    sums[0] = 0
    np.cumsum(sums, out=sums)
    return mix((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]])


@lru_cache(1)
def powers(bits: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, 2 ** bits of each."""
    base = 0x9E3779B97F4A7C15
    return [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full((1 << bits) - 1, b, np.uint64))), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64))]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter that stand for a number."""
    low = np.uint64((1 << FILTER_BITS) - 1)
    return (h & low).astype(np.int64), (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def phrase_hashes(one: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the phrases of ``size`` words, one begun at each word, from those of the words."""
    out = one
    for k in range(1, size):
        out = mix(out[:-1] * np.uint64(3) + one[k:])
    return out


def filter_bits(size: int):
    """Bits of the phrases of ``size`` words in ``phrase``, as rows ``slot, mask``."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, piece = tokenise(batch["phrase"])
            if len(words):
                begin = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))  # each phrase is a text of one piece
                bit = np.concatenate(places(phrase_hashes(hashes(words), size)[begin]))
                yield pa.record_batch({"slot": pa.array(bit >> 6), "mask": pa.array((np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))})

    return bits


def phrase_filter(phrases: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of ``phrases``, 64 bits a number; the driver gets at most 2 ** FILTER_BITS bits."""
    found = phrases.select("phrase").mapInArrow(filter_bits(size), "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    found = found.toPandas()
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bits[found["slot"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    return bits


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for bit in places(h):
        out &= (bits[bit >> 6] >> (bit & 63) & 1).astype(bool)
    return out


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language at a time, some megabytes of them together."""
    def slices(parts: list[pa.Array]) -> Iterator[pa.Array]:
        texts = pa.concat_arrays(parts)
        upto = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            done = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, done + TEXT_BYTES, side="right")))
            yield texts[at:stop]
            at = stop

    held, size = defaultdict(list), 0
    for batch in batches:
        for part in (batch.slice(at, TEXT_ROWS) for at in range(0, len(batch), TEXT_ROWS)):
            coded = pc.dictionary_encode(part["lang"])
            code = coded.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(coded.dictionary.to_pylist()):
                held[lang].append(part["text"].take(pa.array(np.flatnonzero(code == i))).cast(pa.large_string()))
                size += held[lang][-1].nbytes
            if size >= TEXT_BYTES:
                for lang, parts in held.items():
                    yield from ((lang, t) for t in slices(parts))
                held, size = defaultdict(list), 0
    for lang, parts in held.items():
        yield from ((lang, t) for t in slices(parts))


def count_tiles(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct addresses and how often each occurs."""
    rows, cols = codes >> HEAD_BITS, codes & (HEAD - 1)
    tile = ((rows >> SIDE_BITS) << (HEAD_BITS - SIDE_BITS) | cols >> SIDE_BITS).astype(np.uint16)
    order = np.argsort(tile, kind="stable")
    codes, size = codes[order], np.bincount(tile)
    stop = np.cumsum(size)
    side, cells = (1 << SIDE_BITS) - 1, 1 << (2 * SIDE_BITS)
    dense = size >= DENSE * cells
    found, counts = [], []
    for t in np.flatnonzero(dense):
        part = codes[stop[t] - size[t]:stop[t]]
        n = np.bincount((part >> HEAD_BITS & side) << SIDE_BITS | part & side, minlength=cells)
        cell = np.flatnonzero(n)
        base = (int(t) >> (HEAD_BITS - SIDE_BITS)) << (HEAD_BITS + SIDE_BITS) | (int(t) & ((1 << (HEAD_BITS - SIDE_BITS)) - 1)) << SIDE_BITS
        found.append(base + ((cell >> SIDE_BITS) << HEAD_BITS) + (cell & side))
        counts.append(n[cell])
    rest = np.sort(codes[~np.repeat(dense, size)])
    if len(rest):
        cut = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1])))
        found.append(rest[cut])
        counts.append(np.diff(np.append(cut, len(rest))))
    return (np.concatenate(found), np.concatenate(counts)) if found else (rest, np.zeros(0, np.int64))


@dataclass
class Level:
    """Frequent phrases of one length: ``counts`` (lang, phrase, f) all of them, ``head`` those with a rank."""

    counts: DataFrame
    head: DataFrame
    #: Of each language: words in order of rank, or addresses in order and their ranks.
    table: dict
    #: A filter of the frequent phrases without a rank; None if there is none.
    others: np.ndarray | None


def rows_of(lang: str, codes: np.ndarray | None, phrases: pa.Array | None, n: np.ndarray) -> pa.RecordBatch:
    size = len(n)
    return pa.record_batch({
        "lang": pa.array([lang] * size, pa.string()) if size < 2 else pa.DictionaryArray.from_arrays(np.zeros(size, np.int32), [lang]).cast(pa.string()),
        "code": pa.nulls(size, pa.int64()) if codes is None else pa.array(codes, pa.int64()),
        "phrase": pa.nulls(size, pa.string()) if phrases is None else phrases.cast(pa.string()),
        "n": pa.array(n, pa.int64())})


SCHEMA = "lang string, code bigint, phrase string, n bigint"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words; the row without a phrase counts all words of a language."""
    for lang, texts in by_language(batches):
        words, _ = tokenise(texts)
        if len(words):
            seen = pc.value_counts(words)
            yield rows_of(lang, None, pa.concat_arrays([seen.field("values"), pa.nulls(1, pa.large_string())]),
                          np.append(seen.field("counts").to_numpy(), len(words)))


def addresses(words: pa.Array, piece: np.ndarray, known: list[tuple], lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Addresses of the phrases one longer than the last of ``known``; where phrases begin that must be counted by text."""
    vocabulary = known[0][0].get(lang)
    if vocabulary is None:
        ids = np.full(len(words), -1, np.int64)
    else:
        ids = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy().astype(np.int64)
    one = hashes(words) if any(others is not None for _, others in known) else None
    rank = ids
    for k, (table, _) in enumerate(known[1:], 2):
        whole = (rank[:-1] >= 0) & (ids[k - 1:] >= 0) & (piece[:len(piece) - k + 1] == piece[k - 1:])
        code = np.where(whole, rank[:-1] << HEAD_BITS | ids[k - 1:], -1)
        codes, ranks = table.get(lang, (np.zeros(1, np.int64), np.full(1, -1)))
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        rank = np.where(whole & (codes[at] == code), ranks[at], -1)
    frequent = rank >= 0
    if known[-1][1] is not None:
        frequent |= holds(known[-1][1], phrase_hashes(one, len(known)))
    size = len(known) + 1
    able = frequent[:-1] & frequent[1:] & (piece[:len(piece) - size + 1] == piece[size - 1:])
    begin, end = rank[:-1], ids[size - 1:]
    coded = able & (begin >= 0) & (end >= 0)
    return begin[coded] << HEAD_BITS | end[coded], np.flatnonzero(able & ~coded)


def count_phrases(sent: list):
    """A task's counts of the phrases one longer than the last of ``sent``: a broadcast of tables and filter for each length."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [t.value for t in sent]
        held, size = defaultdict(list), 0
        for lang, texts in by_language(batches):
            words, piece = tokenise(texts)
            if len(words) <= len(known):
                continue
            codes, rest = addresses(words, piece, known, lang)
            if len(rest):
                parts = [words.take(pa.array(rest + k)) for k in range(len(known) + 1)]
                seen = pc.value_counts(pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())))
                yield rows_of(lang, None, seen.field("values"), seen.field("counts").to_numpy())
            held[lang].append(codes)
            size += len(codes)
            if size >= BUFFER:
                for of, parts in held.items():
                    found, n = count_tiles(np.concatenate(parts))
                    yield rows_of(of, found, None, n)
                held, size = defaultdict(list), 0
        for of, parts in held.items():
            found, n = count_tiles(np.concatenate(parts))
            yield rows_of(of, found, None, n)

    return count


def most_frequent(counts: DataFrame, name: str, fit: Column, most_ids: int, size: int) -> tuple[DataFrame, np.ndarray | None]:
    """Up to ``most_ids`` of the rows that ``fit``, from a frequency on, with their ``rank`` in their language; a filter of the other rows."""
    level = F.floor(F.log2("f") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.count_if(fit).alias("fit")).collect()  # 8 for each doubling at most
    n, least = 0, None
    for r in sorted(levels, key=lambda r: -r["level"]):
        n += r["fit"]
        if n > most_ids:
            break
        least = r["level"]
    within = fit & (level >= (least if least is not None else 1 << 30))
    chosen = counts.filter(within)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("f"), "phrase")) - 1
    head = materialize(chosen.withColumn("rank", rank.cast("long")), name)
    if n <= most_ids and n == sum(r["n"] for r in levels):
        return head, None
    return head, phrase_filter(counts.filter(~within), size)


def text_rows(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def phrase_levels(texts: DataFrame, most_words: int, least: int, most_ids: int) -> tuple[list[Level], DataFrame, list[DataFrame]]:
    """Frequent phrases of ``lang, text`` by length, but for the longest, which come as a table alone; ``lang, n`` between them."""
    sc = texts.sparkSession.sparkContext
    counted = texts.mapInArrow(count_words, SCHEMA).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    counted = materialize(counted.filter(F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    totals = counted.filter("phrase is null").select("lang", F.col("f").alias("n"))
    words = counted.filter("phrase is not null")
    head, others = most_frequent(words, "words-head", F.octet_length("phrase") <= LONGEST, most_ids, 1)
    rows = head.select("lang", "rank", "phrase").toPandas().sort_values(["lang", "rank"])
    table = {lang: pa.array(part["phrase"], pa.large_string()) for lang, part in rows.groupby("lang")}
    levels, sent, found = [Level(words, head, table, others)], [], []
    try:
        for size in range(2, most_words + 1):
            sent.append(sc.broadcast((levels[-1].table, levels[-1].others)))
            counted = texts.mapInArrow(count_phrases(list(sent)), SCHEMA)
            counted = counted.groupBy("lang", "code", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
            counted = materialize(counted, f"phrases{size}")
            begin = levels[-1].head.select(F.col("lang").alias("l1"), F.col("rank").alias("r1"), F.col("phrase").alias("p1"))
            end = levels[0].head.select(F.col("lang").alias("l2"), F.col("rank").alias("r2"), F.col("phrase").alias("p2"))
            coded = counted.filter("code is not null").drop("phrase")
            coded = coded.join(F.broadcast(begin), (F.col("lang") == F.col("l1")) & (F.shiftright("code", HEAD_BITS) == F.col("r1")))
            coded = coded.join(F.broadcast(end), (F.col("lang") == F.col("l2")) & (F.col("code").bitwiseAND(F.lit(HEAD - 1)) == F.col("r2")))
            named = coded.select("lang", "code", F.concat_ws(" ", "p1", "p2").alias("phrase"), "f")
            phrases = materialize(named.unionByName(counted.filter("code is null")), f"phrases{size}-named")
            found.append(phrases.drop("code"))
            if size < most_words:
                head, others = most_frequent(phrases, f"phrases{size}-head", F.col("code").isNotNull(), most_ids, size)
                rows = head.select("lang", "code", "rank").toPandas().sort_values(["lang", "code"])
                table = {lang: (part["code"].to_numpy(np.int64), part["rank"].to_numpy(np.int64)) for lang, part in rows.groupby("lang")}
                levels.append(Level(phrases, head, table, others))
    finally:
        for b in sent:
            b.unpersist()
    return levels, totals, found


def scored(phrases: DataFrame, levels: list[Level]) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of candidates ``lang, phrase, f``: those of the cut of the lowest score."""
    words = F.split("phrase", " ", -1)
    size = F.size(words)
    cut = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    cut = cut.select("*", side)
    part = F.when(F.col("side") == 0, F.slice(words, F.lit(1), F.col("k"))).otherwise(F.slice(words, F.col("k") + 1, size))
    cut = cut.withColumn("part", F.array_join(part, " "))
    head, *others = [x.head.select(F.col("lang").alias("of"), F.col("phrase").alias("is"), F.col("f").alias("known")) for x in levels]
    for h in others:
        head = head.unionByName(h)
    same = (F.col("lang") == F.col("of")) & (F.col("part") == F.col("is"))
    seen = cut.join(F.broadcast(head), same, "left").drop("of", "is")  # at most HEAD rows a level
    if any(x.others is not None for x in levels):
        seen = materialize(seen, "phrase-parts")
        every = levels[0].counts.select("lang", "phrase", "f")
        for x in levels[1:]:
            every = every.unionByName(x.counts.select("lang", "phrase", "f"))
        # parts outside the tables are seldom: no hot keys
        every = every.select(F.col("lang").alias("of"), F.col("phrase").alias("is"), F.col("f").alias("known"))
        rest = seen.filter("known is null").drop("known").join(every, same).drop("of", "is")
        seen = seen.filter("known is not null").unionByName(rest)
    wide = seen.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("known"))).alias("l"),
                                                        F.max(F.when(F.col("side") == 1, F.col("known"))).alias("r"))
    # counts of up to 15 digits: their products stay exact in 38
    big = "cast({} as decimal(15, 0))"
    score = F.expr(f"cast(({big.format('a')} * {big.format('a')} * cast(1000000 as decimal(7, 0))) div ({big.format('l')} * {big.format('r')}) as bigint)")
    best = wide.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def not_inside(candidates: DataFrame, most_words: int, percent: int) -> DataFrame:
    """``candidates`` without those inside a longer one (dropped or not) that occurs at least ``percent`` % as often."""
    words = F.split("phrase", " ", -1)
    size = F.size(words)
    inside = None
    for k in range(2, most_words):
        longer = candidates.filter(size > k).select("lang", "a", F.explode(F.sequence(F.lit(1), size - k + 1)).alias("at"), words.alias("w"))
        parts = longer.select(F.col("lang").alias("of"), F.array_join(F.slice("w", F.col("at"), k), " ").alias("part"), "a")
        inside = parts if inside is None else inside.unionByName(parts)
    if inside is None:
        return candidates
    most = inside.groupBy("of", "part").agg(F.max("a").alias("most"))
    kept = candidates.join(most, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left")
    return kept.filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("of", "part", "most")


def first_of_each(phrases: DataFrame, limit: int, parts: int = 64) -> DataFrame:
    """The first ``limit`` phrases of each language with their ``rank``; a language's phrases go through ``parts`` tasks first."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    once = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    again = once.filter(F.col("rank") <= limit).drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return again.filter(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))


def collocations(docs: DataFrame, *, most_words: int = 3, least: int = 10, percent: int = 50, limit: int | None = 2000,
                 most_ids: int = HEAD, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the strongest phrases of each language, ``limit`` at most (all if None).

    Candidates are phrases of 2 to ``most_words`` words inside pieces (texts are cut at ``.,;:!?`` and line ends) that occur
    ``a >= least`` times; ``score`` is the lowest ``floor(1000000 a a / (l r))`` of their cuts into two phrases that occur ``l`` and ``r``
    times. Candidates inside a longer one that occurs at least ``percent`` % as often are left out. ``n`` counts the words of a
    language. Ranks go by score, then ``a`` (both falling), then phrase. ``most_ids`` (HEAD at most) bounds the tables of ids, not the result.

    Null and empty texts have no words, a null language is ``und``, rows that repeat count each, very long texts are taken
    whole; other columns are not read. A language without candidates, and an empty table, give no rows.
    """
    if not 0 <= most_ids <= HEAD or most_words < 2:
        raise ValueError(f"most_ids must be 0 to {HEAD}, most_words at least 2")
    levels, totals, found = phrase_levels(text_rows(docs, lang_col, text_col), most_words, least, most_ids)
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    kept = materialize(not_inside(scored(phrases, levels), most_words, percent), "collocations")
    if limit is None:
        ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    else:
        ranked = first_of_each(kept, limit)
    of = totals.select(F.col("lang").alias("of"), "n")
    return ranked.join(of, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
