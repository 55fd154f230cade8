"""Spelling variants of the words of a corpus, by sorted permuterm rotations.

A word ``w`` is marked at its end and turned: its rotations ``w[j:] + $ + w[:j]`` bring every place of the word to the
end of a string. What a rotation is without its last character is the word without that character, turned so that the
gap is at the end. In the sorted rotations, words that differ by replacing the character in one place therefore stand
together under one such prefix, and so does the word that lacks this character, whose own full rotation the prefix
is. A scan of the groups of equal prefixes sees all near words: those in a group are near one another, whatever
their number, so a group gives each member the count and the best of the others, not the pairs. A group has at most one
word for each character of the alphabet and one that lacks it.

Two different places of two words of one length never agree, so a replacement is seen in one group. A character can be
dropped anywhere in a run of equal ones; only the first place of a run counts.

A word's rotations take the square of its length. Prefixes of more than ``TURNED`` characters are written as the
lengths and rolling hashes (93 bits) of the parts before and after the gap instead, which takes its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import whole_text

RUN = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "$"
TURNED = 65
#: Role of a word in a group: it lacks the character; has it, first of its run; has it, not first.
LACKS, FIRST, LATER = 0, 1, 2
PRIME = (1 << 31) - 1
BASES = (1_000_003, 179_424_673, 1_299_709_651)


def one_in(key: Column, run: Column, every: int) -> Column:
    """``run``, without one code point if ``every`` divides the CRC-32 ``h`` of ``key:run``: the one in place ``h % length``."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5,
                drop_one_in: int | None = 199) -> DataFrame:
    """``word, n``: the letter runs of all texts in small letters (A-Z only), from a length and a count on."""
    runs = F.split(F.translate(whole_text(F.col(f"`{text_col}`")), UPPER, LOWER), f"[^{RUN}]+")
    each = docs.select(F.col(f"`{id_col}`").alias("key"), F.explode(F.filter(runs, lambda r: F.length(r) >= least_length)).alias("run"))
    word = F.col("run") if drop_one_in is None else one_in(F.col("key"), F.col("run"), drop_one_in)
    counted = each.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** n`` modulo PRIME."""
    out, step = np.ones(1, np.uint64), base
    while len(out) <= n:
        out = np.concatenate((out, out * np.uint64(step) % np.uint64(PRIME)))
        step = step * step % PRIME
    return out[:n + 1]


def hashed_gaps(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``word[:j]``, ``word[j:]`` and of ``word[j + 1:]`` (each in a row a base)."""
    code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    p, n = np.uint64(PRIME), len(word)
    before, after = [], []
    for base in BASES:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * powers(base, n)[:n] % p) % p))
        before.append(sums)
        after.append((sums[-1] + p - sums) % p * powers(pow(base, -1, PRIME), n) % p)
    before, after = np.stack(before), np.stack(after)
    return before, after, after[:, 1:]


def rotations(word: str) -> tuple[list[str], list[int]]:
    """The prefixes that ``word`` stands under, and its role in each."""
    n = len(word)
    first = [FIRST if not i or word[i - 1] != word[i] else LATER for i in range(n)]
    turned = word + MARK + word
    whole = [turned[j:j + n + 1] for j in range(n + 1)] if n < TURNED else None
    short = [turned[i + 1:i + 1 + n] for i in range(n)] if n <= TURNED else None
    if whole is None:
        before, after, beyond = hashed_gaps(word)
        whole = [f"{n + 1}{MARK}{j}{MARK}" + ".".join(map(str, k)) for j, k in enumerate(np.concatenate((before, after)).T.tolist())]
        if short is None:
            short = [f"{n}{MARK}{i}{MARK}" + ".".join(map(str, k)) for i, k in enumerate(np.concatenate((before[:, :-1], beyond)).T.tolist())]
    return whole + short, [LACKS] * (n + 1) + first


def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``prefix, role, id, n`` of words; of a long word a piece at a time."""
    held: list[tuple[list, list, int, int]] = []
    size = 0

    def rows() -> pd.DataFrame:
        reps = [len(h[0]) for h in held]
        return pd.DataFrame({"prefix": [k for h in held for k in h[0]], "role": np.array([r for h in held for r in h[1]], np.int8),
                             "id": np.repeat(np.array([h[2] for h in held], np.int64), reps),
                             "n": np.repeat(np.array([h[3] for h in held], np.int64), reps)})

    for batch in batches:
        for word, id_, n in zip(batch["word"], batch["id"], batch["n"]):
            prefixes, roles = rotations(word)
            held.append((prefixes, roles, id_, n))
            size += len(prefixes)
            if size >= 1 << 16:
                yield rows()
                held, size = [], 0
    if held:
        yield rows()


def scan_groups(prefix: np.ndarray, role: np.ndarray, id_: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """``id, near, best_n, best`` a member of each group of several, of rows sorted by prefix, then by n from the largest, then by id."""
    start = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
    size = np.diff(np.append(start, len(prefix)))
    lacks, first = role == LACKS, role == FIRST
    n_lacks, n_first = (np.repeat(np.add.reduceat(x.astype(np.int64), start), size) for x in (lacks, first))
    head, size = np.repeat(start, size), np.repeat(size, size)
    near = np.where(lacks, n_first, size - n_lacks - 1 + n_lacks * first)
    several = size > 1
    best = np.where(np.arange(len(prefix)) == head, head + 1, head)[several]  # the best of the others
    return pd.DataFrame({"id": id_[several], "near": near[several], "best_n": n[best], "best": id_[best]})


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        if not len(rows):
            continue
        prefix = rows["prefix"].to_numpy(object)
        cut = int(np.argmax(prefix == prefix[-1]))  # the last group may go on
        held = rows.iloc[cut:]
        if cut:
            yield scan_groups(prefix[:cut], *(rows[c].to_numpy()[:cut] for c in ("role", "id", "n")))
    if held is not None:
        yield scan_groups(held["prefix"].to_numpy(object), *(held[c].to_numpy() for c in ("role", "id", "n")))


def near_words(words: DataFrame) -> DataFrame:
    """``id, n_near, best_n, best`` for each of the distinct words ``id, word, n`` that has a near word.

    The best near word is that of the largest ``n``; of several of them that of the smallest ``id``.
    """
    turned = words.mapInPandas(turn, "prefix string, role byte, id bigint, n bigint")
    ranked = turned.repartition("prefix").sortWithinPartitions("prefix", F.desc("n"), "id")
    seen = ranked.mapInPandas(scan, "id bigint, near bigint, best_n bigint, best bigint")
    best = F.max(F.struct("best_n", (-F.col("best")).alias("best")))
    return seen.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("b")).select("id", "n_near", "b.best_n", (-F.col("b.best")).alias("best"))


def last_forms(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``id, root``: where the chain of ``id -> form`` ends, for each row of ``forms``; each round doubles the steps taken."""
    current = materialize(forms.select("id", F.col("form").alias("root"), F.lit(False).alias("done")), "spelling-roots0")
    for i in range(1, most_rounds + 1):
        ahead = current.select(F.col("id").alias("at"), F.col("root").alias("further"))
        step = current.join(ahead, F.col("root") == F.col("at"), "left")
        current = materialize(step.select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNull().alias("done")), f"spelling-roots{i}")
        if not current.filter(~F.col("done")).limit(1).count():
            return current.select("id", "root")
    raise RuntimeError(f"forms did not end in {most_rounds} rounds")


def spelling_variants(words: DataFrame, *, times: int = 5) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of ``words`` (``word, n``; distinct, without nulls).

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word of
    largest ``n`` (of equal ones the first in code-point order) if its ``n`` is at least ``times`` that of the word,
    else null; ``root`` the last of the forms followed from the word, the word itself if it has none. ``times`` is over
    1, so forms lead to larger counts and end. A table without words gives none.
    """
    if times <= 1:
        raise ValueError("times must be more than 1")
    words = materialize(words.select("word", "n"), "spelling-counts")
    # sorted, so the smaller id is the first in code-point order
    words = materialize(words.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    near = near_words(words).select(F.col("id").alias("near_id"), "n_near", "best_n", "best")
    own = words.select("id", "n").join(near, F.col("id") == F.col("near_id"), "left")
    form = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    own = materialize(own.select("id", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form")), "spelling-near")
    roots = last_forms(own.filter("form is not null").select("id", "form")).select(F.col("id").alias("root_of"), F.col("root").alias("root_id"))

    named = own.join(roots, F.col("id") == F.col("root_of"), "left").join(words, "id")
    form = words.select(F.col("id").alias("form_id"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    root = words.select(F.col("id").alias("last_id"), F.col("word").alias("root_word"))
    named = named.join(form, F.col("form") == F.col("form_id"), "left").join(root, F.col("root_id") == F.col("last_id"), "left")
    return named.select("word", "n", "n_near", F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))


def corpus_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5,
                    drop_one_in: int | None = 199, times: int = 5) -> DataFrame:
    """:func:`spelling_variants` of the words of all texts.

    Null and empty texts have no words, a null id counts as an empty one, rows that repeat an id or a text count
    each, very long texts and runs of letters are taken whole. Other columns are not read.
    """
    counts = word_counts(docs, id_col=id_col, text_col=text_col, least_length=least_length, least_count=least_count, drop_one_in=drop_one_in)
    return spelling_variants(counts, times=times)
