"""Collocations, spelling variants and near-duplicate vectors against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL
from vecshift.llm import collocations, spelling, vectors
from vecshift.llm.queries import QUERIES


def small_letters(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- collocations
def brute_collocations(rows, most=3, least=10, limit=2000, percent=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", small_letters(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        rank = []
        for p, a in found.items():
            if not inside[p] or 100 * inside[p] < percent * a:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rank)[:limit], 1)]
    return sorted(out)


def prose(seed, n):
    draw = random.Random(seed)
    vocabulary = ["of", "the", "New", "YORK", "city", "é", "Äpfel", "x" * 80] + [f"w{i}" for i in range(30)]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "   "]
    out = []
    for _ in range(n):
        words = draw.choices(vocabulary, weights=[30, 30, 9, 9, 9, 5, 5, 4] + [2] * 30, k=draw.randrange(0, 40))
        out.append((draw.choice(["en", "en", "de", None, "und"]), "".join(w + draw.choice(marks) for w in words)))
    return out + [("en", None), ("en", ""), (None, " .\n")] + [("en", "New York city")] * 15


@pytest.mark.parametrize("most_words, least, most_ids", [(3, 10, collocations.HEAD), (3, 4, 0), (3, 4, 12), (4, 3, 60), (2, 2, 200)])
def test_collocations_are_those_of_brute_force(spark, most_words, least, most_ids):
    rows = prose(most_words, 300)
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "lang string, text string, phrase string").repartition(5)
    found = collocations.collocations(df, most_words=most_words, least=least, most_ids=most_ids, limit=25)
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, most_words, least, 25)


def test_collocations_of_one_very_long_text_and_of_none(spark):
    text = "one two, " * 40_000 + "z" * 300_000
    found = collocations.collocations(spark.createDataFrame([("en", text)], "lang string, text string")).collect()
    assert [tuple(x) for x in found] == [("en", 1, "one two", 40_000, 40_000, 40_000, 80_001, 1_000_000)]
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_counts_of_tiles_are_those_of_unique():
    draw = np.random.default_rng(1)
    side = 1 << collocations.SIDE_BITS
    codes = np.concatenate((draw.integers(0, side, 200_000) << collocations.HEAD_BITS | draw.integers(0, side, 200_000),
                            draw.integers(0, 1 << (2 * collocations.HEAD_BITS), 5_000), [(1 << (2 * collocations.HEAD_BITS)) - 1] * 3))
    code, n = collocations.count_tiles(codes)
    order = np.argsort(code)
    want, times = np.unique(codes, return_counts=True)
    assert (code[order] == want).all() and (n[order] == times).all()
    assert len(collocations.count_tiles(np.zeros(0, np.int64))[0]) == 0


def test_products_past_64_bits_stay_exact(spark):
    big = 7_000_000_000_003
    levels = [collocations.Level(None, spark.createDataFrame([("en", "a", big + 2), ("en", "b", big + 10)], "lang string, phrase string, f bigint"), {}, None)]
    found = collocations.scored(spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, f bigint"), levels).first()
    assert found["score"] == 1000000 * big * big // ((big + 2) * (big + 10))


def test_words_keep_their_pieces_over_slices():
    words, piece = collocations.tokenise(pa.array(["skipped", "Aé b.c", "", "D\te "])[1:])
    assert words.to_pylist() == ["aé", "b", "c", "d", "e"] and len(set(piece[:2])) == 1 and len(set(piece)) == 3 and piece[3] == piece[4]


def test_filter_holds_all_that_went_in(spark):
    phrases = [f"{a} x{a * b}" for a in range(60) for b in range(20)]
    bits = collocations.phrase_filter(spark.createDataFrame([(p,) for p in phrases], "phrase string").repartition(3), 2)
    words, _ = collocations.tokenise(pa.array(phrases))
    assert collocations.holds(bits, collocations.phrase_hashes(collocations.hashes(words), 2)[::2]).all()
    other, _ = collocations.tokenise(pa.array([f"y{i} z" for i in range(5_000)]))
    assert collocations.holds(bits, collocations.phrase_hashes(collocations.hashes(other), 2)[::2]).sum() < 50


# ---------------------------------------------------------------- spelling
def brute_counts(rows, length=6, least=5):
    seen = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = small_letters(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += len(run) >= length
    return {w: n for w, n in seen.items() if n >= least}


def edits(word, words):
    one = [x for x in words if x != word and abs(len(x) - len(word)) <= 1]
    out = set()
    for x in one:
        a, b = sorted((word, x), key=len)
        if len(a) == len(b):
            near = sum(p != q for p, q in zip(a, b)) == 1
        else:
            near = any(b[:i] + b[i + 1:] == a for i in range(len(b)))
        if near:
            out.add(x)
    return out


def brute_variants(counts):
    form, out = {}, {}
    near = {w: edits(w, counts) for w in counts}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return out


def collected(found):
    return {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in found.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_those_of_brute_force(spark, seed):
    draw = random.Random(seed)
    words = {"".join(draw.choices("abÿ", k=draw.randrange(6, 9))) for _ in range(150)}
    stem = "".join(draw.choices("ab", k=64))
    words |= {stem, stem + "a", stem[:30] + "ÿ" + stem[30:], "c" + stem, stem[1:], stem[:20] + "ÿ" + stem[21:], stem + "ab", stem + "abb", stem * 20, stem * 20 + "a", stem * 20 + "b",
              (stem * 20)[:500] + "c" + (stem * 20)[500:]}
    counts = {w: draw.choice([1, 1, 2, 6, 30, 150, 800]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    assert collected(spelling.spelling_variants(df)) == brute_variants(counts)


def test_words_of_texts_are_those_of_brute_force(spark):
    draw = random.Random(5)
    stock = ["Straße", "strasse", "Strassen", "ÉCOLES", "écoles", "letters", "lettters", "short", "x" * 3_000, "Ünited", "naïvely×"]
    rows = [(draw.choice([None, draw.randrange(10 ** 9)]), " 7".join(draw.choices(stock, k=draw.randrange(60)))) for _ in range(400)] + [(1, None), (2, ""), (2, "")]
    df = spark.createDataFrame([(a, b, 0, "w") for a, b in rows], "doc_id bigint, text string, n int, word string").repartition(4)
    assert collected(spelling.corpus_variants(df)) == brute_variants(brute_counts(rows))


def test_a_run_as_long_as_a_text_takes_no_square_of_it(spark):
    run = "ab" * 100_000
    df = spark.createDataFrame([(run, 7), (run + "c", 50), ("letter", 5)], "word string, n bigint")
    found = collected(spelling.spelling_variants(df))
    assert found[run] == (7, 1, run + "c", 50, run + "c") and found[run + "c"][1:3] == (1, None) and found["letter"] == (5, 0, None, None, "letter")
    assert collected(spelling.spelling_variants(df.limit(0))) == {}


# ---------------------------------------------------------------- vectors
def brute_links(rows, threshold=0.93):
    n, keep = len(rows), []
    for _, label, v in rows:
        fine = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        keep.append(np.array(v, np.float64) / max(map(abs, v)) if fine else None)
    near = [[j for j in range(n) if j != i and keep[i] is not None and keep[j] is not None and rows[i][1] == rows[j][1] and len(keep[i]) == len(keep[j])
             and keep[i] @ keep[j] / np.sqrt((keep[i] @ keep[i]) * (keep[j] @ keep[j])) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def some_vectors(seed, n, dim=6):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, dim))
    rows = []
    for i in range(n):
        v = centres[draw.integers(8)] + draw.normal(scale=draw.choice([0.02, 0.3]), size=dim)
        rows.append((int(draw.integers(10 ** 6)), int(draw.integers(3)), [float(x) for x in v * draw.choice([1e-200, 1, 1e200])]))
    copies = [(i + 1, rows[0][1], rows[0][2]) for i in range(20)]
    odd = [(5, 0, None), (6, 0, []), (7, 0, [0.0] * dim), (8, 1, [1.0, None] + [0.0] * (dim - 2)), (9, 1, [float("nan")] * dim), (10, 1, [float("inf")] * dim),
           (11, None, rows[0][2]), (12, None, rows[0][2]), (13, 2, rows[0][2][:3]), (None, rows[0][1], rows[0][2]), (None, None, None), (rows[0][0], rows[0][1], rows[0][2])]
    return rows + copies + odd


@pytest.mark.parametrize("options", [{}, {"tile_rows": 8}, {"tile_bytes": 2_000}])
def test_links_are_those_of_all_pairs(spark, options):
    rows = some_vectors(3, 300)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, label int, embedding array<double>, v int").repartition(4)
    found = vectors.near_vectors(df, **options)
    assert sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in found.collect()), key=str) == brute_links(rows)
    assert vectors.near_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("dim", [3, 64, 1200])
def test_no_pair_within_the_error_bound_is_left_out(dim):
    draw = np.random.default_rng(dim)
    x = vectors.unit_rows(draw.normal(size=(150, dim)))
    y = vectors.unit_rows(x[draw.integers(0, 150, 200)] + draw.normal(scale=0.39 / np.sqrt(dim), size=(200, dim)))
    (q, s, e), (p, t, d) = vectors.quantise(x), vectors.quantise(y)
    off = np.abs(x @ y.T - (q.astype(float) @ p.astype(float).T) * s[:, None] * t)
    assert (off <= e[:, None] * (1 + d) + d + vectors.ROUNDING).all()
    i, j = vectors.tile_links(x, y, (q, s, e), (p, t, d), 0.93)
    assert set(zip(i, j)) == set(zip(*np.nonzero(np.einsum("ik,jk->ij", x, y) >= 0.93))) and len(i)


@pytest.mark.parametrize("name", ["op11_collocations", "op12_spelling_variants", "op13_embedding_dedup"])
def test_queries_run_over_their_tables(spark, name):
    found = QUERIES[name](spark, SF_SMALL)
    assert found.count() and len(found.columns) == {"op11": 8, "op12": 6, "op13": 4}[name.split("_")[0]]
