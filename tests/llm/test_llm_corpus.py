"""Near-duplicates, leaks, personal data, mixture, repeats and the pipeline against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from vecshift.llm import components, decontaminate, mixing, pii, simhash, suffix
from vecshift.llm.queries import QUERIES


# ---------------------------------------------------------------- simhash
def brute_code(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 3 else [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes):
    root = {i: i for i in codes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(codes)
    for a in ids:
        for b in ids:
            if a < b and (codes[a] ^ codes[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_gray_rank_orders_neighbours_one_bit_apart():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


@pytest.mark.parametrize("n_centres, spread", [(6, 3), (1, 6), (40, 1)])
def test_forest_joins_what_all_pairs_join(n_centres, spread):
    draw = np.random.default_rng(n_centres)
    codes = {int(c) for c in draw.integers(0, 2 ** 63, n_centres)}
    for c in list(codes):
        codes |= {c ^ sum(1 << int(b) for b in set(draw.integers(0, 64, spread))) for _ in range(700 // n_centres)}
    a, b = simhash.forest(np.array(sorted(codes), np.uint64), 3)
    root = brute_components({c: c for c in codes})
    assert len(codes) - len(a) == len(set(root.values())) and all(root[int(x)] == root[int(y)] for x, y in zip(a, b))


def test_near_duplicates_match_brute_force_also_in_chunks(spark):
    draw = random.Random(4)
    base = [[f"w{draw.randrange(500)}" for _ in range(200)] for _ in range(4)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "One TWO"), (1004, "one two"), (1005, "x" * 50000)]
    for i in range(150):
        w = list(draw.choice(base))
        for _ in range(draw.randrange(3)):
            w[draw.randrange(200)] = "zz"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    codes = {i: brute_code(t) for i, t in rows}
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == codes
    root = brute_components(codes)
    assert {i: r.component_id for i, r in got.items()} == root
    signed = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in set(codes.values())], "code long")
    whole, chunked = (components.connected_components(simhash.links(signed, 3, n)).orderBy("node").collect() for n in (2048, 2))
    assert whole == chunked
    assert {r.doc_id for r in simhash.keep_one_row(df).collect()} == set(root.values())


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "e f g h"), (None, "i j k l")], "doc_id long, text string").withColumn("id_", F.lit(1))
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == {(1, 1): 2, (None, 1): 1, (2, 2): 1, (None, None): 1}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one_row(df.limit(0)).count() == 0


def test_one_row_of_every_group_stays_whatever_its_id(spark):
    a, b, c, d = "a b c d", "e f g h", "i j k l", "m n o p"
    rows = [(1, a, 0), (1, a, 1), (None, a, 0), (2, b, 0), (None, c, 0), (None, d, 0), (None, d, 0),  # null ids: c and one d stay
            (3, "q r s t", 0), (3, "u v w x", 0), (4, "q r s t", 0)]  # an id of two unrelated texts; 4 repeats one of them
    df = spark.createDataFrame(rows, "doc_id long, text string, id_ int")
    want = Counter([(1, a), (2, b), (None, c), (None, d), (3, "q r s t"), (3, "u v w x")])
    for n in (1, 5):
        got = simhash.keep_one_row(df.repartition(n)).collect()
        assert Counter((r.doc_id, r.text) for r in got) == want
        staged = corpus_pipeline.near_duplicates(spark, df.repartition(n), SF_SMALL)
        assert staged.columns == df.columns and sorted(staged.collect(), key=str) == sorted(got, key=str)
    # an id of two unrelated texts, one near a smaller id: only that row goes
    df = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert {tuple(r) for r in simhash.keep_one_row(df).collect()} == {(1, a), (2, b)}
    # several texts of the least id in one group
    near = [" ".join(["w%d" % i for i in range(300)] + [x]) for x in ("y", "z")]
    df = spark.createDataFrame([(7, near[0]), (7, near[1]), (8, near[1])], "doc_id long, text string")
    if len(set(brute_components({i: brute_code(t) for i, t in enumerate(near)}).values())) == 1:
        got = [[tuple(r) for r in simhash.keep_one_row(df.repartition(n)).collect()] for n in (1, 3)]
        assert got[0] == got[1] and len(got[0]) == 1 and got[0][0][0] == 7
    assert simhash.keep_one_row(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    random.Random(0).shuffle(path)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{i: 1000 for i in range(1001, 1200)}}


# ---------------------------------------------------------------- leaks
def shingles(words):
    k = min(5, len(words))
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)), k


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            if not (x or "").split():
                continue
            item, k = shingles(x.lower().split())
            n = min(len(x.split()), len(w))
            for s in range(len(w) - n + 1) if n >= k else ():
                mine = Counter(tuple(w[j:j + k]) for j in range(s, s + n - k + 1))
                shared = sum((item & mine).values())
                j = shared / (sum(item.values()) + sum(mine.values()) - shared)
                if j >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), j)
    return out


def test_leaks_match_brute_force(spark):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([1, 3, 5, 9, 30, 50])))) for i in range(25)] + [(90, None), (91, ""), (92, "only two")]
    docs = [(900, None), (901, ""), (902, "only TWO"), (902, "only TWO"), (None, items[5][1])]
    for d in range(150):
        w = draw.choice(items[:25])[1].split()
        for _ in range(draw.choice([0, 0, 1, 1, 2])):
            j = draw.randrange(len(w))
            w[j:j + draw.randrange(2)] = ["zz"] * draw.randrange(2)
            w = w or ["q"]
        pad = lambda: [draw.choice(words) for _ in range(draw.choice([0, 0, 3, 40]))]
        docs.append((d, " ".join(pad() + w + pad())))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(df, bench).collect()}
    want = brute_leaks(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    left = decontaminate.remove_leaks(df.withColumn("id_", F.lit(0)), bench)
    gone = {d for d, _ in want}
    assert left.count() == sum(d not in gone for d, _ in docs)
    assert decontaminate.find_leaks(df, bench.filter("item_id in (90, 91)")).count() == 0
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_every_text_of_an_item_is_searched_for_whatever_its_id(spark):
    draw = random.Random(2)
    text = lambda n: " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    items = [(None, text(30)), (None, text(30)), (None, text(3))] + [(1, text(40)) for _ in range(6)] + [(2, text(12)), (3, None)]
    items += [(4, items[-2][1]), (None, items[-2][1])]  # a text of three ids
    docs = [(d, f"{text(20)} {t or ''} {text(20)}") for d, (_, t) in enumerate(items)] + [(50, text(60)), (None, items[0][1])]
    docs.append((51, f"{items[3][1]} {text(5)} {items[8][1]}"))  # two texts of an id in one document
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    want = brute_leaks(docs, items)
    assert len(found) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {r.doc_id for r in decontaminate.remove_leaks(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert [(r.start_word, r.n_words) for r in found if r.doc_id == 51] == [(0, 40)]


def test_blocks_meet_every_code_within_the_radius():
    draw = random.Random(0)
    patterns = set(decontaminate._variants(20 // decontaminate.BLOCKS))
    for _ in range(500):
        x = sum(1 << b for b in draw.sample(range(64), 20))
        assert any((x >> 8 * b & 255) in patterns for b in range(8))


# ---------------------------------------------------------------- personal data
FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in value.split(".")), "phone": 9 <= len(digits) <= 15,
            "card": 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0}[kind]


def brute_spans(text):
    found = [(m.start(), r, m.end(), k) for r, (k, p) in enumerate(FORMS.items()) for m in re.finditer(p, text or "") if holds(k, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_base_entities_match_their_forms(spark):
    draw = random.Random(5)
    texts = ["mail a@b.co%x@d.e.f a.b@c", "1.2.3.4.5.6.7.8 256.1.1.1 00.01.002.255 é 4539 1488 0343 6467 +1 (437) 555-0689.", None, "",
             "9" * 40000 + " " + "a" * 40000 + "@", "+1234567890", "4111-1111-1111-1111-", "é@ü.de x@y.z-", "++12 34567890..", "1 " * 3000]
    texts += ["".join(draw.choice("0123456789.+-@ a(") for _ in range(80)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x@y.zz"), (5, "+1234567890")], "doc_id long, text string").withColumn("hash_", F.lit(1))
    for r in pii.find_personal_data(df).withColumn("found", pii.spans_text(F.col("base"))).collect():
        want = brute_spans(r.text) if not (r.text and len(r.text) == 80001) else ""
        assert r.found == want, r.text
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_patterns_of_known_entities_find_unseen_ones(spark):
    known = [f"+1 (555) 555-{n:04d}" for n in range(100, 120)]
    rows = [(i, f"Text {i} of mine. Please call my number {k} today or write.") for i, k in enumerate(known)]
    rows += [(100, "Others said call my number 555-0199-77 today or not."), (101, "The version 5 of call it number seven 555-0199-77 has come.")]
    rows += [(200 + i, f"We sold {i} units of it in {1990 + i} and more.") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (len(r.base), len(r.spans)) for r in pii.find_personal_data(df, least=0.5).collect()}
    assert all(got[i] == (1, 1) for i in range(20)) and all(got[200 + i] == (0, 0) for i in range(20)) and got[101] == (0, 0)
    # the words of known addresses around a form that no rule knows
    mails = [f"user{i}@host{i}.org" for i in range(12)]
    rows = [(50 + i, f"you can write to me at {m} any day") for i, m in enumerate(mails)] + [(99, "you can write to me at user7@localhost any day")]
    got = {r.doc_id: [(s.kind, r.text[s.start:s.end]) for s in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == [("email", "user7@localhost")]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.co, +1 (437) 555-0689; 4111 1111 1111 1111"), (2, None), (3, "none")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(pii.find_personal_data(df)).collect()}
    assert got == {1: "é [EMAIL], [PHONE]; [CARD]", 2: None, 3: "none"}


# ---------------------------------------------------------------- mixture
def brute_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share >= cap * sizes[s]}
        if not full:
            return {**target, **{s: weight[s] * share for s in free}}
        target |= {s: float(cap * sizes[s]) for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    return target


@pytest.mark.parametrize("fan_in, large", [(32, 256), (4, 8)])
def test_mixture(spark, fan_in, large):
    draw = random.Random(6)
    rows = [(i, draw.choice(["a", "b", "b", "b", "é", "z", None, "tiny"]), "w " * int(draw.paretovariate(1) * 20 % 4000)) for i in range(900)]
    rows = [(i, s, "w" if s == "tiny" else t) for i, s, t in rows] + [(2000, "b", None), (2001, "b", ""), (2002, "empty", " "), (5, "a", "w w"), (None, "a", "w\x0bw w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("x"))
    first, again = (sorted(mixing.mix_sources(df.repartition(n), fan_in=fan_in, large=large).collect(), key=str) for n in (1, 7))
    assert first == again and Counter(r.doc_id for r in first) == Counter(i for i, *_ in rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in first:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 60, s
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_copies_keep_their_expectation(spark):
    rows = [(i, "a" if i % 3 else "b", "w " * (1 + i % 40)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    copies = Counter()
    for seed in range(3):
        for r in mixing.mix_sources(df, seed=seed).collect():
            copies[r.source, r.size < 20] += r.taken / r.size / 3
    for s in "ab":
        rate = brute_targets({"a": sum(len(t.split()) for _, x, t in rows if x == "a"), "b": sum(len(t.split()) for _, x, t in rows if x == "b")})[s]
        n = sum(len(t.split()) for _, x, t in rows if x == s)
        for small in (True, False):
            docs = sum(1 for _, x, t in rows if x == s and (len(t.split()) < 20) == small)
            assert abs(copies[s, small] / docs - rate / n) < 0.12


# ---------------------------------------------------------------- repeats
def brute_repeats(rows, length=100):
    seen, out = set(), Counter()
    for d, t in sorted(rows, key=lambda r: r[0]):
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(b) - length + 1):
            if b[p:p + length] in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(b[p:p + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def repeating():
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdé ") for _ in range(400)) for _ in range(5)]
    rows = [(500, "a" * 1000), (501, "a" * 150 + "b"), (502, "ab" * 300), (503, "x" + "ab" * 120), (504, None), (505, ""), (506, base[0]), (507, base[0])]
    for d in range(120):
        t = "".join(draw.choice("xyz ") for _ in range(draw.choice([0, 5, 80, 150])))
        for _ in range(draw.choice([0, 1, 2, 3])):
            a = draw.randrange(0, 300)
            t += draw.choice(base)[a:a + draw.choice([60, 99, 100, 101, 130, 300])] + draw.choice(["", "-", "--"])
        rows.append((d, t))
    return rows


@pytest.mark.parametrize("chunk, block", [(8192, 1 << 20), (3, 256)])
def test_repeats_match_brute_force(spark, monkeypatch, repeating, chunk, block):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    df = spark.createDataFrame(repeating, "doc_id long, text string").withColumn("id", F.lit("x"))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, chunk=chunk).collect())
    assert got == brute_repeats(repeating)
    # blocks of a long text overlap by a window less one byte
    monkeypatch.setattr(suffix, "HASH_BLOCK", block)
    text = (repeating[-1][1] or "x") * 8
    rows = list(suffix._anchor_rows([(1, 0, text.encode())], 100))
    assert sum(int(r["n"].sum()) for r in rows) == max(len(text.encode()) - 99, 0)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    draw = random.Random(9)
    text, other = ("".join(draw.choice("abcdefg") for _ in range(n)) for n in (300, 250))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, other), (None, other)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(df).collect())
    assert got == {(1, 300, 0): 2, (None, 300, 300): 1, (2, 250, 0): 1, (None, 250, 250): 1}
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_merged_transforms_give_the_suffix_order():
    draw = random.Random(8)
    strings = [bytes(draw.choice(b"ab\x00") for _ in range(draw.randrange(1, 30))) for _ in range(40)] + [b"", b"aaaa", b"aaaa"]
    shards = [suffix.Transform(strings[a:a + 10]) for a in range(0, len(strings), 10)]
    row, parts = suffix.interleave(shards, 12)
    place = [(s.string[i] + 10 * k, s.offset[i]) for k, s in enumerate(shards) for i in range(len(s.bwt))]
    # end marks sort first and differ by string; equal prefixes keep the order of shards
    key = [[(b + 1, 0) for b in strings[s][o:o + 12]] + [(0, s)] * int(len(strings[s]) - o < 12) for s, o in place]
    got = [key[r] for r in row]
    assert got == sorted(got)
    for i in range(1, len(row)):
        assert parts[i] == (got[i - 1] != got[i])


# ---------------------------------------------------------------- queries and pipeline
def test_contract_columns(spark):
    want = {"op1": ["page_id", "url", "text", "n_chars"], "op3": ["doc_id"], "op2": ["doc_id", "item_id"],
            "op4": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            "op5": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            "op6": ["doc_id", "held_out", "lang_pred", "score"], "op7": ["doc_id", "fingerprint", "component_id"],
            "op8": ["doc_id", "size", "source_size", "target", "taken"], "op9": ["doc_id", "held_out", "score", "predicted"],
            "op10": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op11": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
            "op12": ["word", "form", "root", "n", "n_near", "form_n"], "op13": ["vec_id", "n_links", "component_id", "kept"]}
    assert {n.split("_")[0] for n in QUERIES} == set(want)
    for name in ("op1_html_extraction", "op5_quality_rules", "op9_quality_classifier"):
        got = QUERIES[name](spark, SF_SMALL)
        assert got.columns[:len(want[name.split("_")[0]])] == want[name.split("_")[0]]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("spans", F.lit("mine")).withColumn("ID_", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixture"]
    odd = docs.limit(2).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(10 ** 6)})
    now = docs.unionByName(odd)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF_SMALL).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert after.columns == docs.columns
            ids = {r.doc_id for r in after.select("doc_id").collect()}
            before = now.select("doc_id", "text").collect()
            if name == "near_duplicates":
                codes = {r.doc_id: brute_code(r.text) for r in before}
                assert ids == set(brute_components(codes).values()) and after.count() == len(ids)
            if name == "decontamination":
                bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
                index = {}
                for item, t in bench:
                    for s in shingles(t.lower().split())[0]:
                        index.setdefault(s, set()).add(item)
                near = [(r.doc_id, r.text) for r in before if any(s in index for s in shingles((r.text or "").lower().split())[0])]
                assert ids == {r.doc_id for r in before} - {d for d, _ in brute_leaks(near, bench)}
            if name == "personal_data":
                assert after.count() == now.count() and not any(brute_spans(r.text) for r in after.collect())
                assert after.filter("text is not null and n_chars != length(text)").count() == 0
            now = after
        else:
            assert after.count() == now.count()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0


# ---------------------------------------------------------------- one text with very many matches
def test_very_many_numbers_and_spans_of_one_text(spark):
    numbers = spark.createDataFrame([(1, " ".join(str(i * 7919 % 99991) for i in range(100_000)))], "doc_id bigint, text string")
    begun = time.perf_counter()
    assert pii.find_personal_data(numbers).select(F.size("spans").alias("n")).first()["n"] == 0
    rows = [" and ".join(f"é a{i}@b.com" for i in range(n)) for n in (0, 1, 2, 3, 10, 30_000)]
    found = spark.createDataFrame([(t,) for t in rows], "text string").withColumn("spans", pii.base_spans("text"))
    assert [r.text for r in pii.redact(found).collect()] == [re.sub("a[0-9]+@b.com", "[EMAIL]", t) for t in rows]
    assert time.perf_counter() - begun < 90


def test_matches_stand_where_they_are(spark):
    draw = random.Random(4)
    rows = ["".join(draw.choices("12 aé.", k=draw.randrange(0, 400))) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in rows], "text string").select(pii.matches("text", "[0-9]+").alias("m")).collect()
    assert [[(m.start, m.end, m.value) for m in r.m] for r in got] == [[(*m.span(), m[0]) for m in re.finditer("[0-9]+", t)] for t in rows]


def test_overlapping_spans_go_with_the_first(spark):
    spans = [(0, 1, 4, "ip"), (2, 0, 6, "email"), (5, 1, 7, "ip"), (9, 2, 12, "card"), (12, 3, 13, "phone")]
    df = spark.createDataFrame([("abcdefghijklmnop", spans)], f"text string, spans array<{pii.SPAN}>")
    assert pii.redact(df).first()["text"] == "[IP]hi[CARD][PHONE]nop"


# ---------------------------------------------------------------- rows that repeat an id
def test_rows_that_repeat_an_id_have_choices_of_their_own(spark):
    rows = [(None, "a", "one two three")] * 4_000 + [(None, "b", "one two three")] * 4_000 + [(7, "b", f"one two {i % 3}") for i in range(600)] + [(i, "b", "x y") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    runs = []
    for n in (1, 7):
        got = mixing.mix_sources(df.repartition(n)).select("doc_id", "source", "size", "target", "taken").collect()
        runs.append(Counter(map(tuple, got)))
        for source in "ab":
            mine = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 6
            assert len({r.taken for r in mine if r.doc_id is None}) > 1 and all(r.taken <= 3 * r.size for r in mine)
    assert runs[0] == runs[1]
