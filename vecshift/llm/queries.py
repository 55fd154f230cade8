"""Queries of the training-data operators: thin, over whole tables, in the columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify_quality
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import apply_rules, fit_forest
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, fit_forest(docs, table(spark, sf_dir, "labels")))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_language
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_language(docs).select("doc_id", "held_out", "lang_pred", "score")


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_html
    return extract_html(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data, summary
    return summary(find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start_word", "n_words", "similarity")


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import corpus_variants
    found = corpus_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("word", "n", "n_near", "form", "form_n", "root")


@query
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


WORDS_SQL = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"

#: Every window that begins at a shared shingle or ends with its text, against every item: the result without fingerprints.
ORACLE["op2_decontamination"] = f"""
WITH i AS (
  SELECT item_id, w, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS m
  FROM (SELECT DISTINCT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0
),
ic AS (
  SELECT item_id, k, m, s, count(*) AS c
  FROM (SELECT item_id, k, m, unnest(list_transform(range(1, m + 1), lambda j: array_to_string(list_slice(w, j, j + k - 1), ' '))) AS s FROM i)
  GROUP BY ALL
),
ds AS (
  SELECT doc_id, k, len(w) AS n, unnest(range(0, len(w) - k + 1)) AS p,
         unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(list_slice(w, j, j + k - 1), ' '))) AS s
  FROM (SELECT DISTINCT doc_id, {WORDS_SQL} AS w FROM documents), (SELECT DISTINCT k FROM i) WHERE len(w) >= k
),
h AS (
  SELECT doc_id, item_id, k, m, c, p, s, n, least(m, n - k + 1) AS span FROM ds JOIN ic USING (s, k)
),
st AS (SELECT DISTINCT doc_id, item_id, least(p, n - k + 1 - span) AS start FROM h),
x AS (
  SELECT h.doc_id, h.item_id, st.start, k, m, span, s, c, count(*) AS d
  FROM st JOIN h ON st.doc_id = h.doc_id AND st.item_id = h.item_id AND p >= st.start AND p < st.start + span GROUP BY ALL
),
y AS (
  SELECT doc_id, item_id, start, k, m, span, CAST(sum(least(c, d)) AS DOUBLE) AS shared FROM x GROUP BY ALL
)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(span + k - 1 AS INTEGER) AS n_words, shared / (m + span - shared) AS similarity
FROM y WHERE shared / (m + span - shared) >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / (m + span - shared) DESC, start) = 1
""".strip()

#: Every 100-byte string of every text, as hexadecimal digits.
ORACLE["op10_suffix_dedup"] = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, x, unnest(range(0, length(x) // 2, 500)) AS lo FROM t),
y AS (SELECT doc_id, lo, length(x) // 2 AS n, substr(x, 2 * lo + 1, 1198) AS y FROM k),
b AS (SELECT doc_id, lo, n, y, unnest(range(least(500, n - lo))) AS o FROM y),
w AS (
  SELECT doc_id, lo + o AS p, substr(y, 2 * o + 1, 2) AS byte, CASE WHEN lo + o + 100 <= n THEN md5(substr(y, 2 * o + 1, 200)) END AS win
  FROM b
),
a AS (
  SELECT doc_id, p, byte, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS again FROM w
),
g AS (
  SELECT doc_id, p, byte, coalesce(max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM a
),
s AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) AS before FROM g),
r AS (
  SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_spans,
         coalesce(string_agg(byte, '' ORDER BY p) FILTER (WHERE gone = 0), '') AS kept
  FROM s GROUP BY doc_id
)
SELECT t.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN r USING (doc_id)
""".strip()

SMALL_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every phrase of one to three words, counted by its text.
ORACLE["op11_collocations"] = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({SMALL_SQL}, '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents
),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(list_slice(w, j, j + k - 1), ' '))) AS phrase
        FROM w, (SELECT unnest(range(1, 4)) AS k) WHERE len(w) >= k)
  GROUP BY ALL
),
d AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 10),
u AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS first, array_to_string(list_slice(w, cut + 1, k), ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM d)
),
s AS (
  SELECT u.lang, u.phrase, u.a, cut, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM u JOIN c x ON x.lang = u.lang AND x.phrase = u.first JOIN c y ON y.lang = u.lang AND y.phrase = u.rest
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, part, max(a) AS a
  FROM (SELECT lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS part FROM d WHERE k = 3)
  GROUP BY lang, part
)
SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS BIGINT) AS rank,
       b.phrase, b.a, b.l, b.r, t.n, b.score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.part = b.phrase
WHERE i.a IS NULL OR 100 * i.a < 50 * b.a
QUALIFY rank <= 2000
""".strip()

#: CRC-32 by its table of 256 steps; near words by words with one character left out or masked.
ORACLE["op12_spelling_variants"] = rf"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
),
o AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(string_split_regex({SMALL_SQL}, '[^A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
),
y AS (
  SELECT run, c, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
         ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END)) AS bytes
  FROM o
),
h AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM y, tab
),
w AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
),
g AS (
  SELECT word, n, substr(word, 1, i::INT) || '*' || substr(word, i::INT + 2) AS masked, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS cut
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
),
e AS (
  SELECT a.word, b.word AS near, b.n FROM g a JOIN g b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g.cut
  UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g.cut
),
m AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS best, max(n) AS best_n FROM e GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.best_n >= 5 * w.n THEN m.best END AS form, CASE WHEN m.best_n >= 5 * w.n THEN m.best_n END AS form_n
  FROM w LEFT JOIN m ON m.word = w.word
),
r AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM f JOIN r ON r.word = f.word AND r.next IS NULL
""".strip()

#: Every pair of rows of one label.
ORACLE["op13_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
""".strip()
