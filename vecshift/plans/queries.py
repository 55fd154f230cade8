"""Query catalogue: one Spark query per operator, each next to its DuckDB oracle.

Every query reads the driver tables under ``sf_dir`` (or data Spark derives
from them) in full. Floating results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_corpus
from ..operators.labels import factorize, label_mapping_json
from ..operators.ordering import seeded_rank
from ..operators.split import assign_split, split_rows
from ..session import materialize
from .oracle import (bounds_cte, clean_cte, codes_cte, register, seeded_rank_sql, split_case)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            register(name, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cleaned_documents(spark: SparkSession, sf_dir: str, target: str = "lang") -> DataFrame:
    """The cleaned corpus, written once as a parquet table (it feeds several jobs)."""
    docs = table(spark, sf_dir, "documents")
    return materialize(clean_corpus(docs, "text", target, order_col="doc_id"), "corpus")


# ---------------------------------------------------------------- cleaning
@query("clean_corpus", f"""
WITH {clean_cte()}
SELECT row_id, doc_id, text, target FROM c
""")
def q_clean_corpus(spark, sf_dir):
    return cleaned_documents(spark, sf_dir)


@query("corpus_head", f"""
WITH {clean_cte()}
SELECT row_id, doc_id, target, md5(text) AS text_md5 FROM c WHERE row_id < 200
""")
def q_corpus_head(spark, sf_dir):
    head = clean_corpus(table(spark, sf_dir, "documents"), "text", "lang", order_col="doc_id", head=200)
    return head.select("row_id", "doc_id", "target", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- labels
@query("factorize_target", f"""
WITH j AS (
  SELECT d.doc_id, d.text, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
),
{clean_cte(target="quality", source="j")},
{codes_cte()}
SELECT c.row_id, c.doc_id, c.target, coalesce(codes.label, -1) AS label
FROM c LEFT JOIN codes ON c.target = codes.value
""")
def q_factorize_target(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = docs.join(labels, "doc_id", "left")
    corpus = clean_corpus(joined, "text", "quality", order_col="doc_id")
    coded, _ = factorize(corpus)
    return coded.select("row_id", "doc_id", "target", "label")


@query("label_mapping", f"""
WITH {clean_cte(target="source")},
{codes_cte()}
SELECT label, value FROM codes
""")
def q_label_mapping(spark, sf_dir):
    _, codes = factorize(cleaned_documents(spark, sf_dir, target="source"))
    return codes.select("label", "value")


@query("label_mapping_json", f"""
WITH {clean_cte(target="source")},
{codes_cte()}
SELECT '{{' || string_agg('"' || CAST(label AS VARCHAR) || '":"' || value || '"', ',' ORDER BY label)
       || '}}' AS mapping
FROM codes
""")
def q_label_mapping_json(spark, sf_dir):
    _, codes = factorize(cleaned_documents(spark, sf_dir, target="source"))
    return label_mapping_json(codes)


# ---------------------------------------------------------------- ordering and splits
@query("seeded_rank", f"""
SELECT vec_id, {seeded_rank_sql('vec_id')} AS rank FROM embeddings
""")
def q_seeded_rank(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id")
    return seeded_rank(emb, "vec_id", seed=42).select("vec_id", "rank")


@query("assign_split", f"""
WITH {clean_cte()},
n AS (SELECT count(*) AS n FROM c),
{bounds_cte('n')},
r AS (SELECT row_id, {seeded_rank_sql('row_id')} AS rank FROM c)
SELECT r.row_id, r.rank, {split_case()} AS split FROM r, b
""")
def q_assign_split(spark, sf_dir):
    return assign_split(cleaned_documents(spark, sf_dir)).select("row_id", "rank", "split")


@query("split_rows", f"""
WITH n AS (SELECT count(*) AS n FROM events),
{bounds_cte('n')},
r AS (SELECT event_id, {seeded_rank_sql('event_id')} AS rank FROM events)
SELECT r.event_id, {split_case()} AS split FROM r, b
""")
def q_split_rows(spark, sf_dir):
    """The split of every event by selected boundary keys: no row is ranked or moved."""
    return split_rows(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query("assign_split_small", f"""
WITH c AS (SELECT CAST(rank() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS row_id FROM region),
n AS (SELECT count(*) AS n FROM c),
{bounds_cte('n')},
r AS (SELECT row_id, {seeded_rank_sql('row_id')} AS rank FROM c)
SELECT r.row_id, r.rank, {split_case()} AS split FROM r, b
""")
def q_assign_split_small(spark, sf_dir):
    from ..operators.ordering import key_rank
    region = table(spark, sf_dir, "region")
    rows = key_rank(region, "r_regionkey", rank_col="row_id").select("row_id")
    return assign_split(rows).select("row_id", "rank", "split")


@query("split_label_counts", f"""
WITH {clean_cte()},
{codes_cte()},
n AS (SELECT count(*) AS n FROM c),
{bounds_cte('n')},
r AS (SELECT row_id, target, {seeded_rank_sql('row_id')} AS rank FROM c)
SELECT {split_case()} AS split, coalesce(codes.label, -1) AS label, r.target,
       CAST(count(*) AS BIGINT) AS n
FROM r CROSS JOIN b LEFT JOIN codes ON r.target = codes.value
GROUP BY ALL
""")
def q_split_label_counts(spark, sf_dir):
    """The minimum slice: rows of each class in train, val and test."""
    corpus = materialize(cleaned_documents(spark, sf_dir).select("row_id", "target"), "targets")
    coded, _ = factorize(corpus)
    return (split_rows(coded, n=corpus.count())
            .groupBy("split", "label", "target")
            .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- vectors
from ..functions.text import tokens as _tokens  # noqa: E402
from ..functions.text import with_prompt as _with_prompt  # noqa: E402
from ..functions.vector import argmax_prefix, dot, scale  # noqa: E402
from ..operators.cluster import assign_nearest, collect_centers, group_centroids  # noqa: E402
from ..operators.encode import HashEncoder, encode_text  # noqa: E402
from ..operators.fit import fit_adapter  # noqa: E402
from ..operators.metrics import (best_by, contingency, num_classes, per_row_ms,  # noqa: E402
                                 speedup, v_measure)
from ..operators.ordering import key_rank, with_batch_id  # noqa: E402
from ..operators.project import analytic_teacher_model  # noqa: E402
from ..operators.vectors import (alignment_report, batch_losses, embedding_stats,  # noqa: E402
                                 epoch_loss, mse_loss, normalize_vectors, pair_embeddings, to_long)
from .oracle import PROMPT, analytic_w, emb_long_cte, hash_encode_cte  # noqa: E402

DIM = 64  # dimension of the fixture vectors


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def with_teacher(spark, df, col="embedding", out="teacher"):
    """Fixture teacher: the analytic map applied to the vectors (double precision)."""
    model = analytic_teacher_model(DIM)
    return df.withColumn(out, model.project_col(spark, col, as_float=False))


TEACHER_CTE = f"""
t AS (
  SELECT e.vec_id, o.i, sum({analytic_w('o.i', 'e.pos')} * e.x) + 0.25 AS y
  FROM e CROSS JOIN range({DIM}) AS o(i) GROUP BY ALL
)"""


@query("l2_normalize", f"""
WITH {emb_long_cte()},
s AS (SELECT vec_id, pos, x * 3 AS x FROM e),
nrm AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS nr FROM s GROUP BY vec_id)
SELECT s.vec_id, s.pos, round(s.x / nrm.nr, 6) AS value FROM s JOIN nrm USING (vec_id)
""")
def q_l2_normalize(spark, sf_dir):
    emb = embeddings(spark, sf_dir).select("vec_id", scale("embedding", 3.0).alias("embedding"))
    return to_long(normalize_vectors(emb, as_float=False), "vec_id", "embedding")


@query("affine_project", f"""
WITH {emb_long_cte()}, {TEACHER_CTE}
SELECT vec_id, i AS pos, round(y, 6) AS value FROM t
""")
def q_affine_project(spark, sf_dir):
    emb = with_teacher(spark, embeddings(spark, sf_dir).select("vec_id", "embedding"))
    return to_long(emb, "vec_id", "teacher")


@query("affine_project_jvm", f"""
WITH {emb_long_cte()}, {TEACHER_CTE}
SELECT vec_id, i AS pos, round(y, 6) AS value FROM t
""")
def q_affine_project_jvm(spark, sf_dir):
    model = analytic_teacher_model(DIM)
    emb = model.transform(embeddings(spark, sf_dir).select("vec_id", "embedding"), "embedding",
                          "teacher", mode="jvm")
    return to_long(emb, "vec_id", "teacher")


@query("mse_loss", f"""
WITH {emb_long_cte()}, {TEACHER_CTE},
r AS (SELECT t.vec_id, avg((e.x - t.y) * (e.x - t.y)) AS m FROM t JOIN e ON e.vec_id = t.vec_id AND e.pos = t.i
      GROUP BY t.vec_id)
SELECT round(avg(m), 6) AS mse, CAST(count(*) AS BIGINT) AS n_rows FROM r
""")
def q_mse_loss(spark, sf_dir):
    emb = with_teacher(spark, embeddings(spark, sf_dir).select("vec_id", "embedding"))
    return mse_loss(emb, "embedding", "teacher").select(F.round("mse", 6).alias("mse"), "n_rows")


@query("batch_losses", f"""
WITH {emb_long_cte()}, {TEACHER_CTE},
r AS (SELECT t.vec_id, avg((e.x - t.y) * (e.x - t.y)) AS m FROM t JOIN e ON e.vec_id = t.vec_id AND e.pos = t.i
      GROUP BY t.vec_id),
k AS (SELECT m, (rank() OVER (ORDER BY vec_id) - 1) // 64 AS batch_id FROM r)
SELECT CAST(batch_id AS BIGINT) AS batch_id, round(avg(m), 6) AS loss, CAST(count(*) AS BIGINT) AS n
FROM k GROUP BY batch_id
""")
def q_batch_losses(spark, sf_dir):
    emb = with_teacher(spark, embeddings(spark, sf_dir).select("vec_id", "embedding"))
    ranked = with_batch_id(key_rank(emb, "vec_id", rank_col="rank"), 64)
    return batch_losses(ranked, "embedding", "teacher").select("batch_id", F.round("loss", 6).alias("loss"), "n")


@query("epoch_loss", f"""
WITH {emb_long_cte()}, {TEACHER_CTE},
r AS (SELECT t.vec_id, avg((e.x - t.y) * (e.x - t.y)) AS m FROM t JOIN e ON e.vec_id = t.vec_id AND e.pos = t.i
      GROUP BY t.vec_id),
k AS (SELECT m, (rank() OVER (ORDER BY vec_id) - 1) // 64 AS batch_id FROM r),
bl AS (SELECT avg(m) AS loss, count(*) AS n FROM k GROUP BY batch_id)
SELECT round(sum(loss * n) / sum(n), 6) AS loss FROM bl
""")
def q_epoch_loss(spark, sf_dir):
    emb = with_teacher(spark, embeddings(spark, sf_dir).select("vec_id", "embedding"))
    ranked = with_batch_id(key_rank(emb, "vec_id", rank_col="rank"), 64)
    return epoch_loss(batch_losses(ranked, "embedding", "teacher")).select(F.round("loss", 6).alias("loss"))


ARGMAX_CTE = f"""
{emb_long_cte()},
am AS (
  SELECT vec_id, label, CAST(min(pos) AS BIGINT) AS cluster FROM (
    SELECT vec_id, label, pos, x, max(x) OVER (PARTITION BY vec_id) AS mx FROM e WHERE pos < 10
  ) WHERE x = mx GROUP BY vec_id, label
)"""


def fixed_clusters(spark, sf_dir):
    emb = embeddings(spark, sf_dir)
    return emb.select("vec_id", F.col("label").cast("long").alias("label"),
                      argmax_prefix("embedding", 10).cast("long").alias("cluster"))


@query("contingency", f"""
WITH {ARGMAX_CTE}
SELECT CAST(label AS BIGINT) AS label, cluster, CAST(count(*) AS BIGINT) AS n FROM am GROUP BY ALL
""")
def q_contingency(spark, sf_dir):
    return contingency(fixed_clusters(spark, sf_dir), "label", "cluster")


V_SQL = """
cont AS (SELECT label, cluster, CAST(count(*) AS DOUBLE) AS n FROM am GROUP BY ALL),
tot AS (SELECT sum(n) AS nn, sum(n * ln(n)) AS s_ij FROM cont),
sa AS (SELECT sum(a * ln(a)) AS s_a FROM (SELECT sum(n) AS a FROM cont GROUP BY label)),
sb AS (SELECT sum(b * ln(b)) AS s_b FROM (SELECT sum(n) AS b FROM cont GROUP BY cluster)),
m AS (
  SELECT ln(nn) + (s_ij - s_a - s_b) / nn AS mi, ln(nn) - s_a / nn AS hc, ln(nn) - s_b / nn AS hk
  FROM tot, sa, sb
),
hc AS (
  SELECT CASE WHEN abs(hc) < 1e-15 THEN 1.0 ELSE least(1.0, greatest(0.0, mi / hc)) END AS h,
         CASE WHEN abs(hk) < 1e-15 THEN 1.0 ELSE least(1.0, greatest(0.0, mi / hk)) END AS c
  FROM m
)
SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness,
       round(CASE WHEN h + c = 0 THEN 0.0 ELSE 2 * h * c / (h + c) END, 6) AS v_measure
FROM hc
"""


@query("v_measure", f"WITH {ARGMAX_CTE},{V_SQL}")
def q_v_measure(spark, sf_dir):
    v = v_measure(fixed_clusters(spark, sf_dir), "label", "cluster")
    return v.select(*[F.round(c, 6).alias(c) for c in ("homogeneity", "completeness", "v_measure")])


@query("nearest_centroid", f"""
WITH {emb_long_cte()},
cen AS (SELECT label, pos, avg(x) AS cx FROM e GROUP BY label, pos),
d AS (
  SELECT e.vec_id, cen.label AS c, sum((e.x - cen.cx) * (e.x - cen.cx)) AS dist
  FROM e JOIN cen ON e.pos = cen.pos GROUP BY e.vec_id, cen.label
)
SELECT vec_id, CAST(arg_min(c, (dist, c)) AS BIGINT) AS cluster FROM d GROUP BY vec_id
""")
def q_nearest_centroid(spark, sf_dir):
    emb = embeddings(spark, sf_dir)
    ids, centers = collect_centers(group_centroids(emb, "label"), "label")
    return assign_nearest(emb.select("vec_id", "embedding"), centers, ids=ids).select("vec_id", "cluster")


@query("pair_embeddings", f"""
WITH {emb_long_cte()}, {TEACHER_CTE}
SELECT e.vec_id AS row_id, CAST(any_value(e.label) AS BIGINT) AS label, CAST(count(*) AS INTEGER) AS base_dim,
       CAST(count(*) AS INTEGER) AS teacher_dim, round(sum(e.x * t.y), 6) AS dot
FROM e JOIN t ON e.vec_id = t.vec_id AND e.pos = t.i GROUP BY e.vec_id
""")
def q_pair_embeddings(spark, sf_dir):
    emb = embeddings(spark, sf_dir).withColumnRenamed("vec_id", "row_id")
    teacher = with_teacher(spark, emb.select("row_id", "embedding"), out="t").select(
        "row_id", F.col("t").alias("embedding"))
    labels = emb.select("row_id", F.col("label").cast("long").alias("label"))
    pairs = pair_embeddings(emb.select("row_id", "embedding"), teacher, labels)
    return pairs.select("row_id", "label", F.size("base").alias("base_dim"), F.size("teacher").alias("teacher_dim"),
                        F.round(dot("base", "teacher"), 6).alias("dot"))


@query("validate_alignment", f"""
WITH {clean_cte()},
{hash_encode_cte(None, DIM)},
tk AS (SELECT DISTINCT id FROM enc),
tt AS (SELECT row_id FROM c),
j AS (SELECT e.vec_id AS b, tt.row_id AS t FROM embeddings e FULL OUTER JOIN tt ON e.vec_id = tt.row_id)
SELECT CAST(count(b) AS BIGINT) AS n_base, CAST(count(t) AS BIGINT) AS n_teacher,
       CAST(NULL AS BIGINT) AS n_labels,
       CAST(sum(CASE WHEN b IS NOT NULL AND t IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS base_only,
       CAST(sum(CASE WHEN t IS NOT NULL AND b IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS teacher_only,
       (SELECT min(len(embedding)) FROM embeddings) AS base_dim_min,
       (SELECT max(len(embedding)) FROM embeddings) AS base_dim_max,
       {DIM} AS teacher_dim_min, {DIM} AS teacher_dim_max
FROM j
""")
def q_validate_alignment(spark, sf_dir):
    """Embeddings (keyed by vec_id) against hash-encoded documents (keyed by row_id): misaligned."""
    base = embeddings(spark, sf_dir).select(F.col("vec_id").alias("row_id"), "embedding")
    teacher = encode_text(cleaned_documents(spark, sf_dir).select("row_id", "text"), HashEncoder(DIM))
    return alignment_report(base, teacher.select("row_id", "embedding"))


@query("embedding_stats", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, min(len(embedding)) AS dim_min, max(len(embedding)) AS dim_max
FROM embeddings
""")
def q_embedding_stats(spark, sf_dir):
    return embedding_stats(embeddings(spark, sf_dir))


@query("num_classes", f"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
{bounds_cte('n')},
r AS (SELECT vec_id, label, {seeded_rank_sql('vec_id')} AS rank FROM embeddings),
s AS (SELECT {split_case()} AS split, label FROM r, b)
SELECT split, CAST(count(DISTINCT label) AS BIGINT) AS n_classes, CAST(count(*) AS BIGINT) AS n_rows
FROM s GROUP BY split
""")
def q_num_classes(spark, sf_dir):
    emb = embeddings(spark, sf_dir).select(F.col("vec_id").alias("row_id"), "label")
    return num_classes(split_rows(emb), "label", ["split"])


@query("best_epoch", """
SELECT event_type, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value
FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type
""")
def q_best_epoch(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return best_by(ev, "value", "event_id", "max", ["event_type"])


@query("best_epoch_min", """
SELECT event_type, arg_min(event_id, (value, event_id)) AS event_id, min(value) AS value
FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type
""")
def q_best_epoch_min(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return best_by(ev, "value", "event_id", "min", ["event_type"])


@query("latency_stats", """
WITH t AS (
  SELECT user_id,
         sum(CASE WHEN event_type = 'view' THEN value END) AS base_seconds,
         sum(CASE WHEN event_type = 'purchase' THEN value END) AS teacher_seconds,
         sum(CASE WHEN event_type = 'click' THEN value END) AS adapter_seconds,
         count(CASE WHEN event_type = 'click' THEN 1 END) AS n_rows
  FROM events GROUP BY user_id
)
SELECT user_id, CAST(n_rows AS BIGINT) AS n_rows, round(base_seconds, 6) AS base_seconds,
       round(teacher_seconds, 6) AS teacher_seconds, round(adapter_seconds, 6) AS adapter_seconds,
       round(CASE WHEN n_rows > 0 THEN adapter_seconds / n_rows * 1e3 END, 6) AS adapter_ms_per_row,
       round(CASE WHEN adapter_seconds > 0 THEN teacher_seconds / adapter_seconds END, 6) AS latency_speedup,
       round(CASE WHEN base_seconds + adapter_seconds > 0
                  THEN teacher_seconds / (base_seconds + adapter_seconds) END, 6) AS end_to_end_speedup
FROM t
""")
def q_latency_stats(spark, sf_dir):
    """Timings table from events: view = base encode, purchase = teacher, click = adapter."""
    ev = table(spark, sf_dir, "events")
    t = ev.groupBy("user_id").agg(
        F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("base_seconds"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("teacher_seconds"),
        F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("adapter_seconds"),
        F.count(F.when(F.col("event_type") == "click", 1)).cast("long").alias("n_rows"))
    r = lambda c: F.round(c, 6)
    return t.select(
        "user_id", "n_rows", r(F.col("base_seconds")).alias("base_seconds"),
        r(F.col("teacher_seconds")).alias("teacher_seconds"), r(F.col("adapter_seconds")).alias("adapter_seconds"),
        r(per_row_ms(F.col("adapter_seconds"), F.col("n_rows"))).alias("adapter_ms_per_row"),
        r(speedup(F.col("teacher_seconds"), F.col("adapter_seconds"))).alias("latency_speedup"),
        r(speedup(F.col("teacher_seconds"), F.col("base_seconds") + F.col("adapter_seconds")))
        .alias("end_to_end_speedup"))


@query("synthetic_teacher_fit", f"""
SELECT CAST(o.i AS INTEGER) AS out_idx, CAST(j.j AS INTEGER) AS in_idx, round({analytic_w('o.i', 'j.j')}, 4) AS weight
FROM range({DIM}) AS o(i) CROSS JOIN range({DIM}) AS j(j)
UNION ALL
SELECT CAST(o.i AS INTEGER) AS out_idx, -1 AS in_idx, 0.25 AS weight FROM range({DIM}) AS o(i)
""")
def q_synthetic_teacher_fit(spark, sf_dir):
    """Fit on (embedding, analytic teacher): the recovered map is the analytic one."""
    emb = with_teacher(spark, embeddings(spark, sf_dir).select("embedding"))
    model, _ = fit_adapter(emb, "embedding", "teacher", solver="normal")
    w = model.to_frame(spark)
    weights = w.select("out_idx", F.posexplode("weights").alias("in_idx", "weight"))
    bias = w.select("out_idx", F.lit(-1).alias("in_idx"), F.col("bias").alias("weight"))
    out = weights.unionByName(bias)
    return out.select("out_idx", "in_idx", (F.round(F.col("weight"), 4) + F.lit(0.0)).alias("weight"))


def _encoded_long(spark, sf_dir, prompt):
    docs = cleaned_documents(spark, sf_dir).select("row_id", "text")
    enc = encode_text(docs, HashEncoder(DIM), prompt=prompt)
    long = enc.select(F.col("row_id").alias("id"), F.posexplode("embedding").alias("bucket", "v"))
    return long.where(F.col("v") != 0).select(
        "id", "bucket", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("hash_encode_base", f"""
WITH {clean_cte()},
{hash_encode_cte(None, DIM)}
SELECT id, bucket, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value FROM enc
""")
def q_hash_encode_base(spark, sf_dir):
    return _encoded_long(spark, sf_dir, None)


@query("hash_encode_instruct", f"""
WITH {clean_cte()},
{hash_encode_cte(PROMPT, DIM)}
SELECT id, bucket, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value FROM enc
""")
def q_hash_encode_instruct(spark, sf_dir):
    return _encoded_long(spark, sf_dir, PROMPT)


PROMPT_SQL = "'" + PROMPT.replace("'", "''") + "'"
TOKENS_SQL = f"list_filter(string_split_regex({PROMPT_SQL} || text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


@query("prompt_concat", f"""
WITH {clean_cte()}
SELECT row_id, md5({PROMPT_SQL} || text) AS prompted_md5, CAST(length({PROMPT_SQL} || text) AS INTEGER) AS n_chars
FROM c
""")
def q_prompt_concat(spark, sf_dir):
    docs = cleaned_documents(spark, sf_dir)
    p = _with_prompt("text", PROMPT)
    return docs.select("row_id", F.md5(p).alias("prompted_md5"), F.length(p).alias("n_chars"))


@query("truncate_tokens", f"""
WITH {clean_cte()},
t AS (SELECT row_id, {TOKENS_SQL} AS toks FROM c)
SELECT row_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(list_slice(toks, 1, 3000)) AS INTEGER) AS n_kept,
       md5(array_to_string(list_slice(toks, 1, 3000), ' ')) AS kept_md5
FROM t
""")
def q_truncate_tokens(spark, sf_dir):
    docs = cleaned_documents(spark, sf_dir)
    toks = _tokens(_with_prompt("text", PROMPT))
    kept = truncate_tokens(_with_prompt("text", PROMPT), 3000)
    return docs.select("row_id", F.size(toks).alias("n_tokens"), F.size(kept).alias("n_kept"),
                       F.md5(F.array_join(kept, " ")).alias("kept_md5"))


# ---------------------------------------------------------------- sources, sinks, cache, streaming
from ..functions.text import fingerprint_long, resolve_instruction_col, row_fingerprint, truncate_tokens  # noqa: E402
from ..operators.labels import decode_labels  # noqa: E402
from ..session import input_bytes, scratch_path  # noqa: E402
from ..sources.corpus import (load_splits_from_column, read_corpus_csv, read_corpus_jsonl,  # noqa: E402
                              write_corpus_csv, write_corpus_jsonl)
from ..sources.csv_ranges import RANGE_BYTES  # noqa: E402
from ..sources.metadata import cache_probe, uncached_rows  # noqa: E402
from ..sources.vector_cache import VectorCache  # noqa: E402
from ..sources.npy import write_npy  # noqa: E402
from ..sources.vectors import (read_json_vectors, read_npy_embeddings, write_json_vectors,  # noqa: E402
                               write_npy_shards)
from ..streaming.encode_stream import encode_stream, run_to_table, stream_corpus  # noqa: E402
from .oracle import NULL_LIST  # noqa: E402

REQUESTED_SPLITS = ["src2", "none", "src0"]


@query("union_splits", """
WITH r AS (SELECT * FROM (VALUES ('src2', 0), ('none', 1), ('src0', 2)) AS t(split, split_ordinal)),
u AS (SELECT d.doc_id, d.source AS split, r.split_ordinal, d.text FROM documents d JOIN r ON d.source = r.split)
SELECT CAST(rank() OVER (ORDER BY split_ordinal, doc_id) - 1 AS BIGINT) AS row_id, split,
       CAST(split_ordinal AS INTEGER) AS split_ordinal, doc_id, md5(text) AS text_md5
FROM u
""")
def q_union_splits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    u = load_splits_from_column(docs, "source", REQUESTED_SPLITS)
    ranked = key_rank(u, "doc_id", rank_col="row_id", prefix_cols=["split_ordinal"], bucket_source=docs)
    return ranked.select("row_id", "split", "split_ordinal", "doc_id", F.md5("text").alias("text_md5"))


@query("csv_roundtrip", f"""
SELECT doc_id, CASE WHEN text IN ({NULL_LIST}) THEN NULL ELSE text END AS text, lang FROM documents
""")
def q_csv_roundtrip(spark, sf_dir):
    from ..functions.text import null_if_token
    path = scratch_path(spark, "csv")
    write_corpus_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    back = read_corpus_csv(spark, path, "doc_id LONG, text STRING, lang STRING")
    return back.select("doc_id", null_if_token("text").alias("text"), "lang")


#: Some text of each document with everything that CSV quotes.
QUOTED_TEXT = """concat(text, chr(10), '"', lang, '", ', source, chr(10), chr(10), text)"""


@query("csv_ranges", f"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL OR lang IS NULL OR source IS NULL THEN NULL
                               ELSE text || chr(10) || '"' || lang || '", ' || source || chr(10) || chr(10) || text END AS text FROM documents)
SELECT CAST(rank() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_id, doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM d
""")
def q_csv_ranges(spark, sf_dir):
    """Documents as CSV with line ends, quotes and commas in every text, read back in 64 ranges or more, in input order."""
    path = scratch_path(spark, "csv-ranges")
    # texts are put together after they are sorted: half the bytes to shuffle
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").orderBy("doc_id")
    write_corpus_csv(docs.select("doc_id", F.expr(QUOTED_TEXT).alias("text")), path)
    size = input_bytes(spark.read.text(path))
    rows = read_corpus_csv(spark, path, "doc_id LONG, text STRING", range_bytes=min(RANGE_BYTES, max(1, size // 64)))
    rows = materialize(rows.select("_order", "doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5")), "csv-rows")
    return rows.join(key_rank(rows.select("_order"), "_order", rank_col="row_id"), "_order").drop("_order")


@query("csv_typed", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS price
FROM (SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag,
             CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM lineitem)
GROUP BY l_orderkey, l_linenumber, l_returnflag, l_quantity
""")
def q_csv_typed(spark, sf_dir):
    """Line items written as CSV; their columns come back as the whole numbers, numbers and strings that they hold."""
    path = scratch_path(spark, "csv-typed")
    columns = ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice"]
    items = table(spark, sf_dir, "lineitem").select(*columns)
    write_corpus_csv(items.select(*(F.col(c).cast("double") if c in columns[3:] else F.col(c) for c in columns)), path)
    rows = read_corpus_csv(spark, path, typed=True)
    return rows.groupBy(*columns[:4]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("jsonl_roundtrip", """
SELECT doc_id, text, lang, source, n_chars FROM documents
""")
def q_jsonl_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    write_corpus_jsonl(table(spark, sf_dir, "documents"), path)
    return read_corpus_jsonl(spark, path, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG") \
        .select("doc_id", "text", "lang", "source", "n_chars")


VEC_LONG_SQL = f"""
WITH {emb_long_cte()},
r AS (SELECT vec_id, CAST(rank() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS row_id FROM embeddings)
SELECT r.row_id, e.pos, round(e.x, 6) AS value FROM e JOIN r USING (vec_id)
"""


@query("npy_scan", VEC_LONG_SQL)
def q_npy_scan(spark, sf_dir):
    path = scratch_path(spark, "npy")
    write_npy_shards(embeddings(spark, sf_dir), path, "vec_id")
    return to_long(read_npy_embeddings(spark, path), "row_id", "embedding")


@query("json_vector_scan", VEC_LONG_SQL)
def q_json_vector_scan(spark, sf_dir):
    path = scratch_path(spark, "json")
    emb = embeddings(spark, sf_dir).select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("name"),
                                           "embedding")
    write_json_vectors(emb, path, "name")
    return to_long(read_json_vectors(spark, path), "row_id", "embedding")


@query("row_fingerprint", f"""
WITH {clean_cte()}
SELECT row_id, md5(text) AS fingerprint FROM c
""")
def q_row_fingerprint(spark, sf_dir):
    return cleaned_documents(spark, sf_dir).select("row_id", row_fingerprint("text").alias("fingerprint"))


@query("uncached_rows", f"""
WITH {clean_cte()},
cache AS (
  SELECT DISTINCT md5(d.text) AS fingerprint FROM documents d JOIN labels l USING (doc_id)
  WHERE d.text IS NOT NULL AND d.text NOT IN ({NULL_LIST})
)
SELECT row_id, md5(text) AS fingerprint FROM c WHERE md5(text) NOT IN (SELECT fingerprint FROM cache)
""")
def q_uncached_rows(spark, sf_dir):
    """Rows still to encode when the labelled documents are already in the vector cache."""
    from ..functions.text import null_if_token
    docs = cleaned_documents(spark, sf_dir).select("row_id", row_fingerprint("text").alias("fingerprint"))
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    cache = labelled.select(null_if_token("text").alias("text")).where(F.col("text").isNotNull()) \
        .select(row_fingerprint("text").alias("fingerprint"), F.lit(PROMPT).alias("instruction"),
                F.lit("hash-md5-64").alias("model"))
    req = docs.withColumn("instruction", F.lit(PROMPT)).withColumn("model", F.lit("hash-md5-64"))
    return uncached_rows(req, cache, ["fingerprint", "instruction", "model"]).select("row_id", "fingerprint")


TEXT_SUM_SQL = "CAST(sum(CAST(('0x' || substr(md5(text), 1, 15))::BIGINT AS HUGEINT)) % 2305843009213693952 AS BIGINT)"


def text_sums(df, group: str):
    """Rows and the sum (modulo 2^61) of 60-bit text hashes of each group; equal rows add up."""
    total = F.sum(fingerprint_long("text").cast("decimal(38,0)")) % F.lit(1 << 61).cast("decimal(38,0)")
    return df.groupBy(F.col(group).alias("source")).agg(F.count(F.lit(1)).cast("long").alias("num_samples"),
                                                        total.cast("long").alias("content_hash")).withColumn("instruction", F.lit(PROMPT))


@query("cache_hit", f"""
WITH {clean_cte(target="source")},
req AS (SELECT target AS source, count(*) AS num_samples, {TEXT_SUM_SQL} AS content_hash FROM c GROUP BY target),
st AS (SELECT source, count(*) AS num_samples, {TEXT_SUM_SQL} AS content_hash FROM documents GROUP BY source)
SELECT req.source, CAST(req.num_samples AS BIGINT) AS num_samples,
       coalesce(req.num_samples = st.num_samples, false) AS hit_loose,
       coalesce(req.num_samples = st.num_samples AND req.content_hash = st.content_hash, false) AS hit_strict
FROM req LEFT JOIN st ON req.source = st.source
""")
def q_cache_hit(spark, sf_dir):
    """Per source: is the cleaned corpus already covered by a record made from the raw table?"""
    req = text_sums(cleaned_documents(spark, sf_dir, target="source"), "target")
    stored = text_sums(table(spark, sf_dir, "documents"), "source")
    loose = cache_probe(req, stored, ["source", "instruction", "num_samples"]).select(
        "source", "num_samples", F.col("hit").alias("hit_loose"))
    strict = cache_probe(req, stored, ["source", "instruction", "num_samples", "content_hash"]).select(
        "source", F.col("hit").alias("hit_strict"))
    return loose.join(strict, "source")


@query("vector_cache", """
WITH d AS (SELECT text FROM documents), a AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations),
c AS (SELECT (SELECT count(*) FROM d) AS n_d, (SELECT count(*) FROM a) AS n_a,
             (SELECT count(DISTINCT coalesce('+' || text, '-')) FROM d) AS u_d, (SELECT count(DISTINCT coalesce('+' || text, '-')) FROM a) AS u_a)
SELECT 'first' AS run, n_d AS n_rows, u_d AS encoded, n_d AS same FROM c
UNION ALL SELECT 'appended', n_a, u_a - u_d, n_a FROM c
UNION ALL SELECT 'again', n_a, 0, n_a FROM c
UNION ALL SELECT 'other_prompt', n_a, u_a, n_a FROM c
""")
def q_vector_cache(spark, sf_dir):
    """Texts encoded by runs over documents, over them with conversations, again, and with a prompt; rows whose vector is the encoder's own."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("row_id"), "text")
    talks = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("row_id"), "text")
    rows = materialize(docs.unionByName(talks), "cache-rows")
    cache, encoder, out = VectorCache(spark, scratch_path(spark, "vector-cache")), HashEncoder(DIM), None
    for run, data, prompt in (("first", rows.where(F.col("row_id").startswith("d")), None), ("appended", rows, None), ("again", rows, None),
                              ("other_prompt", rows, PROMPT)):
        got = cache.encode(data, encoder, prompt=prompt)
        # vectors meet by id, so that no text is shuffled for the comparison
        own = encode_text(data, encoder, prompt=prompt, out="own").select("row_id", "own")
        both = got.rows.select("row_id", "embedding").join(own, "row_id")
        counts = both.agg(F.lit(run).alias("run"), F.count(F.lit(1)).alias("n_rows"), F.lit(got.encoded).cast("long").alias("encoded"),
                         F.count_if(F.col("own") == F.col("embedding")).alias("same"))
        out = counts if out is None else out.unionByName(counts)
    return out


@query("decode_labels", f"""
WITH {clean_cte()},
{codes_cte()}
SELECT c.row_id, coalesce(codes.label, -1) AS label, codes.value AS value FROM c LEFT JOIN codes ON c.target = codes.value
""")
def q_decode_labels(spark, sf_dir):
    coded, codes = factorize(cleaned_documents(spark, sf_dir))
    return decode_labels(coded.select("row_id", "label"), codes).select("row_id", "label", "value")


@query("stream_hash_encode", f"""
WITH c AS (
  SELECT doc_id AS row_id, text FROM documents WHERE text IS NOT NULL AND text NOT IN ({NULL_LIST})
),
{hash_encode_cte(PROMPT, DIM)}
SELECT id AS doc_id, bucket, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value FROM enc
""")
def q_stream_hash_encode(spark, sf_dir):
    """The documents table (a file, or a folder of parts) as a stream: null rule, prompt, encode — processed by a checkpointed query."""
    stream = stream_corpus(spark, f"{sf_dir.rstrip('/')}/documents.parquet", "doc_id LONG, text STRING")
    encoded = encode_stream(stream, HashEncoder(DIM), prompt=PROMPT)
    out = run_to_table(encoded, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt"))
    enc = spark.read.schema(encoded.schema).parquet(out)
    long = enc.select("doc_id", F.posexplode("embedding").alias("bucket", "v"))
    return long.where(F.col("v") != 0).select("doc_id", "bucket", F.round(F.col("v").cast("double"), 6).alias("value"))


# ---------------------------------------------------------------- model fitting and pipelines (rows-only checks)
from ..operators.cluster import kmeans_best  # noqa: E402
from ..operators.evaluate import evaluate_adapter  # noqa: E402
from ..operators.fit import gd_epochs, gram_stats  # noqa: E402
from ..operators.labels import load_labels  # noqa: E402
from ..session import dropping_shuffles, remove_path, remove_table  # noqa: E402
from ..sources.metadata import (PREPROCESS_SCHEMA, MetricLog, file_fingerprint, preprocess_metadata,  # noqa: E402
                                read_metadata, write_metadata)
from ..sources.vectors import synthetic_pairs, write_embeddings  # noqa: E402
from .infer import infer_corpus, inference_state  # noqa: E402
from .preprocess import corpus_state, ingest_corpus, preprocess_corpus  # noqa: E402
from .train import TrainConfig, train_from_folder, train_pipeline  # noqa: E402


def encoded_pairs(spark, sf_dir):
    """(row_id, base, teacher, label): documents encoded without and with the prompt, target = lang."""
    corpus = cleaned_documents(spark, sf_dir)
    coded, _ = factorize(corpus)
    enc = HashEncoder(DIM)
    base = encode_text(coded.select("row_id", "text", "label"), enc, out="base")
    return materialize(encode_text(base, enc, prompt=PROMPT, out="teacher", spread=False).drop("text"), "pairs")


@query("kmeans_best")
def q_kmeans_best(spark, sf_dir):
    """The cluster of every encoded document in the best of 10 seeded k-means fits (k = classes)."""
    pairs = encoded_pairs(spark, sf_dir)
    k = pairs.select("label").distinct().count()
    preds, _ = kmeans_best(pairs.select("row_id", "label", F.col("base").alias("embedding")), k, seed=42)
    return preds.select("row_id", "label", "cluster")


@query("kmeans_settled", f"""
WITH {clean_cte()}
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT target) AS BIGINT) AS k, CAST(0 AS BIGINT) AS n_moved FROM c
""")
def q_kmeans_settled(spark, sf_dir):
    """Best of 10 seeded k-means fits (k = classes) on the encoded documents: no row is nearer to another cluster's mean."""
    pairs = encoded_pairs(spark, sf_dir)
    k = pairs.select("label").distinct().count()
    preds, _ = kmeans_best(pairs.select("row_id", F.col("base").alias("embedding")), k, seed=42, tol=0.0)
    preds = materialize(preds, "kmeans")
    ids, centers = collect_centers(group_centroids(preds, "cluster"), "cluster")
    nearest = assign_nearest(preds, centers, out="nearest", ids=ids)
    return nearest.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cluster").alias("k"),
                       F.sum((F.col("nearest") != F.col("cluster")).cast("long")).alias("n_moved"))


@query("kmeans_v_measure")
def q_kmeans_v_measure(spark, sf_dir):
    pairs = encoded_pairs(spark, sf_dir)
    k = pairs.select("label").distinct().count()
    preds, info = kmeans_best(pairs.select("label", F.col("teacher").alias("embedding")), k, seed=42)
    v = v_measure(preds, "label", "cluster")
    return v.select(F.lit(k).alias("k"), F.round(F.lit(info["cost"]), 6).alias("cost"), "homogeneity", "completeness",
                    "v_measure")


@query("evaluate_adapter")
def q_evaluate_adapter(spark, sf_dir):
    """Fit on the train split, then loss and V-measures on val (long metrics rows)."""
    pairs = encoded_pairs(spark, sf_dir)
    data = split_rows(pairs)
    model, _ = fit_adapter(data.where(F.col("split") == "train"), "base", "teacher", l2=1e-8)
    metrics = evaluate_adapter(data.where(F.col("split") == "val"), model, "val")
    return spark.createDataFrame([(k, v) for k, v in metrics.items()], "metric STRING, value DOUBLE")


@query("fit_gd")
def q_fit_gd(spark, sf_dir):
    """Ten epochs of Adam (lr 1e-3, batch 64) from the one-pass statistics of the train split."""
    pairs = encoded_pairs(spark, sf_dir)
    train = split_rows(pairs).where(F.col("split") == "train")
    stats = gram_stats(train, "base", "teacher")
    rows = [(e, float(loss), float(lr)) for e, _, loss, lr in
            gd_epochs(stats, 10, 64, {"name": "adam", "lr": 1e-3}, {"name": "cosine", "T_max": 10})]
    return spark.createDataFrame(rows, "epoch INT, train_loss DOUBLE, lr DOUBLE")


TRAIN_SQL = f"""
WITH n AS (SELECT count(*) AS n FROM embeddings), {bounds_cte('n')}
SELECT m AS metric, CASE m WHEN 'rows' THEN CAST(te AS DOUBLE) ELSE 0.0 END AS value
FROM b CROSS JOIN (VALUES ('train_loss'), ('val_loss'), ('test_loss'), ('rows')) AS t(m)
"""


def exact_result(spark, res):
    """Losses (zero where the map is recovered) and training rows of a train run."""
    rows = res.metrics.filter(F.col("metric").endswith("_loss")).select("metric", F.abs(F.round("value", 6)).alias("value"))
    return rows.unionByName(spark.createDataFrame([("rows", float(res.summary["rows"]))], "metric STRING, value DOUBLE"))


@query("train_pipeline")
def q_train_pipeline(spark, sf_dir):
    """Whole train pipeline on the encoded documents: every logged metric (losses, V-measures, quality gap, latencies)."""
    pairs = encoded_pairs(spark, sf_dir)
    res = train_pipeline(spark, pairs.select("row_id", F.col("base").alias("embedding")), pairs.select("row_id", F.col("teacher").alias("embedding")),
                         pairs.select("row_id", "label"), TrainConfig(solver="normal", l2=1e-8), out_dir=scratch_path(spark, "train"), teacher_latency_sec=1.0)
    return res.metrics.select("stage", "epoch", "metric", "value")


@query("train_pipeline_exact", TRAIN_SQL)
def q_train_pipeline_exact(spark, sf_dir):
    """Whole train pipeline on a teacher that is an affine map of the vectors: it is recovered."""
    emb = with_teacher(spark, embeddings(spark, sf_dir).select(F.col("vec_id").alias("row_id"), "embedding", "label"))
    emb = materialize(emb, "analytic")
    res = train_pipeline(spark, emb.select("row_id", "embedding"), emb.select("row_id", F.col("teacher").alias("embedding")),
                         emb.select("row_id", F.col("label").cast("long").alias("label")), TrainConfig(solver="normal"),
                         out_dir=scratch_path(spark, "train"))
    return exact_result(spark, res)


@query("train_from_folder", TRAIN_SQL)
def q_train_from_folder(spark, sf_dir):
    """The same from stored vectors, labels and the record beside them."""
    folder = scratch_path(spark, "stored")
    emb = with_teacher(spark, embeddings(spark, sf_dir).select(F.col("vec_id").alias("row_id"), "embedding", "label"))
    write_embeddings(emb, folder, "base")
    write_embeddings(emb, folder, "instruct", vec_col="teacher")
    emb.select("row_id", F.col("label").cast("long").alias("label")).write.parquet(f"{folder}/labels")
    write_metadata(preprocess_metadata(spark, {"num_samples": 1, "instruct_encode_seconds": 2.0}), f"{folder}/metadata")
    res = train_from_folder(spark, folder, TrainConfig(solver="normal"))
    if not res.metrics.filter("metric = 'latency_speedup'").count():
        raise AssertionError("the stored teacher latency was not used")
    # stored vectors are float32: the map is recovered to their precision
    return exact_result(spark, res)


@query("load_labels", f"""
WITH {clean_cte()}, {codes_cte()}
SELECT c.row_id, coalesce(codes.label, -1) AS stored, coalesce(codes.label, -1) AS from_npy, c.row_id AS own_class
FROM c LEFT JOIN codes ON c.target = codes.value
""")
def q_load_labels(spark, sf_dir):
    """Stored labels as a table and as ``.npy``, and rows as their own classes where there are none."""
    coded, _ = factorize(cleaned_documents(spark, sf_dir))
    folder = scratch_path(spark, "labels")
    coded.select("row_id", "label").write.parquet(f"{folder}/labels")
    rows = spark.read.parquet(f"{folder}/labels")
    write_npy(rows, f"{folder}/labels.npy", "row_id", "label", "labels")
    ids = rows.select("row_id")
    a = load_labels(spark, f"{folder}/labels", ids).withColumnRenamed("label", "stored")
    b = load_labels(spark, f"{folder}/labels.npy", ids).withColumnRenamed("label", "from_npy")
    return a.join(b, "row_id").join(load_labels(spark, None, ids).withColumnRenamed("label", "own_class"), "row_id")


@query("adapter_roundtrip", f"""
SELECT CAST(o.i AS INTEGER) AS out_idx, CAST(p.j AS INTEGER) AS pos, round({analytic_w('o.i', 'p.j')}, 6) AS weight, 0.25::DOUBLE AS bias,
       (SELECT count(*) FROM embeddings) AS n_vectors
FROM range({DIM}) AS o(i) CROSS JOIN range({DIM}) AS p(j)
""")
def q_adapter_roundtrip(spark, sf_dir):
    """The map that is the teacher of the stored vectors, fitted from them, saved and loaded."""
    emb = materialize(with_teacher(spark, embeddings(spark, sf_dir).select("vec_id", "embedding")), "analytic")
    model, stats = fit_adapter(emb, "embedding", "teacher")
    loaded = type(model).load(spark, model.save(spark, scratch_path(spark, "adapter")))
    rows = loaded.to_frame(spark).select("out_idx", F.posexplode("weights").alias("pos", "weight"), "bias")
    return rows.select("out_idx", "pos", F.round("weight", 6).alias("weight"), F.round("bias", 6).alias("bias"), F.lit(int(stats.n)).alias("n_vectors"))


@query("metric_log", """
SELECT 'rows_' || source AS metric, CAST(count(*) AS DOUBLE) AS value, 'count' AS stage, '20' AS param FROM documents GROUP BY source
""")
def q_metric_log(spark, sf_dir):
    """Counts of documents by source through the metric table and back, with the run's parameters."""
    counts = table(spark, sf_dir, "documents").groupBy("source").count().collect()  # one row a source
    path = scratch_path(spark, "runs")
    log = MetricLog(spark, path)
    log.log_params(sources=len(counts))
    for r in counts:
        log.log(f"rows_{r['source']}", r["count"], "count")
    log.flush()
    params = spark.read.parquet(f"{path}/params").select("run_id", F.get_json_object("params", "$.sources").alias("param"))
    return spark.read.parquet(f"{path}/metrics").join(params, "run_id").select("metric", "value", "stage", "param")


@query("resolve_instruction", """
SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), nullif(source, '')) AS instruction FROM documents
""")
def q_resolve_instruction(spark, sf_dir):
    """The first instruction that is given: an empty one counts as missing."""
    docs = table(spark, sf_dir, "documents")
    own = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang"))
    return docs.select("doc_id", resolve_instruction_col(own, F.col("source")).alias("instruction"))


@query("null_targets", f"""
WITH d AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' WHEN 2 THEN '' ELSE lang END AS target FROM documents),
{clean_cte(target="target", source="d")}, {codes_cte()}
SELECT c.row_id, c.doc_id, c.target, coalesce(codes.label, -1) AS label FROM c LEFT JOIN codes ON c.target = codes.value
""")
def q_null_targets(spark, sf_dir):
    """Targets that are missing-value tokens are missing and have code -1."""
    m = F.col("doc_id") % 4
    target = F.when(m == 0, "NA").when(m == 1, "null").when(m == 2, "").otherwise(F.col("lang"))
    docs = table(spark, sf_dir, "documents").withColumn("target", target)
    cleaned = materialize(clean_corpus(docs, "text", "target", order_col="doc_id"), "corpus")
    coded, _ = factorize(cleaned)
    return coded.select("row_id", "doc_id", "target", "label")


@query("split_sizes_small", """
WITH k AS (SELECT unnest(range(1, 11)) AS n),
r AS (SELECT k.n, CAST(s.n_nationkey AS BIGINT) AS row_id,
             rank() OVER (PARTITION BY k.n ORDER BY md5('42:' || CAST(s.n_nationkey AS VARCHAR)), s.n_nationkey) - 1 AS rk
      FROM k JOIN nation s ON s.n_nationkey < k.n),
p AS (SELECT *, CASE WHEN n = 1 THEN ['train', 'val', 'test'] WHEN n = 2 THEN CASE WHEN rk = 0 THEN ['train'] ELSE ['val', 'test'] END
             WHEN n = 3 THEN [['train', 'test', 'val'][rk + 1]]
             WHEN rk < greatest(1, CAST(trunc(0.7::DOUBLE / 1.0 * n) AS BIGINT)) THEN ['train']
             WHEN rk < least(n - 1, greatest(greatest(1, CAST(trunc(0.7::DOUBLE * n) AS BIGINT)) + 1, CAST(trunc(0.9::DOUBLE * n) AS BIGINT))) THEN ['val']
             ELSE ['test'] END AS splits FROM r)
SELECT CAST(n AS INTEGER) AS n, row_id, CAST(rk AS BIGINT) AS rank, unnest(splits) AS split FROM p
""")
def q_split_sizes_small(spark, sf_dir):
    """Exact splits of one to ten rows: the layouts of tables too small for three ranges, and the first regular ones."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"))
    parts = [assign_split(nation.filter(F.col("row_id") < n)).withColumn("n", F.lit(n)) for n in range(1, 11)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("n", "row_id", "rank", "split")


@query("ingest_corpus", """
SELECT CAST(rank() OVER (ORDER BY source, doc_id) - 1 AS BIGINT) AS row_id, source AS split, doc_id, md5(text) AS text_md5 FROM documents
""")
def q_ingest_corpus(spark, sf_dir):
    """Every source of documents as a CSV of its own, joined into one corpus file and read back in input order."""
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "ingest", order="doc_id")
    folder = scratch_path(spark, "splits")
    names = [r["source"] for r in docs.select("source").distinct().orderBy("source").collect()]
    for i, name in enumerate(names):
        write_corpus_csv(docs.filter(F.col("source") == name).orderBy("doc_id"), f"{folder}/{name}.csv")
    paths = {name: f"{folder}/{name}.csv" for name in names}
    out = ingest_corpus(spark, paths | {"missing": f"{folder}/missing.csv"}, names + ["missing"], f"{folder}/corpus.csv")
    rows = read_corpus_csv(spark, out)
    ids = key_rank(rows.select("_order"), "_order", rank_col="row_id")
    return rows.join(ids, "_order").select("row_id", F.col("source").alias("split"), F.col("doc_id").cast("long").alias("doc_id"),
                                           F.md5("text").alias("text_md5"))


CACHE_SCENARIOS = {"same": True, "reordered": False, "changed_target": False, "swapped_duplicates": False, "other_instruction": False,
                   "other_encoder": False, "infer_same": True, "teacher_on": False, "adapter_resaved": False, "output_removed": False}


@query("cache_rules", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(v).lower()})" for k, v in CACHE_SCENARIOS.items())
       + ") AS t(scenario, hit) WHERE (SELECT count(*) FROM documents) > 0")
def q_cache_rules(spark, sf_dir):
    """What the two pipelines take for already done, after a run over documents: nothing but the very same run.

    Only the answers are kept: the runs' files and every variant's table go as soon as no later probe reads them.
    """
    docs, enc, found = table(spark, sf_dir, "documents"), HashEncoder(16), {}
    out = scratch_path(spark, "cache-rules")
    with dropping_shuffles(spark):
        emb = preprocess_corpus(spark, docs, out, enc, PROMPT, "text", "lang", order_col="doc_id")["embeddings"]
        remove_path(spark, f"{out}/processed")  # no probe looks at the corpus files
        variants = {"same": (docs, "lang", PROMPT, enc), "reordered": (docs.withColumn("doc_id", -F.col("doc_id")), "lang", PROMPT, enc),
                    "changed_target": (docs, "source", PROMPT, enc), "other_instruction": (docs, "lang", PROMPT + "?", enc),
                    "other_encoder": (docs, "lang", PROMPT, HashEncoder(32))}
        for name, (rows, target, prompt, encoder) in variants.items():
            cleaned = materialize(clean_corpus(rows, "text", target, order_col="doc_id").select("row_id", "text", "target"), "cache-rules")
            found[name] = corpus_state(spark, cleaned, emb, encoder, prompt)[3] is not None
            remove_table(cleaned)
        # the first two rows alike, once with either text: a hash of their difference would not see it
        cleaned = clean_corpus(docs, "text", "lang", order_col="doc_id").select("row_id", "text", "target")
        first = {r["row_id"]: r["text"] for r in cleaned.filter("row_id < 2").collect()}
        alike = [cleaned.withColumn("text", F.when(F.col("row_id") < 2, F.lit(first[i])).otherwise(F.col("text"))) for i in (0, 1)]
        keys = [corpus_state(spark, a, emb, enc, PROMPT)[0] for a in alike]
        found["swapped_duplicates"] = keys[0] == keys[1]

        model = analytic_teacher_model(16)
        ckpt = model.save(spark, f"{out}/adapter")
        run = lambda: infer_corpus(spark, "documents", f"{out}/infer", ckpt, enc, PROMPT, corpus=docs, order_col="doc_id", teacher=False)
        run()
        rows = materialize(clean_corpus(docs, "text", None, order_col="doc_id", deduplicate=False).select("row_id", "text"), "cache-rules")
        state = lambda m, teacher: inference_state(spark, rows, f"{out}/infer", m, enc, PROMPT, teacher, text_column="text")[3] is not None
        found["infer_same"], found["teacher_on"] = state(model, False), state(model, True)
        analytic_teacher_model(16, 0.5).save(spark, ckpt)
        found["adapter_resaved"] = state(type(model).load(spark, ckpt), False)
        remove_path(spark, f"{out}/infer/adapter")
        found["output_removed"] = state(model, False)
        remove_table(rows)
        remove_path(spark, out)
    return spark.createDataFrame([(k, found[k]) for k in CACHE_SCENARIOS], "scenario STRING, hit BOOLEAN")


@query("preprocess_corpus", f"""
WITH {clean_cte()},
h AS (SELECT * FROM c),
{codes_cte(src="h")},
{hash_encode_cte(None, DIM, name="b", source="h")},
{hash_encode_cte(PROMPT, DIM, name="i", source="h")},
v AS (SELECT 'base' AS kind, * FROM b UNION ALL SELECT 'instruct', * FROM i)
SELECT v.kind, v.id AS row_id, coalesce(codes.label, -1) AS label, v.bucket, round(CAST(CAST(v.value AS FLOAT) AS DOUBLE), 6) AS value,
       (SELECT count(*) FROM h) AS num_samples, {DIM} AS embedding_dim
FROM v JOIN h ON v.id = h.row_id LEFT JOIN codes ON h.target = codes.value
""")
def q_preprocess_corpus(spark, sf_dir):
    """Preprocess the whole documents table (target = lang): labels, both vector sets and the record, read back."""
    out = scratch_path(spark, "preprocess")
    docs = table(spark, sf_dir, "documents")
    res = preprocess_corpus(spark, docs, out, HashEncoder(DIM), PROMPT, "text", "lang", order_col="doc_id")
    emb = res["embeddings"]
    labels, meta = spark.read.parquet(f"{emb}/labels"), read_metadata(spark, f"{emb}/metadata", PREPROCESS_SCHEMA)
    parts = [spark.read.parquet(f"{emb}/{kind}").withColumn("kind", F.lit(kind)) for kind in ("base", "instruct")]
    long = parts[0].unionByName(parts[1]).select("kind", "row_id", F.posexplode("embedding").alias("bucket", "v")).filter("v != 0")
    return long.join(labels, "row_id").select("kind", "row_id", "label", "bucket", F.round(F.col("v").cast("double"), 6).alias("value"),
                                              F.lit(meta["num_samples"]).cast("long").alias("num_samples"), F.lit(meta["embedding_dim"]).alias("embedding_dim"))


@query("infer_corpus", f"""
WITH c AS (
  SELECT CAST(rank() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS row_id, text
  FROM conversations WHERE text IS NOT NULL AND text NOT IN ({NULL_LIST})
),
{hash_encode_cte(None, DIM, name="b")},
{hash_encode_cte(PROMPT, DIM, name="t")},
a AS (
  SELECT r.row_id AS id, CAST(o.i AS INTEGER) AS bucket,
         coalesce(sum({analytic_w('o.i', 'b.bucket')} * CAST(CAST(b.value AS FLOAT) AS DOUBLE)), 0) + 0.25 AS value
  FROM c r CROSS JOIN range({DIM}) AS o(i) LEFT JOIN b ON b.id = r.row_id GROUP BY ALL
),
v AS (SELECT 'base' AS kind, * FROM b UNION ALL SELECT 'teacher', * FROM t UNION ALL SELECT 'adapter', * FROM a)
SELECT kind, id AS row_id, bucket, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value FROM v WHERE CAST(value AS FLOAT) <> 0
""")
def q_infer_corpus(spark, sf_dir):
    """Conversations as an inference CSV through a saved adapter: base, adapted and teacher vectors."""
    ckpt = analytic_teacher_model(DIM).save(spark, scratch_path(spark, "adapter"))
    csv = scratch_path(spark, "conversations-csv")
    conv = table(spark, sf_dir, "conversations")
    write_corpus_csv(conv.orderBy("conv_id", "turn").select("conv_id", "turn", "role", "text"), csv)
    out = scratch_path(spark, "infer")
    infer_corpus(spark, csv, out, ckpt, HashEncoder(DIM), PROMPT, "text")
    parts = [spark.read.parquet(f"{out}/{kind}").withColumn("kind", F.lit(kind)) for kind in ("base", "adapter", "teacher")]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "row_id", F.posexplode("embedding").alias("bucket", "v"))
    return long.where(F.col("v") != 0).select("kind", "row_id", "bucket", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("synthetic_pairs")
def q_synthetic_pairs(spark, sf_dir):
    """Seeded synthetic linear pairs keyed by the embedding ids (dims 64 → 64)."""
    ids = embeddings(spark, sf_dir).select(F.col("vec_id").alias("row_id"))
    pairs = synthetic_pairs(ids, DIM, DIM, seed=42)
    return pairs.select("row_id", F.size("base").alias("base_dim"), F.size("target").alias("target_dim"),
                        F.round(F.col("base")[0].cast("double"), 6).alias("base0"))


@query("file_fingerprint")
def q_file_fingerprint(spark, sf_dir):
    """MD5 of a written corpus CSV folder (parts hashed, then hashed in path order)."""
    path = scratch_path(spark, "fp-csv")
    write_corpus_csv(table(spark, sf_dir, "documents").orderBy("doc_id").select("doc_id", "text"), path)
    return spark.createDataFrame([(file_fingerprint(spark, path),)], "file_hash STRING")


# ---------------------------------------------------------------- batches and path stems
from ..functions.text import path_stem  # noqa: E402
from ..operators.ordering import epoch_batches  # noqa: E402


@query("batch_ids", """
SELECT vec_id, CAST(rank() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS rank,
       CAST((rank() OVER (ORDER BY vec_id) - 1) // 64 AS BIGINT) AS batch_id
FROM embeddings
""")
def q_batch_ids(spark, sf_dir):
    """Fixed-size batches of 64 in row order."""
    ranked = key_rank(embeddings(spark, sf_dir).select("vec_id"), "vec_id", rank_col="rank")
    return with_batch_id(ranked, 64).select("vec_id", "rank", "batch_id")


@query("epoch_batches", """
SELECT CAST(e.epoch AS INTEGER) AS epoch, v.vec_id,
       CAST((rank() OVER (PARTITION BY e.epoch ORDER BY md5('42:' || e.epoch || ':' || CAST(v.vec_id AS VARCHAR)),
                                                  v.vec_id) - 1) // 64 AS BIGINT) AS batch_id
FROM embeddings v CROSS JOIN (VALUES (0), (1), (2)) AS e(epoch)
""")
def q_epoch_batches(spark, sf_dir):
    """Per-epoch reshuffled batches of 64 for three epochs."""
    ids = embeddings(spark, sf_dir).select("vec_id")
    out = None
    for epoch in range(3):
        b = epoch_batches(ids, 64, epoch, seed=42, id_col="vec_id").select(
            F.lit(epoch).alias("epoch"), "vec_id", "batch_id")
        out = b if out is None else out.unionByName(b)
    return out


@query("path_stem", r"""
SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem FROM pages
""")
def q_path_stem(spark, sf_dir):
    """Run-name stems of page URLs."""
    return table(spark, sf_dir, "pages").select("page_id", path_stem("url").alias("stem"))
