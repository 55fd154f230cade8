"""DuckDB SQL for every registered query: the correctness oracle.

Each string runs on views named after the driver tables. Shared CTE text is
built by the helpers below; numbers are rounded the same way as in the Spark
queries (6 decimals, fitted weights 4).
"""

from __future__ import annotations

from ..functions.text import NULL_TOKENS

# fixed value: the instruction prompt
PROMPT = "Instruct: Identify the topic of this news article. Query: "


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NULL_LIST = ", ".join(_sql_str(t) for t in NULL_TOKENS)


def clean_cte(target: str = "lang", source: str = "documents", order: str = "doc_id",
              name: str = "c") -> str:
    """Cleaned corpus ``(row_id, <order>, text, target)`` as CTE ``name``."""
    return f"""
{name}_raw AS (
  SELECT {order}, CASE WHEN text IN ({NULL_LIST}) THEN NULL ELSE text END AS text,
         CASE WHEN CAST({target} AS VARCHAR) IN ({NULL_LIST}) THEN NULL ELSE CAST({target} AS VARCHAR) END AS target
  FROM {source}
),
{name}_first AS (
  SELECT min({order}) AS {order} FROM {name}_raw WHERE text IS NOT NULL GROUP BY text
),
{name} AS (
  SELECT CAST(rank() OVER (ORDER BY {order}) - 1 AS BIGINT) AS row_id, {order}, text, target
  FROM {name}_raw WHERE {order} IN (SELECT {order} FROM {name}_first)
)"""


def bounds_cte(n_source: str, train: float = 0.7, val: float = 0.2, test: float = 0.1,
               name: str = "b") -> str:
    """``(n, te, ve)``: train end and val end, same double arithmetic as numpy."""
    s = f"({train}::DOUBLE + {val}::DOUBLE + {test}::DOUBLE)"
    return f"""
{name}_r AS (
  SELECT n, {train}::DOUBLE / {s} AS r0, {val}::DOUBLE / {s} AS r1 FROM {n_source}
),
{name}_t AS (
  SELECT n, greatest(1, CAST(trunc(r0 * n) AS BIGINT)) AS te, r0, r1 FROM {name}_r
),
{name}_v AS (
  SELECT n, te, greatest(te + 1, CAST(trunc((r0 + r1) * n) AS BIGINT)) AS ve FROM {name}_t
),
{name} AS (
  SELECT n, te, CASE WHEN ve >= n THEN greatest(te + 1, n - 1) ELSE ve END AS ve FROM {name}_v
)"""


def seeded_rank_sql(id_col: str, seed: str = "42") -> str:
    return (f"CAST(rank() OVER (ORDER BY md5('{seed}:' || CAST({id_col} AS VARCHAR)), {id_col}) - 1"
            " AS BIGINT)")


def split_case(rank: str = "rank", b: str = "b") -> str:
    return (f"CASE WHEN {rank} < {b}.te THEN 'train' WHEN {rank} < {b}.ve THEN 'val' "
            "ELSE 'test' END")


def codes_cte(src: str = "c", name: str = "codes") -> str:
    return f"""
{name} AS (
  SELECT target AS value, CAST(rank() OVER (ORDER BY min(row_id)) - 1 AS BIGINT) AS label
  FROM {src} WHERE target IS NOT NULL GROUP BY target
)"""


def hash_encode_cte(prompt: str | None, dim: int = 64, name: str = "enc",
                    source: str = "c", id_col: str = "row_id") -> str:
    """Long form ``(id, bucket, value)`` of the hash encoder, zero entries left out."""
    pre = _sql_str(prompt) + " || " if prompt else ""
    return f"""
{name}_tok AS (
  SELECT {id_col} AS id, unnest(list_filter(string_split_regex(lower({pre}text), '[ \\t\\n\\r\\f]+'),
                                      lambda w: w <> '')) AS w
  FROM {source}
),
{name}_h AS (
  SELECT id, md5(w) AS h FROM {name}_tok
),
{name}_s AS (
  SELECT id, CAST(('0x' || substr(h, 1, 8))::BIGINT % {dim} AS INTEGER) AS bucket,
         sum(CASE WHEN ('0x' || substr(h, 9, 1))::INTEGER < 8 THEN 1.0 ELSE -1.0 END) AS v
  FROM {name}_h GROUP BY ALL
),
{name}_n AS (
  SELECT id, greatest(sqrt(sum(v * v)), 1e-12) AS norm FROM {name}_s GROUP BY id
),
{name} AS (
  SELECT s.id, s.bucket, s.v / n.norm AS value FROM {name}_s s JOIN {name}_n n USING (id) WHERE s.v <> 0
)"""


def emb_long_cte(name: str = "e") -> str:
    """Embeddings in long form ``(vec_id, pos, x, label)``, pos 0-based."""
    return f"""
{name} AS (
  SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
         CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings
)"""


def analytic_w(i: str, j: str) -> str:
    return f"(sin(CAST({i} AS DOUBLE) * 64 + {j} + 1) / 8)"


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()
