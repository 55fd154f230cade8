"""Column expressions on text (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The strings a pandas CSV read turns into a missing value by
# default. The corpus always passes through CSV, so these count as null.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Fixed value: whitespace class used to split text into tokens.
WHITESPACE = "[ \\t\\n\\r\\f]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_token(c) -> Column:
    """Null when the value is one of the pandas missing-value strings."""
    c = _col(c)
    return F.when(c.isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def with_prompt(text, prompt: str | None) -> Column:
    """Prepend the instruction to every text; no prompt (None or '') → the text."""
    text = _col(text)
    if not prompt:
        return text
    return F.concat(F.lit(prompt), text)


def resolve_instruction(*candidates) -> str | None:
    """First non-empty candidate, else None (``a or b or None``)."""
    for c in candidates:
        if c:
            return c
    return None


def resolve_instruction_col(*cols) -> Column:
    """Column form of :func:`resolve_instruction`: empty strings count as missing."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])


def tokens(text) -> Column:
    """Whitespace tokens of a text, empty tokens dropped."""
    parts = F.split(_col(text), WHITESPACE)
    return F.filter(parts, lambda t: t != F.lit(""))


def truncate_tokens(text, max_tokens: int | None) -> Column:
    """The first ``max_tokens`` whitespace tokens (all when None)."""
    t = tokens(text)
    if max_tokens is None:
        return t
    return F.slice(t, 1, int(max_tokens))


def path_stem(path) -> Column:
    """File name without folder and last extension (``/a/b/x.csv`` → ``x``)."""
    return F.regexp_extract(_col(path), r"([^/]+?)(\.[^./]*)?$", 1)


def row_fingerprint(text) -> Column:
    """MD5 hex of the UTF-8 text."""
    return F.md5(_col(text))


def fingerprint_long(text) -> Column:
    """60-bit integer taken from the MD5 of a text (first 15 hex digits)."""
    return F.conv(F.substring(F.md5(_col(text)), 1, 15), 16, 10).cast("long")
