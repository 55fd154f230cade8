"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base entities (e-mail, IP address, payment card, telephone) come from their own forms. They are the seeds:
the words around each occurrence and the shape of the token (an at sign, or how many digits) make lexical patterns ("card number is <12-19
digits>"), and all other tokens that look like identifiers are instances of the patterns around them. Spark
scores the graph of patterns and instances in rounds: a pattern is worth the share of its distinct instances
that are known, an instance the joint odds of its good patterns. What good patterns then hold is found as
well, though its form alone does not tell.

Offsets are in code points, the end exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, let, small, whole_text

KINDS = ("email", "ip", "card", "phone")
#: The contract's forms. Possessive, since none ever needs to give back, and begun only where a longer match
#: can't have begun before, so that no text takes quadratic time or deep recursion.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # from 12 digits on: shorter matches fail in any case
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A word with a digit or an at sign, and the words of digits right behind it.
IDENTIFIER = (r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
              r"(?:\x20[(+]?[0-9][0-9().+-]*+(?![^\x20\x09-\x0D]))*+")
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
#: Code points of context that are looked at on either side.
CONTEXT = 80


MATCH = "struct<start:int,end:int,value:string,before:string,after:string>"


def stretches(array: str, reach: str) -> str:
    """SQL: ``first, at`` of stretches of ``array``, about the root of its size of them and as long each.

    An array that grows by one element is copied each time. What runs along ``n`` elements goes over stretches first, and
    inside each over its own elements, so that no array longer than the root of ``n`` grows. ``at`` is what ``reach`` has
    made of the stretches before: SQL of ``acc.at``, the first place ``i`` of a stretch and its length ``{step}``.
    """
    step = f"cast(greatest(ceil(sqrt(size({array}))), 1) as int)"
    starts = f"if(size({array}) > 0, sequence(0, size({array}) - 1, {step}), cast(array() as array<int>))"
    return f"""aggregate({starts}, named_struct('at', 0, 'out', cast(array() as array<struct<first:int,at:int>>)),
        (acc, i) -> named_struct('at', {reach.format(step=step)}, 'out', concat(acc.out, array(named_struct('first', i, 'at', acc.at)))), acc -> acc.out)"""


def matches(text: str, pattern: str) -> Column:
    """All matches in ``text`` (SQL) as an array of structs ``start, end, value, before, after``; the last two the text between them."""
    length = "aggregate(slice(f.{0}, i + 1, {{step}}), 0, (n, x) -> n + length(x))"
    bases = stretches("f.hits", f"acc.at + {length.format('hits')} + {length.format('gaps')}")
    start = "acc.at + length(get(f.gaps, i))"
    stop = f"{start} + length(get(f.hits, i))"
    return F.expr(f"""
        transform(array(named_struct('hits', regexp_extract_all({text}, r'{pattern}', 0), 'gaps', split({text}, r'{pattern}', -1))), f -> flatten(transform({bases}, s ->
            aggregate(sequence(s.first, least(s.first + cast(greatest(ceil(sqrt(size(f.hits))), 1) as int), size(f.hits)) - 1),
                named_struct('at', s.at, 'out', cast(array() as array<{MATCH}>)),
                (acc, i) -> named_struct('at', {stop}, 'out', concat(acc.out, array(named_struct('start', {start}, 'end', {stop},
                    'value', get(f.hits, i), 'before', get(f.gaps, i), 'after', get(f.gaps, i + 1))))), acc -> acc.out))))[0]""")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(sql: str) -> Column:
    """Base entities of a text (SQL), sorted: an array of ``start, rank, end, kind``."""
    text = F.expr(sql)
    has_digit = text.rlike("[0-9]")
    worth = {"email": text.contains("@"), "ip": has_digit & text.contains("."), "card": has_digit, "phone": has_digit & text.contains("+")}
    parts = []
    for rank, kind in enumerate(KINDS):
        parts.append(F.when(worth[kind], _spans_of_kind(sql, rank, kind)).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.array_sort(F.concat(*parts))


def _spans_of_kind(text: str, rank: int, kind: str) -> Column:
    good = F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
    span = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return span.cast(f"array<{SPAN}>")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words_of(gap: Column, last: bool) -> Column:
    part = F.substring(gap, F.greatest(F.length(gap) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)) if last else F.substring(gap, F.lit(1), F.lit(CONTEXT))
    return F.filter(F.split(F.lower(part), r"[^\p{L}]+"), lambda w: w != "")


def occurrences(rows: DataFrame) -> DataFrame:
    """Identifier-like tokens of ``rows`` (``doc_id, digest, text_, base``): place, instance, patterns, and the kind if a base entity covers it."""
    worth = F.col("text_").rlike("[0-9@]")
    found = rows.filter(worth).select("doc_id", "digest", "base", F.explode(matches("text_", IDENTIFIER)).alias("m"))
    lead = F.length(F.regexp_extract("m.value", r"^[^\p{L}0-9+]*", 0))
    core = F.regexp_replace(F.regexp_replace("m.value", r"^[^\p{L}0-9+]+", ""), r"[^\p{L}0-9]+$", "")
    found = found.select("doc_id", "digest", "base", (F.col("m.start") + lead).alias("start"), core.alias("instance"),
                         _words_of(F.col("m.before"), True).alias("left"), _words_of(F.col("m.after"), False).alias("right"))
    found = found.filter(F.length("instance") > 0).withColumn("end", F.col("start") + F.length("instance"))
    cover = F.filter("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    n = F.length(_digits(F.col("instance")))
    size = F.when(n < 5, "1-4").when(n < 9, "5-8").when(n < 12, "9-11").when(n < 20, "12-19").otherwise("20+")
    shape = F.when(F.col("instance").contains("@"), "@").otherwise(F.concat(F.when(F.col("instance").rlike(r"\p{L}"), "a").otherwise(""), size))
    near = F.concat_ws(" ", F.slice("left", F.greatest(F.size("left") - 1, F.lit(1)), F.lit(2)))
    one = F.coalesce(F.element_at(F.when(F.size("left") > 0, F.col("left")), -1), F.lit(""))
    after = F.coalesce(F.get("right", F.lit(0)), F.lit(""))
    patterns = F.array_distinct(F.array(F.concat_ws("|", near, shape, F.lit("")), F.concat_ws("|", one, shape, after)))
    return found.select("doc_id", "digest", "start", "end", F.lower("instance").alias("instance"), patterns.alias("patterns"),
                        F.when(F.size(cover) > 0, F.get(cover, F.lit(0))["kind"]).alias("kind"))


def _confidence(edges: DataFrame, sizes: DataFrame, known: DataFrame, support: int) -> DataFrame:
    """``pattern, kind, confidence`` of patterns with at least ``support`` known distinct instances."""
    mass = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
    return mass.filter(F.col("mass") >= support).join(sizes, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("size") + 1)).alias("confidence"))


def discover(found: DataFrame, rounds: int = 2, support: int = 3, least: float = 0.7) -> DataFrame:
    """``doc_id, digest, start, end, kind`` of tokens outside base entities that good patterns hold.

    ``found``: written occurrences. A pattern is good if at least ``least`` of its distinct instances (plus one) are
    known, at least ``support`` of them; an instance is known from an odds of ``least``.
    """
    edges = materialize(found.select("instance", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    sizes = materialize(edges.groupBy("pattern").agg(F.count("*").alias("size")).filter(F.col("size") >= support), "pii-sizes")
    seeds = found.filter("kind is not null").groupBy("instance", "kind").agg(F.lit(1.0).alias("score"))
    known = seeds = materialize(seeds, "pii-seeds")
    good = None
    for i in range(rounds):
        good = materialize(_confidence(edges, sizes, known, support).filter(F.col("confidence") >= least), f"pii-patterns{i}")
        reached = edges.join(small(good), "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))).alias("score")).filter(F.col("score") >= least)
        known = materialize(seeds.unionByName(reached).groupBy("instance", "kind").agg(F.max("score").alias("score")), f"pii-known{i}")
    held = found.filter("kind is null").select("doc_id", "digest", "start", "end", F.explode("patterns").alias("pattern"))
    held = held.join(small(good), "pattern")
    best = held.groupBy("doc_id", "digest", "start", "end").agg(F.max(F.struct("confidence", F.col("kind").alias("k"))).alias("best"))
    return best.select("doc_id", "digest", "start", "end", F.col("best.k").alias("kind"))


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, support: int = 3,
                       least: float = 0.7, base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """``docs`` with ``base_col`` (base entities) and ``spans_col`` (these and what the patterns add), sorted arrays of structs.

    Null texts count as empty. Rows with equal id and text get equal spans. Columns of ``docs`` by the names
    of the new ones are replaced. An empty table gives an empty result.
    """
    text = whole_text(text_col)
    digest = F.xxhash64(text)
    mine = docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), text.alias("text_")).withColumn("base", base_spans("text_"))
    found = materialize(occurrences(mine), "pii-tokens")
    more = discover(found, rounds, support, least)
    rank = reduce(lambda c, k: F.when(F.col("kind") == k[1], k[0]).otherwise(c), enumerate(KINDS), F.lit(len(KINDS)))
    span = F.struct(F.col("start").cast("int").alias("start"), rank.cast("int").alias("rank"), F.col("end").cast("int").alias("end"), "kind").cast(SPAN)
    other_id, other_digest, other = fresh(docs, "id_"), fresh(docs, "digest_"), fresh(docs, "added_")
    added = more.groupBy(F.col("doc_id").alias(other_id), F.col("digest").alias(other_digest)).agg(F.collect_list(span).alias(other))
    added = materialize(added, "pii-added")
    out = docs.drop(base_col, spans_col).withColumn(base_col, base_spans(f"coalesce(`{text_col}`, '')"))
    out = out.join(small(added), F.col(id_col).eqNullSafe(F.col(other_id)) & (digest == F.col(other_digest)), "left")
    spans = F.array_sort(F.concat(F.col(base_col), F.coalesce(F.col(other), F.array().cast(f"array<{SPAN}>"))))
    return out.withColumn(spans_col, spans).drop(other_id, other_digest, other)


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base entities by kind, their digest, and all spans as text."""
    return found.select(F.col(id_col).alias("doc_id"), *(_count(k).alias(f"n_{k}") for k in KINDS),
                        F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``found`` with every span of its text replaced by ``[KIND]``, overlapping spans by that of the first."""
    kept = "array<struct<from:int,to:int,kind:string>>"
    bases = stretches("x.spans", "greatest(acc.at, array_max(transform(slice(x.spans, i + 1, {step}), s -> s.`end`)))")
    # of each stretch the spans that begin behind all before them, and where the text kept before each begins; the text of a stretch is cut
    # out of the whole once, its pieces out of that
    parts = f"""transform({bases}, s -> aggregate(slice(x.spans, s.first + 1, cast(greatest(ceil(sqrt(size(x.spans))), 1) as int)),
        named_struct('at', s.at, 'out', cast(array() as {kept})), (acc, e) -> named_struct('at', greatest(acc.at, e.`end`), 'out', if(e.start < acc.at, acc.out,
            concat(acc.out, array(named_struct('from', acc.at, 'to', e.start, 'kind', e.kind))))), acc -> acc.out))"""
    cut = "substring(x.text, p[0].`from` + 1, p[size(p) - 1].`to` - p[0].`from`)"
    piece = "concat(substring(t, s.`from` - p[0].`from` + 1, s.`to` - s.`from`), '[', upper(s.kind), ']')"
    whole = f"""array_join(transform(filter({parts}, p -> size(p) > 0), p -> transform(array({cut}), t -> array_join(transform(p, s -> {piece}), ''))[0]), '')"""
    tail = "substring(x.text, array_max(transform(x.spans, s -> s.`end`)) + 1, length(x.text))"
    both = f"named_struct('text', `{text_col}`, 'spans', `{spans_col}`)"
    return found.withColumn(text_col, F.expr(f"transform(array({both}), x -> if(size(x.spans) > 0, concat({whole}, {tail}), x.text))[0]"))
