"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / source_size`` times. The whole copies are sure; the
fractional rest is settled by pivotal steps: two units with fractional copies exchange words, in a random
direction with the odds that keep either's expectation, until one of them holds no copy or one more. A step
keeps the number of words of its pair, so all steps together keep the source's target.

Where the steps run:

* Large documents (over 1 / ``large`` of their source, so less than ``large`` of them) go first, from the
  largest down, each against the pool of all smaller documents of its source: a small document could not
  make up for a large one. What the pool gains or loses shifts the fraction of its documents.
* The others are dealt by hash into buckets of documents of like size (classes of powers of two). Each bucket
  folds, pair by pair, to one residual document, and residuals fold again in a tree with fixed fan-in.
* One bucket of every class is held back. The last fold of a source takes these and the residuals from the
  largest size down, each against the pool of the rest, and so ends with one of its smallest documents: a
  source misses its target by no more than about that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, let, small, whole_text

#: Words are counted in units of 2**-20 while they are exchanged, so that steps are exact.
UNIT_BITS = 20


def source_targets(sizes: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source in and out.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes; a
    target stops at ``cap`` times its source's size and the excess is shared anew by weight. In the order
    of ``cap * size / weight`` the stopped sources are a prefix, so running sums find the common share.
    The windows sort one row per source in one task: the table grows with sources, not with rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("source", "source_size", F.row_number().over(by_name).alias("rank"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    rows = rows.withColumn("share", F.col("left") / F.sum("weight").over(after))
    rows = rows.withColumn("free", F.col("most") > F.col("share") * F.col("weight"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), F.col("rank"), F.col("share")))).over(everything)
    target = F.when(F.col("free"), F.least(first["share"] * F.col("weight"), F.col("most").cast("double"))).otherwise(F.col("most").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def _fold(items: Column, item_type: str) -> Column:
    """One residual and the settled documents of ``items``, an array of structs in the order of the steps."""
    def step(acc: Column, item: Column) -> Column:
        def moved(m: Column) -> Column:
            rise = item["u"] * (m["up"] + m["down"]) < m["down"]
            shift = F.when(rise, m["up"]).otherwise(-m["down"])

            def settle(pair: Column) -> Column:
                held, other = pair["a"], pair["b"]
                settled = (held["y"] == 0) | (held["y"] == held["full"])
                return F.struct(F.when(settled, other).otherwise(held).alias("cur"),
                                F.concat(acc["done"], F.array(F.when(settled, held).otherwise(other))).alias("done"))
            return let(F.struct(acc["cur"].withField("y", acc["cur"]["y"] + shift).alias("a"),
                                item.withField("y", item["y"] - shift).alias("b")), settle)
        room = F.struct(F.least(acc["cur"]["full"] - acc["cur"]["y"], item["y"]).alias("up"),
                        F.least(acc["cur"]["y"], item["full"] - item["y"]).alias("down"))
        return let(room, moved)
    start = F.struct(items[0].alias("cur"), F.array().cast(f"array<{item_type}>").alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), start, step)


def _pool_fold(items: Column, item_type: str, pool: Column) -> Column:
    """All of ``items`` settled one by one, each against the pool of those after it.

    ``pool``: the units that the pool can hold, those of ``items`` included. ``delta`` is what it owes.
    """
    def step(acc: Column, item: Column) -> Column:
        share = (acc["delta"] * (item["full"] / F.greatest(acc["left"], F.lit(1)))).cast("long")
        wanted = F.least(F.greatest(item["y"] + share, F.lit(0)), item["full"])
        got = F.when(item["u"] * item["full"] < wanted, item["full"]).otherwise(F.lit(0).cast("long"))
        return let(got, lambda g: F.struct((acc["delta"] + item["y"] - g).alias("delta"), (acc["left"] - item["full"]).alias("left"),
                                           F.concat(acc["done"], F.array(item.withField("y", g))).alias("done")))
    start = F.struct(F.lit(0).cast("long").alias("delta"), pool.cast("long").alias("left"),
                     F.array().cast(f"array<{item_type}>").alias("done"))
    return F.aggregate(items, start, step)


def _coin(level: int) -> Column:
    return F.xxhash64("h", F.lit(level)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def row_hashes(sized: DataFrame, seed: int, salts: int = 64) -> DataFrame:
    """``sized`` (``doc_id, size, source, content, salt``) with ``h``, a hash of id, size and seed that differs between rows.

    Rows that repeat an id and a size also have the hash of their text, and rows that repeat that too an ordinal. Equal rows,
    a third of the table perhaps, are counted in ``salts`` parts and numbered inside each; ordinals are 0, 1, 2 ... whatever
    part a row is in, so reruns give the same rows.
    """
    plain = F.xxhash64("doc_id", "size", F.lit(seed))
    tied = materialize(sized.groupBy(F.xxhash64("doc_id", "size").alias("tie")).agg(F.count("*").alias("times")).filter("times > 1").drop("times"), "mix-ties")
    n = tied.count()
    if not n:
        return sized.withColumn("h", plain)
    marked = sized.withColumn("at", F.xxhash64("doc_id", "size")).join(small(tied, n), F.col("at") == F.col("tie"), "left")
    once = marked.filter("tie is null").withColumn("h", plain)
    again = marked.filter("tie is not null").withColumn("same", F.xxhash64("doc_id", "size", "source", "content"))
    again = materialize(again, "mix-tied")
    before = Window.partitionBy("same_").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    counts = again.groupBy(F.col("same").alias("same_"), F.col("salt").alias("salt_")).agg(F.count("*").alias("times"))
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("times").over(before), F.lit(0))), "mix-tie-counts")
    place = F.row_number().over(Window.partitionBy("same", "salt").orderBy("at"))
    again = again.withColumn("place", place).join(small(counts), (F.col("same") == F.col("same_")) & (F.col("salt") == F.col("salt_")))
    again = again.withColumn("h", F.xxhash64("doc_id", "size", F.lit(seed), "content", F.col("before") + F.col("place")))
    return once.select(*sized.columns, "h").unionByName(again.select(*sized.columns, "h"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17, fan_in: int = 32, large: int = 256) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``.

    ``taken`` is a whole number of copies (0 to ``cap``) times ``size``. Null texts and texts without a word
    have size 0 and take 0. Null sources are a source of their own, the last. Rows that repeat an id are
    documents of their own, with choices of their own. Reruns agree: every choice is a hash of id, size and ``seed``, of rows that repeat both also of
    text and number. Columns other
    than the three named are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int").alias("salt")
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                                    F.xxhash64(whole_text(text_col)).alias("content"), salt), "mix-sizes")
    sized = row_hashes(sized, seed).drop("content", "salt").withColumn("cls", F.length(F.bin("size")))
    cells = materialize(sized.groupBy("source", "cls").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), cap, weights)
    plan = (cells.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source")))
            .select("s", F.col("cls").alias("c"), "source_size", "target", F.ceil(F.col("n") / fan_in).alias("n_buckets")))
    plan = materialize(plan, "mix-plan")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    full = F.shiftleft(F.col("size"), UNIT_BITS)
    rows = (sized.join(small(plan), F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("c")))
            .select("doc_id", "source", "size", "cls", "source_size", "target", F.floor(rate).alias("base"), "n_buckets",
                    (rate - F.floor(rate)).alias("p"), full.alias("full"), "h"))
    key = ["source", "source_size", "target"]
    id_type = dict(sized.dtypes)["doc_id"]
    item_type = f"struct<order:bigint,doc_id:{id_type},size:bigint,base:bigint,y:bigint,full:bigint,h:bigint,u:double>"

    def items(df: DataFrame, by: list[str], level: int, order: Column, *more: Column) -> DataFrame:
        item = F.struct(order.cast("long").alias("order"), "doc_id", "size", "base", "y", "full", "h", _coin(level).alias("u")).cast(item_type)
        return df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"), *more)

    def settled(folded: DataFrame) -> DataFrame:
        item = folded.select(*key, F.explode("f.done").alias("d"))
        return item.select("d.doc_id", "source", "d.size", "source_size", "target",
                           (F.col("d.size") * (F.col("d.base") + F.when(F.col("d.y") > 0, 1).otherwise(0))).alias("taken"))

    def units(df: DataFrame) -> DataFrame:
        return df.withColumn("y", F.least(F.round(F.col("p") * F.col("full")).cast("long"), F.col("full")))

    is_large = F.col("size") * large > F.col("source_size")
    big = items(units(rows.filter(is_large)), [*key, "p"], 0, -F.col("size"))
    pool = F.shiftleft(F.col("source_size"), UNIT_BITS)
    big = materialize(big.select(*key, "p", _pool_fold(F.col("items"), item_type, pool).alias("f")), "mix-large")
    parts = [settled(big)]
    after = big.select(F.col("source").alias("s2"), F.least(F.greatest(F.col("p") + F.when(F.col("f.left") > 0, F.col("f.delta") / F.col("f.left")).otherwise(0.0),
                                                                       F.lit(0.0)), F.lit(1.0)).alias("p2"))
    rest = rows.filter(~is_large).join(small(after), F.col("source").eqNullSafe(F.col("s2")), "left")
    rest = units(rest.withColumn("p", F.coalesce("p2", "p"))).withColumn("bucket", F.pmod("h", F.col("n_buckets")))
    open_ = (F.col("y") > 0) & (F.col("y") < F.col("full"))
    parts.append(rest.filter(~open_).select("doc_id", "source", "size", "source_size", "target",
                                            (F.col("size") * (F.col("base") + F.when(F.col("y") > 0, 1).otherwise(0))).alias("taken")))
    wide = [*key, "cls", "doc_id", "size", "base", "y", "full", "h"]
    most = plan.agg(F.max("n_buckets")).first()[0] or 0
    held = rest.filter(open_ & (F.col("bucket") == 0)).select(*wide)
    level, current = 1, rest.filter(open_ & (F.col("bucket") > 0)).select(*wide, "bucket")
    while most > 1:
        folded = items(current, [*key, "cls", "bucket"], level, F.col("h"))
        folded = materialize(folded.select(*key, "cls", "bucket", _fold(F.col("items"), item_type).alias("f")), f"mix-level{level}")
        parts.append(settled(folded))
        current = folded.select(*key, "cls", *(F.col(f"f.cur.{c}").alias(c) for c in wide[4:]),
                                (F.floor((F.col("bucket") - 1) / fan_in) + 1).alias("bucket"))
        level, most = level + 1, -(-(most - 1) // fan_in)
    if level > 1:
        held = held.unionByName(current.select(*wide))
    last = items(held, key, level, -F.col("size"), F.sum("full").alias("pool"))
    parts.append(settled(last.select(*key, _pool_fold(F.col("items"), item_type, F.col("pool")).alias("f"))))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
