"""Quoted multi-line CSV read by many tasks a file.

Spark's text source cuts files into ranges and gives a range its lines. Whether a line begins inside a quoted field
depends on all lines before it, so each line is a function of two states (outside or inside quotes) to the state after
it. A first scan composes the functions of every range, with what a range would hold in either case; a prefix scan over
the ranges (narrow rows, by file) then tells the state each one really begins in and the number of its first record. In
the second scan the lines that belong to records across ranges meet by the range their record opened in, and all others
become records where they are. Spark parses the records (``from_csv``).

Quotes count at the start of a field only, and a doubled quote inside a quoted field is one character, as in the reader
that takes a file whole. Lines end in ``\\n`` or ``\\r\\n``; empty lines outside quotes are passed over; a quoted field
that never ends reaches to the end of its file. Files are UTF-8, separated by commas, and have a header each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize

#: Bytes of a range.
RANGE_BYTES = 128 << 20
#: Ranges whose table (some 100 bytes each) is sent to all tasks; more are met by a shuffle of the lines.
BROADCAST_RANGES = 500_000

QUOTED = '"[^"]*+(?:""[^"]*+)*+'
#: A line that begins outside quotes and ends inside them.
OPENS = f'^(?:(?:{QUOTED}"[^,]*+|[^",][^,]*+)?,)*+{QUOTED}\\z'

RANGE_SCHEMA = ("ord LONG, start LONG, end0 INT, end1 INT, n0 LONG, n1 LONG, close LONG, open0 LONG, open1 LONG")
RECORD_SCHEMA = "ord LONG, rec LONG, text BINARY"


def _lines(spark: SparkSession, path: str, listing: DataFrame, file_key, range_bytes: int) -> DataFrame:
    """``ord, start, at, value, blank, out_to, in_to``: the lines by file and range, in order inside a range."""
    # the ranges must be the same in every scan, whatever executors there are: a session of its own fixes their size
    fixed = spark.newSession()
    fixed.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    fixed.conf.set("spark.sql.files.minPartitionNum", "1")
    text = fixed.read.option("lineSep", "\n").text(path).select(
        "value", file_key("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))
    quoted = F.instr("value", '"') > 0
    return listing.join(text, "_file").select(
        F.col("_file_ord").alias("ord"), "start", "at", "value", F.col("value").isin("", "\r").alias("blank"),
        F.when(~quoted, 0).otherwise(F.col("value").rlike(OPENS).cast("int")).alias("out_to"),
        F.when(~quoted, 1).otherwise(F.concat(F.lit('"\n'), "value").rlike(OPENS).cast("int")).alias("in_to"))


def states(out_to: np.ndarray, in_to: np.ndarray, first: int) -> np.ndarray:
    """The state (0 outside, 1 inside quotes) before each line and after the last, beginning in ``first``."""
    n = len(out_to)
    sets = out_to == in_to  # the state after such a line doesn't depend on the one before
    turns = np.concatenate([[0], np.cumsum((out_to == 1) & (in_to == 0))])
    last = np.maximum.accumulate(np.concatenate([[-1], np.where(sets, np.arange(n), -1)]))
    known = last >= 0
    base = np.where(known, out_to[last], first) if n else np.full(1, first)
    return base ^ ((turns - np.where(known, turns[last + 1], 0)) & 1)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], slice]]:
    """The ranges of a batch's lines, each with its place in the batch."""
    ord_, start = (batch.column(c).to_numpy() for c in ("ord", "start"))
    cuts = np.flatnonzero((np.diff(ord_) != 0) | (np.diff(start) != 0)) + 1 if len(ord_) else []
    edges = [0, *cuts, len(ord_)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield (int(ord_[a]), int(start[a])), slice(a, b)


def _range_of(key: tuple[int, int], s: dict) -> dict:
    return {"ord": key[0], "start": key[1], "end0": s["state"][0], "end1": s["state"][1], "n0": s["n"][0], "n1": s["n"][1], "close": s["close"],
            **{f"open{i}": s["last"][i] if s["state"][i] else None for i in (0, 1)}}


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: the state after it, records begun, and the line of a record left open, beginning in either state;
    the line that ends a quoted field which began before."""
    schema = pa.schema([(c, pa.int32() if c.startswith("end") else pa.int64())
                        for c in ("ord", "start", "end0", "end1", "n0", "n1", "close", "open0", "open1")])
    key, s = None, None
    for batch in batches:
        done = []
        at, blank, out_to, in_to = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "blank", "out_to", "in_to"))
        for mine, part in _stretches(batch):
            if mine != key:
                if key is not None:
                    done.append(_range_of(key, s))
                key, s = mine, {"state": [0, 1], "n": [0, 0], "last": [None, None], "close": None}
            for i in (0, 1):
                before = states(out_to[part], in_to[part], s["state"][i])
                begun = np.flatnonzero((before[:-1] == 0) & ~blank[part])
                if len(begun):
                    s["n"][i] += len(begun)
                    s["last"][i] = int(at[part][begun[-1]])
                if i and s["close"] is None and (before[1:] == 0).any():
                    s["close"] = int(at[part][np.argmin(before[1:])])
                s["state"][i] = int(before[-1])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([_range_of(key, s)], schema)


def _placed(ranges: DataFrame) -> DataFrame:
    """``ord, start, state, first, close, open, opener, opener_rec``: the state each range begins in, its first record's
    number, and the range and number of the record it begins inside."""
    order = Window.partitionBy("ord").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turn = ((F.col("end0") == 1) & (F.col("end1") == 0)).cast("long")
    df = ranges.withColumn("turns", F.sum(turn).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").cast("long").alias("end"), "turns"))
    df = (df.withColumn("known", F.last(fixed, ignorenulls=True).over(before))
          .withColumn("so_far", F.coalesce(F.lag("turns").over(order), F.lit(0)))
          .withColumn("state", F.when(F.col("known").isNull(), F.col("so_far") % 2)
                      .otherwise(F.col("known.end").bitwiseXOR((F.col("so_far") - F.col("known.turns")) % 2)))
          .withColumn("n", F.when(F.col("state") == 0, F.col("n0")).otherwise(F.col("n1")))
          .withColumn("open", F.when(F.col("state") == 0, F.col("open0")).otherwise(F.col("open1")))
          .withColumn("close", F.when(F.col("state") == 1, F.col("close")))
          .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))))
    opened = F.when(F.col("open").isNotNull(), F.struct(F.col("start").alias("start"), (F.col("first") + F.col("n") - 1).alias("rec")))
    df = df.withColumn("opened", F.last(opened, ignorenulls=True).over(before))
    return df.select("ord", "start", "state", "first", "close", "open", F.col("opened.start").alias("opener"), F.col("opened.rec").alias("opener_rec"),
                     (F.col("first") + F.col("n") - 1).alias("last_rec"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin and end in a range, from its lines."""
    schema = pa.schema([("ord", pa.int64()), ("rec", pa.int64()), ("text", pa.binary())])
    key, rec, open_lines = None, 0, []
    for batch in batches:
        blank, out_to, in_to, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("blank", "out_to", "in_to", "first"))
        for mine, part in _stretches(batch):
            if mine != key:
                key, rec, open_lines = mine, int(first[part][0]), []
            before = states(out_to[part], in_to[part], 1 if open_lines else 0)
            keep = np.flatnonzero((before[:-1] == 1) | ~blank[part])
            lines = batch.column("value").slice(part.start, part.stop - part.start).take(pa.array(keep)).to_pylist()
            starts = np.flatnonzero(before[:-1][keep] == 0).tolist()
            head = starts[0] if starts else len(lines)
            texts, ended = [], before[-1] == 0
            open_lines += lines[:head]
            if open_lines and (starts or ended):
                texts.append(b"\n".join(open_lines))
                open_lines = []
            edges = starts + [len(lines)] if ended else starts
            texts += [b"\n".join(lines[a:b]) if b - a > 1 else lines[a] for a, b in zip(edges, edges[1:])]
            if starts and not ended:
                open_lines = lines[starts[-1]:]
            if texts:
                n = len(texts)
                yield pa.record_batch([pa.array([mine[0]] * n, pa.int64()), pa.array(range(rec, rec + n), pa.int64()), pa.array(texts, pa.binary())], schema=schema)
                rec += n


def _by_range(lines: DataFrame) -> DataFrame:
    """Lines that a join without broadcast has moved, together and in order again."""
    return lines.repartition("ord", "start").sortWithinPartitions("ord", "start", "at")


def csv_records(spark: SparkSession, path: str, listing: DataFrame, few_files: bool, file_key, range_bytes: int = RANGE_BYTES,
                broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """``ord, rec, text``: every record of the files in ``listing`` (``_file, _file_ord``) with its number in its file, header included.

    A listing of ``few_files`` is broadcast, and so is a table of at most ``broadcast_ranges`` ranges; lines then stay where they are
    read. The table of ranges is written by a job of its own. A range that a later scan does not find in it is an error, never a
    lost line.
    """
    lines = _lines(spark, path, F.broadcast(listing) if few_files else listing, file_key, range_bytes)
    states_only = lines.select("ord", "start", "at", "blank", "out_to", "in_to")
    ranges = (states_only if few_files else _by_range(states_only)).mapInArrow(_compose, RANGE_SCHEMA)
    placed = materialize(_placed(ranges), "csv-ranges")
    few = placed.count() <= broadcast_ranges
    met = lines.join(F.broadcast(placed) if few else placed, ["ord", "start"], "left")
    unknown = F.raise_error(F.lit("a range of a CSV file changed between two scans")).cast("long")
    met = met.withColumn("first", F.coalesce("first", unknown))
    head = (F.col("state") == 1) & (F.col("close").isNull() | (F.col("at") <= F.col("close")))
    tail = F.col("open").isNotNull() & (F.col("at") >= F.col("open"))
    across = F.coalesce(head | tail, F.lit(False))

    inside = met.where(~across).select("ord", "start", "at", "first", "blank", "out_to", "in_to", F.col("value").cast("binary").alias("value"))
    whole = (inside if few and few_files else _by_range(inside)).mapInArrow(_records, RECORD_SCHEMA).withColumn("text", F.col("text").cast("string"))

    pieces = met.where(across).select("ord", F.when(head, F.col("opener_rec")).otherwise(F.col("last_rec")).alias("rec"),
                                      F.struct("start", "at", "value").alias("line"))
    joined = pieces.groupBy("ord", "rec").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    joined = joined.select("ord", "rec", F.array_join(F.col("lines.value"), "\n").alias("text"))
    return whole.unionByName(joined)


def parse_records(records: DataFrame, schema: StructType, options: dict[str, str]) -> DataFrame:
    """Columns of ``schema`` from each record after the header, with ``_file_ord`` and ``_pos``, the row's number in its file."""
    text = F.regexp_replace("text", "\r\\z", "")
    row: Column = F.from_csv(text, F.lit(schema.toDDL()), {k: v for k, v in options.items() if k != "header"} | {"lineSep": "\n"})
    return records.where(F.col("rec") > 0).select(row.alias("row"), F.col("ord").alias("_file_ord"), (F.col("rec") - 1).alias("_pos")) \
        .select("row.*", "_file_ord", "_pos")
