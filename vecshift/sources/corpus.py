"""Corpus files: CSV and JSON-lines scans and sinks, multi-split loading."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import null_if_token
from ..session import input_bytes, path_exists
from .csv_ranges import RANGE_BYTES, csv_records, parse_records

CSV_READ = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "mode": "PERMISSIVE"}
CSV_WRITE = {"header": "true", "escape": '"', "quote": '"',
             # keep surrounding blanks: " NA" must come back as " NA"
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _norm_path(c):
    return F.regexp_replace(c, "^file:/+", "file:/")


def _plain(path: str) -> str:
    """A listed file as :func:`_norm_path` gives it."""
    return re.sub("^file:/+", "file:/", path)


#: ``_order`` is a file's ordinal in the high bits and the row's position in the file in the low ones.
POS_BITS = 33
MAX_FILES = 1 << (62 - POS_BITS)
BROADCAST_FILES = 200_000


def _listing(spark: SparkSession, files: list[str], first: int) -> DataFrame:
    """``_file_ord, _file`` of the input files (sorted), from ``first``."""
    if first + len(files) > MAX_FILES:
        raise ValueError(f"more than {MAX_FILES} input files")
    return spark.createDataFrame([(first + i, f) for i, f in enumerate(files)], "_file_ord LONG, _file STRING")


def _with_order(df: DataFrame, files: list[str], first: int) -> DataFrame:
    """``df``, just read from ``files`` (sorted), with ``_file``, ``_pos`` and ``_order``; the files' ordinals begin at ``first``."""
    listing = _listing(df.sparkSession, files, first)
    df = df.withColumn("_file", _norm_path(F.col("_metadata.file_path"))).withColumn("_pos", F.monotonically_increasing_id())
    # a multi-line CSV file is never split: the low bits of the id follow the file
    at = F.col("_pos").bitwiseAND(F.lit((1 << POS_BITS) - 1))
    df = df.join(F.broadcast(listing) if len(files) <= BROADCAST_FILES else listing, "_file", "left")
    return df.withColumn("_order", F.shiftleft("_file_ord", POS_BITS) + at).drop("_file_ord")


def read_corpus_csv(spark: SparkSession, path: str, schema: str | None = None, first_file: int = 0, typed: bool = False,
                    range_bytes: int = RANGE_BYTES) -> DataFrame:
    """CSV with a header and quoted multi-line fields.

    Columns are read as strings unless a schema is given or ``typed`` asks for :func:`typed_columns`. ``_order`` is a LONG
    that follows input order: the file's ordinal among the input files (by path, listed on the driver, from
    ``first_file``), then the row's position. The pandas missing-value strings become nulls in
    :func:`vecshift.operators.clean.clean_corpus`, and in typed columns.

    Input of more than ``range_bytes`` is read by ranges (:mod:`vecshift.sources.csv_ranges`), many tasks a file; less is
    one range anyway and read a file a task. The rows are the same.
    """
    reader = spark.read.options(**CSV_READ)
    if schema:
        reader = reader.schema(schema)
    df = reader.csv(path)
    files = sorted(_plain(f) for f in df.inputFiles())
    own = [f"`{c}`" for c in df.columns]
    size = input_bytes(df)
    if size is not None and size <= range_bytes:
        out = _with_order(df, files, first_file).select(*own, "_file", "_pos", "_order")
    else:
        listing = _listing(spark, files, first_file)
        few = len(files) <= BROADCAST_FILES
        rows = parse_records(csv_records(spark, path, listing, few, _norm_path, range_bytes), df.schema, CSV_READ)
        order = F.shiftleft("_file_ord", POS_BITS) + F.col("_pos")
        out = rows.join(F.broadcast(listing) if few else listing, "_file_ord").select(*own, "_file", "_pos", order.alias("_order"))
    return typed_columns(out, df.columns) if typed else out


# fixed values: the forms of numbers and truth values in a CSV file
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")


def column_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The narrowest of LONG, DOUBLE, BOOLEAN and STRING that holds every value of each string column, in one aggregate.

    Missing-value strings count as nulls and fit any type; a column of nulls alone stays STRING. Whole numbers beyond 64
    bits are DOUBLE.
    """
    def fits(value: Column) -> list[Column]:
        number = value.rlike(DECIMAL)
        whole = F.when(value.isNotNull(), value.rlike(INTEGER) & F.trim(value).try_cast("long").isNotNull())
        return [whole, number, value.isin(*TRUTH)]
    names = ("LONG", "DOUBLE", "BOOLEAN")
    tests = [F.bool_and(t).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, t in zip(names, fits(null_if_token(F.col(f"`{c}`"))))]
    if not tests:
        return {}
    found = df.agg(*tests).first()
    return {c: next((k for k in names if found[f"{i}_{k}"]), "STRING") for i, c in enumerate(columns)}


def typed_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with its string ``columns`` as :func:`column_types` finds them; missing-value strings are nulls."""
    types = column_types(df, [c for c in columns if df.schema[c].dataType.typeName() == "string"])

    def cast(c: str) -> Column:
        value = null_if_token(F.col(f"`{c}`"))
        return value if types[c] == "STRING" else F.trim(value).cast(types[c])
    return df.select(*(cast(c).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns))


def write_corpus_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header, no index column (S3)."""
    df.write.mode(mode).options(**CSV_WRITE).csv(path)
    return path


def write_corpus_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines, non-ASCII kept as is, null fields written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def read_corpus_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


LISTING_THREADS = "mapreduce.input.fileinputformat.list-status.num-threads"


def jsonl_in_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder of JSON lines in the order of its part files and their lines, without a shuffle.

    (A file scan deals files to tasks by size.) Its partitions follow that order, so what is written from it does too.
    A line that does not parse is an error.
    """
    conf, context = spark._jsc.hadoopConfiguration(), spark.sparkContext
    threads = conf.get(LISTING_THREADS)
    conf.set(LISTING_THREADS, "1")  # a pattern's files are listed sorted; several threads would mix them
    try:
        lines = context.textFile(f"{path}/part-*".replace(",", "?"), context.defaultParallelism)
        lines.getNumPartitions()  # lists the files
    finally:
        conf.unset(LISTING_THREADS) if threads is None else conf.set(LISTING_THREADS, threads)
    return spark.read.schema(schema).options(mode="FAILFAST", maxStringLen=(1 << 31) - 1).json(lines)


def choose_splits(available: list[str], requested: list[str] | None) -> list[str]:
    """Requested names that exist, in requested order; all (sorted) when none exist."""
    have = set(available)
    chosen = [s for s in (requested or []) if s in have]
    return chosen or sorted(have)


def load_split_files(spark: SparkSession, paths: dict[str, str], requested: list[str] | None,
                     schema: str | None = None) -> DataFrame:
    """One CSV per split name → union with ``split`` and ``split_ordinal``."""
    available = [k for k, p in paths.items() if path_exists(spark, p)]
    chosen = choose_splits(available, requested)
    if not chosen:
        raise FileNotFoundError(f"none of the split files exist: {sorted(paths.values())}")
    frames, n_files = [], 0
    for i, name in enumerate(chosen):
        # one count of files over all splits keeps input order, however many splits there are
        frame = read_corpus_csv(spark, paths[name], schema, n_files)
        n_files += len(frame.inputFiles())
        frames.append(frame.withColumn("split", F.lit(name)).withColumn("split_ordinal", F.lit(i)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def load_splits_from_column(df: DataFrame, split_col: str, requested: list[str] | None) -> DataFrame:
    """Table form of :func:`load_split_files`: the splits are values of ``split_col``.

    The requested names become a tiny table joined on the split column, so no
    list of available names is gathered unless none of them exist.
    """
    spark = df.sparkSession
    req = spark.createDataFrame([(s, i) for i, s in enumerate(requested or [])],
                                "split STRING, split_ordinal INT")
    hit = df.join(F.broadcast(req), df[split_col] == req["split"], "inner").drop(req["split"])
    hit = hit.withColumn("split", F.col(split_col))
    if hit.limit(1).count() > 0:
        return hit
    names = sorted(r[0] for r in df.select(split_col).distinct().collect())
    allreq = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "split STRING, split_ordinal INT")
    return df.join(F.broadcast(allreq), df[split_col] == allreq["split"], "inner") \
        .drop(allreq["split"]).withColumn("split", F.col(split_col))
