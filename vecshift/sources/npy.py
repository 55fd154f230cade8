"""``.npy`` arrays as a Spark data source (S6, S8): row ranges read by offset, shards written under a commit.

Reading plans ranges of rows from the headers alone, so one file is read by many tasks and no task holds a whole file.
Row ids are positions over all files in the order of their names. Arrays of any number of dimensions have a row for each
element of the first; the rest is flattened. Arrays in Fortran order can't be cut by rows and are one range each.

Writing, each task attempt fills a file of its own in a folder of the job; the commit gives the files of the attempts
that Spark counts their names, in partition order, and the folder with whatever other attempts left goes. Nothing shows
up under the target before that.

Paths are folders or files that the driver and all executors reach under one name (a mounted shared folder).
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import local_path

#: Bytes of a range, and of what a task reads at a time.
RANGE_BYTES, STEP_BYTES = 32 << 20, 4 << 20
HEADER_BYTES = 128
# the column of each kind and its type
KINDS = {"vectors": ("embedding", "ARRAY<FLOAT>", np.float32), "labels": ("label", "LONG", np.int64)}


def shared_path(path: str) -> str:
    """Local form of a ``file:`` or plain path."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path}: .npy files are read and written through a mount of the shared folder; use parquet on object stores and HDFS")
    return local_path(path)


def npy_files(path: str) -> list[str]:
    """The ``.npy`` files of a folder by name, or the file itself."""
    if os.path.isfile(path):
        return [path]
    return sorted(e.path for e in os.scandir(path) if e.name.endswith(".npy") and e.is_file()) if os.path.isdir(path) else []


@dataclass
class Range(InputPartition):
    """Rows ``start`` to ``stop`` of a file whose first row has the id ``first``."""

    path: str
    offset: int
    dtype: str
    width: int
    start: int
    stop: int
    first: int
    fortran: bool


def ranges(path: str, range_bytes: int = RANGE_BYTES) -> list[Range]:
    """The ranges of all files under ``path``, from their headers."""
    out, first = [], 0
    for name in npy_files(path):
        with open(name, "rb") as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, fortran, dtype = read(f)
            offset = f.tell()
        if dtype.hasobject or dtype.names or not shape:
            raise ValueError(f"{name}: an array of numbers is needed, not {dtype} of shape {shape}")
        n, width = shape[0], int(np.prod(shape[1:], dtype=np.int64))
        fortran = fortran and width > 1
        step = max(n, 1) if fortran else max(1, range_bytes // max(1, width * dtype.itemsize))
        out += [Range(name, offset, dtype.str, width, at, min(at + step, n), first, fortran) for at in range(0, n, step)]
        first += n
    return out


def read_range(part: Range) -> Iterator[tuple[int, np.ndarray]]:
    """Row id of the first row, and rows, some megabytes at a time."""
    if part.fortran:
        rows = np.load(part.path, mmap_mode="r", allow_pickle=False)
        yield part.first, np.asarray(rows).reshape(len(rows), -1)
        return
    dtype = np.dtype(part.dtype)
    size = part.width * dtype.itemsize
    step = max(1, STEP_BYTES // max(1, size))
    with open(part.path, "rb") as f:
        f.seek(part.offset + part.start * size)
        for at in range(part.start, part.stop, step):
            n = min(step, part.stop - at)
            data = f.read(n * size)
            if len(data) != n * size:
                raise ValueError(f"{part.path} ends before row {at + n}")
            yield part.first + at, np.frombuffer(data, dtype).reshape(n, part.width)


class NpyReader(DataSourceReader):
    def __init__(self, path: str, kind: str, range_bytes: int) -> None:
        self.path, self.kind, self.range_bytes = path, kind, range_bytes

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.range_bytes)

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no rows at all
            return
        column, _, dtype = KINDS[self.kind]
        for first, rows in read_range(partition):
            values = pa.array(np.ascontiguousarray(rows, dtype).reshape(-1))
            if self.kind == "vectors":
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * partition.width), values)
            elif partition.width != 1:
                raise ValueError(f"{partition.path}: labels need an array of one dimension")
            yield pa.record_batch({"row_id": pa.array(np.arange(first, first + len(rows), dtype=np.int64)), column: values})


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str | None
    rows: int


def header(dtype: np.dtype, shape: tuple[int, ...]) -> bytes:
    """A header of a fixed size, so that it can be written again when the rows are counted."""
    text = repr({"descr": dtype.str, "fortran_order": False, "shape": shape})
    return b"\x93NUMPY\x01\x00" + (HEADER_BYTES - 10).to_bytes(2, "little") + text.ljust(HEADER_BYTES - 11).encode() + b"\n"


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.folder = os.path.join(path, f"_temporary-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext
        context = TaskContext.get()
        partition = context.partitionId() if context else 0
        attempt = f"{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex[:8]}"
        column, _, kind = KINDS[self.kind]
        dtype, width, rows, f = np.dtype(kind), None, 0, None
        path = os.path.join(self.folder, f"part-{partition:05d}-{attempt}.npy")
        try:
            for batch in iterator:
                if not len(batch):
                    continue
                values = batch[column]
                if values.null_count:
                    raise ValueError(f"null {column}: .npy files have none")
                if self.kind == "vectors":
                    sizes = np.unique(np.diff(values.offsets.to_numpy()))
                    width = int(sizes[0]) if width is None else width
                    if len(sizes) != 1 or sizes[0] != width or values.flatten().null_count:
                        raise ValueError(f"vectors of different lengths or with nulls in one file: {sizes.tolist()}, {width}")
                    values = values.flatten()
                if f is None:
                    os.makedirs(self.folder, exist_ok=True)
                    f = open(path, "wb")
                    f.write(header(dtype, (0,) if width is None else (0, width)))
                f.write(np.ascontiguousarray(values.to_numpy(zero_copy_only=False), dtype).tobytes())
                rows += len(batch)
            if f is not None:
                f.seek(0)
                f.write(header(dtype, (rows,) if width is None else (rows, width)))
        finally:
            if f is not None:
                f.close()
        return Written(partition, path if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.partition)
        os.makedirs(self.path, exist_ok=True)
        old = npy_files(self.path)
        if self.overwrite:
            for name in old:
                os.remove(name)
        first = 0 if self.overwrite else len(old)
        for i, m in enumerate(done, first):
            os.replace(m.path, os.path.join(self.path, f"part-{i:05d}.npy"))
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class NpyDataSource(DataSource):
    """``spark.read.format("npy")``: options ``path``, ``kind`` (``vectors`` or ``labels``) and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _settings(self) -> tuple[str, str]:
        kind = self.options.get("kind", "vectors")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}, not {kind}")
        return shared_path(self.options["path"]), kind

    def schema(self) -> str:
        column, kind, _ = KINDS[self._settings()[1]]
        return f"row_id LONG, {column} {kind}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(*self._settings(), int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NpyWriter(*self._settings(), overwrite)


def read_npy(spark: SparkSession, path: str, kind: str = "vectors", **options: Any) -> DataFrame:
    """``row_id`` and ``embedding`` or ``label`` of all ``.npy`` files of a folder, or of one file."""
    if not npy_files(shared_path(path)):
        raise FileNotFoundError(f"{path} holds no .npy file")
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").options(kind=kind, **options).load(path)


def write_npy(df: DataFrame, path: str, order_col: str, value_col: str, kind: str = "vectors", shards: int | None = None) -> str:
    """``value_col`` in the order of ``order_col`` as shards ``part-NNNNN.npy``, replacing those that are there."""
    spark = df.sparkSession
    shared_path(path)
    spark.dataSource.register(NpyDataSource)
    column, sql_type, _ = KINDS[kind]
    shards = shards or spark.sparkContext.defaultParallelism
    data = df.select(order_col, df[value_col].cast(sql_type).alias(column if column != order_col else value_col))
    data = data.repartitionByRange(shards, order_col).sortWithinPartitions(order_col).select(data.columns[1])
    data.write.format("npy").mode("overwrite").options(kind=kind).save(path)
    return path
