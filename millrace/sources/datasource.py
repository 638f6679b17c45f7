"""Sources of Spark's own interface for what its readers do not read: Arrow IPC files, paged binaries and loaders that are passed in.

A file is read in several tasks: each has a range of its units (record batches or pages), and filters on the unit's number, or on the file,
leave out ranges before any task runs (read() turns on spark.sql.python.filterPushdown.enabled for it).
The file sources also read folders as streams, file by file in order of time and name, and Arrow files can be written.

Paths are opened by pyarrow (local, hdfs, s3, gs); readers.arrow_files() and readers.binary_pages() go through Spark's own binary reader for
stores that only Spark reaches, with one task a file.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

#: Units that a task reads.
UNITS_A_TASK = 64


@dataclass
class Range(InputPartition):
    """Units lo..hi - 1 of a file, or a loader's part."""

    path: str
    lo: int
    hi: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def files_of(path: str) -> list[tuple[int, str]]:
    """(time of the last change in nanoseconds, path) of a file or of a folder's files, but for hidden ones, in that order."""
    system, own = opened(path)
    info = system.get_file_info(own)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(own, recursive=True))
    prefix = path[: len(path) - len(own)] if path.endswith(own) else ""
    names = [(f.mtime_ns or 0, prefix + f.path) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted(names)


class Units:
    """How a kind of file is cut in units. Objects go to the tasks."""

    number = ""

    def schema(self, handle: pa.NativeFile) -> T.StructType:
        raise NotImplementedError

    def count(self, handle: pa.NativeFile) -> int:
        raise NotImplementedError

    def read(self, handle: pa.NativeFile, path: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class Batches(Units):
    """Record batches of an Arrow IPC file; one in the stream format is passed over up to its range."""

    def _reader(self, handle: pa.NativeFile) -> pa.ipc.RecordBatchFileReader | pa.ipc.RecordBatchStreamReader:
        try:
            return pa.ipc.open_file(handle)
        except pa.ArrowInvalid:
            handle.seek(0)
            return pa.ipc.open_stream(handle)

    def schema(self, handle: pa.NativeFile) -> T.StructType:
        return from_arrow_schema(self._reader(handle).schema)

    def count(self, handle: pa.NativeFile) -> int:
        reader = self._reader(handle)
        return reader.num_record_batches if hasattr(reader, "num_record_batches") else sum(1 for _ in reader)

    def read(self, handle: pa.NativeFile, path: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        reader = self._reader(handle)
        if hasattr(reader, "get_batch"):
            yield from (reader.get_batch(i) for i in range(lo, hi))
        else:
            yield from (b for i, b in enumerate(reader) if lo <= i < hi)


@dataclass
class Pages(Units):
    """Pages of a binary document: how many there are, and the texts of a range, are functions of its bytes."""

    counted: Callable[[bytes], int]
    texts: Callable[[bytes, int, int], list[str]]
    number = "page_index"

    def schema(self, handle: pa.NativeFile) -> T.StructType:
        return T.StructType().add("source", "string").add("page_index", "integer").add("text", "string")

    def count(self, handle: pa.NativeFile) -> int:
        return self.counted(handle.read())

    def read(self, handle: pa.NativeFile, path: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        texts = self.texts(handle.read(), lo, hi)
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(range(lo, lo + len(texts)), pa.int32()), pa.array(texts, pa.string())], ["source", "page_index", "text"])


class RangeReader(DataSourceReader):
    """Ranges of the units of files."""

    def __init__(self, units: Units, options: dict[str, str]) -> None:
        self.units, self.options = units, options
        self.low, self.high, self.only, self.sources = 0, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Notes what filters say of unit and file; all are still applied to the rows, as a range may hold more than they let through."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name == self.units.number and name:
                if isinstance(f, EqualTo | In):
                    values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.only = values if self.only is None else self.only & values
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    end = f.value + isinstance(f, LessThanOrEqual)
                    self.high = end if self.high is None else min(self.high, end)
            elif name == "source" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sources = values if self.sources is None else self.sources & values
            yield f

    def ranges(self, paths: Sequence[str]) -> list[Range]:
        step = int(self.options.get("unitsatask", UNITS_A_TASK))
        out = []
        for path in paths:
            if self.sources is not None and path not in self.sources:
                continue
            system, own = opened(path)
            with system.open_input_file(own) as handle:
                n = self.units.count(handle)
            end = n if self.high is None else min(n, self.high)
            for lo in range(self.low - self.low % step, max(end, 0), step):
                hi = min(lo + step, end)
                if self.only is None or any(lo <= x < hi for x in self.only):
                    out.append(Range(path, max(lo, self.low), hi))
        return out

    def partitions(self) -> Sequence[InputPartition]:
        return self.ranges([p for _, p in files_of(self.options["path"])]) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.hi > partition.lo:
            system, own = opened(partition.path)
            with system.open_input_file(own) as handle:
                yield from self.units.read(handle, partition.path, partition.lo, partition.hi)


class RangeStream(DataSourceStreamReader):
    """A folder's files in order of time and name; an offset is the last file that was read. Files must be moved in whole, with their time of arrival."""

    def __init__(self, units: Units, options: dict[str, str]) -> None:
        self.reader, self.options = RangeReader(units, options), options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = files_of(self.options["path"])
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        lo, hi = (start["time"], start["path"]), (end["time"], end["path"])
        return self.reader.ranges([f[1] for f in files_of(self.options["path"]) if lo < f <= hi])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.reader.read(partition)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class ArrowWriter(DataSourceArrowWriter):
    """A file a task, under a name of its own; those of failed attempts are deleted when the job ends."""

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.kind, self.overwrite = options["path"].rstrip("/"), to_arrow_schema(schema), overwrite
        self.before = [p for _, p in files_of(self.path)] if overwrite and opened(self.path)[0].get_file_info(opened(self.path)[1]).type != fs.FileType.NotFound else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, own = opened(self.path)
        system.create_dir(own)
        name, rows = f"part-{uuid.uuid4().hex}.arrow", 0
        with system.open_output_stream(f"{own}/_{name}") as out, pa.ipc.new_file(out, self.kind) as writer:
            for b in iterator:
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, self.kind.types, strict=True)], schema=self.kind))
                rows += b.num_rows
        return Written(f"{own}/_{name}", rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, own = opened(self.path)
        for p in self.before:
            system.delete_file(opened(p)[1])
        for m in messages:
            if m and m.rows:
                system.move(m.path, f"{own}/{m.path.rpartition('/_')[2]}")
            elif m:
                system.delete_file(m.path)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                opened(self.path)[0].delete_file(m.path)


class FileSource(DataSource):
    """Files of some kind of units; option unitsatask: units that a task reads."""

    units: Units = Batches()

    def schema(self) -> T.StructType:
        files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(self.options["path"])
        system, own = opened(files[0][1])
        with system.open_input_file(own) as handle:
            return self.units.schema(handle)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RangeReader(self.units, dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return RangeStream(self.units, dict(self.options))


class ArrowFiles(FileSource):
    """Arrow IPC files, read and written."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrowWriter(schema, dict(self.options), overwrite)


def paged_source(format_name: str, count: Callable[[bytes], int], texts: Callable[[bytes, int, int], list[str]]) -> type[DataSource]:
    """A source (source, page_index, text) of binary documents, by functions of a document's bytes: its pages, and the texts of pages lo..hi - 1."""

    class Paged(FileSource):
        units = Pages(count, texts)

        @classmethod
        def name(cls) -> str:
            return format_name

    return Paged


def loader_source(format_name: str, schema: str, parts: Callable[[dict], list[Any]], load: Callable[[dict, Any], Iterator]) -> type[DataSource]:
    """A source of rows that a loader brings from elsewhere, a task for each part: parts(options) lists them (as JSON holds them), load(options, part)
    yields a part's rows as tuples or record batches."""

    class LoaderReader(DataSourceReader):
        def __init__(self, options: dict[str, str]) -> None:
            self.options = options

        def partitions(self) -> Sequence[InputPartition]:
            return [Range(json.dumps(p), 0, 0) for p in parts(self.options)] or [Range("", 0, 0)]

        def read(self, partition: Range) -> Iterator:
            if partition.path:
                yield from load(self.options, json.loads(partition.path))

    class Loader(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return LoaderReader(dict(self.options))

    return Loader


def read(spark: SparkSession, source: type[DataSource], path: str | None = None, **options: object) -> DataFrame:
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own = spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()})
    return own.load(path) if path else own.load()


def read_stream(spark: SparkSession, source: type[DataSource], path: str, **options: object) -> DataFrame:
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.readStream.format(source.name()).options(**{k: str(v) for k, v in options.items()}).load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "append") -> None:
    df.sparkSession.dataSource.register(ArrowFiles)
    df.write.format("arrow_ipc").mode(mode).save(path)


def hub(spark: SparkSession, source: type[DataSource]) -> Callable[[Any], DataFrame]:
    """A loader for readers.load_dataset(): the registry entry's name, subset, split and folder are the source's options."""
    return lambda entry: read(spark, source, **{k: v for k in ("name", "subset", "split", "folder") if (v := getattr(entry, k)) is not None})
