"""Scans: pages, JSON, text, CSV, local and cloud files, dialogue scripts, the dataset registry, cached stages."""

from __future__ import annotations

import csv
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.align import Columns

#: Extension -> format of a local or cloud file.
FORMATS = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}
DOC_SCHEMA = "unique_id string, page_content string, source string, page int, ordinal long, parent_id string, images_info array<struct<page:int,image_path:string,title:string>>"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line; lines that aren't JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parsed_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The same of a text column."""
    whole = lines.withColumn("__j", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    filled = F.exists(F.array(*[F.col(f"__j.{n}").isNotNull() for n in T._parse_datatype_string(schema).names]), lambda x: x)
    return whole.where(F.col("__j").isNotNull() & filled).select(*lines.columns, "__j.*")


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): trimmed lines that aren't empty."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line")).where("line <> ''")


def abbreviations(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The first two columns of a small CSV, byte-order mark tolerated, in file order; rows without both are left out."""
    rows = csv.reader(r["value"].lstrip("﻿") for r in spark.read.text(path).toLocalIterator())  # row by row; the pairs themselves are what it returns
    return list({r[0].strip(): r[1].strip() for r in rows if len(r) >= 2 and r[0].strip() and r[1].strip()}.items())


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    return text_lines(spark, path).distinct()


def arrow_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Arrow IPC files (stream or file format) as JSON rows' columns: each file is opened by one task and read batch by batch."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load([cloud_path(p) for p in ([path] if isinstance(path, str) else path)])
    head = files.limit(1).select("content").first()
    if head is None:
        raise FileNotFoundError(str(path))

    def batches(content: bytes) -> Iterator[pa.RecordBatch]:
        try:
            reader = pa.ipc.open_file(content)
            yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
        except pa.ArrowInvalid:
            yield from pa.ipc.open_stream(content)

    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(next(batches(head[0])).schema)
    names = schema.names

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for c in b.column(0):
                yield from (x.select(names) for x in batches(c.as_py()))

    return files.select("content").mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, kind: str | None = None) -> DataFrame:
    """Files of one kind, by extension unless kind says; paths may be local, s3a:// or gs://, files or folders."""
    paths = [path] if isinstance(path, str) else list(path)
    kinds = {kind} if kind else {FORMATS.get(PurePosixPath(p).suffix.lstrip(".")) for p in paths}
    if None in kinds:
        raise ValueError(f"unknown file type: {paths}")
    if len(kinds) > 1:
        raise ValueError(f"file types should be identical: {paths}")
    form = kinds.pop()
    if form == "arrow":
        return arrow_files(spark, paths)
    reader = spark.read.schema(schema) if schema else spark.read
    if form == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(form).load([cloud_path(p) for p in paths])


def cloud_path(path: str) -> str:
    """Hadoop's name for an object-store path."""
    for prefix, own in (("s3://", "s3a://"), ("gcs://", "gs://")):
        if path.startswith(prefix):
            return own + path[len(prefix) :]
    return path


def tokenized(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """A stage table: read if it was written whole, else built and written."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def page_documents(pages: DataFrame, text: str, source: str, first: int = 2, last: int = 278, index: str = "page_index") -> DataFrame:
    """Pages first..last (from 0) with text, as DOC rows without parents; page counts from 1."""
    own = pages.where(F.col(index).between(first, last) & (F.trim(text) != ""))
    images = F.array().cast("array<struct<page:int,image_path:string,title:string>>")
    return own.select(X.content_id(text).alias("unique_id"), F.col(text).alias("page_content"), F.col(source).alias("source"), (F.col(index) + 1).cast("int").alias("page"), F.lit(0).cast("long").alias("ordinal"), F.lit(None).cast("string").alias("parent_id"), images.alias("images_info"))


def binary_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(source, page_index, text) of binary documents; extract is the page reader, a function of a file's bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for p, c in zip(df["path"], df["content"], strict=True):
                texts = extract(c)
                yield pd.DataFrame({"source": [p] * len(texts), "page_index": range(len(texts)), "text": texts})

    return files.mapInPandas(run, "source string, page_index int, text string")


def peeled_dialogue(text: Column | str, human: str = "Human:", assistant: str = "Assistant:") -> Column:
    """'Human: a Assistant: b Human: ...' as an array of (from, value); text before the first mark goes, as does what lacks an answer at its end."""
    text = F.col(text) if isinstance(text, str) else text
    marks = rf"\Q{human}\E|\Q{assistant}\E"
    who = F.regexp_extract_all(text, F.lit(f"({marks})"), 1)
    said = F.slice(F.split(text, marks), F.lit(2), F.greatest(F.size(who), F.lit(1)))
    turns = F.zip_with(who, said, lambda w, s: F.struct(F.when(w == human, "human").otherwise("gpt").alias("from"), F.regexp_replace(s, r"^\s+|\s+$", "").alias("value")))
    n = F.size(turns) - F.when(F.element_at(who, -1) == human, 1).otherwise(0)
    return F.when(F.size(who) > 0, F.slice(turns, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(F.slice(turns, 1, 0))


def alternating_dialogue(values: Column | str) -> Column:
    """A list of texts as alternating human and gpt turns; an odd last one goes, and fewer than two give null."""
    values = F.col(values) if isinstance(values, str) else values
    even = F.slice(values, F.lit(1), F.size(values) - F.size(values) % 2)
    return F.when(F.size(values) >= 2, F.transform(even, lambda v, i: F.struct(F.when(i % 2 == 0, "human").otherwise("gpt").alias("from"), v.alias("value"))))


def preference_dialogue(chosen: Column | str, rejected: Column | str) -> tuple[Column, Column, Column, Column]:
    """(history of pairs, instruction, chosen, rejected) of two transcripts that differ in the last answer."""
    turns, other = peeled_dialogue(chosen), peeled_dialogue(rejected)
    said = F.transform(turns, lambda t: t["value"])
    n = F.size(said)
    pairs = F.when(n > 2, F.transform(F.sequence(F.lit(0), F.floor((n - 4) / 2).cast("int")), lambda i: F.slice(said, i * 2 + 1, F.lit(2)))).otherwise(F.array().cast("array<array<string>>"))
    return pairs, F.try_element_at(said, F.lit(-2)), F.try_element_at(said, F.lit(-1)), F.try_element_at(F.transform(other, lambda t: t["value"]), F.lit(-1))


@dataclass
class Dataset:
    """A registry entry: where the rows come from and how their columns read."""

    load_from: str
    name: str
    columns: Columns
    subset: str | None = None
    split: str = "train"
    folder: str | None = None
    num_samples: int | None = None


_HUBS = {"hf_hub_url": "hf_hub", "ms_hub_url": "ms_hub", "om_hub_url": "om_hub"}
_TAGS = ("role_tag", "content_tag", "user_tag", "assistant_tag", "observation_tag", "function_tag", "system_tag")


def resolve(registry: dict[str, dict], names: Sequence[str]) -> list[Dataset]:
    """Entries of the registry by name; an unknown name, or an entry without a source, raises."""
    out = []
    for name in names:
        if name not in registry:
            raise ValueError(f"undefined dataset {name}")
        e = registry[name]
        hub = next((k for k in _HUBS if k in e), None)
        if hub:
            kind, where = _HUBS[hub], e[hub]
        elif "script_url" in e:
            kind, where = "script", e["script_url"]
        elif "cloud_file_name" in e:
            kind, where = "cloud_file", e["cloud_file_name"]
        elif "file_name" in e:
            kind, where = "file", e["file_name"]
        else:
            raise ValueError(f"dataset {name} has no source")
        form = e.get("formatting", "alpaca")
        own = {"messages": "conversations"} if form == "sharegpt" else {}
        fields = {k: v for k, v in e.get("columns", {}).items() if k in Columns.__dataclass_fields__}
        tags = {k: v for k, v in e.get("tags", {}).items() if k in _TAGS}
        columns = Columns(**(own | {"formatting": form, "ranking": e.get("ranking", False)} | fields | tags))
        out.append(Dataset(kind, where, columns, e.get("subset"), e.get("split", "train"), e.get("folder"), e.get("num_samples")))
    return out


def registry_of(spark: SparkSession, path: str) -> dict[str, dict]:
    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def load_dataset(spark: SparkSession, entry: Dataset, root: str, hub: Callable[[Dataset], DataFrame] | None = None) -> DataFrame:
    """The entry's rows. Hubs and scripts need a loader, as this library reaches no network."""
    if entry.load_from in ("file", "cloud_file"):
        path = entry.name if entry.load_from == "cloud_file" else f"{root}/{entry.name}"
        return read_files(spark, path)
    if hub is None:
        raise ValueError(f"{entry.load_from} needs a loader")
    return hub(entry)


def choice_benchmark(spark: SparkSession, path: str, subjects: DataFrame) -> DataFrame:
    """(subject, category, question, A-D, answer) of CSV files named <subject>_<split>.csv; subjects: (subject, category)."""
    rows = spark.read.schema("question string, A string, B string, C string, D string, answer string").csv(path)
    named = rows.withColumn("subject", F.regexp_extract(F.input_file_name(), r"([^/]+?)_[a-z]+\.csv$", 1))
    return named.join(subjects, "subject")
