"""Structured Streaming: the same row functions on unbounded input, exactly-once sinks, and event-time aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.align import Columns, align

#: A stream reads so many files a trigger at most.
FILES_A_TRIGGER = 64


def file_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The files of a folder, or one file: a name without wildcards gets one, as a stream's base must be a folder otherwise."""
    own = path if any(c in path for c in "*?[{") else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_A_TRIGGER).format(form).load(own)


def aligned_stream(stream: DataFrame, columns: Columns) -> DataFrame:
    """Stateless, so the batch converter runs as it is."""
    return align(stream, columns)


def split_stream(stream: DataFrame, key: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(validation, train) by hash of the key; a position-based split has no meaning here."""
    bucket = X.hash_bucket(F.col(key).cast("string"), 100)
    return stream.where(bucket < percent), stream.where(bucket >= percent)


def check_streaming(val_size: float, max_samples: int | None, save: bool, mix: str) -> None:
    """What streaming datasets can't have."""
    if 0 < val_size < 1:
        raise ValueError("streaming needs an integer validation size")
    if max_samples is not None:
        raise ValueError("max_samples doesn't go with streaming")
    if save:
        raise ValueError("token rows can't be saved while streaming")
    if mix == "concat":
        raise ValueError("concat doesn't mix a stream; interleave it")


def shuffled_batches(write: Callable[[DataFrame, int], None], key: str, seed: str = "42") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that shuffles each micro-batch by a seeded hash before it is written."""
    return lambda df, n: write(df.orderBy(F.md5(F.concat(F.lit(f"{seed}:{n}"), F.col(key).cast("string"))), key), n)


def once(stream: DataFrame, key: str) -> DataFrame:
    """The stream's first row of each key; what was seen is kept as state, so no output is read again."""
    return stream.dropDuplicates([key])


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each micro-batch to its own folder: one that is tried again replaces itself."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def once_by_id(spark: SparkSession, path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose key path lacks; a batch that is tried again adds nothing. For a target that others
    write to as well: it reads the target's keys each time. Where the stream alone writes it, once() and by_batch() read nothing."""

    def write(df: DataFrame, n: int) -> None:
        fresh = df.dropDuplicates([key])
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            fresh = fresh.join(spark.read.schema(df.schema).parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write


def drained(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs the stream over all there is now, batch by batch through each, then stops."""
    stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def with_event_time(events: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A watermark on a zoned timestamp (a zoneless one is read in the session's zone)."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling(events: DataFrame, width: str, keys: list[str], column: str = "ts", value: str = "value") -> DataFrame:
    return _counted(events, F.window(column, width), keys, value)


def sliding(events: DataFrame, width: str, step: str, keys: list[str], column: str = "ts", value: str = "value") -> DataFrame:
    return _counted(events, F.window(column, width, step), keys, value)


def sessions(events: DataFrame, gap: str, keys: list[str], column: str = "ts", value: str = "value") -> DataFrame:
    return _counted(events, F.session_window(column, gap), keys, value)


def _counted(events: DataFrame, window, keys: list[str], value: str) -> DataFrame:
    out = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select("w.start", "w.end", *keys, "n", "total")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(keys)
