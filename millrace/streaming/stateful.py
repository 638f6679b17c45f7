"""Streams with state of their own: a shuffle buffer that lives over batches, and rows once by id with expiry.

Both run on transformWithStateInPandas, whose state is kept in RocksDB and saved with the checkpoint: a query that is stopped, or loses an
executor, goes on with the state of its last finished batch. A batch that is tried again starts from that state, so nothing is lost or doubled
as long as the sink takes a batch once (streams.by_batch).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a shuffle buffer, over all its lanes.
BUFFER_ROWS = 16_384


def with_state(spark: SparkSession) -> None:
    """What a session needs to run these; a query that runs already keeps its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class ShuffleBuffer(StatefulProcessor):
    """One lane: once size rows are held, each new row takes the place of one drawn at random, which goes out."""

    def __init__(self, schema: T.StructType, size: int, seed: int) -> None:
        self.schema, self.size, self.seed = schema, size, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)
        self.out = handle.getValueState("out", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = self.schema.names
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        sent = self.out.get()[0] if self.out.exists() else 0
        draws = np.random.default_rng([self.seed, int(key[0]), sent])
        for part in rows:
            new = list(part[names].itertuples(index=False, name=None))
            room = max(0, self.size - len(held))
            held += new[:room]
            gone = []
            for row, at in zip(new[room:], draws.integers(0, self.size, max(0, len(new) - room)).tolist(), strict=True):
                gone.append(held[at])
                held[at] = row
            if gone:
                out = pd.DataFrame(gone, columns=names)
                out["lane"], out["place"] = int(key[0]), range(sent, sent + len(gone))
                sent += len(gone)
                yield out
        self.rows.put([tuple(_plain(v) for v in r) for r in held])
        self.out.update((sent,))

    def close(self) -> None:
        pass


def _plain(value: Any) -> Any:
    """A pandas cell as Spark's state takes it."""
    if value is None or value is pd.NaT or isinstance(value, float) and np.isnan(value):
        return None
    return value.item() if isinstance(value, np.generic) else value


def shuffled(stream: DataFrame, key: str, buffer: int = BUFFER_ROWS, lanes: int = 8, seed: int = 42) -> DataFrame:
    """The stream's rows in shuffled order, with lane and place (the row's number in its lane); buffer rows are held back, see rest().

    Rows are dealt to lanes by a hash of key, and each lane holds buffer / lanes rows, so a lane is as large as its part of the buffer
    however long the stream is. Columns lane and place may not be there already.
    """
    with_state(stream.sparkSession)
    if {"lane", "place"} & {c.lower() for c in stream.columns}:
        raise ValueError("lane and place are names of the result")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    out = T.StructType([*schema.fields, T.StructField("lane", T.IntegerType()), T.StructField("place", T.LongType())])
    dealt = stream.withColumn("__lane", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(lanes)).cast("int"))
    own = ShuffleBuffer(schema, max(1, buffer // lanes), seed)
    return dealt.groupBy("__lane").transformWithStateInPandas(statefulProcessor=own, outputStructType=out, outputMode="Append", timeMode="None")


def rest(spark: SparkSession, checkpoint: str, seed: int = 42) -> DataFrame:
    """What a stopped shuffled() query still holds, in shuffled order; with what it has put out that is every row once."""
    with_state(spark)
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "rows").load()
    own = held.select("list_element.*")
    return own.orderBy(F.xxhash64(*[F.col(c).cast("string") for c in own.columns], F.lit(seed)))


class Once(StatefulProcessor):
    """The first rows of a key; with seconds, rows more than so long after the last one that went out are first again."""

    def __init__(self, names: list[str], order: str | None, time: str | None, seconds: int | None) -> None:
        self.names, self.order, self.time, self.seconds = names, order, time, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)) if self.seconds else None  # of one key and batch
        at = self.seen.get()[0] if self.seen.exists() else None
        if self.seconds is None:
            first = None
            for part in rows:
                both = part if first is None else pd.concat([first, part])
                first = (both.sort_values(self.order, kind="stable") if self.order else both).head(1)
            if at is None and first is not None:
                self.seen.update((0,))
                yield first[self.names]
            return
        own = own.sort_values([self.time, self.order] if self.order else [self.time], kind="stable")
        kept, then = [], at
        for i, t in enumerate(own[self.time]):
            now = -1 if t is pd.NaT else int(t.timestamp() * 1000)
            if then is None or now > then + 1000 * self.seconds:
                kept.append(i)
                then = now
        if then != at:
            self.seen.update((then,))
            self.handle.registerTimer(max(0, then) + 1000 * self.seconds + 1)
        if kept:
            yield own.iloc[kept][self.names]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The watermark has passed: no row can come that the key would hold back."""
        if self.seen.exists() and max(0, self.seen.get()[0]) + 1000 * self.seconds < expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
        yield pd.DataFrame(columns=self.names)

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:  # noqa: N802, N803
        at = int(initialState[self.time].max().timestamp() * 1000) if self.seconds else 0
        self.seen.update((at,))
        if self.seconds:
            self.handle.registerTimer(at + 1000 * self.seconds + 1)

    def close(self) -> None:
        pass


def once_within(stream: DataFrame, key: str, order: str | None = None, known: DataFrame | None = None, time: str | None = None, seconds: int | None = None) -> DataFrame:
    """The stream's first row of each key, of a batch's the least by order.

    time, seconds: by a timestamp column with a watermark, a row more than seconds after the last one of its key that went out goes out too, and
    keys are forgotten when the watermark is past that; a row without a time counts as of the epoch. known: rows whose keys (and times) were
    seen before the stream began, such as those of a target that others have written to: they are read once, when the query first starts, and
    not with each batch. Null keys are a key. streams.once() does the same without expiry and known rows, in the JVM.
    """
    with_state(stream.sparkSession)
    if (time is None) != (seconds is None):
        raise ValueError("time and seconds go together")
    start = {}
    if known is not None:
        seen = known.groupBy(key).agg(F.max(time).alias(time)) if time else known.select(key).distinct()
        start = {"initialState": seen.groupBy(key)}
    own = Once(stream.columns, order, time, seconds)
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=own, outputStructType=stream.schema, outputMode="Append", timeMode="EventTime" if time else "None", **start)
