"""Generation by slow, failing models: a bounded pool of calls in each task, time limits, tries, and progress that outlives the task.

Rows are dealt to buckets by a hash of their id, whatever the partitioning, and what a task has answered is saved to the bucket's folder in chunks as it goes.
A task that is run again, or a later run over the same folder, reads what is there and asks only for the rest. A row whose calls all fail, or
give nothing, has no answer and is asked again by the next run. Progress goes through pyarrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.datasource import opened


@dataclass(frozen=True)
class Pool:
    """threads: calls at once in a task; seconds: a call's limit; tries: calls for a row at most; chunk: rows saved together.

    A call that is over its limit cannot be stopped: its thread is left to itself, and once stuck_most are, the task asks no more.
    """

    threads: int = 8
    seconds: float = 60.0
    tries: int = 3
    chunk: int = 64
    stuck_most: int = 64

    def answers(self, texts: list[str | None], ask: Callable[[str], str | None]) -> list[str | None]:
        """ask of each text, at most threads at once; null where no try gave an answer in time."""
        out: list[str | None] = [None] * len(texts)
        waiting = [(i, 1) for i in reversed(range(len(texts))) if texts[i] is not None]
        ended: queue.Queue = queue.Queue()
        running: dict[int, tuple[int, int, float]] = {}
        stuck = number = 0

        def call(n: int, text: str) -> None:
            try:
                ended.put((n, ask(text)))
            except Exception:  # noqa: BLE001  whatever a model's client raises is a failed try
                ended.put((n, None))

        while waiting or running:
            while waiting and len(running) < self.threads and stuck < self.stuck_most:
                i, turn = waiting.pop()
                number += 1
                running[number] = (i, turn, time.monotonic() + self.seconds)
                threading.Thread(target=call, args=(number, texts[i]), daemon=True).start()
            if not running:
                break
            again = []
            try:
                n, said = ended.get(timeout=max(0.001, min(r[2] for r in running.values()) - time.monotonic()))
                if n in running:  # else it came too late
                    i, turn, _ = running.pop(n)
                    if said is not None:
                        out[i] = said
                    else:
                        again.append((i, turn))
            except queue.Empty:
                late = [n for n, r in running.items() if r[2] <= time.monotonic()]
                stuck += len(late)
                again += [running.pop(n)[:2] for n in late]
            waiting += [(i, turn + 1) for i, turn in again if turn < self.tries]
        return out


def _saved(system: fs.FileSystem, folder: str) -> dict:
    """What is saved of a bucket: answers by id."""
    found = {}
    for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if f.base_name.endswith(".arrow") and not f.base_name.startswith("_"):
            with system.open_input_file(f.path) as h:
                t = pa.ipc.open_file(h).read_all()
            found |= dict(zip(t["id"].to_pylist(), t["answer"].to_pylist(), strict=True))
    return found


def _save(system: fs.FileSystem, folder: str, ids: pa.Array, answers: list[str]) -> None:
    """Under a name of its own, moved into place when it is whole."""
    system.create_dir(folder)
    name = f"{uuid.uuid4().hex}.arrow"
    batch = pa.RecordBatch.from_arrays([ids, pa.array(answers, pa.string())], ["id", "answer"])
    with system.open_output_stream(f"{folder}/_{name}") as out, pa.ipc.new_file(out, batch.schema) as w:
        w.write_batch(batch)
    system.move(f"{folder}/_{name}", f"{folder}/{name}")


def generated(todo: DataFrame, text: str, ask: Callable[[str], str | None], path: str, pool: Pool | None = None, buckets: int = 200, id_col: str = "unique_id", name: str = "raw_resp") -> DataFrame:
    """(id_col, name) of the rows that have an answer, asking only for ids that path has none of; rows of equal id are asked one by one unless saved.

    path: a folder that all tasks reach and that belongs to this generation alone; buckets must stay the same between its runs. A null text is
    not asked.
    """
    pool = pool or Pool()
    own = todo.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(buckets)).cast("int").alias("bucket"))
    dealt = own.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path)
        now, saved = None, {}
        for b in batches:
            at = 0
            while at < b.num_rows:
                bucket = b.column(2)[at].as_py()
                end = at
                while end < b.num_rows and end - at < pool.chunk and b.column(2)[end].as_py() == bucket:
                    end += 1
                if bucket != now:
                    now, saved = bucket, _saved(system, f"{root}/bucket={bucket}")
                part = b.slice(at, end - at)
                ids = part.column(0).to_pylist()
                rest = [i for i, x in enumerate(ids) if x not in saved]
                if rest:
                    said = pool.answers(part.column(1).take(pa.array(rest)).to_pylist(), ask)
                    good = [i for i, a in zip(rest, said, strict=True) if a is not None]
                    if good:
                        _save(system, f"{root}/bucket={bucket}", part.column(0).take(pa.array(good)), [a for a in said if a is not None])
                    fresh = dict(zip(rest, said, strict=True))
                else:
                    fresh = {}
                answers = [fresh[i] if i in fresh else saved[x] for i, x in enumerate(ids)]
                kept = [i for i, a in enumerate(answers) if a is not None]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), pa.array([answers[i] for i in kept], pa.string())], [id_col, name])
                at = end

    return dealt.mapInArrow(run, T.StructType([T.StructField(id_col, todo.schema[id_col].dataType), T.StructField(name, T.StringType())]))
