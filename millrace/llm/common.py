"""What the operators of this subpackage share: shared-folder staging and component labelling.

Conventions of all operators here
---------------------------------
* Only the columns an operator names are read from its input, so other columns, whatever their names, are ignored;
  operators that return documents carry them through unchanged.
* A null text is an empty text. A null id is an ordinary value that sorts before all others.
* Rows may repeat: each input row is judged on its own and gives its own output row.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, scratch

#: Rows of keys that are sent to every executor at once (under 100 bytes each).
BLOCK_ROWS = 400_000
#: Blocks of keys up to which documents are read once a block and stay where they are; with more they are shuffled.
MOST_BLOCKS = 8

_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """What make gives, made once a Python worker for the last key asked for; a function of this module, so that all of a worker's tasks share it.

    A worker that goes on to another operator lets the last one's index or cache go first.
    """
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
        release()  # what making it took besides
    return _held[key]


def release() -> None:
    """Gives the memory that a finished task no longer uses back to the system, as its idle worker stays for a while."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forget() -> None:
    """Lets go what held() holds, at the end of a task: an executor may keep several idle workers for each core, and all would hold it."""
    _held.clear()
    release()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and every executor can read it again."""
    spark = df.sparkSession
    path = path or scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def met(docs: DataFrame, marks: DataFrame, keys: dict[str, Column], how: str) -> DataFrame:
    """docs joined with marks, without moving the documents if marks are few enough.

    marks: staged, a row a key, columns other than those of docs. keys: by column of marks, what it must equal of docs (nulls too).
    marks are sent out in blocks of about BLOCK_ROWS; a block's documents are those whose key has its hash.
    """
    blocks = max(1, -(-marks.count() // BLOCK_ROWS))

    def joined(d: DataFrame, m: DataFrame) -> DataFrame:
        return d.join(m, reduce(Column.__and__, (v.eqNullSafe(F.col(k)) for k, v in keys.items())), how)

    if blocks == 1:
        return joined(docs, F.broadcast(marks))
    if blocks > MOST_BLOCKS:
        return joined(docs, marks)
    at = lambda columns, b: F.pmod(F.xxhash64(*columns), F.lit(blocks)) == b
    parts = [joined(docs.where(at(keys.values(), b)), F.broadcast(marks.where(at([F.col(k) for k in keys], b)))) for b in range(blocks)]
    return reduce(DataFrame.union, parts)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Alternating large-star and small-star rounds, each a min-aggregate joined back on the node; rounds are staged in the
    shared folder and grow with the logarithm of the component size. Nodes are of any orderable type, without nulls.
    Large stars are handled by partial aggregation and the runtime's skew-join split, never gathered into one row.
    """
    spark = edges.sparkSession

    def min_of(sym: DataFrame) -> DataFrame:
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return sym.join(low, "u")

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("xxhash64(a, b) % 1000003"))).first())

    path, before = None, None
    current = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(max_rounds):
        now = summary(current)
        if now == before or now[0] == 0:
            break
        before = now
        sym = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select(F.col("b"), F.col("a")))
        large = min_of(sym).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        joined = min_of(down)
        small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u"), F.col("m")).distinct())
        old, path = path, scratch(spark, "cc")
        current = stage(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc", path)
        if old:
            discard(spark, old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(current.select(F.col("b"), F.col("b")).distinct())
