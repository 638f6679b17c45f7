"""Writes: stage tables, upserts, JSON, splits, predictions, index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import LexicalIndex
from ..operators.sampling import last_wins


def upsert(store: DataFrame | None, rows: DataFrame, key: str, path: str) -> None:
    """A new version of a keyed table at path: rows over store, the last of rows winning by column seq. path isn't what store reads."""
    fresh = last_wins(rows, key, "seq").drop("seq")
    merged = fresh if store is None else store.join(fresh.select(key), key, "left_anti").unionByName(fresh)
    merged.write.mode("overwrite").parquet(path)


def json_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_json(df: DataFrame, path: str) -> None:
    json_rows(df, path, "append")


def by_split(df: DataFrame, path: str, form: str = "json") -> None:
    """One write for all splits."""
    df.write.mode("overwrite").partitionBy("split").format(form).save(path)


def tokens(df: DataFrame, path: str, streaming: bool = False) -> None:
    if streaming or df.isStreaming:
        raise ValueError("token rows can't be saved while streaming")
    df.write.mode("errorifexists").parquet(path)


def predictions(df: DataFrame, path: str) -> None:
    """prompt, predict, label as JSON lines."""
    json_rows(df.select("prompt", "predict", "label"), path)


def reward_columns(chosen: Column | str, rejected: Column | str) -> list[Column]:
    """Rewards as they are written: two places."""
    return [F.round(chosen, 2).alias("chosen"), F.round(rejected, 2).alias("rejected")]


def rewards(df: DataFrame, path: str) -> None:
    json_rows(df.select(*reward_columns("chosen", "rejected")), path)


def lexical(index: LexicalIndex, path: str) -> None:
    """postings, frequencies and lengths as tables under path, postings ranged by term for pruned reads (by id within a term, as a frequent one fills several files)."""
    index.postings().repartitionByRange("term", "unique_id").sortWithinPartitions("term", "unique_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.frequencies().write.mode("overwrite").parquet(f"{path}/frequencies")
    index.lengths().write.mode("overwrite").parquet(f"{path}/lengths")


def vectors(df: DataFrame, path: str, most_chars: int | None = None) -> None:
    """Drop and create: ids, texts (cut where the store they go to has a limit), vectors."""
    out = df.withColumn("text", F.substring("text", 1, most_chars)) if most_chars and "text" in df.columns else df
    out.write.mode("overwrite").parquet(path)
