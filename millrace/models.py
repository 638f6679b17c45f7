"""What a model does for an operator, as interfaces with deterministic offline defaults; pass your own in their place."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import fusion, retrieval
from .operators.chunking import hashed_vectors


class Retriever(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class Reranker(Protocol):
    def rank(self, candidates: DataFrame, k: int) -> DataFrame: ...


class BM25Retriever:
    """queries: (query_id, query)."""

    def __init__(self, docs: DataFrame, tokenizer: Callable[[Column | str], Column] = X.tokens) -> None:
        self.index, self.tokenizer = retrieval.lexical_index(docs, tokenizer=tokenizer), tokenizer

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.bm25(self.index, queries.select("query_id", self.tokenizer("query").alias("words")), k)


class TfidfRetriever(BM25Retriever):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.tfidf(self.index, queries.select("query_id", self.tokenizer("query").alias("words")), k)


class DenseRetriever:
    """vectors: (unique_id, embedding); queries: (query_id, embedding)."""

    def __init__(self, vectors: DataFrame, metric: str = "ip") -> None:
        self.vectors, self.metric = vectors, metric

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.dense(self.vectors, queries, k, self.metric)


class OverlapReranker:
    """Share of the query's words in the text; candidates: (query_id, unique_id, rank, query, page_content)."""

    def rank(self, candidates: DataFrame, k: int) -> DataFrame:
        return fusion.rerank(candidates, fusion.lexical_overlap(X.tokens("query"), X.tokens("page_content")), k)


class PairReranker:
    """score: (queries, texts) -> numbers, called with Arrow batches; every pair is scored."""

    def __init__(self, score: Callable[[list[str], list[str]], list[float]]) -> None:
        self.score = score

    def rank(self, candidates: DataFrame, k: int) -> DataFrame:
        own = self.score

        @F.pandas_udf("double")
        def run(q: pd.Series, t: pd.Series) -> pd.Series:
            return pd.Series(own(q.tolist(), t.tolist()), dtype=float)

        return fusion.rerank(candidates, run("query", "page_content"), k)


def embedded(df: DataFrame, text: str, embed: Callable = hashed_vectors, prefix: str = "", normalise: bool = False, name: str = "embedding") -> DataFrame:
    """df with the vector of a text column; the embedder gets lists of texts. prefix: an instruction for queries."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            v = np.asarray(embed([prefix + (t or "") for t in s]), np.float32)
            if normalise:
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(v))

    return df.withColumn(name, run(text))


def mapped(df: DataFrame, text: str, call: Callable[[list[str]], list[str | None]], name: str, chunk: int = 1024) -> DataFrame:
    """df with what a text model says, in slices of so many rows; null is a failure. Serves cleaning, rewriting, generation, judging."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            yield pd.Series([x for i in range(0, len(texts), chunk) for x in call(texts[i : i + chunk])], dtype=object)

    return df.withColumn(name, run(text))


def identity(texts: list[str]) -> list[str | None]:
    return list(texts)


def extractive(prompts: list[str]) -> list[str | None]:
    """The first numbered context line of each prompt, cited; without one no answer."""
    out: list[str | None] = []
    for p in prompts:
        line = next((x for x in (p or "").split("\n") if x.startswith("【1】")), "")[3:].strip(" \t\n\f\r")
        out.append(f"{line}【1】" if line else X.NO_ANSWER)
    return out


def hyde_queries(queries: DataFrame, generate: Callable[[list[str]], list[str | None]] = identity) -> DataFrame:
    """query with a hypothetical answer on a second line; the query alone where there is none."""
    own = mapped(queries, "query", generate, "__h")
    return own.withColumn("query", F.when(F.col("__h").isNull() | (F.col("__h") == ""), F.col("query")).otherwise(F.concat_ws("\n", "query", "__h"))).drop("__h")


def answered(queries: DataFrame, contexts: DataFrame, prompt: str, generate: Callable[[list[str]], list[str | None]] = extractive, most: int | None = 9000) -> DataFrame:
    """(query_id, query, context, response); prompt has {query} and {context}. Failures are dropped. most: characters of a context that the
    prompt has room for, None for all."""
    both = queries.join(contexts, "query_id")
    both = both.withColumn("context", X.truncated("context", most)) if most else both
    filled = X.filled(prompt.replace("{query}", "{{query}}").replace("{context}", "{{context}}"), query="query", context="context")
    return mapped(both.withColumn("__p", filled), "__p", generate, "response").drop("__p").where("response is not null")


def generated(todo: DataFrame, done: DataFrame | None, text: str, call: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(unique_id, raw_resp) for rows that done lacks; failures are left for the next run."""
    rest = todo if done is None else todo.join(done.select("unique_id").distinct(), "unique_id", "left_anti")
    return mapped(rest, text, call, "raw_resp").where("raw_resp is not null").select("unique_id", "raw_resp")


def judged_mean(df: DataFrame, prompt_col: str, judge: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """One row: the mean of the numbers a judge gives, and of how many rows."""
    scored = mapped(df, prompt_col, judge, "__s").select(F.expr("try_cast(__s as double)").alias("s"))
    return scored.agg(F.avg("s").alias("mean"), F.count("s").alias("n"))


def judged_contexts(rows: DataFrame, judge: Callable[[list[tuple[str, str]]], list[int]], claims: str, contexts: str) -> DataFrame:
    """rows with verdicts (of each context in order: is it of use for any claim) and supported (of each claim: does any context bear it out).

    claims, contexts: arrays of texts. judge: of pairs (claim, context), 1 or 0 each; it gets all pairs of an Arrow batch at once.
    """

    @F.pandas_udf("verdicts array<int>, supported array<int>")
    def run(mine: pd.Series, found: pd.Series) -> pd.DataFrame:
        pairs = [(a, b) for x, y in zip(mine, found, strict=True) for a in x for b in y]
        said, at, out = judge(pairs), 0, []
        for x, y in zip(mine, found, strict=True):
            own = np.asarray(said[at : at + len(x) * len(y)], np.int32).reshape(len(x), len(y))
            at += own.size
            out.append((own.max(0, initial=0).tolist(), own.max(1, initial=0).tolist()))
        return pd.DataFrame(out, columns=["verdicts", "supported"])

    return rows.withColumn("__j", run(claims, contexts)).select(*rows.columns, "__j.verdicts", "__j.supported")
