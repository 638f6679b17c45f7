"""Rerankers as models want them: each family's own prompt, cut by tokens, in batches of like length, and its own way from logits to a score.

A family is a Style: how the ids of a query and a text become one input, and what the model's answer means. Tokenizer and model are functions that
are passed in. Pairs are scored where they stand; ids, ranks and scores alone go on to the ranking.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fusion

#: text -> ids, without special tokens
Encode = Callable[[str], list[int]]
#: From a batch of inputs to the logits of yes and no (either may be missing), or to (score, None).
Logits = Callable[[list[list[int]]], list[tuple[float | None, float | None]]]
#: A logit that a model did not report.
MISSING = -10.0


@dataclass(frozen=True)
class Style:
    """joined: from (encode, query, text, most) to the input's ids. probability: the share of yes of both logits; else the first as it is."""

    name: str
    joined: Callable[[Encode, str, str, int], list[int]]
    probability: bool

    def score(self, yes: float | None, no: float | None) -> float:
        if not self.probability:
            return float(MISSING if yes is None else yes)
        y, n = (MISSING if x is None else x for x in (yes, no))
        return 1 / (1 + math.exp(min(700.0, n - y)))


def shortened(a: list[int], b: list[int], most: int) -> tuple[list[int], list[int]]:
    """Two lists of at most most ids together: what is over goes from the ends, of the longer one while it is longer, of the second if they are equal."""
    over = len(a) + len(b) - most
    if over <= 0:
        return a, b
    gap = len(a) - len(b)
    first = min(over, max(0, gap))
    second = min(over, max(0, -gap))
    rest = over - first - second
    return a[: max(0, len(a) - first - rest // 2)], b[: max(0, len(b) - second - (rest + 1) // 2)]


# The prompts that these models were trained with.
TASK = "Given a web search query, retrieve relevant passages that answer the query"
_JUDGE = 'Judge whether the Document meets the requirements based on the Query and the Instruct provided. Note that the answer can only be "yes" or "no".'
_OPEN, _CLOSE = f"<|im_start|>system\n{_JUDGE}<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
_ASK = "Given a query A and a passage B, determine whether the passage contains an answer to the query by providing a prediction of either 'Yes' or 'No'."


def pair_ids(encode: Encode, query: str, text: str, most: int) -> list[int]:
    """Query and text one after the other."""
    a, b = shortened(encode(query), encode(text), most)
    return a + b


def instruct_style(task: str = TASK, between: str = "\n", whole: bool = False) -> Style:
    """An instruction, the query and the text in a chat that is answered yes or no. whole: the cut is of the chat with its opening, not of its body."""

    def joined(encode: Encode, query: str, text: str, most: int) -> list[int]:
        body = f"<Instruct>: {task}{between}<Query>: {query}{between}<Document>: {text}"
        before, after = encode(_OPEN), encode(_CLOSE)
        if whole:
            return (before + encode(body))[:most] + after
        return before + encode(body)[: max(0, most - len(before) - len(after))] + after

    return Style("instruct", joined, True)


def passage_style(begin: int | None = None) -> Style:
    """Query A, passage B and a question; the logit of yes is the score. begin: the id that begins an input."""

    def joined(encode: Encode, query: str, text: str, most: int) -> list[int]:
        line = encode("\n")
        a = ([] if begin is None else [begin]) + encode(f"A: {query}")[: most * 3 // 4]
        b = line + encode(f"B: {text}")[:most]
        return a + b[: max(0, most - len(a))] + line + encode(_ASK)

    return Style("passage", joined, False)


STYLES = {"pair": Style("pair", pair_ids, False), "instruct": instruct_style(), "instruct_chat": instruct_style(between="\n\n", whole=True), "passage": passage_style()}


@dataclass(frozen=True)
class PromptReranker:
    """style: one of STYLES, or one's own; most: ids of an input; batch_ids: ids that the model gets at once, padded to the longest."""

    style: Style
    encode: Encode
    logits: Logits
    most: int = 4096
    batch_ids: int = 1 << 16

    def batches(self, inputs: list[list[int]]) -> Iterator[list[int]]:
        """Numbers of inputs of like length whose padded size is bounded."""
        own: list[int] = []
        for i in sorted(range(len(inputs)), key=lambda i: (len(inputs[i]), i)):
            if own and len(inputs[i]) * (len(own) + 1) > self.batch_ids:
                yield own
                own = []
            own.append(i)
        if own:
            yield own

    def scores(self, queries: list[str | None], texts: list[str | None]) -> list[float]:
        inputs = [self.style.joined(self.encode, q or "", t or "", self.most) for q, t in zip(queries, texts, strict=True)]
        out = np.zeros(len(inputs))
        for own in self.batches(inputs):
            out[own] = [self.style.score(*x) for x in self.logits([inputs[i] for i in own])]
        return out.tolist()

    def scored(self, candidates: DataFrame) -> DataFrame:
        """(query_id, unique_id, rank, score) of candidates (query_id, unique_id, rank, query, page_content)."""
        kept = ["query_id", "unique_id", "rank"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(self.scores(b.column(3).to_pylist(), b.column(4).to_pylist()), pa.float64())], [*kept, "score"])

        schema = T.StructType([*(candidates.schema[c] for c in kept), T.StructField("score", T.DoubleType())])
        return candidates.select(*kept, "query", "page_content").mapInArrow(run, schema)

    def rank(self, candidates: DataFrame, k: int) -> DataFrame:
        """RANKED rows of the k best of each query; equals keep their order."""
        own = self.scored(candidates)
        return fusion.rerank(own, F.col("score"), k)
