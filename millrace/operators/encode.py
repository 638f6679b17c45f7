"""Aligned rows to token rows: supervised, packed, pretraining, pairwise, feedback and prompt-only; padding, masks, block packing."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import inferred_lengths
from ..functions.templates import Template
from .align import encodable

IGNORE = -100
#: text -> ids
Encode = Callable[[str], list[int]]


def hashed_ids(text: str) -> list[int]:
    """Ids of whitespace-separated words by hash: a tokenizer without a model."""
    return [zlib.crc32(w.encode()) % 32000 + 10 for w in text.split()]


@dataclass(frozen=True)
class Settings:
    cutoff: int = 2048
    train_on_prompt: bool = False
    mask_history: bool = False
    efficient_eos: bool = False
    eos_id: int = 2
    pad_id: int = 0
    neat_packing: bool = False


def ids_of(encode: Encode, texts: Column) -> Column:
    """The ids of each text of an array; the one step here that runs Python."""

    @F.pandas_udf("array<array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda row: [encode(t or "") for t in row])

    return run(texts)


def _empty() -> Column:
    return F.array().cast("array<int>")


def _ignored(n: Column) -> Column:
    return F.array_repeat(F.lit(IGNORE), n)


def _ended(ids: Column, s: Settings) -> Column:
    return F.concat(ids, F.array(F.lit(s.eos_id))) if s.efficient_eos else ids


def turn_rooms(pairs: Column, cutoff: int, start: int = 0) -> Column:
    """Of pairs of a source and a target (structs s, t of ids), in order, how many ids each keeps: (a, b). All turns share the cutoff,
    of which start ids are taken before; what one leaves is for the next."""

    def taken(state: Column, pair: Column) -> Column:
        left = F.lit(cutoff) - state["used"]
        a, b = inferred_lengths(F.size(pair["s"]), F.size(pair["t"]), left)
        some = (left > 0) & (F.size(pair["s"]) + F.size(pair["t"]) > 0)
        a, b = F.when(some, a).otherwise(0).cast("int"), F.when(some, b).otherwise(0).cast("int")
        return F.struct((state["used"] + a + b).alias("used"), F.concat(state["rooms"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("rooms"))

    none = F.struct(F.lit(start).alias("used"), F.array().cast("array<struct<a:int,b:int>>").alias("rooms"))
    return F.aggregate(pairs, none, taken)["rooms"]


def supervised_turns(pairs: Column, s: Settings) -> tuple[Column, Column]:
    """Ids and labels of a dialogue's pairs. Under mask_history the last turns are served first and only the very last is learnt."""
    served = F.reverse(pairs) if s.mask_history else pairs
    rooms = turn_rooms(served, s.cutoff, int(s.efficient_eos))

    def source_labels(ids: Column) -> Column:
        if s.train_on_prompt:
            return ids
        if s.efficient_eos:  # the end of the turn before is learnt at the first place
            return F.when(F.size(ids) > 0, F.concat(F.array(F.lit(s.eos_id)), _ignored(F.size(ids) - 1))).otherwise(_empty())
        return _ignored(F.size(ids))

    cut = F.zip_with(served, rooms, lambda p, r: F.struct(F.slice(p["s"], F.lit(1), r["a"]).alias("s"), F.slice(p["t"], F.lit(1), r["b"]).alias("t")))
    learnt = lambda p, i: F.when(i > 0, _ignored(F.size(p["t"]))).otherwise(p["t"]) if s.mask_history else p["t"]
    both = F.transform(cut, lambda p, i: F.struct(F.concat(p["s"], p["t"]).alias("ids"), F.concat(source_labels(p["s"]), learnt(p, i)).alias("labels")))
    both = F.reverse(both) if s.mask_history else both
    return _ended(F.flatten(F.transform(both, lambda x: x["ids"])), s), _ended(F.flatten(F.transform(both, lambda x: x["labels"])), s)


def _rendered(template: Template, messages: Column, eos: str) -> Column:
    return template.render(messages, "_system", "_tools", eos)


def _own(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def _mask(ids: str) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def encode_supervised(aligned: DataFrame, template: Template, encode: Encode = hashed_ids, settings: Settings = Settings(), eos: str = "") -> DataFrame:
    """(input_ids, attention_mask, labels) with the columns of aligned that don't start with '_'. Rows that don't fit the stage go."""
    texts = _rendered(template, F.concat("_prompt", "_response"), eos)
    own = aligned.where(encodable("sft")).withColumn("__ids", ids_of(encode, texts))
    pair = lambda i: F.struct(F.get("__ids", 2 * i).alias("s"), F.get("__ids", 2 * i + 1).alias("t"))
    turns = F.floor(F.size("__ids") / 2).cast("int")
    own = own.withColumn("__pairs", F.when(turns > 0, F.transform(F.sequence(F.lit(0), turns - 1), pair)).otherwise(F.array().cast("array<struct<s:array<int>,t:array<int>>>")))
    ids, labels = supervised_turns(F.col("__pairs"), settings)
    return own.select(*_own(aligned), ids.alias("input_ids"), labels.alias("labels")).select(*_own(aligned), "input_ids", _mask("input_ids").alias("attention_mask"), "labels")


def _answers(df: DataFrame, template: Template, encode: Encode, s: Settings, eos: str, answers: dict[str, Column]) -> DataFrame:
    """df with the ids of its prompt (__prompt) and of each of the answers (their names), which are arrays of one message."""
    turns = {k: _rendered(template, F.concat("_prompt", m), eos) for k, m in answers.items()}
    first = next(iter(turns.values()))
    texts = F.concat(F.slice(first, F.lit(1), F.size(first) - 1), F.array(*[F.element_at(t, -1) for t in turns.values()]))
    df = df.withColumn("__all", ids_of(encode, texts))
    own = {k: _ended(F.element_at("__all", i - len(turns)), s) for i, k in enumerate(turns)}
    return df.withColumns({"__prompt": F.flatten(F.slice("__all", F.lit(1), F.size("__all") - len(turns))), **own})


def _answered(prompt: Column, answer: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Ids and labels of a prompt cut to a and an answer cut to b."""
    tail = F.slice(answer, F.lit(1), b)
    return F.concat(F.slice(prompt, F.lit(1), a), tail), F.concat(_ignored(a), tail)


def encode_pairwise(aligned: DataFrame, template: Template, encode: Encode = hashed_ids, settings: Settings = Settings(), eos: str = "") -> DataFrame:
    """Chosen and rejected ids, masks and labels; the longer of the two answers decides how the prompt is cut."""
    answers = {"__chosen": F.slice("_response", 1, 1), "__rejected": F.slice("_response", 2, 1)}
    own = _answers(aligned.where(encodable("dpo")), template, encode, settings, eos, answers)
    rooms = inferred_lengths(F.size("__prompt"), F.greatest(F.size("__chosen"), F.size("__rejected")), F.lit(settings.cutoff))
    out = []
    for w in ("chosen", "rejected"):
        ids, labels = _answered(F.col("__prompt"), F.col(f"__{w}"), *rooms)
        out += [ids.alias(f"{w}_input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias(f"{w}_attention_mask"), labels.alias(f"{w}_labels")]
    return own.select(*_own(aligned), *out)


def shifted_responses(df: DataFrame, order: str, column: str, name: str, batch: int = 1000) -> DataFrame:
    """The column of the row before, in batches by position; a batch's first row gets its last (mismatched pairs for KL)."""
    from .sampling import numbered

    rows = numbered(df, [order], "__pos").withColumn("__b", F.floor(F.col("__pos") / batch))
    w = Window.partitionBy("__b")
    before = F.lag(column).over(w.orderBy("__pos"))
    last = F.last_value(column).over(w.orderBy("__pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.row_number().over(w.orderBy("__pos")) == 1
    return rows.withColumn(name, F.when(first, last).otherwise(before)).drop("__pos", "__b")


def encode_feedback(aligned: DataFrame, order: str, template: Template, encode: Encode = hashed_ids, settings: Settings = Settings(), eos: str = "", batch: int = 1000) -> DataFrame:
    """KTO rows: the wanted or unwanted answer, kto_tags, and the answer of the row before (circular in a batch) as kl_*."""
    rows = shifted_responses(aligned, order, "_response", "__kl", batch).where(encodable("kto"))
    pick = lambda r: F.when(F.element_at(r, 1)["content"] != "", F.slice(r, 1, 1)).otherwise(F.slice(r, 2, 1))
    own = _answers(rows, template, encode, settings, eos, {"__mine": pick(F.col("_response")), "__other": pick(F.col("__kl"))})
    out = []
    for name, answer in (("", "__mine"), ("kl_", "__other")):
        rooms = inferred_lengths(F.size("__prompt"), F.size(answer), F.lit(settings.cutoff))
        ids, labels = _answered(F.col("__prompt"), F.col(answer), *rooms)
        out += [ids.alias(f"{name}input_ids"), labels.alias(f"{name}labels")]
    return own.select(*_own(aligned), *out, (F.element_at("_response", 1)["content"] != "").alias("kto_tags"))


def encode_prompts(aligned: DataFrame, template: Template, encode: Encode = hashed_ids, settings: Settings = Settings(), eos: str = "") -> DataFrame:
    """Prompt ids, with the ids of the response as labels where there is one."""
    empty = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content")))
    there = F.size("_response") > 0
    answers = {"__answer": F.when(there, F.slice("_response", 1, 1)).otherwise(empty)}
    own = _answers(aligned.where(encodable("ppo")), template, encode, Settings(efficient_eos=False), eos, answers)
    answer = F.when(F.size("_response") > 0, F.col("__answer")).otherwise(_empty())
    a, b = inferred_lengths(F.size("__prompt"), F.size(answer), F.lit(settings.cutoff))
    out = own.select(*_own(aligned), F.slice("__prompt", F.lit(1), a).alias("input_ids"), F.slice(answer, F.lit(1), b).alias("labels"))
    return out.select(*_own(aligned), "input_ids", _mask("input_ids").alias("attention_mask"), "labels")


def packs(lengths: Iterable[int], capacity: int) -> Iterator[list[int]]:
    """Lengths by packs: each takes the greatest length that still fits, again and again. Works on counts of lengths, so a pack costs a walk
    down the different lengths. Lengths over the capacity are refused."""
    counts = Counter(lengths)
    if counts and max(counts) > capacity:
        raise ValueError("a length is over the capacity")
    counts.pop(0, None)
    while counts:
        room, pack = capacity, []
        for n in sorted(counts, reverse=True):
            if times := min(counts[n], room // n):
                pack += [n] * times
                room -= n * times
                counts[n] -= times
        counts += Counter()  # lengths that are used up go
        yield pack


def pack_supervised(tokens: DataFrame, order: str, settings: Settings, batch: int = 1000) -> DataFrame:
    """Token rows packed to cutoff + 1 in batches of so many rows by position; empty and longer ones go, so a batch is at most batch times
    cutoff ids. attention_mask numbers the rows of a pack under neat_packing; position_ids start anew with each."""
    from .sampling import numbered

    rows = numbered(tokens.select(order, "input_ids", "labels"), [order], "pos").withColumn("batch", F.floor(F.col("pos") / batch))
    rows = rows.where(F.size("input_ids").between(1, settings.cutoff)).select("batch", "pos", "input_ids", "labels")

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("pos")
        waiting: dict[int, list[int]] = {}
        for i, ids in enumerate(df["input_ids"]):
            waiting.setdefault(len(ids), []).append(i)
        ids, labels, out = df["input_ids"].to_list(), df["labels"].to_list(), []
        for own in packs([n for n, v in waiting.items() for _ in v], settings.cutoff):
            members = [waiting[n].pop() for n in own]
            pad = settings.cutoff + 1 - sum(own)
            numbers = range(1, len(own) + 1) if settings.neat_packing else [1] * len(own)
            row = [np.concatenate([ids[i] for i in members]), np.repeat(numbers, own), np.concatenate([np.arange(n) for n in own]), np.concatenate([labels[i] for i in members])]
            fills = (settings.pad_id, int(not settings.neat_packing), 0, IGNORE)
            out.append([np.pad(x, (0, pad), constant_values=v).astype(np.int32) for x, v in zip(row, fills, strict=True)])
        return pd.DataFrame(out, columns=["input_ids", "attention_mask", "position_ids", "labels"])

    return rows.groupBy("batch").applyInPandas(pack, "input_ids array<int>, attention_mask array<int>, position_ids array<int>, labels array<int>")


def encode_pretrain(texts: DataFrame, text: str, encode: Encode = hashed_ids, settings: Settings = Settings(), eos: str = "") -> DataFrame:
    """(…, input_ids) of the text with its end, cut to the cutoff."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: encode((t or "") + eos)[: settings.cutoff])

    return texts.withColumn("input_ids", run(text))


def block_pack(tokens: DataFrame, order: str, ids: str, block: int, batch: int = 1000, bos_id: int | None = None) -> DataFrame:
    """(batch, block_no, input_ids): ids of each batch of rows in order, end to end, cut in blocks; a batch's remainder goes.

    Each row gives a slice to every block it reaches into, and a block gathers its slices: no row or task holds more than a block's ids
    at once, however long the rows are.
    """
    from .sampling import numbered

    rows = numbered(tokens.select(order, F.coalesce(F.col(ids), _empty()).alias("ids")), [order], "pos").withColumn("batch", F.floor(F.col("pos") / batch))
    own = Window.partitionBy("batch")
    placed = rows.withColumn("n", F.size("ids").cast("long")).withColumn("stop", F.sum("n").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("whole", F.floor(F.sum("n").over(own) / block))
    placed = placed.withColumn("start", F.col("stop") - F.col("n")).where("n > 0")
    reached = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))
    slices = placed.withColumn("block_no", F.explode(reached)).where("block_no < whole")
    lo = F.greatest(F.col("block_no") * block - F.col("start"), F.lit(0)).cast("int")
    hi = F.least((F.col("block_no") + 1) * block - F.col("start"), F.col("n")).cast("int")
    part = F.struct("start", F.slice("ids", lo + 1, hi - lo).alias("ids"))
    blocks = slices.groupBy("batch", "block_no").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    out = blocks.select("batch", F.col("block_no").cast("int").alias("block_no"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("input_ids"))
    return out if bos_id is None else out.withColumn("input_ids", F.concat(F.array(F.lit(bos_id)), F.slice("input_ids", 2, block - 1)))


def padded(values: Column | str, to: Column | int, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(to) if isinstance(to, int) else to, F.size(values)) - F.size(values)))


def collate(tokens: DataFrame, batch_col: str, multiple: int = 8, pad_id: int = 0) -> DataFrame:
    """Token rows padded to the longest of their batch, rounded up to a multiple: ids, mask (0) and labels (-100)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch_col))
    size = (F.ceil(longest / multiple) * multiple).cast("int")
    out = tokens.withColumn("__n", size)
    return out.withColumns({"input_ids": padded("input_ids", F.col("__n"), pad_id), "attention_mask": padded("attention_mask", F.col("__n"), 0), "labels": padded("labels", F.col("__n"), IGNORE)}).drop("__n")


def block_causal_mask(segments: list[int]) -> list[list[int]]:
    """1 where a row of one sequence may look: back, in its own segment; segment 0 is padding."""
    return [[int(j <= i and s == t and s > 0) for j, t in enumerate(segments)] for i, s in enumerate(segments)]


def segment_lengths(mask: Column | str) -> Column:
    """Lengths of the segments 1, 2, ... of a packed attention mask, in order."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    kinds = F.array_sort(F.filter(F.array_distinct(mask), lambda x: x > 0))
    return F.transform(kinds, lambda k: F.size(F.filter(mask, lambda x: x == k)))


def masked_labels(source: Column, target: Column, cutoff: int, train_on_prompt: bool = False) -> tuple[Column, Column]:
    """Ids and labels of one turn, from arrays of ids, without Python."""
    a, b = inferred_lengths(F.size(source), F.size(target), F.lit(cutoff))
    head, tail = F.slice(source, F.lit(1), a), F.slice(target, F.lit(1), b)
    return F.concat(head, tail), F.concat(head if train_on_prompt else F.array_repeat(F.lit(IGNORE), a), tail)
