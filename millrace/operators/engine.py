"""The dataset engine end to end: options that fit together, then load, sample, align, mix, split and encode."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.templates import Template
from . import align, encode, sampling


@dataclass
class Options:
    """What to load and how; lists may be comma-separated strings. Options that contradict each other raise."""

    dataset: Sequence[str] | str | None = None
    eval_dataset: Sequence[str] | str | None = None
    dataset_dir: str = "data"
    media_dir: str | None = None
    mix: str = "concat"
    probabilities: Sequence[float] | str | None = None
    max_samples: int | None = None
    val_size: float = 0.0
    streaming: bool = False
    cutoff: int = 2048
    packing: bool = False
    neat_packing: bool = False
    mask_history: bool = False
    train_on_prompt: bool = False
    tokenized_path: str | None = None
    seed: str = "42"

    def __post_init__(self) -> None:
        names = lambda x: [p.strip() for p in x.split(",")] if isinstance(x, str) else x
        self.dataset, self.eval_dataset = names(self.dataset), names(self.eval_dataset)
        self.media_dir = self.media_dir or self.dataset_dir
        wants_split = self.val_size > 1e-6
        wrong = [
            (wants_split and self.dataset is None, "val_size needs a dataset"),
            (wants_split and self.eval_dataset is not None, "val_size and eval_dataset exclude each other"),
            (self.probabilities is not None and self.mix == "concat", "probabilities are for interleaved mixing"),
            (self.streaming and 1e-6 < self.val_size < 1, "streaming needs an integer val_size"),
            (self.streaming and self.max_samples is not None, "max_samples doesn't go with streaming"),
            (self.mask_history and self.train_on_prompt, "mask_history and train_on_prompt exclude each other"),
        ]
        if self.probabilities is not None:
            self.probabilities = [float(p) for p in names(self.probabilities)]
            for kind, own in (("dataset", self.dataset), ("eval_dataset", self.eval_dataset)):
                wrong.append((own is not None and len(own) != len(self.probabilities), f"one probability for each {kind}"))
        for bad, what in wrong:
            if bad:
                raise ValueError(what)
        self.packing = self.packing or self.neat_packing
        if self.packing:
            self.cutoff -= 1


def load_aligned(spark: SparkSession, registry: dict[str, dict], names: Sequence[str], options: Options, stage: str, hub: Callable | None = None) -> list[DataFrame]:
    """Each named dataset's rows, sampled and cut as asked, in aligned form with a row key."""
    from ..sources import readers

    out = []
    for entry in readers.resolve(registry, names):
        align.check_stage(stage, entry.columns.ranking)
        rows = readers.load_dataset(spark, entry, options.dataset_dir, hub)
        own = align.align(rows, entry.columns).withColumn("key", F.xxhash64(F.to_json(F.struct("_prompt", "_response", "_system"))))
        if entry.num_samples is not None and not options.streaming:
            own = sampling.sampled(own, entry.num_samples, "key", options.seed)
        if options.max_samples is not None:
            own = sampling.first_n(own, options.max_samples, ["key"])
        out.append(own)
    return out


def mixed(parts: list[DataFrame], options: Options) -> DataFrame:
    """concat, interleave_under (until the shortest ends) or interleave_over (until the longest does)."""
    if len(parts) == 1:
        return parts[0]
    if options.mix == "concat":
        return sampling.concatenated(*parts)
    stop = {"interleave_under": "first_exhausted", "interleave_over": "all_exhausted"}.get(options.mix)
    if stop is None:
        raise ValueError(f"unknown mixing strategy {options.mix}")
    if options.probabilities is None:
        return sampling.round_robin(parts, ["key"], stop).drop("mix_pos")
    sizes = [p.count() / q for p, q in zip(parts, options.probabilities, strict=True) if q > 0]
    draws = int(min(sizes) if stop == "first_exhausted" else max(sizes))
    return sampling.probabilistic_mix(parts, list(options.probabilities), ["key"], draws, options.seed).drop("mix_pos")


def datasets(spark: SparkSession, registry: dict[str, dict], options: Options, template: Template, stage: str = "sft", encoder: encode.Encode = encode.hashed_ids, hub: Callable | None = None) -> dict[str, DataFrame]:
    """Token rows by split: train, validation or validation_<name>. A tokenized path is read as it is, and nothing else is looked at."""
    if options.tokenized_path:
        rows = spark.read.parquet(options.tokenized_path)
        return {r["split"]: rows.where(F.col("split") == r["split"]).drop("split") for r in rows.select("split").distinct().collect()}
    settings = encode.Settings(options.cutoff, options.train_on_prompt, options.mask_history, template.efficient_eos, neat_packing=options.neat_packing)

    def encoded(rows: DataFrame) -> DataFrame:
        if stage == "sft":
            tokens = encode.encode_supervised(rows, template, encoder, settings)
            return encode.pack_supervised(tokens, "key", settings) if options.packing else tokens
        if stage in ("rm", "dpo"):
            return encode.encode_pairwise(rows, template, encoder, settings)
        if stage == "kto":
            return encode.encode_feedback(rows, "key", template, encoder, settings)
        if stage == "ppo":
            return encode.encode_prompts(rows, template, encoder, settings)
        raise ValueError(f"unknown stage {stage}")

    parts = load_aligned(spark, registry, options.dataset or [], options, stage, hub)
    splits = sampling.train_validation(mixed(parts, options), options.val_size if options.val_size < 1 else int(options.val_size), "key", options.seed)
    for name, rows in zip(options.eval_dataset or [], load_aligned(spark, registry, options.eval_dataset or [], options, stage, hub), strict=True):
        splits["validation" if len(options.eval_dataset) == 1 else f"validation_{name}"] = rows
    return {k: encoded(v) for k, v in splits.items()}
