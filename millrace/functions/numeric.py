"""Scalar arithmetic of encoding, media sizing, losses and throughput, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inferred_lengths(source: Column, target: Column, cutoff: Column) -> tuple[Column, Column]:
    """Lengths of source and target after truncation to cutoff together: the shorter side is spared."""
    most = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise((cutoff * (target / (source + target))).cast("int"))
    new_target = F.least(most, target)
    return F.least(F.greatest(cutoff - new_target, F.lit(0)), source), new_target


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax of two logits; a missing logit counts as -10."""
    y, n = F.coalesce(yes, F.lit(-10.0)), F.coalesce(no, F.lit(-10.0))
    top = F.greatest(y, n)
    return F.exp(y - top) / (F.exp(y - top) + F.exp(n - top))


def sparse_weight(logit: Column) -> Column:
    return F.log1p(F.greatest(logit, F.lit(0.0)))


def resized(width: Column, height: Column, max_pixels: int, min_pixels: int) -> tuple[Column, Column]:
    """Width and height scaled into the pixel bounds, ratio kept; null for a picture without area, which no factor brings into them."""
    area = width.cast("double") * height.cast("double")
    grown = F.when(area > 0, F.sqrt(F.lit(float(min_pixels)) / area))
    factor = F.when(area > max_pixels, F.sqrt(F.lit(float(max_pixels)) / area)).when(area < min_pixels, grown).otherwise(F.lit(1.0))
    return (width * factor).cast("long"), (height * factor).cast("long")


def frame_indices(total: Column, duration_s: Column, fps: float, max_frames: int) -> Column:
    """Indices of evenly spaced video frames, first and last included; of a video of unknown length the first max_frames."""
    n = F.least(total.cast("int"), F.lit(max_frames), F.greatest(F.lit(1), F.floor(duration_s * fps).cast("int")))
    spaced = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * ((total - 1) / F.greatest(n - 1, F.lit(1)))).cast("int"))
    return F.when(total == 0, F.sequence(F.lit(0), F.lit(max_frames - 1))).otherwise(spaced)


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def reward_loss(chosen: Column, rejected: Column) -> Column:
    return -log_sigmoid(chosen - rejected)


def simpo_loss(chosen: Column, rejected: Column, beta: float, gamma: float) -> Column:
    """chosen and rejected: mean log probabilities."""
    return -log_sigmoid(F.lit(beta) * (chosen - rejected - F.lit(gamma / beta)))


def orpo_loss(chosen: Column, rejected: Column, beta: float) -> Column:
    """chosen and rejected: mean log probabilities (negative)."""
    odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
    return -chosen - F.lit(beta) * log_sigmoid(odds)


def suggested_lr(base_lr: float, base_tokens: int, cutoff: int, batch: Column, valid_ratio: Column) -> Column:
    """The base rate scaled by the square root of the valid tokens of a batch over those it was found for."""
    return F.lit(base_lr) * F.sqrt(F.lit(cutoff) * batch * valid_ratio / base_tokens)


def model_flops(batch: Column, seq: Column, layers: int, hidden: int, vocab: int, inter: int, kv_heads: int, heads: int, tied: bool = False, backward: bool = True, recompute: bool = False) -> Column:
    """Floating-point operations of a decoder on batch x seq tokens; two a multiply-add."""
    tokens = (batch * seq).cast("double")
    per_layer = 6.0 * hidden * inter + 4.0 * hidden * hidden + 2.0 * ((2 * hidden * hidden * kv_heads) // heads)
    body = tokens * layers * per_layer + (batch * seq * seq).cast("double") * (4.0 * hidden * layers)
    passes = 3 if backward else 1
    return body * (passes + int(recompute)) + tokens * (float(hidden) * vocab * (1 if tied else 2)) * passes


def utilisation(flops: Column, seconds: Column, peak_flops: Column) -> Column:
    return flops / (seconds * peak_flops)


def delta_percent(ours: Column, base: Column) -> Column:
    return (ours - base) / (base + F.lit(1e-9)) * 100


def argmax_letter(scores: Column) -> Column:
    """A, B, ... of the greatest score; the first of equals."""
    return F.chr(F.array_position(scores, F.array_max(scores)) + 64)


def smoothed(values: Column) -> Column:
    """Exponential smoothing of an array; its weight is 1.8 * (sigmoid(0.05 n) - 0.5)."""
    w = F.lit(1.8) * (F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-0.05) * F.size(values))) - F.lit(0.5))
    start = F.struct(F.element_at(values, 1).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))
    step = lambda acc, x: F.struct((acc["last"] * w + (1 - w) * x).alias("last"), F.concat(acc["out"], F.array(acc["last"] * w + (1 - w) * x)).alias("out"))
    return F.aggregate(values, start, step)["out"]
