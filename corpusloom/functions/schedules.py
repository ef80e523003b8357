"""Scalar schedules, budgets and formats as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_lr(tokens: Column, peak: float, warmup: int, total: int, min_ratio: float = 0.1) -> Column:
    """Learning rate after so many tokens: linear from 0 over the warm-up, then a cosine down to min_ratio of the peak."""
    t = tokens.cast("double")
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - warmup) / max(1, total - warmup)))
    cosine = peak * min_ratio + (peak - peak * min_ratio) * 0.5 * (1 + F.cos(part * math.pi))
    return F.when(t < warmup, t / warmup * peak).otherwise(cosine) if warmup > 0 else cosine


def warmup_steps(total: Column, ratio: float, least: int = 20) -> Column:
    """Steps of warm-up: a share of the run, but no fewer than ``least`` and always one fewer than the run's."""
    if not 0 <= ratio < 1:
        raise ValueError("a share of the run is below 1")
    share = F.bround(total * F.lit(float(ratio)), 0)
    return F.when(total >= 1, F.least(total - 1, F.greatest(F.lit(least), share))).cast("bigint")


def step_lr(step: Column, peak: float, warmup: int, total: int, min_ratio: float = 0.1) -> Column:
    """By steps: step 0 has peak / warmup, the last step of the warm-up the peak, then a cosine to the floor."""
    s = F.greatest(step, F.lit(0)).cast("double")
    part = F.least(F.lit(1.0), (s - warmup) / max(1, total - warmup))
    down = peak * (min_ratio + (1 - min_ratio) * 0.5 * (1 + F.cos(part * math.pi)))
    return F.when(s < warmup, peak * (s + 1) / warmup).otherwise(down) if warmup > 0 else down


def budget_steps(budget: Column, micro: Column, accumulate: Column, seq_len: Column) -> Column:
    """Full steps, micro-batches of a last short one, tokens planned and left over: never above the budget."""
    one = micro * seq_len
    full = F.floor(budget / (one * accumulate))
    tail = F.floor((budget - full * one * accumulate) / one)
    planned = full * one * accumulate + tail * one
    return F.struct(full.alias("full_steps"), tail.alias("tail_micro_batches"), planned.alias("tokens"), (budget - planned).alias("left"))


def simulate(budget: Column, micro: Column, accumulate: Column, seq_len: Column) -> Column:
    """A run that spends the budget: its steps, tokens, the micro-batches of the last step, and what it overshoots (nothing)."""
    one = micro * seq_len
    full = F.floor(budget / (one * accumulate))
    tail = F.floor((budget - full * one * accumulate) / one)
    tokens = (full * accumulate + tail) * one
    last = F.when(tail > 0, tail).when(full > 0, accumulate).otherwise(0)
    return F.struct((full + F.when(tail > 0, 1).otherwise(0)).alias("steps"), tokens.alias("tokens"), last.cast("bigint").alias("final_micro_batches"), F.greatest(tokens - budget, F.lit(0)).alias("overshoot"))


def stage_budget(override: Column, hours: Column, per_second: Column, default: int, floor: int) -> Column:
    """Tokens of a stage: those given, else what the hours allow at the rate, else the default; where they come from, the hours they take, and whether they are too few."""
    given, timed = override > 0, (hours > 0) & (per_second > 0)
    tokens = F.when(given, override).when(timed, F.floor(hours * 3600 * per_second)).when(hours > 0, F.lit(None)).otherwise(F.lit(default)).cast("bigint")
    origin = F.when(given, "override").when(hours > 0, "hours").otherwise("default")
    return F.struct(tokens.alias("tokens"), origin.alias("origin"), F.when(per_second > 0, tokens / per_second / 3600).alias("hours"), (tokens < floor).alias("below_floor"))


# Tokens per parameter at which a model of its own changes in kind, and at which data and size are in balance.
BANDS = ((1.0, "statistics"), (2.0, "fragments"), (8.0, "local"), (15.0, "readable"))
BALANCED = 20.0


def capability(tokens: Column, parameters: Column) -> Column:
    """Tokens per parameter, and what a model trained from nothing on so many can be: ``statistics`` of tokens only, ``fragments``,
    ``local`` coherence, ``readable`` paragraphs, or near ``balanced``."""
    ratio = F.when(parameters > 0, tokens / parameters)
    band = F.when(ratio.isNull(), None)
    for edge, name in BANDS:
        band = band.when(ratio < edge, name)
    return F.struct(ratio.alias("ratio"), band.otherwise("balanced").alias("band"))


def verdict(tokens: Column, parameters: Column) -> Column:
    """``early`` below one token a parameter, ``small`` below half of the balance, else ``balanced``."""
    ratio = F.when(parameters > 0, tokens / parameters)
    return F.when(ratio.isNull(), None).when(ratio < 1.0, "early").when(ratio < BALANCED / 2, "small").otherwise("balanced")


def epoch_tokens(tokens: Column, seq_len: Column, epochs: Column) -> Column:
    """Tokens of whole rows over some epochs."""
    return F.floor(tokens / seq_len) * seq_len * epochs


def passes(budget: Column, unique: Column, most: Column) -> Column:
    """How often the data is passed over, the epochs needed, and whether that is above the most allowed (null: no bound)."""
    p = F.when(unique > 0, budget / unique)
    return F.struct(p.alias("passes"), F.ceil(p).alias("epochs"), F.coalesce(p > most, F.lit(False)).alias("over"))


def rate(amount: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, amount / seconds)


def eta(left: Column, per_second: Column) -> Column:
    """Seconds to go; 0 when nothing is left, null without a rate."""
    return F.when(left <= 0, 0.0).when(per_second > 0, left / per_second)


def count_text(n: Column) -> Column:
    """1,234,567."""
    return F.format_number(n.cast("bigint"), 0)


def short_number(x: Column) -> Column:
    """49.15K, 3.40M, 20.00B; whole below a thousand."""
    a = F.abs(x)
    out = F.when(a >= 1e9, F.format_string("%.2fB", x / 1e9))
    for size, mark in ((1e6, "M"), (1e3, "K")):
        out = out.when(a >= size, F.format_string(f"%.2f{mark}", x / size))
    return out.otherwise(F.format_string("%.0f", x.cast("double")))


def progress_text(done: Column, total: Column) -> Column:
    """3,000 out of 20.00K (15.0%)."""
    return F.concat(count_text(done), F.lit(" out of "), short_number(total), F.format_string(" (%.1f%%)", done * 100.0 / total))


def duration(seconds: Column) -> Column:
    """3d 04h 12m, 1h 02m 09s or 07m 41s; an em dash where it is unknown or negative."""
    t = F.bround(seconds, 0).cast("bigint")
    d, h, m, r = F.floor(t / 86400), F.floor(t % 86400 / 3600), F.floor(t % 3600 / 60), t % 60
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
    return (
        F.when(bad, "—").when(d > 0, F.format_string("%dd %02dh %02dm", d, h, m)).when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).otherwise(F.format_string("%02dm %02ds", m, r))
    )


def loss_text(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.format_string("%.4f", x))


def percent(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.format_string("%.1f%%", x * 100))


def checkpoint_step(path: Column) -> Column:
    """The number in a checkpoint's name, for the newest by number and not by spelling."""
    return F.regexp_extract(path, r"(\d+)(?!.*\d)", 1).cast("bigint")


def transformer_size(layers: Column, width: Column, ffn: Column, vocab: Column) -> Column:
    """Parameters of a decoder with gated feed-forward and tied embeddings, and flops per token (6 per parameter)."""
    block = layers * (4 * width * width + 3 * width * ffn + 2 * width)
    n = block + vocab * width + width
    return F.struct(n.alias("parameters"), (n * 6).alias("flops_per_token"))


def vocab_resize(old: Column, new: Column) -> Column:
    """Rows kept, added and removed when a vocabulary changes its size."""
    return F.struct(F.least(old, new).alias("kept"), F.greatest(new - old, F.lit(0)).alias("added"), F.greatest(old - new, F.lit(0)).alias("removed"))
