"""Corpus, generation, array and timing statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .order import prefix_sum


def compression(df: DataFrame, by: list[str], tokens: str = "num_tokens") -> DataFrame:
    """Documents, characters, bytes, tokens and characters and bytes per token (0 without tokens)."""
    t = F.coalesce("text", F.lit(""))
    x = df.groupBy(*by).agg(F.count("*").alias("documents"), F.sum(F.length(t)).alias("chars"), F.sum(F.octet_length(t)).alias("bytes"), F.sum(tokens).alias("tokens"))
    per = lambda c: F.when(F.col("tokens") > 0, F.col(c) / F.col("tokens")).otherwise(0.0)
    return x.withColumn("chars_per_token", per("chars")).withColumn("bytes_per_token", per("bytes"))


def compression_by(df: DataFrame, encoders: dict, by: list[str]) -> DataFrame:
    """The same for each of several tokenizers and each slice, with ``encoder`` for its name."""
    from . import tokenizer as tk

    out = None
    for name, tok in encoders.items():
        n = F.size(tk.encode(F.coalesce("text", F.lit("")), tok)).cast("bigint")
        x = compression(df.withColumn("num_tokens", n), by).withColumn("encoder", F.lit(name))
        out = x if out is None else out.unionByName(x)
    if out is None:
        raise ValueError("no encoders")
    return out


# ---- n-grams and generations ------------------------------------------------


def ngrams(ids: Column, n: int) -> Column:
    return F.when(F.size(ids) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(ids) - n + 1), lambda i: F.array_join(F.slice(ids, i, n).cast("array<string>"), " ")))


def distinct_n(ids: Column, n: int) -> Column:
    """Distinct n-grams over all; 0 for an empty array, 1 for a shorter one than n."""
    g = ngrams(ids, n)
    return F.when(F.size(ids) == 0, 0.0).when(F.size(g) == 0, 1.0).otherwise(F.size(F.array_distinct(g)) / F.size(g))


def top_ngram(df: DataFrame, key: str, ids: str, n: int = 3) -> DataFrame:
    """(key, gram, repeats): the most frequent n-gram, of equals the largest by ids or words; rows without any are left out."""
    kind = dict(df.dtypes)[ids]
    g = F.when(F.size(ids) < n, F.array().cast(f"array<{kind}>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(ids) - n + 1), lambda i: F.slice(ids, i, n)))
    x = df.select(key, F.explode(g).alias("g")).groupBy(key, "g").agg(F.count("*").alias("c"))
    best = F.max(F.struct("c", "g"))
    return x.groupBy(key).agg(best.alias("b")).select(key, F.array_join(F.col("b.g").cast("array<string>"), " ").alias("gram"), F.col("b.c").alias("repeats"))


def generation_report(df: DataFrame, key: str, ids: str, eos: int, max_repeat: int = 4, least_distinct: float = 0.2) -> DataFrame:
    """Per generation: length, whether it ended by eos, distinct-1 and -2, the most repeats of a 3-gram, and whether it loops."""
    body = F.when(F.element_at(ids, -1) == eos, F.slice(ids, 1, F.size(ids) - 1)).otherwise(F.col(ids))
    x = df.select(key, F.size(ids).cast("bigint").alias("generated"), F.when(F.size(ids) > 0, F.element_at(ids, -1) == eos).otherwise(False).alias("eos_stopped"), F.when(F.size(ids) > 0, body).otherwise(F.col(ids)).alias("_b"))
    top = top_ngram(x.withColumnRenamed("_b", "b2"), key, "b2").select(key, "repeats")
    x = x.join(top, key, "left").na.fill(0, ["repeats"])
    d2 = distinct_n(F.col("_b"), 2)
    x = x.withColumn("distinct_1", distinct_n(F.col("_b"), 1)).withColumn("distinct_2", d2)
    loops = (F.size("_b") > 0) & ((F.col("repeats") > max_repeat) | (F.col("distinct_2") < least_distinct))
    return x.withColumn("degenerate", loops).drop("_b")


def generation_rates(report: DataFrame) -> DataFrame:
    """Shares over all generations; null where there are none."""
    avg = lambda c: F.avg(F.col(c).cast("double"))
    return report.agg(F.count("*").alias("generations"), avg("eos_stopped").alias("eos_rate"), avg("degenerate").alias("degenerate_rate"), F.avg("distinct_2").alias("distinct_2"), F.avg("generated").alias("mean_length"))


# ---- summaries --------------------------------------------------------------


def _ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, _c, _lo, _n): counts of distinct values, the rows below each, and all rows of its group.

    Equal values cost one row, and rows below come from a range partition (``order.prefix_sum``), so
    neither a group nor the whole table is sorted in one task.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranked = prefix_sum(c, [value], {"_lo": "_c"}, by)
    n = ranked.groupBy(*by).agg(F.sum("_c").alias("_n"))
    if not by:
        return ranked.crossJoin(F.broadcast(n))  # one row
    keys = n.select(*(F.col(k).alias(f"_g_{k}") for k in by), "_n")
    cond = F.lit(True)
    for k in by:
        cond = cond & ranked[k].eqNullSafe(keys[f"_g_{k}"])
    return ranked.join(keys, cond).drop(*(f"_g_{k}" for k in by))


def _at(place: Column) -> Column:
    return (place >= F.col("_lo")) & (place < F.col("_lo") + F.col("_c"))


def nearest_rank(df: DataFrame, by: list[str], value: str, qs: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """n, mean, min, max and percentiles by nearest rank: sorted[min(n - 1, int(q (n - 1) + 0.5))]."""
    aggs = [F.sum("_c").alias("n"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")]
    for q in qs:
        aggs.append(F.max(F.when(_at(F.least(F.col("_n") - 1, F.floor(F.lit(q) * (F.col("_n") - 1) + 0.5))), F.col(value))).alias(f"p{int(q * 100)}"))
    return _ranked(df, by, value).groupBy(*by).agg(*aggs)


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """sorted[n // 2]."""
    return _ranked(df, by, value).where(_at(F.floor(F.col("_n") / 2))).select(*by, F.col(value).alias("median"))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Pairs by key: their number, the upper median of b / a, and the change of the means in per cent."""
    x = cut(a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key).where("a <> 0").withColumn("ratio", F.col("b") / F.col("a")))
    means = x.agg(F.count("*").alias("pairs"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    med = upper_median(x, [], "ratio").select(F.col("median").alias("median_ratio"))
    return means.crossJoin(med).withColumn("mean_change_pct", (F.col("mean_b") / F.col("mean_a") - 1) * 100)


def bootstrap_median(df: DataFrame, by: list[str], value: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """95 % interval of the lower median by bootstrap: resampled counts of distinct values, one task per group.

    A group's distinct values with counts must fit one task; resampling is multinomial over them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        v, c = pdf[value].to_numpy(float), pdf["_c"].to_numpy(np.int64)
        n = int(c.sum())
        rng = np.random.default_rng(seed)
        meds = []
        for _ in range(0, resamples, 500):
            draw = rng.multinomial(n, c / n, size=min(500, resamples)).cumsum(axis=1)
            meds.append(v[(draw > (n - 1) // 2).argmax(axis=1)])
        m = np.concatenate(meds)[:resamples]
        return pdf[by].head(1).assign(n=n, low=float(np.quantile(m, 0.025)), high=float(np.quantile(m, 0.975)))

    kinds = dict(df.dtypes)
    return counts.groupBy(*by).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", n bigint, low double, high double")


# ---- arrays -----------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with the norms' product kept above 1e-30."""
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-30))


def compare_vectors(a: Column, b: Column) -> Column:
    """Largest and mean difference, cosine, and whether the largest entries stand at the same place."""
    d = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: F.abs(x - y))
    return F.struct(
        F.array_max(d).alias("max_abs"), (F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d)).alias("mean_abs"), cosine(a, b).alias("cosine"),
        (F.array_position(a, F.array_max(a)) == F.array_position(b, F.array_max(b))).alias("same_top"),
    )


def agreement(a: Column, b: Column) -> Column:
    """Share of equal places over the shorter length, and the first place that differs (the length if none does)."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.try_element_at(a, i) == F.try_element_at(b, i)))
    hits = F.size(F.filter(same, lambda s: s))
    first = F.array_position(same, False)
    return F.struct(F.when(n > 0, hits / n).otherwise(1.0).alias("agreement"), F.when((first == 0) | (n == 0), n).otherwise(first - 1).cast("bigint").alias("first_difference"))


def int8(v: Column) -> Column:
    """Symmetric 8-bit quantisation of an array: ids, scale and errors; halves go to the even number."""
    d = v.cast("array<double>")
    top = F.array_max(F.transform(d, lambda x: F.abs(x)))
    scale = F.when(top > 0, top / 127.0).otherwise(1.0)
    q = F.transform(d, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.bround(x / scale, 0))).cast("int"))
    err = F.zip_with(d, q, lambda x, i: F.abs(x - i * scale))
    return F.struct(q.alias("q"), scale.alias("scale"), F.array_max(err).alias("max_error"), (F.aggregate(err, F.lit(0.0), lambda s, x: s + x) / F.size(err)).alias("mean_error"))


def softmax(v: Column) -> Column:
    d = v.cast("array<double>")
    e = F.transform(d, lambda x: F.exp(x - F.array_max(d)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def top_k(df: DataFrame, by: str, token: str, logit: str, k: int) -> DataFrame:
    """Rows whose logit is at least the k-th largest of their position; k of 0 or less keeps all."""
    if k <= 0:
        return df
    w = Window.partitionBy(by).orderBy(F.desc(logit), token)
    edge = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(by).agg(F.min(logit).alias("_edge"))
    return df.join(edge, by).where(F.col(logit) >= F.col("_edge")).drop("_edge")


def top_p(df: DataFrame, by: str, token: str, logit: str, p: float) -> DataFrame:
    """The smallest set of likeliest tokens whose probability reaches p; the one that crosses is in."""
    if p >= 1:
        return df
    m = Window.partitionBy(by)
    x = df.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(m)))
    x = x.withColumn("_p", F.col("_e") / F.sum("_e").over(m))
    w = Window.partitionBy(by).orderBy(F.desc(logit), token).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("_b", F.coalesce(F.sum("_p").over(w), F.lit(0.0))).where(F.col("_b") < p).drop("_e", "_p", "_b")


def repetition_penalty(logit: Column, seen: Column, penalty: float) -> Column:
    """Logits of seen tokens are divided by the penalty if positive, else multiplied."""
    return F.when(seen, F.when(logit > 0, logit / penalty).otherwise(logit * penalty)).otherwise(logit)


def router(df: DataFrame, key: str, logits: str, k: int) -> DataFrame:
    """(key, expert, weight): the k likeliest experts of each row, weights renormalised over them."""
    x = df.select(key, F.posexplode(softmax(F.col(logits))).alias("expert", "p"))
    w = Window.partitionBy(key).orderBy(F.desc("p"), "expert")
    x = x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return x.select(key, "expert", (F.col("p") / F.sum("p").over(Window.partitionBy(key))).alias("weight"))


def load_balance(df: DataFrame, key: str, logits: str, k: int) -> DataFrame:
    """(experts, loss): how unevenly a router spreads rows; 1 where all experts get alike.

    The number of experts times the sum over experts of their share of routed weight times their mean probability.
    """
    x = df.select(key, F.size(logits).alias("_e"), F.posexplode(softmax(F.col(logits))).alias("expert", "p"))
    mean = x.groupBy("expert").agg(F.sum("p").alias("p"), F.max("_e").alias("e"))
    got = router(df, key, logits, k).groupBy("expert").agg(F.sum("weight").alias("w"))
    n = df.agg(F.count("*").alias("n"))
    per = mean.join(got, "expert", "left").na.fill(0.0, ["w"]).crossJoin(F.broadcast(n))
    return per.agg(F.max("e").alias("experts"), (F.max("e") * F.sum(F.col("w") / F.col("n") * F.col("p") / F.col("n"))).alias("loss"))


def account(steps: DataFrame, order: str, tokens: str, budget: int) -> DataFrame:
    """Adds ``before`` and ``left``, and ``over`` for steps that would cross the budget, which none should."""
    x = prefix_sum(steps, [order], {"before": tokens})
    after = F.col("before") + F.col(tokens)
    return x.withColumn("left", F.greatest(F.lit(budget) - after, F.lit(0))).withColumn("over", after > budget)


def markdown(df: DataFrame) -> str:
    """A small table as text for a report, columns as they come."""
    rows = [[("—" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.4f}" if isinstance(v, float) else str(v)).replace("|", "\\|") for v in r] for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


# ---- training telemetry -----------------------------------------------------


def eval_metrics(df: DataFrame, nll: str, tokens: str, hits: str | None = None) -> DataFrame:
    """Mean loss per token, perplexity (infinite where it overflows, null without tokens), accuracy."""
    loss = F.sum(nll) / F.nullif(F.sum(tokens), F.lit(0))
    cols = [F.sum(tokens).alias("tokens"), loss.alias("loss"), perplexity(loss).alias("perplexity")]
    if hits:
        cols.append((F.sum(hits) / F.nullif(F.sum(tokens), F.lit(0))).alias("accuracy"))
    return df.agg(*cols)


def perplexity(loss: Column) -> Column:
    return F.when(loss.isNull() | F.isnan(loss), F.lit(None)).when(loss > 709.0, F.lit(float("inf"))).otherwise(F.exp(loss))


def skip_runs(df: DataFrame, order: str, skipped: str, limit: int, by: list[str]) -> DataFrame:
    """Per group: skips in all, the run at the end, the longest run, and the place where a run first reached the limit."""
    w = Window.partitionBy(*by).orderBy(order)
    x = df.withColumn("_isl", F.sum(F.when(F.col(skipped), 0).otherwise(1)).over(w))
    x = x.where(F.col(skipped)).withColumn("_run", F.row_number().over(Window.partitionBy(*by, "_isl").orderBy(order)))
    last = df.groupBy(*by).agg(F.sum(F.when(F.col(skipped), 0).otherwise(1)).alias("_end"))
    runs = x.join(last, by, "right")
    return runs.groupBy(*by).agg(
        F.count("_run").alias("skips"), F.coalesce(F.max(F.when(F.col("_isl") == F.col("_end"), F.col("_run"))), F.lit(0)).alias("current_run"), F.coalesce(F.max("_run"), F.lit(0)).alias("longest_run"),
        F.min(F.when(F.col("_run") >= limit, F.col(order))).alias("aborted_at"),
    )


def interval_rates(df: DataFrame, by: list[str], order: str, seconds: str, steps: str, tokens: str) -> DataFrame:
    """Rates over all intervals and in the last one; null where no time passed."""
    rate = lambda n, s: F.when(s > 0, n / s)
    last = F.max_by(F.struct(F.col(seconds).alias("s"), F.col(tokens).alias("t")), order)
    x = df.groupBy(*by).agg(F.sum(seconds).alias("_s"), F.sum(steps).alias("_k"), F.sum(tokens).alias("_t"), last.alias("_l"))
    return x.select(
        *by, F.col("_t").alias("tokens"), rate(F.col("_t"), F.col("_s")).alias("tokens_per_s"), rate(F.col("_l.t"), F.col("_l.s")).alias("steady_tokens_per_s"),
        (F.col("_s") * 1000 / F.greatest(F.col("_k"), F.lit(1))).alias("ms_per_step"),
    )


def supervised_positions(rows: DataFrame, seq_len: int, mask: str | None = None) -> DataFrame:
    """Positions that carry a loss: all but the first of each row, or the mask's."""
    n = F.aggregate(F.slice(mask, 2, seq_len), F.lit(0), lambda a, m: a + m) if mask else F.lit(seq_len - 1)
    return rows.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("supervised"))


def value_counts(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """(id, n) over all rows, counted in each row first."""
    return rows.select(F.explode(ids).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
