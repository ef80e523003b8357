"""Conversations as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import role, strip_space
from .pack import byte_ids

TURN_SEP = "\n\n"


def delivered_once(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per (conv_id, turn), the earliest delivery."""
    first = F.min_by(F.struct("role", content), F.struct("ingested_at", content))
    return df.groupBy("conv_id", "turn").agg(first.alias("r")).select("conv_id", "turn", "r.role", F.col(f"r.{content}").alias("content"))


def segments(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): roles by alias, texts stripped, empty turns gone."""
    x = df.select("conv_id", "turn", role(F.col("role")).alias("role"), strip_space(F.coalesce("content", F.lit(""))).alias("text"))
    return x.where("text <> ''")


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def _joined(df: DataFrame) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat(capitalised(F.col("role")), F.lit(": "), F.col("text")).alias("s"))))
    return df.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["s"]), TURN_SEP).alias("text"))


def linearize(df: DataFrame) -> DataFrame:
    """(conv_id, text): ``Role: text`` turns with blank lines between."""
    return _joined(segments(df))


def linearize_loose(df: DataFrame) -> DataFrame:
    """As above, but roles as they are and empty turns kept."""
    x = df.select("conv_id", "turn", F.coalesce(F.nullif(strip_space(F.col("role")), F.lit("")), F.lit("unknown")).alias("role"), strip_space(F.coalesce("content", F.lit(""))).alias("text"))
    return _joined(x).withColumn("text", strip_space(F.col("text")))


def encode(df: DataFrame, eos: int, bos: int | None = None, ids=byte_ids) -> DataFrame:
    """(conv_id, ids, mask): only assistant tokens and the eos after them are supervised."""
    x = segments(df).withColumn("_ids", ids(F.concat(capitalised(F.col("role")), F.lit(": "), F.col("text"))))
    bot = F.col("role") == "assistant"
    tail = F.when(bot, F.array(F.lit(eos))).otherwise(F.array().cast("array<int>"))
    whole = F.concat("_ids", tail)
    mask = F.transform(whole, lambda i: F.when(bot, 1).otherwise(0))
    x = x.select("conv_id", F.struct("turn", whole.alias("i"), mask.alias("m")).alias("t"))
    out = x.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("conv_id", F.flatten(F.col("ts.i")).alias("ids"), F.flatten(F.col("ts.m")).alias("mask"))
    if bos is None:
        return out
    return out.select("conv_id", F.concat(F.array(F.lit(bos)), "ids").alias("ids"), F.concat(F.array(F.lit(0)), "mask").alias("mask"))


def mask_counts(encoded: DataFrame) -> DataFrame:
    return encoded.select("conv_id", F.size("ids").cast("bigint").alias("tokens"), F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("supervised"))
