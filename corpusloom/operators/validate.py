"""Checks of packed shards and manifests.  Each gives the rows at fault, all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_violations(df: DataFrame, vocab: int, ids: str = "ids") -> DataFrame:
    """Rows with an id below 0 or from vocab on; their smallest and largest id."""
    lo, hi = F.array_min(ids), F.array_max(ids)
    return df.withColumn("min_id", lo).withColumn("max_id", hi).where((lo < 0) | (hi >= vocab))


def shape_violations(df: DataFrame, seq_len: int, ids: str = "ids") -> DataFrame:
    return df.withColumn("width", F.size(ids)).where(F.col("width") != seq_len)


def manifest_problems(manifest: DataFrame, facts: DataFrame) -> DataFrame:
    """(shard, problem, listed, found): missing or stray shards and counts that disagree.

    manifest and facts are (shard, count).
    """
    m, f = manifest.select("shard", F.col("count").alias("listed")), facts.select("shard", F.col("count").alias("found"))
    x = m.join(f, "shard", "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "stray").when(F.col("listed") != F.col("found"), "count")
    return x.withColumn("problem", problem).where("problem is not null").select("shard", "problem", "listed", "found")


def conflicts(facts: DataFrame) -> DataFrame:
    """(label, sources, distinct_values): facts (label, origin, value) on which origins disagree."""
    x = facts.where("value is not null").groupBy("label").agg(F.count("*").alias("sources"), F.countDistinct("value").alias("distinct_values"))
    return x.where("distinct_values > 1")


def tail_run(ids: Column, pad: int) -> Column:
    """How many equal ids ``pad`` end a row."""
    rev = F.reverse(ids)
    first = F.array_position(F.transform(rev, lambda i: i != pad), True)
    return F.when(first == 0, F.size(ids)).otherwise(first - 1).cast("bigint")


def pad_problems(rows: DataFrame, pad: int, order: str = "row_idx") -> DataFrame:
    """Rows other than the last that end in padding."""
    last = rows.agg(F.max(order).alias("_last"))
    x = rows.withColumn("padding", tail_run(F.col("ids"), pad)).crossJoin(F.broadcast(last))
    return x.where((F.col("padding") > 0) & (F.col(order) < F.col("_last"))).drop("_last")


def resolve(values: dict[str, int | None]) -> int:
    """One value on which all origins that know it agree."""
    known = {k: v for k, v in values.items() if v is not None}
    if not known:
        raise ValueError("nothing tells the value")
    if len(set(known.values())) > 1:
        raise ValueError(f"origins disagree: {known}")
    return next(iter(known.values()))


def identity_hash(manifest: DataFrame) -> DataFrame:
    """One hash of (shard, count) without paths, so that a moved corpus is still the same."""
    base = F.regexp_extract("shard", r"([^/]+)$", 1)
    return manifest.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", base, F.col("count").cast("string")))), ","), 256).alias("identity"))


def lookup(rows: DataFrame, registry: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Adds the registry's ``name`` for each row's shape (null-safe on all keys); ``known`` is false where there is none."""
    right = registry.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(name)).dropDuplicates([f"_k_{k}" for k in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(right[f"_k_{k}"])
    return rows.join(right, cond, "left").select(*(rows[c] for c in rows.columns), name, F.col(name).isNotNull().alias("known"))


def pairing_problems(assets: DataFrame, presets: DataFrame) -> DataFrame:
    """(asset, owners, problem): assets (asset) that not exactly one preset (preset, asset) claims, and claims of assets that aren't there."""
    claims = presets.where("asset is not null").groupBy("asset").agg(F.countDistinct("preset").alias("owners"))
    x = assets.select("asset").distinct().withColumn("there", F.lit(True)).join(claims, "asset", "full").na.fill(0, ["owners"])
    problem = F.when(F.col("there").isNull(), "no asset").when(F.col("owners") == 0, "no owner").when(F.col("owners") > 1, "several owners")
    return x.withColumn("problem", problem).where("problem is not null").select("asset", "owners", "problem")
