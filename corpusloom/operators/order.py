"""Order without one large task: prefix sums and ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def prefix_sum(df: DataFrame, order: list[str], values: dict[str, str], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds, for each ``name: column``, the sum of ``column`` over all earlier rows (exclusive).

    Only keys and values are ranked: they are range-partitioned by (by + order) and cut there; sums per
    partition and group are one small row each, scanned by a window over partition numbers and joined back, so
    no task holds more than a range of rows even where one group is a third of all.  Other
    columns come back by a join on the keys and are neither sampled nor written out.
    Rows that tie in the order must not exist; add a unique column to it.
    """
    by = by or []
    keys = [*by, *order]
    narrow = list(dict.fromkeys([*keys, *values.values()]))
    rest = [c for c in df.columns if c not in narrow]
    summed = _prefix_sum(df.select(*narrow), order, values, by, parts)
    if not rest:
        return summed.select(*df.columns, *values)
    right = summed.select(*(F.col(k).alias(f"_k_{n}") for n, k in enumerate(keys)), *values)
    cond = F.lit(True)
    for n, k in enumerate(keys):
        cond = cond & df[k].eqNullSafe(right[f"_k_{n}"])
    return df.join(right, cond).select(*(df[c] for c in df.columns), *values)


def _prefix_sum(df: DataFrame, order: list[str], values: dict[str, str], by: list[str], parts: int | None) -> DataFrame:
    cols = [F.col(k) for k in [*by, *order]]
    ranged = (df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    totals = ranged.groupBy("_part", *by).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_t_{n}") for n, c in values.items()))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *by, *(F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)).alias(f"_b_{n}") for n in values))
    local = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = ranged
    for n, c in values.items():
        x = x.withColumn(n, F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))).over(local), F.lit(0)))
    cond = x["_part"] == bases["_part"]
    for b in by:
        cond = cond & x[b].eqNullSafe(bases[b])
    joined = x.join(bases, cond)
    return joined.select(*(x[c] for c in df.columns), *((x[n] + bases[f"_b_{n}"]).alias(n) for n in values))


def position(df: DataFrame, order: list[str], name: str = "rn", by: list[str] | None = None) -> DataFrame:
    """Adds the number of earlier rows (from 0) in the order, per group or in all."""
    return prefix_sum(df.withColumn("_one", F.lit(1).cast("bigint")), order, {name: "_one"}, by).drop("_one")
