"""Packing token streams into rows of fixed width.

A document's place in the stream is a prefix sum of lengths; rows come from the
overlap of its stretch with each row's, so a document is cut by ``slice`` and no token
is exploded.  Rows are then put together from their few pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import prefix_sum


def byte_ids(text: Column) -> Column:
    """The UTF-8 bytes of a text as token ids."""
    hexed = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    return F.transform(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))


def with_ends(ids: Column, bos: int | None = None, eos: int | None = None) -> Column:
    parts = ([F.array(F.lit(bos))] if bos is not None else []) + [ids] + ([F.array(F.lit(eos))] if eos is not None else [])
    return F.concat(*parts)


def pack(docs: DataFrame, seq_len: int, pos: str = "doc_id", pad: int = 0, drop_last: bool = False, mask: str | None = None, by: list[str] | None = None, before: int = 0, ids: Column | None = None, length: Column | None = None) -> DataFrame:
    """(by, row_idx, ids[, mask]) from (pos, ids[, mask]): documents end to end, cut at seq_len.

    With ``ids`` and ``length`` as expressions, of a text say, places are found from the lengths alone, and ids are made after the
    shuffle, which then moves the text and no arrays.

    The last row is padded, or dropped with drop_last; a null mask counts as all ones, padding as 0.
    ``before`` tokens are already in the first row (a resumed buffer).  With ``by``
    every group is a stream of its own.
    """
    by = by or []
    x = docs.withColumn("_n", F.size("ids") if length is None else length)
    x = prefix_sum(x.where("_n > 0"), [pos], {"_at": "_n"}, by).withColumn("_at", F.col("_at") + before)
    if ids is not None:
        x = x.withColumn("ids", ids)
    first, last = F.floor(F.col("_at") / seq_len), F.floor((F.col("_at") + F.col("_n") - 1) / seq_len)
    x = x.withColumn("row_idx", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("_at"), F.col("row_idx") * seq_len)
    hi = F.least(F.col("_at") + F.col("_n"), (F.col("row_idx") + 1) * seq_len)
    part = lambda c: F.slice(c, (lo - F.col("_at") + 1).cast("int"), (hi - lo).cast("int"))
    cols = [lo.alias("o"), part(F.col("ids")).alias("ids")]
    if mask:
        cols.append(part(F.coalesce(F.col(mask), F.transform("ids", lambda i: F.lit(1)))).alias("mask"))
    pieces = x.select(*by, "row_idx", F.struct(*cols).alias("p"))
    rows = pieces.groupBy(*by, "row_idx").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    out = rows.select(*by, "row_idx", F.flatten(F.col("ps.ids")).alias("ids"), *([F.flatten(F.col("ps.mask")).alias("mask")] if mask else []))
    short = F.lit(seq_len) - F.size("ids")
    if drop_last:
        return out.where(short == 0)
    fill = lambda v: F.when(short > 0, F.array_repeat(F.lit(v), short)).otherwise(F.array().cast("array<int>"))
    return out.select(*by, "row_idx", F.concat("ids", fill(pad)).alias("ids"), *([F.concat("mask", fill(0)).alias("mask")] if mask else []))


def padded(docs: DataFrame, seq_len: int, pad: int = 0) -> DataFrame:
    """One document per row, cut or padded to seq_len."""
    return docs.withColumn("ids", F.slice(F.concat("ids", F.array_repeat(F.lit(pad), seq_len)), 1, seq_len))


def batches(rows: DataFrame, size: int, drop_last: bool = False, by: list[str] | None = None) -> DataFrame:
    """Adds ``batch``; with drop_last the last short batch of each group (of all rows without one) goes."""
    by = by or []
    x = rows.withColumn("batch", F.floor(F.col("row_idx") / size))
    if not drop_last:
        return x
    full = rows.groupBy(*by).agg(F.floor((F.max("row_idx") + 1) / size).alias("_full"))
    x = x.join(F.broadcast(full), by) if by else x.crossJoin(F.broadcast(full))
    return x.where("batch < _full").drop("_full")


def counters(docs: DataFrame, seq_len: int, phase: str = "phase") -> DataFrame:
    """Per phase: documents, those with tokens, tokens, rows and padding of the packed stream."""
    n = F.size("ids").cast("bigint")
    tokens = F.coalesce(F.sum(n), F.lit(0))
    rows = F.ceil(tokens / seq_len)
    return docs.groupBy(phase).agg(F.count("*").alias("documents"), F.sum((n > 0).cast("bigint")).alias("packed_documents"), tokens.alias("tokens"), rows.alias("rows"), (rows * seq_len - tokens).alias("padding"))


def id_bound(max_id: int, dtype: str) -> None:
    """uint16 holds ids below 65,536."""
    most = {"uint16": 1 << 16, "int32": 1 << 31}[dtype]
    if max_id > most:
        raise ValueError(f"{dtype} holds ids below {most}, the vocabulary has {max_id}")


def resume(rows: DataFrame, row_idx: int) -> DataFrame:
    """Rows from a saved position on."""
    return rows.where(F.col("row_idx") >= row_idx)


def epochs(rows: DataFrame, times: int, size: int = 1, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """Adds ``epoch`` and ``batch``: the rows ``times`` over, in batches of ``size``; from a saved (epoch, row) on.

    Each epoch begins its batches anew; rows left over at its end are dropped.  (epoch, row_idx) is the order.
    """
    full = F.broadcast(rows.agg(F.floor((F.max("row_idx") + 1) / size).alias("_full")))
    x = rows.withColumn("batch", F.floor(F.col("row_idx") / size)).crossJoin(full).where("batch < _full").drop("_full")
    x = x.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return x.where((F.col("epoch") > start[0]) | ((F.col("epoch") == start[0]) & (F.col("row_idx") >= start[1])))
