"""Records that hold evaluation texts: by id, by substring, by shared word n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, strip_space, word_ngrams, words
from ..session import BROADCAST_BYTES, cut, maybe_broadcast

ID_FIELDS = ("doc_id", "id", "url", "sha256")


def hits_by_id(df: DataFrame, ids: DataFrame, pos: str) -> DataFrame:
    """Positions of rows one of whose string id fields is in ``ids.id``."""
    kinds = dict(df.dtypes)
    fields = [c for c in ID_FIELDS if kinds.get(c) == "string"]
    if not fields:
        return df.select(pos).limit(0)
    listed = ids.select(strip_space(F.col("id").cast("string")).alias("v")).distinct()
    keys = df.select(pos, F.explode(F.array(*(strip_space(F.col(c)) for c in fields))).alias("v")).where("v is not null")
    return keys.join(maybe_broadcast(listed), "v", "left_semi").select(pos).distinct()


#: Bytes of evaluation texts that are looked for at a time; beyond that the rows are passed over once for each part.
NEEDLE_BYTES = 4 << 20


def _finder(needles: list[str]):
    """Whether a text contains any of the needles, all looked for in one pass where the automaton is there."""
    try:
        import ahocorasick
    except ImportError:
        return lambda t: any(n in t for n in needles)
    machine = ahocorasick.Automaton()
    for n in needles:
        machine.add_word(n, 1)
    machine.make_automaton()
    return lambda t: next(machine.iter(t), None) is not None


def _contains(shared):
    @F.pandas_udf("boolean")
    def contains(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        has = _finder(shared.value)
        for s in batches:
            yield s.map(has).astype(bool)

    return contains


def hits_by_substring(df: DataFrame, texts: Sequence[str] | DataFrame, pos: str) -> DataFrame:
    """Positions of rows whose collapsed text contains a collapsed evaluation text (a list, or ``texts.text``)."""
    spark = df.sparkSession
    given = texts.select(F.col("text").alias("t")) if isinstance(texts, DataFrame) else spark.createDataFrame([(t,) for t in texts], "t string")
    listed = given.select(collapse(F.col("t")).alias("t")).where("t <> ''").distinct()
    size = listed.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = -(-size // NEEDLE_BYTES)
    hay = collapse(F.coalesce(F.col("text"), F.lit("")))
    out = None
    for k in range(parts):
        needles = [r[0] for r in listed.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == k).collect()]
        hit = df.where(_contains(spark.sparkContext.broadcast(needles))(hay)).select(pos)
        out = hit if out is None else out.unionByName(hit)
    return df.select(pos).limit(0) if out is None else out if parts == 1 else out.distinct()


def hits_by_ngram(df: DataFrame, texts: DataFrame, n: int, pos: str) -> DataFrame:
    """Positions of rows that share a run of n words with an evaluation text (``texts.text``).

    The evaluation grams are counted, and broadcast if they are few enough; else both sides meet by shuffle.
    """
    ws = words(F.coalesce(F.col("text"), F.lit(""))).alias("ws")
    hashes = F.array_distinct(F.transform(word_ngrams(F.col("ws"), n), lambda g: F.xxhash64(g)))
    grams = cut(texts.select(ws).select(F.explode(hashes).alias("h")).distinct())
    rows = df.select(pos, ws).select(pos, F.explode(hashes).alias("h"))
    near = F.broadcast(grams) if 16 * grams.count() <= BROADCAST_BYTES else grams
    return rows.join(near, "h", "left_semi").select(pos).distinct()


def apply(df: DataFrame, hits: DataFrame, pos: str, action: str = "drop") -> DataFrame:
    """Drop the rows hit, or flag them: ``contaminated`` is true or null, never false."""
    if action == "drop":
        return df.join(hits, pos, "left_anti")
    if action != "flag":
        raise ValueError("action must be 'drop' or 'flag'")
    return df.join(hits.select(pos, F.lit(True).alias("contaminated")), pos, "left")
