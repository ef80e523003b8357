"""Mixing sources into one order, budgets and splits."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import position, prefix_sum


def shuffled(n: int, seed: int) -> list[int]:
    """The order in which sources are presented."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


#: Most steps that are remembered while a period is looked for.
PERIOD = 1_000_000


class Rota:
    """Smooth weighted round-robin over counts, as runs of steps that repeat.

    Each step every active source gains its weight; the largest gain, of equals the first
    presented, gives a record and loses the total of all weights, exhausted sources' too.
    A source found exhausted costs a step without output.

    Between two exhaustions the gains go round in a circle.  For whole weights that is seen
    from the gains' differences, else from the gains themselves, which repeat exactly or the steps are listed.
    So what is held is a period per exhaustion, whatever the number of records.
    """

    def __init__(self, counts: Sequence[int], weights: Sequence[float], seed: int = 0, epochs: int = 1) -> None:
        if not counts:
            raise ValueError("no sources")
        if any(w < 0 for w in weights):
            raise ValueError("weights must not be negative")
        if sum(weights) <= 0:
            raise ValueError("weights must not all be 0")
        self.weights, self.total = list(weights), sum(weights)
        self.whole = all(float(w).is_integer() for w in weights) and self.total * len(counts) < 2**50
        self.left = [n * epochs for n in counts]
        self.runs: list[tuple[int, np.ndarray, int]] = []  # first output position, sources in turn, how often
        self.at = 0
        active = shuffled(len(counts), seed)
        gain = {i: 0.0 for i in active}
        while active:
            active = self._until_exhausted(active, gain)

    def _emit(self, turns: list[int], times: int = 1) -> None:
        if turns and times:
            self.runs.append((self.at, np.array(turns, np.int32), times))
            self.at += len(turns) * times

    def _until_exhausted(self, active: list[int], gain: dict[int, float]) -> list[int]:
        turns: list[int] = []
        seen: dict[tuple, int] | None = {}
        while True:
            if seen is not None:
                base = gain[active[0]] if self.whole else 0.0
                state = tuple(gain[i] - base for i in active)
                if state in seen:
                    period = turns[seen[state]:]
                    per = {i: period.count(i) for i in set(period)}
                    times = min(self.left[i] // n for i, n in per.items())
                    self._emit(turns)
                    self._emit(period, times)
                    for i, n in per.items():
                        self.left[i] -= n * times
                    turns, seen = [], None  # less than one period is left
                else:
                    seen[state] = len(turns)
            if len(turns) >= PERIOD:
                self._emit(turns)
                turns, seen = [], {} if seen is not None else None
            for i in active:
                gain[i] += self.weights[i]
            pick = max(active, key=lambda i: gain[i])  # the first of equals
            gain[pick] -= self.total
            if not self.left[pick]:
                self._emit(turns)
                return [i for i in active if i != pick]
            self.left[pick] -= 1
            turns.append(pick)

    def places(self, source: int, k: np.ndarray) -> np.ndarray:
        """Output positions of a source's records of numbers ``k``."""
        first, have = [], 0
        mine = []
        for at, turns, times in self.runs:
            own = np.flatnonzero(turns == source)
            if len(own):
                first.append(have)
                mine.append((at, len(turns), own))
                have += len(own) * times
        out = np.zeros(len(k), np.int64)
        run = np.searchsorted(np.array(first), k, "right") - 1
        for r in np.unique(run):
            at, size, own = mine[r]
            here = run == r
            j = k[here] - first[r]
            out[here] = at + j // len(own) * size + own[j % len(own)]
        return out


def weighted(df: DataFrame, sources: Sequence[tuple[str, float]], pos: str = "doc_id", seed: int = 0, epochs: int = 1) -> DataFrame:
    """Rows of the named sources with ``epoch`` and ``out_pos``, their place in the mix.

    The counts of the sources come to the driver, the rota of their turns goes to the tasks; every row
    works its place out from its rank within its source, so no row is planned on the driver or joined.
    """
    spark = df.sparkSession
    names = [s for s, _ in sources]
    rows = df.where(F.col("source").isin(names))
    have = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    counts = [have.get(s, 0) for s in names]
    shared = spark.sparkContext.broadcast(Rota(counts, [w for _, w in sources], seed, epochs))
    ranked = position(rows, [pos], "_rank", ["source"])
    wide = ranked.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    of = lambda xs: F.element_at(F.create_map(*(F.lit(x) for p in zip(names, xs) for x in p)), F.col("source"))

    @F.pandas_udf("bigint")
    def place(source: pd.Series, k: pd.Series) -> pd.Series:
        out = np.zeros(len(k), np.int64)
        for i in source.unique():
            here = (source == i).to_numpy()
            out[here] = shared.value.places(int(i), k.to_numpy()[here])
        return pd.Series(out)

    return wide.withColumn("out_pos", place(of(list(range(len(names)))), F.col("epoch") * of(counts) + F.col("_rank"))).drop("_rank")


def source_counts(df: DataFrame, seeded: Sequence[str] = ()) -> DataFrame:
    """Records per source, missing ones as ``unknown``; the named ones come with 0 too."""
    got = df.groupBy(F.coalesce(F.col("source"), F.lit("unknown")).alias("source")).agg(F.count("*").alias("records"))
    if not seeded:
        return got
    names = df.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(seeded)], "source string")
    return names.join(got, "source", "full").na.fill(0, ["records"])


def first_rows(df: DataFrame, n: int, pos: str = "doc_id", skip: int = 0) -> DataFrame:
    """Rows skip .. skip + n of the order (a distributed top-k)."""
    return df.orderBy(pos).offset(skip).limit(n)


def budget(df: DataFrame, max_docs: int | None = None, max_chars: int | None = None, pos: str = "doc_id") -> DataFrame:
    """Rows in order while fewer than max_docs and max_chars went before; the one that crosses is in."""
    x = prefix_sum(df.withColumn("_one", F.lit(1)).withColumn("_chars", F.length(F.coalesce("text", F.lit("")))), [pos], {"_docs": "_one", "_before": "_chars"})
    if max_docs is not None:
        x = x.where(F.col("_docs") < max_docs)
    if max_chars is not None:
        x = x.where(F.col("_before") < max_chars)
    return x.drop("_one", "_chars", "_docs", "_before")


def split_sizes(n: int, ratio: float) -> int:
    """Training records of n: at least one, at most all but one; halves go to the even number."""
    if n < 2:
        raise ValueError("a split needs two records")
    return min(max(1, round(n * ratio)), n - 1)


#: Most records whose split follows the seeded permutation itself; it is one bit a record on every task, but is made in one place.
PERMUTED = 20_000_000


def seeded_split(df: DataFrame, ratio: float, seed: int, pos: str = "doc_id") -> DataFrame:
    """Adds ``in_train``: the first part of a seeded permutation of places; order is kept.

    Beyond PERMUTED records the permutation is by a seeded hash of ``pos``, of the same exact size.
    """
    n = df.count()
    k = split_sizes(n, ratio)
    if n > PERMUTED:
        keyed = df.withColumn("_h", F.xxhash64(F.lit(seed), pos))
        return position(keyed, ["_h", pos], "_rank").withColumn("in_train", F.col("_rank") < k).drop("_rank", "_h")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    bits = np.zeros(n, bool)
    bits[order[:k]] = True
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.pandas_udf("boolean")
    def chosen(rank: pd.Series) -> pd.Series:
        r = rank.to_numpy(np.int64)
        return pd.Series((shared.value[r >> 3] >> (7 - (r & 7)).astype(np.uint8) & 1).astype(bool))

    return position(df, [pos], "_rank").withColumn("in_train", chosen(F.col("_rank"))).drop("_rank")


def regions(df: DataFrame, val_skip: int, val_tokens: int, target_tokens: int, tokens: str = "num_tokens", pos: str = "doc_id") -> DataFrame:
    """Adds ``phase``: ``skipped``, ``val``, ``train`` or ``unused``.

    After val_skip rows, validation takes rows until it has val_tokens, then training until both
    have target_tokens; crossing rows are in.
    """
    x = position(df, [pos], "_i")
    x = x.withColumn("_t", F.when(F.col("_i") >= val_skip, F.col(tokens)).otherwise(0))
    x = prefix_sum(x, [pos], {"_before": "_t"})
    phase = F.when(F.col("_i") < val_skip, "skipped").when(F.col("_before") < val_tokens, "val").when(F.col("_before") < target_tokens, "train").otherwise("unused")
    return x.withColumn("phase", phase).drop("_i", "_t", "_before")


def shared_rows(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys in both: none if the regions are disjoint."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct()
