"""Bloom filters of hashes: built by all tasks, as large as what is put in needs, and sent to every task.

No false negatives.  A filter has BITS bits for each entry, rounded up to a power of two, and at most
2**MOST bits (128 MB); beyond that it lets more through, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, LEAST, MOST = 12, 16, 30
#: Bits of the slices in which parts are moved and merged, and the most tasks that give out parts.
SLICE, TASKS = 20, 256
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x * _M
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _places(h: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    u = mix(h)
    return (u >> np.uint64(64 - log2)).astype(np.int64), (u & np.uint64((1 << log2) - 1)).astype(np.int64)


class Bloom:
    def __init__(self, log2: int, bits: np.ndarray) -> None:
        self.log2, self.bits = log2, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes (uint64) may have been put in."""
        ok = np.ones(len(h), bool)
        for x in _places(h, self.log2):
            ok &= ((self.bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1).astype(bool)
        return ok


def build(rows: DataFrame, entries: int, hashes):
    """A broadcast filter of all ``hashes(batch)``, an array of uint64 for each pandas batch of ``rows``."""
    log2 = min(MOST, max(LEAST, (BITS * max(entries, 1) - 1).bit_length()))
    width = min(log2, SLICE)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << (log2 - 3), np.uint8)
        for pdf in batches:
            for x in _places(hashes(pdf), log2):
                np.bitwise_or.at(bits, x >> 3, np.left_shift(1, x & 7).astype(np.uint8))
        cut = bits.reshape(-1, 1 << (width - 3))
        full = np.flatnonzero(cut.any(axis=1))
        for i in full:
            yield pd.DataFrame({"slice": [int(i)], "bits": [cut[i].tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = np.frombuffer(pdf["bits"].iloc[0], np.uint8).copy()
        for b in pdf["bits"].iloc[1:]:
            acc |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "bits": [acc.tobytes()]})

    schema = "slice int, bits binary"
    got = rows.coalesce(TASKS).mapInPandas(part, schema).groupBy("slice").applyInPandas(merge, schema).collect()
    bits = np.zeros(1 << (log2 - 3), np.uint8)
    for r in got:
        at = r["slice"] << (width - 3)
        bits[at : at + (1 << (width - 3))] = np.frombuffer(r["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(Bloom(log2, bits))


def of_column(rows: DataFrame, column: str, entries: int):
    """A broadcast filter of a column of bigints."""
    return build(rows.select(column), entries, lambda pdf: pdf[column].to_numpy(np.int64).view(np.uint64))


def keep(rows: DataFrame, column: str, shared) -> DataFrame:
    """The rows whose bigint ``column`` may be in the filter; it is evaluated before any shuffle."""

    @F.pandas_udf("boolean")
    def may(s: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(s.to_numpy(np.int64).view(np.uint64)))

    return rows.where(may(F.col(column)))
