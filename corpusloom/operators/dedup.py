"""Exact and near-duplicate removal in stream order.

Order is a column (``pos``, unique).  Every step is a grouped minimum, combined
before the shuffle, so a text or bucket that holds a third of all rows is no hot task.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_shingles, characters, collapse
from ..session import cut

# The prime of the hash family, and its usual size.
PRIME = (1 << 61) - 1
PERMUTATIONS, BANDS, SHINGLE = 64, 8, 5


def digest(normalize: bool = True) -> Column:
    t = F.coalesce(F.col("text"), F.lit(""))
    return F.sha2(collapse(t) if normalize else t, 256)


def exact(df: DataFrame, pos: str = "doc_id", normalize: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The first row of each text.

    With ``keep``, only pos and those columns of it, by one aggregate in which no text moves.  Without, the input is
    read twice and its rows joined to the first positions; cut it before if it is costly.
    """
    if keep is not None:
        return df.groupBy(digest(normalize).alias("_d")).agg(F.min(F.struct(pos, *keep)).alias("_m")).select("_m.*")
    first = df.groupBy(digest(normalize).alias("_d")).agg(F.min(pos).alias(pos)).select(pos)
    return df.join(first, pos, "left_semi")


def exact_capped(df: DataFrame, max_seen: int, pos: str = "doc_id", normalize: bool = True) -> DataFrame:
    """Only the first ``max_seen`` distinct texts are remembered; later ones are all kept, repeats too.

    The rank of a text is its first position's; the smallest ``max_seen`` are found by a
    distributed top-k whose threshold, one number, comes to the driver.
    """
    x = df.select(pos, digest(normalize).alias("_d"))
    firsts = x.groupBy("_d").agg(F.min(pos).alias("_first"))
    edge = firsts.orderBy("_first").select("_first").limit(max_seen).agg(F.max("_first")).first()[0] if max_seen > 0 else None
    known = F.lit(False) if edge is None else F.col("_first") <= edge
    keep = x.join(firsts, "_d").where(~known | (F.col(pos) == F.col("_first"))).select(pos)
    return df.join(keep, pos, "left_semi")


# ---- MinHash ----------------------------------------------------------------


def family(permutations: int = PERMUTATIONS, seed: int = 0) -> list[tuple[int, int]]:
    """The (a, b) of each hash function, from seeded generators."""
    out = []  # fixed values: the seeds and the order of the draws
    for i in range(permutations):
        rng = random.Random(f"{seed}:{i}")
        out.append((rng.randrange(1, PRIME), rng.randrange(0, PRIME)))
    return out


def _mod(x: np.ndarray) -> np.ndarray:
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


def affine_min(h: np.ndarray, fam: list[tuple[int, int]]) -> list[int]:
    """min over h of (a h + b) mod 2**61 - 1 for every (a, b), for 32-bit h, in 64-bit steps."""
    a = np.array([x for x, _ in fam], np.uint64)[:, None]
    b = np.array([x for _, x in fam], np.uint64)[:, None]
    hi, lo = a >> np.uint64(32), a & np.uint64(0xFFFFFFFF)
    best = np.full(len(fam), PRIME, np.uint64)
    for s in range(0, len(h), 2048):
        x = h[None, s : s + 2048].astype(np.uint64)
        t = _mod(hi * x)  # below 2**61
        # t * 2**32 mod p: bits beyond the 61st come in again at the bottom
        t = _mod(((t & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (t >> np.uint64(29)))
        best = np.minimum(best, _mod(_mod(t + _mod(lo * x)) + b).min(axis=1))
    return best.tolist()


def signature(text: Column, permutations: int = PERMUTATIONS, shingle: int = SHINGLE, seed: int = 0) -> Column:
    """MinHash of a text's character shingles (32 bits of their MD5); null for a text without any."""
    import hashlib

    fam = family(permutations, seed)

    @F.pandas_udf("array<bigint>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for s in batches:
            out = []
            for t in s:
                if not t:
                    out.append(None)
                    continue
                grams = {t[i : i + shingle] for i in range(len(t) - shingle + 1)} or {t}
                hs = []
                for g in grams:
                    x = known.get(g)
                    if x is None:
                        if len(known) > 500_000:
                            known.clear()
                        x = known[g] = int.from_bytes(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[:4], "big")
                    hs.append(x)
                out.append(affine_min(np.array(hs, np.uint64), fam))
            yield pd.Series(out)

    # Not to be evaluated a second time, below a repartition, for a filter on its result.
    return sign.asNondeterministic()(collapse(F.coalesce(text, F.lit(""))))


def shingle_counts(df: DataFrame) -> DataFrame:
    x = df.withColumn("_c", characters(collapse(F.coalesce(F.col("text"), F.lit("")))))
    return x.withColumn("n_shingles", F.size(char_shingles(F.col("_c"), SHINGLE)).cast("bigint")).drop("_c")


def near_by_bands(signed: DataFrame, pos: str, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """Survivors of the ordered rule, from (pos, sig): in order and band by band, a row whose band was
    seen is dropped, but the bands before stay seen.  So only rows that reach a band count
    there, and the survivors of band b are the first rows of each of its keys among the
    survivors of band b - 1.
    """
    if permutations % bands:
        raise ValueError("permutations must be a multiple of bands")
    rows = permutations // bands
    keys = [F.xxhash64(F.lit(b), F.slice("sig", b * rows + 1, rows)).alias(f"k{b}") for b in range(bands)]
    alive = cut(signed.where("sig is not null").select(pos, *keys))
    for b in range(bands):
        rest = [f"k{c}" for c in range(b + 1, bands)]
        alive = alive.groupBy(f"k{b}").agg(F.min(F.struct(pos, *rest)).alias("m")).select(f"m.{pos}", *(f"m.{k}" for k in rest))
    return alive


def near(df: DataFrame, pos: str = "doc_id", bands: int = BANDS, permutations: int = PERMUTATIONS, shingle: int = SHINGLE, seed: int = 0) -> DataFrame:
    """Rows that survive banded MinHash; texts without shingles are dropped."""
    signed = df.select(pos, signature(F.col("text"), permutations, shingle, seed).alias("sig"))
    return df.join(near_by_bands(signed, pos, bands, permutations), pos, "left_semi")


def near_capped(signed: DataFrame, pos: str, cap: int, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """As above with at most ``cap`` remembered bands: at the cap a row is kept at its first unseen band.

    The rule depends on every row before, so it is replayed in one task, over 8 hashes a row.
    """
    rows = permutations // bands
    keys = [F.xxhash64(F.lit(b), F.slice("sig", b * rows + 1, rows)).alias(f"k{b}") for b in range(bands)]

    def replay(batches):
        seen: set = set()
        for pdf in batches:
            keep = []
            for row in pdf[[f"k{b}" for b in range(bands)]].itertuples(index=False):
                ok = True
                for b, k in enumerate(row):
                    if (b, k) in seen:
                        ok = False
                        break
                    if len(seen) >= cap:
                        break
                    seen.add((b, k))
                keep.append(ok)
            yield pdf.loc[keep, [pos]]

    kind = signed.schema[pos].dataType.simpleString()
    return signed.where("sig is not null").select(pos, *keys).orderBy(pos).coalesce(1).mapInPandas(replay, f"{pos} {kind}")
