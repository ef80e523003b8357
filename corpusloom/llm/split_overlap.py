"""Same or near-same records across splits: an edit-distance segment join.

Texts are taken as sequences of words (case, accents, markup, escaping and
punctuation off).  Two texts of n and m words are near-same where at least
``need = ceil(0.8 * max(n, m))`` words stand in the same order in both.  Put as edits: at
most n - need words of the one are deleted and at most m - need words of the other
inserted, so their distance in deletions and insertions is at most ``k = n + m - 2 * need``
(about two fifths of the length: a word replaced or moved counts twice).

1. Records with the same words form one class per dataset, whatever their number;
   only classes are compared, and records come back by a join at the end.
2. A text's words are numbered (the second "the" is another word than the first) and put
   in one order for all texts of a dataset: the rarest first, as counted over all classes.
3. Segments are single words, which only a deletion spoils: of n words at most d = n - need
   are without a partner in m words, so the first of those shared is among the d + 1 rarest of
   the one and, by the same reckoning, the m - need + 1 rarest of the other.  Each evaluation class gives out its
   n / 5 + 1 rarest words with their rank; training classes do too, less
   words that a Bloom filter of the evaluation side's, sized by them, rules out.
4. Rows meet by word where the ranks leave enough words on either side: 4 * m <= 5 * (n - rank) and
   the other way round.  Both sides carry a parity sketch of their numbered words, 256 bits or, for long texts, 512, of
   which an edit changes one bit.
5. Each pair left is decided once by banded dynamic programming: the table of edits
   within n - need cells below and m - need cells above the diagonal, a row at a time in a machine word.

A word held by many evaluation classes is spread over as many salts as its count asks for, so no key
gathers in one task.

Edge cases: null, blank or wordless texts match nothing; a record delivered again
counts once; null or unknown splits take no part; a record on both sides pairs
with others but not with itself; empty tables give empty results; other columns
are ignored.  Classes are told apart by 64-bit hashes of dataset and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_words, strip_space
from ..session import cut, shuffle_width
from . import bloom
from .bloom import mix as _mix

#: Fifths of the longer text's words that must stand in order in the other.
FIFTHS = 4
#: Bits of the table of counts that words are ordered by, and of its slices; the most tasks that fill one.
COUNTS, SLICE, COUNTERS = 22, 16, 64
#: Bits of a word's hash that tell it from others as often met.
TELL = 40
#: Texts of at least so many words have sketches of 512 bits.
LONG = 160
#: Meetings worked on at once, and the least of one word that are compared as a table.
BLOCK, TABLE = 1 << 21, 1 << 12
#: A word of at least HEAVY evaluation classes and HEAVY_SHARE of all is dealt out, HEAVY classes to a salt, over at most
#: SALTS.  There are at most (words of a class) / HEAVY_SHARE such words.
HEAVY, HEAVY_SHARE, SALTS = 1 << 15, 0.0005, 1024
#: Most words of a segment of ``segments_of``.
SEGMENT = 3


def words_needed(n: int, m: int) -> int:
    """Words that texts of n and m words must have in order."""
    return -(-FIFTHS * max(n, m) // 5)


def edits_allowed(n: int, m: int) -> int:
    """Deletions and insertions that two such texts may be apart; below 0 if their lengths forbid it."""
    return n + m - 2 * words_needed(n, m)


def most_edits(n: int) -> int:
    """The most edits that a text of n words may be away from any partner: one as long, or a little longer."""
    return max(edits_allowed(n, m) for m in range(n, n + 6) if words_needed(n, m) <= n)


def near_same(a: list, b: list) -> bool:
    """Whether b comes from a by at most n - need deletions and m - need insertions.

    Dynamic programming over the cells that so many edits can reach, bit i of ``row`` being 0 where the
    best alignment of a[:i + 1] keeps one word more than that of a[:i].  A pair is given up as
    soon as more words of b are without a partner than may be inserted.
    """
    need = words_needed(len(a), len(b))
    deletes, inserts = len(a) - need, len(b) - need
    if deletes < 0 or inserts < 0:
        return False
    i, n, m = 0, len(a), len(b)
    while i < n and i < m and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    need -= len(a) - (n - i)
    a, b = a[i:n], b[i:m]
    if need <= 0:
        return True
    where: dict = {}
    for j, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(a)) - 1
    band = (1 << (deletes + inserts + 1)) - 1
    row = full
    for j, y in enumerate(b):
        at = where.get(y, 0)
        if at:
            at &= band << (j - inserts) if j > inserts else band >> (inserts - j)
            kept = row & at
            row = ((row + kept) | (row - kept)) & full
        if j & 15 == 15 and len(a) - row.bit_count() + inserts <= j:
            return False
    return len(a) - row.bit_count() >= need


# ---- hashing ----------------------------------------------------------------

def _dataset_hash(d: str) -> int:
    return xxhash.xxh64_intdigest(d)


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for pdf in batches:
        ids, keys = [], []
        for d, text in zip(pdf["dataset_id"], pdf["text"]):
            ws = plain_words(text)
            if len(known) > 400_000:
                known.clear()
            row = []
            for w in ws:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh32_intdigest(w) - (1 << 31)
                row.append(h)
            ids.append(row)
            keys.append(xxhash.xxh3_64_intdigest(d + "\n" + " ".join(ws)) - (1 << 63))
        yield pdf.drop(columns=["text"]).assign(cls=keys, words=ids)


def sided(records: DataFrame, stages: DataFrame) -> DataFrame:
    """(record_id, dataset_id, split, source, in_train, in_val, cls, words): records of the stages' splits."""
    norm = lambda c: F.lower(strip_space(F.col(c)))
    sides = (
        stages.select("dataset_id", norm("train_split").alias("s"), F.lit(1).alias("t"), F.lit(0).alias("v"))
        .unionByName(stages.select("dataset_id", norm("val_split").alias("s"), F.lit(0).alias("t"), F.lit(1).alias("v")))
        .where("s is not null and dataset_id is not null").groupBy("dataset_id", "s").agg(F.max("t").alias("in_train"), F.max("v").alias("in_val"))
    )
    rows = records.select("record_id", "dataset_id", norm("split").alias("s"), "source", "text").where("record_id is not null and text is not null")
    rows = rows.join(F.broadcast(sides), ["dataset_id", "s"]).withColumnRenamed("s", "split")
    out = rows.mapInPandas(_classes, "dataset_id string, split string, record_id bigint, source string, in_train int, in_val int, cls bigint, words array<int>")
    return out.where("size(words) > 0")


# ---- candidates -------------------------------------------------------------


def numbered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all words of a batch, text by text: hashes are of dataset, word and which time it comes in the text."""
    many = [len(ws) for ws in pdf["words"]]
    words = np.concatenate([np.asarray(ws, np.int32) for ws in pdf["words"]]).view(np.uint32)
    whole = np.sort(np.repeat(np.arange(len(pdf), dtype=np.uint64) << np.uint64(32), many) | words)
    new = np.flatnonzero(np.diff(whole, prepend=~whole[:1]))
    time = np.arange(len(whole)) - np.repeat(new, np.diff(new, append=len(whole)))
    h = _mix((whole & np.uint64(0xFFFFFFFF)) | (time.astype(np.uint64) << np.uint64(32)))
    salts = np.array([_dataset_hash(d) for d in pdf["dataset_id"]], np.uint64)
    return _mix(h ^ np.repeat(salts, many)), (whole >> np.uint64(32)).astype(np.int64)


def word_counts(classes: DataFrame):
    """A broadcast table of how often numbered words are met, by the first COUNTS bits of their hashes."""

    def count(batches):
        acc = np.zeros(1 << COUNTS, np.int32)
        for pdf in batches:
            if len(pdf):
                acc += np.bincount((numbered(pdf)[0] >> np.uint64(64 - COUNTS)).astype(np.int64), minlength=1 << COUNTS).astype(np.int32)
        acc = acc.reshape(-1, 1 << SLICE)
        for i in np.flatnonzero(acc.any(axis=1)):
            yield pd.DataFrame({"slice": [int(i)], "counts": [acc[i].tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = sum((np.frombuffer(b, np.int32) for b in pdf["counts"]), np.zeros(1 << SLICE, np.int32))
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [acc.tobytes()]})

    schema = "slice int, counts binary"
    counts = np.zeros((1 << (COUNTS - SLICE), 1 << SLICE), np.int32)
    for r in classes.select("dataset_id", "words").coalesce(COUNTERS).mapInPandas(count, schema).groupBy("slice").applyInPandas(merge, schema).collect():
        counts[r["slice"]] = np.frombuffer(r["counts"], np.int32)
    return classes.sparkSession.sparkContext.broadcast(counts.reshape(-1))


def segments_of(words: list[int], often: dict[int, int]) -> list[tuple[int, int]]:
    """k + 1 disjoint (start, end): at the rarest words, up to three words long, in order."""
    n = len(words)
    rank = sorted(range(n), key=lambda i: (often.get(words[i], 0), i))
    at = sorted(rank[: most_edits(n) + 1])
    return [(p, min(p + SEGMENT, q)) for p, q in zip(at, [*at[1:], n])]


def rarest(pdf: pd.DataFrame, counts: np.ndarray) -> pd.DataFrame:
    """(key, cls, n, rank, a1..a4, b1..b4): each text's n / 5 + 1 rarest words, and the sketch of all.

    ``b`` is the second half of the 512 bits of long texts, ``a`` both halves folded into one.
    """
    h, text = numbered(pdf)
    key = (np.minimum(counts[(h >> np.uint64(64 - COUNTS)).astype(np.int64)], (1 << (63 - TELL)) - 1).astype(np.int64) << TELL) | (h & np.uint64((1 << TELL) - 1)).astype(np.int64)
    n = np.bincount(text, minlength=len(pdf))
    many = np.where(n > 1, n // 5 + 1, 0)  # a single word has no partner but its own class
    end = np.cumsum(n)
    keys = [np.sort(key[e - k : e])[:q] for e, k, q in zip(end.tolist(), n.tolist(), many.tolist())]
    odd = np.bincount(text * 512 + ((h >> np.uint64(32)) & np.uint64(511)).astype(np.int64), minlength=512 * len(pdf)) & 1
    bits = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, 8)
    a, b = bits[:, :4] ^ bits[:, 4:], np.where(n[:, None] >= LONG, bits[:, 4:], 0)
    at = np.repeat(np.arange(len(pdf)), many)
    rank = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    frame = {"key": np.concatenate(keys), "cls": pdf["cls"].to_numpy(np.int64)[at], "n": n[at].astype(np.int32), "rank": rank.astype(np.int32)}
    return pd.DataFrame(frame | {f"a{i + 1}": a[at, i] for i in range(4)} | {f"b{i + 1}": b[at, i] for i in range(4)})


def _segments(counts):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield rarest(pdf, counts.value)

    return run


def _windows(counts, shared, salts):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heavy, times_of = salts.value
        for pdf in batches:
            if not len(pdf):
                continue
            rows = rarest(pdf, counts.value)
            rows = rows[shared.value.has(rows["key"].to_numpy().view(np.uint64))]
            times = np.ones(len(rows), np.int64)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, rows["key"]), len(heavy) - 1)
                times = np.where(heavy[at] == rows["key"], times_of[at], 1)
            again = np.repeat(np.arange(len(rows)), times)
            yield rows.iloc[again].assign(salt=np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times))

    return run


def _near_enough(v: dict, t: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sketches of rows x of v and y of t differ in no more bits than edits are allowed."""
    n, m = v["n"][x], t["n"][y]
    k = n + m - 2 * ((FIFTHS * np.maximum(n, m) + 4) // 5)
    a, b = v["a"][x] ^ t["a"][y], v["b"][x] ^ t["b"][y]
    long = (n >= LONG) & (m >= LONG)
    b[~long] = 0
    return (np.bitwise_count(b).sum(axis=1) + np.bitwise_count(a ^ b).sum(axis=1) <= k) & (v["cls"][x] != t["cls"][y])


def _arrays(rows: pd.DataFrame) -> dict:
    n, rank = rows["n"].to_numpy(np.int64), rows["rank"].to_numpy(np.int64)
    out = {"cls": rows["cls"].to_numpy(np.int64), "n": n, "asks": (FIFTHS * n).astype(np.int32), "has": (5 * (n - rank)).astype(np.int32)}
    return out | {c: rows[[f"{c}{i}" for i in range(1, 5)]].to_numpy(np.int64).view(np.uint64) for c in "ab"}


def _meetings(v: dict, t: dict, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of v, of t) that have the word in common and enough words after it: row y of t has it in common with lo[y] to hi[y] - 1 of v."""
    many = hi - lo
    new = np.flatnonzero(np.diff(lo, prepend=-1))
    for b, e in zip(new.tolist(), [*new[1:].tolist(), len(lo)]):
        w = int(many[b])
        if w * (e - b) < TABLE:
            continue
        for v0 in range(lo[b], hi[b], BLOCK):
            vs = slice(v0, min(v0 + BLOCK, int(hi[b])))
            step = max(1, BLOCK // (vs.stop - vs.start))
            for t0 in range(b, e, step):
                ts = slice(t0, min(t0 + step, e))
                y, x = np.nonzero((t["asks"][ts, None] <= v["has"][None, vs]) & (v["asks"][None, vs] <= t["has"][ts, None]))
                yield x + vs.start, y + ts.start
        many[b:e] = 0
    total = np.cumsum(many)
    b = 0
    while b < len(lo):
        e = max(b + 1, int(np.searchsorted(total, (total[b - 1] if b else 0) + BLOCK, "right")))
        k = many[b:e]
        y = np.repeat(np.arange(b, e), k)
        x = np.arange(len(y)) - np.repeat(np.cumsum(k) - k, k) + lo[y]
        ok = (t["asks"][y] <= v["has"][x]) & (v["asks"][x] <= t["has"][y])
        yield x[ok], y[ok]
        b = e


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of classes, of rows that come by word, those of evaluation classes first: only these are kept, until the next word."""
    kept: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        rows = pd.concat([*kept, pdf], ignore_index=True) if kept else pdf
        key, salt, side = (rows[c].to_numpy() for c in ("key", "salt", "side"))
        word = np.cumsum((np.diff(key, prepend=key[:1]) != 0) | (np.diff(salt, prepend=salt[:1]) != 0))
        is_v = side == 0
        of_v, of_t = word[is_v], word[~is_v]
        if len(of_v) and len(of_t):
            lo, hi = np.searchsorted(of_v, of_t, "left"), np.searchsorted(of_v, of_t, "right")
            some = hi > lo
            if some.any():
                v, t = _arrays(rows[is_v]), _arrays(rows[~is_v][some])
                for x, y in _meetings(v, t, lo[some], hi[some]):
                    for c in range(0, len(x), BLOCK // 8):
                        at = slice(c, c + BLOCK // 8)
                        ok = _near_enough(v, t, x[at], y[at])
                        if ok.any():
                            yield pd.DataFrame({"v_cls": v["cls"][x[at][ok]], "t_cls": t["cls"][y[at][ok]]}).drop_duplicates()
        kept = [rows[is_v & (word == word[-1])]]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = [near_same(a.tolist(), b.tolist()) for a, b in zip(pdf["v_words"], pdf["t_words"])]
        yield pdf.loc[keep, ["dataset_id", "v_cls", "t_cls"]]


def class_pairs(members: DataFrame) -> DataFrame:
    """(dataset_id, v_cls, t_cls): near-same evaluation and training classes, equal ones included."""
    spark = members.sparkSession
    classes = cut(members.groupBy("dataset_id", "cls").agg(F.first("words").alias("words"), F.max("in_train").alias("t"), F.max("in_val").alias("v")))
    val, train = (classes.where(f"{c} = 1").select("dataset_id", "cls", "words") for c in "vt")
    counts = word_counts(classes)
    schema = "key bigint, cls bigint, n int, rank int, " + ", ".join(f"{c}{i} bigint" for c in "ab" for i in range(1, 5))
    seg = val.mapInPandas(_segments(counts), schema)  # worked out twice, which takes less than keeping it
    df = cut(seg.groupBy("key").agg(F.count("*").alias("df")))
    least = max(HEAVY, HEAVY_SHARE * classes.where("v = 1").count())
    heavy = df.where(F.col("df") >= least).select("key", F.least(F.ceil(F.col("df") / HEAVY), F.lit(SALTS)).cast("int").alias("salts")).orderBy("key").collect()
    salts = spark.sparkContext.broadcast((np.array([r["key"] for r in heavy], np.int64), np.array([r["salts"] for r in heavy], np.int64)))
    dealt = seg.join(F.broadcast(spark.createDataFrame([(r["key"], r["salts"]) for r in heavy], "key bigint, salts int")), "key", "left")
    v = dealt.withColumn("salt", F.pmod(F.xxhash64("cls"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts").withColumn("side", F.lit(0))
    known = bloom.of_column(df, "key", df.count())
    t = train.mapInPandas(_windows(counts, known, salts), schema + ", salt int").withColumn("side", F.lit(1))
    rows = v.unionByName(t).repartition(shuffle_width(spark), "key", "salt").sortWithinPartitions("key", "salt", "side")
    met = cut(rows.mapInPandas(_meet, "v_cls bigint, t_cls bigint").distinct())
    # Only words of classes that met are moved.
    ids = met.select(F.explode(F.array("v_cls", "t_cls")).alias("cls"))
    known = bloom.of_column(ids, "cls", 2 * met.count())
    met = met.join(bloom.keep(val, "cls", known).select("dataset_id", F.col("cls").alias("v_cls"), F.col("words").alias("v_words")), "v_cls")
    met = met.join(bloom.keep(train, "cls", known).select(F.col("cls").alias("t_cls"), F.col("words").alias("t_words")), "t_cls")
    near = met.mapInPandas(_verify, "dataset_id string, v_cls bigint, t_cls bigint")
    same = classes.where("v = 1 and t = 1").select("dataset_id", F.col("cls").alias("v_cls"), F.col("cls").alias("t_cls"))
    return near.unionByName(same)


def overlaps(records: DataFrame, stages: DataFrame) -> DataFrame:
    """One row per near-same pair of an evaluation and a training record, with both records' split and source."""
    members = cut(sided(records, stages))
    pairs = class_pairs(members)
    one = members.groupBy("dataset_id", "cls", "record_id", "in_train", "in_val").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    v = one.where("in_val = 1").select("dataset_id", F.col("cls").alias("v_cls"), F.col("record_id").alias("v_id"), F.col("split").alias("v_split"), F.col("source").alias("v_source"))
    t = one.where("in_train = 1").select("dataset_id", F.col("cls").alias("t_cls"), F.col("record_id").alias("t_id"), F.col("split").alias("t_split"), F.col("source").alias("t_source"))
    return pairs.join(v, ["dataset_id", "v_cls"]).join(t, ["dataset_id", "t_cls"]).where("v_id <> t_id")


def found(records: DataFrame, stages: DataFrame) -> DataFrame:
    """(record_lo, record_hi): the pairs, smaller id first, each once."""
    return overlaps(records, stages).select(F.least("v_id", "t_id").alias("record_lo"), F.greatest("v_id", "t_id").alias("record_hi")).distinct()


def clean_source(source):
    """Source names that differ in case, outer space or ``_`` for ``-`` are one; null is ``unknown``."""
    s = F.regexp_replace(F.lower(strip_space(source)), "[_\\s]+", "-")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def report(records: DataFrame, stages: DataFrame) -> DataFrame:
    """Per dataset, evaluation split and source: its records, and how many have a near-same training record.

    Worked out by class, so that texts which repeat on both sides are not expanded into pairs: a
    record has a partner if a training class near its own holds any record but itself.
    """
    members = cut(sided(records, stages))
    held = members.where("in_train = 1").groupBy("dataset_id", F.col("cls").alias("t_cls")).agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi"))
    near = class_pairs(members).join(held, ["dataset_id", "t_cls"]).groupBy("dataset_id", F.col("v_cls").alias("cls")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    vals = members.where("in_val = 1").select("dataset_id", "cls", "record_id")
    hit = vals.join(near, ["dataset_id", "cls"]).where("lo <> record_id or hi <> record_id").select("dataset_id", "record_id").distinct().withColumn("hit", F.lit(1))
    norm = lambda c: F.lower(strip_space(F.col(c)))
    vals = stages.select("dataset_id", norm("val_split").alias("split")).distinct()
    rows = records.select("record_id", "dataset_id", norm("split").alias("split"), clean_source(F.col("source")).alias("source")).distinct()
    rows = rows.join(F.broadcast(vals), ["dataset_id", "split"]).join(hit, ["dataset_id", "record_id"], "left")
    return rows.groupBy("dataset_id", "split", "source").agg(F.countDistinct("record_id").alias("records"), F.countDistinct(F.when(F.col("hit") == 1, F.col("record_id"))).alias("overlapping"))
