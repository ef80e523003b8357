"""Evaluation texts leaking into training text: spaced-seed hashing.

Texts are words without case, accents, markup, escaping, punctuation and line-end
hyphens.  An item's own words are those outside sentences that several other items
share (instruction lines).  Fixed masks laid over every position of an item select
some words and ignore the others; their hashes are joined with those of the same masks
over every position of every document.  Only masks that select at least one of the item's
rare words make seeds: a passage of the item that has none is wording the items
share, which is not its own.  Around the hits of a (document, item) the
words are aligned, a word matching if equal or a slip away, and the passage
counts if enough words match in order and the rare words among them agree, so that
the same wording with other names and numbers does not.

Items are prepared in Spark, whatever their number: what comes to the driver are the shared
sentences and the words that are not rare, whose numbers have a bound.  All documents' positions are hashed and
go through a Bloom filter sized by the seeds.  If the prepared items are small, they are sent to every task, and
documents with hits are aligned where they are read.  Beyond ``SEED_BYTES``, hits meet the seeds by a
shuffled join, hot seeds and items spread over salts, and only documents that met are read again.

Edge cases: null, empty or very short texts and items match nothing; equal items
under several ids each count; documents repeated under new ids are each found; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_words, unwrap
from ..session import cut
from . import bloom

#: Masks: 1 selects the word at that place, 0 ignores it.
MASKS = ("1111", "11011", "10111", "11101", "110011", "101101", "1100011")
#: Words that must match in order, and the share of the passage's rare words that must.
MIN_WORDS, MIN_RARE, MIN_RARE_SHARE = 12, 3, 0.5
#: A word is rare if at most so large a share of the different items has it, or so few of them; a sentence is
#: shared if so large a share has it, and so many of them.
RARE_SHARE, RARE_ITEMS = 1 / 60, 4
SHARED_SHARE, SHARED_ITEMS = 1 / 1000, 4
#: Words around a hit that are aligned.
AROUND = 28
#: Prepared items of at most so many bytes are sent to every task.
SEED_BYTES = 64 << 20
#: Parts over which hot seeds and items are spread in the shuffled joins.
SALTS = 16

_SENT = re.compile(r"(?<=[.!?:。])\s+|\n+")
_M = np.uint64(0x9E3779B97F4A7C15)


def mask_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the selected words at each position of the mask."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, int(mask, 2), np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                h = (h ^ ids[j : j + n]) * _M
                h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _ids(words: list[str], known: dict[str, int]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            if len(known) > 400_000:
                known.clear()
            h = known[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


# ---- items ------------------------------------------------------------------


def _words_hash(words) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item, item_id, parts): equal texts are one item with several ids; parts are sentences of words."""
    for pdf in batches:
        parts = [[" ".join(ws) for p in _SENT.split(unwrap(t)) if (ws := plain_words(p))] for t in pdf["text"]]
        yield pd.DataFrame({"item": [_words_hash(plain_words(t)) for t in pdf["text"]], "item_id": pdf["item_id"], "parts": parts})


def seeds_of(words: list[str], rare: list[bool], known: dict[str, int]) -> np.ndarray:
    """Hashes of the masks over all positions at which they select a rare word."""
    ids, r = _ids(words, known), np.array(rare, bool)
    out = []
    for mask in MASKS:
        h = mask_hashes(ids, mask)
        if len(h):
            some = np.zeros(len(h), bool)
            for j, c in enumerate(mask):
                if c == "1":
                    some |= r[j : j + len(h)]
            out.append(h[some])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def prepare(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id) and (item, words, rare, seeds), one row per different item with words enough of its own."""
    spark = benchmark.sparkSession
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    parts = cut(rows.mapInPandas(_parts, "item bigint, item_id bigint, parts array<string>"))
    one = parts.groupBy("item").agg(F.min_by("parts", "item_id").alias("parts"))
    total = one.count()
    # At most (sentences of an item) / SHARED_SHARE sentences are so common, or total / SHARED_ITEMS of few items.
    spread = one.select("item", F.explode("parts").alias("p")).select("item", F.xxhash64("p").alias("p")).distinct().groupBy("p").agg(F.count("*").alias("n"))
    shared = spark.sparkContext.broadcast({r["p"] for r in spread.where(F.col("n") >= max(SHARED_ITEMS, SHARED_SHARE * total)).collect()})
    hashed = one.select("item", "parts", F.transform("parts", lambda p: F.xxhash64(p)).alias("hs"))

    def own(batches):
        for pdf in batches:
            ws = [[w for p, h in zip(ps, hs) if h not in shared.value for w in p.split()] for ps, hs in zip(pdf["parts"], pdf["hs"])]
            yield pd.DataFrame({"item": pdf["item"], "words": ws})

    owned = cut(hashed.mapInPandas(own, "item bigint, words array<string>").where(F.size("words") >= MIN_WORDS))
    # At most (words of an item) / RARE_SHARE words are so common, or the words of few items.
    df = owned.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    common = spark.sparkContext.broadcast({r["w"] for r in df.where(F.col("n") > max(RARE_ITEMS, RARE_SHARE * owned.count())).collect()})

    def seeded(batches):
        known: dict[str, int] = {}
        for pdf in batches:
            rare = [[w not in common.value and (len(w) > 3 or w.isdigit() and len(w) > 1) for w in ws] for ws in pdf["words"]]
            yield pdf.assign(rare=rare, seeds=[seeds_of(list(ws), r, known) for ws, r in zip(pdf["words"], rare)])

    return parts.select("item", "item_id").distinct(), cut(owned.mapInPandas(seeded, "item bigint, words array<string>, rare array<boolean>, seeds array<bigint>"))


class Items:
    """Prepared items in a task's memory."""

    def __init__(self, rows: list[tuple[list[int], list[str], list[bool], list[int]]]) -> None:
        self.item_ids, self.words, self.rare = ([r[k] for r in rows] for k in range(3))
        h = np.concatenate([np.asarray(r[3], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        at = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows]) if rows else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.seed, self.seed_at = h[order], at[order]

    def hits(self, hashes: np.ndarray, places: np.ndarray) -> dict[int, list[int]]:
        """Of hashes that passed the filter: the places at which some seed of an item lies, by item."""
        out: dict[int, list[int]] = defaultdict(list)
        lo, hi = np.searchsorted(self.seed, hashes), np.searchsorted(self.seed, hashes, "right")
        for a, b, p in zip(lo.tolist(), hi.tolist(), places.tolist()):
            for q in range(a, b):
                out[int(self.seed_at[q])].append(p)
        return out


def masked(words: list[str], known: dict[str, int], may) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all masks over all positions that the filter lets through, and the positions."""
    ids = _ids(words, known)
    hs = [mask_hashes(ids, mask) for mask in MASKS]
    h = np.concatenate(hs)
    at = np.flatnonzero(may(h.view(np.uint64)))
    if not len(at):
        return h[:0], at
    return h[at], np.concatenate([np.arange(len(x)) for x in hs])[at]


def leaks(words: list[str], places, item: list[str], rare: list[bool]) -> bool:
    """Whether the words around the places hold a passage of the item."""
    near = np.zeros(len(words), bool)
    for p in places:
        near[max(0, p - AROUND) : p + AROUND + 8] = True
    return passage([w for w, k in zip(words, near) if k], item, rare)


def _slip(a: str, b: str) -> bool:
    """Equal but for one edit or a swap of neighbours (two edits from nine letters on); numbers never."""
    if abs(len(a) - len(b)) > 2 or len(a) < 4 or len(b) < 4 or a.isdigit() or b.isdigit():
        return False
    i = 0
    m = min(len(a), len(b))
    while i < m and a[i] == b[i]:
        i += 1
    j = 0
    while j < m - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if len(x) <= 1 and len(y) <= 1 or len(x) == 2 and x == y[::-1]:
        return True
    return m >= 9 and len(x) <= 2 and len(y) <= 2


def align(doc: list[int], item: list[int]) -> list[tuple[int, int]]:
    """Matched (doc, item) places of a longest common subsequence; -1 matches nothing."""
    n, m = len(doc), len(item)
    table = np.zeros((n + 1, m + 1), np.int32)
    it = np.array(item)
    for i in range(1, n + 1):
        diag = table[i - 1, :-1] + ((it == doc[i - 1]) & (doc[i - 1] >= 0))
        table[i, 1:] = np.maximum.accumulate(np.maximum(diag, table[i - 1, 1:]))
    out = []
    i, j = n, m
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def passage(doc: list[str], item: list[str], rare: list[bool]) -> bool:
    code = {w: n for n, w in enumerate(dict.fromkeys(item))}
    seen: dict[str, int] = {}
    for w in doc:
        if w not in seen:
            c = code.get(w)
            if c is None:
                c = next((v for x, v in code.items() if _slip(w, x)), -1)
            seen[w] = c
    d = [seen[w] for w in doc]
    matched = align(d, [code[w] for w in item])
    if len(matched) < MIN_WORDS:
        return False
    # Runs of matches with small gaps on both sides; stray common words between unrelated text are no passage.
    runs: list[list[tuple[int, int]]] = []
    for i, j in matched:
        if runs and i - runs[-1][-1][0] <= 3 and j - runs[-1][-1][1] <= 3:
            runs[-1].append((i, j))
        else:
            runs.append([(i, j)])
    total = good = among = 0
    close = False
    for r in runs:
        k = sum(rare[j] for _, j in r)
        span = sum(rare[j] for j in range(r[0][1], r[-1][1] + 1))
        if len(r) < 3 or k < 1 or k < MIN_RARE_SHARE * span:
            continue
        total += len(r)
        good += k
        among += span
        # A long run nearly without gaps is the item's wording even if it has few rare words.
        close |= len(r) > MIN_WORDS and len(r) >= 0.85 * max(r[-1][0] - r[0][0], r[-1][1] - r[0][1])
    return total >= MIN_WORDS and (good >= MIN_RARE or close) and good >= MIN_RARE_SHARE * among


def found(documents: DataFrame, benchmark: DataFrame, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """(doc_id, item_id): documents holding a passage of an item."""
    members, items = prepare(benchmark)
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    size = items.agg(
        F.coalesce(F.sum(F.size("seeds")), F.lit(0)).alias("seeds"),
        # What is sent, as Python holds it: 16 bytes a seed, and 80 with the letters for a word.
        F.coalesce(F.sum(16 * F.size("seeds") + 80 * F.size("words") + F.octet_length(F.array_join("words", ""))), F.lit(0)).alias("bytes"),
    ).first()
    ids = members.count()
    known = bloom.build(items.select("seeds"), size["seeds"], lambda pdf: np.concatenate([np.zeros(0, np.int64), *pdf["seeds"]]).view(np.uint64))
    if size["bytes"] + 40 * ids <= seed_bytes:
        return _in_place(docs, members, items, known)
    return _by_shuffle(docs, members, items, known, size["seeds"])


def _in_place(docs: DataFrame, members: DataFrame, items: DataFrame, known) -> DataFrame:
    rows = items.join(members.groupBy("item").agg(F.sort_array(F.collect_list("item_id")).alias("ids")), "item").orderBy("item").collect()
    shared = docs.sparkSession.sparkContext.broadcast(Items([(r["ids"], r["words"], r["rare"], r["seeds"]) for r in rows]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it, may = shared.value, known.value.has
        memo: dict[str, int] = {}
        for pdf in batches:
            out = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                ws = plain_words(t)
                for n, places in it.hits(*masked(ws, memo, may)).items():
                    if leaks(ws, places, it.words[n], it.rare[n]):
                        out += [(d, i) for i in it.item_ids[n]]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return docs.mapInPandas(run, "doc_id bigint, item_id bigint").distinct()


def _by_shuffle(docs: DataFrame, members: DataFrame, items: DataFrame, known, seeds: int) -> DataFrame:
    """The same where the items are too many to send."""

    def hashes(batches):
        memo: dict[str, int] = {}
        for pdf in batches:
            got = [masked(plain_words(t), memo, known.value.has) for t in pdf["text"]]
            many = [len(h) for h, _ in got]
            if sum(many):
                yield pd.DataFrame({"doc_id": np.repeat(pdf["doc_id"].to_numpy(), many), "p": np.concatenate([p for _, p in got]), "h": np.concatenate([h for h, _ in got])})

    def check(batches):
        for pdf in batches:
            keep = [leaks(plain_words(t), places, list(ws), list(rare)) for t, places, ws, rare in zip(pdf["text"], pdf["places"], pdf["words"], pdf["rare"])]
            yield pdf.loc[keep, ["doc_id", "item"]]

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")
    table = items.select("item", F.explode("seeds").alias("h")).select("item", "h", every)
    hits = docs.mapInPandas(hashes, "doc_id bigint, p int, h bigint").select("doc_id", "p", "h", salt)
    met = cut(hits.join(table, ["h", "salt"]).groupBy("doc_id", "item").agg(F.collect_set("p").alias("places")))  # of one document
    again = bloom.keep(docs, "doc_id", bloom.of_column(met, "doc_id", met.count()))
    full = again.join(met, "doc_id").select("doc_id", "text", "item", "places", salt)
    full = full.join(items.select("item", "words", "rare", every), ["item", "salt"])
    pairs = full.mapInPandas(check, "doc_id bigint, item bigint").distinct().select("doc_id", "item", salt)
    return pairs.join(members.select("item", "item_id", every), ["item", "salt"]).select("doc_id", "item_id").distinct()


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per suite and split: items, items that leaked, and (document, item) pairs."""
    hit = found(documents, benchmark).groupBy("item_id").agg(F.count("*").alias("pairs"))
    x = benchmark.select("item_id", "suite", "split").join(hit, "item_id", "left")
    return x.groupBy("suite", "split").agg(F.countDistinct("item_id").alias("items"), F.count("pairs").alias("leaked"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("documents"))
