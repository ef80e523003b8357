"""Filling rows of fixed capacity with documents: swap-based local search.

A document longer than a row is divided into full rows and a rest; nothing else is
divided.  The remaining items are dealt by hash into groups of about ``GROUP`` items,
each packed in one task: best fit by falling size first, then local search.  The
fullest row that still has room takes in items of emptier ones: by a move, by an
exchange one for one, two for one or one for two, whichever fills it most.  Each
such step raises the sum of squared fills, so the search ends; rows left empty go.
Groups are as large as that at every input size; what a group's last row leaves free is one
row in some thousands of items.

Edge cases: null and empty texts have no tokens and are in no row; ties are settled
by (doc_id, piece); a document that comes twice under one id is taken once (its
largest text); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bpe import Merges, token_count
from ..session import cut

#: Items per group.
GROUP = 4096


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Rows of item numbers by best fit, items by falling size; sizes are at most cap."""
    rows: list[list[int]] = []
    room: dict[int, list[int]] = defaultdict(list)
    present = 0  # bit r: some row has r room
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        high = present >> s
        if high:
            r = s + (high & -high).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                present &= ~(1 << r)
        else:
            b, r = len(rows), cap
            rows.append([])
        rows[b].append(i)
        left = r - s
        if left:
            room[left].append(b)
            present |= 1 << left
    return rows


class _Search:
    """Local search over the rows with room; see the module's docstring.

    Of a row's items of one size any will do, so a row is listed by its different sizes.  These add up
    to its capacity at most, so there are at most sqrt(2 * cap) of them and cap pairs, whatever the number of its items.
    """

    def __init__(self, sizes: list[int], rows: list[list[int]], cap: int) -> None:
        self.sizes, self.rows, self.cap = sizes, rows, cap
        self.fill = [sum(sizes[i] for i in r) for r in rows]
        self.one: dict[int, dict[int, tuple[int, ...]]] = defaultdict(dict)
        self.two: dict[int, dict[int, tuple[int, ...]]] = defaultdict(dict)
        self.bits1 = self.bits2 = 0

    def _singles(self, b: int) -> dict[int, tuple[int, ...]]:
        """An item of each size in a row."""
        return {self.sizes[i]: (i,) for i in self.rows[b]}

    def _pairs(self, b: int) -> dict[int, tuple[int, ...]]:
        """Two items of each sum in a row."""
        by: dict[int, list[int]] = defaultdict(list)
        for i in self.rows[b]:
            if len(by[self.sizes[i]]) < 2:
                by[self.sizes[i]].append(i)
        out: dict[int, tuple[int, ...]] = {}
        known: list[tuple[int, int]] = []
        for t, own in by.items():
            if len(own) == 2:
                out.setdefault(2 * t, (own[0], own[1]))
            for u, j in known:
                out.setdefault(t + u, (own[0], j))
            known.append((t, own[0]))
        return out

    def _show(self, b: int) -> None:
        for t, at in self._singles(b).items():
            self.one[t][b] = at
            self.bits1 |= 1 << t
        for t, at in self._pairs(b).items():
            self.two[t][b] = at
            self.bits2 |= 1 << t

    def _hide(self, b: int) -> None:
        for t in self._singles(b):
            d = self.one[t]
            d.pop(b, None)
            if not d:
                self.bits1 &= ~(1 << t)
        for t in self._pairs(b):
            d = self.two[t]
            d.pop(b, None)
            if not d:
                self.bits2 &= ~(1 << t)

    def _largest(self, listed, bits: int, lo: int, hi: int):
        """(sum, (row, items)) with lo < sum <= hi, the largest; 0 if there is none."""
        t = (bits & ((1 << (hi + 1)) - 1)).bit_length() - 1
        if t <= lo:
            return 0, None
        return t, next(reversed(listed[t].items()))

    def _improve(self, a: int) -> bool:
        """The step that fills row a most, if any fills it more."""
        room = self.cap - self.fill[a]
        best, step = 0, None
        gives = [(0, ()), *self._singles(a).items(), *self._pairs(a).items()]
        for t, out in gives:
            takes = [(self.one, self.bits1)] if len(out) == 2 else [(self.one, self.bits1), (self.two, self.bits2)]
            for listed, bits in takes:
                got, at = self._largest(listed, bits, t + best, t + room)
                if at and got - t > best:
                    best, step = got - t, (out, at)
            if best == room:
                break
        if step is None:
            return False
        out, (b, into) = step
        self._hide(b)
        self.rows[a] = [i for i in self.rows[a] if i not in out] + list(into)
        self.rows[b] = [i for i in self.rows[b] if i not in into] + list(out)
        self.fill[a] += best
        self.fill[b] -= best
        if self.rows[b]:
            self._show(b)
        return True

    def run(self) -> list[list[int]]:
        changed = True
        while changed:
            changed = False
            openrows = sorted((b for b in range(len(self.rows)) if self.rows[b] and self.fill[b] < self.cap), key=lambda b: (self.fill[b], b))
            self.one.clear()
            self.two.clear()
            self.bits1 = self.bits2 = 0
            for b in openrows:
                self._show(b)
            queue = [(self.fill[b], b) for b in openrows]
            while queue:
                f, a = queue.pop()
                if not self.rows[a]:
                    continue
                if f != self.fill[a]:  # it gave items away since: back in its place
                    insort(queue, (self.fill[a], a))
                    continue
                self._hide(a)
                while self.fill[a] < self.cap and self._improve(a):
                    changed = True
        return [r for r in self.rows if r]


def fill_rows(sizes: list[int], cap: int, start: list[list[int]] | None = None) -> list[list[int]]:
    """Item numbers by row, from best fit or rows given; sizes are positive and at most cap."""
    return _Search(sizes, best_fit(sizes, cap) if start is None else [list(r) for r in start], cap).run()


def pieces(documents: DataFrame, tokenizer: Merges, caps: list[int]) -> DataFrame:
    """(seq_len, doc_id, piece, start, tokens): documents as items of at most seq_len tokens."""
    sized = documents.where("doc_id is not null and text is not null").select("doc_id", token_count(F.col("text"), tokenizer).alias("n"))
    sized = cut(sized.groupBy("doc_id").agg(F.max("n").alias("n")).where("n > 0"))
    x = sized.withColumn("seq_len", F.explode(F.array(*(F.lit(c).cast("bigint") for c in caps))))
    x = x.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("seq_len")))))
    start = F.col("piece") * F.col("seq_len")
    return x.select("seq_len", "doc_id", "piece", start.alias("start"), F.least(F.col("seq_len"), F.col("n") - start).alias("tokens"))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
    cap, group = int(pdf["seq_len"].iloc[0]), int(pdf["grp"].iloc[0])
    sizes = pdf["tokens"].tolist()
    row, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    start = best_fit(sizes, cap)
    for b, items in enumerate(fill_rows(sizes, cap, start)):
        used = 0
        for i in items:
            row[i], at[i] = b, used
            used += sizes[i]
    before = np.zeros(len(sizes), np.int64)
    before[0] = len(start)
    return pdf.drop(columns=["grp"]).assign(row_id=[f"g{group}-{b}" for b in row], at=at, best_fit_rows=before)


COLUMNS = ("seq_len", "row_id", "at", "doc_id", "piece", "start", "tokens")


def _filled(documents: DataFrame, tokenizer: Merges, caps: list[int]) -> DataFrame:
    """The rows, and with one item of each group the number of rows of its best fit alone."""
    items = cut(pieces(documents, tokenizer, sorted(set(caps))))
    full = items.where("tokens = seq_len")
    rest = items.where("tokens < seq_len")
    # As many groups as the items need; a count per capacity is all that comes to the driver.
    groups = {r["seq_len"]: max(1, -(-r["n"] // GROUP)) for r in rest.groupBy("seq_len").agg(F.count("*").alias("n")).collect()}
    if groups:
        many = F.coalesce(*(F.when(F.col("seq_len") == c, F.lit(g)) for c, g in groups.items()))
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), many))
    else:
        dealt = rest.withColumn("grp", F.lit(0).cast("bigint"))
    schema = "seq_len bigint, doc_id bigint, piece bigint, start bigint, tokens bigint, row_id string, at bigint, best_fit_rows bigint"
    packed = dealt.groupBy("seq_len", "grp").applyInPandas(_pack, schema)
    # A full piece is a row of its own, named by its document and piece.
    alone = full.select("*", F.concat(F.lit("d"), F.col("doc_id"), F.lit("-"), F.col("piece")).alias("row_id"), F.lit(0).cast("bigint").alias("at"), F.lit(1).cast("bigint").alias("best_fit_rows"))
    return packed.select(*COLUMNS, "best_fit_rows").unionByName(alone.select(*COLUMNS, "best_fit_rows"))


def rows(documents: DataFrame, tokenizer: Merges, caps: list[int]) -> DataFrame:
    """(seq_len, row_id, at, doc_id, piece, start, tokens): tokens start.. of a document stand at ``at`` in the row.

    ``row_id`` names a row once for each capacity: by group and number, or by document and piece.
    """
    return _filled(documents, tokenizer, caps).select(*COLUMNS)


def usage(documents: DataFrame, tokenizer: Merges, caps: list[int]) -> DataFrame:
    """Per capacity: rows, those of best fit alone, the least that any filling needs, documents, tokens, and the share of room used."""
    per = _filled(documents, tokenizer, caps).groupBy("seq_len").agg(F.countDistinct("row_id").alias("rows"), F.sum("best_fit_rows").alias("best_fit_rows"), F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"))
    return per.select("seq_len", "rows", "best_fit_rows", F.ceil(F.col("tokens") / F.col("seq_len")).alias("least_rows"), "documents", "tokens", (F.col("tokens") / (F.col("rows") * F.col("seq_len"))).alias("used"))
