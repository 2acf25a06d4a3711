"""Periodic runs of words in texts by suffix trees (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3

RUN = "struct<start:long,length:long,period:long>"


class SuffixTree:
    """Ukkonen's suffix tree of a list of symbols of 1 and more; 0 is put after the last.

    ``ranks`` numbers the suffixes in the order of a walk over the tree; ``lce`` gives the longest common extension of
    two suffixes, which is the depth of their lowest common ancestor.  The Euler tour is kept as the depth of the
    shallowest node visited between one leaf and the next, under a sparse table: two look-ups give an ancestor.
    """

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        self.n = n = len(s)
        self.begin, self.end, self.kids, self.suffix = begin, end, kids, suffix = [0], [0], [{}], [-1]
        link = [0]
        node = at = length = left = 0  # the active point, and how many suffixes are still to be put in
        for i, c in enumerate(s):
            left += 1
            waits = 0  # an inner node that has no suffix link yet
            while left:
                if not length:
                    at = i
                below = kids[node]
                child = below.get(s[at])
                if child is None:
                    below[s[at]] = len(begin)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    span = end[child] - begin[child]
                    if length >= span:
                        node, at, length = child, at + span, length - span
                        continue
                    middle = begin[child] + length
                    if s[middle] == c:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    inner = len(begin)
                    below[s[at]] = inner
                    begin.append(begin[child])
                    end.append(middle)
                    kids.append({s[middle]: child, c: inner + 1})
                    suffix.append(-1)
                    link.append(0)
                    begin[child] = middle
                    if waits:
                        link[waits] = inner
                    waits = inner
                begin.append(i)
                end.append(n)
                kids.append(None)
                suffix.append(i - left + 1)
                link.append(0)
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - left + 1

    def _numbered(self, leaves: list[int]) -> np.ndarray:
        rank = np.empty(self.n, np.int64)
        rank[leaves] = np.arange(self.n)
        return rank

    def tour(self) -> np.ndarray:
        """Ranks of the suffixes with small symbols first, the end before all; keeps the tour for ``lce``."""
        begin, end, kids, suffix = self.begin, self.end, self.kids, self.suffix
        above = [0] * len(begin)
        leaves, low, least, todo = [], [], self.n, [0]
        while todo:
            v = todo.pop()
            depth = above[v]
            if depth < least:
                least = depth
            k = kids[v]
            if k is None:
                leaves.append(suffix[v])
                low.append(least)
                least = self.n
            else:
                depth += end[v] - begin[v]
                for c in sorted(k, reverse=True):
                    above[k[c]] = depth
                    todo.append(k[c])
        self.rank = self._numbered(leaves)
        self.table = [np.array(low, np.int32)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))
        return self.rank

    def turned(self) -> np.ndarray:
        """Ranks with large symbols first, the end still before all."""
        kids, suffix = self.kids, self.suffix
        leaves, todo = [], [0]
        while todo:
            v = todo.pop()
            k = kids[v]
            if k is None:
                leaves.append(suffix[v])
            else:
                order = sorted(k)
                if not order[0]:
                    order.append(order.pop(0))
                todo.extend([k[c] for c in order])
        return self._numbered(leaves)

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common symbols from ``a`` and from ``b`` on, for arrays of places with a <> b."""
        a, b = self.rank[a], self.rank[b]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.table[k][lo[m]], self.table[k][hi[m] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the next place with a smaller one: its longest Lyndon prefix ends there."""
    r = rank.tolist()
    out = [len(r) - 1] * len(r)
    for i in range(len(r) - 2, -1, -1):
        j, own = i + 1, r[i]
        while r[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out[:-1], np.int64)


def maximal_runs(ids: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of the maximal runs of ``ids`` (1 and more), by start, then period.

    Every run holds a Lyndon root that is the longest Lyndon word at its place, by the order of symbols or by the
    inverse one; so each place gives two candidates, which the trees of the sequence and of its reversal extend both ways.
    """
    n = len(ids)
    tree = SuffixTree(ids.tolist())
    at, period = np.tile(np.arange(n), 2), np.concatenate([next_smaller(tree.tour()), next_smaller(tree.turned())]) - np.tile(np.arange(n), 2)
    found = np.unique(np.stack([at, period])[:, period * periods <= n], axis=1)
    at, period = found
    right = tree.lce(at, at + period)
    del tree
    back = SuffixTree(ids[::-1].tolist())
    back.tour()
    left = np.zeros(len(at), np.int64)
    inner = at > 0
    left[inner] = back.lce(n - at[inner], n - at[inner] - period[inner])
    rows = np.stack([at - left, left + period + right, period], axis=1)
    rows = rows[(rows[:, 1] >= least) & (rows[:, 1] >= periods * rows[:, 2])]
    return np.unique(rows[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def windows(ids: np.ndarray, least: int, periods: int) -> list[tuple[int, int]]:
    """Stretches outside of which no run can be, each with a word to either side.

    In a run of period q, every group of ``least // periods`` words but those of the first q has been there before.  A run
    therefore makes an unbroken row of such repeats, whose number bounds q and so where the run began.
    """
    gram = least // periods
    n = len(ids) - gram + 1
    if len(ids) < least:
        return []
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    grams = np.zeros(n, np.uint64)
    for k in range(gram):
        grams += mixed[k : k + n] * np.uint64(pow(0xBF58476D1CE4E5B9, k, 1 << 64))
    seen = np.ones(n, bool)
    seen[np.unique(grams, return_index=True)[1]] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[0], seen.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    some = min(least - 2 * gram + 1, (periods - 1) * (gram + 1) - gram + 1)
    long = end - begin >= some
    begin, end = begin[long], end[long]
    begin = np.maximum(0, begin - (end - begin + gram - 1) // (periods - 1) - 1)
    end = np.minimum(len(ids), end + gram)
    out: list[tuple[int, int]] = []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        if out and a <= out[-1][1]:
            a, b = min(a, out.pop()[0]), b
            while out and a <= out[-1][1]:
                a = min(a, out.pop()[0])
        out.append((a, b))
    return out


def runs_of(words: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of the runs in a sequence of words."""
    none = np.empty((0, 3), np.int64)
    if len(words) < least:
        return none
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known) + 1) for w in words], np.int64, len(words))
    found = [none]
    for a, b in windows(ids, least, periods):
        rows = maximal_runs(ids[a:b], least, periods)
        rows[:, 0] += a
        found.append(rows)
    return np.concatenate(found)


def find_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """``doc_id, n_words, runs, kept_text`` for every row of ``docs(doc_id, text)``.

    Words are what the six separators (blank, tab to carriage return) leave.  ``runs`` lists each maximal run as
    ``start, length, period`` by start, then period; ``kept_text`` are the words outside of repeats, joined by one blank: a
    word goes if a run holds it behind that run's first period.  Texts are compared whole, one in memory at a time beside
    its Arrow batch, and nothing is shuffled.

    A null text counts as empty: no words, no runs, an empty text.  Rows that repeat a doc_id, or have none, are
    worked out each for itself; an empty table gives none; extra columns are not read.
    """
    if least < 2 * periods or periods < 2:
        raise ValueError("a run takes two periods or more and twice as many words as periods")

    def found(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            listed, kept, counts = [], [], []
            for text in batch["text"]:
                words = text.split()  # on bytes: the six separators
                rows = runs_of(words, least, periods)
                counts.append(len(words))
                listed.append([{"start": a, "length": b, "period": c} for a, b, c in rows.tolist()])
                if len(rows):
                    keep = np.ones(len(words), bool)
                    for a, b, c in rows.tolist():
                        keep[a + c : a + b] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                kept.append(b" ".join(words).decode())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": counts, "runs": listed, "kept_text": kept})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(found, f"doc_id long, n_words long, runs array<{RUN}>, kept_text string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` in which one document in ten, told by the crc32 of its id, repeats words from a place on.

    Rows without a doc_id stay as they are.
    """
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD_CLASS), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("_w")
    a = (F.col("_g") % n).cast("int")
    p = (F.floor((n - F.col("_a")) / (F.col("_g") % 8 + 3)) + 1).cast("int")
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(chosen, words).alias("_w"), g.alias("_g"))
    rows = rows.withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    return rows.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """The digest columns of ``find_runs``: number of runs, the one with the greatest exponent, hashes of all and of the
    collapsed text."""
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("e"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    out = find_runs(docs).withColumn("_top", top)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_top.{c}").alias(c) for c in ("start", "length", "period")], F.floor(F.lit(1000) * F.col("_top.length") / F.col("_top.period")).alias("exponent_milli"), digest(lines).alias("runs_sha256"), digest(F.col("kept_text")).alias("collapsed_sha256"))


__all__ = ["SuffixTree", "find_runs", "maximal_runs", "planted", "run_report", "runs_of", "windows"]
