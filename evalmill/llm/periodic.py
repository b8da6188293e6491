"""Periodic runs of words by internal pattern matching.

A run is a longest stretch of words with smallest period q that is at least max(12, 2 q) words long. Words of many texts are
worked on at once, as one array of numbers in which no text's suffix is compared beyond its end. Prefix doubling sorts the
suffixes; after its step k the place of a suffix's group is the start of the suffix-array interval of its block of 2**k words, so
the intervals of all dyadic blocks come with it. A wavelet matrix over the suffix array then answers, for a block's interval and a
place, which occurrence comes next (range successor).

A run of period q holds a block of 2**k words, k the largest with 2 * 2**k <= q + 1, that starts at a multiple of 2**k and
occurs again q words later (``levels``; short periods use blocks of four words at even places, and meet at least six words). So each
dyadic block asks for its occurrences at distances 2 * 2**k - 1 to 4 * 2**k - 2, in two windows of 2**k places. Two occurrences in
a window are two candidates; three or more are an arithmetic progression whose difference d is the block's period. Then the block
lies in a run of period d, and the progression in another one (in the same one, q has the smaller period d): a run of period
q that holds both begins at both their starts or ends at both their ends, which gives two candidates, or else the two runs
meet, and only then all members of the progression are candidates. Longest common extensions by the groups of the doubling
steps make a candidate a run, and of runs on the same words the one with the smallest period stays. Nothing else is tried, so
the work is n log n for texts of one word repeated, too.

Cases: a null text and one without words have no run; a null id plants nothing; one text is held by one task, n log n numbers.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm.common import map_frames, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Words of a run; words of texts that are worked on together.
LEAST, TOGETHER = 12, 1 << 18

NONE = 1 << 62

SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Suffixes:
    """Sorted suffixes of an array in which text t has the places firsts[t] to firsts[t + 1] - 1.

    ``groups[k]``: for each place the number of suffixes before its group, those with the same first 2**k words. A suffix that is
    shorter is alone in its group.
    """

    def __init__(self, words: np.ndarray, firsts: np.ndarray):
        n = len(words)
        sizes = np.diff(firsts)
        end = np.repeat(firsts[1:], sizes)  # of each place's text
        keys = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(keys, kind="stable")
        first = np.append(True, np.diff(keys[self.order]) != 0)[:n]
        self.groups = [np.empty(n, dtype=np.int64)]
        self.groups[0][self.order] = self._starts(np.arange(n), first)
        width = 1
        while True:
            last = self.groups[-1]
            # Places of the order whose group has several members.
            at = np.flatnonzero(~(np.append(first[1:], True) & first))
            if not len(at):
                break
            place = self.order[at]
            beyond = place + width
            # Of a group's suffixes one at most ends here: it is the first of them.
            follow = np.where(beyond < end[place], last[np.minimum(beyond, n - 1)], -1)
            resorted = np.lexsort((follow, last[place]))
            self.order[at] = place[resorted]
            follow, own = follow[resorted], last[place[resorted]]
            new = np.append(True, (np.diff(own) != 0) | (np.diff(follow) != 0))
            first = first.copy()
            first[at] = new
            named = last.copy()
            named[self.order[at]] = self._starts(at, new)
            self.groups.append(named)
            width *= 2

    @staticmethod
    def _starts(at: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(first, at, 0))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j (of one text, i < j) have in common from their start."""
        n, i, j = len(self.order), i.copy(), j.copy()
        begin = j.copy()
        for k in range(len(self.groups) - 1, -1, -1):
            g = self.groups[k]
            same = (j < n) & (g[np.minimum(i, n - 1)] == g[np.minimum(j, n - 1)])
            i, j = i + (same << k), j + (same << k)
        return j - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the prefixes before i and j (of one text, i < j) have in common from their end."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.groups) - 1, -1, -1):
            g, back = self.groups[k], 1 << k
            same = (i >= back) & (g[np.maximum(i - back, 0)] == g[np.maximum(j - back, 0)])
            i, j = i - (same << k), j - (same << k)
        return begin - i


class WaveletMatrix:
    """Range successor over whole numbers: bit by bit from the highest, values stably parted into zeros and ones."""

    def __init__(self, values: np.ndarray):
        self.bits = (int(values.max(initial=0)) + 1).bit_length()  # values stay below 2**bits - 1
        self.zeros, self.ones = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1
            self.ones.append(np.append(0, np.cumsum(one)).astype(np.int64))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values in places lo to hi - 1 are smaller than ``value``."""
        lo, hi, found = lo.copy(), hi.copy(), np.zeros(len(lo), dtype=np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = (value >> b) & 1 == 1
            a, z = ones[lo], ones[hi]
            found += np.where(one, (hi - z) - (lo - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + z, hi - z)
        return found

    def ranked(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of this rank among places lo to hi - 1."""
        lo, hi, rank, value = lo.copy(), hi.copy(), rank.copy(), np.zeros(len(lo), dtype=np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            a, z = ones[lo], ones[hi]
            smaller = (hi - z) - (lo - a)
            one = rank >= smaller
            value += one.astype(np.int64) << b
            rank = np.where(one, rank - smaller, rank)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + z, hi - z)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``value`` in places lo to hi - 1; NONE where there is none."""
        rank = self.below(lo, hi, np.minimum(value, (1 << self.bits) - 1))
        some = rank < hi - lo
        found = np.full(len(lo), NONE, dtype=np.int64)
        found[some] = self.ranked(lo[some], hi[some], rank[some])
        return found


def windows(k: int) -> list[tuple[int, int]]:
    """Distances (first, last) at which blocks of 2**k words look for their next occurrence, by windows of at most 2**k places."""
    width = 1 << k
    first, last = (1 if k == 2 else 2 * width - 1), 4 * width - 2
    return [(a, min(a + width - 1, last)) for a in range(first, last + 1, width)]


def progression_candidates(found: Suffixes, at: np.ndarray, first: np.ndarray, step: np.ndarray, last: np.ndarray, width: int) -> list[tuple]:
    """Candidates (place, period) of blocks at ``at`` whose occurrences from ``first`` to ``last`` at most go on by ``step``."""
    run = lambda i: (i - found.backward(i, i + step), i + step + found.forward(i, i + step))
    (begin, end), (begin_2, end_2) = run(at), run(first)
    other = begin != begin_2
    pairs = [(at[other], (begin_2 - begin)[other]), (at[other], (end_2 - end)[other])]
    meet = np.flatnonzero(other & (end >= begin_2))
    count = (np.minimum(last, end_2 - width)[meet] - first[meet]) // step[meet] + 1
    which, number = np.repeat(meet, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return [*pairs, (at[which], first[which] + number * step[which] - at[which])]


def all_runs(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start and period, of the texts that ``words`` holds one after the other."""
    found = Suffixes(words, firsts)
    n, pairs = len(words), []
    if len(found.groups) > 2:
        # No run without a repeated block of four words: the wavelet matrix needs no other suffixes.
        size = np.bincount(found.groups[2], minlength=n)
        several = size[found.groups[2][found.order]] > 1
        places, rank = found.order[several], np.append(0, np.cumsum(several))
        tree = WaveletMatrix(places)
    for k in range(2, len(found.groups)):
        width, group = 1 << k, found.groups[k]
        at = np.arange(0, n, max(2, width) if k > 2 else 2)
        size = np.bincount(group, minlength=n + 1)
        at = at[size[group[at]] > 1]
        lo, hi = rank[group[at]], rank[group[at] + size[group[at]]]
        for near, far in windows(k):
            end = at + far
            one = tree.successor(lo, hi, at + near)
            some = one <= end
            a, l, h, one, last = at[some], lo[some], hi[some], one[some], end[some]  # noqa: E741
            two = tree.successor(l, h, one + 1)
            three = np.full(len(two), NONE, dtype=np.int64)
            some = two <= last
            three[some] = tree.successor(l[some], h[some], two[some] + 1)
            long_ = three <= last
            pairs += [(a[~long_], (one - a)[~long_]), (a[(two <= last) & ~long_], (two - a)[(two <= last) & ~long_])]
            pairs += progression_candidates(found, a[long_], one[long_], (two - one)[long_], last[long_], width)
    i, q = (np.concatenate([p[x] for p in pairs]) if pairs else np.empty(0, dtype=np.int64) for x in (0, 1))
    i, q = i[(q > 0) & (i + q < n)], q[(q > 0) & (i + q < n)]
    start, end = i - found.backward(i, i + q), i + q + found.forward(i, i + q)
    whole = end - start >= np.maximum(LEAST, 2 * q)
    start, end, q = start[whole], end[whole], q[whole]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))[: len(start)]
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def planted(words: list[str], doc_id: int | None, modulus: int = 10) -> list[str]:
    """The words with the tail that the query's contract repeats in every ``modulus``-th document."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % modulus or not words:
        return words
    n, g = len(words), h // modulus
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def summary(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """The query's columns for one text and its runs (start, length, period)."""
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = words
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for s, length, q in runs:
            change[s + q] += 1
            change[s + length] -= 1
        kept = [w for w, covered in zip(words, np.cumsum(change).tolist()) if not covered]
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(words), len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def text_runs(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words."""
    numbers: dict[str, int] = {}
    flat = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], dtype=np.int64)
    firsts = np.append(0, np.cumsum([len(words) for words in texts])).astype(np.int64)
    found: list[list] = [[] for _ in texts]
    if len(flat):
        start, end, period = all_runs(flat, firsts)
        text = np.searchsorted(firsts, start, side="right") - 1
        for t, s, length, q in zip(text.tolist(), (start - firsts[text]).tolist(), (end - start).tolist(), period.tolist()):
            found[t].append((s, length, q))
    return found


def periodic_runs(docs: DataFrame, plant: int | None = None, together: int = TOGETHER) -> DataFrame:
    """One row for each document: its runs' number, longest one and digests, and the digest of the text without repeated periods.

    ``plant``: the contract's test documents, every so many; None: texts as they are. No shuffle: a document is worked on where it lies.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def finished(ids: list, texts: list) -> pd.DataFrame:
            rows = [(i, *summary(words, runs)) for i, words, runs in zip(ids, texts, text_runs(texts))]
            names = [field.split()[0] for field in SCHEMA.split(", ")]
            return pd.DataFrame(rows, columns=names, dtype=object)

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = WORD.findall(text)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(planted(words, ids[-1], plant) if plant else words)
                held += len(words)
                if held >= together:
                    yield finished(ids, texts)
                    ids, texts, held = [], [], 0
            yield finished(ids, texts)

    return map_frames(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), plant=10)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")
