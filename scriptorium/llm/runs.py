"""Periodic runs of words by the algorithm of Kolpakov and Kucherov.

A run is a stretch of words with smallest period q, at least ``exponent`` times as long as q, that no neighbouring word extends.

1. A suffix automaton of the words gives the Lempel-Ziv factors: each is the longest piece from its start on that also starts earlier, or one new word.
2. Main's algorithm finds the runs that cross or touch a factor's start: for each period, how far the words around that border agree with those
   a period further, on either side, from four Z-functions. A run that ends in a factor starts less than a period before the factor
   ahead of it (that factor would have been longer otherwise), which bounds what is looked at, and with the exponent the periods, by a
   third of both factors' lengths.
3. Every other run lies strictly inside a factor, so the factor's earlier occurrence has it too: it is copied from there, in order of starts.

First, words that are too rare for a run are taken as cuts: a stretch of at least ``exponent`` periods has each of its words so many times.
Counting is repeated within what is left between cuts, until nothing more goes. No run reaches over a cut, so the algorithm sees the few stretches that
are left, each alone, with all their runs whole. Documents are rows, and a document's automaton has 20 bytes a state and at most two states a word.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tidy

#: Longest periods per run, and its fewest words.
EXPONENT, LEAST = 4, 6
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
Run = tuple[int, int, int]


class Automaton:
    """The suffix automaton of a sequence of numbers. A state's first transition is in arrays, those of branching states are in dicts."""

    def __init__(self, s: list[int]):
        self.length, self.link, self.first = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.word, self.to = array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        last = 0
        for i, c in enumerate(s):
            last = self.extend(last, c, i)

    def state(self, length: int, link: int, first: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        self.word.append(-1)
        self.to.append(-1)
        return len(self.length) - 1

    def after(self, p: int, c: int) -> int:
        """The state after ``p`` and ``c``, or -1."""
        if self.word[p] == c:
            return self.to[p]
        more = self.more.get(p)
        return more.get(c, -1) if more else -1

    def put(self, p: int, c: int, q: int) -> None:
        if self.word[p] in (c, -1):
            self.word[p], self.to[p] = c, q
        else:
            self.more.setdefault(p, {})[c] = q

    def extend(self, last: int, c: int, i: int) -> int:
        """Adds word ``c`` at place ``i``; returns the state of the whole sequence so far."""
        new, p = self.state(self.length[last] + 1, 0, i), last
        while p >= 0 and (q := self.after(p, c)) < 0:
            self.put(p, c, new)
            p = self.link[p]
        if p < 0:
            return new
        if self.length[p] + 1 != self.length[q]:
            copy = self.state(self.length[p] + 1, self.link[q], self.first[q])
            self.word[copy], self.to[copy] = self.word[q], self.to[q]
            if q in self.more:
                self.more[copy] = dict(self.more[q])
            self.link[q] = copy
            while p >= 0 and self.after(p, c) == q:
                self.put(p, c, copy)
                p = self.link[p]
            q = copy
        self.link[new] = q
        return new


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of the earliest occurrence) of each Lempel-Ziv factor; a new word's occurrence is its own start."""
    automaton, out, at, n = Automaton(s), [], 0, len(s)
    while at < n:
        p = length = 0
        while at + length < n:
            q = automaton.after(p, s[at + length])
            if automaton.first[q] - length >= at:  # the first occurrence of the longer piece is this one
                break
            p, length = q, length + 1
        out.append((at, max(1, length), automaton.first[p] - length + 1 if length else at))
        at += max(1, length)
    return out


def z_function(s: list[int]) -> list[int]:
    """How far the sequence from each place on agrees with the sequence itself."""
    n = len(s)
    z, low, high = [n] * n, 0, 0
    for i in range(1, n):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def crossing(s: list[int], border: int, before: int, after: int, exponent: int, least: int) -> Iterator[Run]:
    """Runs as (first, last, a period) that cross or touch ``border``, between factors of so many words before and after it."""
    longest = (before + after) // (exponent - 1)
    if longest < 1 or before + after + longest < least:
        return
    low, high = max(0, border - before - longest), min(len(s), border + after)
    left, right = s[low:border][::-1], s[border:high]
    n, m = len(left), len(right)
    right_z, left_z = z_function(right), z_function(left)
    ahead, back = min(longest, m), min(longest, n)
    towards = z_function(left + [-1] + s[low : border + ahead][::-1])  # words before border and before border + p, backwards
    onwards = z_function(right + [-1] + s[border - back : high])  # words from border and from border - p on
    for p in range(1, ahead + 1):
        forward = right_z[p] if p < m else 0
        backward = towards[n + 1 + ahead - p] if n else 0
        if forward + backward >= (exponent - 1) * p:
            yield border - backward, border + p + forward - 1, p
    for p in range(1, back + 1):
        forward = onwards[m + 1 + back - p] if m else 0
        backward = left_z[p] if p < n else 0
        if forward + backward >= (exponent - 1) * p:
            yield border - p - backward, border + forward - 1, p


def runs_of(s: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[Run]:
    """All runs of a sequence of numbers from 0 on as (start, length, smallest period), by start, then period.

    ``exponent`` is 2 at least. A run has at least ``exponent`` periods and ``least`` words.
    """
    if not s:
        return []
    n, cut = len(s), factors(s)
    period: dict[tuple[int, int], int] = {}
    for (_, before, _), (border, after, _) in zip(cut, [*cut[1:], (n, 0, n)], strict=True):
        for first, last, p in crossing(s, border, before, after, exponent, least):
            whole = (first == 0 or s[first - 1] != s[first - 1 + p]) and (last == n - 1 or s[last + 1] != s[last + 1 - p])
            if whole and last - first + 1 >= max(least, exponent * p):
                period[first, last] = min(p, period.get((first, last), p))
    ends: dict[int, list[int]] = {}
    for first, last in period:
        ends.setdefault(first, []).append(last)
    starts = sorted(ends)
    for start, length, earlier in cut:
        shift, i = start - earlier, bisect_left(starts, earlier + 1)
        while shift and i < len(starts) and starts[i] < earlier + length - 1:
            first = starts[i]
            for last in ends[first]:
                if last < earlier + length - 1 and (first + shift, last + shift) not in period:
                    period[first + shift, last + shift] = period[first, last]
                    if first + shift not in ends:
                        ends[first + shift] = []
                        insort(starts, first + shift)
                    ends[first + shift].append(last + shift)
            i += 1
    return sorted((first, last - first + 1, p) for (first, last), p in period.items())


def stretches(s: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Stretches (start, stop) outside of which no run has words; in each, every word is often enough to be in one."""
    left = [(0, len(s))]
    while left:
        start, stop = left.pop()
        if stop - start < max(least, exponent):
            continue
        _, number, count = np.unique(s[start:stop], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[number] < exponent)
        if not len(rare):
            yield start, stop
            continue
        edges = np.concatenate([[-1], rare, [stop - start]])
        long = np.flatnonzero(np.diff(edges) > max(least, exponent))
        left += [(start + int(edges[i]) + 1, start + int(edges[i + 1])) for i in long]


class Numbers(dict):
    """word -> its number, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def document_runs(words: list[bytes], exponent: int = EXPONENT, least: int = LEAST) -> list[Run]:
    """All runs of a document, as (start, length, period) in order."""
    s = np.fromiter(map(Numbers().__getitem__, words), np.int64, len(words))
    found = []
    for start, stop in stretches(s, exponent, least):
        numbers = np.unique(s[start:stop], return_inverse=True)[1].reshape(-1).tolist()
        found += [(start + first, length, p) for first, length, p in runs_of(numbers, exponent, least)]
    return sorted(found)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that a run has after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, p in runs:
        gone[start + p : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def periodic_runs(
    docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each row of ``docs`` (RUNS): its runs by start, then period, and its words without the runs' repeats.

    Words end at ASCII white space and are numbered from 0. A run is a stretch with smallest period q of at least ``exponent`` * q (2 or more) and
    ``least`` words that no neighbouring word extends with that period; runs may overlap. ``collapsed`` has the words that no run has after
    its first q words, joined by one space, in UTF-8. ``prepare`` may change a document's words first.

    Null, empty and wordless texts have no words and no runs. Ids may be null or repeat, equal rows count each; an empty table gives no
    rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            sizes, runs, texts = [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").split()
                words = prepare(doc_id.as_py(), words) if prepare else words
                found = document_runs(words, exponent, least)
                sizes.append(len(words))
                runs.append([{"start": a, "length": n, "period": p} for a, n, p in found])
                texts.append(b" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), RUNS)
