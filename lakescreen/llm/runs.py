"""Periodic runs: stretches of words that repeat with one period, found by a suffix automaton with ordered sets of end positions.

A run is a stretch of words with smallest period q (words q apart are equal), of ``least`` words and ``power`` periods at least, that no
neighbouring word extends with period q. Texts are collapsed by dropping what a run holds after its first q words.

1. In a run of length L the first L - q words recur q words later, and L - 2q is at least least * (power - 2) / power. So every word
   n-gram of a run occurs twice in it, if n is one more than that (``gram``). N-grams are hashed in numpy; stretches of n-grams that
   recur within their own stretch are kept, again and again until nothing falls away. Most documents have none and are done.
2. A suffix automaton reads the n-grams of a stretch as its letters. From the longest state to the shortest, the ordered set of a state's end
   positions is merged into that of its suffix link, the smaller set into the larger one. Of each position that comes in, the
   neighbours on both sides are new; the words before both agree for exactly the state's length. If the distance d is not above
   that length, the two are a square, and where the next words differ, it is the right end of a run with period d.
3. A multiple of a run's period gives the same stretch; the smallest period of each stretch is kept.

An end position changes sets at most log2(n) times, and a set is held in blocks of bounded size, so a text of one repeated word
takes no longer than others. Documents are worked on where they lie: nothing is shuffled.

Defined cases: null and empty texts have no words and no runs; words are compared by 64-bit hashes of their bytes; repeated rows and rows with
a null id are documents of their own; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, texts, window_hashes, word_hashes, words
from .substring_dedup import kept_words, merged

#: Elements of one block of an ordered set before it is halved.
BLOCK = 1024


class Automaton:
    """The suffix automaton of a sequence: length and suffix link of each state, and the position where a prefix's state first ends (-1: a clone)."""

    def __init__(self, symbols: list[int]) -> None:
        self.length, self.link, self.end = array("i", [0]), array("i", [-1]), array("i", [-1])
        # most states have one way on, which is held in two arrays; further ones are in a dict of dicts
        self._symbol, self._to, self._more = array("q", [-1]), array("i", [-1]), {}
        last = 0
        for at, c in enumerate(symbols):
            last = self._extend(last, c, at)

    def _state(self, length: int, link: int, end: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        self._symbol.append(-1)
        self._to.append(-1)
        return len(self.length) - 1

    def _step(self, state: int, c: int) -> int:
        if self._symbol[state] == c:
            return self._to[state]
        more = self._more.get(state)
        return more.get(c, -1) if more else -1

    def _set(self, state: int, c: int, to: int) -> None:
        if self._symbol[state] in (-1, c):
            self._symbol[state], self._to[state] = c, to
        else:
            self._more.setdefault(state, {})[c] = to

    def _extend(self, last: int, c: int, at: int) -> int:
        length, link = self.length, self.link
        new = self._state(length[last] + 1, 0, at)
        p = last
        while p >= 0 and (q := self._step(p, c)) < 0:
            self._set(p, c, new)
            p = link[p]
        if p < 0:
            return new
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        clone = self._state(length[p] + 1, link[q], -1)
        self._symbol[clone], self._to[clone] = self._symbol[q], self._to[q]
        if q in self._more:
            self._more[clone] = dict(self._more[q])
        while p >= 0 and self._step(p, c) == q:
            self._set(p, c, clone)
            p = link[p]
        link[q] = link[new] = clone
        return new


class Ends:
    """An ordered set of positions in blocks."""

    __slots__ = ("blocks", "size")

    def __init__(self, first: int) -> None:
        self.blocks, self.size = [[first]], 1

    def __iter__(self) -> Iterator[int]:
        return (x for block in self.blocks for x in block)

    def put(self, x: int) -> None:
        blocks = self.blocks
        k = 0 if len(blocks) == 1 else min(bisect_left(blocks, x, key=lambda b: b[-1]), len(blocks) - 1)
        block = blocks[k]
        block.insert(bisect_left(block, x), x)
        self.size += 1
        if len(block) > BLOCK:
            blocks[k : k + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]

    def around(self, x: int) -> tuple[int, int]:
        """The next smaller and the next greater element, or -1."""
        blocks = self.blocks
        k = 0 if len(blocks) == 1 else bisect_left(blocks, x, key=lambda b: b[-1])
        if k == len(blocks):
            return blocks[-1][-1], -1
        block = blocks[k]
        i = bisect_left(block, x)
        after = block[i] if i < len(block) else -1
        return block[i - 1] if i else blocks[k - 1][-1] if k else -1, after


def stretch_runs(symbols: list[int], gram: int, least: int, power: int) -> dict[tuple[int, int], int]:
    """Runs of a sequence of overlapping n-grams, by first and last word (exclusive): their smallest period."""
    found: dict[tuple[int, int], int] = {}
    made = Automaton(symbols)
    n, length, link = len(symbols), made.length, made.link
    sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in made.end]
    for state in np.argsort(-np.asarray(length), kind="stable").tolist():
        up = link[state]
        if up <= 0:  # what ends in the root shares nothing
            sets[state] = None
            continue
        small, large = sets[state], sets[up]
        sets[state] = None
        if large is None:
            sets[up] = small
            continue
        if small.size > large.size:
            small, large = large, small
        common = length[up] + gram - 1  # words that agree before both positions
        reach = min(common, common // (power - 1))
        incoming = list(small)
        for x in incoming:
            for y in large.around(x):
                if y >= 0 and 0 < (d := abs(y - x)) <= reach and common + d >= least:
                    left, right = (x, y) if x < y else (y, x)
                    if right + 1 == n or symbols[left + 1] != symbols[right + 1]:
                        stretch = left - length[up] + 1, right + gram
                        found[stretch] = min(d, found.get(stretch, d))
        for x in incoming:
            large.put(x)
        sets[up] = large
    return found


def _recurring(grams: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Whether each n-gram occurs twice or more in its part."""
    by = np.lexsort([grams, part])
    same = (grams[by][1:] == grams[by][:-1]) & (part[by][1:] == part[by][:-1])
    out = np.zeros(len(grams), bool)
    out[by[1:][same]] = out[by[:-1][same]] = True
    return out


def candidates(hashes: np.ndarray, row: np.ndarray, gram: int, least: int) -> list[tuple[int, np.ndarray]]:
    """First word and n-grams of the stretches that can hold a run."""
    grams, whole = window_hashes(hashes, row, gram)
    place = np.flatnonzero(whole)
    part = row[place]
    while len(place):
        keep = _recurring(grams[place], part)
        left = place[keep]
        cut = np.flatnonzero((np.diff(left) != 1) | (np.diff(row[left]) != 0)) + 1
        sizes = np.diff(np.concatenate([[0], cut, [len(left)]]))
        part = np.repeat(np.arange(len(sizes)), sizes)
        wide = np.repeat(sizes + gram - 1 >= least, sizes)  # fewer words are no run
        done = keep.all() and wide.all()
        place, part = left[wide], part[wide]
        if done:
            break
    if not len(place):
        return []
    return [(int(p[0]), grams[p]) for p in np.split(place, np.flatnonzero(np.diff(part)) + 1)]


def find(raw: np.ndarray, at: np.ndarray, least: int = 24, power: int = 3) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each row that has any, by start and period."""
    gram = least * (power - 2) // power + 1
    start, end, row = words(raw, at)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for first, grams in candidates(word_hashes(raw, start, end), row, gram, least):
        symbols = np.unique(grams, return_inverse=True)[1].tolist()
        of = int(row[first])
        shift = first - int(np.searchsorted(row, of))
        found.setdefault(of, []).extend((a + shift, b - a, d) for (a, b), d in stretch_runs(symbols, gram, least, power).items())
    return {r: sorted(x, key=lambda t: (t[0], t[2])) for r, x in found.items() if x}


def collapse(docs: DataFrame, least: int = 24, power: int = 3) -> DataFrame:
    """For every row of docs: doc_id, runs (start, length and period in words, by start and period), n_words, n_dropped, and
    collapsed: the words outside the repetitions, joined by one space."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts(batch.column(1))
            for lo, hi in chunks(at):
                found = find(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], least, power)
                rest = [kept_words(raw[at[i] : at[i + 1]].tobytes(), merged([(s + q, s + n) for s, n, q in found.get(i - lo, ())])) for i in range(lo, hi)]
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(i, ())] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(runs, pa.list_(run)), pa.array([x[0] for x in rest], pa.int64()), pa.array([x[1] for x in rest], pa.int64()), pa.array([x[2].decode() for x in rest], pa.string())],
                    ["doc_id", "runs", "n_words", "n_dropped", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, runs ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>, n_words BIGINT, n_dropped BIGINT, collapsed STRING"
    return docs.select("doc_id", "text").mapInArrow(apply, schema)
