"""Quality rules of texts, with repetition measured on suffix arrays.

All texts of a slice share one suffix array over words, in which a suffix ends
with its text. It is built by prefix doubling that only sorts what is not yet
unique; the groups of each length are kept, so that the longest common prefix
of two neighbours comes from halving steps. Prefixes that neighbours share are
the intervals of maximal repeated substrings; the union of their spans and the
longest of them are limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WORD_RE, claim, slices

WHITE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
WINDOW = 3
#: A repeat has so many words at least; repeats may cover this share of a text,
#: and the longest may have so many words. Of the 3243 good labelled texts of
#: sf0.1 that pass the base rules none has more than 28.2 % or 13 words.
LEAST, COVERED, LONGEST = 8, 0.3, 50
#: The base rules: fewer words fail, and more than this percentage of words in
#: repeated windows.
FEWEST, REPEATED = 50, 50


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, the place in it where the equal keys of each element begin)."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return order, rank


class Suffixes:
    """Suffixes of all texts at once; ``words`` are their lists of words."""

    def __init__(self, words: list[list[str]]):
        self.counts = np.array([len(x) for x in words], np.int64)
        flat = [w for x in words for w in x]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        self.ids = np.fromiter(map(vocabulary.__getitem__, flat), np.int64, len(flat))
        self.owner = np.repeat(np.arange(len(words)), self.counts)
        self.ends = np.repeat(np.cumsum(self.counts), self.counts)  # where the text of a word ends
        self.levels: list[tuple[int, np.ndarray]] = []
        if len(flat):
            self._build()

    def _at(self, values: np.ndarray, at: np.ndarray, step: int, blank: int = 0) -> np.ndarray:
        """values of the words ``step`` after ``at`` plus one, ``blank`` beyond the text."""
        to = at + step
        inside = to < self.ends[at]
        return np.where(inside, values[np.where(inside, to, 0)] + 1, blank)

    def _build(self) -> None:
        every, wide = np.arange(len(self.ids)), int(self.ids.max()) + 2
        _, pair = groups((self.owner * wide + self.ids + 1) * wide + self._at(self.ids, every, 1))
        # the third word; a shorter suffix at the end of its text equals no other
        self.order, rank = groups(pair * wide + self._at(self.ids, every, 2))
        length = WINDOW
        self.levels.append((length, rank))
        while True:
            ordered = rank[self.order]
            same = ordered[1:] == ordered[:-1]
            active = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if not active.any():
                break
            slots = np.flatnonzero(active)
            at = self.order[slots]
            after = self._at(rank, at, length)
            by = np.lexsort((after, rank[at]))
            at, after, head = at[by], after[by], rank[at][by]
            self.order[slots] = at
            new = np.concatenate([[True], (head[1:] != head[:-1]) | (after[1:] != after[:-1])])
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
            length *= 2
            self.levels.append((length, rank))

    def common(self) -> np.ndarray:
        """Words that each place in the order shares with the one before it."""
        shared = np.zeros(len(self.ids), np.int64)
        if len(self.ids) < 2:
            return shared
        first = self.levels[0][1][self.order]
        slots = np.flatnonzero(first[1:] == first[:-1]) + 1
        a, b = self.order[slots - 1], self.order[slots]
        got = np.zeros(len(slots), np.int64)
        for length, rank in reversed(self.levels):
            fits = (a + got < self.ends[a]) & (b + got < self.ends[b])
            x, y = np.where(fits, a + got, 0), np.where(fits, b + got, 0)
            got += np.where(fits & (rank[x] == rank[y]), length, 0)
        for _ in range(WINDOW - 1):
            fits = (a + got < self.ends[a]) & (b + got < self.ends[b])
            x, y = np.where(fits, a + got, 0), np.where(fits, b + got, 0)
            got += fits & (self.ids[x] == self.ids[y])
        shared[slots] = got
        return shared

    def _union(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Words of each text within the spans."""
        edge = np.bincount(at, minlength=len(self.ids) + 1) - np.bincount(at + length, minlength=len(self.ids) + 1)
        return np.bincount(self.owner[np.cumsum(edge)[:-1] > 0], minlength=len(self.counts))

    def measure(self, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: words in repeated windows, words in repeats of at
        least ``least`` words, and the words of the longest repeat."""
        if not len(self.ids):
            return (np.zeros(len(self.counts), np.int64),) * 3
        shared = self.common()
        longest = np.maximum(shared, np.concatenate([shared[1:], [0]]))  # of each suffix, either neighbour
        windows = self.order[longest >= WINDOW]
        repeats = longest >= least
        peak = np.zeros(len(self.counts), np.int64)
        np.maximum.at(peak, self.owner[self.order[repeats]], longest[repeats])
        return self._union(windows, WINDOW), self._union(self.order[repeats], longest[repeats]), peak


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def measure(texts: list[str]) -> list[tuple]:
    """The values of COLUMNS for each text."""
    claim()
    words = [WORD_RE.findall(t) for t in texts]
    repeated, covered, longest = (x.tolist() for x in Suffixes(words).measure())
    out = []
    for text, own, r, c, m in zip(texts, words, repeated, covered, longest, strict=True):
        n = len(own)
        lines = [x for x in text.split("\n") if x.strip(WHITE)] if n else []
        failed = n < FEWEST or 100 * r > REPEATED * n
        kept = not failed and c <= COVERED * n and m <= LONGEST
        out.append((n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), r, failed, kept, c, m))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """doc_id and COLUMNS of every row. Null and empty texts have no words and
    fail; equal rows get equal results; other columns are not read."""
    types = (pa.int64(),) * 5 + (pa.bool_(),) * 2 + (pa.int64(),) * 2
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = measure([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + COLUMNS)
