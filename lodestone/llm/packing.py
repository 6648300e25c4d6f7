"""Best-fit packing of token pieces into sequences of a fixed length.

Bounded-space online best-fit: a fixed number of bins is open. A bitset has a
bit for every amount of free space that some open bin has; the lowest bit at
or above a piece's length names the best fit. When a new bin is needed and all
are open, the fullest one closes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import staged
from .words import WORD_RE, claim, slices

LENGTH = 2048
OPEN_BINS = 1024
#: Pieces that one packing task takes; its open bins at the end are the only
#: loss against packing all in one task.
PIECES_PER_TASK = 2_000_000
#: Words whose ids a worker remembers: about 200 bytes each.
REMEMBER = 800_000


class BestFit:
    """Bins by free space; ``put`` returns (bin number, offset) of a piece."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.open_bins = length, open_bins
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits = self.open = self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        if not 0 < size <= self.length:
            raise ValueError(f"a piece has 1 to {self.length} tokens, not {size}")
        above = self.bits >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.open_bins:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, space = self.made, self.length
            self.made += 1
        if space > size:
            self.free[space - size].append(number)
            self.bits |= 1 << (space - size)
            self.open += 1
        return number, self.length - space

    def _take(self, space: int) -> int:
        bins = self.free[space]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        self.open -= 1
        return number


class Encoder:
    """ids of texts as little-endian unsigned ints.

    The tokenizer drops white space and never looks across it, so the ids of a
    text are those of its words in turn, and each word is encoded once as long
    as the table holds it. Words of letters only, which are one unit to the
    tokenizer, are encoded many at a time: the ids that end a unit tell them
    apart. Should their number differ, the words are encoded one by one.
    """

    GROUP = 2_000
    #: By their arguments, so that the tasks of one worker process share a table.
    made_before: dict[tuple[str, int], Encoder] = {}

    @classmethod
    def of(cls, path: str, remember: int) -> Encoder:
        key = (path, remember)
        if key not in cls.made_before:
            cls.made_before[key] = cls(path, remember)
        claim(cls.made_before[key])
        return cls.made_before[key]

    def forget(self) -> None:
        self.known, self.split = {}, set()

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        self.remember = remember
        self.made = Tokenizer.from_file(path)
        self.ends = np.zeros(self.made.get_vocab_size(), bool)
        self.ends[[i for token, i in self.made.get_vocab().items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.split: set[str] = set()  # may be more than one unit each
        self.stops = {c: self._each([c])[0] for c in ".,"}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.made.encode_batch_fast(words, add_special_tokens=False)]

    def _units(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.made.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            self.split.update(words)
            return self._each(words)
        flat, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]

    def learn(self, words: set[str]) -> None:
        new, known = words.difference(self.known), self.known
        letters = [w for w in new if w.isalpha()]
        stopped = [w for w in new if w[-1] in self.stops and w[:-1].isalpha()]
        rest = list(new.difference(letters, stopped))
        units = list({*letters, *(w[:-1] for w in stopped)}.difference(known))
        for at in range(0, len(units), self.GROUP):
            group = units[at : at + self.GROUP]
            known.update(zip(group, self._units(group), strict=True))
        known.update(zip(rest, self._each(rest), strict=True))
        # a unit that the tokenizer splits may join what follows: not taken apart
        odd = [w for w in stopped if w[:-1] in self.split] if self.split else []
        known.update(zip(odd, self._each(odd), strict=True))
        for w in set(stopped).difference(odd):
            known[w] = known[w[:-1]] + self.stops[w[-1]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        # the tokenizer ignores case; in texts of ASCII only, lowering is safe before NFC
        words = [WORD_RE.findall(t.lower() if t.isascii() else t) for t in texts]
        if len(self.known) > self.remember:
            self.forget()
        self.learn(set().union(*words))
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in words]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, remember: int = REMEMBER) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each row.

    Null text counts as empty; an empty text still has the end id, so every
    row, repeated ones too, gives at least one piece. Texts are never cut
    before their tokens are; other columns are not read. ``remember`` trades
    memory of the workers for time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder.of(tokenizer, remember), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            coded = encode([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``parts`` with sequence_id and offset.

    Pieces reach their tasks by a hash and are sorted there, so that a task
    that runs again packs the same way. A sequence never spans two tasks;
    sequence ids are unique and otherwise of no meaning.
    """
    parts = staged(parts, "pieces")
    tasks = max(1, -(-parts.count() // per_task))
    salt = F.xxhash64("doc_id", "piece", "ids_crc32")
    # equal rows hash alike: the running id spreads a document that is repeated very often
    dealt = parts.withColumn("salt", salt).repartition(tasks, F.col("salt"), F.col("start")) if tasks > 1 else parts.withColumn("salt", salt).coalesce(1)
    dealt = dealt.sortWithinPartitions("salt", "doc_id", "piece").withColumn("task", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(length, open_bins)
        for batch in batches:
            if not batch.num_rows:
                continue
            put = [bins.put(n) for n in batch.column("length").to_pylist()]
            base = batch.column("task")[0].as_py() << 40
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array([base + n for n, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
