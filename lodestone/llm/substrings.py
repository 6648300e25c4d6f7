"""Removal of byte strings that a document with a smaller id holds already.

A suffix array over all texts would bring equal strings together: suffixes, cut
after LENGTH bytes, that sort next to each other are the repeats. Sorting every
suffix would move fifty times the input, so a suffix is filed under a leading
token, the one of least hash of the GRAM-byte tokens that start within it (the
leftmost of them): equal suffixes have the same token at the same place. Runs of
neighbouring suffixes have the same token occurrence and travel as one stretch.

1. Texts are put into slices, written once into hash buckets of the slice's
   number; what later steps find comes back by that number and moves no text.
2. The hashes of the slices' tokens are shuffled as sorted, packed numbers by
   range. A range's task says of each whether several documents hold the token,
   and whether it is hot: too many unlike stretches to bring them together.
3. Stretches of shared tokens are shuffled as hashes of their bytes. All but
   those of the smallest document are settled; of the first ones, those whose
   token has unlike stretches go on. A hot token's suffixes are hashed one by
   one here, which settles them and spreads the token over all tasks.
4. What goes on travels with its bytes: sampled splitters range-partition it by
   the leading tokens, each bucket sorts the suffixes of its stretches by a
   multikey quicksort, and neighbours are compared. Splitters are whole tokens,
   so suffixes on either side of a boundary differ: none is equal across it.
5. All spans come back to their slices, which are cut.

Equal hashes of 128 bits count as equal strings in step 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits
from .jaccard import mixed
from .scratch import bucketed, release, staged
from .words import claim, slices

LENGTH, GRAM = 50, 24
SPREAD = LENGTH - GRAM + 1
#: Bytes of the texts of a slice, and bytes that are worked on together, small
#: enough for a processor's cache.
SLICE, BLOCK = 4 << 20, 1 << 20
#: Tokens of a hash range, about, and hash ranges at least.
RANGE_TOKENS, RANGES = 1 << 21, 64
#: Unlike stretches from which a token is hot.
HOT = 1 << 14
#: Tokens sampled for splitters, about, and groups that they travel in.
SAMPLE, SPREAD_SAMPLE = 1 << 14, 1021
#: Suffixes that a bucket expands and sorts at a time, unless one token has
#: more; one that is not hot has fewer than HOT * SPREAD.
SORTED = 1 << 19

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, padded at the end; where each text begins, and the end)."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    claim()
    return np.frombuffer(b"".join(texts) + bytes(LENGTH + 16), np.uint8), starts


def runs_of(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``counts`` in turn."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def stretches(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, token place, first and last suffix, token hash) of each stretch.

    Works block by block, so that a long text needs memory for its stretches,
    not for its suffixes; a stretch over a block's border becomes two.
    """
    parts = [_block(data, starts, a, min(a + BLOCK, int(starts[-1]))) for a in range(0, int(starts[-1]), BLOCK)]
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds))


def _block(data: np.ndarray, starts: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, ...]:
    n = end - begin + SPREAD - 1
    word = np.ndarray((n + GRAM - 8,), "<u8", data, begin, strides=(1,)).astype(np.uint64)
    hashes = word[:n] * ODD
    for k, odd in zip(range(8, GRAM, 8), (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93), strict=True):
        hashes += word[k : n + k] * U(odd)
    hashes ^= hashes >> U(29)
    hashes *= U(0x165667B19E3779F9)
    low = (hashes & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    reach = 1
    while 2 * reach <= SPREAD:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < SPREAD:
        low = np.minimum(low[: reach - SPREAD], low[SPREAD - reach :])
    lead, stop = int(np.searchsorted(starts, begin, "right")) - 1, int(np.searchsorted(starts, end, "left"))
    from_ = np.maximum(starts[lead:stop], begin)
    whole = np.maximum(np.minimum(starts[lead + 1 : stop + 1] - LENGTH + 1, end) - from_, 0)  # suffixes of each text
    text = np.repeat(np.arange(lead, stop), whole)
    at = runs_of(whole) + np.repeat(from_, whole)
    if not len(at):
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
    token = (low[at - begin] & U(0xFFFFFFFF)).astype(np.int64) + begin
    new = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return text[new], token[new], at[new], at[last], hashes[token[new] - begin]


def digests(data: np.ndarray, at: np.ndarray, size: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Hashes of the ``size`` bytes from ``at`` of each string."""
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = mixed((size.astype(np.uint64) << U(32)) + np.asarray(salt).astype(np.uint64) + U(1))
    for k in range(0, int(size.max()) if len(size) else 0, 8):
        out = mixed(out * ODD + (view[np.minimum(at + k, len(view) - 1)] & _MASKS[np.clip(size - k, 0, 8)]))
    return out


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each place in it) of rows of words, in the order of the
    strings; a group holds equal rows.

    Multikey quicksort with words of eight bytes as its characters: rows are
    split by the present word, and only rows that are equal in it, the middle
    part of the split, go on to the next word, all such parts at once.
    """
    order = np.argsort(words[:, 0], kind="stable")
    group = np.zeros(len(words), np.int64)
    value = words[order, 0]
    group[1:] = np.cumsum(value[1:] != value[:-1])
    for k in range(1, words.shape[1]):
        same = np.concatenate([[False], group[1:] == group[:-1], [False]])
        middle = np.flatnonzero(same[1:] | same[:-1])
        if not len(middle):
            break
        rows, own = order[middle], group[middle]
        value = words[rows, k]
        by = np.lexsort((value, own))
        order[middle], value = rows[by], value[by]
        split = np.zeros(len(words), bool)
        split[middle[1:]] = (value[1:] != value[:-1]) & (own[1:] == own[:-1])
        group += np.cumsum(split)
    return order, group


def suffix_words(pieces: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each of ``at`` as words that sort as the strings
    do; ``pieces`` goes on for 8 bytes after the last."""
    view = np.ndarray((len(pieces) - 7,), ">u8", pieces, strides=(1,))
    out = np.empty((len(at), -(-LENGTH // 8)), np.uint64)
    for k in range(out.shape[1]):
        out[:, k] = view[at + 8 * k]
    if LENGTH % 8:
        out[:, -1] >>= U(64 - 8 * (LENGTH % 8))
    return out


def repeated(doc: np.ndarray, first: np.ndarray, last: np.ndarray, pieces: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of runs of suffixes that a smaller doc holds too;
    row's stretch is at ``begin`` of ``pieces``, which has 8 bytes to spare."""
    counts = last - first + 1
    row, inner = np.repeat(np.arange(len(doc)), counts), runs_of(counts)
    order, group = multikey(suffix_words(pieces, begin[row] + inner))
    own = doc[row[order]]
    least = np.minimum.reduceat(own, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))
    late = np.zeros(len(row), bool)
    late[order] = own > least[group]
    goes_on = late[1:] & late[:-1] & (row[1:] == row[:-1])
    start = np.flatnonzero(late & ~np.concatenate([[False], goes_on]))
    stop = np.flatnonzero(late & ~np.concatenate([goes_on, [False]]))
    return row[start], first[row[start]] + inner[start], first[row[start]] + inner[stop]


def _raw(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the SHA-256 and the mark of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = _raw(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()), pa.array([mark(t) for t in raw], pa.int64())], ["doc_id", "n_bytes", "print", "mark"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, print binary, mark long")


def mark(raw: bytes) -> int:
    """Tells apart the texts of rows that repeat a doc_id."""
    return int.from_bytes(hashlib.sha256(raw).digest()[:8], "big", signed=True)


def sliced(docs: DataFrame, chosen) -> DataFrame:
    """Slices of the rows of (doc_id, text, slot) whose slot ``chosen`` passes:
    a number, the ids, marks and sizes of the texts, and the texts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, size, number, part = [], [], 0, 0, 0

        def packed() -> pa.RecordBatch:
            columns = [(part << 32) + number, np.array(ids, np.int64).tobytes(), np.array([mark(t) for t in raw], np.int64).tobytes(), np.array([len(t) for t in raw], np.int64).tobytes(), pa.compress(b"".join(raw), "zstd", asbytes=True)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, (pa.int64(), *[pa.binary()] * 4), strict=True)], ["slice", "ids", "marks", "sizes", "texts"])

        for batch in slices(batches):
            on = bits.passed(chosen.value, batch.column(2).to_numpy())
            if not on.any():
                continue
            some = batch.filter(pa.array(on))
            part = some.column(3)[0].as_py()
            for doc, text in zip(some.column(0).to_pylist(), _raw(some, 1), strict=True):
                ids.append(doc)
                raw.append(text)
                size += len(text)
                if size >= SLICE:
                    yield packed()
                    ids, raw, size, number = [], [], 0, number + 1
        if ids:
            yield packed()

    return docs.withColumn("part", F.spark_partition_id()).mapInArrow(run, "slice long, ids binary, marks binary, sizes binary, texts binary")


class Slice:
    """A slice and its stretches."""

    def __init__(self, row: dict):
        self.number = row["slice"]
        self.ids, self.marks, sizes = (np.frombuffer(row[k], np.int64) for k in ("ids", "marks", "sizes"))
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.raw = pa.decompress(row["texts"], int(self.starts[-1]), "zstd", asbytes=True)
        claim()
        self.data = np.frombuffer(self.raw + bytes(LENGTH + 16), np.uint8)

    def find(self, shift: int) -> None:
        self.text, self.token, self.first, self.last, self.hashes = stretches(self.data, self.starts)
        self.doc = self.ids[self.text]
        # tokens are those of least hashes, which are crowded
        self.slots, self.back = np.unique(mixed(self.hashes) >> U(shift), return_inverse=True)

    def contents(self, some: np.ndarray) -> np.ndarray:
        """Hashes of the bytes of stretches and of their token's place."""
        first = self.first[some]
        return digests(self.data, first, self.last[some] - first + LENGTH, self.token[some] - first)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Slice, dict]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            yield Slice(row), row


def _planes(numbers: np.ndarray) -> bytes:
    """Packed, byte by byte of the numbers: the high ones are mostly zero."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _from_planes(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(raw.T).view("<u8").ravel().astype(np.uint64)


class Scale:
    """How hashes of tokens are cut into slots and ranges, by the bytes of all texts."""

    def __init__(self, total: int):
        tokens = max(1, 2 * total // (SPREAD + 1))
        self.bits = min(56, max(24, tokens.bit_length() + 6))
        self.range_bits = max(RANGES, tokens // RANGE_TOKENS).bit_length()
        self.share = min(1.0, SAMPLE / tokens)

    @property
    def shift(self) -> int:
        return 64 - self.bits

    def edges(self, slots: np.ndarray) -> np.ndarray:
        return np.searchsorted(slots, np.arange((1 << self.range_bits) + 1, dtype=np.uint64) << U(self.bits - self.range_bits))


MESSAGE = "range int, slice long, n long, slots binary, several binary, unlike binary, lead binary"
ANSWER = "range int, slice long, shared binary, hot binary, lead binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def messages(table: DataFrame, scale: Scale) -> DataFrame:
    """Of each slice and range: the sorted slots of its tokens, which of them
    several of its documents have, and how many unlike stretches more than one;
    and, with negative ranges, a sample of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _ in opened(batches):
            own.find(scale.shift)
            if not len(own.slots):
                continue
            order = np.argsort(own.back, kind="stable")
            heads = np.searchsorted(own.back[order], np.arange(len(own.slots)))
            texts = own.text[order]
            several = np.minimum.reduceat(texts, heads) != np.maximum.reduceat(texts, heads)
            counts = np.diff(np.append(heads, len(order)))
            unlike = np.zeros(len(own.slots), np.uint64)
            more = np.flatnonzero((counts > 1)[own.back])
            if len(more):
                pairs = np.unique(np.stack([own.back[more].astype(np.uint64), own.contents(more)], 1), axis=0)[:, 0].astype(np.int64)
                unlike += np.maximum(np.bincount(pairs, minlength=len(own.slots)) - 1, 0).astype(np.uint64)
            edges = scale.edges(own.slots)
            rows = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[k], edges[k + 1]
                rows.append((k, own.number, int(b - a), _planes(np.diff(own.slots[a:b], prepend=U(k) << U(scale.bits - scale.range_bits))), np.packbits(several[a:b]).tobytes(), _planes(unlike[a:b]) if unlike[a:b].any() else None, None))
            # drawn by occurrence, so that a frequent token weighs as much as it has
            draw = mixed(own.hashes + own.doc.astype(np.uint64) * ODD + (own.token - own.starts[own.text]).astype(np.uint64))
            for t in own.token[(draw >> U(11)).astype(float) / (1 << 53) < scale.share].tolist():
                rows.append((-1 - own.number % SPREAD_SAMPLE, own.number, 0, None, None, None, own.data[t : t + GRAM].tobytes()))
            yield _batch(rows, MESSAGE)

    return table.mapInArrow(run, MESSAGE)


def answers(sent: DataFrame, buckets: int) -> DataFrame:
    """Which of a message's slots several documents hold, and which are hot
    (places); messages without any get no answer. Samples pass."""

    def answered(held: list[tuple]) -> Iterator[tuple]:
        slots = np.concatenate([np.cumsum(_from_planes(x[3], x[2])) for x in held])
        sizes = np.array([x[2] for x in held])
        several = np.concatenate([np.unpackbits(np.frombuffer(x[4], np.uint8), count=x[2]) for x in held]).astype(bool)
        unlike = np.concatenate([_from_planes(x[5], x[2]) if x[5] else np.zeros(x[2], np.uint64) for x in held]).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], slots[order][1:] != slots[order][:-1]]))
        counts = np.diff(np.append(heads, len(order)))
        several = (counts > 1) | np.logical_or.reduceat(several[order], heads)
        hot = several & (counts + np.add.reduceat(unlike[order], heads) >= HOT)
        shared_at, hot_at = np.zeros(len(order), bool), np.zeros(len(order), bool)
        shared_at[order], hot_at[order] = np.repeat(several, counts), np.repeat(hot, counts)
        for x, end, n in zip(held, np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            if shared_at[end - n : end].any():
                yield (x[0], x[1], np.packbits(shared_at[end - n : end]).tobytes(), np.flatnonzero(hot_at[end - n : end]).astype(np.int64).tobytes(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] < 0:
                    out.append((row[0], row[1], None, None, row[6]))
                    continue
                if held and held[0][0] != row[0]:
                    out += answered(held)
                    held = []
                held.append(row)
            if out:
                yield _batch(out, ANSWER)
        out = list(answered(held)) if held else []
        if out:
            yield _batch(out, ANSWER)

    return sent.repartition(buckets, F.col("range")).sortWithinPartitions("range", "slice").mapInArrow(run, ANSWER)


#: Kinds of rows: settled, a stretch, a single suffix of a hot token.
DONE, STRETCH, SINGLE = range(3)
KEYED = "kind int, key long, digest long, doc_id long, slice long, first int, last int, token int"


def keyed(found: DataFrame, scale: Scale) -> DataFrame:
    """Stretches and single suffixes of the tokens that are shared, without
    those that an equal one of a smaller document of the slice settles: these
    are DONE, neighbours as one. ``found``: slices with their answers."""

    def least(key: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
        order = np.lexsort((doc, digest, key))
        k, d = key[order], digest[order]
        heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]))
        out = np.empty(len(doc), np.int64)
        out[order] = np.repeat(doc[order][heads], np.diff(np.append(heads, len(order))))
        return out

    def batch_of(own: Slice, kind, key, digest, doc, first, last, token) -> pa.RecordBatch:
        n = len(first)
        columns = (np.full(n, kind, np.int32), key.view(np.int64), digest.view(np.int64), doc, np.full(n, own.number), *(x.astype(np.int32) for x in (first, last, token)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in KEYED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, row in opened(batches):
            own.find(scale.shift)
            edges = scale.edges(own.slots)
            shared, hot = np.zeros(len(own.slots), bool), np.zeros(len(own.slots), bool)
            for part in row["answers"]:
                a, b = edges[part["range"]], edges[part["range"] + 1]
                shared[a:b] = np.unpackbits(np.frombuffer(part["shared"], np.uint8), count=b - a)
                hot[a + np.frombuffer(part["hot"], np.int64)] = True
            late = np.zeros(len(own.first), bool)
            some = np.flatnonzero((shared & ~hot)[own.back])
            if len(some):
                key, digest, doc = own.hashes[some], own.contents(some), own.doc[some]
                gone = doc > least(key, digest, doc)
                late[some[gone]] = True
                left, on = some[~gone], ~gone
                yield batch_of(own, STRETCH, key[on], digest[on], doc[on], own.first[left], own.last[left], own.token[left])
            # neighbouring stretches that are settled go as one
            at = np.flatnonzero(late)
            first, last = [own.first[at]], [own.last[at]]
            if len(at):
                new = np.concatenate([[True], (first[0][1:] != last[0][:-1] + 1) | (own.text[at][1:] != own.text[at][:-1])])
                heads = np.flatnonzero(new)
                first, last = [first[0][heads]], [last[0][np.append(heads[1:], len(at)) - 1]]
            some = np.flatnonzero((shared & hot)[own.back])
            if len(some):
                counts = own.last[some] - own.first[some] + 1
                place, doc = np.repeat(own.first[some], counts) + runs_of(counts), np.repeat(own.doc[some], counts)
                size = np.full(len(place), LENGTH)
                key, digest = digests(own.data, place, size, 1), digests(own.data, place, size, 2)
                gone = doc > least(key, digest, doc)
                on = ~gone
                yield batch_of(own, SINGLE, key[on], digest[on], doc[on], place[on], place[on], place[on])
                first.append(place[gone])
                last.append(place[gone])
            first, last = np.concatenate(first), np.concatenate(last)
            if len(first):
                spread = mixed(first.astype(np.uint64) + U(own.number) * ODD)
                yield batch_of(own, DONE, spread, spread, np.zeros(len(first), np.int64), first, last, first)

    return found.mapInArrow(run, KEYED)


OUTCOME = "slice long, first int, last int, token int, settled boolean"


def outcomes(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows that are settled, and of the others the stretches whose token has
    unlike ones in other documents.

    Rows come sorted, so that a group's first document is its least; only the
    first ones of the last token wait for what follows.
    """
    dealt = rows.repartition(buckets, F.col("key")).sortWithinPartitions("kind", "key", "digest", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(table: pa.RecordBatch, settled: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(table.column(c) for c in ("slice", "first", "last", "token")), pa.array(np.full(table.num_rows, settled))], [x.split()[0] for x in OUTCOME.split(", ")])

        def split(table: pa.RecordBatch, end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            kind, key, digest, doc = (table.column(c).to_numpy() for c in ("kind", "key", "digest", "doc_id"))
            new_key = np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])])
            new = new_key | np.concatenate([[True], digest[1:] != digest[:-1]])
            heads = np.flatnonzero(new)
            least = np.repeat(doc[heads], np.diff(np.append(heads, len(doc))))
            settled = (doc > least) | (kind == DONE)
            if settled.any():
                yield out(table.filter(pa.array(settled)), True)
            tops = np.flatnonzero(new_key)
            kinds = np.repeat(np.add.reduceat(new.astype(np.int64), tops), np.diff(np.append(tops, len(doc))))
            goes = ~settled & (kinds > 1) & (kind == STRETCH)
            wait = ~settled
            if end:
                wait[:] = False
            else:
                goes[tops[-1] :] = False
                wait[: tops[-1]] = False
            if goes.any():
                yield out(table.filter(pa.array(goes)), False)
            held = table.filter(pa.array(wait)) if wait.any() else None

        for batch in batches:
            if batch.num_rows:
                table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                yield from split(table, False)
        if held is not None:
            yield from split(held, True)

    return dealt.mapInArrow(run, OUTCOME)


SPAN = "lead binary, doc_id long, slice long, first int, last int, token int, bucket int, stretch binary"
RUN = "slice long, first int, last int"


def binaries(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The byte strings of ``sizes`` from ``at``, without a loop over them."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    values = data[np.repeat(at, sizes) + runs_of(sizes)]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def shipped(found: DataFrame, splitters: list[bytes]) -> DataFrame:
    """The stretches of ``found`` (slices with places) with their bytes and the
    bucket of their leading token."""
    edges = np.array(splitters, f"S{GRAM}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, row in opened(batches):
            first, last, token = np.array([(x["first"], x["last"], x["token"]) for x in row["places"]], np.int64).T
            lead = binaries(own.data, token, np.full(len(token), GRAM))
            bucket = np.searchsorted(edges, np.array(lead.to_pylist(), f"S{GRAM}"), "right").astype(np.int32)
            doc = own.ids[np.searchsorted(own.starts, first, "right") - 1]
            columns = [lead, pa.array(doc), pa.array(np.full(len(doc), own.number)), *(pa.array(x.astype(np.int32)) for x in (first, last, token)), pa.array(bucket), binaries(own.data, first, last - first + LENGTH)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SPAN.split(", ")])

    return found.mapInArrow(run, SPAN)


def compared(rows: DataFrame, buckets: int) -> DataFrame:
    """slice and the first and last of each run of suffixes that a smaller
    document holds too."""
    dealt = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("lead", "doc_id").drop("bucket", "token")

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        doc, number, first, last = (table.column(c).to_numpy() for c in ("doc_id", "slice", "first", "last"))
        stretch = table.column("stretch").combine_chunks()
        stretch = stretch if isinstance(stretch, pa.Array) else stretch.chunk(0)
        begin = np.frombuffer(stretch.buffers()[1], np.int32)[stretch.offset : stretch.offset + len(stretch) + 1].astype(np.int64)
        pieces = np.concatenate([np.frombuffer(stretch.buffers()[2], np.uint8)[: begin[-1]], np.zeros(8, np.uint8)])
        row, a, b = repeated(doc, first.astype(np.int64), last.astype(np.int64), pieces, begin[:-1])
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(number[row]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], [x.split()[0] for x in RUN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches):
            lead = batch.column("lead").to_pylist()
            open_ = len(lead)  # rows of the last token may go on
            while open_ and lead[open_ - 1] == lead[-1]:
                open_ -= 1
            size += int((batch.column("last").to_numpy() - batch.column("first").to_numpy() + 1).sum())
            if size >= SORTED and (open_ or (held and held[-1].column("lead")[-1].as_py() != lead[0])):
                yield from found(pa.Table.from_batches([*held, batch.slice(0, open_)]))
                held, batch, size = [], batch.slice(open_), 0
            held.append(batch)
        if held:
            yield from found(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, RUN)


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, what is left) for [start, end) spans."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    left, at = [], 0
    for a, b in merged:
        left.append(text[at:a])
        at = b
    return sum(b - a for a, b in merged), len(merged), b"".join([*left, text[at:]])


def removed(found: DataFrame) -> DataFrame:
    """What is left of the texts of slices that have spans (first << 32 | last)."""
    schema = "doc_id long, mark long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, row in opened(batches):
            spans = np.sort(np.array(row["spans"], np.int64))
            first, last = spans >> 32, spans & 0xFFFFFFFF
            text = np.searchsorted(own.starts, first, "right") - 1
            heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])).tolist()
            out = []
            for a, b in zip(heads, [*heads[1:], len(text)], strict=True):
                t = int(text[a])
                begin, end = int(own.starts[t]), int(own.starts[t + 1])
                n, runs, left = cut(own.raw[begin:end], list(zip((first[a:b] - begin).tolist(), (last[a:b] - begin + LENGTH).tolist(), strict=True)))
                out.append((int(own.ids[t]), int(own.marks[t]), n, runs, hashlib.sha256(left).hexdigest(), left))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return found.mapInArrow(run, schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (hex) and kept (the
    bytes left, null where nothing or all was removed) of every row.

    Null text counts as empty. Texts shorter than LENGTH bytes stay whole, and
    an empty table gives no rows. A row with a null doc_id takes no part. Rows
    that repeat a doc_id do not remove from each other, and equal ones have
    equal results. A very long text is a slice of its own, worked on block by
    block. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(described(docs), "prints")
    known = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH))
    classes = staged(known.groupBy("print").agg(F.min("doc_id").alias("least"), F.first("n_bytes").alias("n_bytes")), "copies")
    count, total = classes.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    none = hashlib.sha256(b"").hexdigest()
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    # of equal texts, the smallest id stands for all; a few others may pass
    room = bits.sized(count)
    chosen = spark.sparkContext.broadcast(bits.collected(classes.select(bits.slot(F.col("least"), room).alias("slot")), room))
    once = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).withColumn("slot", bits.slot(F.col("doc_id"), room))
    table = bucketed(sliced(once, chosen), "slice", buckets, "slices")

    def back(found: DataFrame, name: str, *columns) -> DataFrame:
        """Slices with what was found for them; only the latter is shuffled."""
        return table.join(found.groupBy("slice").agg(F.collect_list(*columns).alias(name)).hint("shuffle_hash"), "slice")

    scale = Scale(total)
    said = staged(answers(messages(table, scale), buckets), "answers")
    leads = sorted(bytes(r.lead) for r in said.filter("range < 0").select("lead").collect())  # about SAMPLE rows
    shared = back(said.filter("range >= 0"), "answers", F.struct("range", "shared", "hot"))
    settled = staged(outcomes(keyed(shared, scale), buckets), "outcomes")
    release(said)
    splitters = [leads[int(k)] for k in np.linspace(0, len(leads), buckets + 1)[1:-1]] if leads else []
    more = shipped(back(settled.filter("NOT settled"), "places", F.struct("first", "last", "token")), splitters)
    spans = settled.filter("settled").select("slice", "first", "last").unionByName(compared(more, buckets))
    spans = staged(spans, "spans")
    release(settled)

    partly = removed(back(spans, "spans", F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("last").cast("long"))))
    # a row that comes twice meets one of its results
    partly = partly.groupBy("doc_id", "mark").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "kept")])
    found = rows.join(classes.select("print", "least"), "print", "left").join(partly, ["doc_id", "mark"], "left")
    copy = F.col("least").isNotNull() & (F.col("doc_id") > F.col("least"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("print")))).alias("kept_sha256"),
        F.when(~copy, F.col("kept")).alias("kept"),
    )
