"""Similarity join of shingle sets by Jaccard: links, their number, components.

Set relations save most of the work, on two levels.

Answers: sets that agree on a band of minimum hashes are compared with one of
them; what links then is a group, with its first set as the leader. What a
member lacks and adds against the leader tells its overlap with any other
member: |S & X| = |L| - |L - S| - |L - X| + (common differences), so the links
inside a group are derived from the differences and no pair of whole sets is
formed. Members so close to the leader that they link with all others are
counted without looking at pairs at all.

Index: pairs across groups come from an index over set prefixes; two sets that
reach the threshold share an element of their prefixes, in an order that puts
common elements last. Its lists are sorted by set size and, within, by the
element's position; blocks of sizes that cannot reach the threshold are
skipped, so are blocks of the set's own group, and the rest of a block from the
first position that leaves too few elements.

Guests: a set that may link with members of a large group is paired with the
group's leader alone. Its differences to the leader tell the overlap with every
member, as they do inside a group, whether or not it links with the leader.

Elements and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits as filters
from .components import labels
from .scratch import release, staged
from .words import claim, slices

WIDTH = 5
#: Two sets link when PART * intersection >= WHOLE * union.
PART, WHOLE = 100, 75
BANDS, ROWS = 8, 4
#: Sets of a band, drawn by hash, that the others of the band are compared with.
LEADERS = 2
#: Elements count as common by buckets of their hashes: of 2 ** HOT_BITS
#: buckets, those that many sets of a task share, the most shared first.
HOT_BITS, HOT_LEAST, HOT_MOST = 22, 16, 200_000
#: Candidate pairs that a task holds at a time; it needs some 100 bytes for each.
CHUNK = 1 << 18
#: Entries of a group in a list's size from which they are a block of their own.
OWN_BLOCK = 16
#: Members of a group whose links are derived together; larger groups go in
#: pairs of such blocks.
MEMBERS = 4096
#: Members of a group from which other sets are its guests and no pairs of sets.
LARGE = 32
#: A part's slack from which nothing is known of its members' distances.
MOST_SLACK = (1 << 32) - 1

U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
#: A word's hash is the sum of its bytes' values times powers of STEP by place.
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, np.int64).astype(np.uint64) * U(2) + U(1)
_BYTE[_WHITE] = 0
STEP = 0x9E3779B97F4A7C15
#: Bytes that are hashed at a time, more only for a longer word; few stay in the cache.
SPAN = 1 << 16
_POWERS: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _powers(step: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``step`` or more, from 1 on."""
    if len(_POWERS.get(step, ())) < n:
        _POWERS[step] = np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, step, U))])
    return _POWERS[step]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text), A-Z lower-cased.

    The bytes of UTF-8 do: white space is ASCII, and so are A to Z.
    """
    claim()
    raw = [t.encode("utf-8", "surrogatepass").lower() + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    white = _WHITE[data]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    sums = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        # powers count from the first of these words, and the inverse of its start's sets each right
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + SPAN, "right")))
        n = int(ends[to - 1] - base)
        values = _BYTE[data[base : base + n]]
        values *= _powers(STEP, max(n, SPAN))[:n]
        first = starts[at:to] - base
        sums[at:to] = np.add.reduceat(values, first) * _powers(pow(STEP, -1, 1 << 64), max(n, SPAN))[first]
        at = to
    hashes = mixed(sums * U(STEP) + (ends - starts).astype(U))
    edges = np.cumsum([len(r) for r in raw])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, edges)]))
    return hashes, counts


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(elements, sizes): the sorted distinct shingles of each text in turn."""
    words, counts = word_hashes(texts)
    step = U(0xD6E8FEB86659FD93)
    ends = np.cumsum(counts)
    wide = np.maximum(counts - WIDTH + 1, 0)
    at = np.repeat(ends - counts, wide) + np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
    value = np.full(len(at), U(WIDTH))
    for k in range(WIDTH):
        value = value * step + words[at + k]
    value = mixed(value)
    parts, done = [], np.cumsum(wide) - wide
    for i, n in enumerate(counts.tolist()):
        if n >= WIDTH:
            own = np.unique(value[done[i] : done[i] + wide[i]])
        elif n:
            one = U(n)
            with np.errstate(over="ignore"):
                for w in words[ends[i] - n : ends[i]]:
                    one = one * step + w
            own = mixed(np.array([one], np.uint64))
        else:
            own = np.zeros(0, np.uint64)
        parts.append(own)
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.array([len(p) for p in parts], np.int64)


def prints_of(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    prints, full = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        prints[full] = mixed(np.add.reduceat(mixed(elements ^ U(0x5851F42D4C957F2D)), starts) + sizes[full].astype(np.uint64))
    return prints


def sketches(elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the sets, hashes of their bands)."""
    owner, prints = np.repeat(np.arange(len(sizes)), sizes), prints_of(elements, sizes)
    bins = BANDS * ROWS
    slot = owner * bins + (elements >> U(64 - (bins - 1).bit_length())).astype(np.int64)
    lows = np.zeros(len(sizes) * bins, np.uint64)
    first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
    lows[slot[first]] = elements[first]
    lows = lows.reshape(len(sizes), BANDS, ROWS)
    bands = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sizes), 1))
    for k in range(ROWS):
        bands = mixed(bands * U(0xD6E8FEB86659FD93) + lows[:, :, k])
    return prints, bands


def parities(own: np.ndarray) -> bytes:
    """A bit for each value of the elements' last bits, about two an element:
    whether an odd number of elements has it. Of two sets, at least as many
    elements are in one alone as bits differ."""
    bits = max(64, 1 << int(2 * len(own) - 1).bit_length()) if len(own) else 64
    return np.packbits(np.bincount((own & U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the elements in one set alone, from two such bit rows;
    the longer one folds onto the other."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    while len(large) > len(small):
        large = large[: len(large) // 2] ^ large[len(large) // 2 :]
    return int(np.bitwise_count(small ^ large).sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _texts(batch: pa.RecordBatch, at: int = 1) -> list[str]:
    return [t or "" for t in batch.column(at).to_pylist()]


def described(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, the print p, bands and parity bits; and rows without a
    doc_id but with a hot bucket and the number of sets that share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, total = np.zeros(1 << HOT_BITS, np.int32), 0
        for batch in slices(batches):
            elements, sizes = shingle_sets(_texts(batch))
            np.add.at(shared, (elements >> U(64 - HOT_BITS)).astype(np.int64), 1)
            total += len(elements)
            prints, bands = sketches(elements, sizes)
            rows, none, ends = len(sizes), [None] * len(sizes), np.cumsum(sizes).tolist()
            bits = pa.array([parities(elements[e - n : e]) for e, n in zip(ends, sizes.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), _signed(prints), pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * BANDS, BANDS, dtype=np.int32)), _signed(bands.ravel())), bits, pa.array(none, pa.int32()), pa.array([False] * rows)], NAMES
            )
        hot = np.flatnonzero(shared >= HOT_LEAST + 4 * total / len(shared))
        blank = [None] * len(hot)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blank, pa.int64()), pa.array(shared[hot].astype(np.int64)), pa.array(blank, pa.int64()), pa.array(blank, pa.list_(pa.int64())), pa.array(blank, pa.binary()), pa.array(hot.astype(np.int32)), pa.array([True] * len(hot), pa.bool_())], NAMES
        )

    return docs.mapInArrow(run, "doc_id long, n long, p long, bands array<long>, bits binary, bucket int, hot boolean")


NAMES = ["doc_id", "n", "p", "bands", "bits", "bucket", "hot"]


def hot_buckets(spark, rows: DataFrame) -> np.ndarray:
    """Which buckets of elements come last in the order: 2 ** HOT_BITS booleans."""
    top = rows.filter("hot").groupBy("bucket").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "bucket").limit(HOT_MOST)
    out = np.zeros(1 << HOT_BITS, bool)
    out[[r.bucket for r in top.select("bucket").collect()]] = True
    return out


def sets_of(docs: DataFrame, ids: DataFrame, room: int) -> DataFrame:
    """p and the elements (binary) of the rows whose doc_id may be the ``id``
    of a row of ``ids``: a bit filter of about 16 bits an id, ``room`` in all,
    passes these and a few others."""
    held = docs.sparkSession.sparkContext.broadcast(filters.collected(ids.select(filters.slot(F.col("id"), room).alias("slot")), room))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            passed = np.flatnonzero(filters.passed(own, batch.column(2).to_numpy())) if batch.num_rows else ()
            for part in slices([batch.take(pa.array(passed))]) if len(passed) else ():
                elements, sizes = shingle_sets(_texts(part))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([_signed(prints_of(elements, sizes)), pa.array([elements[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())], ["p", "elements"])

    return docs.filter("doc_id IS NOT NULL").withColumn("slot", filters.slot(F.col("doc_id"), room)).mapInArrow(run, "p long, elements binary").filter("length(elements) > 0")


def fetched(pairs: DataFrame, docs: DataFrame, classes: DataFrame, room: int) -> DataFrame:
    """p and the elements of the classes at the ends of ``pairs``."""
    ends = pairs.select(F.col("a").alias("p")).unionAll(pairs.select(F.col("b").alias("p"))).distinct()
    return staged(sets_of(docs, ends.join(classes.select("p", F.col("least").alias("id")), "p"), room), "sets")


def overlaps(pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold. With
    ``differences``, all pairs, with the sizes of both sets, their common
    elements and the elements that one of them has alone (binary)."""
    both = pairs.join(sets.select(F.col("p").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("p").alias("b"), F.col("elements").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, m, shared, apart = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                same = x[at] == y
                n.append(len(x))
                m.append(len(y))
                shared.append(int(same.sum()))
                if differences:
                    apart.append(np.concatenate([np.delete(x, at[same]), y[~same]]).tobytes())
            n, m, shared = (np.array(v, np.int64) for v in (n, m, shared))
            if differences:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (n, m, shared)), pa.array(apart, pa.binary())], ["a", "b", "n", "m", "common", "apart"])
            else:
                keep = PART * shared >= WHOLE * (n + m - shared)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    kind = "a long, b long, n long, m long, common long, apart binary" if differences else "a long, b long"
    return staged(both.select("a", "b", "x", "y").mapInArrow(run, kind).dropDuplicates(["a", "b"]), "overlaps")


def prefixes(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """doc_id, p, n and the prefix (binary) of each row with a set."""
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.unpackbits(held.value)
        for batch in slices(batches):
            elements, sizes = shingle_sets(_texts(batch))
            keys = elements >> U(1) | last[(elements >> U(64 - HOT_BITS)).astype(np.int64)].astype(np.uint64) << U(63)
            ends, out = np.cumsum(sizes), []
            for e, n in zip(ends.tolist(), sizes.tolist(), strict=True):
                take = n - -(-WHOLE * n // PART) + 1
                own = keys[e - n : e]
                out.append(np.sort(np.partition(own, take - 1)[:take] if take < n else own).tobytes() if n else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(prints_of(elements, sizes)), pa.array(sizes), pa.array(out, pa.binary())], ["doc_id", "p", "n", "prefix"])

    return docs.mapInArrow(run, "doc_id long, p long, n long, prefix binary").filter("n > 0")


def posted(rows: DataFrame) -> DataFrame:
    """An index row for each element of the prefixes of (p, part, n, prefix); of
    rows with room, 0 but for large parts, it goes along."""
    told = "room" in rows.columns
    rows = rows if told else rows.withColumn("room", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(4)]
            sizes = np.array([len(x) for x in tokens])
            place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            npos = np.repeat(batch.column(2).to_numpy() << 32, sizes) + place
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens)), pa.array(npos), *(pa.array(np.repeat(batch.column(k).to_numpy(), sizes)) for k in (0, 1, 3))], ["token", "npos", "p", "part", "room"]
            )

    index = rows.select("p", "part", "n", "room", "prefix").mapInArrow(run, "token long, npos long, p long, part long, room long")
    return index if told else index.drop("room")


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The common elements that sets of n and m elements need to link."""
    return -(-WHOLE * (n + m) // (PART + WHOLE))


def list_pairs(token: np.ndarray, n: np.ndarray, pos: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of possible pairs of different parts, or in parts with few
    entries, in lists sorted by token, n, pos.

    Each entry looks at the blocks of its list with its own or a smaller size,
    from the smallest that can link, and within a block at the entries whose
    position leaves enough elements. A part with many entries of a size is a
    block of its own, which entries of the part pass over.
    """
    inside = np.cumsum(np.concatenate([[False], (token[1:] != token[:-1]) | (n[1:] != n[:-1])]))
    by = np.lexsort((part, inside))
    heads = np.flatnonzero(np.concatenate([[True], (part[by][1:] != part[by][:-1]) | (inside[by][1:] != inside[by][:-1])]))
    sizes = np.diff(np.append(heads, len(by)))
    own = np.full(len(token), -1, np.int64)  # which block of its own an entry is in
    own[by] = np.repeat(np.where(sizes >= OWN_BLOCK, np.arange(len(sizes)), -1), sizes)
    order = np.lexsort((pos, own, inside))
    token, n, pos, part, own = token[order], n[order], pos[order], part[order], own[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (n[1:] != n[:-1]) | (own[1:] != own[:-1])])
    block = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(token)]])
    size, head = n[starts], np.concatenate([[True], token[starts][1:] != token[starts][:-1]])
    sole, of = own[starts] >= 0, part[starts]
    list_at = np.maximum.accumulate(np.where(head, np.arange(len(starts)), 0))  # first block of the list
    wide = int(size.max()) + 2
    rank = (np.cumsum(head) * wide + size).astype(np.int64)  # blocks ordered by list and size
    lowest = np.searchsorted(rank, np.cumsum(head) * wide + -(-WHOLE * size // PART))
    lowest = np.maximum(lowest, list_at)
    code = block * (int(pos.max()) + 2) + pos
    look = (block - lowest[block] + 1).astype(np.int64)  # blocks that an entry looks at
    done = np.cumsum(look)
    at = 0
    while at < len(token):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CHUNK, "right")))
        entry = np.repeat(np.arange(at, to), look[at:to])
        b = np.repeat(lowest[block[at:to]], look[at:to]) + np.arange(len(entry)) - np.repeat(np.cumsum(look[at:to]) - look[at:to], look[at:to])
        need = needed(n[entry], size[b])
        fits = (n[entry] - pos[entry] >= need) & ~(sole[b] & (of[b] == part[entry]))
        entry, b, need = entry[fits], b[fits], need[fits]
        top = np.searchsorted(code, b * (int(pos.max()) + 2) + np.maximum(size[b] - need, -1), "right")
        top = np.minimum(np.where(b == block[entry], np.minimum(top, entry), top), ends[b])
        count = np.maximum(top - starts[b], 0)
        some = count > 0
        entry, first, count = entry[some], starts[b[some]], count[some]
        sums, k = np.cumsum(count), 0
        while k < len(entry):
            m = max(k + 1, int(np.searchsorted(sums, (sums[k - 1] if k else 0) + CHUNK, "right")))
            c = count[k:m]
            yield order[np.repeat(first[k:m], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)], order[np.repeat(entry[k:m], c)]
            k = m
        at = to


def guest_pairs(token: np.ndarray, n: np.ndarray, pos: np.ndarray, part: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of entries i and of an entry j of a large part, one for all
    of its entries in a list that have a size, that i may link with; lists are
    sorted by token, n, pos. Of two large parts, members of the one with less
    room are guests of the other."""
    large = np.flatnonzero(room)
    if not len(large):
        return
    large = large[np.lexsort((pos[large], n[large], part[large], token[large]))]
    blocks = large[np.concatenate([[True], np.any([x[large][1:] != x[large][:-1] for x in (token, part, n)], 0)])]  # the first position
    wide = int(n.max()) + 2
    start = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]])) * wide
    rank, size = start + n, n[blocks]
    lowest = np.searchsorted(rank, start[blocks] - (-WHOLE * size // PART))
    look = np.searchsorted(rank, start[blocks] + np.minimum(PART * size // WHOLE, wide - 1), "right") - lowest
    done = np.cumsum(look)
    for at in range(0, int(done[-1]), CHUNK):
        flat = np.arange(at, min(at + CHUNK, int(done[-1])))
        b = np.searchsorted(done, flat, "right")
        i, j = lowest[b] + flat - (done - look)[b], blocks[b]
        need = needed(n[i], n[j])
        less = (room[i] < room[j]) | ((room[i] == room[j]) & (part[i] < part[j]))
        fits = less & (n[i] - pos[i] >= need) & (n[j] - pos[j] >= need)
        yield i[fits], j[fits]


def candidates(index: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different parts that may link. If the index
    has room, a class that may link with members of a large part comes in one
    pair with the part's leader b instead; slack is the part's there, else -1."""
    told = "room" in index.columns
    index = index if told else index.withColumn("room", F.lit(0).cast("long"))
    rows = index.repartition(F.col("token")).sortWithinPartitions("token", "npos", "p")

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, npos, own, part, room = (table.column(k).to_numpy() for k in range(5))
        if not len(token):
            return
        n, pos = npos >> 32, npos & 0xFFFFFFFF

        def batch(a: np.ndarray, b: np.ndarray, slack: np.ndarray) -> pa.RecordBatch:
            rows = np.unique(np.stack([a, b, slack], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], ["a", "b", "slack"])

        for i, j in guest_pairs(token, n, pos, part, room):
            if len(i):
                yield batch(own[i], part[j], room[j] & MOST_SLACK)
        few = np.flatnonzero(room == 0)
        if not len(few):
            return
        own, part = own[few], part[few]
        for i, j in list_pairs(token[few], n[few], pos[few], part):
            apart = part[i] != part[j]
            a, b = own[i[apart]], own[j[apart]]
            if len(a):
                yield batch(np.minimum(a, b), np.maximum(a, b), np.full(len(a), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # lists not known to have ended
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column(0).to_numpy()
            last = int(np.searchsorted(token, token[-1]))
            if token[0] != token[-1] or (held and held[-1].column(0)[-1].as_py() != token[0]):
                yield from found(single_lists_out(pa.Table.from_batches([*held, batch.slice(0, last)], batch.schema)))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from found(single_lists_out(pa.Table.from_batches(held)))

    pairs = rows.mapInArrow(run, "a long, b long, slack long")
    return (pairs if told else pairs.select("a", "b")).distinct()


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, beginnings, lengths) of a binary column."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8), ends[:-1], np.diff(ends)


def differing(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Lower bounds of the elements in one set alone, from two columns of such
    bit rows; of two rows the longer one folds onto the shorter."""
    (flat_x, at_x, wide_x), (flat_y, at_y, wide_y) = _rows(x), _rows(y)
    out = np.zeros(len(x), np.int64)
    for w in np.unique(np.stack([wide_x, wide_y]), axis=1).T.tolist():
        some = np.flatnonzero((wide_x == w[0]) & (wide_y == w[1]))
        rows = [flat[at[some][:, None] + np.arange(n)].view(np.uint64) for flat, at, n in ((flat_x, at_x, w[0]), (flat_y, at_y, w[1]))]
        small, large = sorted(rows, key=lambda r: r.shape[1])
        while large.shape[1] > small.shape[1]:
            large = large[:, : large.shape[1] // 2] ^ large[:, large.shape[1] // 2 :]
        out[some] = np.bitwise_count(small ^ large).sum(1)
    return out


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose parity bits leave a link possible: of sets that link,
    at most (PART - WHOLE) / (PART + WHOLE) of all elements are in one alone.
    With a slack of 0 or more, b leads a part and a link of a with any member
    is meant; the member that allows most adds the slack to this bound; the column guest tells these pairs."""
    told = "slack" in pairs.columns
    pairs = pairs if told else pairs.withColumn("slack", F.lit(-1).cast("long"))
    side = classes.select("p", "n", "bits")
    both = pairs.join(side.toDF("a", "n", "x"), "a").join(side.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y", "slack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            slack = batch.column(6).to_numpy()
            most = (PART - WHOLE) * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) + np.maximum(slack, 0)
            keep = ((PART + WHOLE) * differing(batch.column(4), batch.column(5)) <= most) | (slack == MOST_SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slack >= 0)], ["a", "b", "guest"]).filter(pa.array(keep))

    found = both.mapInArrow(run, "a long, b long, guest boolean")
    return found if told else found.select("a", "b")


def single_lists_out(table: pa.Table) -> pa.Table:
    """Without the elements that the sets of one part alone have."""
    token, part = table.column(0).to_numpy(), table.column(3).to_numpy()
    if not len(token):
        return table
    heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    several = np.minimum.reduceat(part, heads) != np.maximum.reduceat(part, heads)
    return table.filter(pa.array(np.repeat(several, np.diff(np.append(heads, len(token)))))).combine_chunks()


def derived_links(weight: np.ndarray, apart: list[np.ndarray], total: int, left: np.ndarray) -> np.ndarray:
    """Links of each member of a group with the members on the other side (all
    others, if every member is on the ``left``), from the members' differences
    to the leader. Members link if the common differences, PART + WHOLE each,
    make up for what their weights exceed ``total`` by."""
    counts = np.zeros(len(weight), np.int64)
    rows = np.flatnonzero(left)
    columns = rows if left.all() else np.flatnonzero(~left)
    if not len(rows) or not len(columns):
        return counts
    sizes = np.array([len(x) for x in apart], np.int64)
    elements, ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *apart]), return_inverse=True)
    owner = np.repeat(np.arange(len(weight)), sizes)
    place = np.full(len(weight), -1)
    place[columns] = np.arange(len(columns))
    on = place[owner] >= 0  # the inverted lists of the differences
    by = np.argsort(ids[on], kind="stable")
    lists, edges = place[owner[on]][by], np.searchsorted(ids[on][by], np.arange(len(elements) + 1))
    ends = np.cumsum(sizes)
    step = max(1, CHUNK // len(columns))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        common = np.zeros((len(some), len(columns)), np.int32)
        if (weight[some].max() + weight[columns].max()) > total:
            for k, r in enumerate(some.tolist()):
                own = ids[ends[r] - sizes[r] : ends[r]]
                spans = [lists[edges[e] : edges[e + 1]] for e in own.tolist()]
                if spans:
                    common[k] = np.bincount(np.concatenate(spans), minlength=len(columns))
        link = (PART + WHOLE) * common >= weight[some][:, None] + weight[columns][None, :] - total
        if columns is rows:
            link[np.arange(len(some)), np.arange(at, at + len(some))] = False
        else:
            counts[columns] += link.sum(0)
        counts[some] += link.sum(1)
    return counts


def inner_links(members: DataFrame) -> DataFrame:
    """p and its number of links inside its group, of (part, p, n, common,
    whole, apart): whole is the leader's size, apart the differences to it.

    Two members link if their weights, PART + WHOLE for each element that one
    lacks of the leader and WHOLE for each element it has, stay within the
    leader's total, or common differences make up for the rest. A member that
    stays within it with the heaviest one links with all; only the others are
    looked at, in pairs of blocks. Blocks are of sizes within WHOLE / PART of
    each other, so that only neighbouring sizes can link.
    """
    rows = weighted(members)
    groups = rows.groupBy("part").agg(F.count("*").alias("size"), F.max("weight").alias("most")).filter("size > 1")
    rows = rows.join(groups, "part").withColumn("close", F.col("weight") + F.col("most") <= F.col("total"))
    sure = rows.filter("close").select("p", (F.col("size") - 1).alias("links"))
    others = rows.filter("NOT close")
    steps = stepped(others)
    others = others.join(steps, "part")
    reached = others.select("p", (F.col("size") - F.aggregate("steps", F.lit(0).cast("long"), lambda x, s: x + s["many"])).alias("links"))  # the close ones
    dealt = others.withColumn("block", block_of("steps")).withColumn("other", F.explode(blocks_near("steps")))
    dealt = dealt.select("part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") <= F.col("other")).alias("left"), "p", "weight", "total", "apart")
    return sure.unionByName(reached).unionByName(counted_links(dealt).select("p", "links")).groupBy("p").agg(F.sum("links").alias("links"))


def guest_links(members: DataFrame, guests: DataFrame) -> DataFrame:
    """part, p, left and links: how many members a guest of the part links with
    (left), and a member with how many guests. Both tables are as above, their
    differences those to the part's leader."""
    members, guests = weighted(members.join(guests.select("part").distinct(), "part", "left_semi")), weighted(guests)
    home, away = stepped(members).withColumnRenamed("steps", "home"), stepped(guests).withColumnRenamed("steps", "away")
    steps = home.join(away, "part")
    members = members.join(steps, "part").select("*", F.explode(blocks_near("away")).alias("low"), block_of("home").alias("high"), F.lit(False).alias("left"))
    guests = guests.join(steps, "part").select("*", block_of("away").alias("low"), F.explode(blocks_near("home")).alias("high"), F.lit(True).alias("left"))
    kept = ["part", "low", "high", "left", "p", "weight", "total", "apart"]
    return counted_links(guests.select(kept).unionByName(members.select(kept)), apart=True).groupBy("part", "p", "left").agg(F.sum("links").alias("links"))


def weighted(rows: DataFrame) -> DataFrame:
    """With weight, the leader's total and the step of sizes, as above."""
    weight = (PART + WHOLE) * (F.col("whole") - F.col("common")) + WHOLE * F.col("n")
    return rows.withColumns({"weight": weight, "total": (PART + WHOLE) * F.col("whole"), "step": F.floor(F.log("n") / float(np.log(PART / WHOLE)) + 1e-9).cast("long")})


def stepped(rows: DataFrame) -> DataFrame:
    """part and its steps of sizes, each with its blocks of MEMBERS rows."""
    steps = rows.groupBy("part", "step").agg(F.count("*").alias("many"))
    return steps.select("part", F.struct("step", F.ceil(F.col("many") / MEMBERS).alias("blocks"), "many").alias("own")).groupBy("part").agg(F.collect_list("own").alias("steps"))  # sizes have few steps


def block_of(steps: str) -> Column:
    """The block of a row, given its part's steps."""
    mine = F.filter(steps, lambda s: s["step"] == F.col("step"))[0]["blocks"]
    return F.col("step") * (1 << 32) + F.pmod(F.xxhash64("p"), mine)


def blocks_near(steps: str) -> Column:
    """The blocks of the row's step of sizes and of its neighbours."""
    near = F.filter(steps, lambda s: F.abs(s["step"] - F.col("step")) <= 1)
    return F.flatten(F.transform(near, lambda s: F.transform(F.sequence(F.lit(0).cast("long"), s["blocks"] - 1), lambda k: s["step"] * (1 << 32) + k)))


def counted_links(dealt: DataFrame, apart: bool = False) -> DataFrame:
    """part, p, left and links of each row of (part, low, high, left, p, weight,
    total, apart), with those of the same blocks low and high; ``apart`` if the
    two sides are of different rows throughout."""
    dealt = dealt.repartition(F.col("part"), F.col("low"), F.col("high")).sortWithinPartitions("part", "low", "high", "p")
    sides = apart

    def counted(table: pa.Table) -> pa.RecordBatch:
        left = table.column("left").to_numpy()
        apart = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("apart")]
        if sides and left.all():
            links = np.zeros(len(left), np.int64)
        else:
            links = derived_links(table.column("weight").to_numpy(), apart, table.column("total")[0].as_py(), left)
        return pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks() for k in ("part", "p", "left")), pa.array(links)], ["part", "p", "left", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            turn = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(turn, turn[1:], strict=False):
                if held and any(held[-1].column(k)[0].as_py() != keys[k, a] for k in range(3)):
                    yield counted(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield counted(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "part long, p long, left boolean, links long")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of ``docs``;
    n_links is the number of other sets that the row's set links with, copies
    of a set being one.

    Null and empty texts have no shingles and link with nothing. A doc_id is
    one vertex: rows that repeat it, of equal or unlike texts, are in one
    component. A null doc_id takes no part and gets a null component. An empty
    table gives no rows. A very long text is one large set, held whole by the
    tasks that compare it. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    rows = staged(described(docs), "jaccard")
    own = rows.filter("NOT hot")
    sets = own.filter("n > 0 AND doc_id IS NOT NULL")
    classes = staged(sets.groupBy("p").agg(F.min(F.struct("doc_id", "n", "bands", "bits")).alias("first")).select("p", F.col("first.doc_id").alias("least"), "first.n", "first.bands", "first.bits"), "classes")
    room = filters.sized(classes.count())

    # each set of a band against a few of the band
    banded = classes.select("p", F.posexplode("bands").alias("band", "key"))
    drawn = [F.min_by("p", F.xxhash64("p", "band", F.lit(k))) for k in range(LEADERS)]
    leads = banded.groupBy("band", "key").agg(F.array_distinct(F.array(*drawn)).alias("leaders"), F.count("*").alias("many")).filter("many > 1")
    pairs = banded.join(leads, ["band", "key"]).select("p", F.explode("leaders").alias("a")).filter("p != a")
    pairs = staged(plausible(pairs.select(F.least("a", "p").alias("a"), F.greatest("a", "p").alias("b")).distinct(), classes), "near")
    sets = fetched(pairs, docs, classes, room)
    near = overlaps(pairs, sets)
    parts = staged(labels(near.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")
    members = overlaps(parts.select(F.col("label").alias("a"), F.col("node").alias("b")), sets, True)
    release(sets)
    stars = members.select(F.col("b").alias("p"), F.col("a").alias("part"), F.col("m").alias("n"), "common", F.col("n").alias("whole"), "apart")
    leaders = members.select(F.col("a").alias("p"), "n").distinct()
    leaders = leaders.select("p", F.col("p").alias("part"), "n", F.col("n").alias("common"), F.col("n").alias("whole"), F.lit(b"").alias("apart"))
    stars = stars.unionByName(leaders)
    inner = inner_links(stars)
    # what a link with a member allows beyond a link with the leader, at most
    slack = F.max((PART - WHOLE) * (F.col("n") - F.col("whole")) + (PART + WHOLE) * (F.col("whole") + F.col("n") - 2 * F.col("common")))
    large = stars.groupBy("part").agg(F.count("*").alias("size"), F.least(slack, F.lit(MOST_SLACK)).alias("slack")).filter(F.col("size") >= LARGE)
    large = large.select("part", (F.col("size") * (1 << 32) + F.col("slack")).alias("room"))

    # pairs across groups from the index
    vertices = classes.select("p", "least").join(parts, F.col("p") == F.col("node"), "left").select("p", F.col("least").alias("doc_id"), F.coalesce("label", "p").alias("part"))
    vertices = vertices.join(large, "part", "left").withColumn("room", F.coalesce("room", F.lit(0).cast("long")))
    index = posted(prefixes(docs, hot_buckets(spark, rows)).join(vertices, ["doc_id", "p"]))
    chosen = staged(plausible(candidates(index), classes), "candidates")
    sets = fetched(chosen, docs, classes, room)
    more = overlaps(chosen.filter("NOT guest").select("a", "b"), sets)
    visits = overlaps(chosen.filter("guest").select(F.col("b").alias("a"), F.col("a").alias("b")), sets, True)
    release(sets)
    guests = visits.select(F.col("b").alias("p"), F.col("a").alias("part"), F.col("m").alias("n"), "common", F.col("n").alias("whole"), "apart")
    hosted = staged(guest_links(stars, guests).filter("links > 0"), "hosted")
    ends = more.select(F.col("a").alias("p")).unionAll(more.select(F.col("b").alias("p")))
    links = inner.unionByName(ends.groupBy("p").agg(F.count("*").alias("links"))).unionByName(hosted.select("p", "links")).groupBy("p").agg(F.sum("links").alias("n_links"))

    # ids that repeat with unlike texts tie their sets together
    mixed_ids = staged(own.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("p").alias("low"), F.max("p").alias("high")).filter("low != high").select("doc_id"), "repeats")
    again = own.join(mixed_ids, "doc_id").filter("n > 0").select("doc_id", "p").distinct()
    ties = again.join(again.groupBy("doc_id").agg(F.min("p").alias("v")), "doc_id").select(F.col("p").alias("u"), "v")
    edges = near.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))).unionByName(ties)
    edges = edges.unionByName(hosted.filter("left").select(F.col("p").alias("u"), F.col("part").alias("v")))  # parts are connected
    found = labels(edges)
    found = found.unionByName(found.select(F.col("label").alias("node"), "label").distinct())
    named = classes.join(found, F.col("p") == F.col("node"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    known = staged(named.select("p", "label").join(least, "label").join(links, "p", "full").select("p", "component", "n_links"), "components")
    own_component = again.join(classes.select("p", "least"), "p").join(known, "p", "left").groupBy("doc_id").agg(F.min(F.least("component", "least")).alias("of_id"))

    out = own.join(classes.select("p", "least"), "p", "left").join(known, "p", "left").join(own_component, "doc_id", "left")
    component = F.coalesce("of_id", F.when(F.col("n") > 0, F.coalesce("component", "least")).otherwise(F.col("doc_id")))
    release(near, members, chosen, pairs, more, visits, hosted, parts)
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )
