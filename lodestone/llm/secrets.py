"""Secrets in documents: fixed patterns, and a chain that tags further ones.

A linear-chain CRF tags each word as outside, beginning or inside a secret,
from its shape, its neighbours and features of the file, decoded by Viterbi.
It learns from the spans that the patterns find in a bounded sample, without
seeing the patterns: a word's identity is no feature unless it is short and of
letters only, so that what it learns carries over to secrets of other forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .scratch import lowest, staged
from .words import WORD_RE, slices, tidy

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: An assignment holds one of these, in either case, so other texts need no search.
ASSIGNED = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

#: The chain learns from at most so many documents with a span and without,
#: those whose ids have the lowest hashes.
SAMPLE = (1000, 500)
OUTSIDE, BEGIN, INSIDE = range(3)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, by start, then kind.

    Matches are leftmost and non-overlapping within a kind; those too short are
    dropped after they were matched, so what they cover is not searched again.
    For the two single runs a shorter run can be left out of the pattern itself.
    """
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(x in low for x in ASSIGNED):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    return ordered(found)


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    rank = {k: i for i, k in enumerate((*KINDS, "chain"))}
    return sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


class _Classes(dict):
    """Classes of characters: digits d, a to f a, other lower case x, upper
    case X, other ASCII itself, all else u."""

    def __missing__(self, c: str) -> str:
        self[c] = k = "d" if c.isdigit() else "a" if c in "abcdef" else "x" if c.islower() else "X" if c.isupper() else c if c.isascii() else "u"
        return k


CLASSES = _Classes()
RUNS = re.compile(r"(.)\1+", re.S)
SOLID = re.compile("[daxXu]+")
UNMARKED = crf.hashed(["q="])


@lru_cache(1 << 13)
def _of_classes(classes: str) -> tuple[list[int], list[int], list[int]]:
    """Features that words of the same classes share: those before and those
    after the mark's, and those of words whose shape is long."""
    n, digits, shape, more = len(classes), classes.count("d"), RUNS.sub(r"\1", classes), []
    if len(shape) > 12:
        run = max(SOLID.findall(classes), key=len, default="")
        more = [f"e={shape[-12:]}", f"t={min(len(run) // 8, 8)},{''.join(sorted(set(run)))}"]
    lead = [f"h={shape[:12]}", f"n={n if n < 16 else 15 + min(n // 8, 8)}", f"d={min(digits, 3)},{n >= 16}"]
    rest = [f"k={''.join(sorted(set(classes) & {'d', 'a', 'x', 'X', 'u'}))},{n >= 16},{n >= 24}", "bias"]
    return crf.hashed(lead), crf.hashed(rest), crf.hashed(more)


def features(word: str) -> list[int]:
    """Shape, length, digits, the mark at either end, kinds of characters, and
    the word itself if it is short and of letters only; of a word whose shape is
    long, also the end of the shape and the length and kinds of its longest run
    of letters and digits. All of them are taken from the whole word."""
    lead, rest, more = _of_classes("".join(map(CLASSES.__getitem__, word)))
    mark = UNMARKED if word[0].isalnum() else crf.hashed([f"q={word[0]}{word[-1]}"])
    bare = word.strip("\"'=:,;.").lower()
    if len(bare) <= 12 and bare.isalpha():
        more = crf.hashed([f"w={bare}"])
    return [*lead, *mark, *rest, *more]


features.forget = _of_classes.cache_clear  # with the chain's table


def notes(text: str) -> list[int]:
    """Features of the file: has assignments, is one line, is long, has braces."""
    return [i for i, on in enumerate(("=" in text, "\n" not in text, len(text) > 4000, "{" in text)) if on]


def tags(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[str], list[int]]:
    """The words of a text and their states, from spans in code points."""
    words, states, at = [], [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    last = -1
    for m in WORD_RE.finditer(text):
        while at < len(merged) and merged[at][1] <= m.start():
            at += 1
        on = at < len(merged) and merged[at][0] < m.end()
        words.append(m[0])
        states.append(OUTSIDE if not on else INSIDE if last == at else BEGIN)
        last = at if on else -1
    return words, states


def train(texts: list[str], seed: int = 0) -> crf.Chain:
    tagged = [tags(text, base_spans(text)) for text in texts]
    chain = crf.Chain(3, features, 4)
    chain.first[INSIDE] = chain.move[OUTSIDE, INSIDE] = -8.0  # nothing is inside that did not begin
    if any(any(t) for _, t in tagged):
        chain.fit([w for w, _ in tagged], [t for _, t in tagged], [notes(t) for t in texts], seed=seed)
    else:
        chain.first[:] = chain.move[:, :] = [0, -30, -30]
    return chain


def learn(docs: DataFrame) -> crf.Chain:
    """A chain from a bounded sample, two thirds of it rows that hold a pattern;
    of rows that repeat an id the least text counts. No rows teach nothing, and
    the chain finds nothing."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # the single runs are cheap to look for; assignments mostly hold one
    marked = F.col("text").rlike("[0-9a-f]{16}|AKIA[A-Z0-9]{14}").alias("marked")
    narrow = staged(rows.select("doc_id", marked), "marked")
    ids = [lowest(narrow.filter(on), "doc_id", n).select("doc_id") for on, n in zip((F.col("marked"), ~F.col("marked")), SAMPLE, strict=True)]
    picked = staged(ids[0].unionAll(ids[1]).distinct(), "picked")  # at most sum(SAMPLE) rows
    texts = rows.join(F.broadcast(picked), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # at most sum(SAMPLE)
    chain = train(sorted(r.text for r in texts))
    del texts
    tidy()  # the driver held what it trained on
    return chain


def chain_spans(words: list[re.Match], states: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i in np.flatnonzero(states):
        if states[i] == INSIDE and out and out[-1][2] == i - 1:
            out[-1][1:] = [words[i].end(), i]
        else:
            out.append([words[i].start(), words[i].end(), i])
    return [(a, b) for a, b, _ in out]


def beside(text: str, span: tuple[int, int], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a span outside of the spans ``taken``, without white space
    at their ends; parts without a letter or digit are no secrets."""
    (at, end), parts = span, []
    for a, b in sorted(t for t in taken if t[0] < end and span[0] < t[1]):
        if a > at:
            parts.append((at, a))
        at = max(at, b)
    if at < end:
        parts.append((at, end))
    out = []
    for a, b in parts:
        words = list(WORD_RE.finditer(text, a, b))
        if any(c.isalnum() for c in text[a:b]):
            out.append((words[0].start(), words[-1].end()))
    return out


def scan(docs: DataFrame, chain: crf.Chain) -> DataFrame:
    """doc_id and spans (array of start, end, kind) of every row, code points,
    end exclusive, by start, then kind. Null counts as the empty text, which
    has no spans; what only the chain finds has the kind 'chain' and overlaps
    none of the patterns' spans, which are taken out of a chain's span. The
    chain runs over the whole of a text, however long; rows that repeat give
    their spans each; an empty table gives no rows. Other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words = [WORD_RE.findall(t) for t in texts]
            emit, real, counts = own.blocks(words, [notes(t) for t in texts])
            path = crf.viterbi(emit, own.move, own.first, real, counts) if len(emit) else np.zeros((0, crf.BLOCK), np.int8)
            out, at = [], 0
            for text, n in zip(texts, counts.tolist(), strict=True):
                spans, states = base_spans(text), path[at : at + n].ravel()
                at += n
                if states.any():
                    taken = [(a, b) for a, b, _ in spans]
                    more = chain_spans(list(WORD_RE.finditer(text)), states)
                    spans = ordered(spans + [(a, b, "chain") for m in more for a, b in beside(text, m, taken)])
                out.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


MASK = "[SECRET]"


def redact(docs: DataFrame, chain: crf.Chain) -> DataFrame:
    """``docs`` with each span, overlapping ones as one, replaced by MASK, and
    n_chars, where it is a column, counted anew. Rows without spans, and null
    texts, stay as they are. Columns and their types stay."""
    held, schema = docs.sparkSession.sparkContext.broadcast(chain), docs.schema

    def mask(text: str, spans: list[tuple[int, int]]) -> str:
        parts, last = [], 0
        for a, b in sorted(spans):
            if a >= last:
                parts += [text[last:a], MASK]
            last = max(last, b)
        return "".join([*parts, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches):
            given = batch.column("text").to_pylist()
            texts = [t or "" for t in given]
            emit, real, counts = own.blocks([WORD_RE.findall(t) for t in texts], [notes(t) for t in texts])
            path = crf.viterbi(emit, own.move, own.first, real, counts) if len(emit) else np.zeros((0, crf.BLOCK), np.int8)
            at, changed = 0, {}
            for i, (text, n) in enumerate(zip(texts, counts.tolist(), strict=True)):
                spans, states = [(a, b) for a, b, _ in base_spans(text)], path[at : at + n].ravel()
                at += n
                if states.any():
                    spans += chain_spans(list(WORD_RE.finditer(text)), states)
                if spans:
                    changed[i] = mask(text, spans)
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["text"] = pa.array([changed.get(i, t) for i, t in enumerate(given)], batch.schema.field("text").type)
            if "n_chars" in columns and changed:
                counted = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(counted)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)
