"""Documents into chunks: fixed windows, sentences, nested separators, tokens.

Fixed windows are built-in expressions. The other strategies depend on what
came before within a text; they run on Arrow batches, a text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

SIZE, OVERLAP = 512, 50
SCHEMA = "doc_id long, index int, text string, start_char int, end_char int, char_count int, token_estimate int"
#: Where a sentence ends: before white space and a capital, or at a line's end.
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s*$", re.M)
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ", "")


def checked(size: int, overlap: int) -> None:
    if overlap >= size:
        raise ValueError(f"the overlap ({overlap}) must be smaller than the chunk size ({size})")


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` characters, each ``size - overlap`` after the one
    before, while one starts within the text; the last may lie inside its
    predecessor. Offsets count from the first character that is not white."""
    checked(size, overlap)
    step = size - overlap
    rows = docs.select("doc_id", trimmed(F.col("text")).alias("whole")).filter(F.length("whole") > 0)
    rows = rows.select("doc_id", "whole", F.posexplode(F.expr(f"sequence(0, length(whole) - 1, {step})")).alias("index", "start_char"))
    rows = rows.withColumn("text", F.expr(f"substring(whole, start_char + 1, {size})"))
    n = F.length("text")
    return rows.select("doc_id", "index", "text", "start_char", (F.col("start_char") + n).alias("end_char"), n.alias("char_count"), F.floor(n / 4).cast("int").alias("token_estimate"))


def gathered(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Pieces joined by spaces as long as they fit. A chunk begins with the last
    pieces of the one before that fit into the overlap; a piece on top of these,
    or longer than the size, is not checked again."""
    held: list[str] = []

    def room(parts: list[str]) -> int:
        return sum(len(p) + 1 for p in parts)

    for piece in pieces:
        if held and room(held) + len(piece) + 1 > size:
            yield " ".join(held)
            keep = len(held)
            while keep and room(held[keep - 1 :]) <= overlap:
                keep -= 1
            held = held[keep:]
        held.append(piece)
    if held:
        yield " ".join(held)


def windows(sequence, size: int, overlap: int) -> list:
    return [sequence[at : at + size] for at in range(0, len(sequence), size - overlap)]


def sentence(text: str, size: int, overlap: int) -> list[tuple[str, int]]:
    """(chunk, start): whole sentences; where a chunk is not found as it is,
    since white space was unified, it starts where the one before ended."""
    parts = [s for s in map(str.strip, SENTENCE_END.split(text)) if s]
    out, at = [], 0
    for chunk in gathered(parts, size, overlap):
        start = text.find(chunk, max(0, at - len(chunk)))
        start = at if start < 0 else start
        out.append((chunk, start))
        at = start + len(chunk)
    return out


def placed(chunks: list[str], text: str, overlap: int) -> list[tuple[str, int]]:
    """Starts of chunks, each looked for from the overlap before the last end."""
    out, at = [], 0
    for chunk in chunks:
        start = text.find(chunk, at)
        start = at if start < 0 else start
        out.append((chunk, start))
        at = max(at, start + len(chunk) - overlap)
    return out


def pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most ``size``: what is longer is split at the next separator,
    which goes; the empty one, and none, cut windows."""
    work, done = [(text, 0)], []
    while work:
        part, depth = work.pop()
        if len(part) <= size:
            done.append(part)
        elif depth >= len(separators) or not separators[depth]:
            done += windows(part, size, overlap)
        else:
            split = [p for p in map(str.strip, part.split(separators[depth])) if p]
            work += [(p, depth + 1) for p in reversed(split)]
    return done


def recursive(text: str, size: int, overlap: int) -> list[tuple[str, int]]:
    return placed(list(gathered(pieces(text, size, overlap), size, overlap)), text, overlap)


def word_codec() -> tuple[Callable[[str], list], Callable[[list], str]]:
    """Stands in where no vocabulary is at hand: words with the space before."""
    return (lambda text: re.findall(r"\s*\S+", text)), "".join


def vocabulary_codec(path: str) -> tuple[Callable[[str], list], Callable[[list], str]]:
    """A byte-level tokenizer from a file of the tokenizers library."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return (lambda text: made.encode(text, add_special_tokens=False).ids), (lambda ids: made.decode(ids, skip_special_tokens=False))


def tokens(text: str, size: int, overlap: int, codec: tuple[Callable, Callable]) -> list[tuple[str, int]]:
    encode, decode = codec
    return placed([decode(w) for w in windows(encode(text), size, overlap)], text, overlap)


def _rows(docs: DataFrame, split: Callable[[], Callable[[str], list[tuple[str, int]]]]) -> DataFrame:
    types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = split()
        for batch in batches:
            rows = [(i, k, c, a, a + len(c), len(c), len(c) // 4) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and t.strip() for k, (c, a) in enumerate(own(t.strip()))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def chunked(docs: DataFrame, strategy: str = "fixed", size: int = SIZE, overlap: int = OVERLAP, codec: Callable[[], tuple] = word_codec) -> DataFrame:
    """Chunks of docs(doc_id, text) as SCHEMA has them; blank texts give none.
    ``codec`` makes the (encode, decode) pair of the token strategy."""
    checked(size, overlap)
    if strategy == "fixed":
        return fixed(docs, size, overlap)
    makers = {
        "sentence": lambda: lambda t: sentence(t, size, overlap),
        "recursive": lambda: lambda t: recursive(t, size, overlap),
        "token": lambda: (lambda own: lambda t: tokens(t, size, overlap, own))(codec()),
    }
    if strategy not in makers:
        raise ValueError(f"unknown strategy {strategy!r}; there are fixed, {', '.join(makers)}")
    return _rows(docs, makers[strategy])


def summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("strategy").agg(
        F.count("*").alias("total_chunks"), F.round(F.avg("char_count"), 1).alias("avg_size"), F.min("char_count").cast("long").alias("min_size"), F.max("char_count").cast("long").alias("max_size")
    )


def compared(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    parts = [chunked(docs, s, size, overlap).withColumn("strategy", F.lit(s)) for s in ("fixed", "sentence", "recursive")]
    return summary(parts[0].unionByName(parts[1]).unionByName(parts[2]))
