"""Language identification of texts.

Sparse multinomial logistic regression on TF-IDF weights of hashed character
n-grams, trained with follow-the-regularised-leader (per-coordinate rates, L1
and L2 penalties, so that most weights are zero) and calibrated with a
temperature. N-grams run over letters in lower case; one non-letter may stand
at either end as the word's edge. A text's score is a sum over its n-grams, so
texts of any length go through the same few vector operations.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import SPARE, below, drawn, staged
from .words import claim, slices, tidy

ORDERS = (1, 2, 3)
BITS = 16
#: The classifier learns from at most so many documents of a language, those
#: whose ids have the lowest hashes, and at most so many in all.
PER_LANGUAGE, SAMPLE = 500, 8_000
#: More languages than this are joined by shuffle instead of broadcast.
BROADCAST_LANGUAGES = 10_000
#: Texts are worked on in slices of about so many bytes; n-grams need some 50 times as much.
SLICE = 1 << 18
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """Buckets of the n-grams of texts; ``letters`` is made once per process."""

    letters: np.ndarray | None = None

    def __init__(self):
        claim()
        if Grams.letters is None:
            Grams.letters = _letters()

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each order the buckets and the owning text of its n-grams, and
        whether a text has a letter."""
        parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        chars = np.concatenate(parts)
        real = self.letters[chars]
        chars = np.where(real, chars, np.uint32(32)).astype(np.uint64)
        has = np.zeros(len(texts), bool)
        has[owner[real]] = True
        buckets, owners = [], []
        value = np.zeros(len(chars), np.uint64)
        for n in ORDERS:
            size = len(chars) - n + 1
            value = value[:size] * np.uint64(1 << 21) + chars[n - 1 :] if n > 1 else chars
            # letters inside, at least one letter, at most one edge at either end
            if n == 1:
                ok = real
            elif n == 2:
                ok = real[:-1] | real[1:]
            else:
                ok = np.logical_and.reduce([real[k : size + k] for k in range(1, n - 1)])
            mixed = (value[ok] ^ np.uint64(n << 60)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
            owners.append(owner[:size][ok])  # texts are set apart by their edges
        return buckets, owners, has


def document_counts(texts: Iterator[list[str]]) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts."""
    grams, counts, seen, total = Grams(), np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool), 0
    for group in texts:
        buckets, owners, _ = grams(group)
        edges = [np.searchsorted(o, np.arange(len(group) + 1)) for o in owners]
        for i in range(len(group)):
            for b, e in zip(buckets, edges, strict=True):
                seen[b[e[i] : e[i + 1]]] = True
            own = np.flatnonzero(seen)
            counts[own] += 1
            seen[own] = False
        total += len(group)
    return counts, total


class Model:
    """weights: (buckets, languages), with the inverse document frequencies in them."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.languages, self.weights, self.bias, self.temperature = languages, weights.astype(np.float32), bias, temperature

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        buckets, owners, has = Grams()(texts)
        sums, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for b, o in zip(buckets, owners, strict=True):
            n = np.bincount(o, minlength=len(texts))
            total += n
            filled = np.flatnonzero(n)
            if len(filled):
                starts = np.concatenate([[0], np.cumsum(n[filled])[:-1]])
                sums[filled] += np.add.reduceat(self.weights[b], starts, axis=0)
        return sums / np.maximum(total, 1)[:, None] + self.bias, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its probability; ``und`` and 0 for a text
        without a letter, or where no language was learnt."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        z, has = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        return [self.languages[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)], np.where(has, p[np.arange(len(p)), best], 0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], gold: np.ndarray, classes: int, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from sparse rows (buckets, values), in random order."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def solve(z, n, l1):
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            own, seen = z[at], n[at]
            w, b = solve(own, seen, l1), solve(zb, nb, 0)
            miss = softmax(x @ w + b)
            miss[gold[i]] -= 1
            g = x[:, None] * miss
            z[at] = own + g - (np.sqrt(seen + g * g) - np.sqrt(seen)) / alpha * w
            n[at] = seen + g * g
            zb += miss - (np.sqrt(nb + miss * miss) - np.sqrt(nb)) / alpha * b
            nb += miss * miss
    return solve(z, n, l1), solve(zb, nb, 0)


def calibrated(z: np.ndarray, gold: np.ndarray) -> float:
    """The temperature at which the held-back rows are likeliest."""
    if not len(z):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), gold], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(texts: list[str], langs: list[str], idf: np.ndarray, back: int = 5) -> Model:
    """Learn from all but every ``back``-th text, which set the temperature."""
    languages = sorted(set(langs))
    gold = np.array([languages.index(x) for x in langs], int)
    grams, rows = Grams(), []
    for text in texts:
        buckets, _, _ = grams([text])
        at, n = np.unique(np.concatenate(buckets), return_counts=True)
        rows.append((at, n / max(1, n.sum()) * idf[at] * SCALE))
    held = np.arange(len(rows)) % back == back - 1
    weights, bias = ftrl([r for r, h in zip(rows, held, strict=True) if not h], gold[~held], max(1, len(languages)))
    model = Model(languages, weights * idf[:, None] * SCALE, bias)
    if held.any():
        model.temperature = calibrated(model.logits([t for t, h in zip(texts, held, strict=True) if h])[0], gold[held])
    return model


#: Term frequencies are small: this brings their rows to a length of about one.
SCALE = 5.0


def fold(doc_id: Column, folds: int = 4, held: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == held


def learn(docs: DataFrame) -> Model:
    """Document frequencies over all training rows, the classifier over the
    bounded sample of them; of rows that repeat an id, the least of language and
    text is in it. Rows of the held-out fold, of null text or of null lang teach
    nothing; without any, every text is ``und``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(~fold(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = document_counts(b.column(0).to_pylist() for b in slices(batches, SLICE))
        tidy()
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*own.tolist(), -1], pa.int32()), pa.array([*counts[own].tolist(), total], pa.int64())], ["bucket", "n"])

    # at most 2 ** BITS + 1 rows, whatever the input
    found = rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << BITS)
    total = 0
    for r in found:
        if r.bucket < 0:
            total = r.n
        else:
            counts[r.bucket] = r.n
    idf = np.log((1 + total) / (1 + counts)) + 1

    # a share of each language's hashes first, so that no task orders them all
    named = staged(rows.select("doc_id", "lang"), "languages")
    sizes = staged(named.groupBy("lang").agg(F.count("*").alias("of")), "language-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes
    some = named.join(sizes, "lang").filter(below("doc_id", F.lit(SPARE * PER_LANGUAGE) / F.col("of")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(drawn("doc_id"), "doc_id"))
    picked = some.select("doc_id", "lang").withColumn("place", place).filter(F.col("place") <= PER_LANGUAGE)
    picked = staged(picked.orderBy("place", "lang", "doc_id").limit(SAMPLE).select("doc_id").distinct(), "picked")
    # of rows that repeat an id, the least: at most SAMPLE
    sample = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("of")).select("doc_id", "of.*").collect()
    sample = sorted(sample, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id or 0, r.lang, r.text))
    model = train([r.text for r in sample], [r.lang for r in sample], idf)
    del sample, found
    tidy()  # the driver held the n-grams of the sample
    return model


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if None) within the struct
    ``doc``, with lang_pred and score, for every row. Null text counts as
    empty: ``und``, 0. A text is judged alone and whole, so copies are judged
    alike; of equally likely languages the first by name is taken; an empty
    table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches, SLICE):
            langs, scores = own.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc", "lang_pred", "score"])
        tidy()

    doc = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc")
    schema = docs.select(doc).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(doc, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


#: A text is kept if its language is known and at least so probable.
LEAST = 0.5


def kept(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, as they are, whose language is identified."""
    held, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches, SLICE):
            langs, scores = own.predict([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))
        tidy()

    return docs.mapInArrow(run, schema)
