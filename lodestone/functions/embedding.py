"""Embeddings of texts, from a stand-in or any function, each text once.

The stand-in is a linear congruential generator modulo 2**64, seeded with the
SHA-256 of the text, whose values are scaled to [-1, 1] and to length one. The
k-th value is affine in the seed, so all values of a batch come at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import trimmed

# Fixed values of the generator.
FACTOR, STEP = 6364136223846793005, 1442695040888963407


def affine(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """a, c such that the k-th value from a seed is a[k] * seed + c[k]."""
    a, c, out = 1, 0, []
    for _ in range(dimensions):
        a, c = a * FACTOR % 2**64, (c * FACTOR + STEP) % 2**64
        out.append((a, c))
    return np.array([x for x, _ in out], np.uint64), np.array([x for _, x in out], np.uint64)


def stand_in(dimensions: int = 1536) -> Callable[[list[str]], np.ndarray]:
    a, c = affine(dimensions)

    def embed(texts: list[str]) -> np.ndarray:
        seeds = np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[-8:], "big") for t in texts], np.uint64)
        values = (seeds[:, None] * a + c) / 2.0**64 * 2 - 1
        return values / np.linalg.norm(values, axis=1, keepdims=True)

    return embed


def cache_key(text: Column, provider: str, model: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(provider), F.lit(model), text), 256)


def embedded(rows: DataFrame, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], provider: str = "mock", model: str = "mock-embed") -> DataFrame:
    """``rows`` with embedding (array of doubles), token_count and key. Equal
    texts are embedded once; blank ones get a null embedding."""
    keyed = rows.withColumn("__text", trimmed(F.col(text))).withColumn("key", cache_key(F.col("__text"), provider, model))
    once = keyed.filter(F.length("__text") > 0).groupBy("key").agg(F.first("__text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make()
        for batch in batches:
            if batch.num_rows:
                values = np.asarray(embed(batch.column(1).to_pylist()), float)
                edges = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(edges, pa.array(values.ravel()))], ["key", "embedding"])

    vectors = once.select("key", "text").mapInArrow(run, "key string, embedding array<double>")
    count = F.size(F.filter(F.split("__text", r"(?U)\s+"), lambda w: w != "")).cast("long")
    return keyed.join(vectors, "key", "left").withColumn("token_count", count).drop("__text")


def batch(rows: DataFrame, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], **how) -> DataFrame:
    """:func:`embedded` for a batch, which must not be empty."""
    if rows.isEmpty():
        raise ValueError("a batch holds one text at least")
    return embedded(rows, text, make, **how)


def batch_totals(found: DataFrame) -> DataFrame:
    """total_texts, total_tokens and cache_hits, texts that came before in the
    batch, of embedded rows."""
    return found.agg(F.count("*").alias("total_texts"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"), (F.count("*") - F.count_distinct("key")).alias("cache_hits"))


def similar(rows: DataFrame, first: str, second: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``rows`` with the similarity of two texts, to 6 places, and its band. All
    texts are embedded in one go, equal ones once."""
    from ..operators.vectors import cosine, interpreted

    keys = [cache_key(trimmed(F.col(c)), "mock", "mock-embed") for c in (first, second)]
    texts = rows.select(F.explode(F.array(first, second)).alias("__each"))
    vectors = embedded(texts, "__each", make).groupBy("key").agg(F.first("embedding").alias("embedding"))
    sides = rows.withColumn("__a", keys[0]).withColumn("__b", keys[1])
    sides = sides.join(vectors.toDF("__a", "__x"), "__a", "left").join(vectors.toDF("__b", "__y"), "__b", "left")
    found = sides.withColumn("similarity", F.round(cosine(F.col("__x"), F.col("__y")), 6))
    return found.withColumn("interpretation", interpreted(F.col("similarity"))).drop("__a", "__b", "__x", "__y")


def cache_use(requests: DataFrame, order: str, key: str) -> DataFrame:
    """size, hits, misses and hit_rate of a cache that never had to evict: the
    first request of a key misses, later ones hit."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    counted = requests.withColumn("__place", place).agg(F.count_if(F.col("__place") == 1).alias("size"), F.count_if(F.col("__place") > 1).alias("hits"), F.count_if(F.col("__place") == 1).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return counted.withColumn("hit_rate", F.when(total == 0, 0.0).otherwise(F.round(F.try_divide(F.col("hits"), total), 4)))


def evicted(requests: DataFrame, order: str, key: str, size: int) -> DataFrame:
    """What a first-in-first-out cache of ``size`` keys has dropped at the end,
    if each key is set once, at its first request: all but the last ones."""
    first = requests.groupBy(key).agg(F.min(order).alias("set_at"))
    last = first.orderBy(F.desc("set_at"), F.desc(key)).limit(size)  # tasks keep ``size`` rows each
    return first.join(F.broadcast(last.select(key)) if size <= 100_000 else last.select(key), key, "left_anti")


def fifo(keys: list[str], size: int) -> tuple[int, int, list[str]]:
    """(hits, misses, what is left) of a first-in-first-out cache. Order
    decides, so this is for one bounded list; a key that is set again evicts
    one as any other does."""
    held: dict[str, None] = {}
    hits = 0
    for k in keys:
        if k in held:
            hits += 1
            continue
        if len(held) >= size:
            held.pop(next(iter(held)))
        held[k] = None
    return hits, len(keys) - hits, list(held)
