"""Vector tables: similarity, filtered search, collections, rows by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in the order of the coordinates, of equal lengths."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(F.try_divide(dot(a, b), scale))


def distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def interpreted(similarity: Column) -> Column:
    # Bands of similarity.
    bands = [(0.9, "very similar"), (0.75, "similar"), (0.5, "somewhat similar"), (0.25, "slightly similar")]
    out = F.lit("not similar")
    for least, name in reversed(bands):
        out = F.when(similarity >= least, name).otherwise(out)
    return out


def to_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def from_literal(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<float>"), F.array().cast("array<float>"))


def search(rows: DataFrame, query: list[float], k: int = 10, collection=None, source: str | None = None, min_score: float | None = None) -> DataFrame:
    """The k rows nearest to ``query`` by cosine among those of a collection
    and source, then those of at least ``min_score``, so that fewer can come.

    rows(id, embedding, ...). The query is a literal, so the scan computes the
    scores and keeps k rows a task; ids break ties.
    """
    if not 1 <= k <= 100:
        raise ValueError("k is 1 to 100")
    if min_score is not None and not 0 <= min_score <= 1:
        raise ValueError("min_score is 0 to 1")
    if collection not in (None, ""):  # an empty name is no condition
        rows = rows.filter(F.col("collection") == collection)
    if source:
        rows = rows.filter(F.col("source") == source)
    target = F.array(*[F.lit(float(x)) for x in query])
    same = F.size("embedding") == len(query)
    near = rows.filter(same).withColumn("score", cosine(F.col("embedding"), target)).orderBy(F.desc("score"), "id").limit(k)
    near = near.withColumn("score", F.round("score", 6))
    return near if min_score is None else near.filter(F.col("score") >= min_score)


def created(rows: DataFrame, column: str = "created_at") -> DataFrame:
    """``rows`` with the time of writing where none is given."""
    now = F.current_timestamp()
    return rows.withColumn(column, F.coalesce(F.col(column), now) if column in rows.columns else now)


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; of a key that both have, the second's value."""
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.map_concat(kept, second)


def collections(rows: DataFrame, created: str | None = None) -> DataFrame:
    """Documents, and first and last creation, of each collection."""
    more = [F.min(created).alias("first_created"), F.max(created).alias("last_created")] if created else []
    return rows.groupBy("collection").agg(F.count("*").alias("document_count"), *more).orderBy(F.desc("document_count"), "collection")
