"""Inverted index and ranked search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exploded_words, stems

K1, B = 1.5, 0.75


@dataclass
class Index:
    """postings(term, doc_id, tf) and docs(doc_id, token_count, collection)."""

    postings: DataFrame
    docs: DataFrame

    def save(self, path: str) -> None:
        """Postings are laid out by term, so that a search reads few row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")

    @staticmethod
    def load(spark, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"))


def frequencies(docs: DataFrame, key: str, text: str, stop: bool = True, stem: bool = True) -> DataFrame:
    """(key, term, tf). Words are counted per document first; each distinct one
    is stemmed once and its stem joined back."""
    rows = exploded_words(docs, key, text, stop)
    counted = rows.groupBy(key, "term").agg(F.count("*").alias("tf"))
    if not stem:
        return counted
    stemmed = counted.join(stems(rows), "term")
    return stemmed.groupBy(key, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def build(docs: DataFrame, stop: bool = True, stem: bool = True) -> Index:
    """Index of docs(doc_id, content, collection); documents without a token
    are still counted."""
    postings = frequencies(docs, "doc_id", "content", stop, stem)
    counted = exploded_words(docs, "doc_id", "content", stop).groupBy("doc_id").agg(F.count("*").alias("token_count"))
    lengths = docs.select("doc_id", "collection").join(counted, "doc_id", "left")
    return Index(postings.select("term", "doc_id", "tf"), lengths.select("doc_id", F.coalesce("token_count", F.lit(0)).alias("token_count"), "collection"))


def add(index: Index, docs: DataFrame, **how) -> Index:
    more = build(docs, **how)
    return Index(index.postings.unionByName(more.postings), index.docs.unionByName(more.docs))


def remove(index: Index, ids: DataFrame) -> Index:
    """Without the documents of ids(doc_id); ids are not used again."""
    return Index(index.postings.join(ids, "doc_id", "left_anti"), index.docs.join(ids, "doc_id", "left_anti"))


def idf(n_docs: Column, n_with: Column) -> Column:
    return F.when((n_docs == 0) | (n_with == 0), 0.0).otherwise(F.log((n_docs - n_with + 0.5) / (n_with + 0.5) + 1))


def statistics(index: Index) -> DataFrame:
    terms = index.postings.agg(F.count_distinct("term").alias("num_terms"))
    docs = index.docs.agg(F.count("*").alias("num_documents"), F.coalesce(F.round(F.avg("token_count"), 2), F.lit(0.0)).alias("avg_doc_length"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"))
    return docs.crossJoin(F.broadcast(terms))  # one row each


def collection_counts(index: Index) -> DataFrame:
    """Documents and tokens of each collection."""
    return index.docs.groupBy("collection").agg(F.count("*").alias("documents"), F.sum("token_count").alias("tokens"))


def document_frequencies(index: Index) -> DataFrame:
    """(term, df, idf) of all terms."""
    total = index.docs.agg(F.count("*").alias("n"))
    counted = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    return counted.crossJoin(F.broadcast(total)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))


def search(index: Index, queries: DataFrame, k: int = 10, collection: str | None = None, min_score: float = 0.0, k1: float = K1, b: float = B, stop: bool = True, stem: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, score, matched_terms) for queries(query_id,
    text): the k best documents of each query with a score of at least
    ``min_score``. The postings of the queries' terms are read twice, for the
    documents of a term and for the scores, and therefore persisted.

    A query's repeated terms count once. The statistics stay those of the whole
    index when a collection limits the documents. Scores rank to 6 places and
    equal ones by doc_id.
    """
    terms = frequencies(queries, "query_id", "text", stop, stem).select("query_id", "term")
    wanted = terms.select("term").distinct()
    hits = index.postings.join(wanted, "term", "left_semi").persist()
    counted = hits.groupBy("term").agg(F.count("*").alias("df"))
    lengths = index.docs.persist()
    total = lengths.agg(F.count("*").alias("n"), F.avg("token_count").alias("avgdl"))  # one row
    docs = lengths.crossJoin(F.broadcast(total))
    if collection is not None:
        docs = docs.filter(F.col("collection") == collection)
    length = F.when(F.col("avgdl") > 0, F.col("token_count") / F.col("avgdl")).otherwise(0.0)
    scored = hits.join(docs, "doc_id").join(counted, "term")
    scored = scored.select("term", "doc_id", (idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))).alias("part"))
    grouped = scored.join(terms, "term").filter("part > 0").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("term")), " ").alias("matched_terms"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = grouped.filter(F.col("score") >= min_score).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score", "matched_terms")


def fused(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two (doc_id, rank) lists: the sum of
    1 / (k + rank) over the lists that a document is in; rank 0 where it is not."""
    a, b = first.select("doc_id", F.col("rank").alias("rank_a")), second.select("doc_id", F.col("rank").alias("rank_b"))
    share = [F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0)) for c in ("rank_a", "rank_b")]
    return a.join(b, "doc_id", "full").select("doc_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("rank_a", "rank_b")], F.round(share[0] + share[1], 9).alias("rrf"))
