"""Lexical and vector queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, stem_steps_sql, stemmed
from ..operators import lexical as L
from ..operators import vectors as V
from ..tables import table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("collection"))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("collection"))


def first_vector(spark, sf_dir) -> list[float]:
    return vectors(spark, sf_dir).orderBy("id").limit(1).collect()[0].embedding


def terms_sql(source: str, key: str, text: str) -> str:
    """A subquery of (key, term, tf)."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    steps = stem_steps_sql("w")
    return f"""(SELECT {key}, w AS term, sum(tf)::BIGINT AS tf FROM (
      SELECT {key}, {steps[2]} AS w, tf FROM (SELECT {key}, {steps[1]} AS w, tf FROM (SELECT {key}, {steps[0]} AS w, tf FROM (
        SELECT {key}, w, count(*) AS tf FROM (SELECT {key}, unnest(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM {source})
        WHERE length(w) >= 2 AND w NOT IN ({stop}) GROUP BY ALL)))) WHERE w <> '' GROUP BY ALL)"""


INDEX = f"""
WITH postings AS {terms_sql("documents", "doc_id", "text")},
lengths AS (SELECT d.doc_id, d.lang AS collection, coalesce(t.n, 0) AS token_count FROM documents d LEFT JOIN (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY 1) t USING (doc_id)),
total AS (SELECT count(*) AS n, avg(token_count) AS avgdl FROM lengths),
counted AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM postings, total GROUP BY term)
"""


def search_sql(only: str = "TRUE", least: float = 0.0, k: int = 10) -> str:
    return f"""{INDEX}, asked AS {terms_sql("benchmark", "item_id", "text")},
    scored AS (SELECT a.item_id AS query_id, p.doc_id, round(sum(c.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (l.token_count / t.avgdl)))), 6) AS score,
        array_to_string(list_sort(list(DISTINCT p.term)), ' ') AS matched_terms
      FROM asked a JOIN postings p USING (term) JOIN counted c USING (term) JOIN lengths l USING (doc_id), total t WHERE {only} GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score >= {least})
    SELECT query_id, rank, doc_id, score, matched_terms FROM ranked WHERE rank <= {k}"""


def lexical_ranks(spark, sf_dir):
    """The ranking of documents for the first benchmark text."""
    first = asked(spark, sf_dir).orderBy("query_id").limit(1)
    return L.search(L.build(docs(spark, sf_dir)), first, k=50).select("doc_id", "rank")


def vector_ranks(spark, sf_dir):
    near = V.search(vectors(spark, sf_dir), first_vector(spark, sf_dir), k=50)
    from pyspark.sql import Window

    return near.select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def similarity(spark, sf_dir):
    query = F.array(*[F.lit(float(x)) for x in first_vector(spark, sf_dir)])
    rows = vectors(spark, sf_dir).select(F.col("id"), F.round(V.cosine(F.col("embedding"), query), 6).alias("similarity"), F.round(V.distance(F.col("embedding"), query), 6).alias("distance"), F.round(-V.dot(F.col("embedding"), query), 6).alias("negative_product"))
    return rows.withColumn("interpretation", V.interpreted(F.col("similarity")))


QUERIES = {
    "bm25_postings": lambda s, d: L.build(docs(s, d)).postings,
    "bm25_idf": lambda s, d: L.document_frequencies(L.build(docs(s, d))),
    "corpus_stats": lambda s, d: L.statistics(L.build(docs(s, d))),
    "corpus_collections": lambda s, d: L.collection_counts(L.build(docs(s, d))),
    "bm25_search": lambda s, d: L.search(L.build(docs(s, d)), asked(s, d)),
    "bm25_collection_search": lambda s, d: L.search(L.build(docs(s, d)), asked(s, d), k=5, collection="en", min_score=5.0),
    "bm25_removed": lambda s, d: L.statistics(L.remove(L.build(docs(s, d)), docs(s, d).filter("collection = 'de'").select("doc_id"))),
    "tokens_stemmed": lambda s, d: stemmed(docs(s, d).select(F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("content"), "[^a-z]+", " "), " "))).alias("word")).distinct().filter("word <> ''").withColumn("stem", F.col("word")), "stem"),
    "vector_topk": lambda s, d: V.search(vectors(s, d), first_vector(s, d)).select("id", "score"),
    "vector_filtered_topk": lambda s, d: V.search(vectors(s, d), first_vector(s, d), k=20, collection=3).select("id", "score"),
    "vector_min_score": lambda s, d: V.search(vectors(s, d), first_vector(s, d), k=50, min_score=0.2).select("id", "score"),
    "vector_similarity": similarity,
    "collection_stats": lambda s, d: V.collections(vectors(s, d)),
    "hybrid_rrf": lambda s, d: L.fused(vector_ranks(s, d), lexical_ranks(s, d)),
}

COSINE = """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
near AS (SELECT vec_id AS id, label, list_inner_product(embedding::DOUBLE[], v) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(v, v))) AS exact, embedding::DOUBLE[] AS e, v FROM embeddings, q)
"""
TOP = COSINE + "SELECT id, round(exact, 6) AS score FROM (SELECT * FROM near {where} ORDER BY exact DESC, id LIMIT {k}) {least}"

SQL = {
    "bm25_postings": INDEX + "SELECT term, doc_id, tf FROM postings",
    "bm25_idf": INDEX + "SELECT term, df, round(idf, 6) AS idf FROM counted",
    "corpus_stats": INDEX + "SELECT count(*) AS num_documents, round(avg(token_count), 2) AS avg_doc_length, sum(token_count)::BIGINT AS total_tokens, (SELECT count(DISTINCT term) FROM postings) AS num_terms FROM lengths",
    "corpus_collections": INDEX + "SELECT collection, count(*) AS documents, sum(token_count)::BIGINT AS tokens FROM lengths GROUP BY 1",
    "bm25_search": search_sql(),
    "bm25_collection_search": search_sql("l.collection = 'en'", 5.0, 5),
    "bm25_removed": INDEX + "SELECT count(*) AS num_documents, round(avg(token_count), 2) AS avg_doc_length, sum(token_count)::BIGINT AS total_tokens, (SELECT count(DISTINCT term) FROM postings JOIN lengths USING (doc_id) WHERE collection <> 'de') AS num_terms FROM lengths WHERE collection <> 'de'",
    "tokens_stemmed": (lambda a, b, c: f"SELECT word, {c} AS stem FROM (SELECT word, {b} AS w FROM (SELECT word, {a} AS w FROM (SELECT word, word AS w FROM (SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS word FROM documents) WHERE word <> '')))")(*stem_steps_sql("w")),
    "vector_topk": TOP.format(where="", k=10, least=""),
    "vector_filtered_topk": TOP.format(where="WHERE label = 3", k=20, least=""),
    "vector_min_score": TOP.format(where="", k=50, least="WHERE round(exact, 6) >= 0.2"),
    "vector_similarity": COSINE + """SELECT id, round(exact, 6) AS similarity, round(list_distance(e, v), 6) AS distance, round(-list_inner_product(e, v), 6) AS negative_product,
        CASE WHEN round(exact, 6) >= 0.9 THEN 'very similar' WHEN round(exact, 6) >= 0.75 THEN 'similar' WHEN round(exact, 6) >= 0.5 THEN 'somewhat similar' WHEN round(exact, 6) >= 0.25 THEN 'slightly similar' ELSE 'not similar' END AS interpretation FROM near""",
    "collection_stats": "SELECT label AS collection, count(*) AS document_count FROM embeddings GROUP BY label",
    "hybrid_rrf": f"""WITH lex AS (SELECT doc_id, rank FROM ({search_sql(k=50)}) WHERE query_id = (SELECT min(item_id) FROM benchmark)),
      vec AS (SELECT id AS doc_id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({TOP.format(where="", k=50, least="")}))
      SELECT doc_id, coalesce(vec.rank, 0) AS rank_a, coalesce(lex.rank, 0) AS rank_b, round(coalesce(1.0::DOUBLE / (60 + vec.rank), 0) + coalesce(1.0::DOUBLE / (60 + lex.rank), 0), 9) AS rrf FROM vec FULL JOIN lex USING (doc_id)""",
}
