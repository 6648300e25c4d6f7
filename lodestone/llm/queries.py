"""Queries over the shared test tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard, langid, lm, mixing, packing, quality, secrets, substrings, toxicity
from .words import text_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(md5(s), '' ORDER BY md5(s))) AS print FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y
  WHERE 100 * c >= 75 * (sx.n + sy.n - c)),
either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
others AS (
  SELECT x AS doc_id, count(DISTINCT sy.print) AS m
  FROM either JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE sx.print != sy.print GROUP BY x),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, b.y FROM reach r JOIN either b ON b.x = r.other)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, coalesce(max(m), 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN others USING (doc_id) JOIN reach USING (doc_id)
GROUP BY d.doc_id
"""


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm.score(docs, lm.learn(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM vectors q JOIN vectors c ON c.vec_id != q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored)
WHERE rank <= 20
"""


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.learn(docs))
    base = F.filter("spans", lambda s: s["kind"] != "chain")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_table(spark, sf_dir, "documents")).drop("kept")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs), carry=("doc_id",))
    doc_id = F.col("doc.doc_id")
    return found.select(doc_id.alias("doc_id"), langid.fold(doc_id).alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER ()
               - coalesce(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM sources),
opened AS (
  SELECT first(level ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST) AS open_level
  FROM levels WHERE level * weight < 2 * source_size),
plan AS (
  SELECT source, source_size, least(coalesce((SELECT open_level FROM opened) * weight, 'inf'::DOUBLE),
                                    (2 * source_size)::DOUBLE) AS target
  FROM levels),
budgets AS (
  SELECT *, least(floor(target)::BIGINT, 2 * source_size) AS budget FROM plan),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole,
         budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size AS rest
  FROM budgets),
placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.whole, s.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM placed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_jaccard": op1_jaccard, "op2_lm": op2_lm, "op3_toxicity": op3_toxicity, "op4_ann": op4_ann, "op5_secrets": op5_secrets, "op6_substrings": op6_substrings, "op7_langid": op7_langid, "op8_quality": op8_quality, "op9_packing": op9_packing, "op10_mixing": op10_mixing}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard": OP1_SQL, "op4_ann": OP4_SQL, "op10_mixing": OP10_SQL}
