"""A corpus pipeline: five stages over ``documents``, each of which works on
all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bits, jaccard, langid, mixing, packing, secrets
from lodestone.llm.scratch import staged
from lodestone.llm.words import text_batches

#: SQL has no language model, chain or tokenizer; tests compare with brute force.
ORACLE_SQL: str | None = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is not identified go: no letter, or no language
    that is at least half probable. Null texts go; repeated rows are judged
    alike; other columns stay as they are."""
    text_batches(spark)
    return langid.kept(docs, langid.learn(docs))


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar shingle sets the row with the smallest
    doc_id stays; texts without a word are similar to nothing. Rows that repeat
    a doc_id are in one component, and one of them stays, the one of the least
    text. Rows without a doc_id stay."""
    found = staged(jaccard.components(docs).filter("n_shingles > 0 AND doc_id != component_id").select("doc_id").distinct(), "others")
    again = staged(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeats")
    # most rows are neither and stay without a shuffle
    some, rest = bits.apart(docs, "doc_id", found.select(F.col("doc_id").alias("id")).unionByName(again.select(F.col("doc_id").alias("id"))))
    some = some.join(found, "doc_id", "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    twice = some.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct("text")).alias("one")).select("one.*")
    some = some.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(twice.select(*docs.columns))
    return rest.unionByName(some)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, null texts and repeated rows
    too. Very long texts are masked whole; other columns stay as they are."""
    return secrets.redact(docs, secrets.learn(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a document comes once for each epoch, the
    last time cut where its source's budget ends. Null and empty texts have no
    words to take."""
    return mixing.drawn(mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset, one at least for each row.
    An empty table gives no rows, here as in every stage."""
    import public_tokenizers

    # workers have held the tables of the stages before
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), remember=50_000))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near-duplicates", one_of_similar),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("pack", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
