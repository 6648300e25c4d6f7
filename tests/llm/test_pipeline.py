import corpus_pipeline as pipeline
from lodestone.llm import bits, langid, scratch, secrets
from pyspark.sql import functions as F


def test_stages_keep_columns_and_decide(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        rows = docs.collect()
        if name == "language":
            assert len(rows) >= 0.98 * len(before)
        if name == "near-duplicates":
            assert len({r.text for r in rows}) == len(rows)
        if name == "secrets":
            assert not any(secrets.base_spans(r.text) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
    out = pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048


def test_one_of_similar(spark):
    same = " ".join(f"w{k}" for k in range(30))
    rows = [(5, same), (3, same), (4, same + " x"), (9, None), (8, ""), (7, "q r"), (7, "q r"), (6, "other words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.one_of_similar(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [3, 6, 7, 8, 9]
    assert pipeline.one_of_similar(spark, docs.limit(0), "").collect() == []


def test_stages_with_odd_rows(spark, sf_dir):
    """Empty tables, nulls in any column, repeated rows and ids, columns with
    names that the operators use."""
    long = " ".join(f"the word number {k} of a long text" for k in range(4000))
    rows = [(1, "the words of this text are in one language", "en", "a", 5), (1, "the words of this text are in one language", "en", "a", 5), (1, "but that one is another text of the same number", "en", None, 5), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "a text that has no number at all", "en", "a", 3), (4, long, "en", "b", 9)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id >= 10")
    odd = spark.createDataFrame(rows, docs.schema).unionByName(docs)
    names = ("slot", "part", "p", "spans", "size", "taken", "target", "kept", "score")
    for name, stage in pipeline.STAGES[:-1]:
        wide = odd.withColumns({n: F.lit("q") for n in names})
        got = stage(spark, wide, sf_dir)
        assert got.columns == wide.columns, name
        found = got.collect()
        assert found and all(r[n] == "q" for r in found for n in names), name
        if name == "near-duplicates":
            assert sum(r.doc_id == 1 for r in found) == 1 and any(r.doc_id is None for r in found)
        assert stage(spark, wide.limit(0), sf_dir).collect() == [], name
    assert pipeline.STAGES[-1][1](spark, odd.withColumn("length", F.lit("q")), sf_dir).filter("doc_id = 1").count() == 3
    assert pipeline.STAGES[-1][1](spark, odd.limit(0), sf_dir).collect() == []


def test_apart(spark):
    df, ids = spark.range(1000).withColumnRenamed("id", "k"), spark.range(0, 1000, 7)
    some, rest = bits.apart(df, "k", ids, 1 << 15)
    a, b = {r.k for r in some.collect()}, {r.k for r in rest.collect()}
    assert {r.id for r in ids.collect()} <= a and not a & b and len(a | b) == 1000 and len(a) < 200


def test_language_of_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.learn(docs)
    found = langid.identify(docs, model, carry=("doc_id", "lang"))
    held = found.filter(langid.fold(F.col("doc.doc_id"))).collect()
    assert sum(r.lang_pred == r.doc.lang for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in held)
    odd = spark.createDataFrame([(1, None, 2.0), (2, "", 1.0), (3, "12 !?", 1.0), (4, "ß", 0.0)], "doc_id long, text string, score double")
    got = {r.doc.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] != "und"
    assert [r.doc_id for r in langid.kept(odd, model, 0.0).collect()] == [4]
    none = langid.learn(odd.withColumn("lang", F.lit(None).cast("string")))
    assert langid.identify(odd, none).first().lang_pred == "und"


def test_lowest_is_the_same_with_and_without_a_share(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in rows.orderBy(scratch.drawn("doc_id"), "doc_id").limit(40).collect()]
    assert sorted(r.doc_id for r in scratch.lowest(rows, "doc_id", 40).collect()) == sorted(want)
    assert scratch.lowest(rows.limit(3), "doc_id", 40).count() == 3
