import hashlib
import random
import re
import zipfile

import duckdb
import numpy as np
import pytest
from lodestone.functions import embedding, text, tokens
from lodestone.operators import chunking, lexical, profile, prompts, resume, scoring, storage, usage, vectors
from lodestone.plans import registry
from lodestone.sources import generator, readers
from pyspark.sql import functions as F


def column(spark, values, expr, type_="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r.x for r in frame.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


# chunks


def joined_chunks(parts, size, overlap):
    """The packing rule, said once more with lengths kept along."""
    out, held, length = [], [], 0
    for p in parts:
        if held and length + len(p) + 1 > size:
            out.append(" ".join(held))
            tail, length = [], 0
            for q in reversed(held):
                if length + len(q) + 1 > overlap:
                    break
                tail, length = [q, *tail], length + len(q) + 1
            held = tail
        held, length = [*held, p], length + len(p) + 1
    return out + ([" ".join(held)] if held else [])


def test_gathered_pieces():
    rng = random.Random(0)
    for _ in range(300):
        parts = ["x" * rng.randint(1, 30) for _ in range(rng.randint(0, 25))]
        size = rng.randint(5, 60)
        overlap = rng.randint(0, size - 1)
        assert list(chunking.gathered(parts, size, overlap)) == joined_chunks(parts, size, overlap)


def test_fixed_windows(spark):
    docs = spark.createDataFrame([(1, "a" * 512), (2, " \n"), (3, None), (4, "　" + "é" * 200 + "\n")], "doc_id long, text string")
    got = {(r.doc_id, r["index"]): r for r in chunking.chunked(docs).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (4, 0)]
    assert (got[1, 1].start_char, got[1, 1].char_count) == (462, 50)
    small = chunking.chunked(docs.filter("doc_id = 4"), "fixed", 100, 20).orderBy("index").collect()
    assert [r.start_char for r in small] == [0, 80, 160] and small[0].text == "é" * 100


def test_strategies(spark):
    text_ = "One is here. Two follows! Three? " + "Long " * 40 + "\n\nLast part."
    docs = spark.createDataFrame([(1, text_)], "doc_id long, text string")
    for strategy in ("sentence", "recursive", "token"):
        rows = chunking.chunked(docs, strategy, 60, 20).orderBy("index").collect()
        assert [r["index"] for r in rows] == list(range(len(rows)))
        assert all(r.end_char - r.start_char == len(r.text) == r.char_count for r in rows)
    assert chunking.sentence("A b. C d. E f.", 10, 0) == [("A b. C d.", 0), ("E f.", 10)]
    assert chunking.pieces("aa. bb", 3, 1) == ["aa", "bb"]
    assert chunking.pieces("x" * 7, 3, 1) == ["xxx", "xxx", "xxx", "x"]
    with pytest.raises(ValueError):
        chunking.chunked(docs, "fixed", 10, 10)
    with pytest.raises(ValueError):
        chunking.chunked(docs, "paragraph")


# words


def python_stem(w):
    if len(w) <= 2:
        return w
    for s, t in text.PLURALS:
        if w.endswith(s):
            w = w[: len(w) - len(s)] + t
            break
    for s, t in text.TENSES:
        if w.endswith(s):
            new = w[: len(w) - len(s)] + t
            w = new if re.search("[aeiou]", new) and len(new) >= 2 else w
            break
    if len(w) > 5:
        for s, t in text.ENDINGS:
            if w.endswith(s) and len(w) - len(s) + len(t) >= 3:
                return w[: len(w) - len(s)] + t
    return w


def test_stems(spark):
    rng = random.Random(1)
    ends = [s for s, _ in text.PLURALS + text.TENSES + text.ENDINGS]
    words = ["retrieve", "retrieval", "generation", "sing", "need", "as", "s", "ss", "aments", "xyness"] + ["".join(rng.choices("aebstr", k=rng.randint(0, 5))) + rng.choice(ends) + rng.choice(["", "s", "ed"]) for _ in range(2000)]
    assert column(spark, words, text.stem) == [python_stem(w) for w in words]


def test_words(spark):
    got = column(spark, ["The State-of-the-Art, naïve x1 a B2!", None, ""], text.words)
    assert got == [["state", "art", "na", "ve", "x1", "b2"], None, []]


def test_characters(spark):
    given = ["a–b — “q” ’ x y", "é ​z﻿ ", "· â", None]
    assert column(spark, given, text.normalised) == ["a-b - \"q\" ' x y", "é z ", "•• ", None]
    assert column(spark, ["fooBar,baz|q\n  \n  x\ty", "a•b"], text.spaced) == ["foo Bar, baz| q\nx y", "a• b"]
    marked = "# Title\n**bold** and _it_ [link](http://x)\n---\n- item\n<b>t</b>"
    assert column(spark, [marked], text.without_markdown) == ["Title\nbold and it link\n\n• item\nt"]
    assert column(spark, ["abc", "abcd"], lambda c: text.preview(c, 3)) == ["abc", "abc..."]


# search


def index(spark):
    docs = spark.createDataFrame([(1, "cats and dogs", "a"), (2, "cat cat cat", "a"), (3, "birds", "b"), (4, "the", "b")], "doc_id long, content string, collection string")
    return lexical.build(docs)


def test_search_rules(spark, tmp_path):
    made = index(spark)
    queries = spark.createDataFrame([(1, "cat cat"), (2, ""), (3, "the of"), (4, "unknown"), (5, "bird dogs")], "query_id long, text string")
    got = [(r.query_id, r["rank"], r.doc_id, r.matched_terms) for r in lexical.search(made, queries).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, "cat"), (1, 2, 1, "cat"), (5, 1, 3, "bird"), (5, 2, 1, "dog")]
    in_a = lexical.search(made, queries, collection="a").collect()
    every = {(r.query_id, r.doc_id): r.score for r in lexical.search(made, queries).collect()}
    assert {(r.query_id, r.doc_id): r.score for r in in_a} == {k: v for k, v in every.items() if k[1] < 3}
    least = every[1, 1]
    assert (1, 1) in {(r.query_id, r.doc_id) for r in lexical.search(made, queries, min_score=least).collect()}
    made.save(str(tmp_path))
    again = lexical.Index.load(spark, str(tmp_path))
    assert lexical.statistics(again).first() == lexical.statistics(made).first()
    assert lexical.statistics(made).first().num_documents == 4
    fewer = lexical.remove(made, spark.createDataFrame([(2,)], "doc_id long"))
    assert lexical.statistics(fewer).first().num_documents == 3
    more = lexical.add(fewer, spark.createDataFrame([(9, "zebra", "c")], "doc_id long, content string, collection string"))
    assert lexical.statistics(more).first().num_documents == 4


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 2.0], "b"), (4, [0.0, 0.0], "b")], "id long, embedding array<float>, collection string")
    assert [(r.id, r.score) for r in vectors.search(rows, [2.0, 0.0], k=10).collect()] == [(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0)]
    assert [r.id for r in vectors.search(rows, [2.0, 0.0], k=3, collection="b").collect()] == [3, 4]
    assert [r.id for r in vectors.search(rows, [2.0, 0.0], k=3, min_score=0.5).collect()] == [1, 2]
    with pytest.raises(ValueError):
        vectors.search(rows, [1.0, 0.0], k=0)
    assert column(spark, ["[1.5,2.0]", None], vectors.from_literal) == [[1.5, 2.0], []]
    assert column(spark, [[1.5, 2.0]], vectors.to_literal, "array<float>") == ["[1.5,2.0]"]


# profiles


def test_numbers(spark):
    cells = [" 1,200 ", "1_000", "12d", "nan", "", None, "-1.5e3", ".5", "5.", "1__0", "+7", "abc"]
    got = column(spark, cells, profile.number)
    assert [None if x is None else "nan" if x != x else x for x in got] == [1200.0, 1000.0, None, "nan", None, None, -1500.0, 0.5, 5.0, None, 7.0, None]


def test_profiles(spark):
    rows = [(str(i) if i < 8 else "x", "5", "" if i % 2 else None, "b" if i % 3 else "a", i) for i in range(10)]
    frame = spark.createDataFrame(rows, "n string, same string, none string, word string, i int").drop("i")
    types = {r.column: r.inferred_type for r in profile.inferred_types(frame).collect()}
    assert types == {"n": "numeric", "same": "numeric", "none": "categorical", "word": "categorical"}
    stats = {r.column: r for r in profile.numeric(frame).collect()}
    assert (stats["n"]["count"], stats["n"].median, stats["same"].std_dev) == (10, 3.5, 0.0)
    corr = {(r.col_a, r.col_b): r["corr"] for r in profile.correlations(frame).collect()}
    assert corr == {("n", "n"): 1.0, ("n", "same"): 0.0, ("same", "n"): 0.0, ("same", "same"): 0.0}
    assert {r.column: r.missing_pct for r in profile.missing(frame).collect()}["none"] == 100.0
    ties = spark.createDataFrame([("z", 1), ("y", 2), ("y", 3), ("z", 4), ("w", 5)], "v string, row int")
    assert [tuple(r) for r in profile.categorical(ties, "v", "row", 2).collect()] == [("z", 2), ("y", 2)]


# usage


def test_usage_log(spark):
    rows = [(i, "m", 10, 5, 100.0 * i, 0.5, "error" if i == 6 else "end", "x" if i == 6 else None) for i in range(1, 7)]
    log = spark.createDataFrame(rows, "request_id long, model string, input_tokens long, output_tokens long, latency_ms double, total_cost double, stop_reason string, error string")
    got = usage.summary(log, 3).first()
    assert (got.total_requests, got.total_errors, got.total_tokens, got.total_cost_usd, got.avg_latency_ms) == (5, 1, 75, 2.5, 400.0)
    assert [r.request_id for r in usage.recent(log, 2, 3).collect()] == [5, 6]
    assert [r.request_id for r in usage.recent(log, 0, 3).collect()] == [3, 4, 5, 6]
    empty = usage.summary(log.limit(0)).first()
    assert (empty.total_requests, empty.avg_latency_ms) == (0, 0.0)
    assert usage.delays(4, 1.0, 5.0) == [1.0, 2.0, 4.0, 5.0]


def test_tokens(spark):
    assert column(spark, [None, "", "abc", "abcdefgh"], tokens.estimate) == [0, 0, 1, 2]
    calls = spark.createDataFrame([("gpt-4o", 1_000_000, 0), ("none", 5, 5)], "model string, input_tokens long, output_tokens long")
    got = {r.model: r for r in tokens.priced(calls).collect()}
    assert got["gpt-4o"].total_cost == 5.0 and got["none"].total_cost == 0.0 and "none" in got["none"].note
    assert column(spark, ["a\nb " * 30], lambda c: usage.mock_reply(c, None, 16)) == ["Mock response to: a"]


# scores


def test_scores(spark):
    strong = "Python, SQL, Docker. 5+ years. Built and led teams. Master of computer science."
    job = "Python, SQL, Docker. Built. Master of computer science. Led."
    rows = spark.createDataFrame([(1, strong, job), (2, "nothing here at all", job), (3, "c++ guru", "c++ needed"), (4, strong, "any person")], "id long, resume string, job string")
    got = {r.id: r for r in scoring.scored(rows).collect()}
    assert got[1].score == 100.0 and got[1].recommendation == "strong match" and got[1].missing_skills == []
    assert got[2].score == 0.0 and got[2].matched_skills == []
    assert got[3].matched_skills == [] and got[3].score == got[4].score == 58.0
    with pytest.raises(ValueError):
        scoring.page(rows, limit=0)


# prompts


def test_prompts(spark):
    rows = spark.createDataFrame([("C", "Q", ["x", "y"], None), (None, "Q", [], "old")], "context string, question string, labels array<string>, note string")
    made = prompts.rendered(rows, "rag_qa", {"context": "context", "question": "question"}).collect()
    assert made[0].prompt == "Context:\nC\n\nQuestion: Q\n\nAnswer based only on the context above:" and made[1].prompt.startswith("Context:\n\n\n")
    assert "in 3 sentences" in prompts.rendered(rows, "summarize", {"document": "context"}).first().prompt
    rewrite = [r.prompt for r in prompts.rendered(rows, "query_rewrite", {"query": "question", "context": "note"}).collect()]
    assert rewrite[0].startswith("Original query: Q\n\n\nRewrite") and "Conversation context: old\n\nRewrite" in rewrite[1]
    one = F.array(F.struct(F.lit("t").alias("text"), F.lit("x").alias("label")))
    assert "x, y\n\nExamples:\nText: t\nLabel: x\n\nText to classify:\nC" in prompts.rendered(rows, "classify", {"text": "context", "labels": "labels", "examples": one}).first().prompt
    own = F.array(F.struct(F.lit("c").alias("context"), F.lit("q").alias("question"), F.lit("a").alias("answer")))
    assert prompts.rendered(rows, "rag_qa_few_shot", {"context": "context", "question": "question", "examples": own}).first().prompt.startswith("Here are examples of good answers:\n\nContext: c\nQuestion: q\nAnswer: a\n\n---\n")
    with pytest.raises(ValueError, match="context"):
        prompts.rendered(rows, "rag_qa", {"question": "question"})
    with pytest.raises(ValueError):
        prompts.template("none")
    with pytest.raises(ValueError, match="step 1"):
        prompts.chained(rows.drop("question"), "rag_with_rewrite")
    assert len(prompts.TEMPLATES) == 10 and prompts.registry(spark, technique="hyde").count() == 1


# embeddings


def test_stand_in_vectors(spark):
    def slow(t, n):
        seed, out = int(hashlib.sha256(t.encode()).hexdigest(), 16), []
        for _ in range(n):
            seed = (seed * embedding.FACTOR + embedding.STEP) % 2**64
            out.append(seed / 2**64 * 2 - 1)
        return np.array(out) / np.linalg.norm(out)

    rows = spark.createDataFrame([(1, "hello  world"), (2, " hello  world\n"), (3, " "), (4, None)], "id long, text string")
    got = {r.id: r for r in embedding.embedded(rows, "text", lambda: embedding.stand_in(24)).collect()}
    assert np.allclose(got[1].embedding, slow("hello  world", 24), atol=1e-15) and got[1].embedding == got[2].embedding
    assert got[1].token_count == 2 and got[3].embedding is None and got[4].embedding is None
    assert embedding.fifo(["a", "b", "a", "c", "a"], 2) == (1, 4, ["c", "a"])


# résumés


def test_resume(spark):
    body = "Ann Example\nann@example.org | (555) 123-4567 | Springfield, IL\n\nSkills:\nPython, scikit-learn | R\nPython\n\nEXPERIENCE\nEngineer at Acme\nBuilt it\nJan 2020 - Feb 2021\n• ran it\n\nEducation\nBachelor of Arts\nState College\n2015"
    got = resume.parsed(spark.createDataFrame([(1, body), (2, ""), (3, None)], "id long, text string"), "id").orderBy("id").collect()
    r = got[0]
    assert (r.name, r.email, r.phone) == ("Ann Example", "ann@example.org", "(555) 123-4567") and r.location.endswith("Springfield, IL")
    assert r.skills == ["Python", "scikit", "learn"]
    assert [(j.dates, j.title, j.company, j.bullets) for j in r.experience] == [("", "Engineer", "Acme", ["Built it"]), ("Jan 2020 - Feb 2021", "", "", ["ran it"])]
    assert [(e.degree, e.institution, e.year) for e in r.education] == [("Bachelor of Arts", "State College", "2015")]
    assert got[1].name == got[2].name == "" and got[1].skills == []
    inline = resume.education_inline(["• Some Institute, Town  July 2019 - June 2023", "• B.Tech in Machines", "", "UC Berkeley", "2020"])
    assert [(e["degree"], e["institution"], e["year"]) for e in inline] == [("B.Tech in Machines", "Some Institute, Town", "2019"), ("UC Berkeley", "", "2020")]


# files and tables


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿café – x".encode())
    (tmp_path / "b.TXT").write_bytes("café".encode("latin-1"))
    (tmp_path / "c.md").write_text("# Head\n- point")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    got = {readers.stem_of(r.path): r.text for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got == {"a": "café - x", "b": "café", "c": "Head\n• point", "d": "one two\nthree"}
    assert readers.grouped_lines([("a", 1.0), ("b", 3.0), ("c", 9.0)]) == ["a b", "c"]
    (tmp_path / "e.xls").write_text("x")
    with pytest.raises(ValueError, match="xls"):
        readers.documents(spark, str(tmp_path))


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('name,n\n"a ""q"" b\nc",1\ncafé,\n'.encode("latin-1"))
    rows = readers.csv(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in rows.collect()] == [('a "q" b\nc', "1"), ("café", None)]
    with pytest.raises(ValueError):
        readers.csv(spark, str(tmp_path / "x.txt"))


def test_company(spark):
    made = generator.company(spark, 60, 3)
    people, reviews = made["employees"].collect(), made["reviews"].collect()
    assert len({p.email for p in people}) == 60 and all(p.manager_id != p.id and 1 <= p.manager_id <= 60 for p in people)
    assert 60 <= len(reviews) <= 180 and all(2.5 <= r.score <= 5 for r in reviews) and len({r.id for r in reviews}) == len(reviews)
    assert generator.company(spark, 60, 3)["employees"].collect() == people


def test_storage(spark):
    rows = spark.createDataFrame([(3, "a"), (7, None)], "id long, name string")
    added = storage.inserted(rows, spark.createDataFrame([("z",), ("y",)], "name string"), "name")
    assert sorted(map(tuple, added.collect()), key=lambda r: r[0]) == [(3, "a"), (7, None), (8, "y"), (9, "z")]
    left, gone = storage.deleted(rows, F.col("name") == "a")
    assert [r.id for r in left.collect()] == [7] and gone.first().deleted == 1
    assert storage.by_id(rows, 3).count() == 1 and storage.by_id(rows, 4).count() == 0


def test_stream_of_the_log_has_the_totals_of_the_table(spark, sf_dir):
    from lodestone.plans import texts

    want, got = ({r.model: r.asDict() for r in texts.QUERIES[q](spark, sf_dir).collect()} for q in ("usage_by_model", "stream_usage_by_model"))
    assert want.keys() == got.keys() and sum(r["input_tokens"] for r in got.values()) > 0
    for model, row in want.items():
        assert got[model] == {**row, "total_cost": pytest.approx(row["total_cost"], abs=2e-6)}


def test_contact_beside_letters_beyond_ascii(spark, tmp_path):
    """The whole query against its SQL, where places adjoin letters beyond ASCII."""
    texts = ["QUEASARJARR MENTE, CIÓNMIÍRR", "ÑSpringfield, ILé", "ñ Lyon, FR", "xLyon, FR Rome, ITa Rome, IT9 Rome, IT_", "9Bern, CH Bern, CH", "Ann Éa\nAnn, B\nÖRome, IT", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.queries()["resume_contact"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(duck.execute(registry.oracle_sql()["resume_contact"]).fetchall())
    assert [r[4] for r in got][:2] == ["QUEASARJARR MENTE, CI", "Springfield, IL"]
