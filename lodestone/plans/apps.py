"""Scoring, prompts, embeddings, parsing, storage and generator queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import embedding as E
from ..functions import text as X
from ..operators import prompts as P
from ..operators import resume as R
from ..operators import scoring as S
from ..operators import storage as W
from ..sources import generator as G
from ..tables import table

# Pairs of our own: all parts, no skills, no education, symbols at the end, a long text.
PAIRS = [
    (1, "Ann: Python and SQL developer, 6 years of experience. Built data pipelines on Spark. Master of Computer Science.", "We need Python, SQL and Spark; years of experience; built pipelines; master or bachelor in computer science."),
    (2, "Bo is a chef who managed a kitchen.", "A cook wanted, managed teams before."),
    (3, "Cy: Java, Docker, Kubernetes. 3+ years. Designed services, deployed to AWS.", "Java, Docker, AWS, Terraform. Designed and deployed systems."),
    (4, "Di knows C++ and C# and R and Go.", "C++ developer, C# a plus, R or Go."),
    (5, "Eve has worked with pandas, numpy and scikit-learn. " + "She writes. " * 40 + "PhD in data science.", "numpy, pandas, scikit-learn, machine learning. PhD in data science."),
    (6, "Fay likes REST and GraphQL, led a team of 4 for 10 years", "REST, GraphQL, gRPC; led teams; years experience"),
]
RESUMES = [
    (1, "Ann Example\nann@example.org | (555) 123-4567 | Springfield, IL\n\nSummary\nBuilder of\ndata things\n\nSkills\nPython, SQL | scikit-learn\n• R\nPython\n\nExperience\nEngineer at Acme\nBuilt things\n- Shipped it\n\nJan 2019 - Mar 2020\nOther - Duty\n\nEducation\nBachelor of Science\nState University\n2018\n"),
    (2, "555-123-4567\nBo Sample\n\nWork Experience:\nLead - Widgets\nMay 2015 – Present\n• ran it\n\nEducation\n• Some Institute of Technology, Town  July 2019 - June 2023\n• B.Tech in Machines\nUC Berkeley\nOpen to relocation\n\nInterests\nchess"),
    (3, ""),
    (4, None),
]


def pairs(spark):
    return spark.createDataFrame(PAIRS, "id long, resume string, job string")


def scores(spark):
    rows = S.scored(pairs(spark))
    lists = [F.array_join(c, ",").alias(c) for c in ("matched_skills", "missing_skills")]
    return rows.select("id", "score", *lists, "recommendation", "resume_snippet")


def score_page(spark, _):
    rows = S.scored(pairs(spark)).withColumn("created_at", F.expr("date_add(DATE '2024-01-01', cast(id div 2 AS INT))"))
    shown, total = S.page(rows, limit=2, offset=1, min_score=20.0)
    return shown.crossJoin(F.broadcast(total)).select("id", "score", "total")  # total is one row


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("context"), F.substring("text", 1, 60).alias("question"))


def resumes(spark):
    return spark.createDataFrame(RESUMES, "id long, text string")


def parsed(version):
    def run(spark, _):
        rows = R.parsed(resumes(spark), "id", version=version)
        return rows.select(*[F.to_json(c).alias(c) if c in ("skills", "experience", "education") else F.col(c) for c in rows.columns])

    return run


def embedded(spark, sf_dir):
    rows = E.embedded(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", lambda: E.stand_in(16))
    return rows.select("item_id", "token_count", "key", *[F.round(F.col("embedding")[k], 9).alias(f"value_{k}") for k in (0, 1, 15)])


def text_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.reverse("text")).alias("other"))
    return E.similar(rows, "text", "other", lambda: E.stand_in(16)).select("item_id", "similarity", "interpretation")


QUERIES = {
    "score_resumes": lambda s, d: scores(s),
    "score_page": score_page,
    "prompt_rag_qa": lambda s, d: P.rendered(asked(s, d), "rag_qa", {"context": "context", "question": "question"}).select("item_id", "prompt"),
    "prompt_few_shot": lambda s, d: P.rendered(asked(s, d), "rag_qa_few_shot", {"context": "context", "question": "question"}).select("item_id", "prompt"),
    "prompt_classify": lambda s, d: P.rendered(table(s, d, "documents"), "classify", {"text": "text", "labels": F.array(F.lit("en"), F.lit("de"))}).select("doc_id", F.md5("prompt").alias("prompt_md5")),
    "template_tag_search": lambda s, d: P.registry(s, tag="retrieval").select("name", "technique", F.array_join("tags", ",").alias("tags")),
    "template_techniques": lambda s, d: P.techniques(s).select(F.array_join("techniques", ",").alias("techniques")),
    "chain_rewrite_answer": lambda s, d: P.chained(asked(s, d), "rag_with_rewrite").select("item_id", "rewritten_query", "answer"),
    "chain_summarize_answer": lambda s, d: P.chained(asked(s, d), "summarize_then_answer").select("item_id", "summary", "answer_preview"),
    "context_by_language": lambda s, d: P.numbered_context(table(s, d, "benchmark").withColumn("group", F.col("item_id") % 4).withColumn("source", F.concat(F.lit("item"), F.col("item_id").cast("string"))), "group", "item_id", "source", "text"),
    "embed_mock": embedded,
    "embed_batch_totals": lambda s, d: E.batch_totals(E.batch(table(s, d, "documents").select("doc_id", "text"), "text", lambda: E.stand_in(16))),
    "text_similarity": text_pairs,
    "cache_evicted": lambda s, d: E.evicted(table(s, d, "documents").withColumn("key", E.cache_key(X.trimmed(F.col("text")), "mock", "mock-embed")), "doc_id", "key", 100).select("key"),
    "cache_stats": lambda s, d: E.cache_use(table(s, d, "documents").withColumn("key", E.cache_key(X.trimmed(F.col("text")), "mock", "mock-embed")), "doc_id", "key"),
    "resume_parse": parsed(1),
    "resume_parse_inline": parsed(2),
    "resume_contact": lambda s, d: R.contact(table(s, d, "documents").select("doc_id", "text")).select("doc_id", "name", "email", "phone", "location"),
    "resume_sections": lambda s, d: R.sections(resumes(s), "id").select("id", "position", "section", "line"),
    "md_strip": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.without_markdown(F.col("text"))).alias("text_md5")),
    "unicode_norm": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.normalised(F.col("text"))).alias("text_md5")),
    "spacing_fix": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.spaced(F.col("text"))).alias("text_md5")),
    "text_previews": lambda s, d: table(s, d, "documents").select("doc_id", X.preview(F.col("text"), 100).alias("preview")),
    "rows_inserted": lambda s, d: W.inserted(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), table(s, d, "region").select(F.col("r_name").alias("name")), "name"),
    "rows_deleted": lambda s, d: W.deleted(table(s, d, "orders"), F.col("o_orderstatus") == "F")[0].groupBy("o_orderstatus").agg(F.count("*").alias("n")),
    "rows_json": lambda s, d: W.to_json(table(s, d, "nation").select("n_nationkey", "n_name")),
    "row_by_id": lambda s, d: W.by_id(table(s, d, "documents").select("doc_id", "lang", "source"), 7, "doc_id"),
    "company_generated": lambda s, d: G.company(s)["employees"].groupBy("department_id").agg(F.count("*").alias("n"), F.countDistinct("email").alias("emails")),
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _patterns() -> str:
    """Structs of the skills and their patterns, for SQL."""
    bound = {s: r"\b" + re.sub("[^a-z0-9 ]", lambda m: "\\" + m[0], s) + r"\b" for s in S.SKILLS}
    return "[" + ", ".join(f"{{'s': {_text(s)}, 'p': {_text(p)}}}" for s, p in bound.items()) + "]"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


SCORED = f"""WITH pairs AS (SELECT * FROM (VALUES {", ".join(f"({i}::BIGINT, {_text(a)}, {_text(b)})" for i, a, b in PAIRS)}) p(id, resume, job)),
found AS (SELECT id, resume, lower(resume) AS r,
  list_transform(list_filter({_patterns()}, lambda x: regexp_matches(lower(job), x.p)), lambda x: x.s) AS wanted, list_transform(list_filter({_patterns()}, lambda x: regexp_matches(lower(resume), x.p)), lambda x: x.s) AS own,
  list_filter({_list(S.EXPERIENCE)}, lambda x: contains(lower(job), x)) AS ex, list_filter({_list(S.EDUCATION)}, lambda x: contains(lower(job), x)) AS ed FROM pairs),
split AS (SELECT *, list_filter(wanted, lambda x: list_contains(own, x)) AS hit, list_filter(wanted, lambda x: NOT list_contains(own, x)) AS miss,
  CASE WHEN len(ex) = 0 THEN 70 ELSE len(list_filter(ex, lambda x: contains(r, x))) * 100.0::DOUBLE / len(ex) END AS eb,
  CASE WHEN len(ed) = 0 THEN 70 ELSE round(len(list_filter(ed, lambda x: contains(r, x))) * 100.0::DOUBLE / len(ed), 2) END AS es FROM found),
parts AS (SELECT *, round(CASE WHEN len(ex) > 0 AND regexp_matches(r, '\\d+\\+?\\s+years?') THEN least(eb + 10, 100) ELSE eb END, 2) AS xs,
  CASE WHEN len(wanted) = 0 THEN 50 ELSE len(hit) * 100.0::DOUBLE / len(wanted) END AS ss FROM split),
done AS (SELECT *, round(least(greatest(ss * 0.6::DOUBLE + xs * 0.25::DOUBLE + es * 0.15::DOUBLE, 0), 100), 2) AS score FROM parts)
"""

#: The stand-in's vectors of 16 values, in 128-bit arithmetic, for texts(id, t).
GENERATED = "gen AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}::UHUGEINT, {c}::UHUGEINT)" for k, (a, c) in enumerate(zip(*(x.tolist() for x in E.affine(16)), strict=True))) + """) g(k, a, c)),
raw AS (SELECT id, k, ((('0x' || right(sha256(t), 16))::UBIGINT::UHUGEINT * a + c) % 18446744073709551616::UHUGEINT)::DOUBLE / 18446744073709551616::DOUBLE * 2 - 1 AS v FROM texts, gen WHERE t <> ''),
vectors AS (SELECT id, list(v / n ORDER BY k) AS e FROM raw JOIN (SELECT id, sqrt(sum(v * v)) AS n FROM raw GROUP BY id) USING (id) GROUP BY id)
"""

SQL = {
    "embed_mock": "WITH texts AS (SELECT item_id AS id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM benchmark), " + GENERATED + """
      SELECT id AS item_id, len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> ''))::BIGINT AS token_count, sha256('mock:mock-embed:' || t) AS key, round(e[1], 9) AS value_0, round(e[2], 9) AS value_1, round(e[16], 9) AS value_15
      FROM texts LEFT JOIN vectors USING (id)""",
    "text_similarity": "WITH texts AS (SELECT item_id * 2 AS id, text AS t FROM benchmark UNION ALL SELECT item_id * 2 + 1, CASE WHEN item_id % 3 = 0 THEN text ELSE reverse(text) END FROM benchmark), " + GENERATED + """,
      near AS (SELECT b.item_id, round(list_inner_product(x.e, y.e), 6) AS similarity FROM benchmark b JOIN vectors x ON x.id = b.item_id * 2 JOIN vectors y ON y.id = b.item_id * 2 + 1)
      SELECT item_id, similarity, CASE WHEN similarity >= 0.9 THEN 'very similar' WHEN similarity >= 0.75 THEN 'similar' WHEN similarity >= 0.5 THEN 'somewhat similar' WHEN similarity >= 0.25 THEN 'slightly similar' ELSE 'not similar' END AS interpretation FROM near""",
    "score_resumes": SCORED + """SELECT id, score, array_to_string(hit, ',') AS matched_skills, array_to_string(miss, ',') AS missing_skills,
      CASE WHEN score >= 80 THEN 'strong match' WHEN score >= 60 THEN 'good match' WHEN score >= 40 THEN 'partial match' ELSE 'weak match' END AS recommendation,
      substr(trim(resume), 1, 300) || CASE WHEN length(resume) > 300 THEN '...' ELSE '' END AS resume_snippet FROM done""",
    "score_page": SCORED + "SELECT id, score, (SELECT count(*) FROM done WHERE score >= 20) AS total FROM done WHERE score >= 20 ORDER BY id // 2 DESC, id DESC LIMIT 2 OFFSET 1",
    "prompt_rag_qa": "SELECT item_id, 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || substr(text, 1, 60) || chr(10) || chr(10) || 'Answer based only on the context above:' AS prompt FROM benchmark",
    "prompt_few_shot": "SELECT item_id, 'Here are examples of good answers:' || chr(10) || chr(10) || "
    + " || ".join(f"'Context: {e['context']}' || chr(10) || 'Question: {e['question']}' || chr(10) || 'Answer: {e['answer']}' || chr(10) || chr(10)" for e in P.TEMPLATES["rag_qa_few_shot"].examples)
    + " || '---' || chr(10) || 'Now answer this:' || chr(10) || chr(10) || 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || substr(text, 1, 60) || chr(10) || chr(10) || 'Answer:' AS prompt FROM benchmark",
    "prompt_classify": "SELECT doc_id, md5('Classify the following text into exactly one of these labels:' || chr(10) || 'en, de' || chr(10) || chr(10) || 'Text to classify:' || chr(10) || text || chr(10) || chr(10) || 'Label:') AS prompt_md5 FROM documents",
    "template_tag_search": "SELECT * FROM (VALUES " + ", ".join(f"({_text(t.name)}, {_text(t.technique)}, {_text(','.join(t.tags))})" for t in P.TEMPLATES.values() if "retrieval" in t.tags) + ") t(name, technique, tags)",
    "template_techniques": f"SELECT {_text(','.join(sorted({t.technique for t in P.TEMPLATES.values()})))} AS techniques",
    "chain_rewrite_answer": """WITH a AS (SELECT item_id, '[Mock] Response to: ' || substr('Original query: ' || substr(text, 1, 60) || chr(10) || chr(10) || 'Conversation context: ' || text, 1, 80) AS with_context,
      '[Mock] Response to: ' || substr('Original query: ' || substr(text, 1, 60) || chr(10) || chr(10) || chr(10) || 'Rewrite this query', 1, 80) AS rewritten_query, text FROM benchmark)
      SELECT item_id, rewritten_query, '[Mock] Response to: ' || substr('Context:' || chr(10) || text, 1, 80) AS answer FROM a""",
    "chain_summarize_answer": """WITH a AS (SELECT item_id, '[Mock] Response to: ' || substr('Summarize the following document in 3 sentences or fewer.' || chr(10) || 'Focus on the most important', 1, 80) AS summary, text FROM benchmark)
      SELECT item_id, summary, '[Mock] Response to: ' || substr('Context:' || chr(10) || summary || chr(10) || chr(10) || 'Question: ' || substr(text, 1, 60), 1, 80) AS answer_preview FROM a""",
    "context_by_language": "WITH n AS (SELECT item_id % 4 AS \"group\", item_id, text, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) AS i FROM benchmark) SELECT \"group\", string_agg('[' || i || '] Source: item' || item_id || chr(10) || text, chr(10) || chr(10) ORDER BY item_id) AS context FROM n GROUP BY 1",
    "embed_batch_totals": "SELECT count(*) AS total_texts, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::BIGINT AS total_tokens, count(*) - count(DISTINCT trim(text)) AS cache_hits FROM documents",
    "cache_evicted": "WITH f AS (SELECT sha256('mock:mock-embed:' || trim(text)) AS key, min(doc_id) AS since FROM documents GROUP BY 1) SELECT key FROM f WHERE key NOT IN (SELECT key FROM f ORDER BY since DESC LIMIT 100)",
    "cache_stats": "WITH k AS (SELECT count(*) AS n, count(DISTINCT trim(text)) AS size FROM documents) SELECT size, n - size AS hits, size AS misses, round((n - size) / n, 4) AS hit_rate FROM k",
    "resume_contact": rf"""SELECT doc_id, coalesce(list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:5],
      lambda x: NOT regexp_matches(x, '{R.EMAIL}') AND NOT regexp_matches(x, '{R.PHONE}') AND NOT regexp_matches(x, '[0-9]') AND len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) <= 5)[1], '') AS name,
      regexp_extract(text, '{R.EMAIL}', 0) AS email, trim(regexp_extract(text, '{R.PHONE}', 0), chr(10) || ' ') AS phone, trim(regexp_extract(text, '{R.LOCATION}', 0)) AS location FROM documents""",
    "unicode_norm": "SELECT doc_id, md5(nfc_normalize(regexp_replace(translate(text, '–—―−•‣▪●․·‧‘’“”\u00a0\uf0b7\u200b\u200c\u200d\ufeffâ', '----•••••••''''\"\" •'), '[\ue000-\uf8ff]', '', 'g'))) AS text_md5 FROM documents",
    "resume_sections": "WITH texts AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_text(t)})" for i, t in RESUMES if t is not None) + """) t(id, text)),
      named AS (SELECT * FROM (VALUES """ + ", ".join(f"({_text(w)}, {_text(s)})" for s, ws in R.SECTIONS[1].items() for w in ws) + r""") n(word, heading)),
      split AS (SELECT id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS ls FROM texts),
      each AS (SELECT id, unnest(range(0, len(ls)))::INT AS position, regexp_replace(unnest(ls), '^\s+|\s+$', '', 'g') AS line FROM split),
      placed AS (SELECT each.*, heading, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'header') AS section FROM each LEFT JOIN named ON word = trim(lower(line), ' :_-'))
      SELECT id, position, section, line FROM placed WHERE heading IS NULL""",
    "md_strip": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '(?m)^#{1,6}\s+', '', 'g'), '\*{1,2}(.+?)\*{1,2}', '\1', 'g'), '_{1,2}(.+?)_{1,2}', '\1', 'g'), '\[(.+?)\]\(.+?\)', '\1', 'g'),
      '(?m)^[-*_]{3,}\s*$', '', 'g'), '<[^>]+>', '', 'g'), '(?m)^[*\-+]\s+', '• ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents""",
    "spacing_fix": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-z])([A-Z][a-z])', '\1 \2', 'g'),
      '([,|•])(\S)', '\1 \2', 'g'), '[^\S\n]+', ' ', 'g'), '(?m)^\s+', '', 'g')) AS text_md5 FROM documents""",
    "text_previews": "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents",
    "rows_inserted": "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name), r_name FROM region",
    "rows_deleted": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
    "rows_json": "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation",
    "row_by_id": "SELECT doc_id, lang, source FROM documents WHERE doc_id = 7",
}
