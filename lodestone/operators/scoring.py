"""Scores of résumés against job descriptions, and pages of a scores table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

# Skills, in the order they are reported.
SKILLS = [
    "python", "javascript", "typescript", "java", "go", "golang", "rust", "c++", "c#", "ruby", "php", "swift", "kotlin", "scala", "r",
    "fastapi", "django", "flask", "react", "vue", "angular", "nextjs", "express", "spring", "rails", "laravel", "sqlalchemy", "pydantic",
    "postgresql", "postgres", "mysql", "sqlite", "mongodb", "redis", "elasticsearch", "cassandra", "dynamodb", "snowflake", "bigquery",
    "aws", "gcp", "azure", "docker", "kubernetes", "k8s", "terraform", "ci/cd", "github actions", "jenkins", "ansible",
    "machine learning", "deep learning", "nlp", "llm", "rag", "langchain", "openai", "pytorch", "tensorflow", "scikit-learn", "pandas", "numpy", "huggingface",
    "git", "rest", "graphql", "grpc", "microservices", "kafka", "celery", "airflow", "spark", "linux", "bash", "sql",
]
# Phrases of experience and of education.
EXPERIENCE = ["years of experience", "year experience", "years experience", "led", "managed", "built", "designed", "architected", "developed", "deployed", "scaled", "optimized", "mentored", "collaborated"]
EDUCATION = ["bachelor", "master", "phd", "b.s.", "m.s.", "b.tech", "m.tech", "b.e.", "computer science", "software engineering", "information technology", "data science", "electrical engineering"]
# Weights of the three parts, and least scores of the recommendations.
WEIGHTS = (0.60, 0.25, 0.15)
BANDS = [(80, "strong match"), (60, "good match"), (40, "partial match"), (0, "weak match")]


def _has_skill(text: Column, skill: str) -> Column:
    """The skill between word boundaries; one that ends in a symbol only counts
    before a letter or digit, as boundaries have it."""
    return text.rlike(r"\b" + re.sub(r"([^\w\s])", r"\\\1", skill) + r"\b")


def _found(text: Column, words: list[str], has) -> Column:
    return F.filter(F.array(*[F.when(has(text, w), F.lit(w)) for w in words]), lambda w: w.isNotNull())


def scored(pairs: DataFrame) -> DataFrame:
    """pairs(resume, job, ...) with score, matched_skills, missing_skills,
    recommendation and resume_snippet.

    Skills of the job decide 60 % (half if it names none), its phrases of
    experience 25 % and of education 15 % (70 of 100 where it has none); ten
    points for a number of years.
    """
    resume, job = F.lower("resume"), F.lower("job")

    def contains(text, w):
        return text.contains(w)

    rows = pairs.withColumns({"__wanted": _found(job, SKILLS, _has_skill), "__own": _found(resume, SKILLS, _has_skill)})
    for name, words in (("__exp", EXPERIENCE), ("__edu", EDUCATION)):
        rows = rows.withColumn(name, _found(job, words, contains)).withColumn(f"{name}_own", _found(resume, words, contains))

    def share(name, none):
        part = F.size(F.array_intersect(name, f"{name}_own")) * 100.0
        return F.when(F.size(name) == 0, F.lit(none)).otherwise(F.try_divide(part, F.size(name)))

    experience = share("__exp", 70.0)
    years = (F.size("__exp") > 0) & resume.rlike(r"\d+\+?\s+years?")
    experience = F.round(F.when(years, F.least(experience + 10, F.lit(100.0))).otherwise(experience), 2)
    matched = F.array_intersect("__wanted", "__own")
    skill = F.when(F.size("__wanted") == 0, 50.0).otherwise(F.try_divide(F.size(matched) * 100.0, F.size("__wanted")))
    total = skill * WEIGHTS[0] + experience * WEIGHTS[1] + F.round(share("__edu", 70.0), 2) * WEIGHTS[2]
    rows = rows.withColumn("score", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 2))
    advice = F.lit(BANDS[-1][1])
    for least, name in reversed(BANDS[:-1]):
        advice = F.when(F.col("score") >= least, name).otherwise(advice)
    snippet = F.substring(trimmed(F.col("resume")), 1, 300)
    snippet = F.when(F.length("resume") > 300, F.concat(snippet, F.lit("..."))).otherwise(snippet)
    rows = rows.withColumns({"matched_skills": matched, "missing_skills": F.array_except("__wanted", "__own"), "recommendation": advice, "resume_snippet": snippet})
    return rows.drop("__wanted", "__own", "__exp", "__exp_own", "__edu", "__edu_own")


def page(scores: DataFrame, limit: int = 20, offset: int = 0, min_score: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(the rows of a page, newest first, and the number of all that pass)."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset 0 or more")
    rows = scores if min_score is None else scores.filter(F.col("score") >= min_score)
    shown = rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    return shown, rows.agg(F.count("*").alias("total"))
