"""Text expressions. Functions named ``*_sql`` return SQL text that Spark and
other engines read alike."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no meaning for a search.
STOPWORDS = """
a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would
could should may might shall can not this that these those it its i me my we our you your he she they their him her
his what which who whom how when where why all each any more most than then so if up out about into through over
after also just only both such there here no nor very one two three new other use used using
""".split()

# Suffixes and their replacements, in the order they are tried.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
TENSES = [("eed", "ee"), ("ed", ""), ("ing", "")]
ENDINGS = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("isation", "ize"), ("ization", "ize"), ("isation", "ise"), ("ational", "al"), ("alism", "al"),
    ("aliti", "al"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("ization", "ize"), ("ational", "ate"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("ing", ""),
    ("ment", ""), ("ness", ""), ("tion", "t"), ("sion", "s"), ("er", ""), ("al", ""), ("ic", ""), ("ly", ""),
]


def _swapped(w: str, suffix: str, to: str) -> str:
    return f"concat(substr({w}, 1, length({w}) - {len(suffix)}), '{to}')"


def stem_steps_sql(w: str) -> list[str]:
    """Three CASE expressions over the column ``w``, each to be applied to the
    result of the one before: plurals, tenses, other endings.

    A tense is only cut if a vowel and two letters stay; of the endings, which
    words of at most five letters keep, the first counts that leaves three.
    """
    plural = " ".join(f"WHEN {w} LIKE '%{s}' THEN {_swapped(w, s, t)}" for s, t in PLURALS)
    tense = " ".join(
        f"WHEN {w} LIKE '%{s}' THEN CASE WHEN length({w}) - {len(s) - len(t)} >= 2 AND translate({_swapped(w, s, t)}, 'aeiou', '') <> {_swapped(w, s, t)} THEN {_swapped(w, s, t)} ELSE {w} END" for s, t in TENSES
    )
    ending = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {3 + len(s) - len(t)} THEN {_swapped(w, s, t)}" for s, t in ENDINGS)
    return [f"CASE WHEN length({w}) <= 2 THEN {w} {plural} ELSE {w} END", f"CASE {tense} ELSE {w} END", f"CASE WHEN length({w}) <= 5 THEN {w} {ending} ELSE {w} END"]


def _replaced(rules: list[tuple[str, str]], fits) -> Callable[[Column], Column]:
    """Word -> word with the longest suffix of the rules replaced, where
    ``fits(word, new)`` holds. Every rule precedes the shorter ones that its
    suffix ends with, so the longest is the first in order."""
    first = dict(reversed(rules))
    pattern = f"({'|'.join(first)})$"

    def step(word: Column) -> Column:
        found = F.regexp_extract(word, pattern, 1)
        to = F.element_at(F.create_map(*[F.lit(x) for rule in (*first.items(), ("", "")) for x in rule]), found)
        new = F.concat(F.left(word, F.length(word) - F.length(found)), to)
        return F.when(fits(word, new), new).otherwise(word)

    return step


def _steps() -> list[Callable[[Column], Column]]:
    return [
        _replaced(PLURALS, lambda word, new: F.length(word) > 2),
        _replaced(TENSES, lambda word, new: (F.length(new) >= 2) & new.rlike("[aeiou]")),
        _replaced(ENDINGS, lambda word, new: (F.length(word) > 5) & (F.length(new) >= 3)),
    ]


def stem(word: Column) -> Column:
    """The stem of a lower-case word, as :func:`stem_steps_sql` has it. Lambdas
    bind each step's word once, where nested CASEs would repeat it many times."""
    one = F.array(word)
    for step in _steps():
        one = F.transform(one, step)
    return F.element_at(one, 1)


def stemmed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, stem(F.col(f"`{column}`")))


def stems(words: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms of words(term), persisted: filters and
    semi-joins on the stem would else be pushed down to every single word, with
    the stemming in them. No stem is empty, for words of two letters or more.
    They are few, so that adaptive execution would leave the costly part to one
    task: hence the explicit number."""
    spark = words.sparkSession
    terms = words.select("term").distinct().repartition(spark.sparkContext.defaultParallelism)
    return terms.withColumn("stem", F.coalesce(stem(F.col("term")), F.lit(""))).persist()


def exploded_words(docs: DataFrame, key: str, text: str, stop: bool = True, least: int = 2) -> DataFrame:
    """(key, term) of every word that :func:`words` has, a row each."""
    rows = docs.select(key, F.explode(F.split(F.lower(F.col(text)), "[^a-z0-9]+")).alias("term")).filter(F.length("term") >= least)
    return rows.filter(~F.col("term").isin(STOPWORDS)) if stop else rows


def words(text: Column, stop: bool = True, least: int = 2) -> Column:
    """Lower-case runs of a-z and 0-9 of at least ``least`` letters, in order."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    long = F.filter(parts, lambda w: F.length(w) >= least)
    return F.filter(long, lambda w: ~w.isin(STOPWORDS)) if stop else long


# Characters of extracted documents and what stands for them.
PLAIN = {
    "-": "–—―−",
    "•": "•‣▪●․\uf0b7·‧",
    "'": "‘’",
    '"': "“”",
    " ": "\u00a0",
    "": "\u200b\u200c\u200d\ufeffâ",
}


def plain_characters(text: Column) -> Column:
    """Dashes, bullets, quotes and spaces unified; marks without width and
    private-use glyphs dropped. Canonical composition is left to ``composed``."""
    kept = [(c, to) for to, chars in PLAIN.items() for c in chars if to]
    dropped = PLAIN[""]
    mapped = F.translate(text, "".join(c for c, _ in kept) + dropped, "".join(t for _, t in kept))
    return F.regexp_replace(mapped, "[\ue000-\uf8ff]", "")


def composed(text: Column) -> Column:
    """Unicode NFC, which Spark has no function for."""
    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return nfc(text)


def normalised(text: Column) -> Column:
    return composed(plain_characters(text))


def spaced(text: Column) -> Column:
    """Spaces back where extraction lost them: between a lower-case letter and
    a capitalised word, and after commas, bars and bullets; runs of spaces as
    one, none (nor blank lines) at the start of lines."""
    text = F.regexp_replace(text, "([a-z])([A-Z][a-z])", "$1 $2")
    text = F.regexp_replace(text, r"(?U)([,|•])(\S)", "$1 $2")
    text = F.regexp_replace(text, r"(?U)[^\S\n]+", " ")
    return F.regexp_replace(text, r"(?Udm)^\s+", "")


# Markdown marks and what stays of them, in order.
MARKDOWN = [
    (r"(?Udm)^#{1,6}\s+", ""), (r"(?d)\*{1,2}(.+?)\*{1,2}", "$1"), (r"(?d)_{1,2}(.+?)_{1,2}", "$1"), (r"(?d)\[(.+?)\]\(.+?\)", "$1"),
    (r"(?Udm)^[-*_]{3,}\s*$", ""), (r"<[^>]+>", ""), (r"(?Udm)^[\*\-\+]\s+", "• "),
]


def without_markdown(text: Column) -> Column:
    for pattern, to in MARKDOWN:
        text = F.regexp_replace(text, pattern, to)
    return trimmed(text)


def trimmed(text: Column) -> Column:
    """Without white space at either end, of any Unicode kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
