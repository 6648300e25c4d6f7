"""Token estimates and prices of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Model, context window in tokens, USD per million input and output tokens.
MODELS = [
    ("claude-3-5-sonnet-20241022", 200_000, 3.00, 15.00),
    ("claude-3-5-haiku-20241022", 200_000, 0.80, 4.00),
    ("claude-3-opus-20240229", 200_000, 15.00, 75.00),
    ("claude-sonnet-4-20250514", 200_000, 3.00, 15.00),
    ("gpt-4o", 128_000, 5.00, 15.00),
    ("gpt-4o-mini", 128_000, 0.15, 0.60),
    ("gpt-4-turbo", 128_000, 10.00, 30.00),
    ("gpt-3.5-turbo", 16_385, 0.50, 1.50),
]
WINDOW = 100_000  # of a model not listed


def estimate(text: Column) -> Column:
    """A fourth of the characters, at least 1; 0 for no text."""
    return F.when(F.length(text) > 0, F.greatest(F.floor(F.length(text) / 4), F.lit(1))).otherwise(0).cast("long")


def exact(text: Column, path: str | None) -> Column:
    """Tokens by a vocabulary file of the tokenizers library; the estimate where
    there is no file or no library."""
    try:
        from tokenizers import Tokenizer

        Tokenizer.from_file(path)
    except Exception:  # noqa: BLE001 - the library raises a bare Exception for a file it can't read
        return estimate(text)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        for texts in batches:
            yield pd.Series([len(x.ids) for x in made.encode_batch([t or "" for t in texts], add_special_tokens=False)])

    return count(text)


def models(spark) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, context_window long, input_price double, output_price double")


def priced(calls: DataFrame) -> DataFrame:
    """calls(model, input_tokens, output_tokens, ...) with costs to 6 places:
    0, with a note, for a model without a price. The model table has a fixed
    number of rows and is broadcast."""
    side = models(calls.sparkSession).drop("context_window")
    rows = calls.join(F.broadcast(side), "model", "left")
    into, out = (F.coalesce(F.col(f"{k}_tokens") / 1_000_000 * F.col(f"{k}_price"), F.lit(0.0)) for k in ("input", "output"))
    note = F.when(F.col("input_price").isNull(), F.concat(F.lit("no price for model '"), F.col("model"), F.lit("'"))).otherwise("")
    rows = rows.withColumn("input_cost", F.round(into, 6)).withColumn("output_cost", F.round(out, 6)).withColumn("total_cost", F.round(into + out, 6)).withColumn("note", note)
    return rows.drop("input_price", "output_price")


def fitting(calls: DataFrame, text: str, reserve: int = 1000) -> DataFrame:
    """calls(model, ...) with whether the text and a reserve fit the window."""
    rows = calls.join(F.broadcast(models(calls.sparkSession).select("model", "context_window")), "model", "left")
    rows = rows.withColumn("context_window", F.coalesce("context_window", F.lit(WINDOW)))
    return rows.withColumn("fits", estimate(F.col(text)) + reserve <= F.col("context_window"))


def conversation_tokens(messages: DataFrame, key: str) -> DataFrame:
    """Tokens of message lists: 4 more for each message and 2 for the list."""
    return messages.groupBy(key).agg((F.sum(estimate(F.col("text"))) + 4 * F.count("*") + 2).cast("long").alias("tokens"))
