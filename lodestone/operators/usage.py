"""A log of model calls: records, totals, retention, replies of a stand-in.

log(request_id, provider, model, input_tokens, output_tokens, latency_ms,
total_cost, stop_reason, timestamp, error), error null for a success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import estimate

KEPT = 1000


def retained(log: DataFrame, most: int = KEPT) -> DataFrame:
    """The last records: a success drops the oldest beyond ``most``, an error
    drops none, so errors after the last success come on top."""
    successes = log.filter(F.col("error").isNull()).agg(F.max("request_id").alias("last"))
    upto = log.crossJoin(F.broadcast(successes)).filter("request_id <= last").drop("last").orderBy(F.desc("request_id")).limit(most)
    after = log.crossJoin(F.broadcast(successes)).filter("last IS NULL OR request_id > last").drop("last")
    return upto.unionByName(after)


def recent(log: DataFrame, n: int = 20, most: int = KEPT) -> DataFrame:
    """The n newest retained records, oldest first; n = 0 means all."""
    rows = retained(log, most)
    return (rows.orderBy(F.desc("request_id")).limit(n) if n else rows).orderBy("request_id")


def summary(log: DataFrame, most: int = KEPT) -> DataFrame:
    """Totals over all successes; errors; the mean latency of the retained
    records without an error, 0 if there are none."""
    ok = F.col("error").isNull()
    total = log.agg(
        F.count_if(ok).alias("total_requests"),
        F.coalesce(F.sum(F.when(ok, F.col("input_tokens"))), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0)).alias("total_output_tokens"),
        F.coalesce(F.round(F.sum(F.when(ok, F.col("total_cost"))), 6), F.lit(0.0)).alias("total_cost_usd"),
        F.count_if(~ok).alias("total_errors"),
    ).withColumn("total_tokens", F.col("total_input_tokens") + F.col("total_output_tokens"))
    latency = retained(log, most).agg(F.coalesce(F.round(F.avg(F.when(ok, F.col("latency_ms"))), 2), F.lit(0.0)).alias("avg_latency_ms"))
    return total.crossJoin(F.broadcast(latency))  # one row each


def by_model(log: DataFrame) -> DataFrame:
    ok = log.filter(F.col("error").isNull())
    return ok.groupBy("model").agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("total_cost"), 6).alias("total_cost"))


def valid_messages(messages: DataFrame) -> DataFrame:
    """Messages of the roles user and assistant that have a text."""
    return messages.filter(F.col("role").isin("user", "assistant") & (F.length("text") > 0))


def mock_reply(last: Column, system: Column | None = None, max_tokens: int = 1024) -> Column:
    """A stand-in's reply: the first 50 characters of the last message after a
    fixed phrase, and the first 30 of the system prompt before, cut to a fourth
    of ``max_tokens`` words; only a cut changes the spacing."""
    text = F.concat(F.lit("Mock response to: "), F.regexp_replace(F.substring(last, 1, 50), "\n", " "))
    if system is not None:
        text = F.when(F.length(system) > 0, F.concat(F.lit("[System: "), F.substring(system, 1, 30), F.lit("] "), text)).otherwise(text)
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(words) > max_tokens // 4, F.array_join(F.slice(words, 1, max_tokens // 4), " ")).otherwise(text)


def streamed(replies: DataFrame, key: str, text: str) -> DataFrame:
    """Tokens of replies in order, each a word and a space, and the end mark."""
    words = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != "")
    marked = F.concat(F.transform(words, lambda w: F.concat(w, F.lit(" "))), F.array(F.lit("[DONE]")))
    return replies.select(key, F.posexplode(marked).alias("position", "token"))


def logged(messages: DataFrame, model: Column) -> DataFrame:
    """A log with a record for each assistant message of conversations: what
    came before it is its input. Empty replies are errors."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.withColumn("tokens", estimate(F.col("text"))).withColumn("input_tokens", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    return rows.filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.lit("mock").alias("provider"), model.alias("model"), "input_tokens", F.col("tokens").alias("output_tokens"))


def cleared(log: DataFrame) -> DataFrame:
    """The log without its records."""
    return log.filter(F.lit(False))


def delay(attempt: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """Waiting time before a retry (0, 1, ...), without its random part."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def delays(attempts: int, base: float = 1.0, most: float = 30.0) -> list[float]:
    """Waiting times before each retry, without their random part."""
    return [min(base * 2**k, most) for k in range(attempts)]
