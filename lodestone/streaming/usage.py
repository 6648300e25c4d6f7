"""Running totals of a usage log as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_root


def totals(calls: DataFrame) -> DataFrame:
    """Totals by model of a stream, or a table, of calls; the state has a row
    for each model."""
    return calls.groupBy("model").agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by hour and type; windows close, and leave the
    state, once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


RING = "key string, request_ids array<long>"


def ring(calls: DataFrame, size: int, key: str = "provider") -> DataFrame:
    """The last ``size`` requests of each key of a stream, as its state holds
    them: a ring buffer that drops the oldest."""

    def keep(own, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            held = sorted([*held, *batch["request_id"].tolist()])[-size:]
        state.update((held,))
        yield pd.DataFrame({"key": [own[0]], "request_ids": [held]})

    rows = calls.select(F.col(key).alias("key"), F.col("request_id").cast("long").alias("request_id"))
    return rows.groupBy("key").applyInPandasWithState(keep, RING, "held array<long>", "update", "NoTimeout")


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there now; its result as a table, which
    each batch replaces (complete, update) or adds to (append). Results go to
    the shared folder, not through the driver."""
    path = f"{scratch_root(spark)}/{name}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(path)

    writer = stream.writeStream.outputMode(mode).foreachBatch(put).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint or f"{path}-state").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
