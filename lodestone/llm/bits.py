"""Bit filters of fixed size over ids: they pass all ids of a set and few others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of Spark's bitmap aggregates.
ROW = 32768


def slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)).cast("int")


def sized(count: int, least: int = 1 << 23, most: int = 1 << 28) -> int:
    """A power of two of about 16 bits an id, within fixed bounds."""
    return min(most, max(least, 1 << max(1, 16 * count - 1).bit_length()))


def collected(slots: DataFrame, bits: int) -> np.ndarray:
    """The filter as bytes, from the column slot; bits / ROW rows at most."""
    rows = slots.groupBy(F.expr(f"slot div {ROW}").alias("part")).agg(F.expr(f"bitmap_construct_agg(slot % {ROW})").alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        table[r.part * (ROW // 8) : (r.part + 1) * (ROW // 8)] = np.frombuffer(bytes(r.bits), np.uint8)
    return table


def passed(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def apart(df: DataFrame, key: str, ids: DataFrame, bits: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be in the column ``id`` of ``ids``, rows whose key
    is certainly not). The filter travels as at most bits / ROW rows of 4 KB,
    so that the rows themselves need no shuffle to be told apart."""
    held = ids.select(slot(F.col("id"), bits).alias("slot")).groupBy(F.expr(f"slot div {ROW}").alias("__part")).agg(F.expr(f"bitmap_construct_agg(slot % {ROW})").alias("__bits"))
    marked = df.withColumn("__slot", slot(F.col(key), bits)).withColumn("__part", F.expr(f"__slot div {ROW}")).join(F.broadcast(held), "__part", "left")
    on = F.expr(f"coalesce(shiftright(cast(conv(hex(substring(__bits, cast(__slot % {ROW} div 8 + 1 AS INT), 1)), 16, 10) AS INT), cast(__slot % 8 AS INT)) & 1, 0) = 1")
    return marked.filter(on).select(*df.columns), marked.filter(~on).select(*df.columns)
