"""Rows of a table added, removed, changed and looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import numbered


def inserted(rows: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``rows`` and ``new``, which gets the ids after the largest, in the order
    of a column. Missing columns become null."""
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))  # one row
    fresh = numbered(new, order).crossJoin(F.broadcast(top)).withColumn("id", F.col("id") + F.col("__top")).drop("__top")
    return rows.unionByName(fresh, allowMissingColumns=True)


def deleted(rows: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """(the rows left, the number deleted); a null condition deletes nothing."""
    gone = F.coalesce(which, F.lit(False))
    return rows.filter(~gone), rows.filter(gone).agg(F.count("*").alias("deleted"))


def by_id(rows: DataFrame, id_: int, key: str = "id") -> DataFrame:
    return rows.filter(F.col(key) == id_)


def to_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """A JSON document a row, as reports are written."""
    return rows.select(F.to_json(F.struct("*")).alias(name))


def shown(rows: DataFrame, n: int = 20) -> None:
    rows.show(n, truncate=False)
