"""Intermediate tables in hash buckets, and samples by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import _PATHS, release, scratch_root, staged

__all__ = ["below", "bucketed", "drawn", "lowest", "release", "scratch_root", "staged"]


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """The same with a file for each of ``buckets`` hash buckets of ``key``, so
    that joins on it move the other side only."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{table}"
    df.repartition(buckets, F.col(key)).write.bucketBy(buckets, key).option("path", path).option("compression", "none").format("parquet").saveAsTable(table)
    out = spark.table(table)
    _PATHS[out] = path
    return out


#: Resolution of hash shares, and how many times the wanted rows first pass.
SHARES, SPARE = 1 << 30, 4


def drawn(key: str) -> Column:
    """The hash of a row's key that a sample goes by."""
    return F.pmod(F.xxhash64(key), F.lit(SHARES))


def below(key: str, share: Column) -> Column:
    """Whether that hash lies within a share of all hashes."""
    return drawn(key) < F.least(share, F.lit(1.0)) * SHARES


def lowest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows whose keys have the lowest hashes. A share of the hashes that
    holds about SPARE times as many goes first, so that what the tasks send to
    the final ordering does not grow with their number."""
    total = rows.count()
    some = rows.filter(below(key, F.lit(SPARE * n / max(1, total)))) if total > SPARE * n else rows
    return some.orderBy(drawn(key), key).limit(n)
