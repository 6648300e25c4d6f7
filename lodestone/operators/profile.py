"""Profiles of text columns: types, statistics, missing values, correlations.

Each operator takes a frame whose cells are strings, as a CSV without a schema
gives them. All columns of a frame are profiled in one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A column is numeric if at least this share of its filled cells are numbers.
NUMERIC_SHARE = 0.8
_DIGITS = r"\d+(_\d+)*"
NUMBER = rf"^([+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?|[+-]?(?i:inf|infinity|nan))$"


def stripped(cell: Column) -> Column:
    """Without white space at either end, of any Unicode kind."""
    return F.regexp_replace(cell, r"(?U)^\s+|\s+$", "")


def blank(cell: Column) -> Column:
    return cell.isNull() | (stripped(cell) == "")


def number(cell: Column) -> Column:
    """The number in a cell, thousands' commas dropped; null if it has none.

    Underscores between digits are allowed, type suffixes are not; 'nan' and
    'inf' count as numbers.
    """
    text = F.regexp_replace(stripped(cell), ",", "")
    return F.when(text.rlike(NUMBER), F.regexp_replace(text, "_", "").try_cast("double"))


def _one_row(df: DataFrame, columns: list[str], values) -> DataFrame:
    """values(name) -> {output: aggregate}; a row for each column."""
    wide = df.agg(*[F.struct(*[v.alias(k) for k, v in values(c).items()]).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"c{i}")[k].alias(k) for k in values(c)]) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def inferred_types(df: DataFrame) -> DataFrame:
    def values(c):
        filled = F.count_if(~blank(F.col(c)))
        share = F.when(filled > 0, F.count_if(number(F.col(c)).isNotNull() & ~blank(F.col(c))) / filled).otherwise(0.0)
        return {"inferred_type": F.when(share >= NUMERIC_SHARE, "numeric").otherwise("categorical")}

    return _one_row(df, df.columns, values)


def numeric_columns(df: DataFrame) -> list[str]:
    return [r.column for r in inferred_types(df).filter("inferred_type = 'numeric'").collect()]


def numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count (filled cells, numbers or not), missing, mean, min, max, population
    standard deviation and exact median of numeric columns, to 4 places."""

    def values(c):
        x = number(F.col(c))
        return {
            "count": F.count_if(~blank(F.col(c))),
            "missing": F.count_if(blank(F.col(c))),
            "mean": F.round(F.avg(x), 4),
            "min": F.min(x),
            "max": F.max(x),
            "std_dev": F.round(F.stddev_pop(x), 4),
            "median": F.round(F.median(x), 4),
        }

    return _one_row(df, numeric_columns(df) if columns is None else columns, values)


def categorical(df: DataFrame, column: str, order: str, top: int = 5) -> DataFrame:
    """The most common filled values, first seen (by ``order``) first on a tie."""
    grouped = df.filter(~blank(F.col(column))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("frequency"), F.min(order).alias("first_seen"))
    return grouped.orderBy(F.desc("frequency"), "first_seen").limit(top).select("value", "frequency")


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return _one_row(df, columns, lambda c: {"count": F.count_if(~blank(F.col(c))), "missing": F.count_if(blank(F.col(c))), "unique_count": F.count_distinct(F.when(~blank(F.col(c)), F.col(c)))})


def missing(df: DataFrame) -> DataFrame:
    """Missing cells of each column and their percentage of all rows."""

    def values(c):
        n = F.count_if(blank(F.col(c)))
        return {"missing": n, "missing_pct": F.when(F.count(F.lit(1)) > 0, F.round(n * 100.0 / F.count(F.lit(1)), 1)).otherwise(0.0)}

    return _one_row(df, df.columns, values)


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson's correlation of all ordered pairs of numeric columns over rows
    where both are numbers, to 4 places: null without such rows, 0 for a single
    row or no variance."""
    columns = numeric_columns(df) if columns is None else columns
    parsed = df.select(*[number(F.col(c)).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def value(a, b):
        on = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(on, F.col(a)), F.when(on, F.col(b))
        scale = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when(F.count_if(on) == 0, F.lit(None).cast("double")).when((F.count_if(on) < 2) | (scale == 0), F.lit(0.0)).otherwise(F.round(F.try_divide(F.covar_pop(x, y), scale), 4))

    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    wide = parsed.agg(*[value(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs) for x, y in {(a, b), (b, a)}]
    return wide.select(F.inline(F.array(*entries)))


def rows_with(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of ``columns`` is blank."""
    return df.filter(reduce(lambda a, b: a & b, [~blank(F.col(c)) for c in columns]))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Contiguous ids from 1 in the order of a column: a place within each range
    partition, plus the sizes of the ones before."""
    ranged = df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(order)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.join(F.broadcast(before), "__part").withColumn("id", F.col("__before") + place).drop("__part", "__before")
