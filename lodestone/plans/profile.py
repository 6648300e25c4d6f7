"""Profile queries: the part table as text, with blank cells among it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..tables import table


def frame(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("p_partkey"),
        "p_brand",
        F.expr("CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_type END").alias("p_type"),
        F.expr("CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE cast(p_size AS STRING) END").alias("p_size"),
        F.expr("cast(cast(p_retailprice * 100 AS BIGINT) AS STRING)").alias("price_cents"),
    )


CELLS = """
WITH cells AS (
  SELECT p_partkey::VARCHAR AS p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_type END AS p_type,
         CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS p_size,
         trunc(p_retailprice * 100)::BIGINT::VARCHAR AS price_cents FROM part),
long AS (UNPIVOT (SELECT coalesce(p_partkey, '') AS p_partkey, coalesce(p_brand, '') AS p_brand, coalesce(p_type, '') AS p_type,
                  coalesce(p_size, '') AS p_size, coalesce(price_cents, '') AS price_cents FROM cells)
         ON p_partkey, p_brand, p_type, p_size, price_cents INTO NAME "column" VALUE v),
typed AS (SELECT "column", nullif(trim(v), '') AS v, try_cast(nullif(trim(v), '') AS DOUBLE) AS x FROM long)
"""
NUMERIC = ["p_partkey", "p_size", "price_cents"]

QUERIES = {
    "profile_inferred_types": lambda s, d: P.inferred_types(frame(s, d)),
    "profile_numeric": lambda s, d: P.numeric(frame(s, d)),
    "profile_missing": lambda s, d: P.missing(frame(s, d)),
    "profile_categorical": lambda s, d: P.categorical(frame(s, d).withColumn("row", F.col("p_partkey").cast("long")), "p_type", "row"),
    "profile_distinct": lambda s, d: P.distinct_values(frame(s, d), ["p_brand", "p_type"]),
    "profile_corr": lambda s, d: P.correlations(frame(s, d), NUMERIC),
    "profile_numbered": lambda s, d: P.numbered(table(s, d, "supplier").select("s_name", "s_suppkey"), "s_name"),
}

_PAIR = """SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN count(*) = 0 THEN NULL WHEN count(*) < 2 OR stddev_pop(x) * stddev_pop(y) = 0 THEN 0.0
  ELSE round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 4) END AS corr
  FROM (SELECT try_cast({a} AS DOUBLE) AS x, try_cast({b} AS DOUBLE) AS y FROM cells) WHERE x IS NOT NULL AND y IS NOT NULL"""

SQL = {
    "profile_inferred_types": CELLS + """SELECT "column", CASE WHEN count(v) > 0 AND count(x) / count(v) >= 0.8 THEN 'numeric' ELSE 'categorical' END AS inferred_type FROM typed GROUP BY 1""",
    "profile_numeric": CELLS + """SELECT "column", count(v) AS count, count(*) - count(v) AS missing, round(avg(x), 4) AS mean, min(x) AS min, max(x) AS max,
        round(stddev_pop(x), 4) AS std_dev, round(median(x), 4) AS median FROM typed GROUP BY 1 HAVING count(x) / count(v) >= 0.8""",
    "profile_missing": CELLS + """SELECT "column", count(*) - count(v) AS missing, round((count(*) - count(v)) * 100.0 / count(*), 1)::DOUBLE AS missing_pct FROM typed GROUP BY 1""",
    "profile_categorical": CELLS + "SELECT p_type AS value, count(*) AS frequency FROM cells WHERE trim(p_type) <> '' GROUP BY 1 ORDER BY count(*) DESC, min(p_partkey::BIGINT) LIMIT 5",
    "profile_distinct": CELLS + """SELECT "column", count(v) AS count, count(*) - count(v) AS missing, count(DISTINCT v) AS unique_count FROM typed WHERE "column" IN ('p_brand', 'p_type') GROUP BY 1""",
    "profile_corr": CELLS + " UNION ALL ".join(_PAIR.format(a=a, b=b) for a in NUMERIC for b in NUMERIC),
    "profile_numbered": "SELECT s_name, s_suppkey, row_number() OVER (ORDER BY s_name) AS id FROM supplier",
}
