"""A synthetic company: departments, employees and reviews of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST = ["Ada", "Bela", "Chidi", "Dora", "Emil", "Fatima", "Goran", "Hana", "Ivo", "Jun", "Kaya", "Lior", "Mina", "Noor", "Otto", "Pia"]
LAST = ["Abara", "Brandt", "Costa", "Diaz", "Eriksen", "Fischer", "Gupta", "Horvat", "Ito", "Jansen", "Kovac", "Lopez", "Meyer", "Novak", "Okafor", "Petrov"]
#: name, city, titles, least and most salary
DEPARTMENTS = [
    ("Engineering", "Berlin", ["Engineer", "Senior Engineer", "Architect"], 60_000, 160_000),
    ("Research", "Zurich", ["Scientist", "Analyst"], 65_000, 150_000),
    ("Sales", "Madrid", ["Representative", "Account Manager"], 40_000, 110_000),
    ("Support", "Lyon", ["Agent", "Team Lead"], 35_000, 80_000),
    ("Finance", "London", ["Accountant", "Controller"], 50_000, 130_000),
]


def _draw(key: str, seed: int, salt: str) -> Column:
    """A number in [0, 1) that a row's key decides, so that reruns agree."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def _pick(values: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(draw * len(values)) + 1).cast("int"))


def company(spark: SparkSession, employees: int = 500, seed: int = 0) -> dict[str, DataFrame]:
    """locations, departments, employees (a third remote; a manager other than
    themselves) and reviews (one to three each, scores 2.5 to 5)."""
    locations = spark.createDataFrame([(i + 1, d[1]) for i, d in enumerate(DEPARTMENTS)], "id long, city string")
    departments = spark.createDataFrame([(i + 1, d[0], i + 1) for i, d in enumerate(DEPARTMENTS)], "id long, name string, location_id long")
    band = F.array(*[F.struct(F.array(*[F.lit(t) for t in d[2]]).alias("titles"), F.lit(float(d[3])).alias("low"), F.lit(float(d[4])).alias("high")) for d in DEPARTMENTS])
    rows = spark.range(1, employees + 1).withColumn("department_id", F.floor(_draw("id", seed, "department") * len(DEPARTMENTS)) + 1)
    rows = rows.withColumn("band", F.element_at(band, F.col("department_id").cast("int")))
    rows = rows.withColumn("first", _pick(FIRST, _draw("id", seed, "first"))).withColumn("last", _pick(LAST, _draw("id", seed, "last")))
    again = F.row_number().over(Window.partitionBy("first", "last").orderBy("id")) - 1
    title = F.element_at("band.titles", (F.floor(_draw("id", seed, "title") * F.size("band.titles")) + 1).cast("int"))
    manager = F.pmod(F.col("id") + F.floor(_draw("id", seed, "manager") * (employees - 1)), F.lit(employees)) + 1
    people = rows.select(
        "id",
        F.concat_ws(" ", "first", "last").alias("name"),
        F.concat(F.lower(F.concat_ws(".", "first", "last")), F.when(again > 0, again.cast("string")).otherwise(""), F.lit("@example.com")).alias("email"),
        title.alias("job_title"),
        "department_id",
        F.when(F.lit(employees > 1), manager).alias("manager_id"),
        F.round(F.col("band.low") + _draw("id", seed, "salary") * (F.col("band.high") - F.col("band.low")), 2).alias("salary"),
        F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), F.floor(_draw("id", seed, "hired") * 3000).cast("int")), "yyyy-MM-dd").alias("hire_date"),
        (_draw("id", seed, "remote") < 1 / 3).cast("int").alias("is_remote"),
    )
    many = (F.floor(_draw("id", seed, "reviews") * 3) + 1).cast("int")
    reviews = people.select("id", "hire_date", F.explode(F.sequence(F.lit(1), many)).alias("n")).withColumn("key", F.col("id") * 3 + F.col("n") - 1)
    reviews = reviews.select(
        F.col("key").alias("id"),
        F.col("id").alias("employee_id"),
        F.date_format(F.date_add(F.col("hire_date").cast("date"), (180 * F.col("n") + F.floor(_draw("key", seed, "day") * 90)).cast("int")), "yyyy-MM-dd").alias("review_date"),
        F.round(2.5 + 2.5 * _draw("key", seed, "score"), 1).alias("score"),
    )
    return {"locations": locations, "departments": departments, "employees": people, "reviews": reviews}
