"""Analytics over employees, departments, locations and reviews.

Frames: employees(id, name, email, job_title, department_id, manager_id,
salary, hire_date 'YYYY-MM-DD', is_remote 0/1), departments(id, name,
location_id), locations(id, city), reviews(id, employee_id, review_date,
score). Joins are left to Catalyst, which broadcasts the dimensions where
their statistics allow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _staffed(employees: DataFrame, departments: DataFrame) -> DataFrame:
    named = departments.select(F.col("id").alias("department_id"), F.col("name").alias("department"), "location_id")
    return employees.join(named, "department_id")


def directory(employees: DataFrame, departments: DataFrame, locations: DataFrame) -> DataFrame:
    """Employees with department, city and manager; no manager gives null."""
    managers = employees.select(F.col("id").alias("manager_id"), F.col("name").alias("manager_name"))
    places = locations.select(F.col("id").alias("location_id"), F.col("city").alias("office_city"))
    remote = F.when(F.col("is_remote") == 1, "Yes").otherwise("No").alias("remote")
    rows = _staffed(employees, departments).join(places, "location_id").join(managers, "manager_id", "left")
    return rows.select("id", "name", "email", "job_title", "department", "office_city", "manager_name", "salary", "hire_date", remote)


def by_department(employees: DataFrame, departments: DataFrame, department: str) -> DataFrame:
    return _staffed(employees, departments).filter(F.col("department") == department).select("name", "job_title", "salary", "hire_date").orderBy(F.desc("salary"))


def headcount(employees: DataFrame, departments: DataFrame) -> DataFrame:
    salary = F.col("salary")
    grouped = _staffed(employees, departments).groupBy("department").agg(
        F.count("id").alias("headcount"), F.round(F.avg(salary), 2).alias("avg_salary"), F.min(salary).alias("min_salary"), F.max(salary).alias("max_salary"), F.sum(salary).alias("total_payroll")
    )
    return grouped.filter("headcount > 0").orderBy(F.desc("avg_salary"))


def remote_split(employees: DataFrame, departments: DataFrame) -> DataFrame:
    grouped = _staffed(employees, departments).groupBy("department").agg(
        F.count_if(F.col("is_remote") == 1).alias("remote_count"), F.count_if(F.col("is_remote") == 0).alias("office_count"), F.count("id").alias("total")
    )
    return grouped.orderBy(F.desc("total"))


def hires_per_year(employees: DataFrame) -> DataFrame:
    return employees.groupBy(F.substring("hire_date", 1, 4).alias("year")).agg(F.count("*").alias("hires")).orderBy("year")


def salary_rank(employees: DataFrame, departments: DataFrame) -> DataFrame:
    order = Window.partitionBy("department_id").orderBy(F.desc("salary"))
    return _staffed(employees, departments).select("name", "department", "salary", F.rank().over(order).cast("long").alias("dept_salary_rank"))


def top_earners(employees: DataFrame, departments: DataFrame, n: int = 3) -> DataFrame:
    """Ranks up to n; ties can make more than n rows a department."""
    return salary_rank(employees, departments).filter(F.col("dept_salary_rank") <= n).orderBy("department", "dept_salary_rank")


def versus_average(employees: DataFrame, departments: DataFrame) -> DataFrame:
    average = F.avg("salary").over(Window.partitionBy("department_id"))
    return _staffed(employees, departments).select("name", "department", "salary", F.round(average, 2).alias("dept_avg_salary"), F.round(F.col("salary") - average, 2).alias("diff_from_avg"))


def payroll_by_hire_date(employees: DataFrame) -> DataFrame:
    """Running payroll by hire date, ids breaking ties.

    The sums of the days before come from a grouped table with a row a day, so
    that no window ever runs over all employees in one task.
    """
    days = employees.groupBy("hire_date").agg(F.sum("salary").alias("day"))
    before = Window.orderBy("hire_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("hire_date", F.coalesce(F.sum("day").over(before), F.lit(0.0)).alias("before"))
    inside = Window.partitionBy("hire_date").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.round(F.col("before") + F.sum("salary").over(inside), 2).alias("running_payroll_total")
    return employees.join(days, "hire_date").select("hire_date", "name", "salary", total)


def above_average(employees: DataFrame, departments: DataFrame) -> DataFrame:
    """Departments whose average salary exceeds that of all employees."""
    overall = employees.agg(F.avg("salary").alias("overall"))  # one row
    grouped = _staffed(employees, departments).groupBy("department").agg(F.avg("salary").alias("average"))
    return grouped.join(F.broadcast(overall), F.col("average") > F.col("overall")).select("department", F.round("average", 2).alias("avg_salary")).orderBy(F.desc("avg_salary"))


def latest_reviews(employees: DataFrame, departments: DataFrame, reviews: DataFrame, n: int | None = 50) -> DataFrame:
    """Reviews of each employee's last review date, all of them on a tie; the
    n best scores, ids breaking ties."""
    last = F.max("review_date").over(Window.partitionBy("employee_id"))
    newest = reviews.select(F.col("id").alias("review_id"), "employee_id", "review_date", "score", last.alias("last")).filter("review_date = last")
    rows = _staffed(employees, departments).join(newest, F.col("id") == F.col("employee_id"))
    rows = rows.orderBy(F.desc("score"), "review_id").select("name", "department", "salary", F.col("score").alias("latest_review_score"), "review_date")
    return rows if n is None else rows.limit(n)


def reviews_by_department(employees: DataFrame, departments: DataFrame, reviews: DataFrame) -> DataFrame:
    rows = reviews.select("employee_id", "score").join(_staffed(employees, departments), F.col("employee_id") == F.col("id"))
    grouped = rows.groupBy("department").agg(
        F.countDistinct("id").alias("employees_reviewed"), F.round(F.avg("score"), 2).alias("avg_review_score"), F.min("score").alias("lowest_score"), F.max("score").alias("highest_score")
    )
    return grouped.orderBy(F.desc("avg_review_score"))


def salary_steps(employees: DataFrame, departments: DataFrame) -> DataFrame:
    """Place, dense rank and the neighbouring salaries within a department, by
    falling salary; ids break the ties of places and neighbours."""
    order = Window.partitionBy("department_id").orderBy(F.desc("salary"), "id")
    dense = F.dense_rank().over(Window.partitionBy("department_id").orderBy(F.desc("salary")))
    return _staffed(employees, departments).select(
        "id", "department", "salary", F.row_number().over(order).cast("long").alias("place"), dense.cast("long").alias("dense"),
        F.lag("salary").over(order).alias("above"), F.lead("salary").over(order).alias("below"),
    )


def department_best(employees: DataFrame, departments: DataFrame) -> DataFrame:
    """Employees with the highest salary of their department, all on a tie."""
    best = employees.groupBy("department_id").agg(F.max("salary").alias("salary"))
    return _staffed(employees, departments).join(best, ["department_id", "salary"], "left_semi").select("id", "name", "department", "salary")


def payroll_share(employees: DataFrame, departments: DataFrame) -> DataFrame:
    """Each department's share of all payroll, in percent: totals as one common
    table, then set against their sum."""
    totals = _staffed(employees, departments).groupBy("department").agg(F.sum("salary").alias("payroll"))
    whole = totals.agg(F.sum("payroll").alias("whole"))  # one row
    share = F.round(F.try_divide(F.col("payroll") * 100.0, F.col("whole")), 4).alias("payroll_pct")
    return totals.crossJoin(F.broadcast(whole)).select("department", share)


def matching(employees: DataFrame, pattern: str | None = None, titles: list[str] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Employees by name (LIKE), job title (IN) and salary (both bounds count);
    what is not given is no condition."""
    if pattern:
        employees = employees.filter(F.col("name").like(pattern))
    if titles:
        employees = employees.filter(F.col("job_title").isin(titles))
    if low is not None:
        employees = employees.filter(F.col("salary") >= low)
    return employees if high is None else employees.filter(F.col("salary") <= high)


def with_managers(employees: DataFrame, managers: DataFrame) -> DataFrame:
    """Employees with manager_id from managers(id, manager_id) where given there."""
    new = managers.select("id", F.col("manager_id").alias("__new"))
    return employees.join(new, "id", "left").withColumn("manager_id", F.coalesce("__new", "manager_id")).select(*employees.columns)
