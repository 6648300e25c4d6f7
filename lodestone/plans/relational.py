"""Relational queries over the test tables: customers stand for employees,
nations for departments, regions for locations and orders for reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..tables import table


def frames(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    employees = customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.col("c_mktsegment").alias("job_title"),
        F.col("c_nationkey").alias("department_id"),
        F.expr("CASE WHEN c_custkey >= 10 THEN c_custkey div 10 END").alias("manager_id"),
        F.col("c_acctbal").alias("salary"),
        F.expr("date_format(date_add(DATE '2015-01-01', cast(c_custkey % 3000 AS INT)), 'yyyy-MM-dd')").alias("hire_date"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("is_remote"),
    )
    departments = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("location_id"))
    locations = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("city"))
    reviews = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("employee_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("review_date"), F.col("o_totalprice").alias("score"))
    return employees, departments, locations, reviews


HR = """
WITH locations AS (SELECT r_regionkey AS id, r_name AS city FROM region),
departments AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS location_id FROM nation),
employees AS (
  SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email, c_mktsegment AS job_title,
         c_nationkey AS department_id, CASE WHEN c_custkey >= 10 THEN c_custkey // 10 END AS manager_id, c_acctbal AS salary,
         strftime(DATE '2015-01-01' + (c_custkey % 3000)::INT, '%Y-%m-%d') AS hire_date,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_remote
  FROM customer),
reviews AS (SELECT o_orderkey AS id, o_custkey AS employee_id, strftime(o_orderdate, '%Y-%m-%d') AS review_date, o_totalprice AS score FROM orders)
"""

QUERIES = {
    "rel_employee_directory": lambda s, d: R.directory(*frames(s, d)[:3]),
    "rel_by_department": lambda s, d: R.by_department(*frames(s, d)[:2], "NATION_7"),
    "rel_headcount": lambda s, d: R.headcount(*frames(s, d)[:2]).withColumn("total_payroll", F.round("total_payroll", 2)),
    "rel_conditional_count": lambda s, d: R.remote_split(*frames(s, d)[:2]),
    "rel_per_year": lambda s, d: R.hires_per_year(frames(s, d)[0]),
    "rel_rank": lambda s, d: R.salary_rank(*frames(s, d)[:2]),
    "rel_top3": lambda s, d: R.top_earners(*frames(s, d)[:2]),
    "rel_vs_avg": lambda s, d: R.versus_average(*frames(s, d)[:2]),
    "rel_running_total": lambda s, d: R.payroll_by_hire_date(frames(s, d)[0]),
    "rel_above_avg": lambda s, d: R.above_average(*frames(s, d)[:2]),
    "rel_latest_review": lambda s, d: (lambda e, p, _, r: R.latest_reviews(e, p, r))(*frames(s, d)),
    "rel_review_by_department": lambda s, d: (lambda e, p, _, r: R.reviews_by_department(e, p, r))(*frames(s, d)),
    "rel_salary_steps": lambda s, d: R.salary_steps(*frames(s, d)[:2]),
    "rel_department_best": lambda s, d: R.department_best(*frames(s, d)[:2]),
    "rel_payroll_share": lambda s, d: R.payroll_share(*frames(s, d)[:2]),
    "rel_matching": lambda s, d: R.matching(frames(s, d)[0], "%7%", ["BUILDING", "MACHINERY"], 0, 5000).select("id", "name", "job_title", "salary"),
    "rel_managers_updated": lambda s, d: (lambda e: R.with_managers(e, e.filter("id % 5 = 0").select("id", (F.col("id") + 1).alias("manager_id"))))(frames(s, d)[0]).select("id", "manager_id"),
}

RANKED = HR + "SELECT e.name, d.name AS department, e.salary, rank() OVER (PARTITION BY e.department_id ORDER BY e.salary DESC) AS dept_salary_rank FROM employees e JOIN departments d ON e.department_id = d.id"

SQL = {
    "rel_employee_directory": HR + """SELECT e.id, e.name, e.email, e.job_title, d.name AS department, l.city AS office_city, m.name AS manager_name, e.salary, e.hire_date,
        CASE e.is_remote WHEN 1 THEN 'Yes' ELSE 'No' END AS remote
        FROM employees e JOIN departments d ON e.department_id = d.id JOIN locations l ON d.location_id = l.id LEFT JOIN employees m ON e.manager_id = m.id""",
    "rel_by_department": HR + "SELECT e.name, e.job_title, e.salary, e.hire_date FROM employees e JOIN departments d ON e.department_id = d.id WHERE d.name = 'NATION_7'",
    "rel_headcount": HR + """SELECT d.name AS department, count(e.id) AS headcount, round(avg(e.salary), 2) AS avg_salary, min(e.salary) AS min_salary, max(e.salary) AS max_salary,
        round(sum(e.salary), 2) AS total_payroll FROM employees e JOIN departments d ON e.department_id = d.id GROUP BY d.name HAVING count(e.id) > 0""",
    "rel_conditional_count": HR + """SELECT d.name AS department, count(CASE WHEN e.is_remote = 1 THEN 1 END) AS remote_count, count(CASE WHEN e.is_remote = 0 THEN 1 END) AS office_count,
        count(e.id) AS total FROM employees e JOIN departments d ON e.department_id = d.id GROUP BY d.name""",
    "rel_per_year": HR + "SELECT substr(hire_date, 1, 4) AS year, count(*) AS hires FROM employees GROUP BY 1",
    "rel_rank": RANKED,
    "rel_top3": f"SELECT * FROM ({RANKED}) WHERE dept_salary_rank <= 3",
    "rel_vs_avg": HR + """SELECT e.name, d.name AS department, e.salary, round(avg(e.salary) OVER (PARTITION BY e.department_id), 2) AS dept_avg_salary,
        round(e.salary - avg(e.salary) OVER (PARTITION BY e.department_id), 2) AS diff_from_avg FROM employees e JOIN departments d ON e.department_id = d.id""",
    "rel_running_total": HR + "SELECT hire_date, name, salary, round(sum(salary) OVER (ORDER BY hire_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_payroll_total FROM employees",
    "rel_above_avg": HR + """SELECT d.name AS department, round(avg(e.salary), 2) AS avg_salary FROM employees e JOIN departments d ON e.department_id = d.id
        GROUP BY d.name HAVING avg(e.salary) > (SELECT avg(salary) FROM employees)""",
    "rel_latest_review": HR + """SELECT e.name, d.name AS department, e.salary, r.score AS latest_review_score, r.review_date
        FROM employees e JOIN departments d ON e.department_id = d.id JOIN reviews r ON r.employee_id = e.id
        WHERE r.review_date = (SELECT max(review_date) FROM reviews x WHERE x.employee_id = e.id) ORDER BY r.score DESC, r.id LIMIT 50""",
    "rel_review_by_department": HR + """SELECT d.name AS department, count(DISTINCT e.id) AS employees_reviewed, round(avg(r.score), 2) AS avg_review_score, min(r.score) AS lowest_score,
        max(r.score) AS highest_score FROM reviews r JOIN employees e ON r.employee_id = e.id JOIN departments d ON e.department_id = d.id GROUP BY d.name""",
    "rel_salary_steps": HR + """SELECT e.id, d.name AS department, e.salary, row_number() OVER w AS place, dense_rank() OVER (PARTITION BY e.department_id ORDER BY e.salary DESC) AS dense,
        lag(e.salary) OVER w AS above, lead(e.salary) OVER w AS below FROM employees e JOIN departments d ON e.department_id = d.id WINDOW w AS (PARTITION BY e.department_id ORDER BY e.salary DESC, e.id)""",
    "rel_department_best": HR + """SELECT e.id, e.name, d.name AS department, e.salary FROM employees e JOIN departments d ON e.department_id = d.id
        WHERE e.salary = (SELECT max(salary) FROM employees x WHERE x.department_id = e.department_id)""",
    "rel_payroll_share": HR + """, totals AS (SELECT d.name AS department, sum(e.salary) AS payroll FROM employees e JOIN departments d ON e.department_id = d.id GROUP BY 1)
        SELECT department, round(payroll * 100 / (SELECT sum(payroll) FROM totals), 4) AS payroll_pct FROM totals""",
    "rel_matching": HR + "SELECT id, name, job_title, salary FROM employees WHERE name LIKE '%7%' AND job_title IN ('BUILDING', 'MACHINERY') AND salary BETWEEN 0 AND 5000",
    "rel_managers_updated": HR + "SELECT id, CASE WHEN id % 5 = 0 THEN id + 1 ELSE manager_id END AS manager_id FROM employees",
}
