"""Queries of the general training-data problems (the others live in the subpackage for text)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import merge_intervals
from ..session import table


def role_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as closed month intervals (year * 12 + month - 1); current ones last to the month of the screening."""
    month = lambda y, m: F.col(y) * 12 + F.coalesce(F.col(m), F.lit(1)) - 1
    roles = table(spark, sf_dir, "experience").select("candidate_id", "batch_id", "start_year", "start_month", "end_year", "end_month", "is_current")
    screened = table(spark, sf_dir, "batches").select("batch_id", (F.year("screened_at") * 12 + F.month("screened_at") - 1).alias("now"))
    return roles.join(screened, "batch_id", "left").select(
        "candidate_id",
        month("start_year", "start_month").alias("a"),
        F.when(F.coalesce("is_current", F.lit(False)), F.col("now")).otherwise(month("end_year", "end_month")).alias("b"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = merge_intervals(role_months(spark, sf_dir), "candidate_id", "a", "b")
    return periods.select("candidate_id", "kind", F.col("from_at").cast("int").alias("from_month"), F.col("to_at").cast("int").alias("to_month"))


P1_SQL = """
WITH spans AS (
  SELECT e.candidate_id, e.start_year * 12 + coalesce(e.start_month, 1) - 1 AS a,
         CASE WHEN coalesce(e.is_current, false) THEN year(b.screened_at) * 12 + month(b.screened_at) - 1
              ELSE e.end_year * 12 + coalesce(e.end_month, 1) - 1 END AS z
  FROM experience e LEFT JOIN batches b ON e.batch_id = b.batch_id
), ok AS (SELECT * FROM spans WHERE candidate_id IS NOT NULL AND a <= z),
far AS (SELECT *, max(z) OVER (PARTITION BY candidate_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ok),
isle AS (SELECT *, sum(CASE WHEN top IS NULL OR a > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS n FROM far),
period AS (SELECT candidate_id, n, min(a) AS a, max(z) AS z FROM isle GROUP BY candidate_id, n),
gap AS (SELECT candidate_id, lag(z) OVER (PARTITION BY candidate_id ORDER BY a) + 1 AS a, a - 1 AS z FROM period)
SELECT candidate_id, 'period' AS kind, CAST(a AS INTEGER) AS from_month, CAST(z AS INTEGER) AS to_month FROM period
UNION ALL SELECT candidate_id, 'gap', CAST(a AS INTEGER), CAST(z AS INTEGER) FROM gap WHERE a IS NOT NULL
"""

QUERIES = {"p1_found": p1_found}
ORACLES = {"p1_found": P1_SQL}
