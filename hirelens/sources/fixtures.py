"""The domain's tables as views of the given ones, over all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hirelens.sources.store import shared_folder, staged  # noqa: F401

#: Accepted unchanged by Spark SQL and DuckDB.
JOBS = """SELECT o_orderkey AS job_id,
  concat('src', CAST(o_custkey % 20 AS VARCHAR(10))) AS source_id,
  concat('ext-', CAST(o_orderkey % 4000 AS VARCHAR(10))) AS external_job_id,
  concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'Senior ' WHEN '2-HIGH' THEN 'Lead '
           WHEN '3-MEDIUM' THEN 'Junior ' ELSE '' END,
         CASE o_orderkey % 5 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Data Scientist'
           WHEN 2 THEN 'Treasury Analyst' WHEN 3 THEN 'Sales Executive' ELSE 'Gardener' END) AS title,
  concat('Role ', CAST(o_orderkey % 97 AS VARCHAR(10)), chr(10),
         'Needs ', CAST(o_custkey % 12 AS VARCHAR(10)), '+ years of experience', chr(10),
         CASE o_orderkey % 4 WHEN 0 THEN 'Bachelor degree required'
           WHEN 1 THEN 'Master or PhD degree preferred' WHEN 2 THEN 'No degree needed'
           ELSE 'Great team' END, chr(10),
         CASE o_custkey % 3 WHEN 0 THEN 'We are unable to sponsor visas'
           WHEN 1 THEN 'Visa: we will sponsor' ELSE 'Apply now' END) AS description_plain,
  CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE -1 END AS min_degree_rank,
  o_custkey % 12 AS jd_experience_years,
  CASE o_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS sponsorship_not_available,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status,
  o_orderdate AS last_seen_at, o_custkey, o_orderpriority
FROM {orders}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOBS, orders=table(spark, sf_dir, "orders"))


JOBS_SQL = JOBS.format(orders="orders")
