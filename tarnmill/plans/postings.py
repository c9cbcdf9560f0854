"""A deterministic table of postings derived from ``documents``: plain arithmetic on doc_id picks each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = ["Senior ML Engineer", "Machine Learning Engineer", "Data Scientist (Remote)", "AI Engineer - NLP", "Backend Developer", "Position filled: SWE", "LLM Researcher", "Sales Manager"]
COMPANIES = ["Acme Corp", "Globex, Inc.", "Initech", "acme corp", "Umbrella-AI", "Unknown"]
LOCATIONS = ["Remote", "Berlin, Germany", "Worldwide", "Hybrid - London, UK", "San Francisco, CA", "On-site, Lahore", ""]
SALARIES = ["$150-200K", "$150,000 - $200,000", "₹25L-30L", "3.5 LPA", "$150 - $200 / year", "$100 - $150 / hr", "N/A", "£120k"]
POSTED = ["Posted 3 days ago", "2026-01-10", "yesterday", "30+ days ago", "6 hours ago", "garbage", "2026-01-12T04:12:00Z", "2 weeks ago", "just posted"]
TYPES = ["Full-time", "Part time", "Contract", "Freelance", "", "Permanent full"]


def _pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        d.alias("seq"), "source", _pick(TITLES, d).alias("title"), _pick(COMPANIES, F.floor(d / 8)).alias("company"),
        F.concat(F.lit("https://jobs.example/view/"), (d % 500).cast("string"), F.lit("?ref="), F.col("source")).alias("url"),
        _pick(LOCATIONS, F.floor(d / 3)).alias("location"), _pick(SALARIES, d).alias("salary"), _pick(POSTED, d).alias("posted_date"),
        F.col("text").alias("description"), _pick(TYPES, d).alias("job_type"),
        (F.lit("2026-01-05").cast("timestamp") + F.make_dt_interval(hours=(d % 300).cast("int"))).alias("fetched_at"),
    )


def _sql_pick(values: list[str], by: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({by}) % {len(values)} + 1]"


POSTINGS_SQL = f"""postings AS (
  SELECT doc_id AS seq, source, {_sql_pick(TITLES, 'doc_id')} AS title, {_sql_pick(COMPANIES, 'doc_id // 8')} AS company,
    'https://jobs.example/view/' || (doc_id % 500) || '?ref=' || source AS url, {_sql_pick(LOCATIONS, 'doc_id // 3')} AS location,
    {_sql_pick(SALARIES, 'doc_id')} AS salary, {_sql_pick(POSTED, 'doc_id')} AS posted_date, text AS description,
    {_sql_pick(TYPES, 'doc_id')} AS job_type, TIMESTAMP '2026-01-05' + INTERVAL 1 HOUR * (doc_id % 300) AS fetched_at
  FROM documents)"""
