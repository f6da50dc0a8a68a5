"""Queries of the general training-data problems (1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.packed import unpack
from postmill.operators.pay import TARGET, monthly_kvnd, pay_units
from postmill.session import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Every posting of either board whose salary states an amount, in thousand VND a month."""
    columns = ["posting_id", "salary", "job_description"]
    both = table(spark, base, "raw_jobs_itviec").select(columns).unionByName(table(spark, base, "raw_jobs_topcv").select(columns))
    paid = monthly_kvnd(both.filter(F.col("salary").rlike(r"\d")), table(spark, base, "unit_factors"))
    return paid.filter(F.col("low_kvnd").isNotNull()).select("posting_id", "low_kvnd", "high_kvnd").distinct()


def p1_conversions(spark: SparkSession, base: str) -> DataFrame:
    """Every unit of pay with the thousand VND a month that one of it makes, from the graph of units."""
    rows = [tuple(r) for r in table(spark, base, "unit_factors").select("unit", "kind", "numer", "denom").collect()]  # a table of units
    return pay_units(rows).table(spark, [TARGET]).select("unit", F.round(F.col("mul_numer") / F.col("mul_denom"), 9).alias("factor"), "add_numer")


def p1_unread(spark: SparkSession, base: str) -> DataFrame:
    """Salaries with a digit whose amount or unit couldn't be told, which p1_found therefore leaves out, by board."""
    parts = []
    for name in ("itviec", "topcv"):
        jobs = table(spark, base, f"raw_jobs_{name}").select("posting_id", "salary", "job_description").filter(F.col("salary").rlike(r"\d"))
        paid = monthly_kvnd(jobs, table(spark, base, "unit_factors"))
        parts.append(paid.filter(F.col("low_kvnd").isNull()).select(F.lit(name).alias("source"), "salary"))
    return parts[0].unionByName(parts[1]).groupBy("source", "salary").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """One row per value of required_skills and location of raw_jobs_itviec, with its position."""
    jobs = table(spark, base, "raw_jobs_itviec")
    return unpack(jobs, ["posting_id"], ["required_skills", "location"]).select("posting_id", "field", "pos", "value").distinct()


QUERIES = {"p1_found": p1_found, "p1_conversions": p1_conversions, "p1_unread": p1_unread, "p4_found": p4_found}
