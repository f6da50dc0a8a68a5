"""Invariants of the pipeline and its run report."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """An invariant doesn't hold."""


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """`df` itself; CheckFailed if `key` is null or repeated anywhere. One aggregate per key, combined before the shuffle."""
    nulls, repeats = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)), F.count_if((F.col("n") > 1) & F.col(key).isNotNull())).first()
    if nulls or repeats:
        raise CheckFailed(f"{key}: {nulls} rows without a value, {repeats} repeated values")
    return df


def conservation(before: DataFrame, after: DataFrame, total: str = "total") -> DataFrame:
    """One row (before, after, holds): whether the sums of two tables are equal; empty tables sum to 0."""
    sums = [F.coalesce(F.sum(total), F.lit(0)).cast("long") for _ in range(2)]
    out = before.agg(sums[0].alias("before")).withColumn("after", after.agg(sums[1]).scalar())
    return out.withColumn("holds", F.col("before") == F.col("after"))


def mapping_checks(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """(check, violations) of a canonical mapping (name, category, final, total) made from members (name, category, total).

    conservation: difference of the sums of mentions; missing and extra: pairs (name, category) on one side only; null_final: pairs
    without a final name; repeated: pairs that stand more than once. All are 0 for a mapping that is whole.
    """
    pairs = ["name", "category"]
    sums = conservation(members, mapping).select(F.lit("conservation").alias("check"), F.abs(F.col("before") - F.col("after")).alias("violations"))
    lost = members.select(*pairs).distinct().exceptAll(mapping.select(*pairs).distinct())
    new = mapping.select(*pairs).distinct().exceptAll(members.select(*pairs).distinct())
    repeated = mapping.groupBy(*pairs).count().filter("count > 1")
    out = sums
    for name, rows in (("missing", lost), ("extra", new), ("null_final", mapping.filter("final is null")), ("repeated", repeated)):
        out = out.unionByName(rows.agg(F.lit(name).alias("check"), F.count("*").alias("violations")))
    return out


def require(checks: DataFrame) -> None:
    """CheckFailed with the checks that have violations."""
    broken = [f"{r[0]}: {r[1]}" for r in checks.filter("violations > 0").orderBy("check").collect()]  # one row per check
    if broken:
        raise CheckFailed("; ".join(broken))


def canonical_collisions(summary: DataFrame) -> DataFrame:
    """(canonical, clusters): canonical names that two or more clusters share, ignoring case and blanks at their ends."""
    return summary.groupBy(F.lower(F.trim("canonical")).alias("canonical")).agg(F.count("*").alias("clusters")).filter("clusters > 1")


def config_hash(config: dict) -> str:
    """The first 16 hex digits of the sha256 of a configuration's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def run_report(members: DataFrame, summary: DataFrame, config: dict) -> DataFrame:
    """One row: mentions, names and (name, category) keys before; clusters, cross-category ones, ties, buckets and final names after; the hash of `config`."""
    before = members.agg(F.sum("total").alias("mentions"), F.countDistinct("name").alias("names"), F.count("*").alias("keys"))
    after = summary.agg(
        F.count("*").alias("clusters"), F.count_if("cross_category").alias("cross_category"), F.count_if("tie").alias("ties"), F.count_if(F.col("final").endswith(" Other")).alias("other_bucket"),
        F.countDistinct("final").alias("finals"),
    )
    names = ("clusters", "cross_category", "ties", "other_bucket", "finals")
    out = before
    for n in names:
        out = out.withColumn(n, after.select(n).scalar())
    return out.withColumn("config_hash", F.lit(config_hash(config)))
