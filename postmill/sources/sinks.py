"""Writers of results; all write through Spark in parallel unless one file is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import file_name

#: Groups of a vocabulary that is written as one file.
MAX_VOCABULARY = 1_000_000


def csv(df: DataFrame, path: str, quote_all: bool = False, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", quote_all).csv(path)


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def json_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, errors_path: str | None = None, error: str = "error") -> None:
    """Append entries as JSON lines; failed ones to a second log as well."""
    df.write.mode("append").json(path)
    if errors_path is not None:
        df.filter(F.col(error).isNotNull()).write.mode("append").json(errors_path)


def by_category(df: DataFrame, path: str, category: str = "category") -> None:
    """A folder per category, named so that any file system can hold it."""
    df.withColumn("__folder", file_name(F.coalesce(F.col(category), F.lit("Other")))).write.mode("overwrite").partitionBy("__folder").option("header", True).csv(path)


def drop_report(dropped: DataFrame, reason: str = "reason", title: str = "job_title") -> DataFrame:
    """(reason, title, rows): the distinct dropped titles of each reason with their rows, in order of reason and title."""
    return dropped.groupBy(reason, title).agg(F.count("*").alias("rows")).orderBy(reason, title)


def yaml_aliases(groups: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Alias groups (canonical, variants) as one YAML text with metadata and the list `aliases`, in order of canonical.

    A vocabulary: above MAX_VOCABULARY groups it is refused.
    """
    import yaml

    rows = groups.select("canonical", "variants").orderBy("canonical").limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} alias groups")
    text = yaml.safe_dump({"metadata": metadata or {}, "aliases": [{"canonical": r[0], "variants": list(r[1] or [])} for r in rows]}, allow_unicode=True, sort_keys=False)
    groups.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="")


def report(df: DataFrame) -> DataFrame:
    """One row of a report as JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("report"))
