"""Readers of the pipeline's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKILL_FIELDS = ("skill_name", "label", "category", "min_years", "level", "source_text")
SKILLS = "array<struct<skill_name:string,label:string,category:string,min_years:string,level:string>>"


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None, all_strings: bool = False) -> DataFrame:
    """A CSV table with a header, quoted line ends and doubled quotes; a byte-order mark before the header is dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", not all_strings).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a DDL schema; blank and malformed lines are skipped."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"\S"))
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return parsed.filter("x is not null and x._bad is null").select("x.*").drop("_bad")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one JSON array each, bare NaN read as null; adds pos, the index in the array."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?<=[:,\[\s])NaN(?=\s*[,}\]])", "null").alias("value"))
    return text.select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("pos", "x")).select("pos", "x.*")


def human_annotations(spark: SparkSession, path: str, annotator: str) -> DataFrame:
    """(record_id, annotator, skills) of a JSON array; a missing id is the running index, skills without a name go."""
    rows = json_array(spark, path, f"id:string,skills:{SKILLS}")
    return rows.select(F.coalesce("id", F.col("pos").cast("string")).alias("record_id"), F.lit(annotator).alias("annotator"), F.filter("skills", lambda s: F.trim(s["skill_name"]) != "").alias("skills"))


def unified_annotations(spark: SparkSession, path: str, annotator: str | None = None) -> DataFrame:
    """(record_id, annotator, skills) of JSON lines whose skills are a list or an object with a list; the annotator is the argument, the record's or "unknown"."""
    rows = jsonl(spark, path, "record_id string, annotator string, skills string")
    skills = F.coalesce(F.from_json("skills", SKILLS), F.from_json("skills", f"struct<skills:{SKILLS}>")["skills"])
    listed = F.when(F.trim("skills").startswith("{"), F.from_json("skills", f"struct<skills:{SKILLS}>")["skills"]).otherwise(skills)
    return rows.select("record_id", F.coalesce(F.lit(annotator), "annotator", F.lit("unknown")).alias("annotator"), listed.alias("skills"))


def flat_annotations(spark: SparkSession, path: str, annotator: str) -> DataFrame:
    """(record_id, annotator, skills) of a CSV with one skill a row; headers in any case, id column row_id or id."""
    df = csv(spark, path, all_strings=True)
    df = df.toDF(*(c.strip().lower() for c in df.columns))
    key = next((c for c in ("row_id", "id") if c in df.columns), None)
    if key is None:
        raise ValueError("neither row_id nor id among the columns")
    one = F.struct(F.monotonically_increasing_id().alias("ord"), *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in SKILL_FIELDS[:5]))
    grouped = df.select(F.col(key).alias("record_id"), one.alias("s")).groupBy("record_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return grouped.select("record_id", F.lit(annotator).alias("annotator"), F.transform("s", lambda s: s.dropFields("ord")).alias("skills"))


def annotations(spark: SparkSession, path: str, annotator: str) -> DataFrame:
    """Annotations by the file's suffix: .csv, .json, .jsonl or .ndjson."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return flat_annotations(spark, path, annotator)
    if suffix == "json":
        return human_annotations(spark, path, annotator)
    if suffix in ("jsonl", "ndjson"):
        return unified_annotations(spark, path, annotator)
    raise ValueError(f"unknown format: .{suffix}")


def _yaml_documents(spark: SparkSession, path: str) -> list:
    """The YAML document of each file under a path, in order of their names; a vocabulary, read by the driver."""
    import yaml

    files = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value").orderBy("file_path").collect()
    return [yaml.safe_load(r.value) for r in files]


def alias_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(ord, canonical, variants) of the lists `aliases` of all YAML files under a path, later files after earlier ones."""
    groups = [g for d in _yaml_documents(spark, path) if isinstance(d, dict) and isinstance(d.get("aliases"), list) for g in d["aliases"]]
    rows = [(i, str(g["canonical"]), [str(v) for v in g.get("variants") or []]) for i, g in enumerate(groups) if isinstance(g, dict) and g.get("canonical")]
    return spark.createDataFrame(rows, "ord int, canonical string, variants array<string>")


def alias_map(groups: DataFrame) -> DataFrame:
    """(variant, canonical) of groups (ord, canonical, variants): a variant equal to its canonical goes, the last group wins a variant."""
    each = groups.select("ord", "canonical", F.explode("variants").alias("variant")).filter((F.col("variant") != F.col("canonical")) & (F.col("canonical") != ""))
    return each.groupBy("variant").agg(F.max_by("canonical", F.struct("ord", "canonical")).alias("canonical"))


def category_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(final, category) of YAML files that map names to categories, the names lower case without blanks at their ends; later files win."""
    found = {str(k).strip().lower(): str(v) for d in _yaml_documents(spark, path) if isinstance(d, dict) for k, v in d.items() if v is not None}
    return spark.createDataFrame(sorted(found.items()), "final string, category string")


def role_list(spark: SparkSession, path: str) -> DataFrame:
    """(role): lines of a text file without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("role")).filter((F.col("role") != "") & ~F.col("role").startswith("#"))


def last_by_id(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """A checkpoint (JSON array) by id, the last entry of an id wins."""
    rows = json_array(spark, path, schema)
    rest = [c for c in rows.columns if c not in (key, "pos")]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), "pos").alias("x")).select(key, "x.*")


def numeric_ids_to_urls(answers: DataFrame, jobs: DataFrame, key: str = "id") -> DataFrame:
    """`answers` whose id is a row number of `jobs` (row, url) get the url as id."""
    named = jobs.select(F.col("row").cast("string").alias("__row"), F.col("url").alias("__url"))
    j = answers.join(named, answers[key] == F.col("__row"), "left")
    return j.select(*(F.coalesce("__url", answers[key]).alias(key) if c == key else answers[c] for c in answers.columns))
