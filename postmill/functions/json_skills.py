"""Skill lists in JSON written by language models: fences, repair, coercion and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import blank

SKILL = "struct<skill_name:string,label:string,category:string,min_years:string,level:string,source_text:string>"
OBJECT, LIST = f"struct<skills:array<{SKILL}>>", f"array<{SKILL}>"
#: Allowed values. Fixed values.
LABELS, LEVELS = ("required_skill", "preferred_skill"), ("expert", "intermediate", "basic")


def unfence(raw: Column) -> Column:
    """A text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?is)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def parse_skills(text: Column, list_root: bool = True) -> Column:
    """The skills of a JSON object, or with `list_root` of a list; null where neither can be read."""
    found = F.from_json(text, OBJECT)["skills"]
    return F.coalesce(found, F.when(text.rlike(r"^\s*\["), F.from_json(text, LIST))) if list_root else found


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def closed(text: Column) -> Column:
    """A truncated list cut after its last complete element and closed."""
    head = F.regexp_extract(text, r"(?s)^(.*\})\s*(?:,|$)", 1)
    complete = F.regexp_extract(text, r"(?s)^(.*?\{.*\})\s*,?\s*\{[^{}]*$", 1)
    return F.concat(F.when(complete != "", complete).otherwise(head), F.lit("]}"))


def coerce(skills: Column) -> Column:
    """Skills with an unknown label as required_skill, an unknown level as null and years as a rounded integer."""

    def one(s: Column) -> Column:
        years = F.bround(s["min_years"].try_cast("double"), 0).cast("int")
        return F.struct(
            s["skill_name"].alias("skill_name"), F.when(s["label"].isin(*LABELS), s["label"]).otherwise(LABELS[0]).alias("label"), s["category"].alias("category"),
            years.alias("min_years"), F.when(s["level"].isin(*LEVELS), s["level"]).alias("level"), s["source_text"].alias("source_text"),
        )

    return F.transform(skills, one)


def parse_log(log: DataFrame, keep: list[str], list_root: bool = True) -> DataFrame:
    """`keep` columns, status and skills of each entry (raw_text, error) of an extraction log.

    status: "ok", "repaired" (after dropping commas or closing a truncated list), "no_text" (nothing to parse,
    the entry's error stands) or "unparsable". A text that parses wins over a recorded error.
    """
    text = unfence(F.col("raw_text"))
    plain = parse_skills(text, list_root)
    lean = parse_skills(without_trailing_commas(text), list_root)
    cut = parse_skills(without_trailing_commas(closed(text)), list_root)
    rows = log.select(*keep, "raw_text", "error", plain.alias("p"), lean.alias("l"), cut.alias("c"))
    ok = F.col("p").isNotNull()
    status = F.when(blank(F.col("raw_text")), "no_text").when(ok, "ok").when(F.col("l").isNotNull() | F.col("c").isNotNull(), "repaired").otherwise("unparsable")
    return rows.select(*keep, status.alias("status"), coerce(F.coalesce("p", "l", "c")).alias("skills"))


def flatten(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per skill of the entries that could be read."""
    return parsed.filter(F.col("status").isin("ok", "repaired")).select(*keep, F.explode("skills").alias("s")).select(*keep, "s.*")


def errors(parsed: DataFrame, keep: list[str]) -> DataFrame:
    return parsed.filter(~F.col("status").isin("ok", "repaired")).select(*keep, "status")


def strict_skills(skills: Column) -> Column:
    """`skills` where every element has a name, an allowed label, a category and an allowed or no level; null where one hasn't: a bad element rejects all."""

    def good(s: Column) -> Column:
        return ~blank(s["skill_name"]) & s["label"].isin(*LABELS) & s["category"].isNotNull() & (s["level"].isNull() | s["level"].isin(*LEVELS)) & (s["min_years"].isNull() | s["min_years"].try_cast("double").isNotNull())

    return F.when(F.forall(skills, lambda s: F.coalesce(good(s), F.lit(False))), skills)


def validate_log(log: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, level and skills of each entry (raw_text): "direct" if it is valid as it stands, "repaired" if after the repair of its text, "coerced" if only with
    unknown values replaced, else "rejected" without skills."""
    text = unfence(F.col("raw_text"))
    rows = log.select(*keep, parse_skills(text).alias("p"), F.coalesce(parse_skills(without_trailing_commas(text)), parse_skills(without_trailing_commas(closed(text)))).alias("r"))
    rows = rows.select(*keep, strict_skills(F.col("p")).alias("direct"), strict_skills(F.col("r")).alias("repaired"), coerce(F.coalesce("r", "p")).alias("coerced"))
    coerced = lambda c: F.transform(c, lambda s: F.struct(s["skill_name"], s["label"], s["category"], F.bround(s["min_years"].try_cast("double"), 0).cast("int").alias("min_years"), s["level"], s["source_text"]))
    level = F.when(F.col("direct").isNotNull(), "direct").when(F.col("repaired").isNotNull(), "repaired").when(F.col("coerced").isNotNull(), "coerced").otherwise("rejected")
    return rows.select(*keep, level.alias("level"), F.coalesce(coerced(F.coalesce("direct", "repaired")), "coerced").alias("skills"))


def whole_years(years: Column) -> Column:
    """Years as written, cut to a whole number; null for anything else."""
    return years.try_cast("double").try_cast("int")


ANSWER = "array<struct<id:string,original:string,standardized_title:string,is_valid_job:boolean>>"


def title_answers(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """(batch_id, id, original, standardized_title, is_valid_job) of a model's answers to batches of titles.

    `answers`: batch_id, raw_text (a JSON list, fenced or not; what can't be read gives no rows). `asked`: batch_id, id, title. An answer without id takes the
    smallest id of its batch whose title is its original; one without original takes the title of its id.
    """
    text = F.regexp_replace(unfence(F.col("raw_text")), r"(?i)^json\s*", "")
    each = answers.select("batch_id", F.explode(F.from_json(text, ANSWER)).alias("a")).select("batch_id", "a.*")
    by_title = asked.groupBy("batch_id", F.col("title").alias("original")).agg(F.min("id").alias("__id"))
    by_id = asked.groupBy("batch_id", F.col("id").cast("string").alias("id")).agg(F.min("title").alias("__title"))
    named = each.join(by_title, ["batch_id", "original"], "left").withColumn("id", F.coalesce("id", F.col("__id").cast("string"))).drop("__id")
    whole = named.join(by_id, ["batch_id", "id"], "left").withColumn("original", F.coalesce("original", "__title"))
    return whole.select("batch_id", "id", "original", "standardized_title", "is_valid_job")


def yaml_aliases(answer: str | None) -> list[dict]:
    """The groups under `aliases` of a model's YAML answer, fenced or not; [] where the root is no mapping or holds no such list."""
    import re

    import yaml

    text = re.sub(r"\s*```\s*$", "", re.sub(r"^\s*```(?:ya?ml)?\s*", "", answer or "", flags=re.I))
    try:
        root = yaml.safe_load(text)
    except yaml.YAMLError:
        return []
    groups = root.get("aliases") if isinstance(root, dict) else None
    return [g for g in groups if isinstance(g, dict)] if isinstance(groups, list) else []
