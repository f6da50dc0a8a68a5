"""Skill canonicalisation: aliases, clusters, votes, mappings and their checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.functions.json_skills import yaml_aliases
from postmill.functions.text import blank, category_key, is_ascii, skill_key
from postmill.operators.relational import batches
from postmill.session import checkpointed, round_checkpointed


class AliasCycle(ValueError):
    """Aliases lead back to themselves."""


def drop_reasons(mentions: DataFrame) -> DataFrame:
    """`mentions` with reason: "blank_skill", then "null_category", null where the row stays."""
    return mentions.withColumn("reason", F.when(blank(F.col("skill_name")), "blank_skill").when(F.col("category").isNull(), "null_category"))


def alias_edges(groups: DataFrame) -> DataFrame:
    """(variant, canonical) of groups (ord, canonical, variants): normalised, without self-maps; the last group wins a variant."""
    rows = groups.filter(~blank(F.col("canonical"))).select("ord", skill_key(F.col("canonical")).alias("canonical"), F.explode("variants").alias("v"))
    edges = rows.select("ord", "canonical", skill_key(F.col("v")).alias("variant")).filter((F.col("variant") != "") & (F.col("variant") != F.col("canonical")))
    return edges.groupBy("variant").agg(F.max_by("canonical", F.struct("ord", "canonical")).alias("canonical"))


def close_aliases(edges: DataFrame) -> DataFrame:
    """(variant, canonical) with chains of any length resolved by pointer jumping; `edges` has one row per variant.

    Each round doubles the links followed. Variants still on the way after more links than there are edges lead into a
    cycle: AliasCycle names up to three of them. An edge from a name to itself is a cycle too.
    """
    now = round_checkpointed(edges.select("variant", "canonical"))
    n = now.count()
    reach = 1
    while True:
        step = now.select(F.col("variant").alias("canonical"), F.col("canonical").alias("next"))
        joined = round_checkpointed(now.join(step, "canonical", "left").select("variant", F.coalesce("next", "canonical").alias("canonical"), F.col("next").isNotNull().alias("moved")))
        moving = joined.filter("moved")
        now = joined.select("variant", "canonical")
        if moving.isEmpty():
            return now
        if reach >= n:  # a name that leads on after so many links has passed some link twice
            found = [r[0] for r in moving.orderBy("variant").select("variant").limit(3).collect()]
            raise AliasCycle(f"aliases lead back to themselves: {', '.join(found)}")
        reach *= 2


def apply_aliases(mentions: DataFrame, closed: DataFrame, skill: str = "skill") -> DataFrame:
    """`mentions` with `skill` replaced by its canonical name where it has one."""
    m = closed.select(F.col("variant").alias("__v"), F.col("canonical").alias("__c"))
    joined = mentions.join(m, mentions[skill] == F.col("__v"), "left")
    return joined.select(*(F.coalesce(F.col("__c"), mentions[skill]).alias(skill) if c == skill else mentions[c] for c in mentions.columns))


def alias_stats(before: DataFrame, after: DataFrame, key: str, skill: str = "skill") -> DataFrame:
    """One row: mentions, changed mentions, their percentage, distinct names before and after."""
    pairs = before.select(key, F.col(skill).alias("old")).join(after.select(key, F.col(skill).alias("new")), key)
    return pairs.agg(
        F.count("*").alias("mentions"), F.count_if(F.col("old") != F.col("new")).alias("changed"), F.countDistinct("old").alias("distinct_before"), F.countDistinct("new").alias("distinct_after")
    ).withColumn("changed_pct", F.round(F.try_divide(F.col("changed") * 100.0, F.col("mentions")), 2))


def aggregate_skills(mentions: DataFrame) -> DataFrame:
    """One row per (skill, category): counts, by label too, raw spellings in order of mention_id and the number of records."""
    return mentions.groupBy("skill", "category").agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == "required_skill").alias("required"), F.count_if(F.col("label") == "preferred_skill").alias("preferred"),
        F.array_sort(F.collect_set("skill_name")).alias("spellings"), F.countDistinct("row_id").alias("records"), F.min("mention_id").alias("first"),
    )


def dominant_category(skills: DataFrame, cluster: str = "skill") -> DataFrame:
    """(cluster, dominant_category, share, tie): the category with most mentions, first seen among equals."""
    per = skills.groupBy(cluster, "category").agg(F.sum("total").alias("n"), F.min("first").alias("first"))
    top = per.groupBy(cluster).agg(F.max_by("category", F.struct("n", -F.col("first"))).alias("dominant_category"), F.max("n").alias("top"), F.sum("n").alias("all"), F.collect_list("n").alias("ns"))
    tie = F.size(F.filter("ns", lambda x: x == F.col("top"))) > 1
    return top.select(cluster, "dominant_category", F.round(F.col("top") / F.col("all"), 4).alias("share"), tie.alias("tie"))


def canonical_rank(name: Column, count: Column) -> Column:
    """Order of names for a cluster: ASCII first, then frequent, short, alphabetical."""
    return F.struct(~is_ascii(name), -count, F.length(name), name)


def pick_canonical(members: DataFrame, cluster: str = "cluster_id", name: str = "name", count: str = "n") -> DataFrame:
    """(cluster, canonical): the best member by canonical_rank."""
    return members.groupBy(cluster).agg(F.min_by(name, canonical_rank(F.col(name), F.col(count))).alias("canonical"))


def cluster_summary(members: DataFrame, min_keep: int = 2) -> DataFrame:
    """One row per cluster_id of (cluster_id, name, category, total, required, preferred, first).

    canonical is the best member; categories a JSON histogram in order of category; final is the canonical name,
    or "<category> Other" for a single member with fewer than `min_keep` mentions.
    """
    names = members.groupBy("cluster_id", "name").agg(F.sum("total").alias("n"))
    categories = members.groupBy("cluster_id", "category").agg(F.sum("total").alias("n"), F.min("first").alias("first"))
    hist = categories.groupBy("cluster_id").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n"))))).alias("categories"), F.count("*").alias("n_categories"),
        F.max_by("category", F.struct("n", -F.col("first"))).alias("dominant_category"), F.max("n").alias("top"), F.collect_list("n").alias("ns"),
    )
    sums = members.groupBy("cluster_id").agg(F.sum("total").alias("total"), F.sum("required").alias("required"), F.sum("preferred").alias("preferred"), F.countDistinct("name").alias("n_members"))
    out = sums.join(pick_canonical(names), "cluster_id").join(hist, "cluster_id")
    tie = F.size(F.filter("ns", lambda x: x == F.col("top"))) > 1
    other = (F.col("n_members") == 1) & (F.col("total") < min_keep)
    return out.select(
        "cluster_id", "canonical", "n_members", "total", "required", "preferred", "categories", "dominant_category", F.round(F.col("top") / F.col("total"), 4).alias("dominant_share"),
        (F.col("n_categories") > 1).alias("cross_category"), tie.alias("tie"), F.when(other, F.concat("dominant_category", F.lit(" Other"))).otherwise(F.col("canonical")).alias("final"),
    )


def canonical_mapping(members: DataFrame, summary: DataFrame) -> DataFrame:
    """(name, category, cluster_id, final, total): one row per name and category."""
    per = members.groupBy("name", "category", "cluster_id").agg(F.sum("total").alias("total"))
    return per.join(summary.select("cluster_id", "final"), "cluster_id").select("name", "category", "cluster_id", "final", "total")


def skill_distribution(mapping: DataFrame) -> DataFrame:
    """(final, total, n_variants, dominant_category, sample): mentions per final name, up to five spellings by name."""
    return mapping.groupBy("final").agg(
        F.sum("total").alias("total"), F.countDistinct("name").alias("n_variants"), F.max_by("category", F.struct("total", F.col("category"))).alias("dominant_category"),
        F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 5), "|").alias("sample"),
    )


def apply_overrides(summary: DataFrame, mapping: DataFrame, overrides: DataFrame) -> DataFrame:
    """`summary` with final set by overrides (name, category, override): one distinct override of a cluster is used, several revert to the canonical name."""
    hits = mapping.join(overrides.filter(~blank(F.col("override"))), ["name", "category"]).groupBy("cluster_id").agg(F.collect_set("override").alias("o"))
    joined = summary.join(hits, "cluster_id", "left")
    final = F.when(F.size("o") == 1, F.element_at("o", 1)).when(F.size("o") > 1, F.col("canonical")).otherwise(F.col("final"))
    return joined.select(*(final.alias("final") if c == "final" else F.col(c) for c in summary.columns))


def override_categories(summary: DataFrame, categories: DataFrame) -> DataFrame:
    """`summary` with dominant_category from (final, category) by folded name, ties cleared; "... Other" buckets are left."""
    m = categories.select(F.lower(F.trim("final")).alias("__k"), F.col("category").alias("__c"))
    j = summary.join(m, (F.lower(F.trim("final")) == F.col("__k")) & ~F.col("final").endswith(" Other"), "left")
    return j.select(*(F.coalesce("__c", c).alias(c) if c == "dominant_category" else (F.col(c) & F.col("__c").isNull()).alias(c) if c == "tie" else F.col(c) for c in summary.columns))


def block_roles(rows: DataFrame, roles: DataFrame, name: str = "final") -> DataFrame:
    """`rows` whose normalised name isn't one of `roles` (role); comments (#) and blanks there are skipped."""
    blocked = roles.filter(~blank(F.col("role")) & ~F.col("role").startswith("#")).select(skill_key(F.col("role")).alias("__role")).distinct()
    return rows.join(blocked, skill_key(rows[name]) == F.col("__role"), "left_anti")


def suggested_action(total: Column, share: Column) -> Column:
    """IGNORE below five mentions, MERGE from a dominant share of .9, MERGE_REVIEW from .7, else REVIEW_SPLIT."""
    return F.when(total < 5, "IGNORE").when(share >= 0.9, "MERGE").when(share >= 0.7, "MERGE_REVIEW").otherwise("REVIEW_SPLIT")


def cross_category_names(mentions: DataFrame) -> DataFrame:
    """(skill, n_categories): names that stand in several categories."""
    return mentions.groupBy("skill").agg(F.countDistinct("category").alias("n_categories")).filter("n_categories > 1")


def clean_mentions(flat: DataFrame) -> DataFrame:
    """Mentions with a normalised skill and category, one row per mention_id, that of its last extraction.

    Blank names and null categories are dropped first. Of several rows extracted at once the greatest counts, whole.
    """
    kept = drop_reasons(flat).filter("reason is null")
    fields = ("row_id", "skill_name", "label", "category")
    one = kept.groupBy("mention_id").agg(F.max(F.struct("extracted_at", *fields)).alias("x")).select("mention_id", *(F.col("x")[c].alias(c) for c in fields))
    return one.select("mention_id", "row_id", "skill_name", "label", skill_key(F.col("skill_name")).alias("skill"), category_key(F.col("category")).alias("category"))


def rank_within(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each group in `order`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def validate_alias_groups(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Alias groups checked against known names: (ord, canonical, variants).

    Unknown variants go; a canonical that is unknown is replaced by its most frequent known variant; a group
    without variants goes. `groups`: ord, canonical, variants; `counts`: name, n.
    """
    known = counts.select(F.col("name").alias("variant"), "n")
    rows = groups.select("ord", F.lower(F.trim("canonical")).alias("canonical"), F.explode("variants").alias("v")).select("ord", "canonical", F.lower(F.trim("v")).alias("variant")).distinct()
    valid = rows.join(known, "variant")
    heads = known.select(F.col("variant").alias("canonical"), F.lit(True).alias("head_known"))
    flagged = valid.join(heads, "canonical", "left")
    promoted = flagged.groupBy("ord").agg(F.max_by("variant", F.struct("n", "variant")).alias("promoted"))
    head = F.when(F.col("head_known"), F.col("canonical")).otherwise(F.col("promoted"))
    named = flagged.join(promoted, "ord").withColumn("head", head).filter(F.col("variant") != F.col("head"))
    return named.groupBy("ord", F.col("head").alias("canonical")).agg(F.array_sort(F.collect_set("variant")).alias("variants"))


def merge_alias_groups(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(canonical, variants): groups of one canonical united; every variant belongs to its most frequent canonical; a canonical that is another's variant keeps the side with the higher count."""
    n = counts.select("name", "n")
    edges = groups.select("canonical", F.explode("variants").alias("variant")).distinct()
    weighed = edges.join(n.select(F.col("name").alias("canonical"), F.col("n").alias("cn")), "canonical", "left").join(n.select(F.col("name").alias("variant"), F.col("n").alias("vn")), "variant", "left").fillna(0, ["cn", "vn"])
    heads = edges.select(F.col("canonical").alias("variant"), F.lit(True).alias("is_head")).distinct()
    weighed = weighed.join(heads, "variant", "left")
    kept = weighed.filter(~F.coalesce("is_head", F.lit(False)) | (F.col("cn") > F.col("vn")) | ((F.col("cn") == F.col("vn")) & (F.col("canonical") < F.col("variant"))))
    owner = kept.groupBy("variant").agg(F.max_by("canonical", F.struct("cn", "canonical")).alias("canonical"))
    return owner.groupBy("canonical").agg(F.array_sort(F.collect_list("variant")).alias("variants"))


def bootstrap_aliases(counts: DataFrame, answer: Callable[[list[str]], str | None], min_count: int = 1, size: int = 200) -> DataFrame:
    """(canonical, variants): alias groups that a language model proposes for frequent names, checked and united.

    `counts`: name, n. Names with at least `min_count` mentions, the most frequent first, go to `answer` in batches of `size` (one call per batch, on the
    executors); its YAML is read by json_skills.yaml_aliases, checked by validate_alias_groups and united by merge_alias_groups.
    """
    kept = counts.filter((F.col("n") >= min_count) & ~blank(F.col("name"))).withColumn("minus", -F.col("n"))
    asked = batches(kept, ["minus", "name"], size).groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("minus", "name"))).alias("names"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [
                (int(batch) * 1_000_000 + i, str(g["canonical"]), [str(v) for v in g.get("variants") or []])
                for batch, names in zip(pdf["batch_id"], pdf["names"]) for i, g in enumerate(yaml_aliases(answer([n["name"] for n in names]))) if g.get("canonical")
            ]
            yield pd.DataFrame(rows, columns=["ord", "canonical", "variants"])

    groups = checkpointed(asked.mapInPandas(ask, "ord long, canonical string, variants array<string>"))
    known = counts.select(F.lower(F.trim("name")).alias("name"), "n").groupBy("name").agg(F.sum("n").alias("n"))
    return merge_alias_groups(validate_alias_groups(groups, known), known)


def cascade_block(mentions: DataFrame, roles: DataFrame, name: str = "final") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) mentions whose final name isn't, or is, one of `roles`: blocked clusters take their mentions with them."""
    kept = block_roles(mentions, roles, name)
    blocked = roles.filter(~blank(F.col("role")) & ~F.col("role").startswith("#")).select(skill_key(F.col("role")).alias("__role")).distinct()
    return kept, mentions.join(blocked, skill_key(mentions[name]) == F.col("__role"), "left_semi")
