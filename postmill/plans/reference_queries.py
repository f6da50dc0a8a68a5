"""Queries over the posting tables, one or more per operator of the core library."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import fields, html, json_skills, labels, salary, text, titles
from postmill.operators import agreement, checks, clusters, relational, skills
from postmill.session import checkpointed, shared_folder, table
from postmill.sources import sinks
from postmill.streaming import jobs as streams

BASE_URL = "https://it-jobs.example"
#: Distance of the clustering queries.
DISTANCE = 0.62


def _boards(spark: SparkSession, base: str, columns: list[str]) -> DataFrame:
    """(source, columns...) of both boards, repeated rows once."""
    return relational.union_all(*(table(spark, base, f"raw_jobs_{b}").select(F.lit(b).alias("source"), *columns) for b in ("itviec", "topcv"))).distinct()


# text


def text_skill_key(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "skills_flat").select("skill_name").filter("skill_name is not null").distinct().select("skill_name", text.skill_key(F.col("skill_name")).alias("skill"))


def text_skill_match_key(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "skills_flat").select("skill_name").filter("skill_name is not null").distinct().select("skill_name", text.skill_match_key(F.col("skill_name")).alias("skill"))


def text_category_key(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "skills_flat").groupBy(text.category_key(F.col("category")).alias("category")).agg(F.count("*").alias("n"))


def text_title_tokens(spark: SparkSession, base: str) -> DataFrame:
    t = _boards(spark, base, ["job_title"]).select("job_title").filter("job_title is not null").distinct()
    return t.select("job_title", F.array_join(text.tokens(F.col("job_title")), " ").alias("tokens"))


def text_url_key(spark: SparkSession, base: str) -> DataFrame:
    u = table(spark, base, "raw_jobs_itviec").select("posting_id", "url").distinct()
    return u.select("posting_id", "url", text.url_key(F.col("url"), BASE_URL).alias("url_key"), text.slug(text.url_key(F.col("url"), BASE_URL), "https://it-jobs.example/it-jobs").alias("slug"))


def text_fold(spark: SparkSession, base: str) -> DataFrame:
    return _boards(spark, base, ["location"]).select("location").filter("location is not null").distinct().select("location", text.fold(F.col("location")).alias("folded"), text.is_ascii(F.col("location")).alias("is_ascii"))


# fields


def location_canonical(spark: SparkSession, base: str) -> DataFrame:
    both = _boards(spark, base, ["posting_id", "location"])
    raw = F.when(F.col("source") == "itviec", fields.board_place(F.col("location"), "itviec")).otherwise(fields.board_place(F.col("location"), "topcv"))
    return both.select("source", "posting_id", "location", raw.alias("raw")).select("source", "posting_id", "location", fields.canonical_place(F.col("raw")).alias("place"))


def level_extract(spark: SparkSession, base: str) -> DataFrame:
    both = _boards(spark, base, ["posting_id", "job_title", "level"])
    return both.select("source", "posting_id", "job_title", "level", fields.extract_level(F.col("job_title"), F.col("level")).alias("job_level"))


def education_extract(spark: SparkSession, base: str) -> DataFrame:
    return _boards(spark, base, ["posting_id", "education"]).select("source", "posting_id", "education", fields.extract_education(F.col("education")).alias("degree"))


def experience_extract(spark: SparkSession, base: str) -> DataFrame:
    return _boards(spark, base, ["posting_id", "experience"]).select("source", "posting_id", "experience", fields.extract_experience(F.col("experience")).alias("years"))


def _employment(spark: SparkSession, base: str) -> DataFrame:
    both = _boards(spark, base, ["posting_id", "job_title", "job_description", "employment_type"])
    return both.select("source", "posting_id", "employment_type", fields.extract_employment(F.col("job_title"), F.col("job_description")).alias("found"))


def employment_type(spark: SparkSession, base: str) -> DataFrame:
    return _employment(spark, base).select("source", "posting_id", "found").distinct()


def employment_reconcile(spark: SparkSession, base: str) -> DataFrame:
    e = _employment(spark, base).withColumn("r", fields.reconcile_employment(F.col("employment_type"), F.col("found")))
    return e.groupBy("source", F.col("r.final").alias("final"), F.col("r.audit").alias("audit")).agg(F.countDistinct("posting_id").alias("n"))


def salary_placeholders(spark: SparkSession, base: str) -> DataFrame:
    both = _boards(spark, base, ["posting_id", "salary"])
    return both.groupBy("source", fields.salary_text(F.col("salary")).isin(fields.NEGOTIABLE).alias("negotiable"), fields.salary_placeholder(F.col("salary")).alias("placeholder")).agg(F.countDistinct("posting_id").alias("n"))


# titles


def title_classify(spark: SparkSession, base: str) -> DataFrame:
    both = _boards(spark, base, ["job_title"]).select("job_title").distinct().withColumn("c", titles.classify(F.col("job_title"), titles.SAFE_PATTERNS, titles.DROP_GROUPS))
    return both.select("job_title", "c.decision", "c.reason")


def title_drop_breakdown(spark: SparkSession, base: str) -> DataFrame:
    both = _boards(spark, base, ["posting_id", "job_title"]).withColumn("c", titles.classify(F.col("job_title"), titles.SAFE_PATTERNS, titles.DROP_GROUPS)).filter("c.decision = 'drop'")
    return relational.value_counts(both.select(F.col("c.reason").alias("reason")), "reason")


def title_drop_report(spark: SparkSession, base: str) -> DataFrame:
    both = _boards(spark, base, ["job_title"]).withColumn("c", titles.classify(F.col("job_title"), titles.SAFE_PATTERNS, titles.DROP_GROUPS)).filter("c.decision = 'drop'")
    return sinks.drop_report(both.select("c.reason", "job_title"))


def title_post_filter(spark: SparkSession, base: str) -> DataFrame:
    t = _boards(spark, base, ["job_title"]).select("job_title").distinct()
    return t.select("job_title", titles.post_filter(F.col("job_title")).alias("dropped"))


def title_standard(spark: SparkSession, base: str) -> DataFrame:
    t = table(spark, base, "skills_flat").select("standardized_title").union(_boards(spark, base, ["job_title"]).select("job_title")).distinct()
    return t.select("standardized_title", titles.standard_title(F.col("standardized_title")).alias("title"))


def title_rule_audit(spark: SparkSession, base: str) -> DataFrame:
    """Rules and whether any title hits them, in one pass."""
    t = F.lower("job_title")
    rules = [(g, p) for g, p in titles.DROP_GROUPS] + [("safe", p) for p in titles.SAFE_PATTERNS]
    one = _boards(spark, base, ["job_title"]).agg(*(F.count_if(t.rlike(p)).alias(f"r{i}") for i, (_, p) in enumerate(rules)))
    pairs = ", ".join(f"{i}, '{g}', r{i}" for i, (g, _) in enumerate(rules))
    return one.selectExpr(f"stack({len(rules)}, {pairs}) as (rule_no, group_name, hits)")


# relational


def union_boards(spark: SparkSession, base: str) -> DataFrame:
    a, b = (table(spark, base, f"raw_jobs_{x}").withColumn("source", F.lit(x)) for x in ("itviec", "topcv"))
    return relational.union_all(a, b).groupBy("source").agg(F.count("*").alias("n"), F.count("page_lang").alias("n_lang"), F.count("brand_recrawled").alias("n_brand"), F.countDistinct("posting_id").alias("postings"))


def dedup_first(spark: SparkSession, base: str) -> DataFrame:
    j = table(spark, base, "raw_jobs_itviec").select("posting_id", "url", "experience", "crawled_at")
    return relational.keep_first(j, ["posting_id"], [F.col("crawled_at"), F.col("url"), F.col("experience")])


def dedup_last(spark: SparkSession, base: str) -> DataFrame:
    j = table(spark, base, "raw_jobs_topcv").select("posting_id", "url", "experience", "crawled_at")
    return relational.keep_last(j, ["posting_id"], [F.col("crawled_at"), F.col("url"), F.coalesce("experience", F.lit(""))])


def surrogate_keys(spark: SparkSession, base: str) -> DataFrame:
    urls = table(spark, base, "raw_jobs_itviec").groupBy("posting_id").agg(F.max("url").alias("url"))
    return relational.number_rows(urls, ["url", "posting_id"], "job_id")


def star_schema(spark: SparkSession, base: str) -> DataFrame:
    """Skills per job by surrogate key, records without a posting counted apart."""
    keys = surrogate_keys(spark, base).select("job_id", F.col("posting_id").cast("string").alias("row_id"))
    m = skills.clean_mentions(table(spark, base, "skills_flat"))
    return m.join(keys, "row_id", "left").groupBy("job_id").agg(F.count("*").alias("mentions"), F.countDistinct("skill").alias("skills"))


def recrawl_needed(spark: SparkSession, base: str) -> DataFrame:
    j = table(spark, base, "raw_jobs_topcv").select("posting_id", "url", "company", "required_skills", "preferred_skills", "specialization").distinct()
    return j.filter(F.col("url").contains("/brand/") & fields.recrawl_needed([F.col(c) for c in ("company", "required_skills", "preferred_skills", "specialization")])).select("posting_id").distinct()


def patch_recrawled(spark: SparkSession, base: str) -> DataFrame:
    """The first crawl of each posting with salary and experience of its last crawl, nulls included."""
    j = table(spark, base, "raw_jobs_topcv").select("posting_id", "salary", "experience", "crawled_at")
    order = [F.col("crawled_at"), F.coalesce("salary", F.lit("")), F.coalesce("experience", F.lit(""))]
    return relational.patch(relational.keep_first(j, ["posting_id"], order), relational.keep_last(j, ["posting_id"], order), "posting_id", ["salary", "experience"])


def unprocessed_anti(spark: SparkSession, base: str) -> DataFrame:
    """Postings without a submission of the model that names a skill."""
    log = table(spark, base, "annotations_unified").filter("annotator = 'llm'")
    done = log.select(F.col("record_id").cast("long").alias("posting_id"), (F.coalesce(F.size("skills"), F.lit(0)) <= 0).alias("failed"))
    jobs_ = table(spark, base, "raw_jobs_itviec").select("posting_id").distinct()
    return relational.unprocessed(jobs_, done, "posting_id", F.col("failed"))


def merge_llm_titles(spark: SparkSession, base: str) -> DataFrame:
    """Postings with the standardized title of their extraction, by status."""
    answers = table(spark, base, "skills_flat").groupBy(F.col("row_id").cast("long").alias("posting_id")).agg(F.max("standardized_title").alias("standardized_title"))
    answers = answers.withColumn("is_valid_job", F.col("posting_id") % 7 != 0).withColumn("error", F.when(F.col("posting_id") % 11 == 0, "timeout"))
    jobs_ = table(spark, base, "raw_jobs_itviec").groupBy("posting_id").agg(F.max("job_title").alias("job_title"))
    return relational.enrich_titles(jobs_, answers, "posting_id").select("posting_id", "standardized_title", "status")


def missing_profile(spark: SparkSession, base: str) -> DataFrame:
    return relational.missing_profile(table(spark, base, "raw_jobs_topcv"), ("required_skills", "preferred_skills"), ("salary",))


def value_counts_pct(spark: SparkSession, base: str) -> DataFrame:
    return relational.value_counts(table(spark, base, "raw_jobs_topcv").select("level"), "level")


def category_stats(spark: SparkSession, base: str) -> DataFrame:
    m = skills.clean_mentions(table(spark, base, "skills_flat"))
    return m.groupBy("category").agg(F.count("*").alias("mentions"), F.countDistinct("skill").alias("skills"))


def title_stats(spark: SparkSession, base: str) -> DataFrame:
    """Standardized titles with at least ten records and the longest source text of each."""
    s = table(spark, base, "skills_flat").filter("standardized_title is not null")
    return s.groupBy("standardized_title").agg(F.countDistinct("row_id").alias("records"), F.max(F.length("source_text")).alias("longest")).filter("records >= 10")


def name_collisions(spark: SparkSession, base: str) -> DataFrame:
    return relational.collisions(table(spark, base, "skills_flat"), "skill_name").select("folded", "n", F.array_join("spellings", "|").alias("spellings"))


def referential_check(spark: SparkSession, base: str) -> DataFrame:
    """Annotated records without a posting and postings that nobody annotated."""
    a = table(spark, base, "annotations_unified").select(F.col("record_id").cast("long").alias("id"))
    b = _boards(spark, base, ["posting_id"]).select(F.col("posting_id").alias("id"))
    return relational.difference(a, b).groupBy("side").agg(F.count("*").alias("n"))


def split_halves(spark: SparkSession, base: str) -> DataFrame:
    h = relational.halves(table(spark, base, "raw_jobs_itviec").select("posting_id").distinct(), "posting_id")
    return h.groupBy("half").agg(F.count("*").alias("n"), F.min("posting_id").alias("first"), F.max("posting_id").alias("last"))


def batching(spark: SparkSession, base: str) -> DataFrame:
    b = relational.batches(table(spark, base, "raw_jobs_topcv").select("posting_id").distinct(), ["posting_id"], 200)
    return b.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("posting_id").alias("first"))


def calibration_sample(spark: SparkSession, base: str) -> DataFrame:
    one = table(spark, base, "skills_flat").select("standardized_title", "row_id").distinct()
    return relational.calibration_sample(one, "standardized_title", "row_id")


def seeded_sample(spark: SparkSession, base: str) -> DataFrame:
    return relational.seeded_sample(table(spark, base, "raw_jobs_itviec").select("posting_id").distinct(), "posting_id", 50)


def sample_properties(spark: SparkSession, base: str) -> DataFrame:
    """What holds for the samples whatever rows they draw: sizes, one row a title, titles with many rows first, rows of the table only."""
    flat = table(spark, base, "skills_flat").select("standardized_title", "row_id").distinct()
    picked = checkpointed(calibration_sample(spark, base))
    simple = checkpointed(seeded_sample(spark, base))
    posted = table(spark, base, "raw_jobs_itviec").select("posting_id").distinct()
    one = picked.agg(F.count("*").alias("calibration"), F.countDistinct("standardized_title").alias("titles"), F.count_if(F.col("title_rows") >= 10).alias("major"))
    true = picked.join(flat, ["standardized_title", "row_id"], "left_semi").agg(F.count("*"))
    drawn = simple.agg(F.countDistinct("posting_id"))
    known = simple.join(posted, "posting_id", "left_semi").agg(F.count("*"))
    return one.withColumn("of_table", true.scalar()).withColumn("simple", drawn.scalar()).withColumn("simple_of_table", known.scalar())


# skills


def _mentions(spark: SparkSession, base: str) -> DataFrame:
    return skills.clean_mentions(table(spark, base, "skills_flat"))


def _aliases(spark: SparkSession, base: str) -> DataFrame:
    ref = table(spark, base, "skill_reference")
    return skills.close_aliases(skills.alias_edges(ref.select(F.col("skill_id").alias("ord"), "canonical", "variants")))


def _members(spark: SparkSession, base: str) -> DataFrame:
    """(cluster_id, name, category, total, required, preferred, first): aggregated names with their alias as cluster."""
    agg = skills.aggregate_skills(_mentions(spark, base))
    m = _aliases(spark, base)
    return agg.join(m, agg["skill"] == m["variant"], "left").select(F.coalesce("canonical", "skill").alias("cluster_id"), F.col("skill").alias("name"), "category", "total", "required", "preferred", "first")


def skill_drop_reasons(spark: SparkSession, base: str) -> DataFrame:
    return skills.drop_reasons(table(spark, base, "skills_flat")).groupBy("reason").agg(F.count("*").alias("n"))


def skill_aggregate(spark: SparkSession, base: str) -> DataFrame:
    return skills.aggregate_skills(_mentions(spark, base)).select("skill", "category", "total", "required", "preferred", "records", "first", F.array_join("spellings", "|").alias("spellings"))


def alias_closure(spark: SparkSession, base: str) -> DataFrame:
    return _aliases(spark, base)


def alias_stats(spark: SparkSession, base: str) -> DataFrame:
    m = checkpointed(_mentions(spark, base))
    return skills.alias_stats(m, skills.apply_aliases(m, _aliases(spark, base)), "mention_id")


def dominant_vote(spark: SparkSession, base: str) -> DataFrame:
    return skills.dominant_category(skills.aggregate_skills(_mentions(spark, base)))


def _summary(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    members = checkpointed(_members(spark, base))
    return members, checkpointed(skills.cluster_summary(members, 5))


def cluster_summary(spark: SparkSession, base: str) -> DataFrame:
    return _summary(spark, base)[1]


def canonical_mapping(spark: SparkSession, base: str) -> DataFrame:
    return skills.canonical_mapping(*_summary(spark, base))


def skill_distribution(spark: SparkSession, base: str) -> DataFrame:
    return skills.skill_distribution(skills.canonical_mapping(*_summary(spark, base)))


def short_names(spark: SparkSession, base: str) -> DataFrame:
    a, b = clusters.short_names(_mentions(spark, base).select("skill").distinct(), 7, "skill")
    return a.agg(F.lit("short").alias("kind"), F.count("*").alias("n")).unionByName(b.agg(F.lit("long").alias("kind"), F.count("*").alias("n")))


def role_block(spark: SparkSession, base: str) -> DataFrame:
    roles = spark.createDataFrame([("# roles",), ("",), ("Cold calling",), ("Kỹ năng Karaoke",), ("nail-art",)], "role string")
    return skills.block_roles(_summary(spark, base)[1], roles).select("cluster_id", "final", "total")


def category_override(spark: SparkSession, base: str) -> DataFrame:
    new = spark.createDataFrame([(" SQL", "Query Language"), ("english", "Language")], "final string, category string")
    return skills.override_categories(_summary(spark, base)[1], new).select("cluster_id", "final", "dominant_category", "tie")


def apply_overrides(spark: SparkSession, base: str) -> DataFrame:
    members, summary = _summary(spark, base)
    mapping = skills.canonical_mapping(members, summary)
    wanted = mapping.filter(F.col("name").isin("python", "java", "sql")).select("name", "category", F.concat(F.lit("x "), "name").alias("override"))
    return skills.apply_overrides(summary, mapping, wanted).select("cluster_id", "canonical", "final")


def cross_category(spark: SparkSession, base: str) -> DataFrame:
    return skills.cross_category_names(_mentions(spark, base))


def suggested_action(spark: SparkSession, base: str) -> DataFrame:
    return _summary(spark, base)[1].groupBy(skills.suggested_action(F.col("total"), F.col("dominant_share")).alias("action")).agg(F.count("*").alias("clusters"), F.sum("total").alias("mentions"))


def top_skills_per_category(spark: SparkSession, base: str) -> DataFrame:
    agg = skills.aggregate_skills(_mentions(spark, base))
    return skills.rank_within(agg.select("category", "skill", "total"), "category", [F.col("total").desc(), F.col("skill")], 20).select("category", "rank", "skill", "total")


# vectors


def embedding_edges(spark: SparkSession, base: str) -> DataFrame:
    return clusters.close_pairs(table(spark, base, "embeddings"), DISTANCE).select("a", "b", F.round("distance", 5).alias("distance"))


def embedding_components(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "embeddings")
    return clusters.components(clusters.close_pairs(e, DISTANCE), e.select("vec_id")).select(F.col("id").alias("vec_id"), "component")


def embedding_clusters(spark: SparkSession, base: str) -> DataFrame:
    return clusters.cluster(table(spark, base, "embeddings"), DISTANCE).select(F.col("id").alias("vec_id"), "cluster_id")


# agreement

def _annotations(spark: SparkSession, base: str) -> DataFrame:
    """(record_id, annotator, ord, name, label, category): the latest submissions, one row per name."""
    rows = table(spark, base, "annotations_unified")
    latest = rows.groupBy("record_id", "annotator").agg(F.max_by("skills", F.struct("submitted_at", F.to_json("skills"))).alias("skills"))
    each = latest.select("record_id", "annotator", F.explode("skills").alias("s")).select(
        "record_id", "annotator", F.col("s.mention_no").alias("ord"), text.skill_match_key(F.col("s.skill_name")).alias("name"), labels.label_name(F.col("s.label")).alias("label"), text.category_key(F.col("s.category")).alias("category")
    )
    first = F.struct("ord", F.coalesce("label", F.lit("")), "category")
    return each.filter("name is not null and name != ''").groupBy("record_id", "annotator", "name").agg(F.min("ord").alias("ord"), F.min_by("label", first).alias("label"), F.min_by("category", first).alias("category"))


def _pair(spark: SparkSession, base: str) -> DataFrame:
    return agreement.match_equal(_annotations(spark, base), "human_a", "llm")


def iaa_f1(spark: SparkSession, base: str) -> DataFrame:
    return agreement.macro_f1(_pair(spark, base))


def iaa_kappa_label(spark: SparkSession, base: str) -> DataFrame:
    return agreement.cohen_kappa(_pair(spark, base), "label_a", "label_b")


def iaa_kappa_category(spark: SparkSession, base: str) -> DataFrame:
    return agreement.cohen_kappa(_pair(spark, base), "category_a", "category_b")


def iaa_confusion(spark: SparkSession, base: str) -> DataFrame:
    return agreement.confusion(_pair(spark, base), "label_a", "label_b")


def iaa_errors(spark: SparkSession, base: str) -> DataFrame:
    return agreement.error_cases(_pair(spark, base), "human_a", "llm").groupBy("error").agg(F.count("*").alias("n"))


def iaa_fleiss(spark: SparkSession, base: str) -> DataFrame:
    a = _annotations(spark, base).filter(F.col("annotator").isin("human_a", "human_b", "llm"))
    return agreement.fleiss_kappa(a, ["record_id", "name"], "label")


def iaa_match(spark: SparkSession, base: str) -> DataFrame:
    return agreement.match_records(_annotations(spark, base), "human_a", "llm")


# agreement by similar names, as annotators write them; the queries above compare equal names, which SQL can check


def _listed(spark: SparkSession, base: str) -> DataFrame:
    """(record_id, annotator, ord, name, label, category): the latest submissions, every mention in its order."""
    rows = table(spark, base, "annotations_unified")
    latest = rows.groupBy("record_id", "annotator").agg(F.max_by("skills", F.struct("submitted_at", F.to_json("skills"))).alias("skills"))
    each = latest.select("record_id", "annotator", F.posexplode("skills").alias("ord", "s")).select(
        "record_id", "annotator", "ord", text.skill_match_key(F.col("s.skill_name")).alias("name"), labels.label_name(F.col("s.label")).alias("label"), text.category_key(F.col("s.category")).alias("category")
    )
    return each.filter("name is not null and name != ''")


def _similar(spark: SparkSession, base: str) -> DataFrame:
    return agreement.match_records(_listed(spark, base), "human_a", "llm")


def _similar_or_empty(spark: SparkSession, base: str) -> DataFrame:
    """Every annotated record has a row, also one where neither names a skill: it counts as 0."""
    records = table(spark, base, "annotations_unified").select("record_id").distinct()
    return _similar(spark, base).unionByName(records, allowMissingColumns=True)


def iaa_similar_f1(spark: SparkSession, base: str) -> DataFrame:
    return agreement.macro_f1(_similar_or_empty(spark, base))


def iaa_similar_kappa_label(spark: SparkSession, base: str) -> DataFrame:
    return agreement.cohen_kappa(checkpointed(_similar(spark, base)), "label_a", "label_b")


def iaa_similar_kappa_category(spark: SparkSession, base: str) -> DataFrame:
    return agreement.cohen_kappa(checkpointed(_similar(spark, base)), "category_a", "category_b")


def iaa_similar_confusion(spark: SparkSession, base: str) -> DataFrame:
    return agreement.confusion(_similar(spark, base), "label_a", "label_b")


def iaa_similar_errors(spark: SparkSession, base: str) -> DataFrame:
    return agreement.error_cases(_similar(spark, base), "human_a", "llm").groupBy("error").agg(F.count("*").alias("n"))


def _triple_ratings(spark: SparkSession, base: str) -> DataFrame:
    triples = checkpointed(agreement.three_way_match(_listed(spark, base), "human_a", "human_b", "llm"))
    return triples.select("record_id", "triple", F.explode(F.array("label_a", "label_b", "label_c")).alias("label"))


def iaa_similar_fleiss(spark: SparkSession, base: str) -> DataFrame:
    return agreement.fleiss_kappa(_triple_ratings(spark, base), ["record_id", "triple"], "label")


def iaa_bootstrap(spark: SparkSession, base: str) -> DataFrame:
    """(measure, value, low, high): intervals of F1 over records, the kappas over pairs and Fleiss over triples."""
    matches = checkpointed(_similar_or_empty(spark, base))
    return (
        agreement.bootstrap_f1(matches).unionByName(agreement.bootstrap_kappa(matches, "label_a", "label_b", "kappa_label"))
        .unionByName(agreement.bootstrap_kappa(matches, "category_a", "category_b", "kappa_category"))
        .unionByName(agreement.bootstrap_fleiss(_triple_ratings(spark, base), ["record_id", "triple"], "label"))
    )


def iaa_report(spark: SparkSession, base: str) -> DataFrame:
    """The whole report: F1, kappas and Fleiss of every pair with intervals and PASS or FAIL, the overall status last."""
    return agreement.run_report(_listed(spark, base), table(spark, base, "annotations_unified").select("record_id"))


# salaries


def _salaries(spark: SparkSession, base: str) -> DataFrame:
    return salary.process_salary(_boards(spark, base, ["posting_id", "salary"]))


def salary_bounds(spark: SparkSession, base: str) -> DataFrame:
    return _salaries(spark, base)


def salary_masks(spark: SparkSession, base: str) -> DataFrame:
    """Postings by the flags of their salary as written and whether it is valid."""
    s = _boards(spark, base, ["posting_id", "salary"]).select("source", "posting_id", salary.salary_flags(F.col("salary")).alias("f"), salary.valid_salary(F.col("salary")).alias("valid"))
    return s.groupBy("source", "f.is_null_salary", "f.is_thoa_thuan", "f.is_missing_salary", "valid").agg(F.count("*").alias("n"))


def salary_completeness(spark: SparkSession, base: str) -> DataFrame:
    return salary.completeness(_salaries(spark, base), "source")


# checks of the canonicalisation


def mapping_invariants(spark: SparkSession, base: str) -> DataFrame:
    members, summary = _summary(spark, base)
    return checks.mapping_checks(members, skills.canonical_mapping(members, summary))


def run_report(spark: SparkSession, base: str) -> DataFrame:
    members, summary = _summary(spark, base)
    return checks.run_report(members, summary, {"min_keep": 5}).drop("config_hash")


def canonical_collisions(spark: SparkSession, base: str) -> DataFrame:
    """Categories' most frequent skills that two or more categories share."""
    top = skills.aggregate_skills(_mentions(spark, base)).groupBy("category").agg(F.max_by("skill", F.struct("total", "skill")).alias("canonical"))
    return checks.canonical_collisions(top.unionByName(top.filter("category < 'C'").select(F.concat("category", F.lit("+")).alias("category"), F.upper("canonical").alias("canonical"))))


def unique_keys(spark: SparkSession, base: str) -> DataFrame:
    """The documents, once their keys are known to be unique and whole."""
    return checks.assert_unique(table(spark, base, "documents"), "doc_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def _proposed(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Alias groups as a model might propose them (the reference list with unknown and repeated names) and the known names with counts."""
    known = table(spark, base, "skills_flat").filter("skill_name is not null").groupBy(F.lower(F.trim("skill_name")).alias("name")).agg(F.count("*").alias("n")).filter("name != ''")
    ref = table(spark, base, "skill_reference")
    groups = ref.select(F.col("skill_id").alias("ord"), F.when(F.col("skill_id") % 3 == 0, F.concat("canonical", F.lit(" (unknown)"))).otherwise(F.col("canonical")).alias("canonical"), F.concat("variants", F.array("canonical", F.lit("no such skill"))).alias("variants"))
    return groups, known


def alias_validate(spark: SparkSession, base: str) -> DataFrame:
    return skills.validate_alias_groups(*_proposed(spark, base)).select("ord", "canonical", F.array_join("variants", "|").alias("variants"))


def alias_merge(spark: SparkSession, base: str) -> DataFrame:
    groups, known = _proposed(spark, base)
    valid = skills.validate_alias_groups(groups, known)
    return skills.merge_alias_groups(valid, known).select("canonical", F.array_join("variants", "|").alias("variants"))


# small relational operators


def first_source_text(spark: SparkSession, base: str) -> DataFrame:
    """Mentions per standardized title with the source text of its first mention that has one."""
    s = table(spark, base, "skills_flat").filter("standardized_title is not null")
    return relational.counts_with_first(s, "standardized_title", "source_text", [F.col("mention_id"), F.col("extracted_at"), F.col("source_text")])


def first_category(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "skills_flat").select("skill_name", "category", "mention_id", "extracted_at").filter("skill_name is not null")
    return relational.first_value(s, "skill_name", "category", [F.col("mention_id"), F.col("extracted_at"), F.col("category")])


def first_appearance(spark: SparkSession, base: str) -> DataFrame:
    """Short skill names numbered by where they first appear."""
    names = _mentions(spark, base).filter(F.length("skill") <= 7).select("skill", "mention_id")
    return relational.first_appearance_ids(names, "skill", "mention_id")


def variant_overlap(spark: SparkSession, base: str) -> DataFrame:
    """Names that a title's own list and the words of its canonical name share, and all of both."""
    r = table(spark, base, "title_reference").select("title_id", F.split(F.lower("canonical_title"), " ").alias("a"), F.flatten(F.transform("alt_names", lambda x: F.split(F.lower(x), " "))).alias("b"))
    o = r.select("title_id", relational.overlap(F.col("a"), F.col("b")).alias("o"))
    return o.select("title_id", F.array_join("o.both", "|").alias("both"), F.array_join("o.either", "|").alias("either"))


def joined_categories(spark: SparkSession, base: str) -> DataFrame:
    """The categories of each skill, sorted and joined, and the pieces of their names."""
    agg = skills.aggregate_skills(_mentions(spark, base)).groupBy("skill").agg(F.map_from_entries(F.collect_list(F.struct("category", "total"))).alias("m"))
    named = agg.select("skill", relational.joined_keys(F.col("m")).alias("categories"))
    pieces = relational.flat_pieces(F.array(F.replace("categories", F.lit("/"), F.lit("|")), F.lit("|end")))
    return named.select("skill", "categories", F.array_join(pieces, ";").alias("pieces"))


def job_urls(spark: SparkSession, base: str) -> DataFrame:
    urls = table(spark, base, "raw_jobs_itviec").select("posting_id", "url").distinct()
    return urls.select("posting_id", "url", relational.job_url(F.col("url")).alias("is_job"))


# field drivers


def level_clean(spark: SparkSession, base: str) -> DataFrame:
    both = _boards(spark, base, ["posting_id", "job_title", "level"])
    return fields.process_level(both.withColumn("job_level", fields.extract_level(F.col("job_title"), F.col("level")))).groupBy("source", "job_level").agg(F.count("*").alias("n"))


def level_declared(spark: SparkSession, base: str) -> DataFrame:
    """The level by the title, else by what a text declares; a declaration is put before every third description."""
    both = _boards(spark, base, ["posting_id", "job_title", "job_description", "requirement"])
    said = F.when(F.col("posting_id") % 3 == 0, F.concat(F.lit("Report to the manager. Position: Senior person.\n"), F.coalesce("job_description", F.lit("")))).otherwise(F.col("job_description"))
    return both.select("source", "posting_id", "job_title", fields.declared_level(F.col("job_title"), said, F.col("requirement")).alias("job_level")).distinct()


def fields_clean(spark: SparkSession, base: str) -> DataFrame:
    """Postings by board and cleaned fields."""
    both = _boards(spark, base, ["posting_id", "job_title", "job_description", "requirement", "level", "experience", "employment_type", "education"]).withColumnRenamed("level", "job_level")
    return fields.process_fields(both).groupBy("source", "job_level", "experience", "employment_type", "education").agg(F.count("*").alias("n"))


# JSON, HTML, streams


def _log(spark: SparkSession, base: str) -> DataFrame:
    """An extraction log made of the annotations: fenced, with a trailing comma, truncated, a list, broken or empty."""
    rows = table(spark, base, "annotations_unified").groupBy("record_id", "annotator").agg(F.max_by("skills", F.struct("submitted_at", F.to_json("skills"))).alias("skills"))
    js = F.to_json(F.struct(F.transform("skills", lambda s: F.struct(s["skill_name"].alias("skill_name"), F.lit("required_skill").alias("label"), s["category"].alias("category"))).alias("skills")))
    kind = F.pmod(F.length("annotator") + F.col("record_id").cast("int"), F.lit(6))
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), "js", F.lit("\n```"))).when(kind == 1, F.regexp_replace("js", r"\]\}$", ",]}")).when(kind == 2, F.regexp_replace("js", r"\]\}$", ', {"skill_name": "Jav'))
        .when(kind == 3, F.regexp_extract("js", r"(?s)^\{\"skills\":(.*)\}$", 1)).when(kind == 4, F.lit("sorry, I can't"))
    )
    return rows.select("record_id", "annotator", js.alias("js"), F.size("skills").alias("n_skills"), kind.alias("kind")).select("*", raw.alias("raw_text"), F.when(F.col("kind") == 5, "empty_requirement").alias("error"))


def json_parse(spark: SparkSession, base: str) -> DataFrame:
    p = json_skills.parse_log(_log(spark, base), ["record_id", "annotator"])
    return json_skills.flatten(p, ["record_id", "annotator"]).groupBy("record_id", "annotator").agg(F.count("*").alias("n"), F.count("category").alias("n_category"))


def json_errors(spark: SparkSession, base: str) -> DataFrame:
    p = json_skills.parse_log(_log(spark, base), ["record_id", "annotator"])
    return p.groupBy("status").agg(F.count("*").alias("n"))


def json_strict(spark: SparkSession, base: str) -> DataFrame:
    """Entries of the log by how far they had to be mended to be valid, with their skills."""
    v = json_skills.validate_log(_log(spark, base), ["record_id", "annotator"])
    return v.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("skills"), F.lit(0)).cast("long")).alias("skills"))


def json_titles(spark: SparkSession, base: str) -> DataFrame:
    """Answers made of the title list, each with its id or its title left out, and read again."""
    asked = table(spark, base, "title_reference").select((F.col("title_id") % 4).alias("batch_id"), F.col("title_id").alias("id"), F.col("canonical_title").alias("title"))
    one = F.struct(
        F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 3 != 1, F.col("title")).alias("original"), F.upper("title").alias("standardized_title"), (F.col("id") % 5 != 0).alias("is_valid_job"),
    )
    raw = asked.groupBy("batch_id").agg(F.to_json(F.collect_list(one)).alias("j")).select("batch_id", F.concat(F.lit("```json\n"), "j", F.lit("\n```")).alias("raw_text"))
    return json_skills.title_answers(raw, asked)


def json_years(spark: SparkSession, base: str) -> DataFrame:
    """Years of the annotations as whole numbers, cut and to the nearest even one."""
    s = table(spark, base, "annotations_unified").select(F.explode("skills").alias("s")).select(F.col("s.min_years").alias("written")).distinct()
    return s.select("written", json_skills.whole_years(F.col("written")).alias("cut"), F.bround(F.col("written").try_cast("double"), 0).try_cast("int").alias("rounded"))


def events_props(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k long")["k"]).alias("sum_k"), F.round(F.sum("value"), 4).alias("sum_value"))


def html_rows(spark: SparkSession, base: str) -> DataFrame:
    """Pages made of postings and read again."""
    j = table(spark, base, "raw_jobs_topcv").groupBy("posting_id").agg(*(F.max(c).alias(c) for c in ("job_title", "company", "salary", "location")))
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit("<html><body><h1 class='job-title'><span>"), esc("job_title"), F.lit("</span></h1><div class='company-name'>"), esc("company"),
        F.lit("</div><p><b>Salary:</b> <span class='salary'>"), esc("salary"), F.lit("</span></p><span class='location'>"), esc("location"), F.lit("</span></body></html>"),
    )
    rows = j.select("posting_id", html.column(html.job_row, html.ROW)(page).alias("r"))
    return rows.select("posting_id", "r.kind", "r.job_title", "r.company", "r.salary")


def _esc(c: str) -> Column:
    text = F.coalesce(F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " ")), F.lit(""))
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_brand(spark: SparkSession, base: str) -> DataFrame:
    """Pages of companies' own sites made of postings and read again."""
    j = table(spark, base, "raw_jobs_topcv").groupBy("posting_id").agg(*(F.max(c).alias(c) for c in ("job_title", "company", "salary", "experience", "level")))
    page = F.concat(
        F.lit("<html><h1>"), _esc("job_title"), F.lit("<span>HOT</span><i>*</i></h1><div class='company-name'>"), _esc("company"), F.lit("</div><div><b>Mức lương</b><span>"), _esc("salary"), F.lit("</span></div><div><b>Kinh nghiệm</b><span>"),
        _esc("experience"), F.lit("</span></div><div><b>Cấp bậc</b><span>"), _esc("level"), F.lit("</span></div></html>"),
    )
    rows = j.select("posting_id", html.column(html.brand_row, html.BRAND_ROW)(page).alias("r"))
    return rows.select("posting_id", "r.job_title", "r.company", "r.salary", "r.experience", "r.level")


def html_sidebar(spark: SparkSession, base: str) -> DataFrame:
    j = table(spark, base, "raw_jobs_topcv").groupBy("posting_id").agg(F.max("industry").alias("industry"), F.max("level").alias("level"))
    page = F.concat(F.lit("<ul><li><b>Industry:</b><p>"), _esc("industry"), F.lit("</p></li><li><b>Level</b><p>"), _esc("level"), F.lit("</p></li><li><b>Level</b><p>again</p></li></ul>"))
    read = html.column(lambda p: html.pairs_of(html.parse(p), "li", "b", "p"), "map<string,string>")
    return j.select("posting_id", read(page).alias("m")).select("posting_id", F.try_element_at("m", F.lit("Industry")).alias("industry"), F.try_element_at("m", F.lit("Level")).alias("level"))


def html_links(spark: SparkSession, base: str) -> DataFrame:
    """Job links of search pages, one page per title, those of titles already crawled left out."""
    s = table(spark, base, "skills_flat").filter("standardized_title is not null and url is not null").select(F.col("standardized_title").alias("tag"), "url").distinct()
    anchors = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<h3 class='title'><a href='"), "url", F.lit("'>x</a></h3>")))), "")
    pages = s.groupBy("tag", F.pmod(F.xxhash64("url"), F.lit(50)).alias("page")).agg(anchors.alias("html"))
    return html.crawl_links(pages, spark.createDataFrame([("Tester",), ("Tester",)], "tag string"))


def _scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stream_resume(spark: SparkSession, base: str) -> DataFrame:
    """Events processed as a stream, those of type error refused as empty."""
    out = _scratch(spark)
    source = table(spark, base, "events").select("event_id", "event_type", "user_id")
    source.write.parquet(f"{out}/in")
    stream = streams.read_files(spark, f"{out}/in", "event_id long, event_type string, user_id long").withColumn("requirement", F.when(F.col("event_type") != "error", F.col("event_type")))
    query = streams.resume(stream, f"{out}/out", f"{out}/errors", f"{out}/checkpoint", lambda d: d.select("event_id", "requirement"), key="event_id")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/out").groupBy("requirement").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        text_skill_key, text_skill_match_key, text_category_key, text_title_tokens, text_url_key, text_fold, location_canonical, level_extract, education_extract, experience_extract,
        employment_type, employment_reconcile, salary_placeholders, title_classify, title_drop_breakdown, title_drop_report, title_post_filter, title_standard, title_rule_audit, union_boards,
        dedup_first, dedup_last, surrogate_keys, star_schema, recrawl_needed, patch_recrawled, unprocessed_anti, merge_llm_titles, missing_profile, value_counts_pct, category_stats, title_stats,
        name_collisions, referential_check, split_halves, batching, calibration_sample, seeded_sample, sample_properties, skill_drop_reasons, skill_aggregate, alias_closure, alias_stats, dominant_vote, cluster_summary,
        canonical_mapping, skill_distribution, short_names, role_block, category_override, apply_overrides, cross_category, suggested_action, top_skills_per_category, embedding_edges,
        embedding_components, embedding_clusters, iaa_f1, iaa_kappa_label, iaa_kappa_category, iaa_confusion, iaa_errors, iaa_fleiss, iaa_match, iaa_similar_f1, iaa_similar_kappa_label, iaa_similar_kappa_category,
        iaa_similar_confusion, iaa_similar_errors, iaa_similar_fleiss, iaa_bootstrap, json_parse, json_errors, json_strict, json_titles, json_years, events_props,
        html_rows, html_brand, html_sidebar, html_links, stream_resume, iaa_report, salary_bounds, salary_masks, salary_completeness, mapping_invariants, run_report, canonical_collisions, unique_keys,
        alias_validate, alias_merge, first_source_text, first_category, first_appearance, variant_overlap, joined_categories, job_urls, level_clean, level_declared, fields_clean,
    )
}
