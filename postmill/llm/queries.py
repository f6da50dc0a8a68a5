"""Queries of the llm problems: pN_ by the problem's number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm import aliases, consensus, encoding, entries, language, linkage, mixing, pairs, splitting
from postmill.operators.pay import monthly_kvnd
from postmill.session import checkpointed, table

#: Rows read of a reference list; it is a vocabulary, sent to every task.
MAX_REFERENCE_ROWS = 100_000
_NOT_BLANK = r"[^\s\u00a0\u3000\u200b\ufeff]"


def _reference(spark: SparkSession, base: str, name: str) -> tuple[list[str], aliases.Keys]:
    """Canonical names, and all keys (id, name) with the list's own further names."""
    columns = {"title_reference": ("title_id", "canonical_title", "alt_names"), "skill_reference": ("skill_id", "canonical", "variants")}[name]
    rows = table(spark, base, name).select(*columns).limit(MAX_REFERENCE_ROWS + 1).collect()
    if len(rows) > MAX_REFERENCE_ROWS:
        raise ValueError(f"{name} has more than {MAX_REFERENCE_ROWS} rows")
    return [r[1] for r in rows if r[1]], [(r[0], x) for r in rows for x in [r[1], *(r[2] or [])] if x]


def _skill_id(spark: SparkSession, base: str) -> Callable[[Column], Column]:
    """A column function skill name -> entry; names are learnt from mentions that several annotators marked."""
    keys, affixes = aliases.skill_vocabulary(table(spark, base, "annotations_unified"), _reference(spark, base, "skill_reference")[1])
    return entries.entry_udf(keys, aliases.forms_of(affixes))


def _paid_postings(spark: SparkSession, base: str, columns: list[str]) -> DataFrame:
    """`columns` of both boards with board (0, 1) and the stated pay."""
    boards = [table(spark, base, name).select(*columns, F.lit(i).alias("board")) for i, name in enumerate(("raw_jobs_itviec", "raw_jobs_topcv"))]
    return monthly_kvnd(boards[0].unionByName(boards[1]), table(spark, base, "unit_factors"))


def _title_id(spark: SparkSession, base: str) -> Callable[[Column], Column]:
    """A column function job title -> entry; titles are learnt from postings of both boards that alone share company, place and pay."""
    keys = _reference(spark, base, "title_reference")[1]
    paid = _paid_postings(spark, base, ["posting_id", "company", "job_title", "location", "salary", "job_description"])
    facts = aliases.posting_facts(paid.filter((F.col("low_kvnd") > 0) | (F.col("high_kvnd") > 0)), keys)
    return entries.entry_udf(aliases.title_vocabulary(facts, keys), entries.title_forms)


#: Labels a mention needs to be reported.
MIN_LABELS = 3


def _marked(spark: SparkSession, base: str) -> DataFrame:
    """(record, annotator, mention_no, label): the labels of the latest submissions, as written."""
    latest = consensus.latest_submissions(table(spark, base, "annotations_unified"), "record_id", "annotator", "submitted_at", "skills", lambda s: F.struct(s["mention_no"].alias("mention_no"), s["label"].alias("label")))
    return latest.select("record", "annotator", F.explode("skills").alias("s")).select("record", "annotator", "s.mention_no", "s.label")


def _votes(spark: SparkSession, base: str) -> DataFrame:
    vote = lambda s: F.struct(s["mention_no"].alias("mention_no"), consensus.required_vote(s["label"]).cast("tinyint").alias("vote"))
    latest = consensus.latest_submissions(table(spark, base, "annotations_unified"), "record_id", "annotator", "submitted_at", "skills", vote)
    mentions = latest.select("record", "annotator", F.explode("skills").alias("s")).select("record", "annotator", "s.mention_no", F.col("s.vote").alias("label"))
    return consensus.votes_of(mentions, F.col("label"))


def p2_labels(spark: SparkSession, base: str) -> DataFrame:
    """How every spelling of a label is read: required_skill, preferred_skill or as an abstention, and how often it stands."""
    written = F.coalesce(F.trim("label"), F.lit(""))
    reading = F.when(consensus.required_vote(F.col("label")) == 1, "required_skill").when(consensus.required_vote(F.col("label")) == 0, "preferred_skill").otherwise("abstained")
    return _marked(spark, base).groupBy(written.alias("label"), reading.alias("reading")).agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """The consensus label of every mention with at least three labels."""
    items, _ = consensus.consensus(checkpointed(_votes(spark, base)))
    label = F.when(F.col("vote") > 0, "required_skill").otherwise("preferred_skill")
    return items.filter(F.col("n_votes") >= MIN_LABELS).select(F.col("record").alias("record_id"), "mention_no", label.alias("label"))


def p2_annotators(spark: SparkSession, base: str) -> DataFrame:
    """Every annotator's votes and reliability."""
    _, annotators = consensus.consensus(checkpointed(_votes(spark, base)))
    return annotators.select("annotator", "n_votes", *(F.round(c, 6).alias(c) for c in ("sens", "spec", "reliability")))


def p2_agreement(spark: SparkSession, base: str) -> DataFrame:
    """How well the annotators agree beyond chance (Krippendorff's alpha)."""
    alpha = consensus.krippendorff_alpha(_votes(spark, base), ["record", "mention_no"], "vote")
    return alpha.select("n_items", "n_ratings", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """The entry of title_reference or skill_reference that each free value means, 0 if none."""
    titles, skills = (_reference(spark, base, x)[0] for x in ("title_reference", "skill_reference"))

    def cases(name: str, key: str, column: str, canonical: list[str]) -> DataFrame:
        return table(spark, base, name).filter(F.col(column).rlike(_NOT_BLANK) & ~F.col(column).isin(canonical)).select(F.col(key).alias("row_key"), F.col(column).alias("value"))

    jobs = cases("raw_jobs_itviec", "posting_id", "job_title", titles).unionByName(cases("raw_jobs_topcv", "posting_id", "job_title", titles))
    mentions = cases("skills_flat", "mention_id", "skill_name", skills)
    out = jobs.select(F.lit("job_title").alias("field"), "row_key", _title_id(spark, base)(F.col("value")).cast("long").alias("ref_id")).unionByName(
        mentions.select(F.lit("skill_name").alias("field"), "row_key", _skill_id(spark, base)(F.col("value")).cast("long").alias("ref_id"))
    )
    return out.distinct()


def p5_matches(spark: SparkSession, base: str) -> DataFrame:
    """Postings of the two boards that are the same job, with a confidence."""
    paid = _paid_postings(spark, base, ["posting_id", "company", "job_title", "location", "required_skills", "job_description", "crawled_at", "salary"])
    skills, affixes = aliases.skill_vocabulary(table(spark, base, "annotations_unified"), _reference(spark, base, "skill_reference")[1])
    found = linkage.link(paid, _reference(spark, base, "title_reference")[1], skills, affixes)
    return found.select(F.least("id_a", "id_b").alias("posting_id_a"), F.greatest("id_a", "id_b").alias("posting_id_b"), "score", "confidence")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Postings of the two boards that are the same job, the smaller id first."""
    return p5_matches(spark, base).select("posting_id_a", "posting_id_b").distinct()


def _skill_mentions(spark: SparkSession, base: str) -> DataFrame:
    """(row_id, item): each record's skills by entry id, 0 for names that fit none."""
    return table(spark, base, "skills_flat").select("row_id", _skill_id(spark, base)(F.col("skill_name")).alias("item"))


#: Least records, share of records and lift of a reported pair.
MIN_TOGETHER, MIN_SHARE, MIN_LIFT = 5, 0.005, 3


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of listed skills that stand together in enough records and far more often than by chance."""
    baskets = checkpointed(pairs.baskets_of(_skill_mentions(spark, base), "row_id", "item"))
    found = pairs.associations(baskets, least=MIN_TOGETHER, least_share=MIN_SHARE)
    often = F.col("n") * F.col("n_ab") >= MIN_LIFT * F.col("n_a") * F.col("n_b")
    return found.filter(often).select(F.col("item_a").alias("skill_id_a"), F.col("item_b").alias("skill_id_b"))


def p6_listed(spark: SparkSession, base: str) -> DataFrame:
    """All pairs of skills that records name exactly as listed, case and blanks at the ends aside, with their counts and lift."""
    ref = table(spark, base, "skill_reference")
    names = ref.select(F.explode(F.concat(F.array("canonical"), F.coalesce("variants", F.array().cast("array<string>")))).alias("name"), "skill_id").groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("skill_id").alias("item"))
    flat = table(spark, base, "skills_flat").select("row_id", F.lower(F.trim("skill_name")).alias("name")).join(names, "name", "left")
    found = pairs.associations(checkpointed(pairs.baskets_of(flat, "row_id", "item")))
    return found.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 9).alias("lift"))


def p6_categories(spark: SparkSession, base: str) -> DataFrame:
    """How often categories of the skill list stand together in a record, and their lift."""
    rows = table(spark, base, "skill_reference").select("skill_id", "category").limit(MAX_REFERENCE_ROWS + 1).collect()
    if len(rows) > MAX_REFERENCE_ROWS:
        raise ValueError(f"skill_reference has more than {MAX_REFERENCE_ROWS} rows")
    names = sorted({r[1] for r in rows if r[1]})
    number = {c: i + 1 for i, c in enumerate(names)}
    # a table of at most MAX_REFERENCE_ROWS rows of two numbers, and one of their names
    of_skill = F.broadcast(spark.createDataFrame([(r[0], number[r[1]]) for r in rows if r[1]], "item int, category int"))
    named = spark.createDataFrame(sorted((i, c) for c, i in number.items()), "number int, name string")
    mentions = _skill_mentions(spark, base).join(of_skill, "item", "left").select("row_id", F.coalesce("category", F.lit(0)).alias("item"))
    found = pairs.associations(checkpointed(pairs.baskets_of(mentions, "row_id", "item")))
    a, b = (named.select(F.col("number").alias(f"item_{x}"), F.col("name").alias(f"category_{x}")) for x in "ab")
    return found.join(F.broadcast(a), "item_a").join(F.broadcast(b), "item_b").select("category_a", "category_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 9).alias("lift"))


def _all_texts(spark: SparkSession, base: str) -> DataFrame:
    """(field, item_id, text, label): documents.text and both text fields of raw_jobs_itviec; repeated rows count once."""
    jobs = table(spark, base, "raw_jobs_itviec")
    docs = table(spark, base, "documents").select(F.lit("text").alias("field"), F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("label"))
    fields = [jobs.select(F.lit(c).alias("field"), F.col("posting_id").alias("item_id"), F.col(c).alias("text"), F.col("page_lang").alias("label")) for c in ("job_description", "requirement")]
    return docs.unionByName(fields[0]).unionByName(fields[1])


def _segments(spark: SparkSession, base: str) -> DataFrame:
    texts = _all_texts(spark, base)
    sample = [(r.text, r.lang) for r in language.labelled_sample(texts, "text", "label").collect()]  # bounded by its parameters
    return language.languages_of(texts, language.fitted(sample))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """The main language of texts whose label is missing or wrong (para_no 0), and of each paragraph of mixed texts."""
    found = _segments(spark, base)
    wrong = F.col("label").isNull() | (F.col("label") != F.col("main"))
    main = F.when(wrong, F.array(F.struct(F.lit(0).alias("para_no"), F.col("main").alias("lang")))).otherwise(F.array().cast("array<struct<para_no:int,lang:string>>"))
    parts = F.when(F.col("mixed"), F.transform(F.filter("parts", lambda p: p["lang"].isNotNull()), lambda p: F.struct(p["para_no"].alias("para_no"), p["lang"].alias("lang"))))
    rows = found.select("field", "item_id", F.explode(F.concat(main, F.coalesce(parts, F.array().cast("array<struct<para_no:int,lang:string>>")))).alias("x"))
    return rows.select("field", "item_id", "x.para_no", "x.lang").distinct()


TOKENIZER = "byte_bpe_50k"


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k; [] for null and empty texts."""
    return encoding.encode_corpus(table(spark, base, "documents"), "doc_id", "text", encoding.tokenizer_path(TOKENIZER))


def _mix(spark: SparkSession, base: str) -> tuple[DataFrame, list[mixing.Share]]:
    rows = table(spark, base, "source_weights").select("source", "target_share", "max_repeats").limit(mixing.MAX_SOURCES + 1).collect()
    if len(rows) > mixing.MAX_SOURCES:
        raise ValueError(f"more than {mixing.MAX_SOURCES} sources")
    weights = [(r[0], r[1], r[2]) for r in rows]
    docs = table(spark, base, "documents").select("doc_id", mixing.canonical_source(F.col("source")).alias("source"), "text")
    docs = docs.filter(F.col("source").isin([w[0] for w in weights]))
    sized = checkpointed(encoding.with_token_counts(docs, "text", encoding.tokenizer_path(TOKENIZER)).select("doc_id", "source", "n_tokens"))
    available, largest = mixing.available_tokens(sized)
    shares = mixing.plan(weights, available)
    return mixing.mixture(sized, shares, largest), shares


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    """The mixture of all sources: each used copy of each document with its slot in the schedule."""
    return _mix(spark, base)[0]


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    """Target and actual share of every source in the mixture."""
    return mixing.report(*_mix(spark, base))


def p9_bounds(spark: SparkSession, base: str) -> DataFrame:
    """(source, within): whether every source stays within its caps and its tokens within one block of its quota."""
    mixed, shares = _mix(spark, base)
    sizes = mixed.agg(F.max("n_tokens")).first()[0] or 0
    block = max(sum(s.quota for s in shares) / mixing.BLOCKS, sizes)
    got = mixing.report(mixed, shares)
    quotas = spark.createDataFrame([(s.source, float(s.quota)) for s in shares], "source string, quota double")
    within = (F.abs(F.col("tokens") - F.col("quota")) <= block) & (F.col("most_repeats") <= F.col("max_repeats"))
    return got.join(quotas, "source").select("source", within.alias("within"))


def p10_bounds(spark: SparkSession, base: str) -> DataFrame:
    """One row of what is wrong with the pieces, all 0: too long, sharing other than the overlap, not part of the text, first or last token left out."""
    limits = table(spark, base, "split_limits").select("tokenizer", "max_tokens", "overlap_tokens").first()
    path = encoding.tokenizer_path(limits[0])
    pieces = checkpointed(p10_pieces(spark, base))
    recounted = encoding.with_token_counts(pieces, "text", path, "own_tokens").withColumn("before", F.lag("end_token").over(Window.partitionBy("doc_id").orderBy("piece_no")))
    docs = encoding.with_token_counts(table(spark, base, "documents").select("doc_id", F.col("text").alias("whole")), "whole", path, "all_tokens")
    ends = pieces.groupBy("doc_id").agg(F.min("first_token").alias("begin"), F.max("end_token").alias("end"))
    over = recounted.agg(F.count_if((F.col("n_tokens") > limits[1]) | (F.col("own_tokens") > limits[1])).alias("too_long"), F.count_if(F.col("before") - F.col("first_token") != limits[2]).alias("other_overlap"))
    torn = recounted.join(docs, "doc_id").agg(F.count_if(~F.contains("whole", "text")).alias("not_in_text"))
    cut = docs.filter(F.col("all_tokens") > limits[1]).join(ends, "doc_id", "left").agg(F.count_if(F.col("begin").isNull() | (F.col("begin") != 0) | (F.col("end") != F.col("all_tokens"))).alias("left_out"))
    return over.withColumn("not_in_text", torn.scalar()).withColumn("left_out", cut.scalar())


def p10_pieces(spark: SparkSession, base: str) -> DataFrame:
    """The pieces of every document over the limit of split_limits."""
    limits = table(spark, base, "split_limits").select("tokenizer", "max_tokens", "overlap_tokens").first()
    path = encoding.tokenizer_path(limits[0])
    return splitting.split_oversized(table(spark, base, "documents"), "doc_id", "text", path, limits[1], limits[2])


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents over the limit, those that the splitting operator cuts."""
    return p10_pieces(spark, base).filter(F.col("piece_no") == 1).select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_annotators": p2_annotators, "p2_agreement": p2_agreement, "p2_labels": p2_labels, "p3_found": p3_found, "p5_found": p5_found, "p5_matches": p5_matches, "p6_found": p6_found, "p6_categories": p6_categories, "p7_found": p7_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p6_listed": p6_listed, "p9_bounds": p9_bounds, "p10_bounds": p10_bounds, "p10_pieces": p10_pieces}
