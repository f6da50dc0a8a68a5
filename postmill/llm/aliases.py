"""Further names of a reference list's entries, learnt from the data.

The lists' own alternative names are incomplete. Two names that stand for the same thing somewhere are evidence that they
mean the same entry: skills that several annotators wrote for one and the same mention, titles of two postings that alone
share company, place and pay. Where one of the two is a listed name and the other isn't, the other gets a vote
for that entry (names that are only spelt nearly like a listed one are not taken for it here). A name becomes an alias when
enough of its votes agree. Everything is counted by aggregates over
all rows; what reaches the driver is the vocabulary of learnt names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.entries import MAX_REFERENCE_KEYS, Affixes, Matcher, compact, entry_udf, fold, matcher_of, skill_forms, title_forms
from postmill.llm.names import city_bits, company_key
from postmill.session import checkpointed

Keys = list[tuple[int, str]]

#: An alias has at least MIN_VOTES votes for its entry, ALL_SHARE of its pairs, ANCHORED_SHARE of those with a listed name, and LEAD times the next entry's.
MIN_VOTES, ALL_SHARE, ANCHORED_SHARE, LEAD = 2, 0.2, 0.4, 2
#: Words around a name are generic when they stand around names of so many entries.
GENERIC_ENTRIES = 3


def core_title(value: str) -> list[str]:
    """The shortest form of a title, the one without remarks."""
    return sorted(title_forms(value), key=lambda f: (len(f), f))[:1]


def _forms_udf(forms: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    @F.pandas_udf("array<string>")
    def each(values: pd.Series) -> pd.Series:
        return values.map(lambda v: sorted({f for f in forms(v) if f}) if isinstance(v, str) else [])

    return each


def elected(votes: DataFrame) -> Keys:
    """(entry, name) from rows (form, entry, n); entry 0 stands for a partner that fits no entry.

    The learnt names are a vocabulary: more than MAX_REFERENCE_KEYS are refused, nothing is left out.
    """
    per = votes.groupBy("form", "entry").agg(F.sum("n").alias("n"))
    listed = F.when(F.col("entry") > 0, F.col("n")).otherwise(0)
    ranked = per.withColumn("next", F.lead(listed, 1, 0).over(Window.partitionBy("form").orderBy(listed.desc(), "entry")))
    top = ranked.groupBy("form").agg(
        F.sum("n").alias("every"), F.sum(listed).alias("anchored"), F.max(F.struct(listed.alias("n"), (-F.col("entry")).alias("minus"), "next")).alias("best")
    )
    n = F.col("best.n")
    good = top.filter((n >= MIN_VOTES) & (n >= ALL_SHARE * F.col("every")) & (n >= ANCHORED_SHARE * F.col("anchored")) & (n >= LEAD * F.col("best.next")))
    rows = good.select((-F.col("best.minus")).cast("int").alias("entry"), "form").limit(MAX_REFERENCE_KEYS + 1).collect()
    if len(rows) > MAX_REFERENCE_KEYS:
        raise ValueError(f"more than {MAX_REFERENCE_KEYS} learnt names")
    return sorted((r.entry, r.form) for r in rows)


def generic_affixes(keys: Keys, learnt: Keys) -> Affixes:
    """Words that stand before or after listed names of several entries in learnt ones, as in "knowledge of ..."."""
    own = defaultdict(set)
    for e, k in keys:
        own[e].add(compact(fold(k)))
    before, after = defaultdict(set), defaultdict(set)
    for e, name in learnt:
        words = name.split(" ")
        for k in range(1, len(words)):
            if compact(" ".join(words[k:])) in own[e]:
                before[" ".join(words[:k])].add(e)
            if compact(" ".join(words[:k])) in own[e]:
                after[" ".join(words[k:])].add(e)
    chosen = lambda side: frozenset(a for a, es in side.items() if len(es) >= GENERIC_ENTRIES)
    return Affixes(chosen(before), chosen(after))


def co_marked_votes(annotations: DataFrame, keys: Keys) -> DataFrame:
    """(form, entry, n): names that annotators wrote for a mention for which others wrote names of one listed entry.

    `annotations`: record_id, skills (an array of structs with mention_no and skill_name). A mention with names of
    several entries gives no votes; null and blank names count nowhere.
    """
    each = annotations.select("record_id", F.explode("skills").alias("s")).select("record_id", F.col("s.mention_no").alias("mention_no"), F.col("s.skill_name").alias("name"))
    each = each.filter(F.col("name").rlike(r"\S") & F.col("mention_no").isNotNull()).distinct()
    known = checkpointed(each.withColumn("entry", entry_udf(keys, skill_forms, exact=True)(F.col("name"))))
    anchors = known.filter("entry > 0").groupBy("record_id", "mention_no").agg(F.min("entry").alias("a"), F.max("entry").alias("b")).filter("a = b")
    loose = known.filter("entry = 0").join(anchors, ["record_id", "mention_no"], "left")
    voted = loose.select(F.explode(_forms_udf(skill_forms)(F.col("name"))).alias("form"), F.coalesce("a", F.lit(0)).alias("entry"))
    return voted.groupBy("form", "entry").agg(F.count("*").alias("n"))


def skill_vocabulary(annotations: DataFrame, keys: Keys) -> tuple[Keys, Affixes]:
    """The list's keys with the learnt ones, and the generic words around names."""
    learnt = elected(co_marked_votes(annotations, keys))
    affixes = generic_affixes(keys, learnt)
    return keys + further(keys, learnt, forms_of(affixes)), affixes


def further(keys: Keys, learnt: Keys, forms: Callable[[str], list[str]]) -> Keys:
    """The learnt names that don't come out at their entry without being learnt: misspelt listed names need no place in the list."""
    plain = Matcher(keys, forms)
    return [(e, name) for e, name in learnt if plain.best(name)[0] != e]


FACTS = "posting_id long, board int, company string, city long, low_kvnd long, high_kvnd long, job_title string, title int"


def posting_facts(postings: DataFrame, keys: Keys) -> DataFrame:
    """What title_votes reads of postings (posting_id, board, company, location, job_title, low_kvnd, high_kvnd)."""

    def run(batches):
        matcher = matcher_of(keys, title_forms)
        for pdf in batches:
            yield pd.DataFrame(
                {
                    "posting_id": pdf["posting_id"], "board": pdf["board"], "company": [company_key(x) for x in pdf["company"]], "city": [city_bits(x) for x in pdf["location"]], "low_kvnd": pdf["low_kvnd"],
                    "high_kvnd": pdf["high_kvnd"], "job_title": pdf["job_title"], "title": [matcher.listed(x) for x in pdf["job_title"]],
                }
            )

    return postings.select("posting_id", "board", "company", "location", "low_kvnd", "high_kvnd", "job_title").mapInPandas(run, FACTS)


def title_votes(facts: DataFrame) -> DataFrame:
    """(form, entry, n): titles of postings paired across the boards by company, place and pay, with the entry of the partner.

    A pair is a group of equal company with equal pay and city, equal pay, or equal city and one equal bound, in which each board
    has one title only. Groups with more titles say nothing and give no pair, so no pairs are multiplied out.
    Postings without company, title or pay vote nowhere. `facts` as posting_facts gives them; title <= 0 fits no entry.
    """
    c = F.col
    rows = facts.filter((c("company") != "") & c("job_title").rlike(r"\S") & ((c("low_kvnd") > 0) | (c("high_kvnd") > 0)))
    none = F.lit(0).cast("long")
    kinds = [
        (True, (c("city"), c("low_kvnd"), c("high_kvnd"))), (True, (none, c("low_kvnd"), c("high_kvnd"))), (c("low_kvnd") > 0, (c("city"), c("low_kvnd"), none)), (c("high_kvnd") > 0, (c("city"), none, c("high_kvnd"))),
    ]
    blocks = F.array_compact(F.array(*(F.when(F.lit(when) if when is True else when, F.struct(F.lit(i).alias("kind"), *(x.alias(n) for x, n in zip(key, ("city", "low", "high"))))) for i, (when, key) in enumerate(kinds))))
    # whether a board has one title only is told by hashes of the titles: numbers are aggregated without sorting
    name = F.when(c("title") > 0, c("title").cast("long")).otherwise(F.xxhash64(F.lower("job_title")))
    sides = [agg for b in (0, 1) for agg in (F.min(F.when(c("board") == b, c("posting_id"))).alias(f"id{b}"), F.min(F.when(c("board") == b, c("name"))).alias(f"least{b}"), F.max(F.when(c("board") == b, c("name"))).alias(f"most{b}"))]
    groups = rows.select("company", "board", "posting_id", name.alias("name"), F.explode(blocks).alias("k")).groupBy("company", "k.kind", "k.city", "k.low", "k.high").agg(*sides)
    pairs = checkpointed(groups.filter("least0 = most0 and least1 = most1").select("id0", "id1").distinct())
    x0, x1 = (rows.filter(c("board") == b).select(c("posting_id").alias(f"id{b}"), F.struct(F.greatest("title", F.lit(0)).alias("title"), "job_title").alias(f"x{b}")) for b in (0, 1))
    both = pairs.join(x0, "id0").join(x1, "id1").distinct()  # a posting may have several rows
    each = both.select(F.explode(F.array(F.struct(c("x0").alias("x"), c("x1.title").alias("entry")), F.struct(c("x1").alias("x"), c("x0.title").alias("entry")))).alias("p")).select("p.x", "p.entry")
    loose = each.filter("x.title = 0").select(F.explode(_forms_udf(core_title)(c("x.job_title"))).alias("form"), "entry")
    return loose.groupBy("form", "entry").agg(F.count("*").alias("n"))


def title_vocabulary(facts: DataFrame, keys: Keys) -> Keys:
    """The list's keys with the learnt ones."""
    return keys + further(keys, elected(title_votes(checkpointed(facts))), title_forms)


def forms_of(affixes: Affixes) -> Callable[[str], list[str]]:
    """skill_forms with generic words taken off."""
    return partial(skill_forms, affixes=affixes)
