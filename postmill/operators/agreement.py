"""Inter-annotator agreement: matching of skills within a record, F1, kappas, errors and bootstrap intervals."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import checkpointed

#: Names match from this word overlap or this similarity of characters on. Fixed values.
JACCARD, RATIO = 0.5, 0.8
#: Bootstrap rounds that must give a number, and the percentiles of the interval.
LEAST_VALID, LOW, HIGH = 10, 2.5, 97.5


@lru_cache(maxsize=200_000)
def is_match(a: str, b: str) -> bool:
    """Whether two normalised names mean the same skill: enough shared words, or else a like sequence of characters."""
    words = (frozenset(a.split()), frozenset(b.split()))
    shared, every = len(words[0] & words[1]), len(words[0] | words[1])
    return (every > 0 and shared >= JACCARD * every) or SequenceMatcher(None, a, b).ratio() >= RATIO


def match_records(mentions: DataFrame, left: str, right: str) -> DataFrame:
    """(record_id, name_a, name_b, label_a, label_b, category_a, category_b) by annotators `left` and `right`.

    `mentions`: record_id, annotator, ord, name (normalised), label, category. First fit in order of ord, one to
    one; an unmatched mention has nulls on the other side. A record must fit a task, as one annotator's list does.
    """
    columns = ("record_id", "ord", "name", "label", "category")

    def side(who: str) -> DataFrame:
        # fresh names: both sides come from one table, and a cogroup must tell their columns apart
        return mentions.filter(F.col("annotator") == who).select(*(F.col(c).alias(f"{who}_{c}") for c in columns)).toDF(*columns)


    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (x.sort_values("ord").to_dict("records") if len(x) else [] for x in (a, b))
        record = (a or b)[0]["record_id"]
        used: set[int] = set()
        rows = []
        for x in a:
            hit = next((k for k, y in enumerate(b) if k not in used and is_match(x["name"], y["name"])), None)
            if hit is not None:
                used.add(hit)
            y = b[hit] if hit is not None else {}
            rows.append((record, x["name"], y.get("name"), x["label"], y.get("label"), x["category"], y.get("category")))
        rows += [(record, None, y["name"], None, y["label"], None, y["category"]) for k, y in enumerate(b) if k not in used]
        return pd.DataFrame(rows, columns=["record_id", "name_a", "name_b", "label_a", "label_b", "category_a", "category_b"])

    schema = "record_id string, name_a string, name_b string, label_a string, label_b string, category_a string, category_b string"
    return side(left).groupBy("record_id").cogroup(side(right).groupBy("record_id")).applyInPandas(match, schema)


def three_way_match(mentions: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """(record_id, triple, name_a, name_b, name_c, label_a, label_b, label_c): skills that all three annotators name.

    Each pair of match_records of `a` and `b` takes the first free mention of `c` that matches its name by `a`;
    pairs without one go. `triple` numbers the triples of a record.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, z = (pdf[pdf["annotator"] == who].sort_values("ord").to_dict("records") for who in (a, b, c))
        used_y: set[int] = set()
        used_z: set[int] = set()
        rows = []
        for p in x:
            j = next((k for k, q in enumerate(y) if k not in used_y and is_match(p["name"], q["name"])), None)
            if j is None:
                continue
            used_y.add(j)
            h = next((k for k, q in enumerate(z) if k not in used_z and is_match(p["name"], q["name"])), None)
            if h is None:
                continue
            used_z.add(h)
            rows.append((p["record_id"], len(rows), p["name"], y[j]["name"], z[h]["name"], p["label"], y[j]["label"], z[h]["label"]))
        return pd.DataFrame(rows, columns=["record_id", "triple", "name_a", "name_b", "name_c", "label_a", "label_b", "label_c"])

    schema = "record_id string, triple int, name_a string, name_b string, name_c string, label_a string, label_b string, label_c string"
    rows = mentions.filter(F.col("annotator").isin(a, b, c)).select("record_id", "annotator", "ord", "name", "label")
    return rows.groupBy("record_id").applyInPandas(match, schema)


def match_equal(mentions: DataFrame, left: str, right: str) -> DataFrame:
    """Like match_records for equal names only, as a full join without Python; names must be unique within a list."""
    side = lambda who, s: mentions.filter(F.col("annotator") == who).select("record_id", "name", F.col("name").alias(f"name_{s}"), F.col("label").alias(f"label_{s}"), F.col("category").alias(f"category_{s}"))
    return side(left, "a").join(side(right, "b"), ["record_id", "name"], "full").drop("name")


def macro_f1(matches: DataFrame) -> DataFrame:
    """One row (records, precision, recall, f1): unweighted means over records, 0 where nothing can match."""
    per = matches.groupBy("record_id").agg(F.count("name_a").alias("a"), F.count("name_b").alias("b"), F.count_if(F.col("name_a").isNotNull() & F.col("name_b").isNotNull()).alias("m"))
    p = F.when(F.col("b") > 0, F.col("m") / F.col("b")).otherwise(0.0)
    r = F.when(F.col("a") > 0, F.col("m") / F.col("a")).otherwise(0.0)
    per = per.select("record_id", p.alias("p"), r.alias("r")).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    return per.agg(F.count("*").alias("records"), F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg("f"), 6).alias("f1"))


def both_sides(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("name_a").isNotNull() & F.col("name_b").isNotNull())


def confusion(matches: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): how often two ratings meet."""
    return both_sides(matches).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def cohen_kappa(matches: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, observed, expected, kappa); null below two pairs, 1.0 where all ratings are one class."""
    cells = confusion(matches, a, b).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("agree"))
    rows = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, "k").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)))
    out = total.withColumn("chance", chance.scalar())
    po, pe = F.try_divide("agree", "n"), F.try_divide(F.col("chance"), F.col("n").cast("double") * F.col("n"))
    return out.select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.when(F.col("n") >= 2, F.when(pe >= 1, 1.0).otherwise(F.round(F.try_divide(po - pe, 1 - pe), 6))).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, item: list[str], label: str, k: int = 3) -> DataFrame:
    """One row (items, kappa) over items with exactly `k` ratings; 1.0 where only one class occurs."""
    per = ratings.filter(F.col(label).isNotNull()).groupBy(*item, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    full = per.groupBy(*item).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.collect_list(F.struct("label", "n")).alias("cells")).filter(F.col("all") == k)
    agree = full.agg(F.count("*").alias("items"), F.avg((F.col("squares") - k) / F.lit(k * (k - 1)).cast("double")).alias("p"))
    shares = full.select(F.explode("cells").alias("c")).groupBy("c.label").agg(F.sum("c.n").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n")))
    out = agree.withColumn("s", shares.scalar())
    pe = F.try_divide(F.col("s"), F.col("items").cast("double") * k * F.col("items") * k)
    return out.select("items", F.when(pe >= 1, 1.0).otherwise(F.round(F.try_divide(F.col("p") - pe, 1 - pe), 6)).alias("kappa"))


def error_cases(matches: DataFrame, left: str, right: str) -> DataFrame:
    """`matches` with error: one side only (omitted by the other), label, category or both; rows in full agreement go."""
    label = ~F.col("label_a").eqNullSafe(F.col("label_b"))
    category = ~F.col("category_a").eqNullSafe(F.col("category_b"))
    error = (
        F.when(F.col("name_b").isNull(), f"only_{left}").when(F.col("name_a").isNull(), f"only_{right}")
        .when(label & category, "label_category_disagreement").when(label, "label_disagreement").when(category, "category_disagreement")
    )
    return matches.withColumn("error", error).filter("error is not null")


def bootstrap_interval(values: DataFrame, value: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row (mean, low, high): percentile interval of the mean by Poisson bootstrap.

    Equal values are drawn together, see resampled, so the interval doesn't depend on how rows are partitioned. Null with fewer than
    LEAST_VALID rounds that drew a row.
    """
    rows = values.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    drawn = resampled(rows.groupBy("v").agg(F.count("*").alias("n")), ["v"], rounds, seed)
    means = drawn.groupBy("round").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m"))
    mean = rows.agg(F.avg("v"))
    ok = F.count("*") >= LEAST_VALID
    return means.agg(F.when(ok, F.percentile("m", F.lit(LOW / 100))).alias("low"), F.when(ok, F.percentile("m", F.lit(HIGH / 100))).alias("high")).withColumn("mean", mean.scalar()).select("mean", "low", "high")


def resampled(cells: DataFrame, keys: list[str], rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(keys..., round, n): the counts `n` of each cell as every bootstrap round draws them.

    n like rows that each draw a Poisson weight of mean 1 add up to one Poisson draw of mean n, so the cells, not
    the rows, are drawn: work and shuffle are bounded by the number of different cells.
    """
    rows = cells.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("cell", F.xxhash64(*(F.col(k).cast("string") for k in keys)))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys]

    def draw(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                n = np.random.default_rng([seed, int(row["cell"]) & ((1 << 63) - 1)]).poisson(float(row["n"]), rounds)
                yield pd.DataFrame({**{k: [row[k]] * rounds for k in keys}, "round": np.arange(rounds), "n": n.astype(np.float64)})

    return rows.mapInPandas(draw, ", ".join([*fields, "round int", "n double"])).filter("n > 0")


def _interval(rounds: DataFrame, measure: str, value: DataFrame, column: str) -> DataFrame:
    """One row (measure, value, low, high) from a row (value) per round; nulls below LEAST_VALID rounds."""
    ok = F.count("value") >= LEAST_VALID
    low, high = (F.when(ok, F.percentile("value", F.lit(x / 100))) for x in (LOW, HIGH))
    out = rounds.agg(low.alias("low"), high.alias("high")).withColumn("value", value.select(column).scalar())
    return out.select(F.lit(measure).alias("measure"), "value", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def bootstrap_f1(matches: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row (measure, value, low, high): macro F1, records drawn."""
    per = matches.groupBy("record_id").agg(F.count("name_a").alias("a"), F.count("name_b").alias("b"), F.count_if(F.col("name_a").isNotNull() & F.col("name_b").isNotNull()).alias("m"))
    drawn = resampled(per.groupBy("a", "b", "m").agg(F.count("*").alias("n")), ["a", "b", "m"], rounds, seed)
    f = F.coalesce(F.try_divide(2 * F.col("m"), F.col("a") + F.col("b")), F.lit(0.0))
    means = drawn.groupBy("round").agg((F.sum(F.col("n") * f) / F.sum("n")).alias("value"))
    return _interval(means, "f1", macro_f1(matches), "f1")


def bootstrap_kappa(matches: DataFrame, a: str, b: str, measure: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row (measure, value, low, high): Cohen's kappa, matched pairs drawn."""
    cells = confusion(matches, a, b).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    drawn = checkpointed(resampled(cells, ["a", "b"], rounds, seed))
    total = drawn.groupBy("round").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0.0)).alias("agree"))
    rows, cols = (drawn.groupBy("round", F.col(x).alias("k")).agg(F.sum("n").alias(f"n{x}")) for x in ("a", "b"))
    chance = rows.join(cols, ["round", "k"]).groupBy("round").agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    po, pe = F.col("agree") / F.col("n"), F.coalesce("chance", F.lit(0.0)) / (F.col("n") * F.col("n"))
    kappas = total.join(chance, "round", "left").select("round", F.when(F.col("n") >= 2, F.when(pe >= 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe))).alias("value"))
    return _interval(kappas, measure, cohen_kappa(matches, a, b), "kappa")


def bootstrap_fleiss(ratings: DataFrame, item: list[str], label: str, k: int = 3, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row (measure, value, low, high): Fleiss' kappa, items of exactly `k` ratings drawn."""
    items = ratings.filter(F.col(label).isNotNull()).groupBy(*item).agg(F.sort_array(F.collect_list(label)).alias("labels")).filter(F.size("labels") == k)
    drawn = checkpointed(resampled(items.groupBy(F.to_json("labels").alias("labels")).agg(F.count("*").alias("n")), ["labels"], rounds, seed))
    each = drawn.select("round", "n", "labels", F.explode(F.from_json("labels", "array<string>")).alias("label"))
    counts = each.groupBy("round", "labels", "n", "label").agg(F.count("*").alias("c"))
    agree = counts.groupBy("round", "labels", "n").agg(((F.sum(F.col("c") * F.col("c")) - k) / F.lit(k * (k - 1))).alias("p"))
    agree = agree.groupBy("round").agg(F.sum("n").alias("items"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("p"))
    shares = counts.groupBy("round", "label").agg(F.sum(F.col("n") * F.col("c")).alias("s")).groupBy("round").agg(F.sum(F.col("s") * F.col("s")).alias("s"))
    pe = F.col("s") / (F.col("items") * F.col("items") * k * k)
    kappas = agree.join(shares, "round").select("round", F.when(F.col("items") >= 2, F.when(pe >= 1, 1.0).otherwise(F.try_divide(F.col("p") - pe, 1 - pe))).alias("value"))
    return _interval(kappas, "fleiss", fleiss_kappa(ratings, item, label, k), "kappa")


def status(value: Column, threshold: float, ci_low: Column | None = None, least_low: float = 0.6) -> Column:
    """N/A for null, PASS from the threshold on if the interval's lower end is null or high enough, else FAIL."""
    ok = value >= threshold
    if ci_low is not None:
        ok = ok & (ci_low.isNull() | (ci_low >= least_low))
    return F.when(value.isNull(), "N/A").when(ok, "PASS").otherwise("FAIL")


#: Least values of the report: F1, kappa of labels and of categories by pair of annotators, Fleiss' kappa. Fixed values.
F1_LEAST = {"llm_vs_human_a": 0.82, "llm_vs_human_b": 0.82, "human_a_vs_human_b": 0.85}
LABEL_LEAST = {"llm_vs_human_a": 0.70, "llm_vs_human_b": 0.70, "human_a_vs_human_b": 0.75}
CATEGORY_LEAST = {"llm_vs_human_a": 0.60, "human_a_vs_human_b": 0.65}
FLEISS_LEAST = 0.70


def run_report(mentions: DataFrame, records: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(task, pair, value, low, high, n, status): the whole report of the agreement, the last row the overall status.

    `mentions` as match_records takes them; `records` (record_id) are all records, also those in which nobody names a skill. Pairs of the annotators human_a, human_b and llm
    that occur are compared: t1 macro F1 (n records), t2 kappa of labels and Fleiss' kappa over all three, t3 kappa of categories (n rated pairs or triples). A measure of
    fewer than two ratings is left out. Overall is PASS if any measure has a status other than N/A and all those are PASS; its n counts the error cases.
    """
    names = {r[0] for r in mentions.filter(F.col("annotator").isin("human_a", "human_b", "llm")).select("annotator").distinct().collect()}
    pairs = [(a, b) for a, b in (("llm", "human_a"), ("llm", "human_b"), ("human_a", "human_b")) if {a, b} <= names]
    ids = records.select("record_id").distinct()
    parts: list[DataFrame] = []
    errors: list[DataFrame] = []

    def row(task: str, pair: str, interval: DataFrame, n: DataFrame, least: float, kappa: bool) -> DataFrame:
        out = interval.withColumn("n", n.scalar())
        state = status(F.col("value"), least, F.col("low") if kappa else None)
        return out.select(F.lit(task).alias("task"), F.lit(pair).alias("pair"), *(F.round(c, 4).alias(c) for c in ("value", "low", "high")), F.col("n").cast("long").alias("n"), state.alias("status"))

    for a, b in pairs:
        pair = f"{a}_vs_{b}"
        matches = checkpointed(match_records(mentions, a, b))
        every = matches.unionByName(ids, allowMissingColumns=True)
        parts.append(row("t1", pair, bootstrap_f1(every, rounds, seed), every.agg(F.countDistinct("record_id")), F1_LEAST[pair], False))
        for task, column, least in (("t2", "label", LABEL_LEAST), ("t3", "category", CATEGORY_LEAST)):
            if pair in least:
                rated = cohen_kappa(matches, f"{column}_a", f"{column}_b").select("n")
                parts.append(row(task, pair, bootstrap_kappa(matches, f"{column}_a", f"{column}_b", task, rounds, seed), rated, least[pair], True).filter("n >= 2"))
        errors.append(error_cases(matches, a, b).agg(F.count("*").alias("n")))
    if len(names) == 3:
        triples = checkpointed(three_way_match(mentions, "human_a", "human_b", "llm").select("record_id", "triple", F.explode(F.array("label_a", "label_b", "label_c")).alias("label")))
        items = fleiss_kappa(triples, ["record_id", "triple"], "label").select("items")
        parts.append(row("t2", "fleiss_kappa_all", bootstrap_fleiss(triples, ["record_id", "triple"], "label", 3, rounds, seed), items, FLEISS_LEAST, True).filter("n >= 2"))
    spark = mentions.sparkSession
    schema = "task string, pair string, value double, low double, high double, n long, status string"
    measures = spark.createDataFrame([], schema)
    for p in parts:
        measures = measures.unionByName(p)
    measures = checkpointed(measures)
    cases = spark.createDataFrame([(0,)], "n long")
    for e in errors:
        cases = cases.unionByName(e)
    valid = F.col("status") != "N/A"
    overall = measures.agg(F.when((F.count_if(valid) > 0) & (F.count_if(valid & (F.col("status") != "PASS")) == 0), "PASS").otherwise("FAIL").alias("status"))
    last = overall.select(F.lit("overall").alias("task"), F.lit("all").alias("pair"), *(F.lit(None).cast("double").alias(c) for c in ("value", "low", "high")), cases.agg(F.sum("n")).scalar().alias("n"), "status")
    return measures.unionByName(last)
