"""Consensus labels from several annotators who disagree.

Iteratively reweighted voting: the weighted consensus of every item and the smoothed reliability of every
annotator, measured against the consensus of the others (the annotator's own vote left out), alternate until the
reliabilities are stable. An annotator's reliability is kept per true label, so that a habit of choosing one label
weighs less than an error. Agreement is Krippendorff's alpha, which corrects for chance and allows missing ratings.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.labels import required_vote as required_vote
from postmill.session import checkpointed

#: Annotators whose reliabilities are kept in a list; those of more stay a table.
MAX_LISTED = 100_000
#: Imaginary votes per annotator and true label before any is seen, and the share of them that is right.
PRIOR_VOTES, PRIOR_RIGHT = 10.0, 0.75
#: Reliabilities stay within [LEAST, 1 - LEAST].
LEAST = 0.02
#: Reliabilities that move less than STABLE are stable; a run that takes more than MAX_ROUNDS is an error, not a result.
MAX_ROUNDS, STABLE = 500, 1e-3


def latest_submissions(df: DataFrame, record: str, annotator: str, submitted: str, skills: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """The latest submission per record and annotator; of several at the same time the one with the greatest hash of its content counts.

    `keep` says what stays of each element of skills, all by default; only that is shuffled. A null time counts as the earliest. Rows without
    record or annotator are dropped.
    """
    content = F.transform(skills, keep) if keep else F.col(skills)
    rows = df.select(
        F.col(record).alias("record"), F.col(annotator).alias("annotator"), F.struct(F.col(submitted).alias("at"), F.xxhash64(skills).alias("h")).alias("order"), content.alias("skills")
    ).filter(F.col("record").isNotNull() & F.col("annotator").isNotNull())
    return rows.groupBy("record", "annotator").agg(F.max_by("skills", "order").alias("skills"))


def votes_of(items: DataFrame, label: Column) -> DataFrame:
    """(item columns..., annotator, vote): one vote per item and annotator, 1.0 for the positive label, 0.0 for the other.

    `items` has record, mention_no, annotator and what `label` reads; `label` gives 1, 0 or null (abstained). Of
    several votes of one annotator on an item the mean counts, a tie is an abstention.
    """
    voted = items.withColumn("vote", label.cast("double")).filter(F.col("vote").isNotNull() & F.col("mention_no").isNotNull())
    mean = voted.groupBy("record", "mention_no", "annotator").agg(F.avg("vote").alias("vote"))
    return mean.filter(F.col("vote") != 0.5).withColumn("vote", F.round("vote"))


def _solve(pp: float, pq: float, qq: float, pv: float, qv: float) -> tuple[float, float]:
    """(sens, spec) by least squares of an annotator's votes on the others' posterior p: vote = sens * p + (1 - spec) * (1 - p).

    The plain shares of votes would be pulled towards each other, because the others' consensus is uncertain. The
    imaginary prior votes smooth the estimate; it is kept off 0 and 1.
    """
    a, d, x, y = pp + PRIOR_VOTES, qq + PRIOR_VOTES, pv + PRIOR_VOTES * PRIOR_RIGHT, qv + PRIOR_VOTES * (1 - PRIOR_RIGHT)
    det = a * d - pq * pq
    sens, false = (x * d - y * pq) / det, (y * a - x * pq) / det
    return min(max(sens, LEAST), 1 - LEAST), min(max(1 - false, LEAST), 1 - LEAST)


def consensus(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) from rows (record, mention_no, annotator, vote).

    items: record, mention_no, n_votes, n_yes, score (log odds of the positive label) and vote (1.0 or 0.0; at
    even odds the majority, then the positive label). annotators: annotator, n_votes, sens and spec (smoothed
    shares of right votes where the others' consensus is positive and negative), reliability (their mean, 0.5 = no
    better than chance).
    """
    spark = votes.sparkSession
    item = ["record", "mention_no"]
    names = [r[0] for r in votes.select("annotator").distinct().limit(MAX_LISTED + 1).collect()]
    if len(names) > MAX_LISTED:
        return _consensus_of_many(votes)
    # annotators by number, so that a vote finds its weights in an array of at most MAX_LISTED entries
    names.sort()
    numbered = F.broadcast(spark.createDataFrame(list(enumerate(names)), "code int, annotator string"))
    # an item's votes in one row: gathered once, at most one per annotator; the rounds then need no shuffle of votes
    gathered = checkpointed(votes.join(numbered, "annotator").groupBy(*item).agg(F.sort_array(F.collect_list(F.struct("code", "vote"))).alias("votes")))
    state = [(PRIOR_RIGHT, PRIOR_RIGHT)] * len(names)
    log_prior = 0.0

    def scored(prior: float) -> DataFrame:
        weights = spark.createDataFrame([([math.log(s / (1 - p)) for s, p in state], [math.log((1 - s) / p) for s, p in state])], "yes array<double>, no array<double>")
        rows = gathered.withColumn("yes", weights.select("yes").scalar()).withColumn("no", weights.select("no").scalar())

        def own(v: Column) -> Column:
            return F.when(v["vote"] > 0, F.get("yes", v["code"])).otherwise(F.get("no", v["code"]))

        rows = rows.select(*item, "votes", F.transform("votes", own).alias("own"))
        return rows.withColumn("score", F.aggregate("own", F.lit(prior), lambda a, x: a + x))

    for _ in range(MAX_ROUNDS):
        rows = scored(log_prior)
        each = rows.select("score", F.explode(F.arrays_zip("votes", "own")).alias("v")).select(
            F.col("v.votes.code").alias("code"), F.col("v.votes.vote").alias("vote"), (1 / (1 + F.exp(-(F.col("score") - F.col("v.own"))))).alias("p")
        )
        found = each.groupBy("code").agg(*_moments()).collect()  # one row per annotator, at most MAX_LISTED
        new = {r.code: _solve(r.pp, r.pq, r.qq, r.pv, r.qv) for r in found}
        moved = max((abs(a - b) for k in new for a, b in zip(new[k], state[k])), default=0.0)
        for k, x in new.items():
            state[k] = x
        if found:
            yes, no = sum(r.yes for r in found), sum(r.no for r in found)
            log_prior = math.log((yes + 1) / (no + 1))
        if moved < STABLE:
            break
    else:
        raise RuntimeError(f"reliabilities still move by {moved:.2g} after {MAX_ROUNDS} rounds")
    final = scored(log_prior)
    n_yes = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x["vote"])
    items = _decided(final.select(*item, F.size("votes").alias("n_votes"), n_yes.cast("int").alias("n_yes"), "score"))
    counts = votes.groupBy("annotator").agg(F.count("*").alias("n_votes"))
    reliability = spark.createDataFrame([(a, s, p) for a, (s, p) in zip(names, state)], "annotator string, sens double, spec double")
    annotators = counts.join(F.broadcast(reliability), "annotator").withColumn("reliability", (F.col("sens") + F.col("spec")) / 2)
    return items, annotators


def _moments() -> list[Column]:
    """Sums over an annotator's votes for the least squares of _solve, and of the posteriors."""
    p, q, v = F.col("p"), 1 - F.col("p"), F.col("vote")
    return [F.sum(x).alias(n) for n, x in (("pp", p * p), ("pq", p * q), ("qq", q * q), ("pv", p * v), ("qv", q * v), ("yes", p), ("no", q))]


def _decided(items: DataFrame) -> DataFrame:
    even = F.abs("score") < 1e-12
    return items.withColumn("vote", F.when(F.col("score") > 0, 1.0).when(~even, 0.0).when(2 * F.col("n_yes") >= F.col("n_votes"), 1.0).otherwise(0.0))


def _consensus_of_many(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """consensus() for more annotators than a list may hold: their reliabilities stay a table that each round joins to the votes."""
    item = ["record", "mention_no"]
    votes = checkpointed(votes.select(*item, "annotator", "vote"))
    state = checkpointed(votes.groupBy("annotator").agg(F.count("*").alias("n_votes")).withColumns({"sens": F.lit(PRIOR_RIGHT), "spec": F.lit(PRIOR_RIGHT)}))
    log_prior = 0.0

    def weighed() -> tuple[DataFrame, DataFrame]:
        own = F.when(F.col("vote") > 0, F.log(F.col("sens") / (1 - F.col("spec")))).otherwise(F.log((1 - F.col("sens")) / F.col("spec")))
        each = votes.join(state, "annotator").select(*item, "annotator", "vote", own.alias("own"))
        sums = each.groupBy(*item).agg((F.lit(log_prior) + F.sum("own")).alias("score"), F.count("*").cast("int").alias("n_votes"), F.sum("vote").cast("int").alias("n_yes"))
        return each, sums

    def kept(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(LEAST)), F.lit(1 - LEAST))

    for _ in range(MAX_ROUNDS):
        each, sums = weighed()
        posterior = each.join(sums, item).select("annotator", "vote", (1 / (1 + F.exp(-(F.col("score") - F.col("own"))))).alias("p"))
        a, d, x, y = F.col("pp") + PRIOR_VOTES, F.col("qq") + PRIOR_VOTES, F.col("pv") + PRIOR_VOTES * PRIOR_RIGHT, F.col("qv") + PRIOR_VOTES * (1 - PRIOR_RIGHT)
        det = a * d - F.col("pq") * F.col("pq")
        new = posterior.groupBy("annotator").agg(*_moments()).select("annotator", "yes", "no", kept((x * d - y * F.col("pq")) / det).alias("s"), kept(1 - (y * a - x * F.col("pq")) / det).alias("p"))
        both = checkpointed(state.join(new, "annotator"))
        r = both.agg(F.max(F.greatest(F.abs(F.col("s") - F.col("sens")), F.abs(F.col("p") - F.col("spec")))).alias("moved"), F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
        state = both.select("annotator", "n_votes", F.col("s").alias("sens"), F.col("p").alias("spec"))
        log_prior = math.log((r.yes + 1) / (r.no + 1))
        if r.moved < STABLE:
            break
    else:
        raise RuntimeError(f"reliabilities still move by {r.moved:.2g} after {MAX_ROUNDS} rounds")
    items = _decided(weighed()[1].select(*item, "n_votes", "n_yes", "score"))
    return items, state.withColumn("reliability", (F.col("sens") + F.col("spec")) / 2)


def krippendorff_alpha(votes: DataFrame, item: list[str], label: str) -> DataFrame:
    """One row (n_items, n_ratings, observed, expected, alpha) for nominal labels with missing ratings.

    Only items with two or more ratings count. alpha is 1 - observed / expected disagreement; it is 1.0 where
    all ratings are one label and null where no item has two ratings.
    """
    per = votes.filter(F.col(label).isNotNull()).groupBy(*item, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    items = per.groupBy(*item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.collect_list(F.struct("label", "n")).alias("labels")).filter("m >= 2")
    items = items.withColumn("disagree", (F.col("m") * F.col("m") - F.col("squares")) / (F.col("m") - 1).cast("double"))
    totals = items.agg(F.count("*").alias("n_items"), F.sum("m").alias("n_ratings"), F.sum("disagree").alias("disagree"))
    marginals = items.select(F.explode("labels").alias("x")).groupBy("x.label").agg(F.sum("x.n").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    n = F.col("n_ratings").cast("double")
    observed = F.try_divide(F.col("disagree"), n)
    expected = F.try_divide(n * n - F.col("squares"), n * (n - 1))
    both = totals.withColumn("squares", marginals.scalar())
    return both.select("n_items", F.coalesce("n_ratings", F.lit(0)).alias("n_ratings"), observed.alias("observed"), expected.alias("expected"), F.when(expected > 0, 1 - F.try_divide(observed, expected)).when(n > 0, 1.0).alias("alpha"))
