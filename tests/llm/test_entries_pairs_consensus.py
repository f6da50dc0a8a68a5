import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.llm import aliases, consensus, entries, pairs


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
        if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12), st.text("abc", max_size=7), st.integers(0, 2))
def test_automaton_finds_all_entries_within_the_distance(keys, query, limit):
    trie = entries.Trie()
    for i, k in enumerate(keys):
        trie.add(k, i, k)
    got = {(d, e) for d, e, _ in trie.search(query, limit)}
    assert got == {(osa(query, k), i) for i, k in enumerate(keys) if osa(query, k) <= limit}


TITLES = [(1, "Backend Engineer"), (2, "AI Engineer"), (3, "Bridge Engineer"), (4, "Technical Leader"), (4, "Tech Lead"), (5, "Kỹ sư dữ liệu"), (6, "Pre Sales Consultant (IT)")]
SKILLS = [(1, "Java"), (2, "JavaScript"), (3, "SQL"), (4, "C++"), (5, "C#"), (6, "Node.js"), (7, "Giao tiếp"), (8, "CI/CD"), (9, "Go")]


def test_titles():
    m = entries.Matcher(TITLES, entries.title_forms)
    cases = {
        "[JOB-12] Senior Backend Engineer (Hybrid) x 3": 1, "🔥 Bakcend Engineer - Lead, Java/SQL": 1, "BI Engineer": 0, "AI Enginer": 2, "(HOT) Jr. tech lead - Python": 4, "Ky su du lieu - Junior": 5,
        "Cần tuyển Pre Sales Consultant (IT) - Senior": 6, "Kỹ sư xây dựng cầu đường": 0, "": 0, "  ": 0, None: 0, "x" * 5000: 0, "-": 0,
    }
    assert {c: m.best(c)[0] for c in cases} == cases
    assert m.best("Senior Backend Engineer") == m.best("Senior Backend Engineer")  # from the cache


def test_skills():
    m = entries.Matcher(SKILLS, entries.skill_forms)
    cases = {"java": 1, " Kiến thức về Java ": 1, "JavaCard": 0, "SQLite": 0, "Sql_": 3, "c ++": 4, "C#": 5, "node JS": 6, "Giao tiếp": 7, "ky nang giao tiep": 7, "CI-CD": 8, "CI-CD pipeline": 0, "Java (cơ bản)": 1, "JavaSript": 2, "Git": 0, "Go": 9, "G": 0}
    assert {c: m.best(c)[0] for c in cases} == cases
    assert {e for _, e, _ in m.all("JavaSript")} == {2}


def test_affixes_are_taken_off():
    m = entries.Matcher(SKILLS, lambda v: entries.skill_forms(v, entries.Affixes(frozenset({"knowledge of"}), frozenset({"pipeline"}))))
    assert [m.best(x)[0] for x in ("knowledge of CI/CD pipeline", "pipeline", "Knowledge of", "knowledge of baking")] == [8, 0, 0, 0]
    assert len(entries.skill_forms("kinh nghiệm " * 40 + "x")) == 41  # however many words stand before a name


def test_names_learnt_from_mentions(spark):
    def marks(record, *names):
        return [(record, [(k, n) for k, n in enumerate(ns)]) for ns in names]

    rows = []
    for k, name in enumerate(["Java", "SQL", "C++", "Go"]):
        rows += marks(f"a{k}", [name], [f"all about {name}"]) + marks(f"b{k}", [name.upper()], [f"all about {name}"])
    rows += marks("c1", ["JavaScript"], ["ECMA"]) + marks("c2", ["javascript"], ["ecma"]) + marks("c3", ["SQL"], ["ecma"])
    rows += marks("d1", ["Java"], ["coffee"]) + marks("e1", ["Java"], ["SQL"], ["both"]) + marks("e2", ["Java"], ["SQL"], ["both"])
    rows += marks("f1", ["Karaoke"], ["singing"]) + marks("f2", ["Karaoke"], ["singing"]) + [("g", None), (None, [(1, None)])]
    df = spark.createDataFrame(rows, "record_id string, skills array<struct<mention_no:int,skill_name:string>>").withColumn("entry", F.lit("clash"))
    keys, affixes = aliases.skill_vocabulary(df, SKILLS)
    learnt = set(keys) - set(SKILLS)
    assert learnt == {(2, "ecma")}  # the other names come out by their generic words
    m = entries.Matcher(keys, aliases.forms_of(affixes))
    assert [m.best(x)[0] for x in ("All about Java", "all about C++", "ECMA", "coffee", "both", "singing", "all about nothing")] == [1, 4, 2, 0, 0, 0, 0]
    assert affixes.before == {"all about"} and not affixes.after
    assert aliases.skill_vocabulary(df.limit(0), SKILLS) == (SKILLS, entries.Affixes())


def test_titles_learnt_from_postings(spark):
    rows = []
    for k in range(6):  # "Server Dev" alone shares company, place and pay with "Backend Engineer"
        rows += [(k, 0, f"comp{k}", 1, 10, 20, "Senior Server Dev (HOT)"), (100 + k, 1, f"comp{k}", 1, 10, 20, "Backend Engineer")]
        rows += [(200 + k, 0, f"other{k}", 1, 10, 0, "Landscaper"), (300 + k, 1, f"other{k}", 1, 10, 0, "Gardener")]
    # a company with many titles of equal pay says nothing
    rows += [(400 + k, k % 2, "hot", 1, 7, 7, t) for k, t in enumerate(["Cook", "AI Engineer", "Driver", "Bridge Engineer"] * 5)]
    rows += [(1, 0, None, 0, 0, 0, None), (900, 1, "", 1, 5, 5, "Backend Engineer")]
    df = spark.createDataFrame([(i, b, c, "Hanoi" if p else None, low, high, t) for i, b, c, p, low, high, t in rows], "posting_id long, board int, company string, location string, low_kvnd long, high_kvnd long, job_title string")
    got = aliases.title_vocabulary(aliases.posting_facts(df, TITLES), TITLES)
    assert set(got) - set(TITLES) == {(1, "server dev")}
    assert aliases.title_vocabulary(aliases.posting_facts(df.limit(0), TITLES), TITLES) == TITLES


def test_entry_udf(spark):
    f = entries.entry_udf(SKILLS, entries.skill_forms)
    df = spark.createDataFrame([("java",), (None,), ("",), ("java",), ("nothing",)], "s string")
    assert [r.x for r in df.select(f(F.col("s")).alias("x")).collect()] == [1, 0, 0, 1, 0]
    assert df.limit(0).select(f(F.col("s"))).count() == 0


def test_gram_against_counting(spark):
    rng = random.Random(5)
    baskets = [sorted(rng.sample(range(1, 2500), rng.randint(0, 9))) for _ in range(400)] + [[1, 2]] * 30 + [None]
    df = spark.createDataFrame([(b, "clash") for b in baskets], "items array<int>, n string")
    want: dict[tuple[int, int], int] = {}
    for b in baskets:
        for a, c in itertools.combinations_with_replacement(b or [], 2):
            want[a, c] = want.get((a, c), 0) + 1
    assert {(r.item_a, r.item_b): r.n for r in pairs.gram(df).collect()} == want
    assert pairs.gram(df.limit(0)).count() == 0


def test_products_of_many_items_in_bounded_pieces(monkeypatch):
    rng = random.Random(3)
    baskets = [rng.sample(range(1_000_000), rng.randint(0, 40)) for _ in range(300)] + [list(range(1500))]
    flat, sizes = np.array([x for b in baskets for x in b], dtype=np.int64), np.array([len(b) for b in baskets])
    monkeypatch.setattr(pairs, "PRODUCTS", 5000)
    parts = list(pairs._products(flat, sizes))
    assert len(parts) > 100 and max(len(c) for c, _ in parts) <= 5000
    codes, n = pairs._summed(parts)
    want = Counter((a << 32) | c for b in baskets for a, c in itertools.combinations_with_replacement(sorted(b), 2))
    assert dict(zip(codes.tolist(), n.tolist())) == want


def test_associations_and_baskets(spark):
    rows = [("r1", 1), ("r1", 2), ("r1", 2), ("r2", 1), ("r2", 2), ("r3", 3), ("r4", 0), ("r5", None), (None, 1)]
    df = spark.createDataFrame(rows, "r string, i int")
    found = pairs.associations(pairs.baskets_of(df, "r", "i")).collect()
    assert [(x.item_a, x.item_b, x.n_ab, x.n_a, x.n_b, x.n) for x in found] == [(1, 2, 2, 2, 2, 5)]
    assert found[0].lift == pytest.approx(5 * 2 / 4)
    assert pairs.associations(pairs.baskets_of(df.limit(0), "r", "i")).count() == 0


def test_rare_items_leave_without_changing_the_frequent_pairs(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([([x for x in range(1, 40) if rng.random() < 3 / (x + 3)],) for _ in range(500)], "items array<int>")
    every = {(r.item_a, r.item_b): r.asDict() for r in pairs.associations(df).collect()}
    some = {(r.item_a, r.item_b): r.asDict() for r in pairs.associations(df, least=3, least_share=0.04).collect()}
    assert some == {k: v for k, v in every.items() if v["n_ab"] >= 20} and 0 < len(some) < len(every)


SKILL = {"good1": (0.95, 0.95), "good2": (0.9, 0.9), "fair": (0.8, 0.75), "always_yes": (0.97, 0.1), "liar": (0.1, 0.15), "coin": (0.5, 0.5)}


def simulated(seed, items=600):
    rng = random.Random(seed)
    truth, rows = {}, []
    for i in range(items):
        truth[i] = rng.random() < 0.55
        for a in rng.sample(sorted(SKILL), 4):
            right = rng.random() < SKILL[a][not truth[i]]
            rows.append((str(i), 1, a, float(truth[i] == right)))
    return truth, rows


def test_consensus_is_near_the_best_that_known_skills_allow(spark):
    truth, rows = simulated(11)
    df = spark.createDataFrame(rows, "record string, mention_no int, annotator string, vote double")
    items, annotators = consensus.consensus(df)
    got = {int(r.record): r.vote > 0 for r in items.collect()}
    votes: dict[int, list[tuple[str, float]]] = {}
    for r, _, a, v in rows:
        votes.setdefault(int(r), []).append((a, v))

    def best(vs):
        odds = math.log(0.55 / 0.45)
        for a, v in vs:
            sens, spec = SKILL[a]
            odds += math.log(sens / (1 - spec)) if v else math.log((1 - sens) / spec)
        return odds > 0

    share = sum(got[i] == truth[i] for i in truth) / len(truth)
    optimum = sum(best(v) == truth[i] for i, v in votes.items()) / len(truth)
    majority = sum((sum(x for _, x in v) * 2 >= len(v)) == truth[i] for i, v in votes.items()) / len(truth)
    assert share >= optimum - 0.03 and share > majority + 0.05, (share, optimum, majority)
    rel = {r.annotator: r.reliability for r in annotators.collect()}
    assert rel["liar"] < 0.4 < rel["coin"] < 0.65 < rel["fair"] < rel["good1"]


def test_consensus_of_many_annotators_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame(simulated(5, 200)[1], "record string, mention_no int, annotator string, vote double")
    few = [t.collect() for t in consensus.consensus(df)]
    monkeypatch.setattr(consensus, "MAX_LISTED", 3)
    many = [t.collect() for t in consensus.consensus(df)]
    assert {(r.record, r.vote, r.n_votes, r.n_yes) for r in few[0]} == {(r.record, r.vote, r.n_votes, r.n_yes) for r in many[0]}
    assert {r.annotator: (round(r.sens, 9), r.n_votes) for r in few[1]} == {r.annotator: (round(r.sens, 9), r.n_votes) for r in many[1]}


def test_consensus_is_stable_or_an_error(spark, monkeypatch):
    df = spark.createDataFrame(simulated(11, 60)[1], "record string, mention_no int, annotator string, vote double")
    monkeypatch.setattr(consensus, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        consensus.consensus(df)


def test_consensus_edges(spark):
    schema = "record string, mention_no int, annotator string, vote double"
    items, annotators = consensus.consensus(spark.createDataFrame([], schema))
    assert items.count() == 0 and annotators.count() == 0
    tie = consensus.consensus(spark.createDataFrame([("1", 1, "a", 1.0), ("1", 1, "b", 0.0)], schema))[0].collect()
    assert len(tie) == 1 and tie[0].n_votes == 2


def test_latest_and_votes(spark):
    rows = [("1", "a", "2025-01-01 00:00:00", "required"), ("1", "a", "2025-02-01 00:00:00", "nice to have"), ("1", "a", "2025-02-01 00:00:00", "nice to have"), ("1", "b", None, "n/a"), (None, "a", None, "required")]
    df = spark.createDataFrame(rows, "r string, a string, t string, l string").select("r", "a", F.col("t").cast("timestamp_ntz").alias("t"), F.array(F.struct(F.lit(1).alias("mention_no"), "l")).alias("s"), F.lit(1).alias("vote"))
    latest = consensus.latest_submissions(df, "r", "a", "t", "s")
    each = latest.select("record", "annotator", F.explode("skills").alias("x")).select("record", "annotator", "x.mention_no", "x.l")
    votes = consensus.votes_of(each, consensus.required_vote(F.col("l"))).collect()
    assert [(v.record, v.annotator, v.vote) for v in votes] == [("1", "a", 0.0)]


def test_alpha(spark):
    # two coders, nominal: observed 1 of 4 items differ
    rows = [(1, "x"), (1, "x"), (2, "x"), (2, "x"), (3, "y"), (3, "y"), (4, "x"), (4, "y"), (5, "x")]
    a = consensus.krippendorff_alpha(spark.createDataFrame(rows, "item int, label string"), ["item"], "label").first()
    n, do, de = 8, 2 / 8, (64 - 25 - 9) / (8 * 7)
    assert (a.n_items, a.n_ratings) == (4, n) and a.alpha == pytest.approx(1 - do / de)
    assert consensus.krippendorff_alpha(spark.createDataFrame([], "item int, label string"), ["item"], "label").first().alpha is None
