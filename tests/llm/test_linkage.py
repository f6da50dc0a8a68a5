import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from postmill.llm import linkage, names
from postmill.llm.entries import matcher_of, title_forms

TITLES = [(1, "Backend Engineer"), (2, "Data Analyst"), (3, "QA Engineer")]
SKILLS = [(i, s) for i, s in enumerate(["Java", "SQL", "Git", "Python", "Docker", "React"], 1)]


def postings(spark, n=120, seed=1):
    """n jobs on both boards with noise, some posted twice on one board, and a company with half of all postings."""
    rng = random.Random(seed)
    rows, truth = [], set()
    for k in range(n):
        company = "Bigcorp Group" if k % 2 else f"{''.join(rng.choices('bdfgklmnprst', k=6))} Labs"
        title, city = rng.choice(TITLES)[1], rng.choice(["Ha Noi", "Ho Chi Minh", "Da Nang"])
        project, size, low = f"{rng.choice(['Amber', 'Cobalt', 'Raven', 'Tundra'])}{rng.choice(['lane', 'port', 'mill'])}{k % 7}{k}", rng.randint(4, 50), rng.randint(10, 60) * 1000
        picked = ", ".join(s for _, s in rng.sample(SKILLS, 3))
        a = (2 * k, 0, f"{company} JSC", f"Senior {title}", f"12 Some St, {city}", picked, f"You join project {project}, a team of {size}.", low, low + 5000)
        b = (100_000 + 2 * k, 1, f"Công ty TNHH {company.upper()}", f"[JOB-{k}] {title}", f"Việc làm tại {city}", str(picked.split(", ") + ["English"]), f"Dự án: {project}, quy mô {size + rng.choice([-1, 0, 1])} nhân sự.", low, low + 5000)
        rows += [a, b]
        truth.add((a[0], b[0]))
        if k % 10 == 0:
            rows.append((b[0] + 1, *b[1:]))
            truth.add((a[0], b[0] + 1))
    rows += [(90_000, 0, None, None, None, None, None, None, None), (190_000, 1, "", " ", "", "[]", "x" * 50_000, None, None), rows[0]]
    schema = "posting_id long, board int, company string, job_title string, location string, required_skills string, job_description string, low_kvnd long, high_kvnd long"
    return spark.createDataFrame(rows, schema).withColumn("crawled_at", F.lit("2025-01-01").cast("timestamp_ntz")).withColumn("score", F.lit("clash")), truth


def test_links_jobs_and_their_reposts(spark):
    df, truth = postings(spark)
    got = {(r.id_a, r.id_b): r.confidence for r in linkage.link(df, TITLES, SKILLS).collect()}
    assert len(set(got) & truth) >= 0.95 * len(truth) and len(set(got) - truth) <= 0.05 * len(truth)
    assert all(0.5 < c <= 1 for c in got.values())


def test_window_pairs_equal_all_pairs_in_a_small_table(spark):
    df, _ = postings(spark, 12, 3)
    rows = linkage.features(df, TITLES, SKILLS).drop("job_title")
    wide = {(r.id_a, r.id_b): r.score for r in linkage.neighbour_pairs(rows, 200).collect()}
    found = {(r.id_a, r.id_b): r.score for r in linkage.neighbour_pairs(rows, linkage.WINDOW).collect()}
    assert found == wide and len(found) >= 12


FEATURES = "posting_id long, board int, company string, title int, level int, city long, facts string, low long, high long, skills binary"


def test_short_and_empty_partitions_lose_no_pair(spark):
    rng = random.Random(9)
    rows = [(k, k % 2, f"company{k % 3}", 1, 0, 1, "", 5, 9, bytes([rng.randrange(8)])) for k in range(60)]
    df = spark.createDataFrame(rows, FEATURES)
    whole, cut = ({(r.id_a, r.id_b, r.score) for r in linkage.neighbour_pairs(df, 7, parts).collect()} for parts in (1, 45))
    assert whole == cut and len(whole) > 100


def test_names_that_descriptions_count():
    named = linkage.named_counts
    assert named("Bạn tham gia dự án Marblebird-12 với 47 thành viên.") == [("marblebird", 47)] and named(None) == named("") == []
    assert named("We are Ravenport. The group behind Lagoon counts 4 people! Lagoon grows. On Redis since 9 years") == [("lagoon", 4), ("redis", 9)]
    assert named("- Ask for Redis 3 times", frozenset({"redis"})) == [] and len(named("x Amber " + "9" * 60)) == 1
    agree = lambda a, b: linkage._facts_agree(linkage._counts(a), linkage._counts(b))
    assert agree("amber:4,raven:9", "raven:10") == 6 and agree("amber:4,raven:9", "raven:30") == -2 and agree("a:1,b:2", "c:1") == -3


def test_names_that_descriptions_count_are_those_of_its_sentences():
    def plainly(text):
        out = {}
        for sentence in re.split(r"[.\n\r\u3002!?]+", text):
            if m := re.search(r"(?<![\w-])\d+(?![\w-])", sentence):
                count = int(m.group()) if len(m.group()) < 19 else linkage._h(m.group())
                sentence = sentence.strip(" -*\u2022+\t")
                out |= {(n.group().lower(), count): None for n in re.finditer(r"(?<![\w.-])[A-Z][a-z]{3,}(?![a-z])", sentence) if n.start()}
        return list(out)

    rng, words, found = random.Random(3), ["Amber", "Raven", "abcDefgh", "Abcd-ef", "Team", "\u00c9lan", "12", "7", "-9", "4a", "1.5", "\u0663\u0664", "9" * 25, ".", "\u3002", "\n", "?!", "- ", "\u2022 ", " "], 0
    for _ in range(20_000):
        text = rng.choice([" ", ""]).join(rng.choices(words, k=rng.randint(0, 14)))
        assert linkage.named_counts(text) == plainly(text), text
        found += bool(plainly(text))
    assert found > 1000


def test_keys_become_rows_without_an_array_of_them(spark):
    rng, heavy = random.Random(12), ["hot"]
    rows = [(k, k % 2, rng.choice(["hot", "small", ""]), rng.choice([-5, 0, 1]), 1, k % 3, rng.choice(["", "amber:4", "amber:30,raven:7"]), k % 4, rng.choice([0, k % 4, 9]), bytes([k])) for k in range(100)]
    df = spark.createDataFrame(rows, FEATURES)
    got = linkage.keyed_rows(df, heavy)
    want = []
    for name, block, rest, whole, value in linkage._sort_keys(heavy):
        mine = df.filter("facts != ''").withColumn("fact", F.explode(F.split("facts", ","))) if name in linkage.FACT_PASSES else df
        key = F.concat(F.lit(name).cast("binary"), block)
        want += mine.select(*df.columns, F.lit(name).alias("pass"), key.alias("key"), rest.alias("rest"), whole.alias("whole"), value.alias("value")).filter("key is not null").collect()
    assert got.columns == [*df.columns, "pass", "key", "rest", "whole", "value"] and sorted(map(repr, got.collect())) == sorted(map(repr, want))
    # exploded arrays of keys took three times the CPU seconds; what is exploded are the counted names alone
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand ") == 2 and plan.count("Generate ") == 1


def test_titles_are_read_once_for_all_tasks_of_a_worker(spark):
    rows = [(k, 0, None, f"Senior Backend Engineer ({k % 2})", None, None, None, None, 0, 0) for k in range(8)]
    df = spark.createDataFrame(rows, "posting_id long, board int, company string, job_title string, location string, required_skills string, job_description string, crawled_at timestamp_ntz, low_kvnd long, high_kvnd long")
    assert {(r.title, r.level) for r in linkage.features(df, TITLES, SKILLS).collect()} == {(1, 1)}
    other = [(2, "Backend Engineer")]  # another list is not answered from the first one's
    assert {(r.title, r.level) for r in linkage.features(df, other, SKILLS).collect()} == {(2, 1)}
    assert matcher_of(TITLES, title_forms).known is matcher_of(TITLES, title_forms).known is not matcher_of(other, title_forms).known


def test_large_block_with_names_on_one_side_and_no_pay(spark):
    rng, n, rows = random.Random(5), 300, []
    for k in range(n):
        level, picked = rng.randint(1, 4), sum(1 << x for x in rng.sample(range(1, 106), 5)).to_bytes(14, "little")
        rows += [(k, 0, "hot", 1, level, 1, f"p{rng.random()}:9".replace(".", ""), 0, 0, picked), (100_000 + k, 1, "hot", 1, level, 1, "", 0, 0, picked)]
    rows += [(200_000 + k, 1, f"filler{k}", 2, 0, 2, "", 0, 0, bytes(14)) for k in range(14_000)]  # of a company with a third of all rows such postings say too little
    found = linkage.neighbour_pairs(spark.createDataFrame(rows, FEATURES)).filter("id_b = id_a + 100000")
    assert found.count() >= 0.98 * n


def test_equal_keys_mix_the_boards(spark):
    n = 200
    rows = [(board * 10**6 + k, board, "hot", 1, 1, 1, "", 5, 5, bytes([7])) for board in (0, 1) for k in range(n)]
    pairs = linkage.neighbour_pairs(spark.createDataFrame(rows, FEATURES)).filter("board_a != board_b")
    assert linkage.assign(pairs).count() >= 0.9 * n


def test_blocks_larger_than_the_window_lose_no_pair(spark):
    rng, n, rows = random.Random(8), 600, []
    for k in range(n):  # a company unknown, the counted size off by one, 60 postings of each size
        rows += [(k, 0, "", 1, 0, 1, f"amber:{10 + k % 10}", 0, 0, bytes(14)), (100_000 + k, 1, f"c{rng.random()}".replace(".", ""), 1, 0, 1, f"amber:{11 + k % 10}", 0, 0, bytes(14))]
    for k in range(n, 2 * n):  # of one company, title and pay, a place and a skill more on one board
        picked = rng.sample(range(104), 6)
        sides = [sum(1 << x for x in chosen).to_bytes(14, "little") for chosen in (picked[:5], picked)]
        rows += [(k, 0, "hot", 2, 0, 1, f"p{rng.random()}:9".replace(".", ""), 10, 20, sides[0]), (100_000 + k, 1, "hot", 2, 0, 3, "", 10, 20, sides[1])]
    df = spark.createDataFrame(rows, FEATURES)
    found = linkage.neighbour_pairs(df).filter("id_b = id_a + 100000 or id_a = id_b + 100000")
    assert found.filter(f"id_a < {n}").count() == found.filter(f"id_a >= {n}").count() == n


def test_pairs_of_one_company_are_all_compared(spark):
    rng, rows = random.Random(11), []
    for k in range(900):
        low, fact = rng.choice([0, 10, 20]), rng.choice(["", "amber:4", "amber:5", "raven:9", "amber:30,raven:7"])
        rows.append((k, k % 2, rng.choice(["hot", "hot", "hot", "small", ""]), rng.choice([0, 1, 1, 2]), rng.choice([0, 1]), rng.choice([0, 1, 2, 3]), fact, low, 40 + low if low else 0, bytes([rng.randrange(4)])))
    df = spark.createDataFrame(rows, FEATURES)
    company = {r[0]: r[2] for r in rows}
    wide = {(r.id_a, r.id_b): r.score for r in linkage.neighbour_pairs(df, 10_000).collect() if r.board_a != r.board_b and company[r.id_a] == company[r.id_b] != ""}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        found = {(r.id_a, r.id_b): r.score for r in linkage.neighbour_pairs(df, 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(wide) > 1000 and wide.items() <= found.items()


def test_names_told_apart_by_their_letters():
    rng = random.Random(2)
    few = ["".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(150)] + ["", "abcdefxyz", "abcdef", "caf\u00e9", "cafe", "caff\u00e9\u00e9"]
    sides = list(zip(*itertools.product(range(len(few)), repeat=2)))
    unlike = linkage._unlike(*((x[list(sides[0])], x[list(sides[1])]) for x in linkage._signatures(few)))
    assert unlike.sum() > 1000 and all(linkage._alike(few[i], few[j]) == linkage.UNLIKE for i, j, u in zip(*sides, unlike) if u and few[i] != few[j])


def best_total(edges):
    """The greatest sum of log odds of a one-to-one choice, by trying all."""
    best: dict[frozenset, float] = {frozenset(): 0.0}
    for a in sorted({e[0] for e in edges}):
        step = dict(best)
        for used, total in best.items():
            for x, b, s in edges:
                if x == a and b not in used:
                    key = used | {b}
                    step[key] = max(step.get(key, 0.0), total + s - linkage.EVEN)
        best = step
    return max(best.values())


def test_assignment_has_the_greatest_total(spark):
    rng, edges, want = random.Random(4), [], 0.0
    for part in range(25):
        mine = [(100 * part + a, 100 * part + b, float(rng.randint(9, 20))) for a, b in itertools.product(range(6), range(6)) if rng.random() < 0.5]
        edges, want = edges + mine, want + best_total(mine)
    # a chain in which the better edge of each pair is the wrong one, and a pair of its own
    chain = [(10_000 + k, 10_000 + k, 15.0) for k in range(40)] + [(10_000 + k + 1, 10_000 + k, 15.5) for k in range(40)]
    edges, want = edges + chain + [(99_999, 99_999, 9.0)], want + best_total([(0, 0, 9.0)]) + 40 * (15.5 - linkage.EVEN)
    df = spark.createDataFrame([*edges, edges[0], (None, 1, 20.0), (7, 7, linkage.EVEN)], "id_a long, id_b long, score double").withColumn("component", F.lit("clash"))

    def total(found):
        rows = found.collect()
        assert len({r.id_a for r in rows}) == len({r.id_b for r in rows}) == len(rows)
        assert {(r.id_a, r.id_b, r.score) for r in rows} <= set(edges)
        return sum(r.score - linkage.EVEN for r in rows), len(rows)

    assert total(linkage.assign(df))[0] == pytest.approx(want)


def test_large_components_are_matched_exactly_too(spark):
    n = 1500  # in one component the better edge of each pair is better by less than the step of an auction
    edges = [(k, k, 15.0) for k in range(n)] + [(k + 1, k, 15.0 + 1 / 64) for k in range(n)] + [(n + 1, k, linkage.EVEN + 1 / 128) for k in range(n)]
    found = linkage.assign(spark.createDataFrame(edges, "id_a long, id_b long, score double")).collect()
    assert sorted((r.id_a, r.id_b) for r in found) == [(k + 1, k) for k in range(n)]


def test_auctions_come_near_the_greatest_total(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(a, b, float(rng.randint(9, 20))) for a, b in itertools.product(range(9), range(9)) if rng.random() < 0.6]
    df, want = spark.createDataFrame(edges, "id_a long, id_b long, score double"), best_total(edges)
    monkeypatch.setattr(linkage, "EXACT_WORK", 0)
    near = linkage.assign(df).collect()
    assert len({r.id_b for r in near}) == len(near) and sum(r.score - linkage.EVEN for r in near) >= want - len(near) * linkage.STEP
    monkeypatch.setattr(linkage, "TASK_EDGES", 3)
    far = linkage.assign(df).collect()
    assert len({r.id_b for r in far}) == len(far) and sum(r.score - linkage.EVEN for r in far) >= want - len(far) * linkage.FAR_STEP


def test_assignment_of_equal_scores_leaves_no_edge(spark):
    # a run of 400 equally scored rows, boards alternating, each row next to its 20 neighbours
    edges = [(i, j, 9.0) if i % 2 == 0 else (j, i, 9.0) for i in range(400) for j in range(i + 1, min(400, i + 21)) if (i + j) % 2]
    got = [(r.id_a, r.id_b) for r in linkage.assign(spark.createDataFrame(edges, "id_a long, id_b long, score double")).collect()]
    used = {x for pair in got for x in pair}
    assert len(used) == 2 * len(got) and all(a in used or b in used for a, b, _ in edges)


def test_empty_and_keys(spark):
    df, _ = postings(spark, 1)
    assert linkage.link(df.limit(0), TITLES, SKILLS).count() == 0
    assert names.company_key("Công ty Cổ phần Công nghệ Orvfoven Cloud (OC)") == names.company_key("ORVFOVEN CLOUD CO., LTD") == names.company_key("Orvfoven Cloud Company Limited") == "orvfovencloud"
    assert linkage._edit_within("rynnoxa", "rynnxoa", 1) and not linkage._edit_within("abcd", "wxyz", 2)
    assert linkage._alike("fennquitis", "fennquitissystems") == linkage.PART and linkage._alike("rynnoxa", "rynnxoa") == linkage.CLOSE and linkage._alike("abc", "abcdefg") == linkage.UNLIKE
    assert linkage.assign(spark.createDataFrame([], "id_a long, id_b long, score double")).count() == 0
