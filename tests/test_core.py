import json
import random
from collections import Counter
from datetime import datetime
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.functions import fields, html, json_skills, salary, text, titles
from postmill.operators import agreement, checks, clusters, relational, skills
from postmill.plans import reference_queries
from postmill.sources import readers, sinks
from postmill.streaming import jobs as streams


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_skill_key(spark):
    cases = {"Machine Learning": "machine learning", "Kỹ năng giao tiếp": "giao tiếp", "React.js": "react js", "AI/ML": "ai ml", "fine-tuning": "fine tuning", "a.i": "a.i", "C++": "c++", ".NET": "net", "kỹ năng": "kỹ năng", "": "", None: None}
    assert column(spark, list(cases), text.skill_key) == list(cases.values())


def test_skill_match_key(spark):
    cases = {"ReactJS": "react", "react.js": "react", "Vue.js": "vue", "ASP.NET": "aspnet", "js": "js", "node js": "node js", None: None}
    assert column(spark, list(cases), text.skill_match_key) == list(cases.values())


def test_text_helpers(spark):
    assert column(spark, [" Đà Nẵng ", "Hà Nội", None], text.fold) == ["da nang", "ha noi", None]
    assert column(spark, ["A / B", " ", None], text.category_key) == ["A/B", "Other", "Other"]
    assert column(spark, ["abc kỹ1 x2", ""], lambda c: F.array_join(text.tokens(c), " ")) == ["abc x2", ""]
    assert column(spark, ["/a?x=1", "https://h/b?y", "c"], lambda c: text.url_key(c, "https://h/")) == ["https://h/a", "https://h/b", "https://h/c"]
    assert column(spark, ["a/b:c"], text.file_name) == ["a_b_c"]


def test_fields(spark):
    assert column(spark, ["TP HCM", "Đà Nẵng", "somewhere in Hà Nội", "nowhere", "", None], fields.canonical_place) == ["Hồ Chí Minh", "Đà Nẵng", "Hà Nội", "Khác", "Khác", "Khác"]
    assert column(spark, ["Engineering Manager", "Team Lead", "Sr. Dev", "Dev", None], lambda c: fields.extract_level(c, F.lit(None).cast("string"))) == ["Quản lý / Giám sát", "Trưởng nhóm", "Senior", "Nhân viên", "Nhân viên"]
    assert column(spark, ["Bachelor's degree", "Cao đẳng", "none", None], fields.extract_education) == ["Đại học trở lên", "Cao đẳng trở lên", "Không yêu cầu", "Không yêu cầu"]
    assert column(spark, ["3 years", "5+ years", "2 - 4 năm", "0 năm", "25 years old", ""], fields.extract_experience) == ["3 năm", "Trên 5 năm", "2 năm", "Dưới 1 năm", "Không yêu cầu", "Không yêu cầu"]
    types = column(spark, ["[Remote] Dev", "part-time dev", "part time or full time", "hybrid working", "", None], lambda c: fields.extract_employment(c, F.lit("")))
    assert types == ["Remote", "Bán thời gian", "Toàn thời gian", "Hybrid", "Toàn thời gian", "Toàn thời gian"]


def test_titles(spark):
    got = column(spark, ["Graphic Designer", "Software Graphic Developer", " ", None, "Chef"], lambda c: F.to_json(titles.classify(c, titles.SAFE_PATTERNS, titles.DROP_GROUPS)))
    assert [json.loads(x)["decision"] for x in got] == ["drop", "keep", "review", "review", "keep"]
    assert column(spark, ["Account Manager", "Sales Lead", "Presales Sales", "3D Modeler", "3dimensional", None], titles.post_filter) == ["account_manager", "sales_non_it", None, "keyword", None, None]
    assert column(spark, ["Manual Tester", "Systems Engineer", "Senior Full Stack Dev", "Chef", None], titles.standard_title) == ["QA Engineer", "System Engineer", "Fullstack Developer", "Chef", None]


def test_keep_first_last_patch(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z"), (None, 3, "n"), ("a", 1, "x")], "k string, t int, v string")
    first = {r.k: r.v for r in relational.keep_first(df, ["k"], [F.col("t")]).collect()}
    last = {r.k: r.v for r in relational.keep_last(df, ["k"], [F.col("t")]).collect()}
    assert first == {"a": "x", "b": "z", None: "n"} and last == {"a": None, "b": "z", None: "n"}
    base = spark.createDataFrame([("a", "old"), ("b", "old"), (None, "old")], "k string, v string")
    up = spark.createDataFrame([("a", None)], "k string, v string")
    assert sorted(r.v or "" for r in relational.patch(base, up, "k", ["v"]).collect()) == ["", "old", "old"]
    assert relational.keep_first(df.limit(0), ["k"], [F.col("t")]).count() == 0


def test_numbers_halves_batches(spark):
    df = spark.range(101).select((100 - F.col("id")).alias("x"))
    assert [r.n for r in relational.number_rows(df, ["x"], "n").orderBy("x").collect()] == list(range(1, 102))
    assert relational.halves(df, "x").groupBy("half").count().orderBy("half").collect()[0]["count"] == 50
    assert relational.batches(df, ["x"], 20).agg(F.max("batch_id")).first()[0] == 5
    assert relational.number_rows(df.limit(0), ["x"], "n").count() == 0


def test_profiles_and_checks(spark):
    df = spark.createDataFrame([("[]", "x", 1), ("['a']", "5", None), (None, " ", 2)], "l string, d string, n int")
    got = {r["column"]: (r.missing, r.pct) for r in relational.missing_profile(df, ("l",), ("d",)).collect()}
    assert got == {"l": (2, 66.67), "d": (2, 66.67), "n": (1, 33.33)}
    with pytest.raises(relational.MissingColumns):
        relational.require_columns(df, "zzz")
    assert relational.collisions(spark.createDataFrame([("A",), ("a ",), ("b",)], "x string"), "x").first().n == 2


def test_aliases(spark):
    g = spark.createDataFrame([(1, "C", ["B"]), (2, "B", ["A", "b"]), (3, "D", None)], "ord int, canonical string, variants array<string>")
    closed = {r.variant: r.canonical for r in skills.close_aliases(skills.alias_edges(g)).collect()}
    assert closed == {"a": "c", "b": "c"}
    cycle = spark.createDataFrame([(1, "a", ["b"]), (2, "b", ["a"])], "ord int, canonical string, variants array<string>")
    with pytest.raises(skills.AliasCycle):
        skills.close_aliases(skills.alias_edges(cycle))
    counts = spark.createDataFrame([("js", 5), ("javascript", 9), ("ecma", 2)], "name string, n int")
    groups = spark.createDataFrame([(1, "hallucinated", ["js", "ecma", "nope"]), (2, "javascript", ["js"])], "ord int, canonical string, variants array<string>")
    valid = {r.canonical: r.variants for r in skills.validate_alias_groups(groups, counts).collect()}
    assert valid == {"js": ["ecma"], "javascript": ["js"]}
    merged = {r.canonical: r.variants for r in skills.merge_alias_groups(skills.validate_alias_groups(groups, counts), counts).collect()}
    assert merged == {"js": ["ecma"], "javascript": ["js"]}


def test_canonical_pick(spark):
    m = spark.createDataFrame([(1, "ai", 163), (1, "trí tuệ nhân tạo", 500), (1, "a.i", 2), (2, "đ", 1)], "cluster_id int, name string, n int")
    assert {r.cluster_id: r.canonical for r in skills.pick_canonical(m).collect()} == {1: "ai", 2: "đ"}


def brute_average_linkage(d, t):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min(((np.mean([d[i][j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
        if best[0] >= t:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_average_linkage_against_brute_force(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 25):
        x = rng.normal(size=(n, 4))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - x @ x.T
        label = clusters.average_linkage(d, 0.5)
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label)} == brute_average_linkage(d, 0.5)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None), (98, [0.0] * 4)], "vec_id long, embedding array<float>")
    got: dict[int, set[int]] = {}
    for r in clusters.cluster(df.filter("embedding is not null"), 0.5).collect():
        got.setdefault(r.cluster_id, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == brute_average_linkage(d, 0.5) | {frozenset({98})}


def test_average_linkage_by_sums(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for n, t in ((1, 0.5), (2, 0.5), (9, 0.5), (25, 0.5), (25, 1.1), (300, 0.4), (300, 0.9)):
        x = rng.normal(size=(n, 5))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert clusters.average_linkage_by_sums(x, t).tolist() == clusters.average_linkage(1 - x @ x.T, t).tolist()
    assert clusters.average_linkage_by_sums(np.repeat(np.eye(3), 4, axis=0), 0.5).tolist() == [0] * 4 + [4] * 4 + [8] * 4
    # components too large for a matrix are clustered all the same
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    want = {(r.id, r.cluster_id) for r in clusters.cluster(df, 0.5).collect()}
    for name in ("MAX_MATRIX", "MAX_COMPONENT"):
        monkeypatch.setattr(clusters, name, 10, raising=False)
    assert {(r.id, r.cluster_id) for r in clusters.cluster(df, 0.5).collect()} == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in clusters.components(edges, spark.range(203)).collect()} == {0, 201, 202}


def test_agreement(spark):
    rows = [("1", "a", 1, "python", "r", "x"), ("1", "a", 2, "java core", "p", "x"), ("1", "b", 1, "pythn", "r", "x"), ("1", "b", 2, "core java", "r", "y"), ("2", "b", 1, "sql", "r", "x")]
    m = spark.createDataFrame(rows, "record_id string, annotator string, ord int, name string, label string, category string")
    matched = agreement.match_records(m, "a", "b")
    assert matched.filter("name_a is not null and name_b is not null").count() == 2 and SequenceMatcher(None, "python", "pythn").ratio() >= 0.8
    f = agreement.macro_f1(matched).first()
    assert (f.records, f.f1) == (2, 0.5)
    assert {r.error for r in agreement.error_cases(matched, "a", "b").collect()} == {"label_category_disagreement", "only_b"}
    same = spark.createDataFrame([("1", "n", "n", "r", "r", "c", "c")] * 3, "record_id string, name_a string, name_b string, label_a string, label_b string, category_a string, category_b string")
    assert agreement.cohen_kappa(same, "label_a", "label_b").first().kappa == 1.0
    assert agreement.cohen_kappa(same.limit(0), "label_a", "label_b").first().kappa is None
    # Fleiss: two items of three ratings
    r = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "y"), (2, "y"), (2, "y")], "item int, label string")
    p, pe = (1 / 3 + 1) / 2, (2 / 6) ** 2 + (4 / 6) ** 2
    assert agreement.fleiss_kappa(r, ["item"], "label").first().kappa == pytest.approx((p - pe) / (1 - pe), abs=1e-6)
    ci = agreement.bootstrap_interval(spark.range(200).select((F.col("id") % 2).cast("double").alias("v")), "v", 200).first()
    assert ci.low < ci.mean < ci.high and 0.4 < ci.low and ci.high < 0.6


def test_similar_names_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = ["Python", "pythn", "React.js", "reactt", "Core Java", "java core", "SQL", "MySQL", "node js", "NodeJS", "docker", "dockers"]
    lists = {(str(r), who): [(k, rng.choice(words), rng.choice(["required", "nice to have"]), "A / B") for k in range(rng.randint(0, 6))] for r in range(40) for who in ("human_a", "human_b", "llm")}
    schema = "record_id string, annotator string, skills array<struct<mention_no int, skill_name string, label string, category string>>, submitted_at timestamp"
    stamp = datetime(2025, 1, 1)
    spark.createDataFrame([(r, who, s, stamp) for (r, who), s in lists.items()], schema).write.parquet(f"{tmp_path}/annotations_unified.parquet")

    def key(name):
        t = " ".join(name.lower().translate(str.maketrans("", "", ".-_/")).split())
        return t if " " in t else next((t[: -len(x)] for x in ("js", "framework", "library") if t.endswith(x) and len(t) > len(x)), t)

    def match(a, b):
        x, y = set(a.split()), set(b.split())
        return len(x & y) / len(x | y) >= 0.5 or SequenceMatcher(None, a, b).ratio() >= 0.8

    def paired(a, b):
        used_a, used_b, out = set(), set(), []
        for i, j in [(i, j) for i in range(len(a)) for j in range(len(b)) if match(key(a[i][1]), key(b[j][1]))]:
            if i not in used_a and j not in used_b:
                used_a.add(i), used_b.add(j), out.append((a[i], b[j]))
        return out

    cells, triples, f1, n = Counter(), [], [], Counter()
    for r in range(40):
        a, b, c = (lists[str(r), who] for who in ("human_a", "human_b", "llm"))
        pairs = paired(a, c)
        cells.update((p[2], q[2]) for p, q in pairs)
        n.update({"only_human_a": len(a) - len(pairs), "only_llm": len(c) - len(pairs), "label_disagreement": sum(p[2] != q[2] for p, q in pairs)})
        f1.append(2 * len(pairs) / (len(a) + len(c)) if pairs else 0.0)
        free = list(c)
        for p, q in paired(a, b):
            if (z := next((z for z in free if match(key(p[1]), key(z[1]))), None)) is not None:
                free.remove(z), triples.append((p[2], q[2], z[2]))
    q = {name: reference_queries.QUERIES[f"iaa_similar_{name}"](spark, str(tmp_path)) for name in ("f1", "kappa_label", "confusion", "errors", "fleiss")}
    long = {"required": "required_skill", "nice to have": "preferred_skill"}
    assert {(x.a, x.b): x.n for x in q["confusion"].collect()} == {(long[x], long[y]): k for (x, y), k in cells.items()}
    assert {x.error: x.n for x in q["errors"].collect()} == {k: v for k, v in n.items() if v}
    assert q["f1"].first().f1 == pytest.approx(sum(f1) / len(f1), abs=1e-5) and q["kappa_label"].first().n == sum(cells.values())
    share = sum(t.count("required") for t in triples) / (3 * len(triples))
    p, pe = sum(len(set(t)) == 1 or 1 / 3 for t in triples) / len(triples), share**2 + (1 - share) ** 2
    fleiss = q["fleiss"].first()
    assert fleiss["items"] == len(triples) and fleiss.kappa == pytest.approx((p - pe) / (1 - pe), abs=1e-5)


def test_bootstrap_against_resampling(spark):
    rng = np.random.default_rng(7)
    pairs = [(a, a if rng.random() < 0.8 else "p") for a in rng.choice(["r", "p"], 150)]
    rows = [(str(i % 30), "n", None if i % 5 == 0 else "n", str(a), str(b), "c", "c") for i, (a, b) in enumerate(pairs)]
    m = spark.createDataFrame(rows, "record_id string, name_a string, name_b string, label_a string, label_b string, category_a string, category_b string")

    def kappa(x):
        po, (u, v) = (x[:, 0] == x[:, 1]).mean(), (x == "r").mean(axis=0)
        pe = u * v + (1 - u) * (1 - v)
        return (po - pe) / (1 - pe)

    both = np.array([r[3:5] for r in rows if r[2]])
    want = np.percentile([kappa(both[rng.integers(0, len(both), len(both))]) for _ in range(1000)], [2.5, 97.5])
    got = agreement.bootstrap_kappa(m, "label_a", "label_b", "kappa_label").first()
    assert got.value == pytest.approx(kappa(both), abs=1e-5) and [got.low, got.high] == pytest.approx(want, abs=0.04)
    per = [(sum(r[2] is not None for r in g), len(g)) for g in ([r for r in rows if r[0] == str(k)] for k in range(30))]
    f = np.array([2 * k / (n + k) for k, n in per])
    want = np.percentile([f[rng.integers(0, 30, 30)].mean() for _ in range(1000)], [2.5, 97.5])
    got = agreement.bootstrap_f1(m).first()
    assert got.value == pytest.approx(f.mean(), abs=1e-5) and [got.low, got.high] == pytest.approx(want, abs=0.05)

    def fleiss(t):
        share = (t == "r").mean()
        n = (t == "r").sum(axis=1)
        p, pe = ((n**2 + (3 - n) ** 2 - 3) / 6).mean(), share**2 + (1 - share) ** 2
        return (p - pe) / (1 - pe)

    triples = np.array([(a, a, b) for a, b in pairs])
    want = np.percentile([fleiss(triples[rng.integers(0, 150, 150)]) for _ in range(1000)], [2.5, 97.5])
    ratings = spark.createDataFrame([(i, str(x)) for i, t in enumerate(triples) for x in t], "item int, label string")
    got = agreement.bootstrap_fleiss(ratings, ["item"], "label").first()
    assert got.value == pytest.approx(fleiss(triples), abs=1e-5) and [got.low, got.high] == pytest.approx(want, abs=0.05)


def test_json_skills(spark):
    good = '{"skills": [{"skill_name": "A", "label": "bad", "category": "c", "min_years": "2.5", "level": "guru"}]}'
    cases = [(good, "ok", 1), (f"```json\n{good}\n```", "ok", 1), (good[:-2] + ",]}", "repaired", 1), (good[:-2] + ', {"skill_name": "B', "repaired", 1), (good[11:-1], "ok", 1), ("no", "unparsable", None), ("", "no_text", None), (None, "no_text", None)]
    log = spark.createDataFrame([(i, t, None) for i, (t, _, _) in enumerate(cases)], "row_id int, raw_text string, error string")
    got = {r.row_id: r for r in json_skills.parse_log(log, ["row_id"]).collect()}
    for i, (_, status, n) in enumerate(cases):
        assert got[i].status == status and (n is None or len(got[i].skills) == n)
    s = got[0].skills[0]
    assert (s.label, s.min_years, s.level) == ("required_skill", 2, None)
    assert json_skills.flatten(json_skills.parse_log(log, ["row_id"]), ["row_id"]).count() == 5


def test_html(spark):
    page = "<h1 class='job-title x'>Dev &amp; Ops<br></h1><b>Mức lương:</b> <i>10 triệu</i><h2>Job description</h2><ul><li>a</li><li>b</li></ul><h2>Requirement</h2><p>c</p><a class=tag>Git</a><a class=tag>Git</a>"
    row = html.job_row(page)
    assert row["job_title"] == "Dev & Ops" and row["salary"] == "10 triệu" and row["required_skills"] == ["Git"] and row["job_description"] == "a\nb"
    assert html.page_kind(html.parse("<input type=password>")) == "login" and html.last_page(html.parse("<a href='?page=3'>3</a>")) == 3
    assert html.links(html.parse("<h3 class=title><a href=/a>x</a></h3><h3 data-url=/b></h3>")) == ["/a", "/b"]
    assert html.job_row(None)["salary"] == "Not Found" and html.job_row("<div" * 2000)["job_title"] is None


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "1", "x": 2}\n\nbroken\n{"id": "2"}\n')
    assert readers.jsonl(spark, str(tmp_path / "l.jsonl"), "id string, x int").count() == 2
    (tmp_path / "h.json").write_text('[{"skills": [{"skill_name": "A", "min_years": NaN}, {"skill_name": " "}]}, {"id": "7", "skills": []}]')
    rows = readers.annotations(spark, str(tmp_path / "h.json"), "human_a").collect()
    assert {r.record_id: len(r.skills) for r in rows} == {"0": 1, "7": 0}
    (tmp_path / "u.jsonl").write_text('{"record_id": "1", "skills": {"skills": [{"skill_name": "A"}]}}\n{"record_id": "2", "annotator": "x", "skills": [{"skill_name": "B"}]}\n')
    assert {(r.record_id, r.annotator, len(r.skills)) for r in readers.annotations(spark, str(tmp_path / "u.jsonl"), None).collect()} == {("1", "unknown", 1), ("2", "x", 1)}
    (tmp_path / "f.csv").write_bytes("﻿ID,Skill_Name,label\n1,A,r\n1,\"B\nb\",p\n".encode())
    flat = readers.annotations(spark, str(tmp_path / "f.csv"), "llm").collect()
    assert [s.skill_name for s in flat[0].skills] == ["A", "B\nb"]
    (tmp_path / "a.yaml").write_text("aliases:\n- canonical: x\n  variants: [y, z]\n- variants: [q]\n")
    assert readers.alias_yaml(spark, str(tmp_path / "a.yaml")).first().variants == ["y", "z"]
    with pytest.raises(ValueError):
        readers.annotations(spark, "x.txt", "a")
    df = spark.createDataFrame([("a/b", 1, None), (None, 2, "e")], "category string, n int, error string")
    sinks.by_category(df, str(tmp_path / "cat"))
    assert {p.name for p in (tmp_path / "cat").iterdir() if p.is_dir()} == {"__folder=a_b", "__folder=Other"}
    sinks.append_log(df, str(tmp_path / "log"), str(tmp_path / "err"))
    sinks.append_log(df, str(tmp_path / "log"), str(tmp_path / "err"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4 and spark.read.json(str(tmp_path / "err")).count() == 2


def test_stream_resume_goes_on_where_it_stopped(spark, tmp_path):
    source, out, err, ck = (str(tmp_path / x) for x in ("in", "out", "err", "ck"))
    schema = "url string, requirement string"

    def run():
        streams.resume(streams.read_files(spark, source, schema), out, err, ck, lambda d: d.withColumn("n", F.length("requirement"))).awaitTermination()

    spark.createDataFrame([("a", "x"), ("b", " "), ("a", "x")], schema).write.parquet(source)
    run()
    spark.createDataFrame([("a", "again"), ("c", "yy")], schema).write.mode("append").parquet(source)
    run()
    assert {(r.url, r.n) for r in spark.read.parquet(out).collect()} == {("a", 1), ("c", 2)}
    assert spark.read.parquet(err).count() == 1


def test_alias_chains_and_cycles_of_any_length(spark):
    chain = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}") for k in range(40)] + [("x", "y")], "variant string, canonical string")
    closed = {r.variant: r.canonical for r in skills.close_aliases(chain).collect()}
    assert closed == {f"n{k:02d}": "n40" for k in range(40)} | {"x": "y"}
    for cycle in ([("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("b", "a"), ("p", "q")], [("a", "a")], [("p", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a")]):
        with pytest.raises(skills.AliasCycle):
            skills.close_aliases(spark.createDataFrame(cycle, "variant string, canonical string"))
    assert skills.close_aliases(chain.limit(0)).count() == 0


def test_the_last_extraction_of_a_mention_stays_whole(spark):
    rows = [(1, "r", "Java", "required_skill", "B", "2025-01-01"), (1, "r", "SQL", None, "A", "2025-02-01"), (2, "r", "Go", None, None, None), (2, "r", "Go", "x", "C", None), (3, "r", " ", "x", "C", None)]
    df = spark.createDataFrame(rows, "mention_id long, row_id string, skill_name string, label string, category string, t string").withColumn("extracted_at", F.col("t").cast("timestamp_ntz"))
    assert {(r.mention_id, r.skill, r.label, r.category) for r in skills.clean_mentions(df).collect()} == {(1, "sql", None, "A"), (2, "go", "x", "C")}


def test_patches_of_all_batches_stay(spark, tmp_path):
    source, base, out, ck = (str(tmp_path / x) for x in ("in", "base", "out", "ck"))
    spark.createDataFrame([(k, "old", k) for k in range(4)], "id int, v string, w int").write.parquet(base)
    schema = "id int, v string, at int"

    def run():
        streams.patch_stream(streams.read_files(spark, source, schema), base, out, ck, "id", ["v"], "at").awaitTermination()
        return {(r.id, r.v) for r in streams.latest_batch(spark, out).collect()}

    spark.createDataFrame([(1, "late", 9), (1, "early", 3), (9, "nobody", 1)], schema).write.parquet(source)
    assert run() == {(0, "old"), (1, "late"), (2, "old"), (3, "old")}
    spark.createDataFrame([(2, None, 1)], schema).write.mode("append").parquet(source)
    assert run() == {(0, "old"), (1, "late"), (2, None), (3, "old")}


def test_retries_and_crawl(spark):
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "yes"

    assert streams.with_retries(call, 3, 5, waits.append) == "yes" and waits == [5, 10]
    with pytest.raises(OSError):
        streams.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, 1, waits.append)
    urls = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    log = spark.createDataFrame([("a", "done"), ("b", "failed"), ("c", "gone"), ("a", "failed")], "url string, status string")
    assert {r.url for r in streams.crawl_pending(urls, log).collect()} == {"b", "d"}


def test_checks(spark):
    members = spark.createDataFrame([("a", "x", 3), ("b", "x", 2)], "name string, category string, total long")
    good = spark.createDataFrame([("a", "x", "A", 3), ("b", "x", "B", 2)], "name string, category string, final string, total long")
    checks.require(checks.mapping_checks(members, good))
    bad = spark.createDataFrame([("a", "x", None, 3), ("c", "x", "C", 3), ("c", "x", "C", 0)], good.schema)
    found = {r.check: r.violations for r in checks.mapping_checks(members, bad).collect()}
    assert found == {"conservation": 1, "missing": 1, "extra": 1, "null_final": 1, "repeated": 1}
    with pytest.raises(checks.CheckFailed, match="conservation: 1"):
        checks.require(checks.mapping_checks(members, bad))
    assert checks.mapping_checks(members.limit(0), good.limit(0)).agg(F.sum("violations")).first()[0] == 0
    assert checks.assert_unique(members, "name") is members
    with pytest.raises(checks.CheckFailed, match="1 rows without a value, 1 repeated"):
        checks.assert_unique(spark.createDataFrame([("a",), ("a",), (None,)], "name string"), "name")
    assert checks.config_hash({"b": 1, "a": [2]}) == checks.config_hash({"a": [2], "b": 1}) != checks.config_hash({"a": 2})


def test_salaries(spark):
    cases = {
        "Up to $2,000": (0.0, 50.0, 50.0), "10 - 15 triệu": (10.0, 15.0, 12.5), "Từ 15.000.000 VND": (15.0, 0.0, 15.0), "1000 USD": (25.0, 25.0, 25.0), "66.7 tr": (66.7, 66.7, 66.7), "Tới 20 triệu": (0.0, 20.0, 20.0), "Thỏa thuận": (0.0, 0.0, 0.0),
        "": (0.0, 0.0, 0.0), None: (0.0, 0.0, 0.0), "x" * 9000: (0.0, 0.0, 0.0),
    }
    got = column(spark, list(cases), salary.salary_bounds)
    assert [tuple(g) for g in got] == list(cases.values())
    df = salary.process_salary(spark.createDataFrame([(i, s, 1) for i, s in enumerate(cases)], "i int, salary string, avg_salary int"))
    missing = {r.i: r.is_missing_salary for r in df.collect()}
    assert [missing[i] for i in range(len(cases))] == [False] * 6 + [True] * 4
    assert column(spark, ["Negotiable ", "", None, "5"], salary.valid_salary) == [False, False, False, True]


def test_relational_small(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("b", None, 3), ("a", "y", 4)], "g string, v string, o int")
    assert {tuple(r) for r in relational.counts_with_first(df, "g", "v", [F.col("o")]).collect()} == {("a", 3, "x"), ("b", 1, None)}
    assert {tuple(r) for r in relational.first_value(df, "g", "v", [F.col("o")]).collect()} == {("a", "x"), ("b", None)}
    assert [tuple(r) for r in relational.first_appearance_ids(df, "v", "o", start=5).orderBy("id").collect()] == [("x", 5), ("y", 6)]
    assert relational.rename_columns(df, {"g": "h", "zz": "q"}).columns == ["h", "v", "o"] and relational.drop_columns(df, "v", "zz").columns == ["g", "o"]
    with pytest.raises(ValueError):
        relational.rename_columns(df, {"g": "v"})
    with pytest.warns(UserWarning, match="zz"):
        assert relational.keep_available(df, ["o", "zz", "g"]).columns == ["o", "g"]
    row = spark.range(1).select(relational.flat_pieces(F.array(F.lit("a|b|"), F.lit(None), F.lit("b|c"))).alias("f"), relational.overlap(F.array(F.lit("a"), F.lit("b")), F.lit(None)).alias("o")).first()
    assert row.f == ["a", "b", "c"] and (row.o.both, row.o.either) == ([], ["a", "b"])
    assert column(spark, ["x-123", "x-12", None], relational.job_url) == [True, False, False]


def test_alias_bootstrap(spark):
    counts = spark.createDataFrame([("ReactJS", 9), ("react", 5), ("vue", 3), ("rare", 1), (" ", 99)], "name string, n long")

    def answer(names):
        assert "rare" not in names
        return "```yaml\naliases:\n- canonical: React\n  variants: [reactjs, nothing, react]\n- canonical: unheard\n  variants: [vue]\n- 7\n```" if "vue" in names else "- no mapping"

    got = {r.canonical: r.variants for r in skills.bootstrap_aliases(counts, answer, 2, 3).collect()}
    assert got == {"react": ["reactjs"]}
    assert json_skills.yaml_aliases("aliases: 3") == json_skills.yaml_aliases(": : [") == json_skills.yaml_aliases(None) == []


def test_strict_json_and_title_answers(spark):
    good = '{"skill_name": "A", "label": "required_skill", "category": "c"}'
    cases = [(f'{{"skills": [{good}]}}', "direct"), (f'{{"skills": [{good},]}}', "repaired"), (f'{{"skills": [{good}, {{"skill_name": "B", "label": "odd", "category": "c"}}]}}', "coerced"), ("no", "rejected"), (None, "rejected")]
    log = spark.createDataFrame([(i, t, None) for i, (t, _) in enumerate(cases)], "row_id int, raw_text string, error string")
    got = {r.row_id: r for r in json_skills.validate_log(log, ["row_id"]).collect()}
    assert [got[i].level for i in range(len(cases))] == [x for _, x in cases] and len(got[2].skills) == 2 and got[3].skills is None
    asked = spark.createDataFrame([(1, 1, "Dev"), (1, 2, "QA"), (2, 3, "Dev")], "batch_id int, id int, title string")
    raw = spark.createDataFrame([(1, '```json\n[{"original": "QA", "standardized_title": "Q"}, {"id": "1", "standardized_title": "D"}]\n```'), (2, "sorry")], "batch_id int, raw_text string")
    assert {(r.batch_id, r.id, r.original, r.standardized_title) for r in json_skills.title_answers(raw, asked).collect()} == {(1, "2", "QA", "Q"), (1, "1", "Dev", "D")}
    assert column(spark, ["3.9", "x", "-1.5", None, "NaN"], json_skills.whole_years) == [3, None, -1, None, None]


def test_agreement_report(spark):
    rows = [(str(r), who, k, f"skill number {k} of {r}", "required_skill" if (r + k) % 2 else "preferred_skill", "A" if k % 2 else "B") for r in range(12) for who in ("human_a", "human_b", "llm") for k in range(4)]
    df = spark.createDataFrame(rows, "record_id string, annotator string, ord int, name string, label string, category string")
    got = {(r.task, r.pair): r for r in agreement.run_report(df, df.select("record_id"), 50).collect()}
    assert set(got) == {("t1", p) for p in agreement.F1_LEAST} | {("t2", p) for p in (*agreement.LABEL_LEAST, "fleiss_kappa_all")} | {("t3", p) for p in agreement.CATEGORY_LEAST} | {("overall", "all")}
    assert all(r.value == 1.0 and r.status == "PASS" for k, r in got.items() if k[0] != "overall") and got["overall", "all"].status == "PASS" and got["overall", "all"].n == 0
    one = agreement.run_report(df.filter("annotator = 'llm'"), df.select("record_id"), 50).collect()
    assert [(r.task, r.status, r.n) for r in one] == [("overall", "FAIL", 0)]
