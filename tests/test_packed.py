from postmill.operators.packed import unpack

SINGLE = ["Git", "SQL", "Java", "React", "CI/CD", "Docker", "Data Structures and Algorithms"] * 3
LISTS = [
    ("Git, SQL, Java", ["Git", "SQL", "Java"]), ('SQL, "Analysis, Design", Git', ["SQL", "Analysis, Design", "Git"]), ("['Git', 'C#']", ["Git", "C#"]), ('["Kafka", "HTML5"]', ["Kafka", "HTML5"]),
    ("Git;;SQL;;React", ["Git", "SQL", "React"]), ("Java, CI/CD, React", ["Java", "CI/CD", "React"]), ("Git/SQL/Java", ["Git", "SQL", "Java"]), ("CI/CD", ["CI/CD"]), ("Git/CI/CD/Docker", ["Git", "CI/CD", "Docker"]),
    ("SQL | Java; Git", ["SQL", "Java", "Git"]), ("Java (API, CLI), Git, ", ["Java (API, CLI)", "Git"]), ("SQL、Git、Java", ["SQL", "Git", "Java"]), ("Data Structures and Algorithms, Git", ["Data Structures and Algorithms", "Git"]),
    ("React\nGit", ["React", "Git"]), ("Java • SQL", ["Java", "SQL"]), ("[]", []), ("  ", []), (None, []), ("Rust", ["Rust"]),
]
PLACES = [
    ("12 Lua Vang St, District 1, Ha Noi - 52 - 54 Bo Song St, Lotus Ward, Hue - Fresher Accepted - ", ["12 Lua Vang St, District 1, Ha Noi", "52 - 54 Bo Song St, Lotus Ward, Hue", "Fresher Accepted"]),
    ("12 Lua Vang St, District 1, Ha Noi", ["12 Lua Vang St, District 1, Ha Noi"]), ("Ha Noi, Hue", ["Ha Noi", "Hue"]), ("Hue và Ha Noi", ["Hue", "Ha Noi"]), ("Ha Noi & Hue", ["Ha Noi", "Hue"]),
    ('"1 A St, District 1, Hue", "Night shift"', ["1 A St, District 1, Hue", "Night shift"]),
]


def test_every_kind_of_list(spark):
    rows = [(i, x, None, "clash") for i, x in enumerate(SINGLE)]
    # each kind often enough for its source to have statistics
    rows += [(1000 + 50 * k + i, x, None, "clash") for k in range(8) for i, (x, _) in enumerate(LISTS)]
    rows += [(5000 + i, None, c, "clash") for i, c in enumerate(["Ha Noi", "Hue", "Fresher Accepted", "Night shift"] * 5)]
    rows += [(6000 + 50 * k + i, None, x, "clash") for k in range(8) for i, (x, _) in enumerate(PLACES)]
    df = spark.createDataFrame(rows + rows[:40], "id long, skills string, place string, value string")
    got: dict[tuple[int, str], list[tuple[int, str]]] = {}
    for r in unpack(df, ["id"], ["skills", "place"]).collect():
        got.setdefault((r.id, r.field), []).append((r.pos, r.value))
    for i, (text, want) in enumerate(LISTS):
        assert [v for _, v in sorted(got.get((1000 + i, "skills"), []))] == want, text
    for i, (text, want) in enumerate(PLACES):
        assert [v for _, v in sorted(got.get((6000 + i, "place"), []))] == want, text
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_long_text_and_empty_table(spark):
    long = ", ".join(f"skill {i}" for i in range(5000))
    df = spark.createDataFrame([(1, long), (2, "x" * 200_000), (None, "a, b")], "id long, s string")
    rows = unpack(df, ["id"], ["s"]).collect()
    assert sum(r.id == 2 for r in rows) == 1 and any(r.id is None for r in rows)
    assert unpack(df.limit(0), ["id"], ["s"]).count() == 0
