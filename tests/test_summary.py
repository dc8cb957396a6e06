import random

from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.text import holds_any, snake
from claimgrid.operators import graph, summary
from tests.helpers import rows


def test_coverage_matches_plain_containment(spark):
    rng = random.Random(7)
    words = ["The", "user", "Role", "is", "owner", "é", "", "a"]
    statements = [(f"s{i % 3}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(120)]
    criteria = [(f"s{i % 4}", i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(160)]
    criteria += [("s0", 900, ""), ("s3", 901, "")]
    got = summary.covered_criteria(
        spark.createDataFrame(criteria, "session_id string, criterion_key int, description string"),
        spark.createDataFrame(statements, "session_id string, statement string"),
    )
    want = [
        (s, k, any(t == s and d.lower() in text.lower() for t, text in statements)) for s, k, d in criteria
    ]
    assert rows(got, "session_id", "criterion_key", "covered") == sorted(want, key=str)


def test_coverage_percent_rounds_half_up(spark):
    sessions = spark.createDataFrame([("a",), ("b",), ("none",)], "session_id string")
    covered = [("a", i, i == 0) for i in range(8)] + [("b", i, i < 2) for i in range(3)]
    table = spark.createDataFrame(covered, "session_id string, criterion_key int, covered boolean")
    assert rows(summary.coverage(sessions, table), "session_id", "requirement_coverage") == [("a", 13), ("b", 67), ("none", None)]


def test_finding_status_and_candidate_stats(spark):
    sessions = spark.createDataFrame([("open",), ("done",), ("none",)], "session_id string")
    findings = spark.createDataFrame(
        [("open", "HIGH", None), ("open", "LOW", "fix"), ("done", "CRITICAL", "fix")],
        "session_id string, severity string, proposed_resolution string",
    )
    got = summary.finding_status(sessions, findings)
    assert rows(got, "session_id", "status", "conflicts_found", "conflicts_resolved", "critical", "high", "low") == [
        ("done", "PASS", 1, 1, 1, 0, 0), ("none", "PASS", 0, 0, 0, 0, 0), ("open", "FAIL", 2, 1, 0, 1, 1),
    ]
    candidates = spark.createDataFrame([("s", "DISMISSED"), ("s", "PENDING"), ("s", "CONFIRMED")], "session_id string, status string")
    assert rows(summary.candidate_stats(candidates)) == [("s", 3, 1, 1)]


def test_fractions_and_flags(spark):
    table = spark.createDataFrame([(1, 2, 90), (None, 2, 89), (3, None, None)], "n int, d int, p int")
    got = table.select(summary.fraction(F.col("n"), F.col("d")), summary.coverage_ok(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("1/2", True), (None, False), (None, None)]


def test_passport_text_shows_a_dash_for_what_is_not_measured(spark):
    sessions = spark.createDataFrame(
        [("session-1", "Add billing", "acme/platform", "a", "b")],
        "session_id string, requirement_text string, repository string, branch_a string, branch_b string",
    )
    results = spark.createDataFrame(
        [("session-1", 7, 130, "130 semantic conflict(s) detected.")],
        "session_id string, claims_found int, conflicts_found int, summary string",
    )
    files = spark.createDataFrame([("session-1", 4)], "session_id string, files_changed int")
    parts = spark.createDataFrame([("session-1", "src"), ("session-1", "src/a.ts")], "session_id string, component string")
    passport = summary.passports(sessions, results, files, parts)
    row = passport.first()
    assert (row.passport_id, row.n_components, row.tests_total, row.status) == ("live-session-1", 2, None, "FAIL")
    assert row.remaining_risk == "130 semantic conflict(s) detected."
    lines = summary.passport_text(passport).first().text.split("\n")
    assert "Branches:             a, b" in lines
    assert "Tests:                — / —" in lines
    assert "Req. Coverage:        —" in lines


def test_components_and_tiers(spark):
    files = spark.createDataFrame([("s", "c1", "src/a.ts"), ("s", "c2", "src/a.ts")], "session_id string, conflict_id string, file_path string")
    paths = spark.createDataFrame([("s", "src/a.ts"), ("s", "docs/x.md"), ("s", "/odd")], "session_id string, path string")
    assert rows(summary.components(files, paths), "component") == [("docs",), ("src",), ("src/a.ts",)]
    kinds = ["REQUIREMENT", "CHANGE", "ASSUMPTION", "FILE", "CONFLICT"]
    got = spark.createDataFrame([(k,) for k in kinds], "k string").select(graph.tier(F.col("k"))).collect()
    assert [r[0] for r in got] == [0, 1, 2, 3, 4]


def test_coverage_of_long_repeating_and_short_texts_with_few_keys(spark):
    rng = random.Random(3)
    statements = [(f"s{i % 3}", "".join(rng.choices("abÄ ", k=rng.randint(0, 60)))) for i in range(90)]
    statements += [("s0", "a" * 50), ("s1", "x" + "ab" * 30 + "y"), ("s2", None)]
    criteria = [(f"s{i % 3}", i, t[a : a + rng.randint(0, 30)]) for i, (_, t) in enumerate(statements[:90]) for a in [rng.randint(0, 20)]]
    criteria += [("s0", 100, "A" * 8), ("s0", 101, "a" * 51), ("s0", 102, "a" * 50), ("s1", 103, "ab" * 9), ("s1", 104, "yx"), ("s2", 105, None)]
    got = summary.covered_criteria(
        spark.createDataFrame(criteria, "session_id string, criterion_key int, description string"),
        spark.createDataFrame(statements, "session_id string, statement string"),
    )
    want = [
        (s, k, d is not None and any(t == s and text is not None and d.lower() in text.lower() for t, text in statements))
        for s, k, d in criteria
    ]
    assert rows(got, "session_id", "criterion_key", "covered") == sorted(want, key=str)
    # The keys of a criterion cover it side by side, and are no more than that takes.
    texts = spark.createDataFrame([("abcdefghijklmnopqrstuvwxy",), ("abcdefgh",), ("abc",), ("",)], "t string")
    width = F.least(F.length("t"), F.lit(summary.KEY_CHARS))
    assert [r[0] for r in texts.select(F.size(summary._tile_hashes(F.col("t"), width))).collect()] == [4, 1, 1, 1]


def test_words_are_found_as_by_their_pattern(spark):
    lists = [words for tests in (fixed.REQUIREMENT_HINTS, fixed.CHANGE_HINTS) for words, _ in tests]
    lists += [fixed.ROLE_SUBJECT, fixed.RULE_KEY, fixed.CONTRACT_SUBJECT, fixed.CONTRACT_KEY, fixed.DEPENDENCY_KEY]
    texts = [(w,) for words in lists for w in words.split("|")] + [("src/" + w[1:],) for words in lists for w in words.split("|")]
    table = spark.createDataFrame([*texts, ("",), (None,), ("ap|i",)], "t string")
    for words in lists:
        got = table.select(holds_any(F.col("t"), words).alias("a"), F.rlike("t", F.lit(words)).alias("b"))
        assert got.filter("not (a <=> b)").count() == 0


def test_snake_leaves_texts_in_lower_case(spark):
    data = [("userRole", "user_role"), ("HTTPServer", "http_server"), ("user_role", "user_role"), ("öÄ", "öä"), ("ÄB", "äb"), ("a1B", "a1_b"), ("", "")]
    table = spark.createDataFrame(data, "t string, want string")
    assert table.filter(~snake(F.col("t")).eqNullSafe(F.col("want"))).count() == 0
