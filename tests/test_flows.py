"""Whole flows on small golden cases."""

import json

import pytest
from pyspark.sql import functions as F

from claimgrid.operators import extract, reports
from claimgrid.plans import verify
from claimgrid.sources import tables
from tests.golden import SCENARIO_1
from tests.helpers import SESSIONS, inputs, rows

OWNER = ("vault", "vault/keys.py", "keeper.role = 'owner'  # holds the spare keys")
ADMIN = ("audit", "audit/rounds.py", "assert visitor.role == 'admin', visitor")
REQUIREMENT = "Lock the vault at night. Only keeper users are allowed to open boxes."


@pytest.fixture(scope="module")
def pasted(spark):
    cases = {
        "conflict": [OWNER, ADMIN],
        "agree": [OWNER, (*ADMIN[:2], ADMIN[2].replace("admin", "owner"))],
        "duplicate": [OWNER, ADMIN, ADMIN],
        "no-path": [(OWNER[0], "", OWNER[2]), (ADMIN[0], None, ADMIN[2])],
        "silent": [("a", "a.ts", "x"), ("b", "b.ts", "y")],
    }
    return verify.verify(inputs(spark, cases, REQUIREMENT))


def test_verdicts_of_pasted_texts(pasted):
    got = {r.session_id: (r.status, r.conflicts_found, r.claims_found) for r in pasted.results.collect()}
    assert got == {
        "conflict": ("CONFLICTS_FOUND", 1, 3),
        "agree": ("PASS", 0, 3),
        "duplicate": ("CONFLICTS_FOUND", 1, 4),
        "no-path": ("CONFLICTS_FOUND", 1, 3),
        "silent": ("PASS", 0, 1),
    }
    summary = {r.session_id: r.summary for r in pasted.results.collect()}
    assert summary["agree"] == "No semantic conflicts detected. 3 assumptions extracted and all agree."


def test_the_owner_admin_report(pasted):
    report = pasted.reports.filter("session_id = 'conflict'").first()
    assert (report.conflict_type, report.affected_entity, report.severity, report.confidence) == (
        "BUSINESS_RULE", "user_role", "HIGH", "HIGH",
    )
    assert (report.l_predicate, report.r_predicate) == ("required_role = owner", "required_role = admin")
    assert report.severity_rule == "BUSINESS_RULE:auth_contradiction"
    assert report.title == "Authorization contradiction on 'user_role'"
    assert report.why_incompatible.startswith("'vault/keys.py' assumes that the privileged value for 'user_role' is 'owner'")
    files = rows(pasted.report_files.filter("session_id = 'conflict'"), "file_path")
    assert files == [("audit/rounds.py",), ("vault/keys.py",)]


def test_default_path_and_requirement_source(spark, pasted):
    paths = rows(pasted.claims.filter("session_id = 'no-path' and source_file is not null"), "source_file")
    assert paths == [("change-0.diff",), ("change-1.diff",)]
    by_text = verify.verify(inputs(spark, {"s": [OWNER, ADMIN]}, REQUIREMENT), source_type="REQUIREMENT")
    assert rows(by_text.reports, "severity", "confidence") == [("HIGH", "MEDIUM")]


def test_three_flows_agree(spark):
    sessions = spark.createDataFrame([("s", REQUIREMENT)], SESSIONS)
    branches = spark.createDataFrame([("s", OWNER[0], 0), ("s", ADMIN[0], 1)], "session_id string, branch_name string, declared_seq int")
    changed = spark.createDataFrame(
        [("s", i, b, p, "MODIFIED", t) for i, (b, p, t) in enumerate([OWNER, ADMIN])],
        "session_id string, seq int, branch_name string, path string, kind string, patch string",
    )
    raw = spark.createDataFrame(
        [("s", i, b, f"diff --git a/{p} b/{p}\n@@ -0,0 +1 @@\n+{t}\n") for i, (b, p, t) in enumerate([OWNER, ADMIN])],
        "session_id string, diff_id int, branch_name string, raw string",
    )
    flows = [
        inputs(spark, {"s": [OWNER, ADMIN]}, REQUIREMENT),
        verify.from_changed_files(sessions, branches, changed),
        verify.from_diffs(sessions, branches, raw),
    ]
    shown = ("conflict_type", "affected_entity", "l_predicate", "r_predicate", "severity", "confidence", "l_file", "r_file")
    outcomes = [rows(verify.verify(f).reports, *shown) for f in flows]
    assert outcomes[0] == outcomes[1] == outcomes[2]
    assert len(outcomes[0]) == 1


def test_a_conflict_in_the_sixtieth_file_is_found(spark):
    sessions = spark.createDataFrame([("s", REQUIREMENT)], SESSIONS)
    branches = spark.createDataFrame([("s", OWNER[0], 0), ("s", ADMIN[0], 1)], "session_id string, branch_name string, declared_seq int")
    quiet = [("s", i, OWNER[0], f"src/f{i}.ts", "MODIFIED", f"const n{i} = {i}") for i in range(59)]
    loud = [("s", 59, *OWNER[:2], "MODIFIED", "\n" * 21_000 + OWNER[2]), ("s", 60, *ADMIN[:2], "MODIFIED", ADMIN[2])]
    changed = spark.createDataFrame(
        [*quiet, *loud], "session_id string, seq int, branch_name string, path string, kind string, patch string"
    )
    result = verify.verify(verify.from_changed_files(sessions, branches, changed)).results.first()
    assert (result.conflicts_found, result.status) == (1, "CONFLICTS_FOUND")


def test_session_without_files_gets_the_empty_change(spark):
    sessions = spark.createDataFrame([("s", REQUIREMENT)], SESSIONS)
    none = spark.createDataFrame([], "session_id string, seq int, branch_name string, path string, kind string, patch string")
    branches = spark.createDataFrame([("s", "a", 0)], "session_id string, branch_name string, declared_seq int")
    flow = verify.from_changed_files(sessions, branches, none)
    assert rows(flow.changes, "change_id", "content") == [("change-empty", "No changes submitted for verification.")]


def test_own_extractor_and_detector(spark):
    flow = inputs(spark, {"s": [OWNER, ADMIN]}, REQUIREMENT)
    nothing = verify.verify(flow, extractor=lambda units: extract.claims(units, "CODE_DIFF").filter("false"))
    assert nothing.results.first().status == "PASS"
    from claimgrid.operators import pairing

    none = verify.verify(flow, detector=lambda claims: pairing.detect_conflicts(claims).filter("false"))
    assert none.results.first().conflicts_found == 0


def test_report_order_puts_underscores_first(spark):
    table = spark.createDataFrame(
        [("s", "HIGH", "a1"), ("s", "HIGH", "a_b"), ("s", "LOW", "0"), ("s", "MEDIUM", "z")],
        "session_id string, severity string, conflict_id string",
    )
    got = [r.conflict_id for r in reports.in_report_order(table).collect()]
    assert got == ["a_b", "a1", "z", "0"]


def test_requirement_of_a_feature_request(spark):
    table = spark.createDataFrame([("d", ["r1", "r2"]), ("d", None)], "description string, rules array<string>")
    assert rows(verify.requirement_text(table), "requirement_text") == [("d",), ("d\nr1\nr2",)]


def test_sources_and_sinks(spark, tmp_path, pasted):
    (tmp_path / "diffs").mkdir()
    for name, text in SCENARIO_1["patches"].items():
        (tmp_path / "diffs" / f"{name}.diff").write_text(text)
    read = tables.read_diff_texts(spark, str(tmp_path / "diffs"))
    assert rows(read, "branch_name", "raw") == sorted(SCENARIO_1["patches"].items())
    assert rows(tables.read_diff_texts(spark, str(tmp_path / "diffs"), "main"), "branch_name") == [("main",)] * 2

    scenario = {
        "id": "roles", "title": "t",
        "branches": [{"name": b, "changed_files": [], "patch": p} for b, p in SCENARIO_1["patches"].items()],
    }
    (tmp_path / "scenario.json").write_text(json.dumps(scenario))
    diffs = tables.scenario_diffs(tables.read_scenarios(spark, str(tmp_path / "scenario.json")))
    assert rows(diffs, "branch_name", "raw") == sorted(SCENARIO_1["patches"].items())

    secret = pasted.results.withColumn("agent_key", F.lit("hidden"))
    texts = [json.loads(t) for (t,) in rows(tables.public_json(secret), "json")]
    assert len(texts) == 5 and all("agent_key" not in t and "status" in t for t in texts)
    tables.write_table(secret, str(tmp_path / "out"))
    assert "agent_key" not in spark.read.parquet(str(tmp_path / "out")).columns
    tables.write_texts(tables.public_json(secret), str(tmp_path / "texts"), "json")
    assert spark.read.text(str(tmp_path / "texts")).count() == 5

    changed = pasted.claims.select(F.col("session_id"), F.lit("b1").alias("branch_name"))
    changed.write.parquet(str(tmp_path / "changed"))
    assert tables.read_changed_files(spark, str(tmp_path / "changed"), "other").count() == 0


def test_repository_defaults(spark):
    schema = "name string, provider string, feature_branches array<string>"
    good = tables.repositories(spark.createDataFrame([("n", None, ["b"])], schema))
    assert rows(good, "provider") == [("local",)]
    with pytest.raises(Exception, match="at least one feature branch"):
        tables.repositories(spark.createDataFrame([("n", "x", [])], schema)).collect()
