import pytest
from pyspark.sql import functions as F

from claimgrid.operators import checks
from tests.helpers import rows

ID = "123e4567-e89b-42d3-a456-426614174000"
TIME = "2024-08-01T12:00:00.000Z"


def fields(df):
    return [f for (f,) in rows(df, "field")]


def one(spark, values):
    """One-row table with typed columns from plain values."""
    columns = []
    for name, value in values.items():
        columns.append((F.lit(None).cast("string") if value is None else F.lit(value)).alias(name))
    return spark.range(1).select(F.lit("k").alias("record"), *columns)


BASES = {
    "code_evidence_checks": dict(source="TEST", file_path="a", line_start=1, line_end=2, branch_name="b"),
    "criterion_checks": dict(key="k", description="d"),
    "feature_request_checks": dict(id=ID, title="t", description="d", created_at=TIME, submitted_by="me"),
    "branch_checks": dict(name="main", sha="a" * 40),
    "changed_file_checks": dict(path="p", kind="ADDED", previous_path=None, additions=0, deletions=0, branch_name="b"),
    "domain_claim_checks": dict(
        id=ID, branch_name="b", source_file="f", statement="s", concept="a-b", value="v", source_agent="intent",
        confidence="HIGH", numeric_confidence=0.5, extracted_at=TIME,
    ),
    "dependency_checks": dict(
        id=ID, from_file_path="a", from_branch_name="b", to_file_path="c", to_branch_name="d", kind="IMPORT",
        is_cross_module=True,
    ),
    "finding_checks": dict(
        id=ID, title="t", description="d", severity="HIGH", category="LOGIC", affected_claim_ids=[ID],
        proposed_resolution=None, resolved_at=None,
    ),
    "summary_checks": dict(
        assumptions_found=3, conflicts_found=1, conflicts_resolved=0, files_changed=2, requirement_coverage=50
    ),
    "result_checks": dict(
        id=ID, schema_version="1.0.0", status="PASS", started_at=TIME, completed_at=TIME, error_message=None
    ),
    "passport_draft_checks": dict(
        id=ID, title="t", intent_summary="i", generated_at=TIME, approved_by=None, approved_at=None,
        verification_result_id=ID, embedded_result_id=ID,
    ),
    "repository_checks": dict(
        id=ID, name="n", clone_url="u", provider="p", feature_branches=["b"], resolved_at=TIME
    ),
}
FLAWS = [
    ("code_evidence_checks", dict(line_end=0), ["line", "lineEnd"]),
    ("code_evidence_checks", dict(source="GUESS"), ["source"]),
    ("criterion_checks", dict(key=""), ["key"]),
    ("feature_request_checks", dict(id="x", created_at="2024-08-01"), ["createdAt", "id"]),
    ("feature_request_checks", dict(created_at="2024-13-41T12:00:00Z"), ["createdAt"]),
    ("branch_checks", dict(sha="A" * 40), ["sha"]),
    ("changed_file_checks", dict(kind="RENAMED"), ["previousPath"]),
    ("changed_file_checks", dict(additions=-1), ["additions"]),
    ("domain_claim_checks", dict(concept="Not Kebab", numeric_confidence=1.5), ["concept", "numericConfidence"]),
    ("dependency_checks", dict(kind="X", to_file_path=""), ["kind", "to.filePath"]),
    ("finding_checks", dict(title="t" * 161, resolved_at=TIME), ["resolvedAt", "title"]),
    ("finding_checks", dict(severity="INFO", category="STYLE"), ["category", "severity"]),
    ("summary_checks", dict(conflicts_resolved=2, requirement_coverage=101), ["conflictsResolved", "requirementCoverage"]),
    ("result_checks", dict(status="PENDING"), ["completedAt"]),
    ("result_checks", dict(status="ERROR", schema_version="1.0"), ["errorMessage", "schemaVersion"]),
    ("passport_draft_checks", dict(approved_by="me"), ["approvedBy"]),
    ("passport_draft_checks", dict(embedded_result_id="other"), ["verificationResultId"]),
    ("repository_checks", dict(provider=""), ["provider"]),
]


def test_good_records_have_no_issues(spark):
    for name, base in BASES.items():
        assert fields(checks.record_errors(one(spark, base), ["record"], getattr(checks, name))) == [], name


@pytest.mark.parametrize("name,change,expected", FLAWS)
def test_flawed_records(spark, name, change, expected):
    table = one(spark, {**BASES[name], **change})
    assert fields(checks.record_errors(table, ["record"], getattr(checks, name))) == expected


def test_input_errors(spark):
    sessions = spark.createDataFrame([("s", " "), ("t", "text"), ("idle", "x")], "session_id string, requirement_text string")
    changes = spark.createDataFrame(
        [("s", 0, "a", "l", "c"), ("s", 1, "a", "", "c"), ("s", 2, " ", "l", None), ("t", 0, "a", "l", "c")],
        "session_id string, change_seq int, change_id string, label string, content string",
    )
    snippets = spark.createDataFrame(
        [("s", 0, 0, "", "c", (1, 2)), ("s", 0, 1, "f", "c", (3, 2)), ("t", 0, 0, "f", "c", None)],
        "session_id string, change_seq int, snippet_seq int, file_path string, content string, line_range struct<start:int,end:int>",
    )
    errors = checks.input_errors(sessions, changes, snippets)
    assert rows(errors, "session_id", "field") == sorted(
        [
            ("idle", "changes"), ("s", "requirementText"), ("s", "changes[1].label"), ("s", "changes[1].id"),
            ("s", "changes[2].id"), ("s", "changes[2].content"), ("s", "changes[0].fileSnippets[0].filePath"),
            ("s", "changes[0].fileSnippets[1].lineRange"),
        ],
        key=str,
    )
    with pytest.raises(ValueError, match="Invalid AnalysisInput: 8 errors"):
        checks.assert_none(errors, "AnalysisInput")


CLAIM = "struct<claim_id:string,statement:string,subject:string,predicate:string,source_type:string,evidence_text:string,confidence:string>"
REF = "struct<ref_id:string,source_type:string,file_path:string,line_range:struct<start:int,end:int>,text:string,label:string>"
GOOD_CLAIM = ("c", "s", "User", "p", "CODE_DIFF", "e", "HIGH")


def test_claims_candidates_and_conflicts(spark):
    bad_ref = ("", "CODE_DIFF", None, (0, -1), " ", None)
    claims = spark.createDataFrame([("k", *GOOD_CLAIM[:6], "SURE", [bad_ref])], f"key string, {CLAIM[7:-1].replace(':', ' ')}, supporting_evidence array<{REF}>")
    assert fields(checks.claim_errors(claims, ["key"])) == [
        "confidence", "supportingEvidence[0].id", "supportingEvidence[0].lineRange", "supportingEvidence[0].lineRange[0]",
        "supportingEvidence[0].lineRange[1]", "supportingEvidence[0].text",
    ]
    other = ("c2", "", "order", "p", "CODE_DIFF", "e", "HIGH")
    candidates = spark.createDataFrame(
        [("k", "id", "CONTRACT", "HIGH", "LOW", "OPEN", "e", "", GOOD_CLAIM, other)],
        "key string, candidate_id string, conflict_type string, estimated_severity string, confidence string, status string, "
        f"affected_entity string, pairing_rationale string, left {CLAIM}, right {CLAIM}",
    )
    assert fields(checks.candidate_errors(candidates, ["key"])) == [
        "affectedEntity", "pairingRationale", "rightAssumption.statement", "status",
    ]
    conflicts = spark.createDataFrame(
        [("k", "id", "CONTRACT", "x", "e", "HIGH", "LOW", [], "not a time", GOOD_CLAIM, GOOD_CLAIM)],
        "key string, conflict_id string, conflict_type string, explanation string, affected_entity string, severity string, "
        f"confidence string, evidence array<{REF}>, confirmed_at string, left {CLAIM}, right {CLAIM}",
    )
    assert fields(checks.conflict_errors(conflicts, ["key"])) == ["confirmedAt", "evidenceReferences"]


def test_golden_record_integrity(spark):
    claims = spark.createDataFrame([("r", "c1"), ("r", "c2"), ("r", "c3")], "result_id string, claim_id string")
    findings = spark.createDataFrame([("r", ["c1", "c9"])], "result_id string, affected_claim_ids array<string>")
    assert rows(checks.unknown_claim_ids(findings, claims), "claim_id") == [("c9",)]
    good = ("r", 3, 1, 0, 1, 0, 0)
    schema = "result_id string, assumptions_found int, conflicts_found int, critical int, high int, medium int, low int"
    assert checks.miscounted(spark.createDataFrame([good], schema), claims, findings).count() == 0
    assert checks.miscounted(spark.createDataFrame([(*good[:4], 2, 0, 0)], schema), claims, findings).count() == 1
