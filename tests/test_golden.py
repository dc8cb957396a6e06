"""The three golden scenarios: merged claims, conflicts and files."""

import pytest

from claimgrid.operators import pairing
from claimgrid.plans import verify
from tests.golden import SCENARIOS
from tests.helpers import SESSIONS, rows


@pytest.fixture(scope="module")
def outcome(spark):
    sessions = spark.createDataFrame([(s, case["requirement"]) for s, case in SCENARIOS.items()], SESSIONS)
    branches = [(s, b, i) for s, case in SCENARIOS.items() for i, b in enumerate(case["patches"])]
    raw = [(s, i, b, t) for s, case in SCENARIOS.items() for i, (b, t) in enumerate(case["patches"].items())]
    return verify.verify(
        verify.from_diffs(
            sessions,
            spark.createDataFrame(branches, "session_id string, branch_name string, declared_seq int"),
            spark.createDataFrame(raw, "session_id string, diff_id int, branch_name string, raw string"),
        )
    )


def test_merged_claims(outcome):
    got = pairing.merge_claims(outcome.normalized).groupBy("session_id").count()
    assert rows(got) == [("1", 2), ("2", 10), ("3", 11)]


def test_conflicts(outcome):
    got = rows(outcome.reports, "session_id", "conflict_type", "affected_entity", "l_predicate", "r_predicate", "severity", "confidence")
    assert [r[:5] for r in got] == [
        ("1", "BUSINESS_RULE", "user_role", "required_role = admin", "required_role = owner"),
        ("2", "CONTRACT", "api_response_field", "field_name = renamed", "field_name = to"),
        ("2", "CONTRACT", "handleevent", "signature = handleevent(_event: eventpayload)", "signature = handleevent(event: eventpayload)"),
        ("3", "DEPENDENCY", "email", "is_required = false", "is_required = true"),
    ]
    assert got[0][5] == "HIGH" and got[3][5:] == ("HIGH", "HIGH")
    assert rows(outcome.results, "session_id", "conflicts_found", "status") == [
        ("1", 1, "CONFLICTS_FOUND"), ("2", 2, "CONFLICTS_FOUND"), ("3", 1, "CONFLICTS_FOUND"),
    ]


def test_expected_files_are_covered(outcome):
    got = {(r.session_id, r.file_path) for r in outcome.report_files.collect()}
    for session, paths in {
        "1": ["src/auth/roles.ts", "src/billing/permissions.ts"],
        "2": ["src/activity-feed/handler.ts", "src/events/payload.ts"],
        "3": ["src/notifications/welcome-email.ts", "src/users/model.ts", "src/users/register.ts"],
    }.items():
        assert {(session, p) for p in paths} <= got
