import pytest

from claimgrid.operators import normalize
from tests.helpers import rows

CLAIM = (
    "claim_id string, subject string, predicate string, statement string, source_type string, "
    "source_file string, evidence_text string"
)


@pytest.fixture(scope="module")
def normalized(spark):
    pairs = [
        ("role", "allowed_role = Owner"),
        ("manage subscriptions", "x"),
        ("UserEmail", "required = YES"),
        ("the", "type = a"),
        ("the order-total", "Max Size = 5"),
        ("a_b", "field = userId"),
        ("orgId", "must_be = 'Paid Up'"),
        ("HTTPServer", "is_required = no"),
        ("", "  "),
        ("status", "label = a; b C"),
    ]
    data = [(f"c{i}", s, p, "st", "CODE_DIFF", None, "ev") for i, (s, p) in enumerate(pairs)]
    df = normalize.normalize(spark.createDataFrame(data, CLAIM))
    return {r.claim_id: r for r in normalize.references(normalize.with_trace(df)).collect()}


@pytest.mark.parametrize(
    "claim,subject,predicate",
    [
        ("c0", "user_role", "required_role = owner"),
        ("c1", "subscription_management", "x"),
        ("c2", "email", "is_required = true"),
        ("c3", "", "type = a"),
        ("c4", "order_total", "max_size = 5"),
        ("c5", "a_b", "field_name = user_id"),
        ("c6", "organization_id", "must_be = paid up"),
        ("c7", "http_server", "is_required = false"),
        ("c8", "", ""),
    ],
)
def test_canonical_forms(normalized, claim, subject, predicate):
    row = normalized[claim]
    assert (row.canonical_subject, row.canonical_predicate) == (subject, predicate)


def test_trace_lists_each_change(normalized):
    assert [s.field for s in normalized["c0"].trace] == ["subject", "predicate", "value"]
    assert normalized["c3"].trace[0].explanation.startswith("Normalized entity")
    assert normalized["c1"].canonical_value is None


def test_trace_tells_notes_apart_inside_values(normalized):
    # The note about the value holds "; ", so its tail counts as a predicate step.
    assert [s.field for s in normalized["c9"].trace] == ["value", "predicate", "predicate"]


def test_primary_reference(normalized):
    ref = normalized["c0"].refs[0]
    assert (ref.ref_id, ref.text, ref.file_path) == ("c0__primary", "ev", None)


def test_dropped_claims(spark):
    data = [("c1", "the", "a = b", "st", "CODE_DIFF", None, "ev"), ("c2", "x", "a = b", "st", "CODE_DIFF", None, "ev")]
    df = spark.createDataFrame(data, CLAIM).selectExpr("'s' as session_id", "*")
    assert rows(normalize.dropped(normalize.normalize(df)), "claim_id") == [("c1",)]


def test_trace_rows_normalise_each_claim_once(spark):
    claims = spark.range(2).selectExpr(
        "id AS session_id", "concat('c', id) AS claim_id", "concat('the order-total', id) AS subject",
        "concat('Max Size = ', id) AS predicate",
    )
    traced = normalize.trace_rows(normalize.normalize(claims))
    plan = traced._jdf.queryExecution().optimizedPlan().toString()
    # A filter inferred for the generator would test the size of the steps, made once more.
    assert "size(concat(" not in plan
    assert {r.step for r in traced.collect()} >= {0}
