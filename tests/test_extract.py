import re
import time

import pytest
from pyspark.sql import functions as F

from claimgrid.functions.rules import RULES, Reading, Rule
from claimgrid.functions.text import slug, subject_key
from claimgrid.operators import extract
from tests.helpers import rows, units

NBSP = chr(0xA0)
RULE_CASES = [
    ("Only organization owners can manage subscriptions", 0, "manage_subscriptions", "allowed_role = owners"),
    ("if role === 'admin' go", 1, "user_role", "allowed_role = admin"),
    ('ROLE = "Owner"', 2, "user_role", "assigned_role = Owner"),
    ("hasPermission('billing:Write')", 3, "billing_write", "required_permission = billing:write"),
    ("Every invoice must be paid", 4, "every_invoice", "must_be = paid"),
    ("Guests can't view pages", 5, "guests", "prohibited = view pages"),
    ("Only admin users are allowed to refund orders", 6, "refund_orders", "allowed_actor = admin users"),
    ('returns "userId" here', 7, "api_response_field", "field_name = userId"),
    ("expects field user_name", 8, "api_response_field", "expected_field = user_name"),
    ("def pay(order, sum)", 9, "pay", "signature = pay(order, sum)"),
    ("email is mandatory", 10, "email", "is_required = true"),
    ("phone field is optional", 11, "phone", "is_required = false"),
    ("{ email?: string }", 12, "email", "is_required = false"),
    ("total: Number", 13, "total", "type = number"),
    ("email is always defined", 14, "email", "always_present = true"),
    ("The job assumes every user has phone", 15, "phone", "always_present = true"),
    ("relies on the billing service", 16, "billing", "dependency_required = true"),
    ("It calls charge(card)", 17, "charge", "called_by_component = true"),
]


@pytest.fixture(scope="module")
def matched(spark):
    cases = [c[0] for c in RULE_CASES]
    found = extract.rule_matches(units(spark, *cases)).collect()
    return {(r.change_seq, r.rule_idx): r for r in found}


@pytest.mark.parametrize("at", range(len(RULE_CASES)))
def test_each_rule_reads_its_sentence(matched, at):
    _, rule, subject, predicate = RULE_CASES[at]
    hit = matched[(at, rule)]
    assert (hit.subject, hit.predicate) == (subject, predicate)


def test_rules_beyond_the_expected_ones(matched):
    extra = {k for k in matched if k[1] != RULE_CASES[k[0]][1]}
    # "expects field x" and "field is" also read as a field name.
    assert extra == {(8, 7), (11, 7)}


def test_optional_property_is_case_sensitive_but_others_are_not(spark):
    found = rows(extract.rule_matches(units(spark, "EMAIL IS REQUIRED")), "rule_idx", "subject")
    assert found == [(10, "email")]


def test_dots_split_segments(spark):
    found = rows(extract.rule_matches(units(spark, "if (user.role === 'admin') x", "calls payments.charge(x)")), "rule_idx", "seg_idx")
    assert found == [(1, 1)]


def test_blanks_beyond_ascii_count_as_blanks(spark):
    table = units(spark, f"email{NBSP}is{NBSP}required", f"{NBSP}abcd{NBSP}")
    assert rows(extract.rule_matches(table), "rule_idx", "subject") == [(10, "email")]
    assert rows(extract.segments(table, "change_seq"), "segment") == [(f"email{NBSP}is{NBSP}required",)]


def test_segment_length_counts_utf16_units(spark):
    rocket = chr(0x1F680)
    assert rows(extract.segments(units(spark, rocket * 2, rocket * 3, "abcd"), "change_seq"), "change_seq") == [(1,)]


def test_hint_limits_rules(spark):
    both = "Only owners can pay; email is required"
    authorization = extract.rule_matches(units(spark, both, hint="AUTHORIZATION"))
    business = extract.rule_matches(units(spark, both + "; fees must be paid", hint="BUSINESS_RULE"))
    assert rows(authorization, "rule_idx") == [(0,)]
    assert rows(business, "rule_idx") == [(0,), (4,)]


@pytest.mark.parametrize(
    "label,source,hint",
    [
        ("requirement", "REQUIREMENT", "BUSINESS_RULE"),
        ("Owner rules", "REQUIREMENT", "AUTHORIZATION"),
        ("docs/author.md", "DOCUMENTATION", "AUTHORIZATION"),
        ("src/request.ts", "CODE_DIFF", "CONTRACT"),
        ("users/model.ts", "CODE_DIFF", "SCHEMA"),
        ("welcome-email.ts", "CODE_DIFF", "DEPENDENCY"),
        ("src/invoice.ts", "CODE_DIFF", "BUSINESS_RULE"),
        ("src/main.ts", "CODE_DIFF", None),
    ],
)
def test_category_hints(spark, label, source, hint):
    got = spark.range(1).select(extract.category_hint(F.lit(label), F.lit(source))).first()[0]
    assert got == hint


def test_claims_are_deduped_and_numbered_per_unit(spark):
    table = units(spark, "email is required; email is required; phone is required", "email is required")
    got = rows(extract.claims(table), "change_seq", "claim_idx", "claim_id", "source_type")
    assert got == [
        (0, 0, "assm_u0__email__is_required_true__0", "REQUIREMENT"),
        (0, 1, "assm_u0__phone__is_required_true__1", "REQUIREMENT"),
        (1, 0, "assm_u1__email__is_required_true__0", "REQUIREMENT"),
    ]


def test_noun_is_looked_up_in_the_whole_unit(spark):
    table = units(spark, "The phone is here; it assumes every user has one")
    got = rows(extract.rule_matches(table).filter("rule_idx = 15"), "subject")
    assert got == [("phone",)]


def test_diagnostics_name_the_reason(spark):
    got = dict(rows(extract.diagnostics(units(spark, " \t", "ok.", "nothing to see", "email is required")), "change_seq", "message"))
    assert set(got) == {0, 1, 2}
    assert "empty text" in got[0] and "too short" in got[1] and "no pattern matched" in got[2]


def test_rule_set_can_be_extended(spark):
    own = Rule(
        "own:limit", "SCHEMA", r"limit\s+(\d+)", 1, "LOW", ("limit",),
        lambda hit: Reading(F.lit("limit"), F.concat(F.lit("limit = "), hit.group(1)), F.lit("limit"), F.lit(True)),
    )
    got = extract.claims(units(spark, "limit 20 applies"), rules=[*RULES, own])
    assert rows(got, "rule_id", "predicate") == [("own:limit", "limit = 20")]


def test_slug_keeps_its_form_and_takes_no_longer_than_other_patterns(spark):
    texts = ["a b", "Ä-ö", "x__y", "A.B/c", "", "\U0001f600!z", "0_9"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(slug(F.col("t"), F.lit("Z"))).collect()]
    assert got == [re.sub("[^A-Za-z0-9_]+", "_", f"{t}__Z").lower() for t in texts]
    ids = spark.range(0, 60_000, 1, 1).select(F.concat(F.lit("assm_change_"), F.col("id"), F.lit("__snippet_0__user_role__allowed_role = owner" * 3)).alias("s"))

    def seconds(column):
        start = time.perf_counter()
        ids.select(F.sum(F.length(column))).collect()
        return time.perf_counter() - start

    seconds(slug(F.col("s")))
    assert seconds(slug(F.col("s"))) < 3 * seconds(subject_key(F.col("s"))) + 0.3
