"""Steps that tell keys that come twice from all others, against the plain steps."""

import pytest
from pyspark.sql import functions as F

from claimgrid.operators import pairing, repeats, reports, summary
from claimgrid.session import stage
from tests.helpers import claim_table, rows

ALONE = "change_seq = -1"
SOME = "change_seq in (0, 1, 10)"
ALL = "change_seq >= 0"


def table(spark, met):
    """Claims of which those that ``met`` names share their id."""
    data = [("s", i, "order", "must_be", f"v{i % 5}", "CODE_DIFF", f"f{i % 3}.ts") for i in range(12)]
    data += [("t", i, "user", "role", v, "TEST", None) for i, v in enumerate(["owner", "admin", "owner", "guest"])]
    data += [(None, i, "order", "must_be", f"v{i}", "CODE_DIFF", None) for i in range(3)]
    found = claim_table(spark, data)
    return stage(found.withColumn("claim_id", F.when(F.expr(met), "assm_x").otherwise(F.col("claim_id"))), "claims")


@pytest.mark.parametrize("most", [0, 500_000])
@pytest.mark.parametrize("met", [ALONE, SOME, ALL])
def test_stored_tables_give_the_same_evidence_and_conflicts(spark, monkeypatch, met, most):
    monkeypatch.setattr(repeats, "FEW", most)
    normalized = table(spark, met)
    claims = stage(pairing.pairable(pairing.merge_claims(normalized, texts=False)), "pairable")
    plain = pairing.conflicts_from_pairable(claims)
    found = pairing.staged_conflicts(claims)
    assert found.columns == plain.columns and rows(found) == rows(plain)
    assert rows(pairing.merged_evidence(normalized, stored=True)) == rows(pairing.merged_evidence(normalized))
    whole = reports.report_evidence(plain, pairing.merged_evidence(normalized))
    got = reports.report_evidence(found, pairing.merged_evidence(normalized, stored=True), stored=True)
    assert got.columns == whole.columns and rows(got) == rows(whole)
    assert met == ALL or got.count() > 0


def test_rows_with_keys_of_their_own_are_not_shuffled_again(spark):
    normalized = table(spark, ALONE)
    claims = stage(pairing.pairable(pairing.merge_claims(normalized, texts=False)), "pairable")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pairing.staged_conflicts(claims)
        got = reports.report_evidence(found, pairing.merged_evidence(normalized, stored=True), stored=True)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The two sides of the join of conflicts and evidence, and nothing else.
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("most", [0, 500_000])
def test_large_groups_are_sent_to_stored_claims(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "FEW", most)
    data = [("hot", i, "order", "must_be", f"v{i}", "CODE_DIFF", None) for i in range(60)]
    data += [(f"s{i % 9}", i, "order", "must_be", f"v{i}", "CODE_DIFF", None) for i in range(40)]
    claims = stage(pairing.pairable(pairing.merge_claims(claim_table(spark, data))), "pairable")
    plain = pairing.in_blocks(claims, 10)
    assert rows(pairing.in_blocks(claims, 10, stored=True), *plain.columns) == rows(plain)
    assert rows(pairing.contradicting_pairs(claims, 10, stored=True)) == rows(pairing.contradicting_pairs(claims, 10))


@pytest.mark.parametrize("most", [0, 500_000])
@pytest.mark.parametrize("met", [ALONE, SOME, ALL])
def test_counts_agree_with_the_conflicts_however_ids_are_told(spark, monkeypatch, met, most):
    monkeypatch.setattr(repeats, "FEW", most)
    merged = pairing.merge_claims(table(spark, met), texts=False)
    pairs = pairing.conflicts_from_merged(merged).groupBy("session_id").agg(
        F.count("*").alias("conflicts_found"), F.count_if(F.col("severity") == "HIGH").alias("high")
    )
    names = ("session_id", "conflicts_found", "high")
    counts = summary.conflict_counts(merged).filter("conflicts_found > 0 and session_id is not null")
    assert rows(counts, *names) == rows(pairs, *names)


def test_claims_with_ids_of_their_own_are_counted_without_a_join(spark):
    counts = summary.conflict_counts(pairing.merge_claims(table(spark, ALONE), texts=False))
    assert "Join" not in counts._jdf.queryExecution().executedPlan().toString()
