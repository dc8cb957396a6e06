"""Merging, pairing and counting against brute force, also on a hot session."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from claimgrid.operators import pairing, reports, summary
from tests.helpers import claim_table, rows

ROLES = ["owner", "admin", "guest", "member", "true"]


@pytest.fixture(scope="module")
def claims(spark):
    data = []
    for i in range(400):
        # A third of all claims and more sits in one session.
        session = "hot" if i % 3 else f"s{i % 7}"
        subject, key, value = [
            ("user_role", "required_role", ROLES[i % 5]),
            ("email", "is_required", ["true", "false", "maybe"][i % 3]),
            ("api_response_field", "field_name", f"f{i % 40}"),
            ("order", "must_be", f"v{i % 11}"),
            ("order", "colour", f"c{i % 5}"),
            ("", "must_be", f"v{i % 4}"),
        ][i % 6]
        source = ["CODE_DIFF", "REQUIREMENT", "TEST", "CODE_DIFF"][i % 4]
        data.append((session, i, subject, key, value, source, f"f{i % 9}.ts" if i % 4 == 0 else None))
    return claim_table(spark, data).cache()


@pytest.fixture(scope="module")
def expected(claims):
    """Conflicts formed by plain loops over merged claims."""
    merged = {}
    for r in sorted(claims.collect(), key=lambda r: r.change_seq):
        merged.setdefault((r.session_id, r.canonical_subject, r.canonical_predicate), r)
    found = []
    for a, b in combinations(merged.values(), 2):
        same = (a.session_id, a.canonical_subject, a.canonical_key) == (b.session_id, b.canonical_subject, b.canonical_key)
        if not same or a.canonical_subject == "" or a.canonical_key == "colour":
            continue
        flip = {a.canonical_value, b.canonical_value} == {"true", "false"}
        if a.canonical_key == "is_required" and not flip:
            continue
        quality = min(
            2 if r.source_type == "CODE_DIFF" and r.source_file else 1 if r.source_type in ("CODE_DIFF", "REQUIREMENT") else 0
            for r in (a, b)
        )
        direct = flip or all(v in ("owner", "admin", "member") for v in (a.canonical_value, b.canonical_value))
        severity = {
            "required_role": "HIGH" if direct else "MEDIUM",
            "must_be": "MEDIUM",
            "field_name": ["LOW", "MEDIUM", "HIGH"][quality],
            "is_required": "HIGH" if quality == 2 else "MEDIUM",
        }[a.canonical_key]
        found.append((a.session_id, a.claim_id, b.claim_id, severity))
    return sorted(found)


@pytest.mark.parametrize("block", [1, 7, 512])
def test_pairs_match_brute_force_for_any_block_size(claims, expected, block):
    got = pairing.detect_conflicts(claims, block)
    assert rows(got, "session_id", "l_claim_id", "r_claim_id", "severity") == expected


def test_counts_without_pairs_match_the_pairs(claims, expected):
    merged = pairing.merge_claims(claims)
    got = {r.session_id: (r.conflicts_found, r.high, r.medium, r.low) for r in summary.conflict_counts(merged).collect()}
    want = {}
    for session, _, _, severity in expected:
        n = want.setdefault(session, [0, 0, 0, 0])
        n[0] += 1
        n[1 + ["HIGH", "MEDIUM", "LOW"].index(severity)] += 1
    assert got == {s: tuple(n) for s, n in want.items()}


def test_row_order_and_partitions_do_not_matter(claims, expected):
    shuffled = claims.orderBy(F.rand(5)).repartition(13)
    got = pairing.detect_conflicts(shuffled)
    assert rows(got, "session_id", "l_claim_id", "r_claim_id", "severity") == expected


def test_merged_evidence_keeps_every_source(claims):
    evidence = pairing.merged_evidence(claims)
    assert evidence.count() == claims.count()
    files = pairing.evidence_files(claims)
    assert rows(files) == sorted(
        {
            (r.session_id, r.canonical_subject, r.canonical_predicate, r.source_file)
            for r in claims.collect() if r.source_file
        },
        key=str,
    )


def test_every_conflict_carries_its_order(claims, expected):
    found = pairing.detect_conflicts(claims)
    shown = reports.with_order(found)
    assert shown.count() == found.count()
    hot = shown.filter("session_id = 'hot'").orderBy("severity_order", "id_order").collect()
    ranks = ["HIGH", "MEDIUM", "LOW"]
    keys = [(ranks.index(r.severity), r.conflict_id.replace("_", " ")) for r in hot]
    assert keys == sorted(keys)


def test_counts_agree_with_the_conflicts_when_claim_ids_meet(spark):
    data = [("s", i, "order", "must_be", v, "CODE_DIFF", None) for i, v in enumerate(["a", "b", "c", "d"])]
    data += [("s", 10 + i, "user", "role", v, "CODE_DIFF", "x.ts") for i, v in enumerate(["owner", "admin", "guest"])]
    data += [("t", i, "order", "must_be", v, "CODE_DIFF", None) for i, v in enumerate(["a", "b"])]
    for met in ("change_seq < 2", "change_seq in (0, 1, 10)", "change_seq = 99", "change_seq in (0, 10) or change_seq in (1, 11)"):
        table = claim_table(spark, data).withColumn("claim_id", F.when(F.expr(met), "assm_x").otherwise(F.col("claim_id")))
        merged = pairing.merge_claims(table)
        pairs = pairing.conflicts_from_merged(merged).groupBy("session_id").agg(
            F.count("*").alias("conflicts_found"), F.count_if(F.col("severity") == "HIGH").alias("high"),
            F.count_if(F.col("severity") == "MEDIUM").alias("medium"), F.count_if(F.col("severity") == "LOW").alias("low"),
        )
        names = ("session_id", "conflicts_found", "high", "medium", "low")
        counts = summary.conflict_counts(merged).filter("conflicts_found > 0")
        assert rows(counts, *names) == rows(pairs, *names), met


def test_a_group_counts_its_pairs_without_forming_them(spark):
    data = [("hot", i, "order", "must_be", f"v{i}", "CODE_DIFF", None) for i in range(5_000)]
    merged = pairing.merge_claims(claim_table(spark, data))
    assert rows(summary.conflict_groups(merged), "n_values", "n_pairs") == [(5_000, 12_497_500)]
    assert rows(summary.conflict_counts(merged), "conflicts_found") == [(12_497_500,)]


def test_equal_claim_ids_are_not_paired_and_equal_conflict_ids_count_once(spark):
    data = [("s", i, "order", "must_be", v, "CODE_DIFF", None) for i, v in enumerate(["a", "b", "c"])]
    same = claim_table(spark, data).withColumn(
        "claim_id", F.when(F.col("change_seq") < 2, "assm_x").otherwise("assm_y")
    )
    got = pairing.detect_conflicts(same)
    assert rows(got, "l_value", "r_value") == [("a", "c")]




def test_a_large_group_is_dealt_to_blocks_and_paired_once(spark):
    data = [("hot", i, "order", "must_be", f"v{i}", "CODE_DIFF", None) for i in range(5_000)]
    data += [(f"s{i % 50}", i, "order", "must_be", f"v{i}", "CODE_DIFF", None) for i in range(500)]
    claims = pairing.pairable(pairing.merge_claims(claim_table(spark, data)))
    blocks = pairing.in_blocks(claims).groupBy("session_id", "blocks", "block").count().collect()
    assert {r.blocks for r in blocks if r.session_id == "hot"} == {4} and {r.blocks for r in blocks if r.session_id != "hot"} == {1}
    assert max(r["count"] for r in blocks) < 1_500
    counts = pairing.contradicting_pairs(claims).groupBy(F.col("session_id") == "hot").count().collect()
    assert {r[0]: r[1] for r in counts} == {True: 5_000 * 4_999 // 2, False: 50 * 45}


def test_rows_of_a_group_are_shuffled_once_for_both_sides(spark):
    data = [("s", i, "user_role", "required_role", f"v{i}", "CODE_DIFF", f"f{i}.ts") for i in range(40)]
    claims = pairing.pairable(pairing.merge_claims(claim_table(spark, data)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = pairing.contradicting_pairs(claims, block=8)
        pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.count() == 40 * 39 // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ReusedExchange" in plan.split("== Initial Plan ==")[0]
    assert sum("Exchange hashpartitioning" in line and " i#" in line for line in plan.split("== Initial Plan ==")[0].splitlines()) <= 2


def test_merged_claims_without_texts_give_the_same_conflicts(spark):
    data = [("s", i, "user_role", "required_role", f"v{i % 7}", "CODE_DIFF", f"f{i}.ts") for i in range(30)]
    table = claim_table(spark, data)
    lean = pairing.merge_claims(table, texts=False)
    assert not set(pairing.TEXTS) & set(lean.columns)
    found = pairing.conflicts_from_merged(lean)
    whole = pairing.conflicts_from_merged(pairing.merge_claims(table)).select(found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    assert found.count() == 21
