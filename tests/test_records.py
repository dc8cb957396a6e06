"""Checked writes, committed nested records, rule sets as tables, factorised evidence."""

import json

import pytest
from pyspark.sql import functions as F

from claimgrid.functions import rulebook
from claimgrid.operators import checks, extract, pairing, reports
from claimgrid.plans import verify
from claimgrid.sources import tables
from tests.helpers import claim_table, inputs, rows, units

FILE = "path string, kind string, previous_path string, additions int, deletions int, branch_name string"


def test_a_bad_row_stops_the_write(spark, tmp_path):
    good = [(f"p{i}", "ADDED", None, 1, 0, "b") for i in range(50)]
    path = str(tmp_path / "good")
    assert checks.write_checked(spark.createDataFrame(good, FILE), checks.changed_file_checks, path, "ChangedFile") == 50
    assert spark.read.parquet(path).columns == [c.split()[0] for c in FILE.split(", ")]
    bad = [*good, ("", "COPIED", None, 1, 0, "b"), ("x", "RENAMED", None, -1, 0, "b")]
    with pytest.raises(checks.InvalidRows, match="Invalid ChangedFile: 4 errors, among them: additions") as caught:
        checks.write_checked(spark.createDataFrame(bad, FILE).repartition(3), checks.changed_file_checks, str(tmp_path / "bad"), "ChangedFile")
    assert caught.value.errors == 4
    assert sorted(p.name for p in tmp_path.iterdir()) == ["good"]
    with pytest.raises(FileExistsError):
        checks.write_checked(spark.createDataFrame(good, FILE), checks.changed_file_checks, path, "ChangedFile")
    assert checks.write_checked(spark.createDataFrame([], FILE), checks.changed_file_checks, str(tmp_path / "none"), "ChangedFile") == 0


NESTED = "id bigint, source struct<name:string,branches:array<struct<name:string,sha:string>>>, findings array<struct<id:string,claims:array<string>>>"


def test_nested_records_round_trip_and_corrupt_ones_are_reported(spark, tmp_path):
    records = [
        {"id": 1, "source": {"name": "é", "branches": [{"name": "a", "sha": None}, {"name": "b", "sha": "x"}]}, "findings": []},
        {"id": 2, "source": None, "findings": [{"id": "f", "claims": ["c", "d"]}]},
    ]
    broken = ['{"id": 3', '{"id": 4, "findings": "none"}', '{"id": "five"}', '{"id": 6, "source": {"branches": [{"name": {}}, 1]}}']
    (tmp_path / "in.json").write_text("\n".join([*map(json.dumps, records), *broken, "", "  "]))
    good, corrupt = tables.read_records(spark, str(tmp_path / "in.json"), NESTED)
    assert sorted(r.value for r in corrupt.collect()) == sorted(broken)
    root = str(tmp_path / "root")
    assert tables.committed(spark, root) == []
    assert tables.commit_records(good, root, "one") and not tables.commit_records(good, root, "one")
    assert tables.commit_records(good.filter("id = 2"), root, "two")
    # A lost attempt leaves a folder that no manifest names.
    good.write.json(f"{root}/part-lost")
    assert len(tables.committed(spark, root)) == 2
    read, unread = tables.read_records(spark, tables.committed(spark, root), NESTED)
    got = [r.asDict(recursive=True) for r in read.orderBy("id").collect()]
    assert got == [records[0], records[1], records[1]] and unread.count() == 0
    with pytest.raises(ValueError):
        tables.commit_records(good, root, "../x")


def rule(**changes):
    row = {"rule_set": "s", "place": 0, "rule_id": "r", "category": "SCHEMA", "confidence": "HIGH", "pattern": r"(\w+) needs (\w+)", "ignore_case": True,
           "triggers": ["needs"], "subject": "{1|key}", "predicate": "needs = {2|lower}", "statement": "{1} needs {2}!"}
    return tuple({**row, **changes}.values())


def test_rule_sets_are_chosen_per_session(spark):
    book = spark.createDataFrame([rule(), rule(rule_set="t", pattern="needs (a)?(b)?", subject="x{1}", predicate="p{2}", statement="s")], rulebook.SCHEMA)
    sets = rulebook.rule_sets(book)
    table = units(spark, "Door NEEDS Key. wall needs a", session="one").unionByName(units(spark, "it needs ab; it needs b", session="two"))
    chosen = spark.createDataFrame([("one", "s"), ("two", "t"), ("three", "t")], "session_id string, rule_set string")
    got = extract.rule_set_claims(table, chosen, sets)
    assert rows(got, "rule_set", "session_id", "subject", "predicate", "statement") == [
        ("s", "one", "door", "needs = key", "Door needs Key!"), ("s", "one", "wall", "needs = a", "wall needs a!"),
        ("t", "two", "xa", "pb", "s"),
    ]
    unknown = spark.createDataFrame([("one", "nope")], "session_id string, rule_set string")
    with pytest.raises(Exception, match="unknown rule set: nope"):
        extract.rule_set_matches(table, unknown, sets).collect()


@pytest.mark.parametrize("changes", [{"subject": "{3}"}, {"triggers": ["Needs"]}, {"triggers": []}, {"pattern": "a(?=b)"}])
def test_rules_that_cannot_run_are_refused(spark, changes):
    with pytest.raises(ValueError):
        rulebook.rule_sets(spark.createDataFrame([rule(**changes)], rulebook.SCHEMA))


def test_detectors_are_chosen_by_name(spark):
    texts = {"s": [("a", "x.ts", "role = 'owner'"), ("b", "y.ts", "role = 'admin'")],
             "t": [("a", "x.ts", "orders must be paid"), ("b", "y.ts", "orders must be sent")]}
    found = {n: rows(verify.verify(inputs(spark, texts), detector=n).results, "session_id", "status") for n in ("contradictions", "direct")}
    assert [s for _, s in found["contradictions"]] == ["CONFLICTS_FOUND"] * 2
    assert found["direct"] == [("s", "CONFLICTS_FOUND"), ("t", "PASS")]
    with pytest.raises(ValueError, match="unknown detector"):
        verify.verify(inputs(spark, texts), detector="nope")


def test_evidence_in_factors_expands_to_the_reports(spark):
    data = [("hot", i, "order", "must_be", f"v{i % 40}", "CODE_DIFF", f"f{i % 90}.ts") for i in range(400)]
    normalized = claim_table(spark, data)
    found = pairing.detect_conflicts(normalized)
    evidence = reports.evidence_of(found, normalized)
    n_conflicts = found.count()
    assert n_conflicts == 40 * 39 // 2
    assert evidence.sides.count() == 2 * n_conflicts and evidence.references.count() == 400
    assert rows(evidence.expand_references()) == rows(reports.report_evidence(found, pairing.merged_evidence(normalized)))
    assert rows(evidence.expand_files()) == rows(reports.report_files(found, pairing.evidence_files(normalized)))
    counts = evidence.counts()
    assert counts.agg(F.sum("n_refs")).first()[0] == evidence.sides.join(evidence.references, pairing.MERGE_KEY).count() == 400 * 39
    one = found.select("session_id", "conflict_id").limit(1)
    assert evidence.expand_references(one).select("conflict_id").distinct().count() == 1
