"""Diff files read by splits, and repository contexts."""

import random

import pytest

from claimgrid.operators import context, diffs
from claimgrid.session import stage
from claimgrid.sources import tables
from tests.helpers import rows
from tests.test_diffs import DIFFS

COLUMNS = ["path", "previous_path", "kind", "is_binary", "additions", "deletions", "patch", "hunks"]


def both(spark, folder):
    """Files of each diff in order, read whole and read by splits."""
    whole, split = {}, {}
    for r in diffs.diff_files(tables.read_diff_texts(spark, folder)).orderBy("diff_id", "file_idx").collect():
        whole.setdefault(r.diff_id, []).append(tuple(r[c] for c in COLUMNS))
    read = diffs.parse_chunk(tables.read_split_diffs(spark, folder))
    for r in read.orderBy("diff_id", "place").collect():
        split.setdefault(r.diff_id, []).append(tuple(r[c] for c in COLUMNS))
    return whole, split


def test_splits_give_the_files_of_whole_diffs(spark, tmp_path):
    rng = random.Random(4)
    extra = {
        "two_in_line": "diff --git a/x b/x\n@@ -1 +1 @@\n+see diff --git a/y b/y\n",
        "odd_breaks": "diff --git a/x b/x\r@@ -1 +1 @@\n+a\rdiff --git a/y b/y\n@@ -1 +1 @@\n+b",
        "unread_header": "diff --git x\n--- a/gone b\ndiff --git a/y b/y\n@@ -1 +1 @@\n-c\n\n\ndiff --git a/z b/z\n@@ -2 +2 @@\n+d\n\n",
        "preamble": "a/one b/two\n--- a/no\n+++ b/no\ndiff --git a/y b/y\n@@ -1 +1 @@\n+é\n",
        "large": "".join(
            f"diff --git a/src/f{k}.ts b/src/f{k}.ts\n@@ -1 +1,{n} @@\n" + "".join(f"+line {j} ü\n" for j in range(n))
            for k, n in enumerate(rng.randrange(1, 60) for _ in range(800))
        ),
    }
    for name, text in {**DIFFS, **extra}.items():
        (tmp_path / f"{name}.diff").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728", "20000", "777"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            whole, split = both(spark, str(tmp_path))
            assert split == whole, size
        large = spark.read.option("lineSep", f"\n{diffs.DIFF_MARK}").text(f"{tmp_path}/large.diff")
        assert large.rdd.getNumPartitions() > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(map(len, whole.values())) > 800 and any(len(v) == 2 for k, v in whole.items() if "headerless" in k)


LOG = "repository string, branch_name string, ts timestamp, event_id long, sha string"
SESSIONS = (
    "session_id string, repository string, clone_url string, provider string, base_branch string, "
    "feature_branches array<string>, at timestamp"
)
FILES = "session_id string, seq int, branch_name string, path string, kind string, previous_path string, patch string"


def test_refs_are_those_of_the_time(spark):
    rng = random.Random(9)
    log = [(f"r{rng.randrange(2)}", rng.choice("ab"), rng.randrange(0, 4000), k, f"sha{k}") for k in range(300)]
    wanted = [(f"r{rng.randrange(3)}", rng.choice("abc"), rng.randrange(-50, 4200), k) for k in range(200)]
    want = sorted(
        ((*w[:2], w[3], max(((t, e, s) for r, b, t, e, s in log if (r, b) == w[:2] and t <= w[2]), default=(0, 0, None))[2]) for w in wanted),
        key=str,
    )
    logged = spark.createDataFrame(log, "repository string, branch_name string, t long, event_id long, sha string")
    logged = logged.selectExpr("*", "timestamp_seconds(t) as ts").drop("t")
    asked = spark.createDataFrame(wanted, "repository string, branch_name string, t long, k int").selectExpr("*", "timestamp_seconds(t) as at").drop("t")
    for seconds in (1, 50, 3000, 10**6):
        got = context.refs_as_of(asked, logged, seconds)
        assert rows(got, "repository", "branch_name", "k", "sha") == want, seconds


def made(spark, features, log):
    sessions = spark.createDataFrame([("s", "r", "url", None, "main", features, None)], SESSIONS).selectExpr(
        "session_id", "repository", "clone_url", "provider", "base_branch", "feature_branches", "timestamp '2024-01-02 00:00:00' as at"
    )
    entries = spark.createDataFrame([("r", b, None, k, f"sha-{b}-{k}") for k, b in enumerate(log)], LOG).selectExpr(
        "repository", "branch_name", "timestamp '2024-01-01 00:00:00' as ts", "event_id", "sha"
    )
    patch = "diff --git a/x b/x\n@@ -1 +1 @@\n+a\n@@ -9 +9 @@\n+b\n"
    changed = [("s", 0, "b", "x", "MODIFIED", None, "old"), ("s", 1, "b", "x", "MODIFIED", None, patch), ("s", 2, "c", "y", "ADDED", None, None),
               ("s", 3, "other", "z", "ADDED", None, None), ("t", 4, "b", "z", "ADDED", None, None)]
    return context.repository_context(sessions, entries, spark.createDataFrame(changed, FILES))


def test_a_context_has_record_files_and_evidence(spark):
    found = made(spark, ["c", "b"], ["main", "b", "c", "b", "main", "other"])
    record = found.source.first()
    assert (record.name, record.provider, record.base_branch.sha) == ("r", "local", "sha-main-4")
    assert [(b.name, b.sha) for b in record.feature_branches] == [("c", "sha-c-2"), ("b", "sha-b-3")]
    assert rows(found.changed_files, "branch_name", "path") == [("b", "x"), ("c", "y")]
    assert rows(found.evidence, "file_path", "evidence_idx", "snippet") == [("x", 0, "+a"), ("x", 1, "+b"), ("y", 0, None)]


@pytest.mark.parametrize("features,log,message", [([], ["main"], "at least one feature"), (["b", "nope"], ["main", "b"], "unknown branch: nope of r")])
def test_empty_and_unknown_branches_fail(spark, features, log, message):
    with pytest.raises(Exception, match=message):
        made(spark, features, log).source.collect()


def test_staged_tables_are_written_small_and_read_back(spark):
    kept = stage(spark.range(5), "small")
    assert sorted(r.id for r in kept.collect()) == list(range(5))
    assert all(name.endswith(".zstd.parquet") for name in kept.inputFiles())
