import pytest

from claimgrid.operators import files
from tests.helpers import rows

FILE = "session_id string, seq int, branch_name string, path string, kind string, patch string"


def table(spark, *data):
    return spark.createDataFrame(list(data), FILE)


def test_dedupe_keeps_the_last_row_at_the_first_place(spark):
    got = files.dedupe(
        table(
            spark,
            ("s", 0, "b", "x", "ADDED", "one"),
            ("s", 1, "b", "y", "ADDED", "two"),
            ("s", 2, "b", "x", "MODIFIED", None),
            ("s", 3, "c", "x", "ADDED", "four"),
        )
    )
    assert rows(got, "branch_name", "path", "seq", "kind", "patch") == [
        ("b", "x", 0, "MODIFIED", None), ("b", "y", 1, "ADDED", "two"), ("c", "x", 3, "ADDED", "four"),
    ]


def test_all_files_are_forwarded_whole(spark):
    data = [("s", i, "b", f"p{i}", "ADDED", "x" * (20_005 if i == 3 else 5)) for i in range(60)]
    data += [("s", 100 + i, "b", f"blank{i}", "ADDED", p) for i, p in enumerate(["  ", None, ""])]
    df = table(spark, *data)
    fed = files.forwarded(df).collect()
    assert sorted(r.seq for r in fed) == list(range(60))
    assert {len(r.content) for r in fed} == {5, 20_005}
    assert files.patch_warnings(df).count() == 2


def test_sizes_refuse_nothing(spark):
    data = [("many", i, "b", f"p{i}", "ADDED", "x") for i in range(201)]
    data += [("large", 0, "b", "p", "ADDED", "é" * 500_001), ("none", 0, "b", "p", "ADDED", None)]
    assert rows(files.sizes(table(spark, *data))) == [("large", 1, 1_000_002), ("many", 201, 201), ("none", 1, 0)]


def test_files_of_a_head(spark):
    heads = spark.createDataFrame([("s", "a"), ("s", "idle")], "session_id string, branch_name string")
    df = table(spark, ("s", 0, "a", "p", "ADDED", "xy"), ("s", 1, "a", "q", "ADDED", "z"), ("s", 2, "b", "r", "ADDED", "z"))
    assert rows(files.head_files(heads, df), "branch_name", "path") == [("a", "p"), ("a", "q")]


def test_heads_without_files_stay(spark):
    heads = spark.createDataFrame([("s", "a"), ("s", "b")], "session_id string, branch_name string")
    df = table(spark, ("s", 0, "a", "p", "ADDED", "xy"))
    assert rows(files.by_head(heads, df)) == [("s", "a", 1, 2), ("s", "b", 0, 0)]
    assert rows(files.change_content(heads, files.forwarded(df)), "branch_name", "content") == [
        ("a", "—"), ("b", "No textual differences for b."),
    ]


def test_unknown_branch_fails(spark):
    wanted = spark.createDataFrame([("s", "zz")], "session_id string, branch_name string")
    known = table(spark, ("s", 0, "a", "p", "ADDED", "xy"))
    with pytest.raises(Exception, match="unknown branch: zz"):
        files.check_branches(wanted, known).collect()


def test_branch_order_and_file_owner(spark):
    df = table(spark, ("s", 0, "x", "p", "ADDED", "1"), ("s", 1, "b", "p", "ADDED", "1"), ("s", 2, "a", "q", "ADDED", "1"))
    declared = spark.createDataFrame(
        [("s", "a", 0), ("s", "b", 1), ("s", "idle", 2)], "session_id string, branch_name string, declared_seq int"
    )
    assert rows(files.ordered_branches(declared, df), "branch_name", "declared_seq", "first_seq") == [
        ("a", 0, 2), ("b", 1, 1), ("x", None, 0),
    ]
    assert rows(files.branch_by_file(df), "path", "branch_name") == [("p", "x"), ("q", "a")]
    assert rows(files.files_changed(df)) == [("s", 2)]
