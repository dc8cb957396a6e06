import pytest
from pyspark.sql import functions as F

from claimgrid.operators import diffs, evidence
from tests.helpers import rows

DIFFS = {
    "two": (
        "diff --git a/src/x.ts b/src/x.ts\nindex 1..2 100644\n--- a/src/x.ts\n+++ b/src/x.ts\n"
        "@@ -1,2 +1,3 @@ fn()\n ctx\n-old\n+new\n+more\n@@ -10 +11 @@\n-a\n+b\n"
        "diff --git a/y.py b/y.py\nnew file mode 100644\n--- /dev/null\n+++ b/y.py\n@@ -0,0 +1,2 @@\n+l1\n+l2\n"
    ),
    "deleted": "diff --git a/d.go b/d.go\ndeleted file mode 100644\n--- a/d.go\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-l1\n-l2",
    "renamed": "diff --git a/o.rs b/n.rs\nsimilarity index 100%\nrename from o.rs\nrename to n.rs\n",
    "renamed_changed": "diff --git a/o.rs b/n.rs\nrename from o.rs\nrename to n.rs\n@@ -1 +1 @@\n-a\n+b\n",
    "binary": "diff --git a/i.png b/i.png\nindex 1..2\nBinary files a/i.png and b/i.png differ\n@@ -1 +1 @@\n+x\n",
    "headerless": "--- a/p.ts\n+++ b/p.ts\n@@ -1,1 +1,1 @@\n-a\n+b\n--- a/q.ts\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-a\n",
    "added_headerless": "--- /dev/null\n+++ b/new.ts\n@@ -0,0 +1 @@\n+a\n",
    "prose": "just prose\nno diff",
    "blank": "  \n ",
    "crlf": "diff --git a/x b/x\r\n@@ -1 +1 @@\r\n+a\r\n",
    "truncated": "diff --git a/tr.ts b/tr.ts\nindex 1",
    "bad_hunk": "diff --git a/z b/z\n@@ nonsense\n+x\n@@ -3 +4 @@\n+y\n",
    "prefixed": "junk\ndiff --git a/b/win\\path.js b/b/win\\path.js\n@@ -1 +1 @@\n+x\n",
    "gone_bare": "diff --git a/e.txt b/e.txt\ndeleted file mode 100644\n",
}


@pytest.fixture(scope="module")
def files(spark):
    table = spark.createDataFrame([*DIFFS.items(), ("null", None)], "diff string, raw string")
    return diffs.diff_files(table).cache()


def test_files(files):
    got = rows(files, "diff", "file_idx", "path", "previous_path", "kind", "is_binary", "additions", "deletions", F.size("hunks"))
    assert got == sorted(
        [
            ("two", 0, "src/x.ts", None, "MODIFIED", False, 3, 2, 2),
            ("two", 1, "y.py", None, "ADDED", False, 2, 0, 1),
            ("deleted", 0, "d.go", None, "DELETED", False, 0, 2, 1),
            ("renamed", 0, "n.rs", "o.rs", "RENAMED", False, 0, 0, 0),
            ("renamed_changed", 0, "n.rs", "o.rs", "RENAMED", False, 1, 1, 1),
            ("binary", 0, "i.png", None, "MODIFIED", True, 0, 0, 0),
            ("headerless", 0, "p.ts", None, "MODIFIED", False, 1, 1, 1),
            ("headerless", 1, "q.ts", None, "MODIFIED", False, 0, 1, 1),
            ("added_headerless", 0, "new.ts", None, "MODIFIED", False, 1, 0, 1),
            ("truncated", 0, "tr.ts", None, "MODIFIED", False, 0, 0, 0),
            ("bad_hunk", 0, "z", None, "MODIFIED", False, 1, 0, 1),
            ("prefixed", 0, "win/path.js", None, "MODIFIED", False, 1, 0, 1),
            ("gone_bare", 0, "e.txt", None, "DELETED", False, 0, 0, 0),
        ],
        key=str,
    )


def test_patches_end_with_a_line_break(files):
    patches = {(r.diff, r.file_idx): r.patch for r in files.collect()}
    assert patches[("binary", 0)] is None
    assert patches[("truncated", 0)] == DIFFS["truncated"] + "\n"
    assert patches[("headerless", 1)].startswith("diff --git a/q.ts b/q.ts\n--- a/q.ts\n")
    assert all(p.endswith("\n") for k, p in patches.items() if p)


def test_hunks(files):
    got = rows(diffs.diff_hunks(files, "diff").filter("diff = 'two'").drop("added", "removed", "raw_hunk"))
    assert got == [
        ("two", "src/x.ts", 0, 1, 2, 1, 3, "fn()"),
        ("two", "src/x.ts", 1, 10, 1, 11, 1, ""),
        ("two", "y.py", 0, 0, 0, 1, 2, ""),
    ]


def test_unreadable_line_numbers_do_not_fail(spark):
    raw = "diff --git a/x b/x\n@@ -1 +" + "9" * 30 + " @@\n+a\n"
    files = diffs.diff_files(spark.createDataFrame([("d", raw)], "diff string, raw string"))
    assert rows(evidence.from_diffs(files, "diff"), "line_start", "snippet") == [(None, "+a")]


def test_lines(files):
    got = rows(diffs.diff_lines(files, "diff").filter("diff = 'two' and hunk_idx = 0 and path = 'src/x.ts'"), "change", "line_idx", "line")
    assert got == [("added", 0, "+new"), ("added", 1, "+more"), ("removed", 0, "-old")]


def test_evidence_rows(files):
    found = evidence.from_diffs(files, "diff").collect()
    per_file = {}
    for r in found:
        per_file.setdefault((r.diff, r.file_path), []).append(r)
    first = per_file[("two", "src/x.ts")][0]
    assert (first.line_start, first.line_end, first.snippet) == (1, 3, "+new\n+more\n-old")
    assert first.metadata == {"changeKind": "MODIFIED", "hunkIndex": "0", "additions": "2", "deletions": "1", "contextLabel": "fn()"}
    gone = per_file[("deleted", "d.go")][0]
    assert (gone.line_start, gone.line_end) == (None, None)
    assert per_file[("renamed", "n.rs")][0].metadata == {"changeKind": "RENAMED", "previousPath": "o.rs"}
    assert per_file[("binary", "i.png")][0].metadata == {"changeKind": "MODIFIED", "isBinary": "true"}
    assert per_file[("gone_bare", "e.txt")][0].metadata == {"changeKind": "DELETED", "additions": "0", "deletions": "0"}
    assert ("truncated", "tr.ts") not in per_file


def test_snippet_has_all_changed_lines(spark):
    raw = "diff --git a/x b/x\n@@ -1,9 +1,9 @@\n" + "".join(f"+a{i}\n" for i in range(4)) + "-r0\n-r1\n"
    files = diffs.diff_files(spark.createDataFrame([("d", raw)], "diff string, raw string"))
    assert rows(evidence.from_diffs(files, "diff"), "snippet") == [("+a0\n+a1\n+a2\n+a3\n-r0\n-r1",)]


def test_evidence_of_changed_files(spark):
    table = spark.createDataFrame(
        [
            ("s", 0, "b", "a.ts", "MODIFIED", None, DIFFS["two"]),
            ("s", 1, "b", "i.png", "ADDED", None, None),
            ("s", 2, "b", "new.ts", "RENAMED", "old.ts", ""),
            ("s", 3, "b", "bad.ts", "MODIFIED", None, "garbage"),
        ],
        "session_id string, seq int, branch_name string, path string, kind string, previous_path string, patch string",
    )
    got = {}
    for r in evidence.from_changed_files(table).collect():
        got.setdefault(r.seq, []).append((r.file_path, r.metadata))
    assert [p for p, _ in got[0]] == ["src/x.ts", "src/x.ts"]
    assert got[1] == [("i.png", {"changeKind": "ADDED"})]
    assert got[2] == [("new.ts", {"changeKind": "RENAMED", "previousPath": "old.ts"})]
    assert got[3] == [("bad.ts", {"changeKind": "MODIFIED", "parseError": "unparseable-patch"})]
    assert evidence.comparison_snippets(table).count() == 2


def test_comparison_snippets_read_each_hunk_header_once(spark):
    raws = spark.range(2).selectExpr("id AS session_id", "id AS diff_id", "'b' AS branch_name", "concat('@@', id) AS raw")
    files = diffs.changed_files(raws).withColumn("seq", F.struct("diff_id", "file_idx"))
    plan = evidence.comparison_snippets(files)._jdf.queryExecution().optimizedPlan().toString()
    # Kept pieces, matched text and its groups: no filter spells the reading out again.
    assert plan.count(diffs.HUNK_HEADER) == 3


def test_hunk_headers_keep_their_numbers_and_labels(spark):
    head = "diff --git a/z b/z\n"
    hunks = ["@@ -1 +2 @@", "@@ -3,4 +5,6 @@ fn() @@ more", f"@@ -{'9' * 30},0 +0,0 @@\r tail"]
    raw = head + "".join(h + "\n+x\n" for h in hunks)
    read = diffs.diff_files(spark.createDataFrame([(1, raw)], "diff_id int, raw string")).first().hunks
    shown = [(h.base_start, h.base_count, h.head_start, h.head_count, h.context_label) for h in read]
    assert shown == [(1, 1, 2, 1, ""), (3, 4, 5, 6, "fn() @@ more"), (None, 0, 0, 0, "")]


def test_pieces_of_split_diffs_are_cut_once(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(diffs, "stage", lambda df, name: staged.append(name) or df)
    records = spark.createDataFrame(
        [("d", "b", 0, 0, "junk"), ("d", "b", 0, 1, "a/x b/x\n+x")],
        "diff_id string, branch_name string, block bigint, at bigint, value string",
    )
    pieces = diffs.file_pieces(records)
    assert staged == ["diff-pieces"]
    assert [r.chunk for r in pieces.collect()] == ["diff --git a/x b/x\n+x"]


@pytest.mark.parametrize(
    "path,language",
    [
        ("a.ts", "typescript"), ("a.TSX", "typescript"), ("a.mjs", "javascript"), ("a.py", "python"),
        ("a.rb", "ruby"), ("a.go", "go"), ("a.rs", "rust"), ("A.java", "java"), ("a.kt", "kotlin"),
        ("a.cs", "csharp"), ("a.hpp", "cpp"), ("a.sql", "sql"), ("a.yml", "yaml"), ("a.json", "json"),
        ("a.toml", "toml"), ("README.md", "markdown"), ("a.scss", "css"), ("a.htm", "html"),
        ("a.sh", "shell"), ("Dockerfile", "dockerfile"), ("a.tf", "terraform"), ("a.proto", "protobuf"),
        ("LICENSE", None), ("a.xyz", None),
    ],
)
def test_languages(spark, path, language):
    assert spark.range(1).select(diffs.language(F.lit(path))).first()[0] == language
