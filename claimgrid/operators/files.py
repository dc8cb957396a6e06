"""Changed-file tables: attribution, dedupe, sizes and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.text import is_blank


def of_branch(files: DataFrame, branch: str | Column) -> DataFrame:
    return files.filter(F.col("branch_name") == branch)


def check_branches(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``wanted`` rows, failing the job at the first branch that is not known.

    The outer join keeps one row per wanted branch, so the check runs with the
    rows it guards and needs no separate action.
    """
    marked = wanted.join(
        known.select("session_id", "branch_name", F.lit(True).alias("is_known")).distinct(),
        ["session_id", "branch_name"],
        "left",
    )
    message = F.concat(F.lit("unknown branch: "), "branch_name")
    checked = F.when(F.col("is_known"), F.col("branch_name")).otherwise(F.raise_error(message).cast("string"))
    return marked.withColumn("branch_name", checked).drop("is_known")


def dedupe(files: DataFrame) -> DataFrame:
    """Per session, branch and path the last row by ``seq``, at the first row's place."""
    key = ["session_id", "branch_name", "path"]
    rest = [c for c in files.columns if c not in (*key, "seq")]
    latest = files.groupBy(*key).agg(
        F.max_by(F.struct(*rest), "seq").alias("latest"), F.min("seq").alias("seq")
    )
    return latest.select(*key, "seq", "latest.*")


def by_head(heads: DataFrame, files: DataFrame) -> DataFrame:
    """Compared heads with file and byte counts; heads without files stay."""
    per_head = files.groupBy("session_id", "branch_name").agg(
        F.count("*").alias("n_files"),
        F.sum(F.octet_length("patch")).alias("patch_bytes"),
    )
    return (
        heads.select("session_id", "branch_name")
        .join(per_head, ["session_id", "branch_name"], "left")
        .fillna(0, ["n_files", "patch_bytes"])
    )


def patch_warnings(files: DataFrame) -> DataFrame:
    missing = files.filter(F.coalesce(F.col("patch"), F.lit("")) == "")
    return missing.select(
        "session_id",
        F.lit("BINARY_OR_EMPTY_PATCH").alias("code"),
        F.concat(
            "path", F.lit(" on "), "branch_name",
            F.lit(" has no textual patch — excluded from semantic input"),
        ).alias("message"),
    )


def with_text(files: DataFrame) -> DataFrame:
    return files.filter(~is_blank(F.col("patch")))


def forwarded(files: DataFrame) -> DataFrame:
    """Files that have text, whole. Their ``seq`` is their order; nothing is ranked."""
    return with_text(files).withColumn("content", F.col("patch"))


def change_content(heads: DataFrame, forwarded: DataFrame, word: str = "for") -> DataFrame:
    """Single-feed rule: files carry the payload, the change itself stays inert."""
    fed = forwarded.select("session_id", "branch_name").distinct().withColumn("fed", F.lit(True))
    joined = heads.join(fed, ["session_id", "branch_name"], "left")
    return joined.withColumn(
        "content",
        F.when(F.col("fed"), fixed.NOT_KNOWN).otherwise(
            F.concat(F.lit(f"No textual differences {word} "), "branch_name", F.lit("."))
        ),
    ).drop("fed")


def sizes(files: DataFrame) -> DataFrame:
    """Per session: file count and patch bytes. No size is refused."""
    return files.groupBy("session_id").agg(
        F.count("*").alias("n_files"),
        F.sum(F.octet_length(F.coalesce(F.col("patch"), F.lit("")))).alias("diff_bytes"),
    )


def head_files(heads: DataFrame, files: DataFrame) -> DataFrame:
    """The files of every compared head, one row each."""
    return heads.select("session_id", "branch_name").join(files, ["session_id", "branch_name"])


def changed_paths(files: DataFrame) -> DataFrame:
    return files.select("session_id", "path").distinct()


def files_changed(files: DataFrame) -> DataFrame:
    """Distinct changed paths per session, counted over already distinct rows."""
    return changed_paths(files).groupBy("session_id").agg(F.count("*").alias("files_changed"))


def branch_by_file(files: DataFrame) -> DataFrame:
    """The branch that touched a path first."""
    return files.groupBy("session_id", "path").agg(
        F.min_by("branch_name", "seq").alias("branch_name")
    )


def ordered_branches(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Branches with files: declared ones in declared order, then the others by
    first appearance. The order is carried as the key ``(declared_seq, first_seq)``."""
    present = files.groupBy("session_id", "branch_name").agg(F.min("seq").alias("first_seq"))
    return present.join(
        declared.select("session_id", "branch_name", "declared_seq"),
        ["session_id", "branch_name"],
        "left",
    )
