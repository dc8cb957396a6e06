"""Readers and writers of the input and result tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrid.operators.diffs import DIFF_MARK, file_pieces
from claimgrid.operators.files import of_branch
from claimgrid.session import stage

FILES = "array<struct<path:string,content:string>>"
SCENARIO = (
    "id string, title string, original_requirement string, conflict_category string, "
    f"base_files {FILES}, "
    f"branches array<struct<name:string,changed_files:{FILES},patch:string>>, "
    "expected_contradiction string, expected_affected_files array<string>, "
    "expected_affected_components array<string>"
)


def read_diff_texts(spark: SparkSession, path: str, branch: str | None = None) -> DataFrame:
    """Exported diff texts, one file per row, for files that are small.

    The branch is the given one, or the file name without its extension.
    """
    texts = spark.read.text(path, wholetext=True)
    return texts.select(*_file_columns(branch), F.col("value").alias("raw"))


def _file_columns(branch: str | None) -> list[Column]:
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return [F.col("_metadata.file_path").alias("diff_id"), (F.lit(branch) if branch else name).alias("branch_name")]


def read_split_diffs(spark: SparkSession, path: str, branch: str | None = None) -> DataFrame:
    """The file chunks of exported diff texts, read by as many tasks as the files have splits.

    The scan ends a record before each line that begins a file of the diff, and any
    task can find such a line from the middle of a diff, so a large file is one scan
    split after the other instead of one row. ``place`` orders the chunks of a diff:
    start of the split, record in the split, piece of the record. Chunks are those of
    ``read_diff_texts`` with ``diffs.diff_files``. (diff_id, branch_name, place, chunk)
    """
    texts = spark.read.option("lineSep", f"\n{DIFF_MARK}").text(path)
    records = texts.select(
        *_file_columns(branch), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    return file_pieces(stage(records, "diff-records"))


def read_changed_files(spark: SparkSession, path: str, branch: str | None = None) -> DataFrame:
    """A table of changed files; the branch filter reaches the parquet scan."""
    files = spark.read.parquet(path)
    return files if branch is None else of_branch(files, branch)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENARIO).json(path)


def scenario_diffs(scenarios: DataFrame) -> DataFrame:
    """Raw diff rows of scenarios, branch by branch."""
    rows = scenarios.select(
        F.col("id").alias("session_id"), F.posexplode("branches").alias("diff_id", "branch")
    )
    return rows.select(
        "session_id", "diff_id", F.col("branch.name").alias("branch_name"),
        F.col("branch.patch").alias("raw"),
    )


def repositories(rows: DataFrame) -> DataFrame:
    """Repository rows with the default provider; a row without branches fails."""
    none = F.coalesce(F.size("feature_branches") <= 0, F.lit(True))
    message = F.lit("at least one feature branch name is required")
    checked = F.when(none, F.raise_error(message).cast("array<string>")).otherwise(
        F.col("feature_branches")
    )
    return rows.withColumns(
        {"feature_branches": checked, "provider": F.coalesce("provider", F.lit("local"))}
    )


SECRET_COLUMNS = ["agent_key"]


def public_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text that reads back to the same row, secrets left out."""
    shown = [c for c in rows.columns if c not in SECRET_COLUMNS]
    value: Column = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    return rows.select("session_id", value.alias(name))


def write_table(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    shown = [c for c in rows.columns if c not in SECRET_COLUMNS]
    rows.select(*shown).write.mode(mode).format(fmt).save(path)


def write_texts(texts: DataFrame, path: str, column: str = "text", mode: str = "errorifexists") -> None:
    texts.select(column).write.mode(mode).text(path)


CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Nested JSON records of one text line each, checked against ``schema``: the good ones, and the corrupt texts.

    A line that is no JSON or that has a value of another type anywhere is corrupt; it
    is reported whole with its file and never read in part. Unknown members are ignored
    and missing ones are null.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    typed = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.withColumn("r", F.from_json("value", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.filter(~bad).select("r.*").drop(CORRUPT), parsed.filter(bad).select("file", "value")


def commit_records(rows: DataFrame, root: str, commit_id: str) -> bool:
    """Write ``rows`` as JSON records under ``root`` as one commit; False if that commit is there already.

    Files go to a folder of this attempt, and the manifest entry that names the folder
    is created last and never replaced. So readers see all of a commit or nothing, a
    repeated commit changes nothing, and an attempt that was lost leaves a folder that
    no manifest names.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", commit_id):
        raise ValueError(f"not a commit id: {commit_id!r}")
    spark = rows.sparkSession
    entry = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest/{commit_id}")
    system = entry.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if system.exists(entry):
        return False
    folder = f"part-{uuid.uuid4().hex}"
    shown = [c for c in rows.columns if c not in SECRET_COLUMNS]
    rows.select(*shown).write.option("ignoreNullFields", "false").json(f"{root}/{folder}")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest/_{folder}")
    out = system.create(draft, True)
    out.write(bytearray(folder.encode()))
    out.close()
    # Local and HDFS renames don't replace a file; who comes second keeps nothing.
    done = not system.exists(entry) and system.rename(draft, entry)
    if not done:
        system.delete(draft, True)
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}"), True)
    return done


def committed(spark: SparkSession, root: str) -> list[str]:
    """Folders of all commits under ``root``, by the manifest."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(place):
        return []
    entries = [e.getPath() for e in system.listStatus(place) if not e.getPath().getName().startswith(("_", "."))]
    folders = []
    for entry in sorted(entries, key=lambda e: e.getName()):
        stream = system.open(entry)
        folders.append(f"{root}/{bytes(stream.readAllBytes()).decode()}")
        stream.close()
    return folders
