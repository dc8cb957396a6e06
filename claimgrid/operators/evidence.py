"""Code evidence rows from shredded diffs and from changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.operators.diffs import file_chunks, parse_chunk


def _metadata(entries: dict[str, Column]) -> Column:
    """Map without the entries that are null or empty."""
    pairs = F.array(
        *(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in entries.items())
    )
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"] != ""))


def _evidence(start: Column, end: Column, snippet: Column, metadata: Column) -> Column:
    return F.struct(
        start.cast("bigint").alias("line_start"),
        end.cast("bigint").alias("line_end"),
        snippet.cast("string").alias("snippet"),
        metadata.alias("metadata"),
    )


def _whole_file(metadata: Column) -> Column:
    none = F.lit(None)
    return F.array(_evidence(none, none, none, metadata))


def hunk_range(hunk: Column) -> tuple[Column, Column]:
    start = F.when(hunk["head_start"] > 0, hunk["head_start"])
    end = F.when(hunk["head_count"] > 0, start + hunk["head_count"] - 1).otherwise(start)
    return start, end


def hunk_snippet(hunk: Column) -> Column:
    """Changed lines, added before removed; null if there are none."""
    lines = F.concat(hunk["added"], hunk["removed"])
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def _hunk_evidence(hunk: Column) -> Column:
    metadata = _metadata(
        {
            "changeKind": F.col("kind"),
            "hunkIndex": hunk["hunk_idx"],
            "additions": F.size(hunk["added"]),
            "deletions": F.size(hunk["removed"]),
            "contextLabel": hunk["context_label"],
            "previousPath": F.col("previous_path"),
        }
    )
    return _evidence(*hunk_range(hunk), hunk_snippet(hunk), metadata)


def _file_evidence() -> Column:
    """Evidence of one parsed file; a changed file without hunks gives none."""
    kind = F.col("kind")
    bare = F.size("hunks") == 0
    # The previous path of a bare rename is listed even when it is empty.
    rename = F.create_map(
        F.lit("changeKind"), F.lit("RENAMED"),
        F.lit("previousPath"), F.coalesce("previous_path", F.lit("")),
    )
    return (
        F.when(
            F.col("is_binary"), _whole_file(_metadata({"changeKind": kind, "isBinary": F.lit("true")}))
        )
        .when((kind == "RENAMED") & bare, _whole_file(rename))
        .when(
            (kind == "DELETED") & bare,
            _whole_file(
                _metadata({"changeKind": kind, "additions": F.lit("0"), "deletions": F.col("deletions")})
            ),
        )
        .otherwise(F.transform("hunks", _hunk_evidence))
    )


def from_diffs(files: DataFrame, *keep: str) -> DataFrame:
    """Evidence of all files of all diffs, in file and hunk order."""
    rows = files.select(
        *keep, F.col("path").alias("file_path"),
        F.posexplode(_file_evidence()).alias("evidence_idx", "e"),
    )
    return rows.select(*keep, F.lit("FILE_CHANGE").alias("source"), "file_path", "evidence_idx", "e.*")


def _first_chunk(files: DataFrame) -> DataFrame:
    """Changed files with their patch read again; only its first file counts."""
    renamed = files.select(
        "session_id", "seq", "branch_name",
        F.col("path").alias("file_path"), F.col("kind").alias("file_kind"),
        F.col("previous_path").alias("file_previous"),
        F.nullif(F.col("patch"), F.lit("")).alias("file_patch"),
    )
    # An outer generator keeps filters on the chunk from being pushed into its making, where
    # Catalyst would write out, and evaluate, the whole reading several times a file.
    first = F.slice(file_chunks(F.col("file_patch")), 1, 1)
    return parse_chunk(renamed.select("*", F.explode_outer(first).alias("chunk")))


def from_changed_files(files: DataFrame) -> DataFrame:
    """Evidence of changed files: opaque without a patch, marked if unreadable."""
    opaque = _whole_file(
        _metadata({"changeKind": F.col("file_kind"), "previousPath": F.col("file_previous")})
    )
    unreadable = _whole_file(
        _metadata({"changeKind": F.col("file_kind"), "parseError": F.lit("unparseable-patch")})
    )
    evidence = (
        F.when(F.col("file_patch").isNull(), opaque)
        .when(F.col("chunk").isNull(), unreadable)
        .otherwise(_file_evidence())
    )
    rows = _first_chunk(files)
    parsed_path = F.when(F.col("file_patch").isNotNull(), F.col("path"))
    return rows.select(
        "session_id", "seq", "branch_name", F.lit("FILE_CHANGE").alias("source"),
        F.coalesce(parsed_path, F.col("file_path")).alias("file_path"),
        F.posexplode(evidence).alias("evidence_idx", "e"),
    ).select("session_id", "seq", "branch_name", "source", "file_path", "evidence_idx", "e.*")


def comparison_snippets(files: DataFrame, origin: str = "GIT_DIFF") -> DataFrame:
    """Line range and snippet of every hunk of a comparison's files."""
    rows = _first_chunk(files).filter(F.col("chunk").isNotNull())
    hunk = F.col("hunk")
    start, end = hunk_range(hunk)
    # Outer, because the inner generator makes Catalyst infer a filter that reads all hunks again.
    hunks = rows.select("session_id", "seq", "branch_name", "path", F.explode_outer("hunks").alias("hunk"))
    return hunks.filter(hunk.isNotNull()).select(
        "session_id", "seq", "branch_name", F.col("path").alias("file_path"),
        hunk["hunk_idx"].alias("hunk_idx"),
        start.alias("line_start"), end.alias("line_end"), hunk_snippet(hunk).alias("snippet"),
        F.lit(origin).alias("source"),
    )
