"""Unified diff texts -> changed files -> hunks -> lines.

A diff is one text row; everything here is read out of that row with array
functions, so shredding needs no shuffle and scales with the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.normal import word_map
from claimgrid.functions.text import is_blank, pattern, trim
from claimgrid.session import stage

LINE_START = r"(?:\A|(?<=[\n\r\x{2028}\x{2029}]))"
FILE_HEADER = pattern(fixed.FILE_HEADER)
HUNK_HEADER = pattern(fixed.HUNK_HEADER)
BINARY = r"(?:\A|\n)" + pattern(fixed.BINARY_LINE)[1:-2] + r"(?=\n|\z)"

# What begins a file of a diff.
DIFF_MARK = "diff --git "

HUNK_TYPE = (
    "array<struct<hunk_idx:int,base_start:bigint,base_count:bigint,head_start:bigint,head_count:bigint,"
    "context_label:string,raw_hunk:string,added:array<string>,removed:array<string>>>"
)


def normal_path(path: Column) -> Column:
    return F.translate(F.regexp_replace(path, "^[ab]/", ""), "\\", "/")


def language(path: Column) -> Column:
    """Language of the file extension, null if it is not a known one."""
    names = word_map({ext: name for name, exts in fixed.LANGUAGES.items() for ext in exts})
    return F.try_element_at(names, F.lower(F.substring_index(path, ".", -1)))


def _first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _marker_paths(chunk: Column) -> Column:
    """A chunk with the texts behind its ``---`` and ``+++`` markers."""
    to_line = F.regexp_extract(chunk, r"(?:\A|\n)(\+\+\+ [^\n]*)", 1)
    return F.struct(
        chunk.alias("chunk"),
        trim(F.regexp_extract(_first_line(chunk), pattern(r"^--- (?:a/)?(.+)$"), 1)).alias("old"),
        trim(F.regexp_extract(to_line, pattern(r"^\+\+\+ (?:b/)?(.+)$"), 1)).alias("new"),
    )


def _with_header(marked: Column) -> Column:
    """A header-less chunk with the header its markers imply, null without paths."""
    old, new = (F.when((marked[p] != "") & (marked[p] != "/dev/null"), marked[p]) for p in ("old", "new"))
    return F.concat(
        F.lit("diff --git a/"), F.coalesce(old, new), F.lit(" b/"), F.coalesce(new, old),
        F.lit("\n"), marked["chunk"],
    )


def file_chunks(raw: Column) -> Column:
    """Chunks with a readable header; the marker fallback applies if there is none.

    Array functions with lambdas are interpreted and share no common parts, here and
    below: what is used twice is made in a step of its own and named by the next one.
    """
    none = F.array().cast("array<string>")
    chosen = F.transform(F.array(_headed(raw)), lambda headed: F.when(F.size(headed) > 0, headed).otherwise(_marked(raw)))
    return F.when(is_blank(raw), none).otherwise(chosen[0])


def _readable(chunk: Column) -> Column:
    return F.rlike(_first_line(chunk), F.lit(FILE_HEADER))


def _headed(raw: Column) -> Column:
    return F.filter(F.split(raw, LINE_START + f"(?={DIFF_MARK})"), _readable)


def _marked(raw: Column) -> Column:
    return F.filter(
        F.transform(F.transform(F.split(raw, LINE_START + "(?=--- [^ ])"), _marker_paths), _with_header),
        lambda c: c.isNotNull() & _readable(c),
    )


def file_pieces(records: DataFrame) -> DataFrame:
    """File chunks of diffs that a scan has cut before each ``diff --git`` line.

    ``records(diff_id, block, at, value, ...)``: ``(block, at)`` orders the records of a
    diff, and the scan has taken away the line break and the mark that it cut at. They
    are put back by knowing a diff's first and last record, which are looked up by
    their place, so the records of one diff stay spread. Line starts that the scan
    doesn't know are cut inside the record. Chunks without a header, found by their
    markers, only count in a diff that has no header at all; this is decided on the
    few such chunks.
    """
    ends = records.groupBy("diff_id", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    edges = ends.groupBy("diff_id").agg(
        F.min("block").alias("low"), F.min_by("first", "block").alias("first"),
        F.max("block").alias("high"), F.max_by("last", "block").alias("last"),
    )
    marks = edges.select("diff_id", F.inline(F.expr(
        "array(named_struct('block', low, 'at', first, 'is_first', true, 'is_last', false), "
        "named_struct('block', high, 'at', last, 'is_first', false, 'is_last', true))"
    ))).groupBy("diff_id", "block", "at").agg(F.max("is_first").alias("is_first"), F.max("is_last").alias("is_last"))
    whole = F.concat(
        F.when(F.col("is_first"), "").otherwise(DIFF_MARK), "value", F.when(F.col("is_last"), "").otherwise("\n")
    )
    keep = [c for c in records.columns if c not in ("block", "at", "value")]
    texts = records.join(marks, ["diff_id", "block", "at"], "left").select(*keep, "block", "at", whole.alias("text"))
    found = texts.withColumn("headed", _headed(F.col("text")))
    with_header = F.size("headed") > 0
    pieces = F.when(with_header, F.col("headed")).otherwise(_marked(F.col("text")))
    cut = found.select(*keep, "block", "at", with_header.alias("with_header"), F.posexplode(pieces).alias("piece", "chunk"))
    # Read three times, so the records are joined and cut once.
    cut = stage(cut.select(*keep, F.struct("block", "at", "piece").alias("place"), "with_header", "chunk"), "diff-pieces")
    plain = cut.filter(~F.col("with_header")).join(cut.filter("with_header").select("diff_id").distinct(), "diff_id", "left_anti")
    return cut.filter("with_header").unionByName(plain).drop("with_header")


# Length of a slice that takes the rest of an array. Well below the integer limit,
# because start and length are added.
REST = 2**30


# Stands between the groups of a hunk header; a noncharacter, which no text holds.
GROUP_MARK = "\ufdd0"


def _lines_of(piece: Column) -> Column:
    return F.struct(piece.alias("raw"), F.split(piece, "\n").alias("lines"))


def _headers_of(piece: Column) -> Column:
    """The lines of a hunk and the groups of its header, read in one pass over the matched text."""
    whole = F.regexp_extract(piece["lines"][0], HUNK_HEADER, 0)
    listed = GROUP_MARK.join(f"${n}" for n in range(1, 6))
    groups = F.split(F.regexp_replace(whole, F.lit(HUNK_HEADER), F.lit(listed)), GROUP_MARK, -1)
    return F.struct(piece["raw"].alias("raw"), F.slice(piece["lines"], 2, REST).alias("body"), groups.alias("groups"))


def _hunk(piece: Column, index: Column) -> Column:
    body = piece["body"]

    def number(group: int) -> Column:
        found = piece["groups"][group - 1]
        # A number too long to read becomes null rather than failing the job.
        return F.when(found == "", F.lit(1).cast("bigint")).otherwise(found.try_cast("bigint"))

    return F.struct(
        index.cast("int").alias("hunk_idx"),
        number(1).alias("base_start"),
        number(2).alias("base_count"),
        number(3).alias("head_start"),
        number(4).alias("head_count"),
        trim(piece["groups"][4]).alias("context_label"),
        piece["raw"].alias("raw_hunk"),
        F.filter(body, lambda line: F.startswith(line, F.lit("+"))).alias("added"),
        F.filter(body, lambda line: F.startswith(line, F.lit("-"))).alias("removed"),
    )


def _hunks(pieces: Column) -> Column:
    """Hunks among the pieces of a chunk, a column that is made before."""
    # A hunk that another one follows does not own the line break between them.
    owned = F.transform(
        pieces,
        lambda p, i: F.when(i < F.size(pieces) - 1, F.regexp_replace(p, r"\n\z", "")).otherwise(p),
    )
    headed = F.filter(owned, lambda p: F.rlike(p, F.lit(HUNK_HEADER)))
    return F.transform(F.transform(F.transform(headed, _lines_of), _headers_of), _hunk)


def parse_chunk(chunks: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Add path, kind, counts and hunks of the file each chunk describes."""
    text = F.col(chunk)
    header = _first_line(text)
    before_hunks = F.substring_index(text, "\n@@", 1)
    meta = F.col("meta_lines")
    kinds = {"new file mode": "ADDED", "deleted file mode": "DELETED", "rename to ": "RENAMED"}

    def last(*starts: str) -> Column:
        found = F.filter(meta, lambda line: F.rlike(line, F.lit(f"^(?:{'|'.join(starts)})")))
        return F.try_element_at(found, F.lit(-1))

    def renamed(line: Column, marker: str) -> Column:
        return normal_path(trim(F.substring(line, len(marker) + 1, F.length(line))))

    kind = F.lit("MODIFIED")
    for start, name in kinds.items():
        kind = F.when(F.startswith(F.col("kind_line"), F.lit(start)), name).otherwise(kind)
    moved = F.col("path_line")
    parsed = (
        chunks.withColumn("is_binary", F.rlike(before_hunks, F.lit(BINARY)))
        .withColumn(
            "meta_lines",
            # Reading stops at the first binary line; line 0 is the header.
            F.slice(F.split(F.regexp_replace(before_hunks, f"(?s){BINARY}.*", ""), "\n"), 2, REST),
        )
        .withColumn("hunk_pieces", F.split(text, r"(?<=\n)(?=@@)"))
        .withColumns(
            {
                "kind_line": last(*kinds),
                "path_line": last("deleted file mode", "rename to "),
                "from_line": last("rename from "),
                "hunks": F.when(F.col("is_binary"), F.array().cast(HUNK_TYPE)).otherwise(_hunks(F.col("hunk_pieces"))),
            }
        )
    )
    path_a = normal_path(F.regexp_extract(header, FILE_HEADER, 1))
    path_b = normal_path(F.regexp_extract(header, FILE_HEADER, 2))

    def total(field: str) -> Column:
        return F.aggregate(
            "hunks", F.lit(0), lambda n, hunk: (n + F.size(hunk[field])).cast("int")
        )

    return parsed.withColumns(
        {
            "path": F.when(moved.isNull(), path_b)
            .when(F.startswith(moved, F.lit("deleted")), path_a)
            .otherwise(renamed(moved, "rename to ")),
            "previous_path": renamed(F.col("from_line"), "rename from "),
            "kind": kind,
            "patch": F.when(
                ~F.col("is_binary"),
                F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n"))),
            ),
            "additions": total("added"),
            "deletions": total("removed"),
        }
    ).drop("meta_lines", "kind_line", "path_line", "from_line", "hunk_pieces")


def diff_files(diffs: DataFrame, raw: str = "raw") -> DataFrame:
    """Files of each diff row, in diff order, with their hunks as an array."""
    keep = [c for c in diffs.columns if c != raw]
    chunks = diffs.select(
        *keep, F.posexplode_outer(file_chunks(F.col(raw))).alias("file_idx", "chunk")
    ).filter(F.col("chunk").isNotNull())
    return parse_chunk(chunks).drop("chunk")


def changed_of_pieces(pieces: DataFrame) -> DataFrame:
    """Changed-file rows of chunks read by ``tables.read_split_diffs``, in the order of ``place``."""
    keep = [c for c in pieces.columns if c != "chunk"]
    return parse_chunk(pieces).select(
        *keep, "path", "previous_path", "kind", "patch", "additions", "deletions", language(F.col("path")).alias("language")
    )


def diff_hunks(files: DataFrame, *keep: str) -> DataFrame:
    return files.select(*keep, "path", F.inline("hunks"))


def diff_lines(files: DataFrame, *keep: str) -> DataFrame:
    """Changed lines of every hunk, added before removed, with their marks."""

    def marked(field: str) -> Column:
        return F.transform(
            field,
            lambda line, i: F.struct(
                F.lit(field).alias("change"), i.alias("line_idx"), line.alias("line")
            ),
        )

    lines = F.concat(marked("added"), marked("removed"))
    return diff_hunks(files, *keep).select(*keep, "path", "hunk_idx", F.inline(lines))


def changed_files(diffs: DataFrame, raw: str = "raw") -> DataFrame:
    """Changed-file rows of each diff, attributed to the diff's branch."""
    keep = [c for c in diffs.columns if c != raw]
    return diff_files(diffs, raw).select(
        *keep, "file_idx", "path", "previous_path", "kind", "patch", "additions", "deletions",
        language(F.col("path")).alias("language"),
    )
