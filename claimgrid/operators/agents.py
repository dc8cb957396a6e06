"""Claims in analyser responses: JSON text rows -> claims, rejects and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.text import BLANK, nonblank, trim

FENCED = rf"(?s)^```(?:json)?{BLANK}*(.*?){BLANK}*```\z"
NUMBER = "^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def strip_fences(text: Column) -> Column:
    trimmed = trim(text)
    inner = trim(F.regexp_extract(trimmed, FENCED, 1))
    return F.when(F.rlike(trimmed, F.lit(FENCED)), inner).otherwise(trimmed)


def text_parts(texts: DataFrame, *keep: str, text: str = "text", size: int = fixed.AGENT_PART_CHARS) -> DataFrame:
    """Texts for an analyser in parts of at most ``size`` characters; nothing is left out."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    rows = texts.select(*keep, text, F.posexplode(starts).alias("part", "start"))
    return rows.select(*keep, "part", F.substring(F.col(text), F.col("start"), F.lit(size)).alias("content"))


def derive_concept(statement: Column) -> Column:
    dashed = F.btrim(F.regexp_replace(F.lower(statement), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.nullif(dashed, F.lit(""))


def confidence_label(numeric: Column) -> Column:
    return F.when(numeric >= 0.9, "HIGH").when(numeric >= 0.6, "MEDIUM").otherwise("LOW")


def parse_json(text: Column) -> Column:
    """The text as one JSON value, null if it is anything else.

    Parsing stops after the first value, so the text is read as the first entry
    of a closed list: whatever follows it would break or lengthen that list.
    """
    closed = F.concat(F.lit("["), text, F.lit(',"end"]'))
    entries = F.try_variant_get(F.try_parse_json(closed), "$", "array<variant>")
    return F.when(F.size(entries) == 2, F.try_element_at(entries, F.lit(1)))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _member(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def _string(item: Column, name: str) -> Column:
    """A member that is a JSON string, trimmed; null if blank or something else."""
    text = F.try_variant_get(item, f"$.{name}", "string")
    return F.when(_kind(_member(item, name)) == "STRING", nonblank(trim(text)))


def _number(item: Column, name: str) -> Column:
    value = F.try_variant_get(item, f"$.{name}", "double")
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(F.rlike(_kind(_member(item, name)), F.lit(NUMBER)) & finite, value)


def _members(item: Column) -> Column:
    """The members of an item, each read from the JSON value once."""
    texts = ["id", "statement", "value", "branch", "concept", "file", "evidence"]
    numbers = ["line", "confidence"]
    return F.struct(
        *(_string(item, name).alias(name) for name in texts),
        *(_number(item, name).alias(name) for name in numbers),
    )


def _concept(item: Column) -> Column:
    concept = F.coalesce(item["concept"], derive_concept(item["statement"]))
    return item.withField("concept", concept)


def _item(item: Column, index: Column) -> Column:
    statement, value, branch, concept = (
        item[name] for name in ("statement", "value", "branch", "concept")
    )
    line = item["line"]
    given = F.coalesce(item["confidence"], F.lit(fixed.DEFAULT_AGENT_CONFIDENCE))
    numeric = F.least(F.lit(1.0), F.greatest(F.lit(0.0), given))

    def say(text: Column | str) -> Column:
        rest = F.lit(text) if isinstance(text, str) else text
        return F.concat(F.lit("assumption #"), index.cast("string"), F.lit(": "), rest)

    wrong_branch = F.concat(
        F.lit('"branch" must be exactly "'), "branch_a", F.lit('" or "'), "branch_b", F.lit('"')
    )
    error = (
        F.when(statement.isNull(), say('"statement" must be a non-empty string'))
        .when(value.isNull(), say('"value" must be a non-empty string'))
        .when(
            branch.isNull() | ((branch != F.col("branch_a")) & (branch != F.col("branch_b"))),
            say(wrong_branch),
        )
        .when(concept.isNull(), say('"concept" is missing and cannot be derived'))
    )
    return F.struct(
        index.cast("int").alias("item_idx"),
        F.coalesce(item["id"], F.lit("")).alias("id"),
        statement.alias("statement"),
        value.alias("value"),
        branch.alias("branch_name"),
        concept.alias("concept"),
        F.coalesce(item["file"], F.lit(fixed.NOT_KNOWN)).alias("source_file"),
        F.when((line >= 1) & (line == F.floor(line)), line.try_cast("bigint")).alias("line"),
        item["evidence"].alias("snippet"),
        numeric.alias("numeric_confidence"),
        error.alias("error"),
    )


def read_responses(responses: DataFrame) -> DataFrame:
    """Responses with their checked items, or the reason they are refused.

    ``responses(session_id, response_id, agent, branch_a, branch_b, raw_text)``.
    One bad item refuses its whole response. All items are checked inside the row
    of their response, so nothing is shuffled.
    """
    keep = [c for c in responses.columns if c != "raw_text"]
    parsed = responses.select(*keep, parse_json(strip_fences(F.col("raw_text"))).alias("json"))
    listed = parsed.withColumns(
        {
            "kind": _kind(F.col("json")),
            "list_kind": _kind(F.try_variant_get("json", "$.assumptions", "variant")),
            "list": F.try_variant_get("json", "$.assumptions", "array<variant>"),
        }
    )
    checked = listed.withColumn(
        "items",
        F.transform(
            F.transform(F.transform("list", _members), _concept),
            _item,
        ),
    )
    first_error = F.try_element_at(
        F.filter(F.transform("items", lambda i: i["error"]), lambda e: e.isNotNull()), F.lit(1)
    )
    reason = (
        F.when(F.col("json").isNull(), "invalid JSON")
        .when(
            ~F.startswith("kind", F.lit("OBJECT")),
            'response must be a JSON object with an "assumptions" array',
        )
        .when(
            ~F.startswith("list_kind", F.lit("ARRAY")), 'response is missing the "assumptions" array'
        )
        .otherwise(first_error)
    )
    return checked.withColumn("reason", reason).drop("json", "kind", "list_kind", "list")


def claims(read: DataFrame) -> DataFrame:
    """Claims of the responses that passed."""
    keep = [c for c in read.columns if c not in ("items", "reason", "branch_a", "branch_b")]
    # A filter on the reason would be pushed below and check every item twice.
    passed = F.when(F.col("reason").isNull(), F.col("items"))
    items = read.select(*keep, F.inline_outer(passed)).filter(F.col("item_idx").isNotNull())
    located = F.col("snippet").isNotNull() & (F.col("source_file") != fixed.NOT_KNOWN)
    return items.drop("error").withColumns(
        {
            "confidence": confidence_label(F.col("numeric_confidence")),
            "evidence_source": F.when(located, "FILE_CHANGE").otherwise("INFERRED"),
        }
    )


def with_ids(claims: DataFrame) -> DataFrame:
    made = F.concat_ws("-", F.lit("claim"), F.col("response_id").cast("string"), F.col("item_idx").cast("string"))
    return claims.withColumn("id", F.coalesce(F.nullif(F.col("id"), F.lit("")), made))


def warnings(read: DataFrame) -> DataFrame:
    """One warning per refused response, which gives no claims at all."""
    return read.filter(F.col("reason").isNotNull()).select(
        "session_id", "response_id", "agent",
        F.concat("agent", F.lit(": "), "reason").alias("message"),
    )


def claim_text(claims: DataFrame) -> DataFrame:
    """Each claim as analysis text, with its evidence."""
    base = F.concat(
        F.lit("["), "agent", F.lit("] "), "statement", F.lit(" — value: "), "value",
        F.lit(" @ "), "source_file", F.lit(" ("), "branch_name", F.lit(")"),
    )
    snippet = nonblank(F.col("snippet"))
    text = F.when(
        snippet.isNotNull(), F.concat(base, F.lit(" :: "), snippet)
    ).otherwise(base)
    return claims.withColumn("text", text)


def unique_lines(texts: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """Distinct non-blank lines per session, each at its first place.

    ``order`` names the columns that order a session's texts. Lines stay rows:
    the earliest place is combined before the shuffle, so a line repeated
    throughout a hot session costs one row per input partition.
    """
    lines = texts.select(
        "session_id", *order, F.posexplode(F.split(text, "\n")).alias("line_idx", "line")
    ).select("session_id", *order, "line_idx", trim(F.col("line")).alias("line"))
    kept = (
        lines.filter("line <> ''")
        .groupBy("session_id", "line")
        .agg(F.min(F.struct(*order, "line_idx")).alias("place"))
    )
    return kept.select("session_id", "place.*", "line")


def as_change(lines: DataFrame, order: list[str], change_seq: int) -> tuple[DataFrame, DataFrame]:
    """Change and snippet rows of a session's distinct lines, single-feed.

    Every line is a snippet of its own and carries its place as order, so a
    session's lines are never gathered into one text.
    """
    change = lines.select("session_id").distinct().select(
        "session_id", F.lit(change_seq).cast("long").alias("change_seq"),
        F.lit("change-agent-findings").alias("change_id"),
        F.lit("Agent findings").alias("label"), F.lit(fixed.NOT_KNOWN).alias("content"),
    )
    snippet = lines.select(
        "session_id", F.lit(change_seq).cast("long").alias("change_seq"),
        F.lit("change-agent-findings").alias("change_id"),
        F.struct(*(F.col(c).cast("long").alias(c) for c in (*order, "line_idx"))).alias("snippet_seq"),
        F.lit("agent-findings.txt").alias("file_path"), F.lit("CODE_DIFF").alias("source_type"),
        F.col("line").alias("content"),
    )
    return change, snippet
