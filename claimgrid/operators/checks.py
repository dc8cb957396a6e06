"""Data-quality checks: each table gives rows of (key columns, field, message).

A check is a field name, a condition that makes it fail, and a message. All
checks of a table run in one pass over it; only duplicate ids and missing rows
need a second table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.text import is_blank, longer_than, trim

Get = Callable[[str], Column]
ISSUE = "array<struct<field:string,message:string>>"
UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z"
UTC_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z\z"


@dataclass(frozen=True)
class Check:
    field: str | Column
    fails: Column
    message: str | Column


def _column(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def issue_array(checks: list[Check], prefix: Column | None = None) -> Column:
    """Failed checks as an array; a check that is unknown does not fail."""
    entries = []
    for check in checks:
        field = _column(check.field)
        field = F.concat(prefix, field) if prefix is not None else field
        entry = F.struct(field.alias("field"), _column(check.message).alias("message"))
        entries.append(F.when(check.fails, entry))
    return F.array_compact(F.array(*entries)).cast(ISSUE)


def issues(df: DataFrame, keys: list[str], *arrays: Column) -> DataFrame:
    found = F.concat(*(F.coalesce(a, F.array().cast(ISSUE)) for a in arrays))
    rows = df.select(*keys, F.inline_outer(found).alias("field", "message"))
    return rows.filter(F.col("field").isNotNull())


def each(array: Column, checks: Callable[[Get], list[Check]], name: str) -> Column:
    """Issues of every element of a nested array, fields written ``name[i].field``."""

    def one(element: Column, index: Column) -> Column:
        prefix = F.concat(F.lit(f"{name}["), index.cast("string"), F.lit("]."))
        return issue_array(checks(lambda field: element[field]), prefix)

    return F.flatten(F.transform(array, one))


def blank(field: str, value: Column, name: str | None = None) -> Check:
    return Check(field, is_blank(value), f"{name or field} must be a non-empty string")


def empty(field: str, value: Column, message: str | None = None) -> Check:
    return Check(field, F.coalesce(value, F.lit("")) == "", message or f"{field} must not be empty")


def one_of(field: str, value: Column, allowed: list[str]) -> Check:
    message = f"{field} must be one of: {', '.join(allowed)}"
    return Check(field, ~F.coalesce(value.isin(allowed), F.lit(False)), message)


def uuid(field: str, value: Column) -> Check:
    return Check(field, ~F.coalesce(F.rlike(value, F.lit(UUID)), F.lit(False)), "id must be a UUID v4 string")


def utc_time(field: str, value: Column, nullable: bool = False) -> Check:
    good = F.rlike(value, F.lit(UTC_TIME)) & F.try_to_timestamp(value).isNotNull()
    absent = value.isNull() if nullable else F.lit(False)
    message = "must be an ISO-8601 UTC datetime string (e.g. 2024-08-01T12:00:00.000Z)"
    return Check(field, ~(absent | F.coalesce(good, F.lit(False))), message)


# --- engine input ----------------------------------------------------------------


def input_errors(
    sessions: DataFrame, changes: DataFrame, snippets: DataFrame | None = None
) -> DataFrame:
    """Errors of whole analysis inputs, keyed by session."""
    key = ["session_id"]
    at = F.concat(F.lit("changes["), F.col("change_seq").cast("string"), F.lit("]."))
    of_session = issues(
        sessions, key,
        issue_array(
            [
                blank("sessionId", F.col("session_id").cast("string")),
                blank("requirementText", F.col("requirement_text")),
            ]
        ),
    )
    changed = changes.select("session_id").distinct()
    without = sessions.join(changed, "session_id", "left_anti").select(
        "session_id", F.lit("changes").alias("field"),
        F.lit("at least one change description is required").alias("message"),
    )
    of_change = issues(
        changes, key,
        issue_array(
            [
                blank("id", F.col("change_id"), "change id"),
                blank("label", F.col("label"), "change label"),
                blank("content", F.col("content"), "change content"),
            ],
            at,
        ),
    )
    # Repeated ids are few, so the first place of each is found by a combined
    # minimum and only repeated ids are joined back.
    first = (
        changes.filter(~is_blank(F.col("change_id")))
        .groupBy("session_id", "change_id")
        .agg(F.min("change_seq").alias("first_seq"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    repeated = (
        changes.join(first, ["session_id", "change_id"])
        .filter("change_seq > first_seq")
        .select(
            "session_id", F.concat(at, F.lit("id")).alias("field"),
            F.concat(F.lit('duplicate change id "'), "change_id", F.lit('"')).alias("message"),
        )
    )
    found = of_session.unionByName(without).unionByName(of_change).unionByName(repeated)
    if snippets is not None:
        place = F.concat(at, F.lit("fileSnippets["), F.col("snippet_seq").cast("string"), F.lit("]."))
        checks = [
            blank("filePath", F.col("file_path")),
            blank("content", F.col("content"), "snippet content"),
        ]
        if "line_range" in snippets.columns:
            start, end = F.col("line_range.start"), F.col("line_range.end")
            wrong = F.coalesce((start < 1) | (end < 1) | (start > end), F.lit(True))
            checks.append(
                Check(
                    "lineRange", F.col("line_range").isNotNull() & wrong,
                    "lineRange must be [start, end] with start >= 1 and start <= end",
                )
            )
        found = found.unionByName(issues(snippets, key, issue_array(checks, place)))
    return found


class InvalidRows(ValueError):
    """Rows that were not written: how many errors they have, and the first of them."""

    def __init__(self, subject: str, errors: int, first: str | None):
        super().__init__(f"Invalid {subject}: {errors} errors, among them: {first}")
        self.errors, self.first = errors, first


def write_checked(rows: DataFrame, checks: Callable[[Get], list[Check]], path: str, subject: str) -> int:
    """Write ``rows`` if all of them pass, counting errors in the writing job itself.

    Every row's failed checks are found on its way to the writer and observed: number
    of errors, and the least (field, message). No row is read twice and no action
    runs beside the write. The files appear under a name that readers skip and get
    ``path`` only when no error was seen, so a bad row leaves nothing behind. Returns
    the number of rows.
    """
    spark = rows.sparkSession
    found = issue_array(checks(F.col))
    listed = F.transform(found, lambda e: F.concat(e["field"], F.lit(" — "), e["message"]))
    name = "_issues"
    while name in rows.columns:
        name = "_" + name
    seen = Observation("checks")
    observed = rows.withColumn(name, listed).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.sum(F.size(name)).alias("errors"), F.min(F.array_min(name)).alias("first")
    )
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if system.exists(place):
        raise FileExistsError(path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_draft-{uuid4().hex}")
    try:
        observed.drop(name).write.parquet(draft.toString())
        if seen.get["errors"]:
            raise InvalidRows(subject, seen.get["errors"], seen.get["first"])
        if not system.rename(draft, place):
            raise FileExistsError(path)
    finally:
        system.delete(draft, True)
    return seen.get["rows"]


def assert_none(errors: DataFrame, subject: str) -> None:
    """Fail with the number of errors and the first of them in order of place and message."""
    found = errors.agg(F.count(F.lit(1)).alias("n"), F.min(F.concat("field", F.lit(" — "), "message")).alias("first")).first()
    if found["n"]:
        raise ValueError(f"Invalid {subject}: {found['n']} errors, among them: {found['first']}")


# --- engine records --------------------------------------------------------------


def reference_checks(get: Get) -> list[Check]:
    start, end = get("line_range")["start"], get("line_range")["end"]
    given = get("line_range").isNotNull()
    positive = "must be a positive integer"
    return [
        blank("id", get("ref_id")),
        one_of("sourceType", get("source_type"), fixed.SOURCE_TYPES),
        blank("text", get("text")),
        Check("lineRange[0]", given & F.coalesce(start < 1, F.lit(True)), f"lineRange start {positive}"),
        Check("lineRange[1]", given & F.coalesce(end < 1, F.lit(True)), f"lineRange end {positive}"),
        Check("lineRange", start > end, "lineRange start must be less than or equal to end"),
    ]


def claim_checks(get: Get) -> list[Check]:
    return [
        blank("id", get("claim_id")),
        blank("statement", get("statement")),
        blank("subject", get("subject")),
        blank("predicate", get("predicate")),
        one_of("sourceType", get("source_type"), fixed.SOURCE_TYPES),
        blank("evidenceText", get("evidence_text")),
        one_of("confidence", get("confidence"), fixed.CONFIDENCES),
    ]


def claim_errors(claims: DataFrame, keys: list[str]) -> DataFrame:
    arrays = [issue_array(claim_checks(F.col))]
    if "supporting_evidence" in claims.columns:
        arrays.append(each(F.col("supporting_evidence"), reference_checks, "supportingEvidence"))
    return issues(claims, keys, *arrays)


def reference_errors(refs: DataFrame, keys: list[str]) -> DataFrame:
    return issues(refs, keys, issue_array(reference_checks(F.col)))


def _sides() -> list[Column]:
    return [
        issue_array(claim_checks(lambda f, s=s: F.col(s)[f]), F.lit(f"{label}."))
        for s, label in (("left", "leftAssumption"), ("right", "rightAssumption"))
    ]


def candidate_errors(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` and ``right`` are claim structs."""
    col = F.col
    own = [
        blank("id", col("candidate_id")),
        one_of("conflictType", col("conflict_type"), fixed.CONFLICT_TYPES),
        one_of("estimatedSeverity", col("estimated_severity"), fixed.SEVERITIES),
        one_of("confidence", col("confidence"), fixed.CONFIDENCES),
        one_of("status", col("status"), fixed.CANDIDATE_STATUSES),
        blank("affectedEntity", col("affected_entity")),
        blank("pairingRationale", col("pairing_rationale")),
    ]
    same = F.lower(trim(col("left.subject"))) == F.lower(trim(col("right.subject")))
    shared = Check(
        "affectedEntity", ~same,
        "leftAssumption.subject and rightAssumption.subject must share the same normalized entity",
    )
    return issues(candidates, keys, issue_array(own), *_sides(), issue_array([shared]))


def conflict_errors(conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` and ``right`` are claim structs, ``evidence`` an array of references."""
    col = F.col
    none = F.coalesce(F.size("evidence") <= 0, F.lit(True))
    unreadable = ~is_blank(col("confirmed_at")) & F.try_to_timestamp("confirmed_at").isNull()
    own = [
        blank("id", col("conflict_id")),
        one_of("conflictType", col("conflict_type"), fixed.CONFLICT_TYPES),
        blank("explanation", col("explanation")),
        blank("affectedEntity", col("affected_entity")),
        one_of("severity", col("severity"), fixed.SEVERITIES),
        one_of("confidence", col("confidence"), fixed.CONFIDENCES),
        Check("evidenceReferences", none, "at least one evidence reference is required for a confirmed conflict"),
        Check("confirmedAt", is_blank(col("confirmed_at")), "confirmedAt must be a non-empty ISO-8601 timestamp"),
        Check("confirmedAt", unreadable, "confirmedAt must be a valid ISO-8601 date string"),
    ]
    nested = each(col("evidence"), reference_checks, "evidenceReferences")
    return issues(conflicts, keys, issue_array(own), nested, *_sides())


# --- domain records --------------------------------------------------------------


def code_evidence_checks(get: Get) -> list[Check]:
    start, end = get("line_start"), get("line_end")
    apart = (end < start) | (start.isNull() & end.isNotNull())
    return [
        one_of("source", get("source"), fixed.EVIDENCE_SOURCES),
        empty("filePath", get("file_path")),
        Check("lineStart", start < 1, "lineStart must be positive"),
        Check("lineEnd", end < 1, "lineEnd must be positive"),
        empty("branchName", get("branch_name")),
        Check("line", apart, "lineEnd must be >= lineStart, and both must be null or both non-null"),
    ]


def criterion_checks(get: Get) -> list[Check]:
    return [empty("key", get("key")), empty("description", get("description"))]


def feature_request_checks(get: Get) -> list[Check]:
    return [
        uuid("id", get("id")),
        empty("title", get("title")),
        empty("description", get("description")),
        utc_time("createdAt", get("created_at")),
        empty("submittedBy", get("submitted_by")),
    ]


def branch_checks(get: Get) -> list[Check]:
    good = F.coalesce(F.rlike(get("sha"), F.lit(r"^[0-9a-f]{40}\z")), F.lit(False))
    return [
        empty("name", get("name"), "branch name must not be empty"),
        Check("sha", ~good, "sha must be a 40-character lowercase hex string"),
    ]


def repository_checks(get: Get) -> list[Check]:
    none = F.coalesce(F.size(get("feature_branches")) <= 0, F.lit(True))
    return [
        uuid("id", get("id")),
        empty("name", get("name")),
        empty("cloneUrl", get("clone_url")),
        empty("provider", get("provider")),
        Check("featureBranches", none, "at least one feature branch is required"),
        utc_time("resolvedAt", get("resolved_at")),
    ]


def changed_file_checks(get: Get) -> list[Check]:
    return [
        empty("path", get("path")),
        one_of("kind", get("kind"), fixed.CHANGE_KINDS),
        Check("previousPath", get("previous_path") == "", "previousPath must not be empty"),
        Check("additions", F.coalesce(get("additions") < 0, F.lit(True)), "additions must not be negative"),
        Check("deletions", F.coalesce(get("deletions") < 0, F.lit(True)), "deletions must not be negative"),
        empty("branchName", get("branch_name")),
        Check(
            "previousPath", (get("kind") == "RENAMED") & get("previous_path").isNull(),
            "previousPath is required when kind is RENAMED",
        ),
    ]


def domain_claim_checks(get: Get) -> list[Check]:
    kebab = F.coalesce(F.rlike(get("concept"), F.lit(r"^[a-z0-9-]+\z")), F.lit(False))
    ratio = F.coalesce(get("numeric_confidence").between(0, 1), F.lit(False))
    return [
        uuid("id", get("id")),
        empty("branchName", get("branch_name")),
        empty("sourceFile", get("source_file")),
        empty("statement", get("statement")),
        Check("concept", ~kebab, "concept must be lowercase kebab-case"),
        empty("value", get("value")),
        one_of("sourceAgent", get("source_agent"), fixed.AGENT_TYPES),
        one_of("confidence", get("confidence"), fixed.CONFIDENCES),
        Check("numericConfidence", ~ratio, "numericConfidence must be between 0 and 1"),
        utc_time("extractedAt", get("extracted_at")),
    ]


def dependency_checks(get: Get) -> list[Check]:
    ends = [
        empty(f"{end}.{name}", get(f"{end}_{column}"))
        for end in ("from", "to")
        for name, column in (("filePath", "file_path"), ("branchName", "branch_name"))
    ]
    missing = Check("isCrossModule", get("is_cross_module").isNull(), "isCrossModule is required")
    return [uuid("id", get("id")), *ends, one_of("kind", get("kind"), fixed.DEPENDENCY_KINDS), missing]


def finding_checks(get: Get) -> list[Check]:
    none = F.coalesce(F.size(get("affected_claim_ids")) <= 0, F.lit(True))
    return [
        uuid("id", get("id")),
        empty("title", get("title")),
        Check("title", longer_than(get("title"), 160), "title should be < 160 characters"),
        empty("description", get("description")),
        one_of("severity", get("severity"), fixed.FINDING_SEVERITIES),
        one_of("category", get("category"), fixed.FINDING_CATEGORIES),
        Check("affectedAssumptionIds", none, "at least one affected assumption is required"),
        Check(
            "resolvedAt", get("proposed_resolution").isNull() & get("resolved_at").isNotNull(),
            "resolvedAt must be null when proposedResolution is null",
        ),
    ]


def summary_checks(get: Get) -> list[Check]:
    counts = {
        "assumptionsFound": "assumptions_found",
        "conflictsFound": "conflicts_found",
        "conflictsResolved": "conflicts_resolved",
        "filesChanged": "files_changed",
    }
    percent = get("requirement_coverage")
    return [
        *(
            Check(name, F.coalesce(get(c) < 0, F.lit(True)), f"{name} must not be negative")
            for name, c in counts.items()
        ),
        Check("requirementCoverage", ~percent.between(0, 100), "requirementCoverage must be between 0 and 100"),
        Check(
            "conflictsResolved", get("conflicts_resolved") > get("conflicts_found"),
            "conflictsResolved cannot exceed conflictsFound",
        ),
    ]


def result_checks(get: Get) -> list[Check]:
    status, done = get("status"), get("completed_at")
    version = F.coalesce(F.rlike(get("schema_version"), F.lit(r"^\d+\.\d+\.\d+\z")), F.lit(False))
    return [
        uuid("id", get("id")),
        Check("schemaVersion", ~version, 'must be a valid SemVer string (e.g. "1.0.0")'),
        one_of("status", status, fixed.RESULT_STATUSES),
        utc_time("startedAt", get("started_at")),
        utc_time("completedAt", done, nullable=True),
        Check(
            "completedAt", ~status.isin(fixed.TERMINAL_STATUSES) & done.isNotNull(),
            "completedAt must be null when status is PENDING or IN_PROGRESS",
        ),
        Check(
            "errorMessage", (status == "ERROR") & get("error_message").isNull(),
            "errorMessage must be set when status is ERROR",
        ),
    ]


def passport_draft_checks(get: Get) -> list[Check]:
    half = get("approved_by").isNull() != get("approved_at").isNull()
    return [
        uuid("id", get("id")),
        empty("title", get("title")),
        empty("intentSummary", get("intent_summary")),
        utc_time("generatedAt", get("generated_at")),
        Check("approvedBy", half, "approvedBy and approvedAt must both be set or both be null"),
        Check(
            "verificationResultId", get("verification_result_id") != get("embedded_result_id"),
            "verificationResultId must match the embedded verificationResult.id",
        ),
    ]


def record_errors(df: DataFrame, keys: list[str], checks: Callable[[Get], list[Check]]) -> DataFrame:
    return issues(df, keys, issue_array(checks(F.col)))


# --- golden-record integrity -----------------------------------------------------


def unknown_claim_ids(findings: DataFrame, claims: DataFrame) -> DataFrame:
    """Claim ids a finding names that its result does not list."""
    named = findings.select("result_id", F.explode("affected_claim_ids").alias("claim_id"))
    known = claims.select("result_id", "claim_id")
    return named.join(known, ["result_id", "claim_id"], "left_anti")


def miscounted(summaries: DataFrame, claims: DataFrame, findings: DataFrame) -> DataFrame:
    """Results whose summary counts differ from their rows."""
    n_claims = claims.groupBy("result_id").agg(F.count("*").alias("n_claims"))
    n_findings = findings.groupBy("result_id").agg(F.count("*").alias("n_findings"))
    joined = summaries.join(n_claims, "result_id", "left").join(n_findings, "result_id", "left")
    joined = joined.fillna(0, ["n_claims", "n_findings"])
    by_severity = F.col("critical") + F.col("high") + F.col("medium") + F.col("low")
    return joined.filter(
        (F.col("assumptions_found") != F.col("n_claims"))
        | (F.col("conflicts_found") != F.col("n_findings"))
        | (by_severity != F.col("conflicts_found"))
    )
