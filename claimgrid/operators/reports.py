"""Conflicts -> explainable reports, findings and display rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.rulings import locale_key, pair_text, severity_rank, source_label
from claimgrid.operators import repeats
from claimgrid.operators.pairing import MERGE_KEY, evidence_files, merged_evidence


def explain(conflicts: DataFrame) -> DataFrame:
    """The report of each conflict. Narrow: texts are written after all shuffles."""
    return conflicts.select(
        "session_id", "conflict_id", "conflict_type",
        F.col("canonical_subject").alias("affected_entity"),
        pair_text(fixed.TITLES).alias("title"),
        "severity", "confidence", "severity_rule", "confidence_rule",
        pair_text(fixed.WHY).alias("why_incompatible"),
        pair_text(fixed.HINTS).alias("verification_hint"),
        pair_text(fixed.EXPLANATIONS).alias("explanation"),
        source_label("l_source_type", "l_file").alias("l_label"), "l_claim_id",
        "l_statement", "l_predicate", "l_evidence_text", "l_file",
        source_label("r_source_type", "r_file").alias("r_label"), "r_claim_id",
        "r_statement", "r_predicate", "r_evidence_text", "r_file",
    )


def in_report_order(reports: DataFrame) -> DataFrame:
    """Session by session, most severe first, then by id."""
    return reports.orderBy("session_id", severity_rank(), locale_key())


def _side_keys(conflicts: DataFrame) -> DataFrame:
    """The two merged claims of each conflict as rows: side 0 left, 1 right."""
    return conflicts.select(
        "session_id", "canonical_subject", "conflict_id",
        F.posexplode(F.array("l_predicate", "r_predicate")).alias("side", "canonical_predicate"),
    )


def report_files(conflicts: DataFrame, evidence_files: DataFrame) -> DataFrame:
    """Distinct files behind either side of a conflict, one row each."""
    return (
        _side_keys(conflicts)
        .drop("side")
        .join(evidence_files, MERGE_KEY)
        .select("session_id", "conflict_id", "file_path")
        .distinct()
    )


def report_evidence(conflicts: DataFrame, merged_evidence: DataFrame, stored: bool = False) -> DataFrame:
    """Evidence of both sides, left before right, first reference per id.

    If the evidence is ``stored`` and ``conflicts`` has one row an id, as ``first_per_id``
    leaves it, a reference whose id a session has once can't meet itself in a conflict,
    because the two sides of a conflict are different merged claims. Only the others are
    grouped again.
    """
    sides = _side_keys(conflicts)
    alone, shared = repeats.split(merged_evidence, ["session_id", "ref_id"]) if stored else (None, merged_evidence)
    parts = []
    if alone is not None:
        parts.append(sides.join(alone, MERGE_KEY).select("session_id", "conflict_id", "ref_id", *REFERENCE))
    if shared is not None:
        parts.append(_first_references(sides.join(shared, MERGE_KEY)))
    return reduce(DataFrame.unionByName, parts)


# The order of a conflict's references, and what they say.
REFERENCE = ["side", "ord", "ref_seq", "source_type", "file_path", "line_range", "text", "label"]


def _first_references(rows: DataFrame) -> DataFrame:
    kept = rows.groupBy("session_id", "conflict_id", "ref_id").agg(F.min(F.struct(*REFERENCE)).alias("ref"))
    return kept.select("session_id", "conflict_id", "ref_id", "ref.*")


@dataclass(frozen=True)
class Evidence:
    """The evidence of conflicts in factors: which claims a conflict has, and what each claim has.

    A claim that stands in many conflicts holds its references and files once, so the
    tables grow with claims plus conflicts. ``expand_references`` and ``expand_files``
    give the rows of ``report_evidence`` and ``report_files``, for all conflicts or for
    the (session_id, conflict_id) asked for.
    """

    sides: DataFrame
    references: DataFrame
    files: DataFrame

    def counts(self) -> DataFrame:
        """References and files behind each side of a conflict, counted per claim and never expanded."""
        n_refs = self.references.groupBy(*MERGE_KEY).agg(F.count("*").alias("n_refs"))
        n_files = self.files.groupBy(*MERGE_KEY).agg(F.count("*").alias("n_files"))
        joined = self.sides.join(n_refs.join(n_files, MERGE_KEY, "full"), MERGE_KEY, "left")
        return joined.select("session_id", "conflict_id", "side", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_refs", "n_files")))

    def _wanted(self, wanted: DataFrame | None) -> DataFrame:
        return self.sides if wanted is None else self.sides.join(wanted, ["session_id", "conflict_id"], "left_semi")

    def expand_references(self, wanted: DataFrame | None = None) -> DataFrame:
        return _first_references(self._wanted(wanted).join(self.references, MERGE_KEY))

    def expand_files(self, wanted: DataFrame | None = None) -> DataFrame:
        rows = self._wanted(wanted).join(self.files, MERGE_KEY)
        return rows.select("session_id", "conflict_id", "file_path").distinct()


def evidence_of(conflicts: DataFrame, normalized: DataFrame) -> Evidence:
    """``conflicts`` and the normalised claims they were found in; both are read more than once."""
    return Evidence(_side_keys(conflicts), merged_evidence(normalized), evidence_files(normalized))


def _label_number(column: str, numbers: dict[str, float]) -> Column:
    chain = F.lit(None)
    for label, number in numbers.items():
        chain = F.when(F.col(column) == label, F.lit(number)).otherwise(chain)
    return chain


def finding_severity() -> Column:
    return F.when(F.col("severity") == "INFO", "LOW").otherwise(F.col("severity"))


def domain_claims(
    claims: DataFrame, branch_by_file: DataFrame, fallback_branch: DataFrame
) -> DataFrame:
    """Claims with branch, evidence source and numeric confidence.

    ``branch_by_file(session_id, path, branch_name)`` holds one row per path and
    ``fallback_branch(session_id, fallback_branch)`` one per session, so neither
    join can multiply rows.
    """
    by_file = branch_by_file.select(
        "session_id", F.col("path").alias("source_file"), F.col("branch_name").alias("file_branch")
    )
    joined = claims.join(by_file, ["session_id", "source_file"], "left").join(
        fallback_branch, "session_id", "left"
    )
    has_file = F.nullif(F.col("source_file"), F.lit("")).isNotNull()
    return joined.select(
        "session_id", F.col("claim_id").alias("id"),
        F.coalesce("file_branch", "fallback_branch").alias("branch_name"),
        F.coalesce("source_file", F.lit(fixed.NOT_KNOWN)).alias("source_file"),
        "statement", F.col("subject").alias("concept"), F.col("predicate").alias("value"),
        F.lit("change").alias("source_agent"),
        F.when(has_file, "FILE_CHANGE").otherwise("INFERRED").alias("evidence_source"),
        F.col("evidence_text").alias("snippet"),
        "confidence",
        _label_number("confidence", fixed.CLAIM_CONFIDENCE).cast("double").alias("numeric_confidence"),
        *[c for c in claims.columns if c in ("part", "change_seq", "snippet_seq", "seg_idx", "rule_idx")],
    )


def statement_ids(claims: DataFrame) -> DataFrame:
    """First claim id per statement; combined before the shuffle."""
    order = F.struct("part", "change_seq", "snippet_seq", "seg_idx", "rule_idx")
    return claims.groupBy("session_id", "statement").agg(
        F.min_by("claim_id", order).alias("statement_claim_id")
    )


def findings(reports: DataFrame, ids: DataFrame) -> DataFrame:
    """Findings, each side resolved to the first claim with that statement."""

    def resolved(side: str) -> DataFrame:
        return ids.select(
            "session_id",
            F.col("statement").alias(f"{side}_statement"),
            F.col("statement_claim_id").alias(f"{side}_id"),
        )

    joined = reports.join(resolved("l"), ["session_id", "l_statement"], "left").join(
        resolved("r"), ["session_id", "r_statement"], "left"
    )
    return joined.select(
        "session_id", "conflict_id", "title",
        F.col("why_incompatible").alias("description"),
        finding_severity().alias("severity"),
        F.col("conflict_type").alias("category"),
        F.array_compact(F.array("l_id", "r_id")).alias("affected_claim_ids"),
        F.lit(None).cast("string").alias("proposed_resolution"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def display_rows(reports: DataFrame, sessions: DataFrame) -> DataFrame:
    """Reports as shown: number for confidence, two claim sides, two excerpts."""

    def side(prefix: str, mark: str) -> Column:
        return F.struct(
            F.concat("conflict_id", F.lit(f"::{mark}")).alias("id"),
            F.col(f"{prefix}_statement").alias("statement"),
            F.coalesce(F.col(f"{prefix}_file"), F.lit(fixed.NOT_KNOWN)).alias("source_file"),
            F.lit(fixed.NOT_KNOWN).alias("source_line"),
            F.col("affected_entity").alias("depends_on"),
            F.col(f"{prefix}_label").alias("produced_by"),
        )

    def excerpt(prefix: str) -> Column:
        return F.struct(
            F.col(f"{prefix}_file").alias("file"),
            F.col(f"{prefix}_label").alias("location"),
            F.col(f"{prefix}_evidence_text").alias("snippet"),
            F.col(f"{prefix}_label").alias("source"),
        )

    texts = sessions.select("session_id", "requirement_text")
    return reports.join(texts, "session_id").select(
        "session_id", "conflict_id", F.col("conflict_type").alias("kind"),
        finding_severity().alias("severity"),
        _label_number("confidence", fixed.DISPLAY_CONFIDENCE).cast("int").alias("confidence"),
        "title", F.col("why_incompatible").alias("description"), "requirement_text",
        F.col("affected_entity").alias("affected_contract"),
        side("l", "a").alias("claim_a"), side("r", "b").alias("claim_b"),
        F.array(excerpt("l"), excerpt("r")).alias("excerpts"),
        "verification_hint",
        F.lit(False).alias("resolved"),
    )


def resolution(proposal: str = "proposed_resolution", hint: str = "verification_hint") -> Column:
    return F.coalesce(F.col(proposal), F.col(hint))


def with_order(reports: DataFrame) -> DataFrame:
    """Every conflict with the key ``(severity_order, id_order)`` it is shown by.

    The key stands in the row, so no session is ranked in one task.
    """
    return reports.withColumns({"severity_order": severity_rank(), "id_order": locale_key()})
