"""The three verification flows as one job over a table of sessions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.refs import default_path
from claimgrid.functions.rules import RULES, Rule
from claimgrid.operators import agents, diffs, extract, files, normalize, pairing, reports, summary
from claimgrid.session import prepare, stage

Extractor = Callable[[DataFrame], DataFrame]
Detector = Callable[[DataFrame], DataFrame]


def direct_conflicts(normalized: DataFrame) -> DataFrame:
    """Only conflicts whose values exclude each other directly."""
    return pairing.detect_conflicts(normalized).filter("direct")


# Detectors by the name a caller chooses.
DETECTORS: dict[str, Detector] = {"contradictions": pairing.detect_conflicts, "direct": direct_conflicts}


@dataclass(frozen=True)
class Inputs:
    """Engine tables: sessions, changes and snippets, optionally context docs."""

    sessions: DataFrame
    changes: DataFrame
    snippets: DataFrame
    context_docs: DataFrame | None = None


@dataclass(frozen=True)
class Outcome:
    """Result tables of a run, keyed by session."""

    claims: DataFrame
    normalized: DataFrame
    conflicts: DataFrame
    reports: DataFrame
    report_files: DataFrame
    results: DataFrame


def _inert(rows: DataFrame) -> DataFrame:
    """Single-feed changes: the snippet carries the text, the change itself a dash."""
    return rows.select(
        "session_id", "change_seq", "change_id", "label", F.lit(fixed.NOT_KNOWN).alias("content")
    )


def from_texts(sessions: DataFrame, texts: DataFrame) -> Inputs:
    """Caller-supplied texts.

    ``texts(session_id, change_seq, change_id, label, content, file_path)``.
    """
    snippets = texts.select(
        "session_id", "change_seq", "change_id", F.lit(0).alias("snippet_seq"),
        default_path(F.col("file_path"), F.col("change_id")).alias("file_path"),
        F.lit("CODE_DIFF").alias("source_type"), "content",
    )
    return Inputs(sessions, _inert(texts), snippets)


def from_changed_files(sessions: DataFrame, branches: DataFrame, changed: DataFrame) -> Inputs:
    """Pre-parsed changed files.

    ``branches(session_id, branch_name, declared_seq)`` and ``changed(session_id,
    seq, branch_name, path, patch, ...)``. Branches with files become changes, in
    declared order and then by first file.
    """
    # Branch order, contents and snippets all read these rows; written once, the
    # diffs behind them are shredded once.
    kept = stage(files.dedupe(changed), "changed")
    order = Window.partitionBy("session_id").orderBy(
        F.col("declared_seq").asc_nulls_last(), "first_seq"
    )
    heads = files.ordered_branches(branches, kept).withColumn(
        "change_seq", (F.row_number().over(order) - 1).cast("long")
    )
    heads = heads.withColumn(
        "change_id", F.concat(F.lit("change-"), F.col("change_seq").cast("string"), F.lit("-"), "branch_name")
    ).select("session_id", "branch_name", "change_seq", "change_id", F.col("branch_name").alias("label"))
    fed = files.forwarded(kept)
    changes = files.change_content(heads, fed, word="on").drop("branch_name")
    silent = sessions.join(heads, "session_id", "left_anti").select(
        "session_id", F.lit(0).cast("long").alias("change_seq"),
        F.lit("change-empty").alias("change_id"), F.lit("empty").alias("label"),
        F.lit("No changes submitted for verification.").alias("content"),
    )
    snippets = fed.join(heads, ["session_id", "branch_name"]).select(
        "session_id", "change_seq", "change_id", F.col("seq").alias("snippet_seq"),
        F.col("path").alias("file_path"), F.lit("CODE_DIFF").alias("source_type"), "content",
    )
    return Inputs(sessions, changes.unionByName(silent), snippets)


def from_diffs(sessions: DataFrame, branches: DataFrame, raw_diffs: DataFrame) -> Inputs:
    """Exported diff texts: shredded to changed files, then as above."""
    shredded = diffs.changed_files(raw_diffs)
    changed = shredded.withColumn("seq", F.struct("diff_id", "file_idx")).drop("diff_id", "file_idx")
    return from_changed_files(sessions, branches, changed)


def from_split_diffs(sessions: DataFrame, branches: DataFrame, pieces: DataFrame) -> Inputs:
    """Chunks of ``tables.read_split_diffs`` with their session, parsed and taken as changed files."""
    parsed = diffs.changed_of_pieces(pieces)
    changed = parsed.withColumn("seq", F.struct("diff_id", "place.block", "place.at", "place.piece")).drop("diff_id", "place")
    return from_changed_files(sessions, branches, changed)


def from_analysers(sessions: DataFrame, responses: DataFrame) -> Inputs:
    """Analyser responses: every distinct line of their claims is a snippet of its own.

    ``responses`` as ``agents.read_responses`` takes them, with numeric ids. Lines
    keep (response, item, line) as order, so a session is never gathered.
    """
    claims = agents.claims(agents.read_responses(responses))
    order = ["response_id", "item_idx"]
    lines = agents.unique_lines(agents.claim_text(claims), order)
    changes, snippets = agents.as_change(lines, order, 0)
    return Inputs(sessions, changes, snippets)


def requirement_text(requests: DataFrame) -> DataFrame:
    """Requirement of a feature request: its description and then its rules."""
    lines = F.concat(F.array("description"), F.coalesce("rules", F.array().cast("array<string>")))
    return requests.withColumn("requirement_text", F.array_join(lines, "\n"))


def verify(
    inputs: Inputs,
    source_type: str = "CODE_DIFF",
    rules: Sequence[Rule] = RULES,
    extractor: Extractor | None = None,
    detector: Detector | str | None = None,
) -> Outcome:
    """Extract, normalise, pair, rule and report every session of ``inputs``.

    Claims are the one expensive intermediate and feed all results, so they are
    written once. ``extractor`` (units to claims) and ``detector`` (normalised
    claims to conflicts, or a name in ``DETECTORS``) replace the built-in ones.
    """
    if isinstance(detector, str):
        if detector not in DETECTORS:
            raise ValueError(f"unknown detector: {detector}")
        detector = DETECTORS[detector]
    prepare(inputs.sessions.sparkSession)
    units = extract.build_units(
        inputs.sessions, inputs.changes, inputs.snippets, inputs.context_docs
    )
    found = extractor(units) if extractor else extract.claims(units, source_type, rules)
    claims = stage(found, "claims")
    normalized = normalize.normalize(claims)
    if detector:
        conflicts = detector(normalized)
        counts = conflicts.groupBy("session_id").agg(
            F.count("*").alias("conflicts_found"),
            F.count_if(F.col("severity") == "HIGH").alias("high"),
        )
    else:
        # The verdict needs counts only, and those need no pairs.
        pairable = stage(pairing.pairable(pairing.merge_claims(normalized)), "pairable")
        conflicts = pairing.conflicts_from_pairable(pairable)
        counts = summary.counts_of_pairable(pairable)
    return Outcome(
        claims=claims,
        normalized=normalized,
        conflicts=conflicts,
        reports=reports.explain(conflicts),
        report_files=reports.report_files(conflicts, pairing.evidence_files(normalized)),
        results=summary.session_results(inputs.sessions, summary.claim_counts(claims), counts),
    )
