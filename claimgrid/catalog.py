"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrid.functions import refs, rulebook
from claimgrid.operators import (
    agents,
    checks,
    context,
    diffs,
    evidence,
    extract,
    graph,
    lifecycle,
    normalize,
    pairing,
    reports,
    summary,
)
from claimgrid.operators import files as files_ops
from claimgrid.plans import verify
from claimgrid.session import prepare, scratch, stage
from claimgrid.sources import corpus, tables
from claimgrid.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(prepare(spark), sf)

    QUERIES[fn.__name__] = run
    return run


# --- the claim pipeline over the projected corpus ------------------------------


def corpus_units(spark: SparkSession, sf: str) -> DataFrame:
    return extract.build_units(
        corpus.sessions(spark, sf),
        corpus.changes(spark, sf),
        corpus.snippets(spark, sf),
        corpus.context_docs(spark, sf),
    )


def corpus_claims(spark: SparkSession, sf: str) -> DataFrame:
    return extract.claims(corpus_units(spark, sf), source_type="CODE_DIFF")


def corpus_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize(corpus_claims(spark, sf))


def found_pairable(normalized: DataFrame, texts: bool = False) -> DataFrame:
    """Pairable claims, staged once: pairing reads them three times, and counting six."""
    return stage(pairing.pairable(pairing.merge_claims(normalized, texts)), "pairable")


def found_conflicts(normalized: DataFrame, texts: bool = False) -> DataFrame:
    """Conflicts, with the statements and excerpts of their claims if ``texts``."""
    return pairing.conflicts_from_pairable(found_pairable(normalized, texts))


def corpus_conflicts(spark: SparkSession, sf: str, texts: bool = False) -> DataFrame:
    return found_conflicts(corpus_normalized(spark, sf), texts)


@query
def segments(spark, sf):
    return extract.segments(corpus_units(spark, sf), *extract.UNIT_KEY)


@query
def document_segments(spark, sf):
    docs = corpus.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return extract.segments(docs, "doc_id", "lang").groupBy("lang").agg(
        F.count("*").alias("n_segments"),
        F.sum(F.length("segment")).alias("n_chars"),
        F.max("seg_idx").alias("max_seg_idx"),
    )


@query
def category_hints(spark, sf):
    return corpus_units(spark, sf).select(*extract.UNIT_KEY, "unit_id", "category_hint")


@query
def rule_matches(spark, sf):
    return extract.rule_matches(corpus_units(spark, sf)).drop("unit_id")


@query
def claims(spark, sf):
    return corpus_claims(spark, sf).select(
        *extract.UNIT_KEY, "seg_idx", "rule_idx", "rule_id", "category", "subject",
        "predicate", "statement", "evidence_text", "confidence", "source_type", "source_file",
    )


@query
def claim_ids(spark, sf):
    return corpus_claims(spark, sf).select("session_id", "claim_idx", "claim_id")


@query
def extraction_diagnostics(spark, sf):
    return extract.diagnostics(corpus_units(spark, sf))


@query
def rule_counts(spark, sf):
    return corpus_claims(spark, sf).groupBy("category", "rule_id").agg(
        F.count("*").alias("n_claims"), F.count_distinct("session_id").alias("n_sessions")
    )


@query
def norm_entities(spark, sf):
    return corpus_normalized(spark, sf).select(
        "session_id", "claim_id", "subject", "canonical_subject", "subject_why"
    )


@query
def norm_predicates(spark, sf):
    return corpus_normalized(spark, sf).select(
        "session_id", "claim_id", "predicate", "canonical_key", "canonical_value",
        "canonical_predicate", "key_why", "value_why",
    )


@query
def merged_claims(spark, sf):
    return pairing.merge_claims(corpus_normalized(spark, sf)).select(
        *pairing.MERGE_KEY, "claim_id", "statement", "source_file", "n_claims"
    )


@query
def merged_evidence(spark, sf):
    return pairing.merged_evidence(corpus_normalized(spark, sf)).select(
        *pairing.MERGE_KEY, "ref_id", "source_type", "file_path", "text"
    )


@query
def conflict_pairs(spark, sf):
    return pairing.contradicting_pairs(found_pairable(corpus_normalized(spark, sf))).select(
        *pairing.GROUP_KEY, "conflict_type", "l_claim_id", "r_claim_id", "l_value", "r_value"
    )


@query
def conflicts(spark, sf):
    return corpus_conflicts(spark, sf).select(
        "session_id", "conflict_id", "conflict_type", "canonical_subject", "canonical_key",
        "l_value", "r_value", "severity", "severity_rule", "confidence", "confidence_rule",
        F.array_join(F.coalesce(pairing.conflict_files(), F.array()), "|").alias("files"),
    )


@query
def conflict_reports(spark, sf):
    return reports.explain(corpus_conflicts(spark, sf, texts=True)).drop("l_claim_id", "r_claim_id")


@query
def report_files(spark, sf):
    normalized = stage(corpus_normalized(spark, sf), "normalized")
    found = stage(found_conflicts(normalized), "found")
    return reports.report_files(found, pairing.evidence_files(normalized))


@query
def report_evidence(spark, sf):
    # What pairing and references read, so that nothing else is shuffled and staged.
    read = [*pairing.MERGE_KEY, *pairing.MERGED, *extract.CLAIM_ORDER, "evidence_text"]
    normalized = stage(corpus_normalized(spark, sf).select(*read), "normalized")
    found = pairing.staged_conflicts(found_pairable(normalized))
    rows = reports.report_evidence(found, pairing.merged_evidence(normalized, stored=True), stored=True)
    return rows.select("session_id", "conflict_id", "ref_id", "side", "file_path", "text")


@query
def evidence_counts(spark, sf):
    """References and files behind each side of a conflict, from factors that are not expanded."""
    normalized = stage(corpus_normalized(spark, sf), "normalized")
    return reports.evidence_of(found_conflicts(normalized), normalized).counts()


@query
def domain_claims(spark, sf):
    rows = stage(corpus_claims(spark, sf), "claims")
    files = corpus.snippets(spark, sf).select(
        "session_id", F.col("file_path").alias("path"), F.col("change_seq").alias("seq"),
        F.col("change_id").alias("branch_name"),
    )
    by_file = files_ops.branch_by_file(files)
    fallback = files.groupBy("session_id").agg(
        F.min_by("branch_name", "seq").alias("fallback_branch")
    )
    return reports.domain_claims(rows, by_file, fallback).drop(*extract.CLAIM_ORDER)


@query
def findings(spark, sf):
    rows = stage(corpus_claims(spark, sf), "claims")
    found = found_conflicts(normalize.normalize(rows), texts=True)
    table = reports.findings(reports.explain(found), reports.statement_ids(rows))
    return table.select(
        "session_id", "conflict_id", "title", "description", "severity", "category",
        F.array_join("affected_claim_ids", "|").alias("affected_claim_ids"),
    )


@query
def finding_status(spark, sf):
    rows = stage(corpus_claims(spark, sf), "claims")
    found = found_conflicts(normalize.normalize(rows), texts=True)
    table = reports.findings(reports.explain(found), reports.statement_ids(rows))
    return summary.finding_status(corpus.sessions(spark, sf), table)


@query
def display_conflicts(spark, sf):
    shown = reports.display_rows(
        reports.explain(corpus_conflicts(spark, sf, texts=True)), corpus.sessions(spark, sf)
    )
    return shown.select(
        "session_id", "conflict_id", "kind", "severity", "confidence", "requirement_text",
        F.col("claim_a.id").alias("claim_a"), F.col("claim_a.source_file").alias("file_a"),
        F.col("claim_b.id").alias("claim_b"), F.col("claim_b.produced_by").alias("produced_by_b"),
        F.col("excerpts")[0]["snippet"].alias("snippet_a"),
    )


@query
def top_conflicts(spark, sf):
    ordered = reports.with_order(corpus_conflicts(spark, sf))
    return ordered.select("session_id", "severity_order", "id_order", "conflict_id", "severity")


@query
def conflict_groups(spark, sf):
    return summary.conflict_groups(pairing.merge_claims(corpus_normalized(spark, sf), texts=False))


@query
def high_conflicts(spark, sf):
    found = corpus_conflicts(spark, sf).filter("severity = 'HIGH'")
    return found.select("session_id", "conflict_id", "conflict_type", "severity_rule")


@query
def severity_counts(spark, sf):
    merged = pairing.merge_claims(corpus_normalized(spark, sf), texts=False)
    return summary.severity_counts(
        corpus.sessions(spark, sf), summary.conflict_counts(merged)
    )


@query
def session_results(spark, sf):
    rows = stage(corpus_claims(spark, sf), "claims")
    merged = pairing.merge_claims(normalize.normalize(rows), texts=False)
    return summary.session_results(
        corpus.sessions(spark, sf), summary.claim_counts(rows), summary.conflict_counts(merged)
    )


def corpus_criteria(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptance criteria projected from orders and customers."""
    return corpus.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"),
        F.col("o_orderkey").alias("criterion_key"),
        F.expr(corpus.CRITERION).alias("description"),
    )


@query
def covered_criteria(spark, sf):
    return summary.covered_criteria(corpus_criteria(spark, sf), corpus_claims(spark, sf))


@query
def requirement_coverage(spark, sf):
    covered = summary.covered_criteria(corpus_criteria(spark, sf), corpus_claims(spark, sf))
    return summary.coverage(corpus.sessions(spark, sf), covered)


def corpus_paths(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.snippets(spark, sf).select("session_id", F.col("file_path").alias("path")).distinct()


def corpus_passports(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(corpus_claims(spark, sf), "claims")
    normalized = normalize.normalize(rows)
    pairable = found_pairable(normalized)
    found = pairing.conflicts_from_pairable(pairable)
    files = reports.report_files(found, pairing.evidence_files(normalized))
    paths = corpus_paths(spark, sf)
    sessions = corpus.sessions(spark, sf)
    results = summary.session_results(
        sessions, summary.claim_counts(rows), summary.counts_of_pairable(pairable)
    )
    changed = paths.groupBy("session_id").agg(F.count("*").alias("files_changed"))
    return summary.passports(sessions, results, changed, summary.components(files, paths))


@query
def passports(spark, sf):
    return corpus_passports(spark, sf).select(
        "passport_id", "session_id", "intent", "files_changed", "n_components", "claims_found",
        "conflicts_found", "remaining_risk", "status",
    )


@query
def passport_components(spark, sf):
    """Names of the components that each passport counts, one row each."""
    normalized = stage(corpus_normalized(spark, sf), "normalized")
    found = stage(found_conflicts(normalized), "found")
    files = reports.report_files(found, pairing.evidence_files(normalized))
    return summary.components(files, corpus_paths(spark, sf))


@query
def verification_summaries(spark, sf):
    # What counting and coverage read, so that nothing else is shuffled and staged.
    read = ["session_id", *extract.CLAIM_ORDER, "claim_id", "subject", "predicate", "statement", "source_type", "source_file"]
    rows = stage(corpus_claims(spark, sf).select(*read), "claims")
    merged = pairing.merge_claims(normalize.normalize(rows), texts=False)
    sessions = corpus.sessions(spark, sf)
    changed = corpus_paths(spark, sf).groupBy("session_id").agg(F.count("*").alias("files_changed"))
    covered = summary.coverage(sessions, summary.covered_criteria(corpus_criteria(spark, sf), rows))
    return summary.verification_summary(
        sessions, summary.claim_counts(rows), summary.conflict_counts(merged), changed, covered
    )


@query
def passport_texts(spark, sf):
    return summary.passport_text(corpus_passports(spark, sf))


def _shown_with_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    normalized = stage(corpus_normalized(spark, sf), "normalized")
    found = stage(found_conflicts(normalized, texts=True), "found")
    return reports.explain(found), reports.report_files(found, pairing.evidence_files(normalized))


@query
def graph_nodes(spark, sf):
    shown, files = _shown_with_files(spark, sf)
    return graph.nodes(corpus.sessions(spark, sf), corpus.changes(spark, sf), shown, files)


@query
def graph_edges(spark, sf):
    shown, files = _shown_with_files(spark, sf)
    return graph.edges(corpus.changes(spark, sf), shown, files)


# --- diffs and code evidence -----------------------------------------------------


@query
def diff_files(spark, sf):
    files = diffs.diff_files(corpus.raw_diffs(spark, sf))
    return files.select(
        "session_id", "diff_id", "branch_name", "file_idx", "path", "previous_path", "kind",
        "is_binary", "additions", "deletions", "patch", F.size("hunks").alias("n_hunks"),
    )


@query
def diff_hunks(spark, sf):
    files = diffs.diff_files(corpus.raw_diffs(spark, sf))
    return diffs.diff_hunks(files, "diff_id", "file_idx").drop("added", "removed")


@query
def diff_lines(spark, sf):
    return diffs.diff_lines(diffs.diff_files(corpus.raw_diffs(spark, sf)), "diff_id", "file_idx")


def exported_diffs(spark: SparkSession, sf: str) -> str:
    """A folder of exported diff files; each raw diff in them begins with a header of its own."""
    path = scratch(spark, "exports")
    raws = corpus.raw_diffs(spark, sf).select(F.concat(F.expr(corpus.EXPORT_HEADER), "raw").alias("text"))
    tables.write_texts(raws, path)
    return path


@query
def split_diff_files(spark, sf):
    """Exported diff files, read by splits: files of all diffs, whichever file they stand in."""
    files = diffs.parse_chunk(tables.read_split_diffs(spark, exported_diffs(spark, sf)))
    # The writer ends the last line of a file, which the last diff may have ended itself.
    return files.select(
        "path", "previous_path", "kind", "is_binary", "additions", "deletions", F.size("hunks").alias("n_hunks"),
        F.md5(F.rtrim("patch", F.lit("\n"))).alias("patch_md5"),
    )


@query
def repository_contexts(spark, sf):
    """Suppliers as sessions on shared repositories, orders as their ref log, line items as changed files."""
    changed = corpus.changed_files(spark, sf).withColumn("previous_path", F.lit(None).cast("string"))
    found = context.repository_context(corpus.repository_sessions(spark, sf), corpus.ref_log(spark, sf), changed)
    n_files = found.changed_files.groupBy("session_id").agg(F.count("*").alias("n_files"))
    n_evidence = found.evidence.groupBy("session_id").agg(F.count("*").alias("n_evidence"))
    shown = F.transform("feature_branches", lambda b: F.concat(b["name"], F.lit("@"), b["sha"]))
    rows = found.source.join(n_files, "session_id", "left").join(n_evidence, "session_id", "left")
    return rows.select(
        "session_id", "name", "clone_url", "provider", F.col("base_branch.sha").alias("base_sha"),
        F.array_join(shown, "|").alias("features"), F.date_format("resolved_at", "yyyy-MM-dd").alias("resolved_on"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
    )


@query
def languages(spark, sf):
    files = corpus.changed_files(spark, sf)
    return (
        files.withColumn("language", diffs.language(F.col("path")))
        .groupBy("language")
        .agg(F.count("*").alias("n_files"))
    )


def _metadata_text(column: str = "metadata"):
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


@query
def code_evidence(spark, sf):
    files = diffs.diff_files(corpus.raw_diffs(spark, sf))
    rows = evidence.from_diffs(files, "diff_id", "file_idx", "branch_name")
    return rows.withColumn("metadata", _metadata_text())


def corpus_changed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Changed files shredded from the raw diffs, ordered by diff and file."""
    files = diffs.changed_files(corpus.raw_diffs(spark, sf))
    return files.withColumn("seq", F.struct("diff_id", "file_idx")).drop("diff_id", "file_idx")


@query
def patch_evidence(spark, sf):
    rows = evidence.from_changed_files(corpus_changed_files(spark, sf))
    return rows.select(
        F.col("seq.diff_id").alias("diff_id"), F.col("seq.file_idx").alias("file_idx"),
        "file_path", "evidence_idx", "line_start", "line_end", "snippet",
        _metadata_text().alias("metadata"),
    )


@query
def comparison_snippets(spark, sf):
    rows = evidence.comparison_snippets(corpus_changed_files(spark, sf))
    return rows.select(
        F.col("seq.diff_id").alias("diff_id"), F.col("seq.file_idx").alias("file_idx"),
        "file_path", "hunk_idx", "line_start", "line_end", "snippet", "source",
    )


# --- changed files ---------------------------------------------------------------


@query
def files_deduped(spark, sf):
    kept = files_ops.dedupe(corpus.changed_files(spark, sf))
    return kept.select(
        "session_id", "branch_name", "path",
        F.col("seq.l_orderkey").alias("first_order"), F.col("seq.l_linenumber").alias("first_line"),
        F.md5("patch").alias("patch_md5"),
    )


@query
def files_forwarded(spark, sf):
    rows = files_ops.forwarded(files_ops.dedupe(corpus.changed_files(spark, sf)))
    return rows.select(
        "session_id", "branch_name", "path",
        F.col("seq.l_orderkey").alias("first_order"), F.col("seq.l_linenumber").alias("first_line"),
        F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"),
    )


@query
def ingestion_warnings(spark, sf):
    files = files_ops.dedupe(corpus.changed_files(spark, sf))
    return files_ops.patch_warnings(files)


@query
def diff_limits(spark, sf):
    return files_ops.sizes(corpus.changed_files(spark, sf))


@query
def files_changed(spark, sf):
    return files_ops.files_changed(corpus.changed_files(spark, sf))


@query
def branch_by_file(spark, sf):
    return files_ops.branch_by_file(corpus.changed_files(spark, sf))


@query
def head_comparisons(spark, sf):
    heads = corpus.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("session_id"),
        F.explode(F.array(*map(F.lit, ["feature/a", "feature/n", "feature/r", "feature/idle"]))).alias("branch_name"),
    )
    return files_ops.by_head(heads, corpus.changed_files(spark, sf))


@query
def head_files(spark, sf):
    heads = corpus.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("session_id"),
        F.explode(F.array(*map(F.lit, ["feature/a", "feature/n", "feature/r", "feature/idle"]))).alias("branch_name"),
    )
    files = files_ops.head_files(heads, files_ops.dedupe(corpus.changed_files(spark, sf)))
    return files.select("session_id", "branch_name", "path", F.md5("patch").alias("patch_md5"))


@query
def ordered_branches(spark, sf):
    declared = corpus.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("session_id"),
        F.posexplode(F.array(F.lit("feature/r"), F.lit("feature/a"))).alias("declared_seq", "branch_name"),
    )
    rows = files_ops.ordered_branches(declared, corpus.changed_files(spark, sf))
    return rows.select(
        "session_id", "branch_name", "declared_seq", F.col("first_seq.l_orderkey").alias("first_order")
    )


# --- analyser responses ----------------------------------------------------------


@query
def json_claims(spark, sf):
    read = agents.read_responses(corpus.responses(spark, sf))
    return agents.with_ids(agents.claims(read))


@query
def json_rejects(spark, sf):
    return agents.warnings(agents.read_responses(corpus.responses(spark, sf)))


@query
def agent_lines(spark, sf):
    read = agents.read_responses(corpus.responses(spark, sf))
    texts = agents.claim_text(agents.claims(read))
    return agents.unique_lines(texts, ["response_id", "item_idx"])


@query
def dedup_lines(spark, sf):
    turns = corpus.table(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id")
    return agents.unique_lines(turns, ["turn"])


@query
def document_lines(spark, sf):
    docs = corpus.table(spark, sf, "documents").withColumnRenamed("source", "session_id")
    kept = agents.unique_lines(docs, ["doc_id"])
    return kept.groupBy("session_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"),
        F.max("line_idx").alias("max_line_idx"),
    )


@query
def capped_texts(spark, sf):
    docs = corpus.table(spark, sf, "documents").select("doc_id", "text")
    parts = agents.text_parts(docs, "doc_id")
    return parts.select("doc_id", "part", F.length("content").alias("n_chars"), F.md5("content").alias("part_md5"))


# --- references and lifecycle ----------------------------------------------------


@query
def repo_urls(spark, sf):
    pages = corpus.table(spark, sf, "pages").select("page_id", F.expr(corpus.REPO_URL).alias("url"))
    return refs.parse_repository(pages)


@query
def ref_names(spark, sf):
    parts = corpus.table(spark, sf, "part").select("p_partkey", F.expr(corpus.REF_NAME).alias("ref"))
    return parts.select(
        "p_partkey", "ref", refs.ref_error(F.col("ref"), "branch").alias("error"),
        refs.is_branch_name(F.col("ref")).alias("is_branch"),
    )


@query
def branch_hash(spark, sf):
    names = corpus.table(spark, sf, "customer").select("c_custkey", "c_name")
    return names.select("c_custkey", refs.synthetic_sha(F.col("c_name")).alias("sha"))


@query
def session_status(spark, sf):
    status = lifecycle.latest_status(corpus.status_events(spark, sf))
    return status.select("session_id", "status", "n_events")


@query
def status_log(spark, sf):
    """Status events as a stream of files, folded into a log, compacted and read."""
    root = scratch(spark, "status")
    events = corpus.status_events(spark, sf)
    events.write.parquet(f"{root}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events")
    feed.status_stream(stream, f"{root}/checkpoint", f"{root}/status", compact_every=2).awaitTermination()
    return feed.current_status(spark, f"{root}/status").select("session_id", "status", "event_id", "n_events")


@query
def checked_files(spark, sf):
    """Changed files written under checks that run in the writing job, and read back."""
    path = scratch(spark, "checked")
    rows = corpus.changed_files(spark, sf).withColumns(
        {"previous_path": F.lit(None).cast("string"), "additions": F.lit(1), "deletions": F.lit(0)}
    )
    checks.write_checked(rows, checks.changed_file_checks, path, "ChangedFile")
    return tables.read_changed_files(spark, path).groupBy("session_id", "branch_name").agg(
        F.count("*").alias("n_files"), F.count_distinct("path").alias("n_paths")
    )


@query
def session_stages(spark, sf):
    return lifecycle.stage_rows(lifecycle.latest_status(corpus.status_events(spark, sf)))


@query
def merge_attestations(spark, sf):
    notes = corpus.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("note")
    )
    judged = lifecycle.attest(notes, lifecycle.latest_status(corpus.status_events(spark, sf)))
    return judged.select("session_id", "turn", "error", F.md5("note").alias("note_md5"))


# --- checks ----------------------------------------------------------------------


@query
def input_errors(spark, sf):
    changes = corpus.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("change_seq"),
        F.expr(corpus.FLAWED_CHANGE_ID).alias("change_id"),
        F.expr(corpus.FLAWED_LABEL).alias("label"), F.expr(corpus.FLAWED_CONTENT).alias("content"),
    )
    return checks.input_errors(corpus.sessions(spark, sf), changes)


@query
def claim_errors(spark, sf):
    rows = corpus_claims(spark, sf).withColumns(
        {
            "confidence": F.when(F.col("rule_idx") == 3, "SURE").otherwise(F.col("confidence")),
            "subject": F.when(F.col("rule_idx") == 9, " ").otherwise(F.col("subject")),
        }
    )
    return checks.claim_errors(rows, ["session_id", "claim_id"])


@query
def evidence_errors(spark, sf):
    rows = corpus.record(spark, sf, "lineitem", corpus.EVIDENCE_RECORD)
    return checks.record_errors(rows, ["id"], checks.code_evidence_checks)


@query
def changed_file_errors(spark, sf):
    rows = corpus.record(spark, sf, "lineitem", corpus.CHANGED_FILE_RECORD)
    return checks.record_errors(rows, ["id"], checks.changed_file_checks)


@query
def finding_errors(spark, sf):
    rows = corpus.record(spark, sf, "orders", corpus.FINDING_RECORD)
    ids = F.array_repeat(F.col("id"), F.col("affected"))
    return checks.record_errors(
        rows.withColumn("affected_claim_ids", ids), ["id"], checks.finding_checks
    )


@query
def result_errors(spark, sf):
    rows = corpus.record(spark, sf, "orders", corpus.RESULT_RECORD)
    return checks.record_errors(rows, ["id"], checks.result_checks)


# --- whole flows -----------------------------------------------------------------


def corpus_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Two declared branches per session; a third one only appears in the diffs."""
    declared = F.array(F.lit("feature/1"), F.lit("feature/0"))
    return corpus.sessions(spark, sf).select(
        "session_id", F.posexplode(declared).alias("declared_seq", "branch_name")
    )


@query
def repository_verdicts(spark, sf):
    """Raw diffs to verdicts: shred, dedupe, extract, group and report."""
    inputs = verify.from_diffs(
        corpus.sessions(spark, sf), corpus_branches(spark, sf), corpus.raw_diffs(spark, sf)
    )
    return verify.verify(inputs).results


@query
def text_verdicts(spark, sf):
    """Pasted texts to verdicts: every snippet of an order as its own change."""
    rows = corpus.snippets(spark, sf)
    texts = rows.select(
        "session_id", (F.col("change_seq") * 2 + F.col("snippet_seq")).alias("change_seq"),
        F.concat("change_id", F.lit("-"), "snippet_seq").alias("change_id"),
        F.lit("text").alias("label"), "content",
        F.when(F.col("snippet_seq") == 0, F.col("file_path")).alias("file_path"),
    )
    return verify.verify(verify.from_texts(corpus.sessions(spark, sf), texts)).results


@query
def analyser_verdicts(spark, sf):
    """Claims found by analysers to verdicts: lines of their findings are read again by the rules."""
    inputs = verify.from_analysers(corpus.sessions(spark, sf), corpus.responses(spark, sf))
    return verify.verify(inputs).results


@query
def changed_file_verdicts(spark, sf):
    """Pre-parsed changed files to verdicts, one session per supplier."""
    sessions = corpus.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("session_id"), F.lit("Only owners can refund orders.").alias("requirement_text")
    )
    declared = F.array(F.lit("feature/r"), F.lit("feature/a"))
    branches = sessions.select("session_id", F.posexplode(declared).alias("declared_seq", "branch_name"))
    files = corpus.changed_files(spark, sf).withColumn("patch", F.expr(corpus.SPOKEN_PATCH))
    return verify.verify(verify.from_changed_files(sessions, branches, files)).results


@query
def stream_conflicts(spark, sf):
    """The corpus as a stream of units, verified batch by batch."""
    root = scratch(spark, "feed")
    units = corpus_units(spark, sf)
    units.write.parquet(f"{root}/units", compression="zstd")
    stream = spark.readStream.schema(units.schema).parquet(f"{root}/units")
    feed.verify_stream(stream, root, f"{root}/checkpoint", available_now=True).awaitTermination()
    return feed.current_conflicts(spark, root, texts=False).select(
        "session_id", "conflict_id", "conflict_type", "l_value", "r_value", "severity"
    )


# --- further operators -----------------------------------------------------------


@query
def norm_traces(spark, sf):
    return normalize.trace_rows(corpus_normalized(spark, sf))


@query
def change_contents(spark, sf):
    inputs = verify.from_diffs(
        corpus.sessions(spark, sf), corpus_branches(spark, sf), corpus.raw_diffs(spark, sf)
    )
    return inputs.changes


@query
def conflict_resolutions(spark, sf):
    shown = reports.explain(corpus_conflicts(spark, sf, texts=True))
    proposed = F.when(F.col("severity") == "MEDIUM", F.concat(F.lit("Agree on "), "affected_entity"))
    table = shown.withColumn("proposed_resolution", proposed)
    return table.select("session_id", "conflict_id", reports.resolution().alias("resolution"))


@query
def candidate_stats(spark, sf):
    candidates = corpus.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.expr(corpus.CANDIDATE_STATUS).alias("status")
    )
    return summary.candidate_stats(candidates)


@query
def result_stats(spark, sf):
    candidates = corpus.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.expr(corpus.CANDIDATE_STATUS).alias("status")
    )
    rows = stage(corpus_claims(spark, sf), "claims")
    counts = summary.conflict_counts(pairing.merge_claims(normalize.normalize(rows), texts=False))
    return summary.result_stats(
        corpus.sessions(spark, sf), summary.claim_counts(rows), summary.candidate_stats(candidates), counts
    )


@query
def dependency_errors(spark, sf):
    rows = corpus.record(spark, sf, "lineitem", corpus.DEPENDENCY_RECORD)
    return checks.record_errors(rows, ["line"], checks.dependency_checks)


@query
def summary_errors(spark, sf):
    rows = corpus.record(spark, sf, "orders", corpus.SUMMARY_RECORD)
    return checks.record_errors(rows, ["id"], checks.summary_checks)


@query
def conflict_errors(spark, sf):
    """Conflict records with flawed columns: no entity, no evidence, unread time."""

    def side(prefix: str):
        return F.struct(
            F.col(f"{prefix}_claim_id").alias("claim_id"), F.col(f"{prefix}_statement").alias("statement"),
            F.col("canonical_subject").alias("subject"), F.col(f"{prefix}_predicate").alias("predicate"),
            F.col(f"{prefix}_source_type").alias("source_type"),
            F.col(f"{prefix}_evidence_text").alias("evidence_text"), F.lit("HIGH").alias("confidence"),
        )

    def reference(prefix: str):
        return F.struct(
            F.concat(f"{prefix}_claim_id", F.lit("__primary")).alias("ref_id"),
            F.col(f"{prefix}_source_type").alias("source_type"),
            F.lit(None).cast("struct<start:int,end:int>").alias("line_range"),
            F.when(F.col("canonical_key") == "must_be", " ").otherwise(F.col(f"{prefix}_evidence_text")).alias("text"),
        )

    found = corpus_conflicts(spark, sf, texts=True)
    evidence_of = F.when(F.col("conflict_type") == "DEPENDENCY", F.array().cast(
        "array<struct<ref_id:string,source_type:string,line_range:struct<start:int,end:int>,text:string>>"
    )).otherwise(F.array(reference("l"), reference("r")))
    table = found.select(
        "session_id", "conflict_id", "conflict_type", "severity", "confidence",
        F.lit("text").alias("explanation"),
        F.when(F.col("severity") == "MEDIUM", "").otherwise(F.col("canonical_subject")).alias("affected_entity"),
        evidence_of.alias("evidence"),
        F.when(F.col("confidence") == "LOW", "yesterday").otherwise("2024-08-01T12:00:00Z").alias("confirmed_at"),
        side("l").alias("left"), side("r").alias("right"),
    )
    return checks.conflict_errors(table, ["session_id", "conflict_id"])


@query
def unknown_claim_ids(spark, sf):
    """Claim ids named by findings but not in a claim list that lost its rule-2 claims."""
    rows = stage(corpus_claims(spark, sf), "claims")
    found = found_conflicts(normalize.normalize(rows), texts=True)
    table = reports.findings(reports.explain(found), reports.statement_ids(rows))
    known = rows.filter("rule_idx <> 2").select(F.col("session_id").alias("result_id"), "claim_id")
    missing = checks.unknown_claim_ids(
        table.select(F.col("session_id").alias("result_id"), "affected_claim_ids"), known
    )
    return missing.distinct()


# --- operators on their own ------------------------------------------------------


@query
def branch_files(spark, sf):
    files = files_ops.of_branch(corpus.changed_files(spark, sf), "feature/r")
    return files.select("session_id", F.col("seq.l_orderkey").alias("l_orderkey"), F.col("seq.l_linenumber").alias("l_linenumber"), "path")


@query
def dropped_subjects(spark, sf):
    return normalize.dropped(corpus_normalized(spark, sf))


@query
def light_claims(spark, sf):
    return normalize.tidy(corpus_claims(spark, sf)).select(
        "session_id", "claim_id", "subject", "predicate", "statement", "evidence_text"
    )


@query
def coverage_fractions(spark, sf):
    covered = summary.covered_criteria(corpus_criteria(spark, sf), corpus_claims(spark, sf))
    rows = summary.coverage(corpus.sessions(spark, sf), covered)
    return rows.select(
        "session_id", summary.fraction(F.col("covered"), F.nullif(F.col("criteria"), F.lit(0))).alias("fraction"),
        summary.coverage_ok(F.col("requirement_coverage")).alias("enough"),
    )


@query
def criterion_errors(spark, sf):
    return checks.record_errors(corpus.record(spark, sf, "part", corpus.CRITERION_RECORD), ["id"], checks.criterion_checks)


@query
def branch_errors(spark, sf):
    return checks.record_errors(corpus.record(spark, sf, "customer", corpus.BRANCH_RECORD), ["id"], checks.branch_checks)


@query
def feature_request_errors(spark, sf):
    rows = corpus.record(spark, sf, "orders", {"key": "o_orderkey", **corpus.FEATURE_REQUEST_RECORD})
    return checks.record_errors(rows, ["key"], checks.feature_request_checks)


@query
def repository_errors(spark, sf):
    return checks.record_errors(corpus.record(spark, sf, "customer", corpus.REPOSITORY_RECORD), ["key"], checks.repository_checks)


def corpus_rule_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    """Which of two rule sets each session wants, and the sets compiled from their table."""
    chosen = corpus.customers(spark, sf, "c_custkey").select(F.col("c_custkey").alias("session_id"), F.expr(corpus.RULE_SET).alias("rule_set"))
    return chosen, rulebook.rule_sets(spark.createDataFrame(corpus.RULE_ROWS, rulebook.SCHEMA))


@query
def rule_set_matches(spark, sf):
    """Two rule sets from a table, each read on the sessions that chose it."""
    found = extract.rule_set_matches(corpus_units(spark, sf), *corpus_rule_sets(spark, sf))
    return found.select("rule_set", *extract.UNIT_KEY, "seg_idx", "rule_id", "category", "subject", "predicate", "statement", "confidence")


@query
def direct_verdicts(spark, sf):
    """Verdicts of a detector chosen by name: only values that exclude each other directly count."""
    inputs = verify.Inputs(corpus.sessions(spark, sf), corpus.changes(spark, sf), corpus.snippets(spark, sf), corpus.context_docs(spark, sf))
    return verify.verify(inputs, detector="direct").results.select("session_id", "claims_found", "conflicts_found", "status")


@query
def committed_results(spark, sf):
    """Nested results written as lines, read against a schema, committed twice under one id, and read again."""
    lines = corpus.orders(spark, sf, "o_orderkey", "o_custkey", "o_orderstatus").select(F.expr(corpus.RESULT_JSON).alias("text"))
    path, root = scratch(spark, "result-lines"), scratch(spark, "results")
    tables.write_texts(lines, path)
    good, corrupt = tables.read_records(spark, path, corpus.RESULT_SCHEMA)
    for _ in range(2):
        tables.commit_records(good, root, "results-1")
    read, unread = tables.read_records(spark, tables.committed(spark, root), corpus.RESULT_SCHEMA)
    rows = read.select(
        F.lit("good").alias("kind"), "id", "status", F.col("source.name").alias("name"),
        F.array_join("source.branches.name", "|").alias("branches"), F.col("counts")["high"].alias("high"),
        F.array_join(F.flatten("findings.claims"), "|").alias("claims"), F.md5(F.lit("")).alias("text_md5"),
    )
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:-1]]
    return rows.unionByName(corrupt.union(unread).select(F.lit("corrupt").alias("kind"), *none, F.md5("value").alias("text_md5")))


@query
def domain_claim_errors(spark, sf):
    rows = corpus.record(spark, sf, "orders", corpus.DOMAIN_CLAIM_RECORD)
    return checks.record_errors(rows, ["id"], checks.domain_claim_checks)


@query
def passport_draft_errors(spark, sf):
    return checks.record_errors(corpus.record(spark, sf, "orders", corpus.DRAFT_RECORD), ["id"], checks.passport_draft_checks)


@query
def candidate_errors(spark, sf):
    """Candidates whose sides are sound claims with subjects that may differ."""

    def side(subject: str):
        return F.struct(
            F.lit("c").alias("claim_id"), F.lit("s").alias("statement"), F.col(subject).alias("subject"), F.lit("p").alias("predicate"),
            F.lit("CODE_DIFF").alias("source_type"), F.lit("e").alias("evidence_text"), F.lit("HIGH").alias("confidence"),
        )

    rows = corpus.record(spark, sf, "orders", corpus.CANDIDATE_RECORD)
    return checks.candidate_errors(rows.withColumns({"left": side("left_subject"), "right": side("right_subject")}), ["id"])


@query
def miscounted_results(spark, sf):
    summaries = corpus.record(spark, sf, "orders", corpus.COUNTED_RECORD)
    lines = corpus.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("result_id"), "l_linenumber")
    return checks.miscounted(summaries, lines, lines.filter("l_linenumber = 2")).select(
        "result_id", "assumptions_found", "n_claims", "n_findings"
    )


@query
def public_rows(spark, sf):
    """Sessions written as JSON texts without secrets and read from them again."""
    rows = corpus.sessions(spark, sf).withColumn("agent_key", F.lit("k"))
    schema = "session_id bigint, requirement_text string, agent_key string"
    read = tables.public_json(rows).select(F.from_json("json", schema).alias("r")).select("r.*")
    return read.filter("agent_key is null").select("session_id", "requirement_text")


@query
def written_files(spark, sf):
    """Changed files written as a table and read back for one branch."""
    path = scratch(spark, "changed")
    tables.write_table(corpus.changed_files(spark, sf), path)
    files = tables.read_changed_files(spark, path, "feature/a")
    return files.select("session_id", F.col("seq.l_orderkey").alias("l_orderkey"), F.col("seq.l_linenumber").alias("l_linenumber"), F.md5("patch").alias("patch_md5"))
