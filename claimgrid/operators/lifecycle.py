"""Session status folded from an event log, stage rows and merge attestations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.text import nonblank, trim

# What a running stage shows.
STAGE_TEXTS = {
    "PENDING": "Session queued…",
    "INGESTING": "Fetching repository and extracting real diffs…",
    "RUNNING": "Analyzing changes…",
    "ANALYZING": "Extracting semantic assumptions…",
    "VERIFYING": "Checking assumptions for conflicts…",
}
RUNNING_STAGES = ["PENDING", "INGESTING", "ANALYZING", "VERIFYING"]


def latest_status(events: DataFrame) -> DataFrame:
    """Last status per session; ``event_id`` decides between equal times.

    Also valid on a stream in update mode: one status and its place per session.
    """
    place = F.struct("ts", "event_id")
    return events.groupBy("session_id").agg(
        F.max_by("status", place).alias("status"),
        F.max("ts").alias("updated_at"),
        F.count("*").alias("n_events"),
    )


def stage_rows(status: DataFrame) -> DataFrame:
    """Five stage rows per session: done, running or pending."""
    shown = F.when(F.col("status") == "RUNNING", "ANALYZING").otherwise(F.col("status"))
    at = F.greatest(
        F.lit(0),
        F.array_position(F.array(*map(F.lit, RUNNING_STAGES)), shown).cast("int") - 1,
    )
    rows = status.select(
        "session_id", "status", at.alias("stage_idx"),
        F.posexplode(F.array(*map(F.lit, fixed.AGENT_TYPES))).alias("idx", "stage"),
    )
    complete = F.col("status") == "COMPLETE"
    state = (
        F.when(complete | (F.col("idx") < F.col("stage_idx")), "COMPLETE")
        .when(F.col("idx") == F.col("stage_idx"), "RUNNING")
        .otherwise("PENDING")
    )
    text = F.lit("Working…")
    for name, shown_text in STAGE_TEXTS.items():
        text = F.when(F.col("status") == name, shown_text).otherwise(text)
    finding = F.when(F.col("state") == "RUNNING", text).when(
        (F.col("state") == "COMPLETE") & ~complete, "Done"
    )
    return rows.withColumn("state", state).select(
        "session_id", "idx", "stage", "state", finding.alias("finding")
    )


def attest(attestations: DataFrame, status: DataFrame) -> DataFrame:
    """Merge notes with the reason they are refused, null if accepted."""
    joined = attestations.join(status.select("session_id", "status"), "session_id", "left")
    error = (
        F.when(F.col("status").isNull(), "Session not found")
        .when(F.col("status") != "COMPLETE", "Only COMPLETE sessions can be marked as merged")
    )
    return joined.withColumns({"error": error, "note": nonblank(trim(F.col("note")))}).drop("status")
