"""Repository contexts: refs resolved as of a session's time, files, evidence, source record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgrid.operators import evidence, files

REF_KEY = ["repository", "branch_name"]
# Seconds of a bucket of the ref log.
BUCKET_SECONDS = 7 * 24 * 3600


@dataclass(frozen=True)
class Context:
    """What a verification of repositories reads: records, files and evidence."""

    source: DataFrame
    changed_files: DataFrame
    evidence: DataFrame


def _bucket(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(time) / seconds)


def refs_as_of(wanted: DataFrame, log: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``wanted`` with ``sha``: the last entry of its branch at or before ``at``, null if there is none.

    ``wanted(repository, branch_name, at, ...)`` and ``log(repository, branch_name, ts,
    event_id, sha)``; ``event_id`` decides between equal times. The time line of a
    branch is cut into buckets. Inside a bucket wanted rows and log entries are put in
    order together and the last sha is carried along, so a busy branch costs its rows
    and no pairs, and its buckets go to many tasks. What holds when a bucket begins
    is the last entry of an earlier bucket: one closing row a bucket is kept for that,
    so the window over a whole branch holds buckets, not entries.
    """
    asked = wanted.withColumn("_bucket", _bucket(F.col("at"), seconds))
    entries = log.select(*REF_KEY, "ts", "event_id", "sha").withColumn("_bucket", _bucket(F.col("ts"), seconds))
    closing = entries.groupBy(*REF_KEY, "_bucket").agg(F.max_by("sha", F.struct("ts", "event_id")).alias("closing"))
    buckets = closing.join(asked.select(*REF_KEY, "_bucket").distinct(), [*REF_KEY, "_bucket"], "full")
    earlier = Window.partitionBy(*REF_KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    opening = buckets.select(*REF_KEY, "_bucket", F.last("closing", ignorenulls=True).over(earlier).alias("_opening"))

    rows = asked.select(*REF_KEY, "_bucket", F.col("at").alias("_ts"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_event"),
                        F.lit(None).cast("string").alias("_sha"), F.struct(*wanted.columns).alias("_row"))
    none = F.lit(None).cast(rows.schema["_row"].dataType)
    both = rows.unionByName(entries.select(
        *REF_KEY, "_bucket", F.col("ts").alias("_ts"), F.lit(0).alias("_kind"), F.col("event_id").cast("long").alias("_event"),
        F.col("sha").alias("_sha"), none.alias("_row"),
    ))
    so_far = Window.partitionBy(*REF_KEY, "_bucket").orderBy("_ts", "_kind", "_event").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_inside", F.last("_sha", ignorenulls=True).over(so_far)).filter("_kind = 1")
    return inside.join(opening, [*REF_KEY, "_bucket"], "left").select(
        "_row.*", F.coalesce("_inside", "_opening").alias("sha")
    )


def known(refs: DataFrame) -> DataFrame:
    """``refs``, failing the job at the first branch without a sha."""
    message = F.concat(F.lit("unknown branch: "), "branch_name", F.lit(" of "), "repository")
    return refs.withColumn("sha", F.coalesce("sha", F.raise_error(message).cast("string")))


def repository_context(sessions: DataFrame, log: DataFrame, changed: DataFrame) -> Context:
    """Resolve refs, gather the files of all feature branches, dedupe, build evidence, stamp a record.

    ``sessions(session_id, repository, clone_url, provider, base_branch, feature_branches,
    at)``, the ref log of ``refs_as_of``, and ``changed(session_id, seq, branch_name,
    path, kind, previous_path, patch)``. A session without feature branches and a
    branch that the log doesn't know fail the job. The record is one row a session;
    its branches stay the array that the session declared, with their shas.
    """
    empty = F.coalesce(F.size("feature_branches") <= 0, F.lit(True))
    message = F.lit("at least one feature branch name is required")
    declared = F.when(empty, F.raise_error(message).cast("array<string>")).otherwise(F.col("feature_branches"))
    names = F.concat(F.array("base_branch"), declared)
    wanted = sessions.select("session_id", "repository", "at", F.posexplode(names).alias("place", "branch_name"))
    refs = known(refs_as_of(wanted, log))
    branch = F.struct(F.col("branch_name").alias("name"), "sha")
    listed = refs.groupBy("session_id").agg(
        F.max(F.when(F.col("place") == 0, branch)).alias("base_branch"),
        F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", branch.alias("branch"))))).alias("listed"),
    )
    source = sessions.drop("base_branch", "feature_branches", "at").join(listed, "session_id").select(
        "session_id", F.col("repository").alias("name"), "clone_url", F.coalesce("provider", F.lit("local")).alias("provider"),
        "base_branch", F.transform("listed", lambda b: b["branch"]).alias("feature_branches"),
    ).join(sessions.select("session_id", F.col("at").alias("resolved_at")), "session_id")
    features = refs.filter("place > 0").select("session_id", "branch_name").distinct()
    kept = files.dedupe(changed.join(features, ["session_id", "branch_name"], "left_semi"))
    return Context(source, kept, evidence.from_changed_files(kept))
