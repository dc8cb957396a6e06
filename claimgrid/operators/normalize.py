"""Claims -> normalised claims with trace and evidence anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions.normal import (
    canonical_key,
    canonical_value,
    entity_reason,
    entity_synonym,
    entity_working,
    key_reason,
    plain_key,
    predicate_key,
    predicate_value,
    without_fillers,
)
from claimgrid.functions.text import strip_quotes, trim


def _step(field: Column | str, raw: str, canonical: str, why: Column) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.struct(
        name.alias("field"),
        F.col(raw).alias("raw_value"),
        F.col(canonical).alias("canonical_value"),
        why.alias("explanation"),
    )


def normalize(claims: DataFrame) -> DataFrame:
    """Add the canonical subject, key, value and predicate. Narrow.

    Built in small steps over plain columns: each intermediate is used several
    times, and Catalyst keeps such a step apart instead of repeating it.
    """
    kept = claims.filter(F.col("claim_id").isNotNull())
    parsed = kept.withColumns(
        {
            "working": entity_working(F.col("subject")),
            "plain_key": plain_key(predicate_key(F.col("predicate"))),
            "raw_value": predicate_value(F.col("predicate")),
        }
    )
    bare = parsed.withColumn("bare_value", strip_quotes(F.col("raw_value")))
    looked_up = bare.withColumns(
        {
            "synonym": entity_synonym(F.col("working")),
            "canonical_key": canonical_key(F.col("plain_key")),
            "value": canonical_value(F.col("bare_value")),
        }
    )
    named = looked_up.withColumn(
        "canonical_subject", F.coalesce("synonym", without_fillers(F.col("working")), F.lit(""))
    )
    predicate = F.when(
        F.col("value") != "", F.concat("canonical_key", F.lit(" = "), "value")
    ).otherwise(F.col("canonical_key"))
    return named.select(
        *claims.columns,
        "canonical_subject",
        F.coalesce("canonical_key", F.lit("")).alias("canonical_key"),
        F.nullif(F.col("value"), F.lit("")).alias("canonical_value"),
        F.coalesce(predicate, F.lit("")).alias("canonical_predicate"),
        entity_reason(F.col("subject"), F.col("synonym"), F.col("canonical_subject")).alias("subject_why"),
        key_reason(F.col("plain_key"), F.col("canonical_key")).alias("key_why"),
        F.when(
            (F.col("raw_value") != "") & (F.col("value") != F.col("raw_value")),
            F.concat(
                F.lit("Value normalized: '"), "raw_value", F.lit("' → '"), "value", F.lit("'")
            ),
        ).alias("value_why"),
    )


def with_trace(normalized: DataFrame) -> DataFrame:
    """Array of normalisation steps. A predicate note that mentions a value is a
    value step; notes are told apart at ``'; '``, also inside a value."""
    notes = F.concat_ws("; ", "key_why", "value_why")
    parts = F.when(notes != "", F.split(notes, "; ")).otherwise(F.array().cast("array<string>"))
    subject = F.when(
        F.col("subject_why").isNotNull(),
        F.array(_step("subject", "subject", "canonical_subject", F.col("subject_why"))),
    ).otherwise(F.array().cast("array<struct<field:string,raw_value:string,canonical_value:string,explanation:string>>"))
    predicate = F.transform(
        parts,
        lambda part: _step(
            F.when(F.contains(F.lower(part), F.lit("value")), "value").otherwise("predicate"),
            "predicate",
            "canonical_predicate",
            part,
        ),
    )
    return normalized.withColumn("trace", F.concat(subject, predicate))


def trace_rows(normalized: DataFrame) -> DataFrame:
    """The normalisation steps of every claim, one row each."""
    traced = with_trace(normalized)
    # Outer, because the inner generator makes Catalyst infer a filter that normalises every claim again.
    steps = traced.select("session_id", "claim_id", F.posexplode_outer("trace").alias("step", "t"))
    return steps.filter("step is not null").select("session_id", "claim_id", "step", "t.*")


def primary_reference() -> Column:
    """A claim's own evidence reference."""
    return F.struct(
        F.concat("claim_id", F.lit("__primary")).alias("ref_id"),
        F.col("source_type").alias("source_type"),
        F.col("source_file").alias("file_path"),
        F.lit(None).cast("struct<start:int,end:int>").alias("line_range"),
        F.col("evidence_text").alias("text"),
        F.lit(None).cast("string").alias("label"),
    )


def references(normalized: DataFrame) -> DataFrame:
    """The evidence anchor: own reference first, then any supporting ones."""
    refs = F.array(primary_reference())
    if "supporting_evidence" in normalized.columns:
        refs = F.concat(refs, F.coalesce("supporting_evidence", F.array()))
    return normalized.withColumn("refs", refs)


def dropped(normalized: DataFrame) -> DataFrame:
    """Claims whose subject normalised to nothing; pairing skips them."""
    return normalized.filter(F.col("canonical_subject") == "").select(
        "session_id", "claim_id", "subject"
    )


def tidy(claims: DataFrame) -> DataFrame:
    """Light form: texts trimmed, the subject also lower-cased."""
    trimmed = {c: trim(F.col(c)) for c in ["statement", "predicate", "evidence_text"]}
    return claims.withColumns({**trimmed, "subject": F.lower(trim(F.col("subject")))})
