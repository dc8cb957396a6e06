"""Small inputs for engine tests."""

from pyspark.sql import functions as F

SESSIONS = "session_id string, requirement_text string"
TEXTS = (
    "session_id string, change_seq bigint, change_id string, label string, content string, "
    "file_path string"
)
UNITS = (
    "session_id string, part int, change_seq bigint, snippet_seq int, unit_id string, text string, "
    "category_hint string, source_file string"
)


def units(spark, *texts, session="s", hint=None, file=None):
    rows = [(session, 1, i, 0, f"u{i}", t, hint, file) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, UNITS)


def inputs(spark, session_texts, requirement="Add organization billing."):
    """``session -> [(label, file path, content)]`` as engine inputs of pasted texts."""
    from claimgrid.plans import verify

    sessions = spark.createDataFrame([(s, requirement) for s in session_texts], SESSIONS)
    rows = [
        (s, i, f"change-{i}", label, content, path)
        for s, texts in session_texts.items()
        for i, (label, path, content) in enumerate(texts)
    ]
    return verify.from_texts(sessions, spark.createDataFrame(rows, TEXTS))


def rows(df, *columns):
    """Sorted tuples of the given columns."""
    shown = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in shown.collect()), key=str)


def claim_table(spark, tuples):
    """Normalised claims from (session, seq, subject, key, value, source, file)."""
    df = spark.createDataFrame(
        tuples,
        "session_id string, change_seq bigint, canonical_subject string, canonical_key string, "
        "canonical_value string, source_type string, source_file string",
    )
    return df.select(
        "*",
        F.lit(1).alias("part"), F.lit(0).alias("snippet_seq"), F.lit(0).alias("seg_idx"),
        F.lit(0).alias("rule_idx"),
        F.concat(F.lit("assm_"), "change_seq").alias("claim_id"),
        F.concat("canonical_key", F.lit(" = "), "canonical_value").alias("canonical_predicate"),
        F.concat("canonical_key", F.lit(" = "), "canonical_value").alias("predicate"),
        F.col("canonical_subject").alias("statement"),
        F.lit("text").alias("evidence_text"),
        F.lit("HIGH").alias("confidence"),
    )
