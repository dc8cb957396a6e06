"""Text units -> segments -> claims."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrid.functions import fixed
from claimgrid.functions.rules import NOUN_REGEX, RULES, Rule, matches, tried
from claimgrid.functions.text import holds_any, is_blank, longer_than, slug, trim

# A unit's place in its session; "first occurrence" everywhere follows this
# order, then the segment, then the rule.
UNIT_KEY = ["session_id", "part", "change_seq", "snippet_seq"]
CLAIM_ORDER = ["part", "change_seq", "snippet_seq", "seg_idx", "rule_idx"]


def category_hint(label: Column, source_type: Column) -> Column:
    return _hint_of(F.lower(label), source_type)


def _hint_of(lowered: Column, source_type: Column) -> Column:
    """The hint of a label in lower case, which stands in a column of its own because each word is searched in it."""

    def choose(tests: list[tuple[str, str]], otherwise: Column) -> Column:
        arms = [(holds_any(lowered, words), F.lit(hint)) for words, hint in tests]
        chain = F.when(*arms[0])
        for arm in arms[1:]:
            chain = chain.when(*arm)
        return chain.otherwise(otherwise)

    return F.when(
        source_type == "REQUIREMENT",
        choose(fixed.REQUIREMENT_HINTS, F.lit(fixed.REQUIREMENT_DEFAULT_HINT)),
    ).otherwise(choose(fixed.CHANGE_HINTS, F.lit(None).cast("string")))


def _unit(df: DataFrame, part: int, seq: Column, snippet: Column, unit_id: Column,
          text: Column, hint: Column, source_file: Column) -> DataFrame:
    return df.select(
        "session_id",
        F.lit(part).alias("part"),
        seq.cast("long").alias("change_seq"),
        snippet.alias("snippet_seq"),
        unit_id.alias("unit_id"),
        text.alias("text"),
        hint.alias("category_hint"),
        source_file.cast("string").alias("source_file"),
    )


def build_units(
    sessions: DataFrame,
    changes: DataFrame,
    snippets: DataFrame | None = None,
    context_docs: DataFrame | None = None,
) -> DataFrame:
    """Everything to scan, as rows that carry their order instead of a number.

    ``sessions(session_id, requirement_text)``,
    ``changes(session_id, change_seq, change_id, label, content)``,
    ``snippets(session_id, change_seq, change_id, snippet_seq, file_path, source_type, content)``
    ``context_docs(session_id, doc_seq, file_path, source_type, content)``.
    ``snippet_seq`` counts from 0 within its change, or is a struct of the columns
    that order the snippets of a change; then other units have none.
    """
    none = F.lit(None)
    kind = snippets.schema["snippet_seq"].dataType if snippets is not None else T.IntegerType()
    keyed = isinstance(kind, T.StructType)
    zero = F.lit(None).cast(kind) if keyed else F.lit(0)
    units = [
        _unit(
            sessions, 0, F.lit(0), zero, F.lit("requirement"), F.col("requirement_text"),
            category_hint(F.lit("requirement"), F.lit("REQUIREMENT")), none,
        ),
        _unit(
            changes.withColumn("lowered", F.lower("label")), 1, F.col("change_seq"), zero, F.col("change_id"), F.col("content"),
            _hint_of(F.col("lowered"), F.lit("CODE_DIFF")), none,
        ),
    ]
    file_hint = _hint_of(F.col("lowered"), F.col("source_type"))
    if snippets is not None:
        units.append(
            _unit(
                snippets.withColumn("lowered", F.lower("file_path")), 1, F.col("change_seq"),
                F.col("snippet_seq") if keyed else (F.col("snippet_seq") + 1).cast("int"),
                F.concat(
                    "change_id", F.lit("__snippet_"),
                    F.concat_ws("_", *(F.col("snippet_seq")[f].cast("string") for f in kind.names)) if keyed
                    else F.col("snippet_seq").cast("string"),
                ),
                F.col("content"), file_hint, F.col("file_path"),
            )
        )
    if context_docs is not None:
        units.append(
            _unit(
                context_docs.withColumn("lowered", F.lower("file_path")), 2, F.col("doc_seq"), zero,
                F.concat(F.lit("context_doc_"), "doc_seq"),
                F.col("content"), file_hint, F.col("file_path"),
            )
        )
    return reduce(DataFrame.unionByName, units)


def segments(units: DataFrame, *keep: str) -> DataFrame:
    """One row per segment; ``seg_idx`` is the piece's place in the split text.

    Outer generators are used here and below because the inner ones make
    Catalyst infer a size filter that evaluates the whole array a second time.
    """
    pieces = F.transform(F.split("text", fixed.SEGMENT_BREAK), trim)
    rows = units.select(*keep, F.posexplode_outer(pieces).alias("seg_idx", "segment"))
    return rows.filter(longer_than(F.col("segment"), fixed.MIN_SEGMENT_LENGTH - 1))


def rule_matches(units: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """First match per segment and rule. Narrow: nothing is shuffled."""
    # The noun rule looks at the whole unit text, so it is read before the split
    # and the text itself travels no further.
    noun = F.when(
        F.rlike("text", F.lit("(?i)assume")), F.regexp_extract("text", NOUN_REGEX, 1)
    )
    keep = [*UNIT_KEY, "unit_id", "category_hint", "source_file", "noun"]
    rows = segments(units.withColumn("noun", noun), *keep)
    application = units.sparkSession.sparkContext.applicationId
    lowered = rows.withColumn("lowered", F.lower("segment"))
    found = lowered.withColumn("tried", tried(tuple(rules), application)).select(
        *UNIT_KEY, "unit_id", "source_file", "seg_idx",
        F.inline_outer(matches(tuple(rules), application)),
    )
    return found.filter(F.col("rule_idx").isNotNull())


def claims(
    units: DataFrame, source_type: str = "REQUIREMENT", rules: Sequence[Rule] = RULES,
    deal: dict[str, Column] | None = None,
) -> DataFrame:
    """Claims of every unit: first of each (subject, predicate), numbered from 0.

    One shuffle, by unit, serves both rankings. A unit is one text row, so no
    key here can grow beyond that row. ``deal`` names columns that follow from the unit
    key; rows are then shuffled by these, so the claims need no second shuffle to be
    stored by them, and the claims keep the columns.
    """
    deal = deal or {}
    found = rule_matches(units, rules)
    # What a rule fixes is looked up again by its place, so it isn't shuffled.
    fixed_by = {
        name: F.element_at(F.array(*(F.lit(getattr(rule, name)) for rule in rules)), F.col("rule_idx") + 1)
        for name in ("rule_id", "category", "confidence")
    }
    columns = found.columns
    found = found.drop(*fixed_by).withColumns(deal).repartition(*(deal or UNIT_KEY))
    place = ["seg_idx", "rule_idx"]
    again = Window.partitionBy(*deal, *UNIT_KEY, "subject", "predicate").orderBy(*place)
    running = Window.partitionBy(*deal, *UNIT_KEY).orderBy(*place)
    kept = (
        found.withColumn("nth", F.row_number().over(again))
        .filter("nth = 1")
        .drop("nth")
        .withColumn("claim_idx", F.row_number().over(running) - 1)
    )
    claim_id = F.concat(
        F.lit("assm_"),
        slug(F.col("unit_id"), F.col("subject"), F.col("predicate"), F.col("claim_idx").cast("string")),
    )
    named = kept.withColumns({"claim_id": claim_id, **fixed_by}).select(*columns, "claim_idx", "claim_id", *deal)
    return named.withColumn("source_type", F.lit(source_type))


def _of_sets(units: DataFrame, chosen: DataFrame, sets: dict[str, Sequence[Rule]], read) -> DataFrame:
    """Units of each session read by the rule set that ``chosen(session_id, rule_set)`` names for it."""
    missing = F.concat(F.lit("unknown rule set: "), "rule_set")
    name = F.when(F.col("rule_set").isin(*sets), F.col("rule_set")).otherwise(F.raise_error(missing).cast("string"))
    marked = units.join(chosen.select("session_id", name.alias("rule_set")), "session_id")
    parts = [read(marked.filter(F.col("rule_set") == key).drop("rule_set"), rules).withColumn("rule_set", F.lit(key)) for key, rules in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def rule_set_matches(units: DataFrame, chosen: DataFrame, sets: dict[str, Sequence[Rule]]) -> DataFrame:
    """``rule_matches`` with a rule set for each session; a set that isn't there fails the job."""
    return _of_sets(units, chosen, sets, rule_matches)


def rule_set_claims(units: DataFrame, chosen: DataFrame, sets: dict[str, Sequence[Rule]], source_type: str = "REQUIREMENT") -> DataFrame:
    """``claims`` with a rule set for each session."""
    return _of_sets(units, chosen, sets, lambda rows, rules: claims(rows, source_type, rules))


def diagnostics(units: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Units that gave no claim, with the reason.

    Whether a unit matched is decided on the row's own matches, before any
    dedupe, so the join is one-to-one on the unit key.
    """
    found = rule_matches(units) if found is None else found
    hit = found.select(*UNIT_KEY).distinct()
    longest = F.exists(
        F.split("text", fixed.SEGMENT_BREAK),
        lambda piece: longer_than(trim(piece), fixed.MIN_SEGMENT_LENGTH - 1),
    )
    shape = (
        F.when(is_blank(F.col("text")), "empty text — no assumptions extracted")
        .when(~longest, "text too short to segment")
        .otherwise("no pattern matched — returning empty result (not hallucinating)")
    )
    rows = units.select(*UNIT_KEY, "unit_id", shape.alias("reason"))
    return (
        rows.join(hit, UNIT_KEY, "left_anti")
        .select(
            *UNIT_KEY, "unit_id",
            F.concat(F.lit('Unit "'), "unit_id", F.lit('": '), "reason").alias("message"),
        )
    )
