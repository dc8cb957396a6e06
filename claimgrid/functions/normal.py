"""Scalar normalisers for claim subjects, keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.text import (
    BLANK_RANGE,
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    is_blank,
    pattern,
    snake,
    strip_edge,
    trim,
)


def word_map(pairs: dict[str, str]) -> Column:
    """A literal map; Catalyst folds it into one constant."""
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _synonyms(clusters: list[tuple[str, list[str], str]]) -> Column:
    return word_map({word: name for name, words, _ in clusters for word in words})


def _reasons(clusters: list[tuple[str, list[str], str]]) -> Column:
    return word_map({name: why for name, _, why in clusters})


def entity_synonym(working: Column) -> Column:
    """Canonical name if the subject, as written or with blanks, is a synonym."""
    names = _synonyms(fixed.ENTITY_SYNONYMS)
    return F.coalesce(
        F.try_element_at(names, F.translate(working, "_", " ")), F.try_element_at(names, working)
    )


def entity_working(raw: Column) -> Column:
    return snake(trim(raw))


def separators(text: Column) -> Column:
    joined = F.regexp_replace(text, rf"[{BLANK_RANGE}\-.]+", "_")
    return strip_edge(F.regexp_replace(joined, "_+", "_"), "_")


def without_fillers(working: Column) -> Column:
    filler = f"{NOT_AFTER_WORD}(?:{'|'.join(fixed.FILLER_WORDS)}){NOT_BEFORE_WORD}"
    return separators(F.regexp_replace(working, filler, ""))


def entity_reason(raw: Column, synonym: Column, canonical: Column) -> Column:
    """Why the canonical subject differs from the raw one, null if it does not."""
    plain = F.lower(trim(raw))
    return (
        F.when(is_blank(raw), F.lit(None).cast("string"))
        .when(synonym == plain, F.lit(None).cast("string"))
        .when(synonym.isNotNull(), F.try_element_at(_reasons(fixed.ENTITY_SYNONYMS), synonym))
        .when(canonical != separators(plain), fixed.ENTITY_CHANGED)
    )


def predicate_key(predicate: Column) -> Column:
    """Raw key: the text before the first ``=``."""
    return F.lower(trim(F.substring_index(predicate, "=", 1)))


def predicate_value(predicate: Column) -> Column:
    """Raw value: the text after the first ``=``, empty without one."""
    at = F.locate("=", predicate)
    return F.when(at > 0, trim(F.substring(predicate, at + 1, F.length(predicate)))).otherwise("")


def plain_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), rf"[{BLANK_RANGE}-]+", "_")


def canonical_key(plain: Column) -> Column:
    return F.coalesce(F.try_element_at(_synonyms(fixed.KEY_SYNONYMS), plain), plain)


def key_reason(plain: Column, canonical: Column) -> Column:
    return F.when(canonical != plain, F.try_element_at(_reasons(fixed.KEY_SYNONYMS), canonical))


def canonical_value(bare: Column) -> Column:
    """Canonical form of a value already without its quotes."""
    lowered = F.lower(bare)
    return (
        F.when(lowered.isin(fixed.TRUE_WORDS), "true")
        .when(lowered.isin(fixed.FALSE_WORDS), "false")
        .when(F.rlike(bare, F.lit(pattern(fixed.HUMPED_IDENTIFIER))), snake(bare))
        .otherwise(lowered)
    )
