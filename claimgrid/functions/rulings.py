"""Class, severity, confidence and texts of a contradicting pair.

Pair columns are ``l_*`` and ``r_*`` for the earlier and the later claim, next
to the shared ``canonical_subject`` and ``canonical_key``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.text import holds_any


def _has(column: str, words: str) -> Column:
    return holds_any(F.col(column), words)


def claim_class(subject: str = "canonical_subject", key: str = "canonical_key",
                value: str = "canonical_value") -> Column:
    """Class of any contradiction a claim can be part of, null if none.

    The class depends on subject and key alone, except that presence keys only
    contradict as true against false. So it is known before pairing.
    """
    business = _has(subject, fixed.ROLE_SUBJECT) | F.col(key).isin(fixed.ROLE_KEYS) | _has(
        key, fixed.RULE_KEY
    )
    contract = _has(subject, fixed.CONTRACT_SUBJECT) | _has(key, fixed.CONTRACT_KEY)
    presence = _has(key, fixed.DEPENDENCY_KEY) & F.col(value).isin("true", "false")
    return (
        F.when(business, "BUSINESS_RULE").when(contract, "CONTRACT").when(presence, "DEPENDENCY")
    )


def evidence_quality(source_type: str = "source_type", file: str = "source_file") -> Column:
    """2 with a file behind code, 1 for other code or requirement text, else 0."""
    return (
        F.when(
            F.col(source_type).isin("FILE_SNIPPET", "CODE_DIFF") & F.col(file).isNotNull(), 2
        )
        .when(F.col(source_type).isin("CODE_DIFF", "REQUIREMENT"), 1)
        .otherwise(0)
    )


def is_direct(left: str = "l_value", right: str = "r_value") -> Column:
    """True against false, or two different role words."""
    l, r = F.col(left), F.col(right)
    flip = ((l == "true") & (r == "false")) | ((l == "false") & (r == "true"))
    return flip | (l.isin(fixed.ROLE_WORDS) & r.isin(fixed.ROLE_WORDS))


def is_auth(subject: str = "canonical_subject", predicate: str = "l_predicate") -> Column:
    return _has(subject, fixed.ROLE_SUBJECT) | F.contains(F.col(predicate), F.lit("required_role"))


def _ruled(severity: str, rule: str) -> Column:
    return F.struct(F.lit(severity).alias("level"), F.lit(rule).alias("rule"))


def severity_ruling() -> Column:
    kind, quality, direct = F.col("conflict_type"), F.col("quality"), F.col("direct")
    files = F.col("l_file").isNotNull() & F.col("r_file").isNotNull()
    business = kind == "BUSINESS_RULE"
    contract = kind == "CONTRACT"
    return (
        F.when(business & is_auth() & direct, _ruled("HIGH", "BUSINESS_RULE:auth_contradiction"))
        .when(business & is_auth(), _ruled("MEDIUM", "BUSINESS_RULE:auth_indirect"))
        .when(business, _ruled("MEDIUM", "BUSINESS_RULE:general_rule_contradiction"))
        .when(contract & files & (quality >= 2), _ruled("HIGH", "CONTRACT:both_files_confirmed"))
        .when(contract & (quality >= 1), _ruled("MEDIUM", "CONTRACT:one_side_confirmed"))
        .when(contract, _ruled("LOW", "CONTRACT:weak_evidence"))
        .when(direct & (quality >= 2), _ruled("HIGH", "DEPENDENCY:boolean_flip_confirmed"))
        .when(direct, _ruled("MEDIUM", "DEPENDENCY:boolean_flip_partial_evidence"))
        .otherwise(_ruled("LOW", "DEPENDENCY:indirect"))
    )


def confidence_ruling() -> Column:
    quality, direct = F.col("quality"), F.col("direct")
    return (
        F.when(direct & (quality == 2), _ruled("HIGH", "direct_contradiction_with_file_evidence"))
        .when(direct & (quality >= 1), _ruled("MEDIUM", "direct_contradiction_moderate_evidence"))
        .when(quality == 2, _ruled("MEDIUM", "file_evidence_indirect_contradiction"))
        .when(quality == 1, _ruled("LOW", "moderate_evidence_indirect_contradiction"))
        .otherwise(_ruled("LOW", "weak_evidence"))
    )


def severity_rank(severity: str = "severity") -> Column:
    chain = F.lit(fixed.SEVERITY_RANK["INFO"])
    for name, rank in fixed.SEVERITY_RANK.items():
        chain = F.when(F.col(severity) == name, F.lit(rank)).otherwise(chain)
    return chain


def locale_key(conflict_id: str = "conflict_id") -> Column:
    """Sort key of an id in locale order: ids are [a-z0-9_] and '_' comes first."""
    return F.translate(F.col(conflict_id), "_", " ")


def source_label(source_type: str, file: str) -> Column:
    return F.coalesce(
        F.nullif(F.col(file), F.lit("")), F.translate(F.lower(F.col(source_type)), "_", " ")
    )


TEXT_PLACES = ["e", "l", "r", "ll", "rl", "ls", "rs"]


def _positional(template: str) -> str:
    """Spell ``{name}`` places as the numbered arguments of ``format_string``."""
    return re.sub(
        r"\{(\w+)\}", lambda m: f"%{TEXT_PLACES.index(m.group(1)) + 1}$s", template
    )


def pair_text(templates: dict[str, str]) -> Column:
    """A text of the pair: one format call, its template chosen by class."""

    def presence(value: str) -> Column:
        return F.when(F.col(value) == "true", fixed.PRESENT).otherwise(fixed.ABSENT)

    chosen = F.lit(None).cast("string")
    for kind, template in templates.items():
        required = F.lit(_positional(template.replace("{d}", fixed.MADE_REQUIRED)))
        optional = F.lit(_positional(template.replace("{d}", fixed.MADE_OPTIONAL)))
        text = required
        if "{d}" in template:
            text = F.when(F.col("l_value") == "false", optional).otherwise(required)
        chosen = F.when(F.col("conflict_type") == kind, text).otherwise(chosen)
    return F.call_function(
        "format_string",
        chosen,
        F.col("canonical_subject"),
        F.col("l_value"),
        F.col("r_value"),
        source_label("l_source_type", "l_file"),
        source_label("r_source_type", "r_file"),
        presence("l_value"),
        presence("r_value"),
    )
