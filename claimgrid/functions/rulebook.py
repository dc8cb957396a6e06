"""Rule sets as tables: patterns, triggers and templates compiled into extraction rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions.rules import Hit, Reading, Rule
from claimgrid.functions.text import pattern, subject_key, trim

SCHEMA = (
    "rule_set string, place int, rule_id string, category string, confidence string, pattern string, "
    "ignore_case boolean, triggers array<string>, subject string, predicate string, statement string"
)
# Rules are expressions of a plan, so a rule set has a bound.
MOST_RULES = 500
# ``{1}`` is a group, ``{1|lower}`` in lower case, ``{1|key}`` as a subject key.
SLOT = re.compile(r"\{(\d+)(?:\|(lower|key))?\}")
FORMS = {None: trim, "lower": lambda c: F.lower(trim(c)), "key": subject_key}


def _slots(template: str, hit: Hit) -> list[Column]:
    return [FORMS[m[2]](hit.group(int(m[1]))) for m in SLOT.finditer(template)]


def _filled(template: str, hit: Hit) -> Column:
    texts = [F.lit(t) for t in SLOT.sub("\0", template).split("\0")]
    slots = _slots(template, hit)
    parts = [texts[0], *(part for pair in zip(slots, texts[1:], strict=True) for part in pair)]
    return F.concat(*parts)


def _reader(subject: str, predicate: str, statement: str):
    def read(hit: Hit) -> Reading:
        valid = F.lit(True)
        for slot in (*_slots(subject, hit), *_slots(predicate, hit)):
            valid = valid & (slot != "")
        return Reading(_filled(subject, hit), _filled(predicate, hit), _filled(statement, hit), valid)

    return read


def _rule(row) -> Rule:
    groups = re.compile(row.pattern).groups
    for template in (row.subject, row.predicate, row.statement):
        if any(int(m[1]) > groups for m in SLOT.finditer(template)):
            raise ValueError(f"rule {row.rule_id}: a template names a group that its pattern lacks")
    if not row.triggers or any(t != t.lower() for t in row.triggers):
        raise ValueError(f"rule {row.rule_id}: triggers must be lower-case texts")
    if re.search(r"\(\?(?:[=!]|<[=!])", row.pattern):
        raise ValueError(f"rule {row.rule_id}: a pattern can't look around")
    return Rule(
        rule_id=row.rule_id, category=row.category, regex=pattern(row.pattern, ignore_case=bool(row.ignore_case)), n_groups=groups,
        confidence=row.confidence, triggers=tuple(row.triggers), read=_reader(row.subject, row.predicate, row.statement),
    )


def rule_sets(table: DataFrame) -> dict[str, tuple[Rule, ...]]:
    """The rules of each set in order of ``place``; at most ``MOST_RULES`` rules in all."""
    rows = table.orderBy("rule_set", "place").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    sets: dict[str, list[Rule]] = {}
    for row in rows:
        sets.setdefault(row.rule_set, []).append(_rule(row))
    return {name: tuple(rules) for name, rules in sets.items()}
