"""Extraction rules as data, each turned into one Column over a segment."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.text import longer_than, pattern, subject_key, trim


# Stands between the groups of a match; a noncharacter, which no text holds.
GROUP_MARK = "\ufdd0"


@dataclass(frozen=True)
class Hit:
    """Captured groups of one match, and the unit's field noun."""

    captured: Column
    noun: Column

    def group(self, n: int) -> Column:
        return self.captured["groups"][n]

    def first_of(self, *groups: int) -> Column:
        return F.coalesce(*(F.nullif(self.group(n), F.lit("")) for n in groups), F.lit(""))


@dataclass(frozen=True)
class Reading:
    """What a rule reads out of a match; the claim exists only if ``valid``."""

    subject: Column
    predicate: Column
    statement: Column
    valid: Column


@dataclass(frozen=True)
class Rule:
    """``triggers`` are lower-case texts, one of which every match contains. The regex has no look-around."""

    rule_id: str
    category: str
    regex: str
    n_groups: int
    confidence: str
    triggers: tuple[str, ...]
    read: Callable[[Hit], Reading]


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _filled(*texts: Column) -> Column:
    return reduce(lambda a, b: a & b, (t != "" for t in texts))


def _only_role_can(hit: Hit) -> Reading:
    role, action = F.lower(trim(hit.group(1))), F.lower(trim(hit.group(2)))
    return Reading(
        subject_key(action),
        _text("allowed_role = ", role),
        _text("Only '", role, "' may perform: ", action),
        _filled(role, action),
    )


def _role_literal(key: str, opening: str) -> Callable[[Hit], Reading]:
    def read(hit: Hit) -> Reading:
        role = hit.group(1)
        return Reading(
            F.lit("user_role"),
            _text(f"{key} = ", role),
            _text(f"{opening} '", role, "'"),
            _filled(role),
        )

    return read


def _permission(hit: Hit) -> Reading:
    perm = F.lower(trim(hit.group(1)))
    return Reading(
        subject_key(perm),
        _text("required_permission = ", perm),
        _text("Access requires permission '", perm, "'"),
        _filled(perm),
    )


def _obligation(key: str, verb: str) -> Callable[[Hit], Reading]:
    def read(hit: Hit) -> Reading:
        subject, rule = subject_key(hit.group(1)), F.lower(trim(hit.group(2)))
        return Reading(
            subject,
            _text(f"{key} = ", rule),
            _text(subject, f" {verb} ", rule),
            (F.length(subject) >= 2) & _filled(rule),
        )

    return read


def _only_actor(hit: Hit) -> Reading:
    actor, action = F.lower(trim(hit.group(1))), subject_key(hit.group(2))
    return Reading(
        action,
        _text("allowed_actor = ", actor),
        _text("Only ", actor, " are allowed to ", F.translate(action, "_", " ")),
        _filled(actor, action),
    )


def _response_field(key: str, opening: str) -> Callable[[Hit], Reading]:
    def read(hit: Hit) -> Reading:
        field = hit.first_of(1, 2)
        return Reading(
            F.lit("api_response_field"),
            _text(f"{key} = ", field),
            _text(f"{opening} field '", field, "'"),
            F.length(field) >= 2,
        )

    return read


def _signature(hit: Hit) -> Reading:
    name, params = hit.group(1), trim(hit.group(2))
    return Reading(
        subject_key(name),
        _text("signature = ", name, "(", params, ")"),
        _text("Function '", name, "' has signature (", params, ")"),
        _filled(name),
    )


def _requiredness(required: str, word: str, *groups: int) -> Callable[[Hit], Reading]:
    def read(hit: Hit) -> Reading:
        field = hit.first_of(*groups)
        return Reading(
            subject_key(field),
            F.lit(f"is_required = {required}"),
            _text("Field '", field, f"' is {word}"),
            _filled(field),
        )

    return read


def _field_type(hit: Hit) -> Reading:
    field, kind = hit.first_of(1, 3), F.lower(hit.first_of(2, 4))
    return Reading(
        subject_key(field),
        _text("type = ", kind),
        _text("Field '", field, "' has type ", kind),
        _filled(field, kind),
    )


def _presence(field: Column) -> Reading:
    return Reading(
        subject_key(field),
        F.lit("always_present = true"),
        _text("Dependency assumes '", field, "' is always present"),
        _filled(field),
    )


def _always_present(hit: Hit) -> Reading:
    leaf = F.substring_index(hit.group(1), ".", -1)
    return _presence(F.lower(leaf))


def _assumed_present(hit: Hit) -> Reading:
    noun = F.lower(F.nullif(hit.noun, F.lit("")))
    return _presence(F.coalesce(noun, subject_key(hit.group(1))))


def _depends_on(hit: Hit) -> Reading:
    dep = trim(hit.group(1))
    return Reading(
        subject_key(dep),
        F.lit("dependency_required = true"),
        _text("Component depends on '", dep, "'"),
        longer_than(dep, 1),
    )


def _calls(hit: Hit) -> Reading:
    call = hit.group(1)
    return Reading(
        subject_key(call),
        F.lit("called_by_component = true"),
        _text("Component calls '", call, "'"),
        _filled(call),
    )


# rule id -> (category, confidence, triggers, reader), in rule order.
_SPECS = {
    "auth:only_role_can_action": ("AUTHORIZATION", "HIGH", ["only"], _only_role_can),
    "auth:role_check_equality": (
        "AUTHORIZATION", "HIGH", ["role"],
        _role_literal("allowed_role", "The privileged role is"),
    ),
    "auth:role_assignment": (
        "AUTHORIZATION", "HIGH", ["role"],
        _role_literal("assigned_role", "User role is assigned as"),
    ),
    "auth:permission_check": (
        "AUTHORIZATION", "MEDIUM", ["haspermission", "hasrole", "hasaccess"], _permission,
    ),
    "biz:must_requirement": (
        "BUSINESS_RULE", "HIGH", ["must"], _obligation("must_be", "must be"),
    ),
    "biz:cannot_requirement": (
        "BUSINESS_RULE", "HIGH", ["cannot", "can't", "should", "must"],
        _obligation("prohibited", "cannot"),
    ),
    "biz:only_x_allowed": ("BUSINESS_RULE", "HIGH", ["allowed"], _only_actor),
    "contract:field_name": (
        "CONTRACT", "MEDIUM", ["return", "respond", "field"],
        _response_field("field_name", "API response includes"),
    ),
    "contract:expects_field": (
        "CONTRACT", "MEDIUM", ["expect"], _response_field("expected_field", "Consumer expects"),
    ),
    "contract:function_signature": (
        "CONTRACT", "MEDIUM", ["function", "method", "def"], _signature,
    ),
    "schema:field_required": (
        "SCHEMA", "HIGH", ["required", "mandatory", "null"],
        _requiredness("true", "required", 1, 2),
    ),
    "schema:field_optional": (
        "SCHEMA", "HIGH", ["optional", "null"], _requiredness("false", "optional", 1, 2),
    ),
    "schema:field_optional_property": (
        "SCHEMA", "HIGH", ["?"], _requiredness("false", "optional", 1),
    ),
    "schema:field_type": ("SCHEMA", "MEDIUM", [":", "type"], _field_type),
    "dep:field_always_present": ("DEPENDENCY", "MEDIUM", ["always"], _always_present),
    "dep:assumes_field_present": ("DEPENDENCY", "MEDIUM", ["assume"], _assumed_present),
    "dep:depends_on_service": ("DEPENDENCY", "MEDIUM", ["depend", "relies", "rely"], _depends_on),
    "dep:calls_service": ("DEPENDENCY", "LOW", ["call", "invoke"], _calls),
}

RULES: list[Rule] = [
    Rule(
        rule_id=rule_id,
        category=category,
        regex=pattern(
            fixed.RULE_PATTERNS[rule_id],
            ignore_case=rule_id not in fixed.CASE_SENSITIVE_RULES,
        ),
        n_groups=re.compile(fixed.RULE_PATTERNS[rule_id]).groups,
        confidence=confidence,
        triggers=tuple(triggers),
        read=read,
    )
    for rule_id, (category, confidence, triggers, read) in _SPECS.items()
]

NOUN_REGEX = pattern(fixed.FIELD_NOUN, ignore_case=True)


def admits(hint: Column, category: str) -> Column:
    """Whether a unit with this hint is read by rules of ``category``."""
    hints = [category]
    if category == "AUTHORIZATION":
        hints.append("BUSINESS_RULE")
    return hint.isNull() | hint.isin(hints)


def _capture(index: int, rule: Rule, segment: Column, lowered: Column, hint: Column) -> Column:
    """Rule and matched text, empty if the pattern finds nothing: one evaluation."""
    words = reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(w)) for w in rule.triggers))
    found = F.struct(F.lit(index).alias("rule_idx"), F.regexp_extract(segment, rule.regex, 0).alias("whole"))
    return F.when(admits(hint, rule.category) & words, found)


def _groups(captured: Column, rules: Sequence[Rule]) -> Column:
    """The matched text and its groups in order, from one pass over the matched text.

    A pattern has no look-around, so it matches its own matched text as a whole.
    """
    chain = None
    for index, rule in enumerate(rules):
        listed = GROUP_MARK.join(f"${n}" for n in range(rule.n_groups + 1))
        groups = F.split(F.regexp_replace(captured["whole"], F.lit(rule.regex), F.lit(listed)), GROUP_MARK, -1)
        test = captured["rule_idx"] == index
        chain = F.when(test, groups) if chain is None else chain.when(test, groups)
    return F.struct(captured["rule_idx"].alias("rule_idx"), chain.alias("groups"))


def _read(captured: Column, noun: Column, rules: Sequence[Rule]) -> Column:
    """The claim a match stands for; null if the rule rejects it."""
    chain = None
    for index, rule in enumerate(rules):
        reading = rule.read(Hit(captured, noun))
        claim = F.struct(
            F.lit(index).alias("rule_idx"),
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.category).alias("category"),
            reading.subject.alias("subject"),
            reading.predicate.alias("predicate"),
            reading.statement.alias("statement"),
            trim(captured["groups"][0]).alias("evidence_text"),
            F.lit(rule.confidence).alias("confidence"),
        )
        test, value = captured["rule_idx"] == index, F.when(reading.valid, claim)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


@lru_cache(maxsize=8)
def tried(rules: tuple[Rule, ...], application: str) -> Column:
    """First match of each rule in one segment, null for rules that aren't tried.

    Reads the columns ``segment``, ``lowered`` and ``category_hint``. The expression
    is the same for every table, so an application builds it once. It stands in a
    projection of its own: triggers and patterns run on every segment, and what
    feeds an array function directly is interpreted together with it.
    """
    segment, lowered, hint = map(F.col, ("segment", "lowered", "category_hint"))
    return F.array(*(_capture(i, rule, segment, lowered, hint) for i, rule in enumerate(rules)))


@lru_cache(maxsize=8)
def matches(rules: tuple[Rule, ...], application: str) -> Column:
    """Claims of one segment, in rule order: first match of each admitted rule.

    Reads the columns ``tried`` and ``noun``. What the groups of a match mean is read
    only for the rules that matched, in array functions, which keeps that out of one
    oversized generated method the JVM would not compile.
    """
    found = F.filter("tried", lambda c: c.isNotNull() & (c["whole"] != ""))
    captured = F.transform(found, lambda c: _groups(c, rules))
    return F.array_compact(F.transform(captured, lambda c: _read(c, F.col("noun"), rules)))
