"""DuckDB texts of the registered queries.

Each stage of the claim pipeline is one CTE; a query names the stages it needs.
The SQL is written on its own, from the fixed values and the corpus templates.
"""

from __future__ import annotations

import re

from claimgrid.functions import fixed
from claimgrid.sources import corpus


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def subject_key(x: str) -> str:
    return f"trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '_')"


def slug(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^A-Za-z0-9_]+', '_', 'g'))"


def snake(x: str) -> str:
    one = f"regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')"
    return f"lower(regexp_replace({one}, '([a-z\\d])([A-Z])', '\\1_\\2', 'g'))"


def hint(label: str, tests: list[tuple[str, str]], default: str) -> str:
    arms = " ".join(f"WHEN regexp_matches(lower({label}), {q(w)}) THEN {q(h)}" for w, h in tests)
    return f"CASE {arms} ELSE {default} END"


BLANK_LIST = " || ".join(["' '", "chr(9)", "chr(10)", "chr(13)", "chr(160)"])


def btrim(x: str) -> str:
    return f"trim({x}, {BLANK_LIST})"


# --- units -------------------------------------------------------------------


def _units() -> str:
    change = hint("label", fixed.CHANGE_HINTS, "NULL")
    file = hint("file_path", fixed.CHANGE_HINTS, "NULL")
    parts = [
        f"""SELECT c_custkey AS session_id, 0 AS part, 0 AS change_seq, 0 AS snippet_seq,
            'requirement' AS unit_id, {corpus.REQUIREMENT} AS text, 'BUSINESS_RULE' AS category_hint,
            NULL::VARCHAR AS source_file FROM customer""",
        f"""SELECT session_id, 1, change_seq, 0, change_id, content, {change}, NULL
            FROM (SELECT o_custkey AS session_id, o_orderkey AS change_seq, {corpus.CHANGE_ID} AS change_id,
                  {corpus.LABEL} AS label, {corpus.CONTENT} AS content
                  FROM (SELECT *, {corpus.role('o_orderkey')} AS r1 FROM orders))""",
    ]
    for i, s in enumerate(corpus.SNIPPETS):
        parts.append(
            f"""SELECT session_id, 1, change_seq, {i + 1}, change_id || '__snippet_{i}', {corpus.SNIPPET_TEXT}, {file}, file_path
            FROM (SELECT *, {corpus.role('n1')} AS r1, {corpus.role('n2')} AS r2 FROM (
              SELECT o_custkey AS session_id, o_orderkey AS change_seq, {corpus.CHANGE_ID} AS change_id,
                  {corpus.path(s['at'])} AS file_path, {s['n1']} AS n1, {s['n2']} AS n2, {s['m1']} AS m1, {s['m2']} AS m2
              FROM orders))"""
        )
    doc = hint("'docs/notes.md'", fixed.CHANGE_HINTS, "NULL")
    parts.append(
        f"""SELECT c_custkey, 2, 0, 0, 'context_doc_0', {corpus.CONTEXT_TEXT}, {doc}, 'docs/notes.md'
            FROM (SELECT *, {corpus.role('n1')} AS r1 FROM (SELECT *, {corpus.CONTEXT_NUMBER} AS n1 FROM customer))"""
    )
    return " UNION ALL ".join(parts)


SEGS = f"""
  SELECT * EXCLUDE (piece, text), {btrim('piece')} AS segment FROM (
    SELECT *, regexp_extract(text, {q('(?i)' + fixed.FIELD_NOUN)}, 1) AS noun,
      unnest(string_split_regex(text, '[.;\\n]')) AS piece,
      generate_subscripts(string_split_regex(text, '[.;\\n]'), 1) - 1 AS seg_idx
    FROM units)
  WHERE length({btrim('piece')}) > 4"""


# --- rules: id -> (category, confidence, subject, predicate, statement, valid) --


def _g(n: int) -> str:
    return f"g{n}"


def _either(a: int, b: int) -> str:
    return f"coalesce(nullif(g{a}, ''), g{b})"


_field, _kind = _either(1, 3), f"lower({_either(2, 4)})"
_low1, _low2 = "lower(trim(g1))", "lower(trim(g2))"
_key1 = subject_key("g1")
_noun = f"coalesce(nullif(lower(noun), ''), {_key1})"
RULE_SQL = {
    "auth:only_role_can_action": (
        "AUTHORIZATION", "HIGH", subject_key("g2"), f"'allowed_role = ' || {_low1}",
        f"'Only ''' || {_low1} || ''' may perform: ' || {_low2}", "trim(g1) <> '' AND trim(g2) <> ''"),
    "auth:role_check_equality": (
        "AUTHORIZATION", "HIGH", "'user_role'", "'allowed_role = ' || g1",
        "'The privileged role is ''' || g1 || ''''", "g1 <> ''"),
    "auth:role_assignment": (
        "AUTHORIZATION", "HIGH", "'user_role'", "'assigned_role = ' || g1",
        "'User role is assigned as ''' || g1 || ''''", "g1 <> ''"),
    "auth:permission_check": (
        "AUTHORIZATION", "MEDIUM", _key1, f"'required_permission = ' || {_low1}",
        f"'Access requires permission ''' || {_low1} || ''''", "trim(g1) <> ''"),
    "biz:must_requirement": (
        "BUSINESS_RULE", "HIGH", _key1, f"'must_be = ' || {_low2}",
        f"{_key1} || ' must be ' || {_low2}", f"length({_key1}) >= 2 AND trim(g2) <> ''"),
    "biz:cannot_requirement": (
        "BUSINESS_RULE", "HIGH", _key1, f"'prohibited = ' || {_low2}",
        f"{_key1} || ' cannot ' || {_low2}", f"length({_key1}) >= 2 AND trim(g2) <> ''"),
    "biz:only_x_allowed": (
        "BUSINESS_RULE", "HIGH", subject_key("g2"), f"'allowed_actor = ' || {_low1}",
        f"'Only ' || {_low1} || ' are allowed to ' || replace({subject_key('g2')}, '_', ' ')",
        f"trim(g1) <> '' AND {subject_key('g2')} <> ''"),
    "contract:field_name": (
        "CONTRACT", "MEDIUM", "'api_response_field'", f"'field_name = ' || {_either(1, 2)}",
        f"'API response includes field ''' || {_either(1, 2)} || ''''", f"length({_either(1, 2)}) >= 2"),
    "contract:expects_field": (
        "CONTRACT", "MEDIUM", "'api_response_field'", f"'expected_field = ' || {_either(1, 2)}",
        f"'Consumer expects field ''' || {_either(1, 2)} || ''''", f"length({_either(1, 2)}) >= 2"),
    "contract:function_signature": (
        "CONTRACT", "MEDIUM", _key1, "'signature = ' || g1 || '(' || trim(g2) || ')'",
        "'Function ''' || g1 || ''' has signature (' || trim(g2) || ')'", "g1 <> ''"),
    "schema:field_required": (
        "SCHEMA", "HIGH", subject_key(_either(1, 2)), "'is_required = true'",
        f"'Field ''' || {_either(1, 2)} || ''' is required'", f"{_either(1, 2)} <> ''"),
    "schema:field_optional": (
        "SCHEMA", "HIGH", subject_key(_either(1, 2)), "'is_required = false'",
        f"'Field ''' || {_either(1, 2)} || ''' is optional'", f"{_either(1, 2)} <> ''"),
    "schema:field_optional_property": (
        "SCHEMA", "HIGH", _key1, "'is_required = false'",
        "'Field ''' || g1 || ''' is optional'", "g1 <> ''"),
    "schema:field_type": (
        "SCHEMA", "MEDIUM", subject_key(_field), f"'type = ' || {_kind}",
        f"'Field ''' || {_field} || ''' has type ' || {_kind}", f"{_field} <> '' AND {_kind} <> ''"),
    "dep:field_always_present": (
        "DEPENDENCY", "MEDIUM", subject_key("split_part(g1, '.', -1)"), "'always_present = true'",
        "'Dependency assumes ''' || lower(split_part(g1, '.', -1)) || ''' is always present'",
        "split_part(g1, '.', -1) <> ''"),
    "dep:assumes_field_present": (
        "DEPENDENCY", "MEDIUM", subject_key(_noun), "'always_present = true'",
        f"'Dependency assumes ''' || {_noun} || ''' is always present'", f"{_noun} <> ''"),
    "dep:depends_on_service": (
        "DEPENDENCY", "MEDIUM", _key1, "'dependency_required = true'",
        "'Component depends on ''' || trim(g1) || ''''", "length(trim(g1)) >= 2"),
    "dep:calls_service": (
        "DEPENDENCY", "LOW", _key1, "'called_by_component = true'",
        "'Component calls ''' || g1 || ''''", "g1 <> ''"),
}


def _found() -> str:
    selects = []
    for idx, (rule_id, rule) in enumerate(RULE_SQL.items()):
        category, confidence, subject, predicate, statement, valid = rule
        source = fixed.RULE_PATTERNS[rule_id]
        flag = "" if rule_id in fixed.CASE_SENSITIVE_RULES else "(?i)"
        pattern = q(flag + source)
        plain = re.sub(r"\\.|\[[^]]*\]", "", source)
        n_groups = len(re.findall(r"\((?!\?)", plain))
        groups = ", ".join(
            f"regexp_extract(segment, {pattern}, {n}) AS g{n}" for n in range(1, n_groups + 1)
        )
        admitted = [category, "BUSINESS_RULE"] if category == "AUTHORIZATION" else [category]
        selects.append(
            f"""SELECT session_id, part, change_seq, snippet_seq, unit_id, source_file, seg_idx,
              {idx} AS rule_idx, {q(rule_id)} AS rule_id, {q(category)} AS category,
              {subject} AS subject, {predicate} AS predicate, {statement} AS statement,
              trim(g0) AS evidence_text, {q(confidence)} AS confidence
            FROM (SELECT *, regexp_extract(segment, {pattern}) AS g0, {groups} FROM segs
                  WHERE regexp_matches(segment, {pattern})
                    AND (category_hint IS NULL OR category_hint IN {words(admitted)}))
            WHERE {valid}"""
        )
    return " UNION ALL ".join(selects)


CLAIMS = f"""
  SELECT *, 'CODE_DIFF' AS source_type,
    'assm_' || {slug("unit_id || '__' || subject || '__' || predicate || '__' || claim_idx")} AS claim_id
  FROM (
    SELECT * EXCLUDE (nth), row_number() OVER (PARTITION BY session_id, part, change_seq, snippet_seq
        ORDER BY seg_idx, rule_idx) - 1 AS claim_idx
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id, part, change_seq, snippet_seq, subject, predicate
        ORDER BY seg_idx, rule_idx) AS nth FROM found)
    WHERE nth = 1)"""


def _norm() -> str:
    entity = " ".join(
        f"WHEN replace(working, '_', ' ') IN {words(ws)} OR working IN {words(ws)} THEN {q(name)}"
        for name, ws, _ in fixed.ENTITY_SYNONYMS
    )
    entity_why = " ".join(
        f"WHEN {q(name)} THEN {q(why)}" for name, _, why in fixed.ENTITY_SYNONYMS
    )
    key = " ".join(f"WHEN plain_key IN {words(ws)} THEN {q(name)}" for name, ws, _ in fixed.KEY_SYNONYMS)
    key_why = " ".join(f"WHEN {q(name)} THEN {q(why)}" for name, _, why in fixed.KEY_SYNONYMS)
    filler = "|".join(fixed.FILLER_WORDS)

    def sep(x: str) -> str:
        return f"trim(regexp_replace(regexp_replace({x}, '[\\s\\-.]+', '_', 'g'), '_+', '_', 'g'), '_')"

    stripped = sep(f"regexp_replace(working, '\\b({filler})\\b', '', 'g')")
    humped = q(fixed.HUMPED_IDENTIFIER)
    bare = "trim(regexp_replace(raw_value, '^[''\"`]|[''\"`]$', '', 'g'))"
    return f"""
  SELECT * EXCLUDE (working, plain_key, synonym, stripped, raw_value, bare, value),
    coalesce(synonym, stripped) AS canonical_subject,
    nullif(value, '') AS canonical_value,
    CASE WHEN value <> '' THEN canonical_key || ' = ' || value ELSE canonical_key END AS canonical_predicate,
    CASE WHEN synonym IS NOT NULL THEN CASE WHEN synonym <> lower(trim(subject)) THEN CASE synonym {entity_why} END END
         WHEN stripped <> {sep('lower(trim(subject))')} THEN {q(fixed.ENTITY_CHANGED)} END AS subject_why,
    CASE WHEN canonical_key <> plain_key THEN CASE canonical_key {key_why} END END AS key_why,
    CASE WHEN raw_value <> '' AND value <> raw_value
         THEN 'Value normalized: ''' || raw_value || ''' → ''' || value || '''' END AS value_why
  FROM (SELECT *, CASE {entity} END AS synonym, {stripped} AS stripped,
      CASE {key} ELSE plain_key END AS canonical_key,
      CASE WHEN lower(bare) IN {words(fixed.TRUE_WORDS)} THEN 'true'
           WHEN lower(bare) IN {words(fixed.FALSE_WORDS)} THEN 'false'
           WHEN regexp_matches(bare, {humped}) THEN {snake('bare')}
           ELSE lower(bare) END AS value
    FROM (SELECT *, {bare} AS bare
      FROM (SELECT *, {snake('trim(subject)')} AS working,
          regexp_replace(lower(trim(split_part(predicate, '=', 1))), '[\\s-]+', '_', 'g') AS plain_key,
          CASE WHEN contains(predicate, '=') THEN trim(substr(predicate, strpos(predicate, '=') + 1)) ELSE '' END AS raw_value
        FROM claims)))"""


MERGED = """
  SELECT * EXCLUDE (nth) FROM (
    SELECT *, row_number() OVER (w ORDER BY part, change_seq, snippet_seq, seg_idx, rule_idx) AS nth,
      count(*) OVER w AS n_claims
    FROM norm WINDOW w AS (PARTITION BY session_id, canonical_subject, canonical_predicate))
  WHERE nth = 1"""

PAIRS = """
  SELECT l.session_id, l.canonical_subject, l.canonical_key,
    l.claim_id AS l_claim_id, r.claim_id AS r_claim_id,
    l.statement AS l_statement, r.statement AS r_statement,
    l.canonical_predicate AS l_predicate, r.canonical_predicate AS r_predicate,
    l.canonical_value AS l_value, r.canonical_value AS r_value,
    l.source_type AS l_source_type, r.source_type AS r_source_type,
    l.source_file AS l_file, r.source_file AS r_file,
    l.evidence_text AS l_evidence_text, r.evidence_text AS r_evidence_text
  FROM merged l JOIN merged r
    ON l.session_id = r.session_id AND l.canonical_subject = r.canonical_subject
    AND l.canonical_key = r.canonical_key AND l.canonical_value <> r.canonical_value
    AND l.claim_id <> r.claim_id
    AND (l.part, l.change_seq, l.snippet_seq, l.seg_idx, l.rule_idx)
      < (r.part, r.change_seq, r.snippet_seq, r.seg_idx, r.rule_idx)
  WHERE l.canonical_subject <> ''"""


def _quality(side: str) -> str:
    return (
        f"CASE WHEN {side}_source_type IN ('FILE_SNIPPET', 'CODE_DIFF') AND {side}_file IS NOT NULL THEN 2 "
        f"WHEN {side}_source_type IN ('CODE_DIFF', 'REQUIREMENT') THEN 1 ELSE 0 END"
    )


CONFLICTS = f"""
  SELECT *, 'conflict_' || {slug("conflict_type || '__' || least(l_claim_id, r_claim_id) || '__' || greatest(l_claim_id, r_claim_id)")} AS conflict_id,
    split_part(sev, '|', 1) AS severity, split_part(sev, '|', 2) AS severity_rule,
    split_part(conf, '|', 1) AS confidence, split_part(conf, '|', 2) AS confidence_rule
  FROM (SELECT *,
      CASE WHEN conflict_type = 'BUSINESS_RULE' THEN
             CASE WHEN auth AND direct THEN 'HIGH|BUSINESS_RULE:auth_contradiction'
                  WHEN auth THEN 'MEDIUM|BUSINESS_RULE:auth_indirect'
                  ELSE 'MEDIUM|BUSINESS_RULE:general_rule_contradiction' END
           WHEN conflict_type = 'CONTRACT' THEN
             CASE WHEN l_file IS NOT NULL AND r_file IS NOT NULL AND quality >= 2 THEN 'HIGH|CONTRACT:both_files_confirmed'
                  WHEN quality >= 1 THEN 'MEDIUM|CONTRACT:one_side_confirmed'
                  ELSE 'LOW|CONTRACT:weak_evidence' END
           WHEN direct AND quality >= 2 THEN 'HIGH|DEPENDENCY:boolean_flip_confirmed'
           WHEN direct THEN 'MEDIUM|DEPENDENCY:boolean_flip_partial_evidence'
           ELSE 'LOW|DEPENDENCY:indirect' END AS sev,
      CASE WHEN direct AND quality = 2 THEN 'HIGH|direct_contradiction_with_file_evidence'
           WHEN direct AND quality >= 1 THEN 'MEDIUM|direct_contradiction_moderate_evidence'
           WHEN quality = 2 THEN 'MEDIUM|file_evidence_indirect_contradiction'
           WHEN quality = 1 THEN 'LOW|moderate_evidence_indirect_contradiction'
           ELSE 'LOW|weak_evidence' END AS conf
    FROM (SELECT *, least({_quality('l')}, {_quality('r')}) AS quality,
        ((l_value = 'true' AND r_value = 'false') OR (l_value = 'false' AND r_value = 'true')
          OR (l_value IN {words(fixed.ROLE_WORDS)} AND r_value IN {words(fixed.ROLE_WORDS)})) AS direct,
        (regexp_matches(canonical_subject, '{fixed.ROLE_SUBJECT}') OR contains(l_predicate, 'required_role')) AS auth,
        CASE WHEN regexp_matches(canonical_subject, '{fixed.ROLE_SUBJECT}') OR canonical_key IN {words(fixed.ROLE_KEYS)}
               OR regexp_matches(canonical_key, '{fixed.RULE_KEY}') THEN 'BUSINESS_RULE'
             WHEN regexp_matches(canonical_subject, '{fixed.CONTRACT_SUBJECT}')
               OR regexp_matches(canonical_key, '{fixed.CONTRACT_KEY}') THEN 'CONTRACT'
             WHEN regexp_matches(canonical_key, '{fixed.DEPENDENCY_KEY}')
               AND l_value IN ('true', 'false') AND r_value IN ('true', 'false') THEN 'DEPENDENCY'
        END AS conflict_type FROM pairs)
    WHERE conflict_type IS NOT NULL)"""


def fill(template: str) -> str:
    names = {
        "e": "canonical_subject", "l": "l_value", "r": "r_value",
        "ll": "coalesce(nullif(l_file, ''), replace(lower(l_source_type), '_', ' '))",
        "rl": "coalesce(nullif(r_file, ''), replace(lower(r_source_type), '_', ' '))",
        "ls": f"CASE WHEN l_value = 'true' THEN {q(fixed.PRESENT)} ELSE {q(fixed.ABSENT)} END",
        "rs": f"CASE WHEN r_value = 'true' THEN {q(fixed.PRESENT)} ELSE {q(fixed.ABSENT)} END",
    }
    if "{d}" in template:
        names["d"] = (
            f"CASE WHEN l_value = 'false' THEN {fill(fixed.MADE_OPTIONAL)} "
            f"ELSE {fill(fixed.MADE_REQUIRED)} END"
        )
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"({names[p]})" if i % 2 else q(p) for i, p in enumerate(parts) if i % 2 or p)


def by_type(templates: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {q(kind)} THEN {fill(t)}" for kind, t in templates.items())
    return f"CASE conflict_type {arms} END"


STAGES = {
    "units": _units(),
    "segs": SEGS,
    "found": _found(),
    "claims": CLAIMS,
    "norm": _norm(),
    "merged": MERGED,
    "pairs": PAIRS,
    "conflicts": CONFLICTS,
}


def upto(stage: str, body: str, **more: str) -> str:
    """``body`` behind the CTEs of every stage up to ``stage``."""
    names = list(STAGES)[: list(STAGES).index(stage) + 1]
    ctes = [f"{n} AS MATERIALIZED ({STAGES[n]})" for n in names]
    ctes += [f"{n} AS ({text})" for n, text in more.items()]
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- queries -------------------------------------------------------------------

UNIT = "session_id, part, change_seq, snippet_seq"
ORACLES: dict[str, str] = {
    "segments": upto("segs", f"SELECT {UNIT}, seg_idx, segment FROM segs"),
    "document_segments": f"""
      SELECT lang, count(*) AS n_segments, sum(length(segment)) AS n_chars, max(seg_idx) AS max_seg_idx
      FROM (SELECT lang, seg_idx, {btrim('piece')} AS segment FROM (
        SELECT lang, unnest(string_split_regex(text, '[.;\\n]')) AS piece,
          generate_subscripts(string_split_regex(text, '[.;\\n]'), 1) - 1 AS seg_idx FROM documents))
      WHERE length(segment) > 4 GROUP BY lang""",
    "category_hints": upto("units", f"SELECT {UNIT}, unit_id, category_hint FROM units"),
    "rule_matches": upto("found", "SELECT * EXCLUDE (unit_id) FROM found"),
    "claims": upto("claims", "SELECT * EXCLUDE (unit_id, claim_idx, claim_id) FROM claims"),
    "claim_ids": upto("claims", "SELECT session_id, claim_idx, claim_id FROM claims"),
    "extraction_diagnostics": upto(
        "found",
        f"""SELECT {UNIT}, unit_id, 'Unit "' || unit_id || '": ' || CASE
              WHEN {btrim('text')} = '' THEN 'empty text — no assumptions extracted'
              WHEN NOT EXISTS (SELECT 1 FROM segs s WHERE s.session_id = u.session_id AND s.part = u.part
                AND s.change_seq = u.change_seq AND s.snippet_seq = u.snippet_seq) THEN 'text too short to segment'
              ELSE 'no pattern matched — returning empty result (not hallucinating)' END AS message
            FROM units u WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.session_id = u.session_id
              AND f.part = u.part AND f.change_seq = u.change_seq AND f.snippet_seq = u.snippet_seq)""",
    ),
    "rule_counts": upto(
        "claims",
        "SELECT category, rule_id, count(*) AS n_claims, count(DISTINCT session_id) AS n_sessions FROM claims GROUP BY ALL",
    ),
    "norm_entities": upto(
        "norm", "SELECT session_id, claim_id, subject, canonical_subject, subject_why FROM norm"
    ),
    "norm_predicates": upto(
        "norm",
        """SELECT session_id, claim_id, predicate, canonical_key, canonical_value, canonical_predicate,
           key_why, value_why FROM norm""",
    ),
    "merged_claims": upto(
        "merged",
        """SELECT session_id, canonical_subject, canonical_predicate, claim_id, statement, source_file,
           n_claims FROM merged""",
    ),
    "merged_evidence": upto(
        "norm",
        """SELECT session_id, canonical_subject, canonical_predicate, claim_id || '__primary' AS ref_id,
           source_type, source_file AS file_path, evidence_text AS text FROM norm""",
    ),
    "conflict_pairs": upto(
        "conflicts",
        """SELECT session_id, canonical_subject, canonical_key, conflict_type, l_claim_id, r_claim_id,
           l_value, r_value FROM conflicts""",
    ),
    "conflicts": upto(
        "conflicts",
        """SELECT session_id, conflict_id, conflict_type, canonical_subject, canonical_key, l_value, r_value,
           severity, severity_rule, confidence, confidence_rule,
           concat_ws('|', l_file, CASE WHEN r_file IS DISTINCT FROM l_file THEN r_file END) AS files
           FROM conflicts""",
    ),
    "conflict_reports": upto(
        "conflicts",
        f"""SELECT session_id, conflict_id, conflict_type, canonical_subject AS affected_entity,
              {by_type(fixed.TITLES)} AS title, severity, confidence, severity_rule, confidence_rule,
              {by_type(fixed.WHY)} AS why_incompatible, {by_type(fixed.HINTS)} AS verification_hint,
              {by_type(fixed.EXPLANATIONS)} AS explanation,
              coalesce(nullif(l_file, ''), replace(lower(l_source_type), '_', ' ')) AS l_label,
              l_statement, l_predicate, l_evidence_text, l_file,
              coalesce(nullif(r_file, ''), replace(lower(r_source_type), '_', ' ')) AS r_label,
              r_statement, r_predicate, r_evidence_text, r_file FROM conflicts""",
    ),
}

FILES = """
  SELECT DISTINCT c.session_id, c.conflict_id, n.source_file AS file_path
  FROM conflicts c JOIN norm n ON n.session_id = c.session_id
    AND n.canonical_subject = c.canonical_subject
    AND n.canonical_predicate IN (c.l_predicate, c.r_predicate)
  WHERE n.source_file IS NOT NULL"""
ORDERED = """
  SELECT *, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END AS severity_order,
      replace(conflict_id, '_', ' ') AS id_order FROM conflicts"""
SHOWN = "SELECT * FROM conflicts"
SHOWN_FILES = "SELECT f.* FROM files f SEMI JOIN shown s ON f.session_id = s.session_id AND f.conflict_id = s.conflict_id"
RESULTS = """
  SELECT c_custkey AS session_id, coalesce(n_claims, 0) AS claims_found, coalesce(n_conflicts, 0) AS conflicts_found,
    CASE WHEN n_conflicts > 0 THEN 'CONFLICTS_FOUND' ELSE 'PASS' END AS status,
    CASE WHEN n_conflicts > 0 THEN n_conflicts || ' semantic conflict(s) detected. ' || coalesce(n_claims, 0) || ' assumptions extracted.'
         ELSE 'No semantic conflicts detected. ' || coalesce(n_claims, 0) || ' assumptions extracted and all agree.' END AS summary,
    coalesce(n_conflicts, 0) > 0 AS has_conflicts, coalesce(n_high, 0) AS high_severity_conflicts
  FROM customer
  LEFT JOIN (SELECT session_id, count(*) AS n_claims FROM claims GROUP BY 1) a ON a.session_id = c_custkey
  LEFT JOIN (SELECT session_id, count(*) AS n_conflicts, count(*) FILTER (severity = 'HIGH') AS n_high
             FROM conflicts GROUP BY 1) b ON b.session_id = c_custkey"""
CHANGED = " UNION ".join(
    f"SELECT o_custkey AS session_id, {corpus.path(s['at'])} AS path FROM orders" for s in corpus.SNIPPETS
)
COVERED = f"""
  SELECT o_custkey AS session_id, o_orderkey AS criterion_key, description, EXISTS (
      SELECT 1 FROM claims c WHERE c.session_id = o_custkey
        AND contains(lower(c.statement), lower(description))) AS covered
  FROM (SELECT *, {corpus.CRITERION} AS description FROM orders)"""
FIRST_ID = """
  SELECT session_id, statement, claim_id FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, statement
      ORDER BY part, change_seq, snippet_seq, seg_idx, rule_idx) AS nth FROM claims) WHERE nth = 1"""
SNIPPET_FILES = " UNION ALL ".join(
    f"SELECT o_custkey AS session_id, {corpus.path(s['at'])} AS path, o_orderkey AS seq, "
    f"{corpus.CHANGE_ID} AS branch_name FROM orders"
    for s in corpus.SNIPPETS
)
CHANGE_ROWS = f"SELECT o_custkey AS session_id, {corpus.CHANGE_ID} AS change_id, {corpus.LABEL} AS label FROM orders"
PASSPORTS = """
  SELECT 'live-' || CAST(session_id AS VARCHAR) AS passport_id, r.session_id, intent,
    coalesce(files_changed, 0) AS files_changed, coalesce(n_components, 0) AS n_components,
    claims_found, conflicts_found,
    CASE WHEN conflicts_found > 0 THEN summary END AS remaining_risk,
    CASE WHEN conflicts_found > 0 THEN 'FAIL' ELSE 'PASS' END AS status
  FROM results r JOIN intents USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS files_changed FROM changed GROUP BY 1) USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS n_components FROM (
      SELECT session_id, file_path FROM shown_files
      UNION SELECT session_id, split_part(path, '/', 1) FROM changed) GROUP BY 1) USING (session_id)"""
PASSPORT_CTES = dict(
    files=FILES, shown=SHOWN, shown_files=SHOWN_FILES, results=RESULTS, changed=CHANGED,
    intents=f"SELECT c_custkey AS session_id, {corpus.REQUIREMENT} AS intent FROM customer",
)


def _line(label: str, value: str) -> str:
    return f"'{(label + ':').ljust(22)}' || {value}"


_TEXT = " || chr(10) || ".join(
    [
        "'CHANGE PASSPORT'", "''", _line("Feature", "'—'"), _line("Intent", "intent"),
        _line("Repository", "'—'"), _line("Branches", "'—'"), _line("Files Changed", "files_changed"),
        _line("Components", "n_components"), "''", _line("Assumptions Found", "claims_found"),
        _line("Verified", "'—'"), _line("Conflicts Found", "conflicts_found"), _line("Resolved", "'0'"),
        _line("Tests", "'— / —'"), _line("Req. Coverage", "'—'"), "''",
        _line("Remaining Risk", "coalesce(remaining_risk, 'None identified')"),
        _line("Verification Status", "status"), "''", _line("Passport ID", "passport_id"),
        _line("Session ID", "session_id"), _line("Generated", "'—'"),
    ]
)
_SIDES = """SELECT session_id, conflict_id, conflict_id || '::a' AS id, l_statement AS label FROM shown
  UNION ALL SELECT session_id, conflict_id, conflict_id || '::b', r_statement FROM shown"""

ORACLES |= {
    "report_files": upto("conflicts", FILES),
    "report_evidence": upto(
        "conflicts",
        """SELECT c.session_id, c.conflict_id, n.claim_id || '__primary' AS ref_id,
             CASE WHEN n.canonical_predicate = c.l_predicate THEN 0 ELSE 1 END AS side,
             n.source_file AS file_path, n.evidence_text AS text
           FROM conflicts c JOIN norm n ON n.session_id = c.session_id
             AND n.canonical_subject = c.canonical_subject
             AND n.canonical_predicate IN (c.l_predicate, c.r_predicate)""",
    ),
    "domain_claims": upto(
        "claims",
        """SELECT c.session_id, claim_id AS id, coalesce(b.branch_name, f.branch_name) AS branch_name,
             coalesce(source_file, '—') AS source_file, statement, subject AS concept, predicate AS value,
             'change' AS source_agent, CASE WHEN source_file <> '' THEN 'FILE_CHANGE' ELSE 'INFERRED' END AS evidence_source,
             evidence_text AS snippet, confidence,
             CASE confidence WHEN 'HIGH' THEN 0.9::DOUBLE WHEN 'MEDIUM' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS numeric_confidence
           FROM claims c
           LEFT JOIN (SELECT session_id, path, arg_min(branch_name, seq) AS branch_name FROM snippet_files GROUP BY ALL) b
             ON b.session_id = c.session_id AND b.path = c.source_file
           LEFT JOIN (SELECT session_id, arg_min(branch_name, seq) AS branch_name FROM snippet_files GROUP BY ALL) f
             ON f.session_id = c.session_id""",
        snippet_files=SNIPPET_FILES,
    ),
    "findings": upto(
        "conflicts",
        f"""SELECT c.session_id, conflict_id, {by_type(fixed.TITLES)} AS title, {by_type(fixed.WHY)} AS description,
              severity, conflict_type AS category, concat_ws('|', a.claim_id, b.claim_id) AS affected_claim_ids
            FROM conflicts c LEFT JOIN first_id a ON a.session_id = c.session_id AND a.statement = l_statement
            LEFT JOIN first_id b ON b.session_id = c.session_id AND b.statement = r_statement""",
        first_id=FIRST_ID,
    ),
    "finding_status": upto(
        "conflicts",
        """SELECT c_custkey AS session_id, count(conflict_id) AS conflicts_found, 0 AS conflicts_resolved, 0 AS critical,
             count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
             count(*) FILTER (severity = 'LOW') AS low,
             CASE WHEN count(conflict_id) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
           FROM customer LEFT JOIN conflicts ON session_id = c_custkey GROUP BY c_custkey""",
    ),
    "display_conflicts": upto(
        "conflicts",
        f"""SELECT session_id, conflict_id, conflict_type AS kind, severity,
              CASE confidence WHEN 'HIGH' THEN 90 WHEN 'MEDIUM' THEN 65 ELSE 40 END AS confidence,
              {corpus.REQUIREMENT} AS requirement_text, conflict_id || '::a' AS claim_a,
              coalesce(l_file, '—') AS file_a, conflict_id || '::b' AS claim_b,
              coalesce(r_file, replace(lower(r_source_type), '_', ' ')) AS produced_by_b, l_evidence_text AS snippet_a
            FROM conflicts JOIN customer ON c_custkey = session_id""",
    ),
    "top_conflicts": upto(
        "conflicts", f"SELECT session_id, severity_order, id_order, conflict_id, severity FROM ({ORDERED})"
    ),
    "severity_counts": upto(
        "conflicts",
        """SELECT c_custkey AS session_id, 0 AS critical, count(*) FILTER (severity = 'HIGH') AS high,
             count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low,
             count(conflict_id) AS conflicts_found
           FROM customer LEFT JOIN conflicts ON session_id = c_custkey GROUP BY c_custkey""",
    ),
    "session_results": upto("conflicts", RESULTS),
    "conflict_groups": upto(
        "conflicts",
        """SELECT session_id, canonical_subject, canonical_key, conflict_type, count(*) AS n_values,
             CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_pairs FROM (
             SELECT DISTINCT session_id, canonical_subject, canonical_key, conflict_type, unnest([l_value, r_value]) AS value FROM conflicts)
           GROUP BY ALL""",
    ),
    "high_conflicts": upto(
        "conflicts",
        "SELECT session_id, conflict_id, conflict_type, severity_rule FROM conflicts WHERE severity = 'HIGH'",
    ),
    "passport_components": upto(
        "conflicts",
        """SELECT session_id, file_path AS component FROM shown_files
           UNION SELECT session_id, split_part(path, '/', 1) FROM changed WHERE split_part(path, '/', 1) <> ''""",
        **PASSPORT_CTES,
    ),
    "verification_summaries": upto(
        "conflicts",
        """SELECT r.session_id, claims_found, r.conflicts_found, 0 AS conflicts_resolved, coalesce(files_changed, 0) AS files_changed,
             requirement_coverage, 0 AS critical, high, medium, low, CASE WHEN r.conflicts_found > 0 THEN 'FAIL' ELSE 'PASS' END AS status
           FROM results r
           JOIN (SELECT c_custkey AS session_id, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
                   count(*) FILTER (severity = 'LOW') AS low FROM customer LEFT JOIN conflicts ON session_id = c_custkey GROUP BY 1) USING (session_id)
           LEFT JOIN (SELECT session_id, count(*) AS files_changed FROM changed GROUP BY 1) USING (session_id)
           LEFT JOIN (SELECT session_id, CAST(floor(100.0 * count(*) FILTER (covered) / count(*) + 0.5) AS INTEGER) AS requirement_coverage
                      FROM covered_rows GROUP BY 1) USING (session_id)""",
        results=RESULTS, changed=CHANGED, covered_rows=COVERED,
    ),
    "result_stats": upto(
        "conflicts",
        f"""SELECT r.session_id, claims_found, coalesce(candidates, 0) AS candidates, conflicts_found, coalesce(dismissed, 0) AS dismissed
            FROM results r LEFT JOIN (SELECT o_custkey AS session_id, count(*) AS candidates,
              count(*) FILTER (status = 'DISMISSED') AS dismissed
              FROM (SELECT o_custkey, {corpus.CANDIDATE_STATUS} AS status FROM orders) GROUP BY 1) USING (session_id)""",
        results=RESULTS,
    ),
    "covered_criteria": upto("claims", COVERED),
    "requirement_coverage": upto(
        "claims",
        """SELECT c_custkey AS session_id, count(criterion_key) AS criteria, count(*) FILTER (covered) AS covered,
             CASE WHEN count(criterion_key) > 0
               THEN CAST(floor(100.0 * count(*) FILTER (covered) / count(criterion_key) + 0.5) AS INTEGER) END AS requirement_coverage
           FROM customer LEFT JOIN covered_rows ON session_id = c_custkey GROUP BY c_custkey""",
        covered_rows=COVERED,
    ),
    "passports": upto("conflicts", PASSPORTS, **PASSPORT_CTES),
    "passport_texts": upto(
        "conflicts", f"SELECT session_id, {_TEXT} AS text FROM ({PASSPORTS})", **PASSPORT_CTES
    ),
    "graph_nodes": upto(
        "conflicts",
        f"""SELECT *, CASE kind WHEN 'REQUIREMENT' THEN 0 WHEN 'CHANGE' THEN 1 WHEN 'ASSUMPTION' THEN 2
              WHEN 'FILE' THEN 3 ELSE 4 END AS tier FROM (
            SELECT c_custkey AS session_id, 'req-0' AS id, 'REQUIREMENT' AS kind, 'Requirement' AS label, NULL AS severity FROM customer
            UNION ALL SELECT session_id, change_id, 'CHANGE', label, NULL FROM ({CHANGE_ROWS})
            UNION ALL SELECT session_id, id, 'ASSUMPTION', label, NULL FROM ({_SIDES})
            UNION ALL SELECT session_id, conflict_id, 'CONFLICT', canonical_subject, severity FROM shown
            UNION ALL SELECT DISTINCT session_id, 'file:' || file_path, 'FILE', file_path, NULL FROM shown_files)""",
        files=FILES, shown=SHOWN, shown_files=SHOWN_FILES,
    ),
    "graph_edges": upto(
        "conflicts",
        f"""SELECT session_id, 'req-0' AS from_id, change_id AS to_id, 'frames' AS label FROM ({CHANGE_ROWS})
            UNION ALL SELECT session_id, id, conflict_id, 'contradicts' FROM ({_SIDES})
            UNION ALL SELECT session_id, 'file:' || file_path, conflict_id, 'evidences' FROM shown_files""",
        files=FILES, shown=SHOWN, shown_files=SHOWN_FILES,
    ),
}

# --- diffs, files, responses, refs ----------------------------------------------

DIFFS = f"""
  SELECT o_custkey AS session_id, o_orderkey AS diff_id, {corpus.DIFF_BRANCH} AS branch_name, {corpus.RAW_DIFF} AS raw
  FROM (SELECT *, {corpus.sentence('n1', 'r1')} AS s1, {corpus.sentence('n2', 'r2')} AS s2 FROM (
    SELECT *, {corpus.role('n1')} AS r1, {corpus.role('n2')} AS r2 FROM (
      SELECT *, o_orderkey % 50 + 1 AS k, {corpus.path('o_orderkey')} AS p1, {corpus.path('o_orderkey + 3')} AS p2,
        {corpus.DIFF_NUMBERS['n1']} AS n1, {corpus.DIFF_NUMBERS['n2']} AS n2 FROM orders)))"""
# RE2 has no look-around: split at the marker text and put the marker back.
CHUNKS = """
  SELECT session_id, diff_id, branch_name, pos - 2 AS file_idx, 'diff --git ' || piece AS chunk FROM (
    SELECT *, unnest(string_split(raw, 'diff --git ')) AS piece,
      generate_subscripts(string_split(raw, 'diff --git '), 1) AS pos FROM diffs) WHERE pos > 1
  UNION ALL
  SELECT session_id, diff_id, branch_name, pos - 2,
    'diff --git a/' || regexp_extract(piece, '^a/(.*)', 1) || ' b/' ||
      CASE WHEN contains(piece, '+++ /dev/null') THEN regexp_extract(piece, '^a/(.*)', 1)
           ELSE regexp_extract(piece, '(?m)^\\+\\+\\+ b/(.*)$', 1) END
    || chr(10) || '--- ' || piece || CASE WHEN pos < n THEN chr(10) ELSE '' END FROM (
    SELECT *, len(pieces) AS n, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos
    FROM (SELECT *, string_split(chr(10) || raw, chr(10) || '--- ') AS pieces FROM diffs
          WHERE NOT contains(raw, 'diff --git '))) WHERE pos > 1"""
SHREDDED = """
  SELECT *, CASE WHEN regexp_matches(chunk, '(?m)^new file mode') THEN 'ADDED'
      WHEN regexp_matches(chunk, '(?m)^deleted file mode') THEN 'DELETED'
      WHEN regexp_matches(chunk, '(?m)^rename to ') THEN 'RENAMED' ELSE 'MODIFIED' END AS kind,
    CASE WHEN regexp_matches(chunk, '(?m)^rename to ') THEN regexp_extract(chunk, '(?m)^rename to (.*)$', 1)
      ELSE regexp_extract(chunk, '^diff --git a/(.+?) b/([^\\n]+)', 2) END AS path,
    CASE WHEN regexp_matches(chunk, '(?m)^rename from ') THEN regexp_extract(chunk, '(?m)^rename from (.*)$', 1) END AS previous_path,
    regexp_matches(chunk, '(?m)^Binary files? .+ differ$') AS is_binary,
    CASE WHEN regexp_matches(chunk, '(?m)^Binary files? .+ differ$') THEN NULL
      WHEN ends_with(chunk, chr(10)) THEN chunk ELSE chunk || chr(10) END AS patch
  FROM chunks"""
HUNKS = """
  SELECT *, raw_lines[1] AS header, [x FOR x IN raw_lines[2:] IF starts_with(x, '+')] AS added,
    [x FOR x IN raw_lines[2:] IF starts_with(x, '-')] AS removed,
    CAST(regexp_extract(raw_lines[1], '^@@ -(\\d+)(,(\\d+))? \\+(\\d+)(,(\\d+))? @@(.*)', 1) AS BIGINT) AS base_start,
    coalesce(TRY_CAST(regexp_extract(raw_lines[1], '^@@ -(\\d+)(,(\\d+))? \\+(\\d+)(,(\\d+))? @@(.*)', 3) AS BIGINT), 1) AS base_count,
    CAST(regexp_extract(raw_lines[1], '^@@ -(\\d+)(,(\\d+))? \\+(\\d+)(,(\\d+))? @@(.*)', 4) AS BIGINT) AS head_start,
    coalesce(TRY_CAST(regexp_extract(raw_lines[1], '^@@ -(\\d+)(,(\\d+))? \\+(\\d+)(,(\\d+))? @@(.*)', 6) AS BIGINT), 1) AS head_count,
    trim(regexp_extract(raw_lines[1], '^@@ -(\\d+)(,(\\d+))? \\+(\\d+)(,(\\d+))? @@(.*)', 7)) AS context_label
  FROM (SELECT *, pos - 2 AS hunk_idx, string_split('@@ -' || piece, chr(10)) AS raw_lines FROM (
    SELECT *, unnest(string_split(chunk, chr(10) || '@@ -')) AS piece,
      generate_subscripts(string_split(chunk, chr(10) || '@@ -'), 1) AS pos FROM files WHERE NOT is_binary)
    WHERE pos > 1)"""


def shredded(body: str, **more: str) -> str:
    ctes = {"diffs": DIFFS, "chunks": CHUNKS, "files": SHREDDED, "hunks": HUNKS, **more}
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ctes.items()) + "\n" + body


_RANGE = """CASE WHEN head_start > 0 THEN head_start END AS line_start,
  CASE WHEN head_start > 0 THEN CASE WHEN head_count > 0 THEN head_start + head_count - 1 ELSE head_start END END AS line_end,
  nullif(array_to_string(added || removed, chr(10)), '') AS snippet"""
EVIDENCE = f"""
  SELECT diff_id, file_idx, branch_name, 'FILE_CHANGE' AS source, path AS file_path, hunk_idx AS evidence_idx, {_RANGE},
    'additions=' || len(added) || '|changeKind=' || kind || CASE WHEN context_label <> '' THEN '|contextLabel=' || context_label ELSE '' END
    || '|deletions=' || len(removed) || '|hunkIndex=' || hunk_idx
    || CASE WHEN previous_path <> '' THEN '|previousPath=' || previous_path ELSE '' END AS metadata FROM hunks
  UNION ALL
  SELECT diff_id, file_idx, branch_name, 'FILE_CHANGE', path, 0, NULL, NULL, NULL,
    CASE WHEN is_binary THEN 'changeKind=' || kind || '|isBinary=true'
      ELSE 'changeKind=RENAMED|previousPath=' || coalesce(previous_path, '') END
  FROM files WHERE is_binary OR (kind = 'RENAMED' AND NOT contains(chunk, chr(10) || '@@'))"""
CHANGED_ROWS = f"""
  SELECT l_suppkey AS session_id, l_orderkey, l_linenumber, l_partkey, {corpus.FILE_BRANCH} AS branch_name,
    {corpus.FILE_PATH} AS path, {corpus.FILE_PATCH} AS patch FROM lineitem"""
DEDUPED = f"""
  SELECT session_id, branch_name, path, first_order, first_line, first_part, patch FROM (
    SELECT *, row_number() OVER (w ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS nth,
      first_value(l_orderkey) OVER (w ORDER BY l_orderkey, l_linenumber, l_partkey) AS first_order,
      first_value(l_linenumber) OVER (w ORDER BY l_orderkey, l_linenumber, l_partkey) AS first_line,
      first_value(l_partkey) OVER (w ORDER BY l_orderkey, l_linenumber, l_partkey) AS first_part
    FROM ({CHANGED_ROWS}) WINDOW w AS (PARTITION BY session_id, branch_name, path)) WHERE nth = 1"""
RESPONSES = f"""
  SELECT user_id AS session_id, event_id AS response_id, {corpus.AGENT} AS agent, {corpus.RESPONSE} AS raw_text FROM events"""
PARSED = """
  SELECT *, CASE WHEN NOT json_valid(body) THEN 'invalid JSON'
      WHEN json_type(body) <> 'OBJECT' THEN 'response must be a JSON object with an "assumptions" array'
      WHEN coalesce(json_type(body, '$.assumptions'), '') <> 'ARRAY' THEN 'response is missing the "assumptions" array' END AS refused
  FROM (SELECT *, CASE WHEN starts_with(raw_text, '```') THEN trim(regexp_extract(raw_text, '(?s)^```(?:json)?\\s*(.*?)\\s*```$', 1), ' ' || chr(10))
                  ELSE trim(raw_text) END AS body FROM responses)"""


def _text_member(name: str) -> str:
    return f"CASE WHEN json_type(item, '$.{name}') = 'VARCHAR' THEN nullif(trim(json_extract_string(item, '$.{name}')), '') END"


ITEMS = f"""
  SELECT *, CASE WHEN statement IS NULL THEN 'assumption #' || item_idx || ': "statement" must be a non-empty string'
      WHEN value IS NULL THEN 'assumption #' || item_idx || ': "value" must be a non-empty string'
      WHEN branch_name IS NULL OR branch_name NOT IN ('feature/a', 'feature/b')
        THEN 'assumption #' || item_idx || ': "branch" must be exactly "feature/a" or "feature/b"' END AS error
  FROM (SELECT session_id, response_id, agent, item_idx, item,
      {_text_member('statement')} AS statement, {_text_member('value')} AS value, {_text_member('branch')} AS branch_name
    FROM (SELECT *, unnest(CAST(json_extract(body, '$.assumptions') AS JSON[])) AS item,
        generate_subscripts(CAST(json_extract(body, '$.assumptions') AS JSON[]), 1) - 1 AS item_idx
      FROM parsed WHERE refused IS NULL))"""
REASONS = """
  SELECT p.session_id, p.response_id, p.agent, coalesce(refused, first_error) AS reason
  FROM parsed p LEFT JOIN (SELECT response_id, arg_min(error, item_idx) AS first_error FROM items
    WHERE error IS NOT NULL GROUP BY 1) e ON e.response_id = p.response_id"""
JSON_CLAIMS = f"""
  SELECT session_id, response_id, agent, item_idx,
    coalesce({_text_member('id')}, 'claim-' || response_id || '-' || item_idx) AS id, statement, value, branch_name,
    coalesce({_text_member('concept')}, trim(regexp_replace(lower(statement), '[^a-z0-9]+', '-', 'g'), '-')) AS concept,
    source_file, line, snippet, numeric_confidence,
    CASE WHEN numeric_confidence >= 0.9 THEN 'HIGH' WHEN numeric_confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    CASE WHEN snippet IS NOT NULL AND source_file <> '—' THEN 'FILE_CHANGE' ELSE 'INFERRED' END AS evidence_source
  FROM (SELECT i.*, coalesce({_text_member('file')}, '—') AS source_file,
      CASE WHEN TRY_CAST(json_extract_string(item, '$.line') AS BIGINT) >= 1 THEN TRY_CAST(json_extract_string(item, '$.line') AS BIGINT) END AS line,
      {_text_member('evidence')} AS snippet,
      least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(TRY_CAST(json_extract_string(item, '$.confidence') AS DOUBLE), 0.6::DOUBLE))) AS numeric_confidence
    FROM items i JOIN reasons r ON r.response_id = i.response_id AND r.reason IS NULL)"""


def responded(body: str, **more: str) -> str:
    ctes = {"responses": RESPONSES, "parsed": PARSED, "items": ITEMS, "reasons": REASONS, **more}
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ctes.items()) + "\n" + body


def unique_lines(source: str, order: list[str]) -> str:
    """First place of each distinct non-blank line of ``source(session_id, ..., text)``."""
    cols = ", ".join(order)
    return f"""
      SELECT session_id, {cols}, line_idx, line FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, line ORDER BY {cols}, line_idx) AS nth FROM (
          SELECT session_id, {cols}, line_idx, {btrim('piece')} AS line FROM (
            SELECT session_id, {cols}, unnest(string_split(text, chr(10))) AS piece,
              generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM {source}))
        WHERE line <> '') WHERE nth = 1"""


CLAIM_TEXT = """
  SELECT *, '[' || agent || '] ' || statement || ' — value: ' || value || ' @ ' || source_file || ' (' || branch_name || ')'
    || CASE WHEN snippet IS NOT NULL THEN ' :: ' || snippet ELSE '' END AS text FROM json_claims"""
STATUS_ROWS = f"""
  SELECT user_id AS session_id, arg_max({corpus.STATUS}, (ts, event_id)) AS status, count(*) AS n_events
  FROM events GROUP BY 1"""
_ext = " ".join(
    f"WHEN lower(split_part(path, '.', -1)) IN {words(exts)} THEN {q(name)}" for name, exts in fixed.LANGUAGES.items()
)
_u = "trim(u)"
URLS = rf"""
  SELECT *, CASE WHEN scheme <> 'https' THEN 'unsupported repository scheme "' || scheme || ':" — only https://github.com URLs are supported'
      WHEN host <> 'github.com' THEN 'unsupported repository host "' || host || '" — only github.com is supported in this MVP'
      WHEN contains(authority, '@') THEN 'repository URLs containing credentials are not allowed'
      WHEN contains(authority, ':') THEN 'repository URLs containing a port are not allowed'
      WHEN len(pieces) <> 2 THEN 'invalid GitHub repository path "' || path || '" — expected /<owner>/<repo>'
      WHEN NOT regexp_full_match(pieces[1], '[A-Za-z0-9_.-]+') OR NOT regexp_full_match(repo_name, '[A-Za-z0-9_.-]+')
        THEN 'invalid GitHub repository "' || pieces[1] || '/' || repo_name || '" — owner and repo may only contain letters, numbers, ''.'', ''_'' and ''-'''
      END AS error
  FROM (SELECT *, [x FOR x IN string_split(path, '/') IF x <> ''] AS pieces,
      regexp_replace([x FOR x IN string_split(path, '/') IF x <> ''][2], '\.git$', '') AS repo_name
    FROM (SELECT page_id, u AS url, lower(regexp_extract({_u}, '^(\w+)://', 1)) AS scheme,
        regexp_extract({_u}, '^\w+://([^/?#]*)', 1) AS authority,
        lower(regexp_replace(regexp_replace(regexp_extract({_u}, '^\w+://([^/?#]*)', 1), '^.*@', ''), ':\d+$', '')) AS host,
        regexp_extract({_u}, '^\w+://[^/?#]*([^?#]*)', 1) AS path
      FROM (SELECT page_id, {corpus.REPO_URL} AS u FROM pages)))"""

ORACLES |= {
    "diff_files": shredded(
        """SELECT session_id, diff_id, branch_name, file_idx, path, previous_path, kind, is_binary,
             coalesce(n_added, 0) AS additions, coalesce(n_removed, 0) AS deletions, patch, coalesce(n, 0) AS n_hunks
           FROM files LEFT JOIN (SELECT diff_id, file_idx, count(*) AS n, sum(len(added)) AS n_added, sum(len(removed)) AS n_removed
             FROM hunks GROUP BY ALL) USING (diff_id, file_idx)"""
    ),
    "diff_hunks": shredded(
        """SELECT diff_id, file_idx, path, hunk_idx, base_start, base_count, head_start, head_count, context_label,
             '@@ -' || piece AS raw_hunk FROM hunks"""
    ),
    "diff_lines": shredded(
        """SELECT diff_id, file_idx, path, hunk_idx, 'added' AS change, unnest(added) AS line, generate_subscripts(added, 1) - 1 AS line_idx FROM hunks
           UNION ALL SELECT diff_id, file_idx, path, hunk_idx, 'removed', unnest(removed), generate_subscripts(removed, 1) - 1 FROM hunks"""
    ),
    "split_diff_files": shredded(
        """SELECT path, previous_path, kind, is_binary, coalesce(n_added, 0) AS additions, coalesce(n_removed, 0) AS deletions,
             coalesce(n, 0) AS n_hunks, md5(rtrim(patch, chr(10))) AS patch_md5
           FROM files LEFT JOIN (SELECT diff_id, file_idx, count(*) AS n, sum(len(added)) AS n_added, sum(len(removed)) AS n_removed
             FROM hunks GROUP BY ALL) USING (diff_id, file_idx)""",
        diffs=f"SELECT session_id, diff_id, branch_name, {corpus.EXPORT_HEADER} || raw AS raw FROM ({DIFFS})",
    ),
    "repository_contexts": f"""
      WITH sessions AS (
        SELECT s_suppkey AS session_id, {corpus.REPOSITORY.format(n='s_suppkey')} AS repository, {corpus.CLONE_URL} AS clone_url,
          coalesce({corpus.PROVIDER}, 'local') AS provider, timestamp '1996-01-01 12:00:00' + to_days(CAST(s_suppkey % 1500 AS INT)) AS at_time,
          CASE s_suppkey % 2 {' '.join(f"WHEN {k} THEN [{', '.join(map(q, names))}]" for k, names in corpus.FEATURES.items())} END AS features
        FROM supplier),
      log AS (SELECT {corpus.REPOSITORY.format(n='o_custkey')} AS repository, {corpus.PUSHED_BRANCH} AS branch_name, o_orderdate AS ts,
          o_orderkey AS event_id, {corpus.PUSHED_SHA} AS sha FROM orders),
      wanted AS (SELECT session_id, repository, at_time, unnest(list_prepend('main', features)) AS branch_name,
          generate_subscripts(list_prepend('main', features), 1) AS place FROM sessions),
      resolved AS (SELECT session_id, place, w.branch_name, arg_max(sha, (ts, event_id)) AS sha
          FROM wanted w JOIN log l ON l.repository = w.repository AND l.branch_name = w.branch_name AND ts <= at_time GROUP BY ALL),
      listed AS (SELECT session_id, max(sha) FILTER (place = 1) AS base_sha,
          string_agg(branch_name || '@' || sha, '|' ORDER BY place) FILTER (place > 1) AS features FROM resolved GROUP BY 1),
      counted AS (SELECT session_id, count(*) AS n FROM ({DEDUPED}) JOIN (SELECT DISTINCT session_id, branch_name FROM wanted WHERE place > 1)
          USING (session_id, branch_name) GROUP BY 1)
      SELECT session_id, repository AS name, clone_url, provider, base_sha, listed.features, strftime(at_time, '%Y-%m-%d') AS resolved_on,
        coalesce(n, 0) AS n_files, coalesce(n, 0) AS n_evidence
      FROM sessions JOIN listed USING (session_id) LEFT JOIN counted USING (session_id)""",
    "languages": f"""SELECT language, count(*) AS n_files FROM (
        SELECT CASE {_ext} END AS language FROM ({CHANGED_ROWS})) GROUP BY 1""",
    "code_evidence": shredded(EVIDENCE),
    "patch_evidence": shredded(
        f"""SELECT diff_id, file_idx, file_path, evidence_idx, line_start, line_end, snippet,
              CASE WHEN contains(metadata, 'isBinary') THEN 'changeKind=MODIFIED' ELSE metadata END AS metadata FROM ({EVIDENCE})"""
    ),
    "comparison_snippets": shredded(
        f"SELECT diff_id, file_idx, path AS file_path, hunk_idx, {_RANGE}, 'GIT_DIFF' AS source FROM hunks"
    ),
    "files_deduped": f"SELECT session_id, branch_name, path, first_order, first_line, md5(patch) AS patch_md5 FROM ({DEDUPED})",
    "files_forwarded": f"""
      SELECT session_id, branch_name, path, first_order, first_line, length(patch) AS n_chars, md5(patch) AS content_md5
      FROM ({DEDUPED}) WHERE trim(patch) <> ''""",
    "ingestion_warnings": f"""
      SELECT session_id, 'BINARY_OR_EMPTY_PATCH' AS code, path || ' on ' || branch_name || ' has no textual patch — excluded from semantic input' AS message
      FROM ({DEDUPED}) WHERE patch IS NULL""",
    "diff_limits": f"""
      SELECT session_id, count(*) AS n_files, sum(coalesce(strlen(patch), 0)) AS diff_bytes FROM ({CHANGED_ROWS}) GROUP BY 1""",
    "files_changed": f"SELECT session_id, count(DISTINCT path) AS files_changed FROM ({CHANGED_ROWS}) GROUP BY 1",
    "branch_by_file": f"""SELECT session_id, path, branch_name FROM (SELECT *, row_number() OVER (
        PARTITION BY session_id, path ORDER BY l_orderkey, l_linenumber, l_partkey) AS nth FROM ({CHANGED_ROWS})) WHERE nth = 1""",
    "head_comparisons": f"""
      SELECT s_suppkey AS session_id, h.branch_name, count(c.path) AS n_files, coalesce(sum(strlen(patch)), 0) AS patch_bytes
      FROM supplier CROSS JOIN (VALUES ('feature/a'), ('feature/n'), ('feature/r'), ('feature/idle')) h(branch_name)
      LEFT JOIN ({CHANGED_ROWS}) c ON c.session_id = s_suppkey AND c.branch_name = h.branch_name GROUP BY 1, 2""",
    "head_files": f"""
      SELECT session_id, branch_name, path, md5(patch) AS patch_md5 FROM ({DEDUPED})
      WHERE branch_name IN ('feature/a', 'feature/n', 'feature/r', 'feature/idle') AND session_id IN (SELECT s_suppkey FROM supplier)""",
    "ordered_branches": f"""
      SELECT session_id, branch_name, CASE branch_name WHEN 'feature/r' THEN 0 WHEN 'feature/a' THEN 1 END AS declared_seq,
        min(l_orderkey) AS first_order FROM ({CHANGED_ROWS}) GROUP BY session_id, branch_name""",
    "json_claims": responded(JSON_CLAIMS),
    "json_rejects": responded(
        "SELECT session_id, response_id, agent, agent || ': ' || reason AS message FROM reasons WHERE reason IS NOT NULL"
    ),
    "agent_lines": responded(
        unique_lines(f"({CLAIM_TEXT})", ["response_id", "item_idx"]), json_claims=JSON_CLAIMS
    ),
    "dedup_lines": unique_lines("(SELECT conv_id AS session_id, turn, text FROM conversations)", ["turn"]),
    "document_lines": f"""SELECT session_id, count(*) AS n_lines, sum(length(line)) AS n_chars, max(line_idx) AS max_line_idx
      FROM ({unique_lines("(SELECT source AS session_id, doc_id, text FROM documents)", ["doc_id"])}) GROUP BY 1""",
    "capped_texts": """SELECT doc_id, part, length(content) AS n_chars, md5(content) AS part_md5 FROM (
        SELECT doc_id, part, substr(text, part * 12000 + 1, 12000) AS content
        FROM (SELECT *, unnest(range(0, greatest((length(text) - 1) // 12000 + 1, 1))) AS part FROM documents))""",
    "repo_urls": f"""SELECT page_id, url, error, CASE WHEN error IS NULL THEN pieces[1] END AS owner,
        CASE WHEN error IS NULL THEN repo_name END AS repo,
        CASE WHEN error IS NULL THEN 'https://github.com/' || pieces[1] || '/' || repo_name END AS canonical_url,
        CASE WHEN error IS NULL THEN pieces[1] || '/' || repo_name END AS name FROM ({URLS})""",
    "ref_names": rf"""SELECT p_partkey, ref, CASE WHEN trim(ref) = '' THEN 'branch is required — provide a branch name or commit SHA'
        WHEN regexp_matches(ref, '^[-/]') THEN 'branch "' || ref || '" must not start with ''-'' or ''/'''
        WHEN contains(ref, '..') OR regexp_matches(trim(ref), '\s') THEN 'branch "' || trim(ref) || '" contains a forbidden sequence'
        WHEN regexp_full_match(ref, '[0-9a-fA-F]+') THEN CASE WHEN length(ref) NOT BETWEEN 4 AND 64 THEN 'branch "' || ref || '" is not a valid commit SHA' END
        WHEN NOT regexp_full_match(ref, '[A-Za-z0-9._/-]+') THEN 'branch "' || ref || '" contains invalid characters — use letters, numbers, ''.'', ''_'', ''/'' and ''-'' only'
        END AS error, NOT (regexp_full_match(trim(ref), '[0-9a-fA-F]+') AND length(trim(ref)) BETWEEN 4 AND 64) AS is_branch
      FROM (SELECT p_partkey, {corpus.REF_NAME} AS ref FROM part)""",
    "branch_hash": """SELECT c_custkey, repeat(lpad(lower(to_hex(CAST(list_reduce(
        [CAST(ord(x) AS BIGINT) FOR x IN string_split(c_name, '')], lambda a, b: (a * 31 + b) % 4294967296, CAST(0 AS BIGINT)) AS BIGINT))), 8, '0'), 5) AS sha
      FROM customer""",
    "session_status": STATUS_ROWS,
    "session_stages": f"""
      SELECT session_id, idx, stage, state, CASE WHEN state = 'RUNNING' THEN CASE status WHEN 'PENDING' THEN 'Session queued…'
          WHEN 'INGESTING' THEN 'Fetching repository and extracting real diffs…' WHEN 'ANALYZING' THEN 'Extracting semantic assumptions…'
          ELSE 'Working…' END WHEN state = 'COMPLETE' AND status <> 'COMPLETE' THEN 'Done' END AS finding
      FROM (SELECT *, CASE WHEN status = 'COMPLETE' OR idx < stage_at THEN 'COMPLETE' WHEN idx = stage_at THEN 'RUNNING' ELSE 'PENDING' END AS state
        FROM (SELECT *, CASE status WHEN 'INGESTING' THEN 1 WHEN 'ANALYZING' THEN 2 ELSE 0 END AS stage_at FROM ({STATUS_ROWS}))
        CROSS JOIN (VALUES (0, 'intent'), (1, 'contract'), (2, 'dependency'), (3, 'adversary'), (4, 'change')) s(idx, stage))""",
    "merge_attestations": f"""
      SELECT conv_id AS session_id, turn, CASE WHEN status IS NULL THEN 'Session not found'
          WHEN status <> 'COMPLETE' THEN 'Only COMPLETE sessions can be marked as merged' END AS error,
        md5(nullif({btrim('text')}, '')) AS note_md5
      FROM conversations LEFT JOIN ({STATUS_ROWS}) ON session_id = conv_id""",
}


# --- checks ----------------------------------------------------------------------


def flaws(source: str, key: str, tests: list[tuple[str, str, str]]) -> str:
    """One SELECT per (field expression, condition, message expression)."""
    return " UNION ALL ".join(
        f"SELECT {key}, {field} AS field, {message} AS message FROM {source} WHERE {test}"
        for field, test, message in tests
    )


def record_sql(name: str, columns: dict[str, str]) -> str:
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {name})"


def not_in(field: str, column: str, allowed: list[str]) -> tuple[str, str, str]:
    return q(field), f"coalesce({column}, '') NOT IN {words(allowed)}", q(f"{field} must be one of: {', '.join(allowed)}")


def no_text(field: str, column: str) -> tuple[str, str, str]:
    return q(field), f"coalesce({column}, '') = ''", q(f"{field} must not be empty")


_UUID = "NOT regexp_full_match(id, '[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}')"
_CHANGES = f"""(SELECT o_custkey AS session_id, o_orderkey AS change_seq, 'changes[' || o_orderkey || '].' AS place,
  {corpus.FLAWED_CHANGE_ID} AS change_id, {corpus.FLAWED_LABEL} AS label, {corpus.FLAWED_CONTENT} AS content FROM orders)"""
_REPEATED = f"""(SELECT *, row_number() OVER (PARTITION BY session_id, change_id ORDER BY change_seq) AS nth
  FROM {_CHANGES} WHERE trim(change_id) <> '')"""
_SESSIONS = f"(SELECT c_custkey AS session_id, {corpus.REQUIREMENT} AS requirement_text FROM customer)"


def _empty(field: str, column: str, name: str) -> tuple[str, str, str]:
    return f"place || '{field}'", f"coalesce(trim({column}), '') = ''", q(f"{name} must be a non-empty string")


ORACLES |= {
    "input_errors": " UNION ALL ".join(
        [
            flaws(_SESSIONS, "session_id", [
                ("'requirementText'", f"{btrim('requirement_text')} = ''", "'requirementText must be a non-empty string'"),
                ("'changes'", "session_id NOT IN (SELECT o_custkey FROM orders)", "'at least one change description is required'"),
            ]),
            flaws(_CHANGES, "session_id", [
                _empty("id", "change_id", "change id"),
                _empty("label", "label", "change label"),
                _empty("content", "content", "change content"),
            ]),
            flaws(_REPEATED, "session_id", [("place || 'id'", "nth > 1", "'duplicate change id \"' || change_id || '\"'")]),
        ]
    ),
    "claim_errors": upto(
        "claims",
        """SELECT session_id, claim_id, 'subject' AS field, 'subject must be a non-empty string' AS message FROM claims WHERE rule_idx = 9 OR subject = ''
           UNION ALL SELECT session_id, claim_id, 'confidence', 'confidence must be one of: HIGH, MEDIUM, LOW' FROM claims WHERE rule_idx = 3""",
    ),
    "evidence_errors": flaws(record_sql("lineitem", corpus.EVIDENCE_RECORD), "id", [
        not_in("source", "source", fixed.EVIDENCE_SOURCES),
        no_text("filePath", "file_path"),
        ("'lineStart'", "line_start < 1", "'lineStart must be positive'"),
        ("'lineEnd'", "line_end < 1", "'lineEnd must be positive'"),
        no_text("branchName", "branch_name"),
        ("'line'", "line_end < line_start OR (line_start IS NULL AND line_end IS NOT NULL)",
         "'lineEnd must be >= lineStart, and both must be null or both non-null'"),
    ]),
    "changed_file_errors": flaws(record_sql("lineitem", corpus.CHANGED_FILE_RECORD), "id", [
        no_text("path", "path"),
        not_in("kind", "kind", fixed.CHANGE_KINDS),
        ("'previousPath'", "previous_path = ''", "'previousPath must not be empty'"),
        ("'additions'", "additions < 0 OR additions IS NULL", "'additions must not be negative'"),
        ("'deletions'", "deletions < 0 OR deletions IS NULL", "'deletions must not be negative'"),
        no_text("branchName", "branch_name"),
        ("'previousPath'", "kind = 'RENAMED' AND previous_path IS NULL", "'previousPath is required when kind is RENAMED'"),
    ]),
    "finding_errors": flaws(record_sql("orders", corpus.FINDING_RECORD), "id", [
        ("'id'", _UUID, "'id must be a UUID v4 string'"),
        no_text("title", "title"),
        ("'title'", "length(title) > 160", "'title should be < 160 characters'"),
        no_text("description", "description"),
        not_in("severity", "severity", fixed.FINDING_SEVERITIES),
        not_in("category", "category", fixed.FINDING_CATEGORIES),
        ("'affectedAssumptionIds'", "affected = 0", "'at least one affected assumption is required'"),
        ("'resolvedAt'", "proposed_resolution IS NULL AND resolved_at IS NOT NULL",
         "'resolvedAt must be null when proposedResolution is null'"),
    ]),
    "result_errors": flaws(record_sql("orders", corpus.RESULT_RECORD), "id", [
        ("'id'", _UUID, "'id must be a UUID v4 string'"),
        ("'schemaVersion'", "NOT regexp_full_match(schema_version, '\\d+\\.\\d+\\.\\d+')", "'must be a valid SemVer string (e.g. \"1.0.0\")'"),
        ("'startedAt'", "NOT contains(started_at, 'T')", "'must be an ISO-8601 UTC datetime string (e.g. 2024-08-01T12:00:00.000Z)'"),
        ("'completedAt'", "status = 'IN_PROGRESS' AND completed_at IS NOT NULL", "'completedAt must be null when status is PENDING or IN_PROGRESS'"),
        ("'errorMessage'", "status = 'ERROR' AND error_message IS NULL", "'errorMessage must be set when status is ERROR'"),
    ]),
}


# --- whole flows -----------------------------------------------------------------

_FILE_HINT = hint("file_path", fixed.CHANGE_HINTS, "NULL")
_REQUIREMENT_UNITS = f"""SELECT c_custkey AS session_id, 0 AS part, 0 AS change_seq, 0 AS snippet_seq,
  'requirement' AS unit_id, {corpus.REQUIREMENT} AS text, 'BUSINESS_RULE' AS category_hint, NULL::VARCHAR AS source_file FROM customer"""
_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, branch_name, path ORDER BY diff_id DESC, file_idx DESC) AS nth,
    first_value(diff_id) OVER w AS first_diff, first_value(file_idx) OVER w AS first_file
  FROM files WINDOW w AS (PARTITION BY session_id, branch_name, path ORDER BY diff_id, file_idx)) WHERE nth = 1"""
_HEADS = """SELECT *, row_number() OVER (PARTITION BY session_id
    ORDER BY CASE branch_name WHEN 'feature/1' THEN 0 WHEN 'feature/0' THEN 1 ELSE 2 END, first_diff, first_file) - 1 AS change_seq
  FROM (SELECT DISTINCT ON (session_id, branch_name) session_id, branch_name, first_diff, first_file FROM latest
    ORDER BY session_id, branch_name, first_diff, first_file)"""
_FORWARDED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, branch_name ORDER BY first_diff, first_file) AS file_nth
  FROM latest WHERE trim(patch) <> '')"""
_DIFF_UNITS = f"""{_REQUIREMENT_UNITS}
  UNION ALL SELECT session_id, 1, change_seq, 0, 'change-' || change_seq || '-' || branch_name,
    CASE WHEN EXISTS (SELECT 1 FROM forwarded f WHERE f.session_id = h.session_id AND f.branch_name = h.branch_name)
      THEN '—' ELSE 'No textual differences on ' || branch_name || '.' END, NULL, NULL FROM heads h
  UNION ALL SELECT session_id, 1, change_seq, file_nth, 'change-' || change_seq || '-' || branch_name || '__snippet_' || (file_nth - 1),
    patch, {_FILE_HINT}, path FROM (
      SELECT f.*, h.change_seq, f.path AS file_path FROM forwarded f JOIN heads h USING (session_id, branch_name))"""
_TEXT_UNITS = f"""{_REQUIREMENT_UNITS} UNION ALL
  SELECT session_id, 1, change_seq, 1, change_id || '__snippet_0', text, {_FILE_HINT}, file_path FROM (
    SELECT session_id, change_seq * 2 + CAST(right(unit_id, 1) AS INTEGER) AS change_seq,
      replace(unit_id, '__snippet_', '-') AS change_id, text,
      CASE WHEN snippet_seq = 1 THEN source_file ELSE replace(unit_id, '__snippet_', '-') || '.diff' END AS file_path
    FROM corpus_units WHERE snippet_seq > 0)"""


_AGENT_UNITS = f"""{_REQUIREMENT_UNITS}
  UNION ALL SELECT DISTINCT session_id, 1, 0, 0, 'change-agent-findings', '—', {hint("'agent findings'", fixed.CHANGE_HINTS, "NULL")}, NULL FROM lines
  UNION ALL SELECT session_id, 1, 0, row_number() OVER (PARTITION BY session_id ORDER BY response_id, item_idx, line_idx),
    'change-agent-findings__snippet_' || response_id || '_' || item_idx || '_' || line_idx, line,
    {hint("'agent-findings.txt'", fixed.CHANGE_HINTS, "NULL")}, 'agent-findings.txt' FROM lines"""
_LATEST_FILES = f"""SELECT session_id, branch_name, path, first_order, first_line, first_part, {corpus.SPOKEN_PATCH} AS patch FROM ({DEDUPED})"""
_FILE_HEADS = """SELECT *, row_number() OVER (PARTITION BY session_id
    ORDER BY CASE branch_name WHEN 'feature/r' THEN 0 WHEN 'feature/a' THEN 1 ELSE 2 END, first_order, first_line, first_part) - 1 AS change_seq
  FROM (SELECT DISTINCT ON (session_id, branch_name) session_id, branch_name, first_order, first_line, first_part FROM latest
    ORDER BY session_id, branch_name, first_order, first_line, first_part)"""
_FILE_UNITS = f"""SELECT s_suppkey AS session_id, 0 AS part, 0 AS change_seq, 0 AS snippet_seq, 'requirement' AS unit_id,
    'Only owners can refund orders.' AS text, 'BUSINESS_RULE' AS category_hint, NULL::VARCHAR AS source_file FROM supplier
  UNION ALL SELECT session_id, 1, change_seq, 0, 'change-' || change_seq || '-' || branch_name, '—', {hint("branch_name", fixed.CHANGE_HINTS, "NULL")}, NULL FROM heads
  UNION ALL SELECT session_id, 1, change_seq, row_number() OVER (PARTITION BY session_id, branch_name ORDER BY f.first_order, f.first_line, f.first_part),
    'change-' || change_seq || '-' || branch_name || '__snippet_' || f.first_order || '_' || f.first_line || '_' || f.first_part,
    patch, {_FILE_HINT}, path FROM (SELECT *, path AS file_path FROM latest WHERE trim(patch) <> '') f
    JOIN (SELECT session_id, branch_name, change_seq FROM heads) h USING (session_id, branch_name)"""


def flow(units: str, body: str, **before: str) -> str:
    """The pipeline over other units, which the CTEs in ``before`` prepare."""
    ctes = {**before, **STAGES, "units": units}
    order = [*before, *STAGES]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in order) + "\n" + body


ORACLES |= {
    "repository_verdicts": flow(
        _DIFF_UNITS, RESULTS, diffs=DIFFS, chunks=CHUNKS, files=SHREDDED, latest=_LATEST, heads=_HEADS,
        forwarded=_FORWARDED,
    ),
    "analyser_verdicts": flow(
        _AGENT_UNITS, RESULTS, responses=RESPONSES, parsed=PARSED, items=ITEMS, reasons=REASONS, json_claims=JSON_CLAIMS,
        lines=unique_lines(f"({CLAIM_TEXT})", ["response_id", "item_idx"]),
    ),
    "changed_file_verdicts": flow(
        _FILE_UNITS, RESULTS.replace("c_custkey", "s_suppkey").replace("FROM customer", "FROM supplier"), latest=_LATEST_FILES,
        heads=_FILE_HEADS,
    ),
    "text_verdicts": flow(_TEXT_UNITS, RESULTS, corpus_units=_units()),
    "stream_conflicts": upto(
        "conflicts",
        "SELECT session_id, conflict_id, conflict_type, l_value, r_value, severity FROM conflicts",
    ),
}


# --- further operators -----------------------------------------------------------

_TRACE = """
  SELECT session_id, claim_id, 0 AS kind, 'subject' AS field, subject AS raw_value, canonical_subject AS canonical_value, subject_why AS explanation
  FROM norm WHERE subject_why IS NOT NULL
  UNION ALL SELECT session_id, claim_id, 1, CASE WHEN contains(lower(key_why), 'value') THEN 'value' ELSE 'predicate' END,
    predicate, canonical_predicate, key_why FROM norm WHERE key_why IS NOT NULL
  UNION ALL SELECT session_id, claim_id, 2, 'value', predicate, canonical_predicate, value_why FROM norm WHERE value_why IS NOT NULL"""
_CONFLICT_FLAWS = [
    ("'affectedEntity'", "severity = 'MEDIUM'", "'affectedEntity must be a non-empty string'"),
    ("'evidenceReferences'", "conflict_type = 'DEPENDENCY'", "'at least one evidence reference is required for a confirmed conflict'"),
    ("'confirmedAt'", "confidence = 'LOW'", "'confirmedAt must be a valid ISO-8601 date string'"),
    *(
        (f"'evidenceReferences[{i}].text'", "canonical_key = 'must_be'", "'text must be a non-empty string'")
        for i in (0, 1)
    ),
]

ORACLES |= {
    "branch_files": f"SELECT session_id, l_orderkey, l_linenumber, path FROM ({CHANGED_ROWS}) WHERE branch_name = 'feature/r'",
    "written_files": f"SELECT session_id, l_orderkey, l_linenumber, md5(patch) AS patch_md5 FROM ({CHANGED_ROWS}) WHERE branch_name = 'feature/a'",
    "dropped_subjects": upto("norm", "SELECT session_id, claim_id, subject FROM norm WHERE canonical_subject = ''"),
    "light_claims": upto(
        "claims",
        f"""SELECT session_id, claim_id, lower({btrim('subject')}) AS subject, {btrim('predicate')} AS predicate,
              {btrim('statement')} AS statement, {btrim('evidence_text')} AS evidence_text FROM claims""",
    ),
    "coverage_fractions": upto(
        "claims",
        """SELECT c_custkey AS session_id, CASE WHEN count(criterion_key) > 0
             THEN count(*) FILTER (covered) || '/' || count(criterion_key) END AS fraction,
             CASE WHEN count(criterion_key) > 0 THEN floor(100.0 * count(*) FILTER (covered) / count(criterion_key) + 0.5) >= 90 END AS enough
           FROM customer LEFT JOIN covered_rows ON session_id = c_custkey GROUP BY c_custkey""",
        covered_rows=COVERED,
    ),
    "criterion_errors": flaws(record_sql("part", corpus.CRITERION_RECORD), "id", [no_text("key", "key"), no_text("description", "description")]),
    "branch_errors": flaws(record_sql("customer", corpus.BRANCH_RECORD), "id", [
        ("'name'", "name = ''", "'branch name must not be empty'"),
        ("'sha'", "NOT regexp_full_match(coalesce(sha, ''), '[0-9a-f]{40}')", "'sha must be a 40-character lowercase hex string'"),
    ]),
    "domain_claim_errors": flaws(record_sql("orders", corpus.DOMAIN_CLAIM_RECORD), "id", [
        ("'id'", _UUID, "'id must be a UUID v4 string'"),
        no_text("branchName", "branch_name"), no_text("value", "value"),
        ("'concept'", "NOT regexp_full_match(concept, '[a-z0-9-]+')", "'concept must be lowercase kebab-case'"),
        not_in("sourceAgent", "source_agent", fixed.AGENT_TYPES), not_in("confidence", "confidence", fixed.CONFIDENCES),
        ("'numericConfidence'", "numeric_confidence > 1", "'numericConfidence must be between 0 and 1'"),
    ]),
    "passport_draft_errors": flaws(record_sql("orders", corpus.DRAFT_RECORD), "id", [
        no_text("title", "title"),
        ("'approvedBy'", "(approved_by IS NULL) <> (approved_at IS NULL)", "'approvedBy and approvedAt must both be set or both be null'"),
        ("'verificationResultId'", "verification_result_id <> embedded_result_id",
         "'verificationResultId must match the embedded verificationResult.id'"),
    ]),
    "candidate_errors": flaws(record_sql("orders", corpus.CANDIDATE_RECORD), "id", [
        ("'id'", "trim(candidate_id) = ''", "'id must be a non-empty string'"),
        not_in("conflictType", "conflict_type", fixed.CONFLICT_TYPES), not_in("estimatedSeverity", "estimated_severity", fixed.SEVERITIES),
        not_in("status", "status", fixed.CANDIDATE_STATUSES),
        ("'pairingRationale'", "pairing_rationale = ''", "'pairingRationale must be a non-empty string'"),
        ("'affectedEntity'", "lower(trim(left_subject)) <> lower(trim(right_subject))",
         "'leftAssumption.subject and rightAssumption.subject must share the same normalized entity'"),
    ]),
    "miscounted_results": f"""SELECT result_id, assumptions_found, n_claims, n_findings FROM {record_sql("orders", corpus.COUNTED_RECORD)}
      JOIN (SELECT o_orderkey AS result_id, count(l_orderkey) AS n_claims, count(*) FILTER (l_linenumber = 2) AS n_findings
            FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) USING (result_id)
      WHERE assumptions_found <> n_claims OR conflicts_found <> n_findings OR critical + high + medium + low <> conflicts_found""",
    "public_rows": f"SELECT c_custkey AS session_id, {corpus.REQUIREMENT} AS requirement_text FROM customer",
    "norm_traces": upto(
        "norm",
        f"""SELECT session_id, claim_id, row_number() OVER (PARTITION BY session_id, claim_id ORDER BY kind) - 1 AS step,
              field, raw_value, canonical_value, explanation FROM ({_TRACE})""",
    ),
    "change_contents": flow(
        _DIFF_UNITS,
        """SELECT session_id, change_seq, unit_id AS change_id, substr(unit_id, length('change-' || change_seq || '-') + 1) AS label,
             text AS content FROM units WHERE part = 1 AND snippet_seq = 0
           UNION ALL SELECT c_custkey, 0, 'change-empty', 'empty', 'No changes submitted for verification.' FROM customer
           WHERE c_custkey NOT IN (SELECT session_id FROM heads)""",
        diffs=DIFFS, chunks=CHUNKS, files=SHREDDED, latest=_LATEST, heads=_HEADS, forwarded=_FORWARDED,
    ),
    "conflict_resolutions": upto(
        "conflicts",
        f"""SELECT session_id, conflict_id, CASE WHEN severity = 'MEDIUM' THEN 'Agree on ' || canonical_subject
              ELSE {by_type(fixed.HINTS)} END AS resolution FROM conflicts""",
    ),
    "candidate_stats": f"""SELECT o_custkey AS session_id, count(*) AS candidates, count(*) FILTER (status = 'CONFIRMED') AS confirmed,
        count(*) FILTER (status = 'DISMISSED') AS dismissed
      FROM (SELECT o_custkey, {corpus.CANDIDATE_STATUS} AS status FROM orders) GROUP BY 1""",
    "dependency_errors": flaws(record_sql("lineitem", corpus.DEPENDENCY_RECORD), "line", [
        ("'id'", "id = ''", "'id must be a UUID v4 string'"),
        no_text("from.filePath", "from_file_path"),
        no_text("to.branchName", "to_branch_name"),
        not_in("kind", "kind", fixed.DEPENDENCY_KINDS),
        ("'isCrossModule'", "is_cross_module IS NULL", "'isCrossModule is required'"),
    ]),
    "summary_errors": flaws(record_sql("orders", corpus.SUMMARY_RECORD), "id", [
        ("'assumptionsFound'", "assumptions_found IS NULL", "'assumptionsFound must not be negative'"),
        ("'conflictsResolved'", "conflicts_resolved < 0", "'conflictsResolved must not be negative'"),
        ("'conflictsResolved'", "conflicts_resolved > conflicts_found", "'conflictsResolved cannot exceed conflictsFound'"),
        ("'requirementCoverage'", "requirement_coverage > 100", "'requirementCoverage must be between 0 and 100'"),
    ]),
    "conflict_errors": upto("conflicts", flaws("conflicts", "session_id, conflict_id", _CONFLICT_FLAWS)),
    "unknown_claim_ids": upto(
        "conflicts",
        """SELECT DISTINCT n.session_id AS result_id, n.claim_id FROM (
             SELECT session_id, l_statement AS statement FROM conflicts UNION SELECT session_id, r_statement FROM conflicts) s
           JOIN first_id n USING (session_id, statement) JOIN claims c ON c.session_id = n.session_id AND c.claim_id = n.claim_id
           WHERE c.rule_idx = 2""",
        first_id=FIRST_ID,
    ),
}

# Column types of the Spark results where DuckDB would choose wider or narrower ones.
_TYPES = {
    "INTEGER": {
        "segments": ["seg_idx"], "rule_matches": ["seg_idx"], "claims": ["seg_idx"],
        "claim_ids": ["claim_idx"], "document_segments": ["max_seg_idx"], "top_conflicts": ["severity_order"],
        "diff_files": ["file_idx", "additions", "deletions", "n_hunks"],
        "diff_hunks": ["file_idx", "hunk_idx"], "diff_lines": ["file_idx", "hunk_idx", "line_idx"],
        "code_evidence": ["file_idx", "evidence_idx"], "patch_evidence": ["file_idx", "evidence_idx"],
        "comparison_snippets": ["file_idx", "hunk_idx"], "files_forwarded": ["n_chars"],
        "json_claims": ["item_idx"], "agent_lines": ["item_idx", "line_idx"], "dedup_lines": ["line_idx"],
        "document_lines": ["max_line_idx"], "capped_texts": ["n_chars", "part"], "norm_traces": ["step"],
    },
    "BIGINT": {
        "document_segments": ["n_chars"], "finding_status": ["conflicts_resolved", "critical"],
        "severity_counts": ["critical"], "diff_limits": ["diff_bytes"],
        "verification_summaries": ["critical", "conflicts_resolved"],
        "head_comparisons": ["patch_bytes"], "document_lines": ["n_chars"],
    },
}
for _name in ORACLES:
    _casts = [
        f"CAST({c} AS {kind}) AS {c}" for kind, columns in _TYPES.items() for c in columns.get(_name, [])
    ]
    if _casts:
        ORACLES[_name] = f"SELECT * REPLACE ({', '.join(_casts)}) FROM ({ORACLES[_name]})"

_U = "NOT regexp_full_match(coalesce({c}, ''), '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')"


def _own_rule(rule: tuple) -> str:
    """Matches of a rule of the table: the first of a segment whose subject and predicate slots are filled."""
    rule_set, _, rule_id, category, confidence, pattern, ignore_case, _, *templates = rule
    flags = "(?i)" if ignore_case else ""

    def filled(template: str) -> str:
        forms = {"": "trim(g{n})", "lower": "lower(trim(g{n}))", "key": subject_key("g{n}")}
        parts = re.split(r"\{(\d)(?:\|(lower|key))?\}", template)
        out = [q(parts[0])]
        for n, form, text in zip(parts[1::3], parts[2::3], parts[3::3]):
            out += [forms[form or ""].replace("{n}", n), q(text)]
        return " || ".join(out)

    groups = ", ".join(f"regexp_extract(segment, {q(flags + pattern)}, {n}) AS g{n}" for n in (1, 2) if n <= re.compile(pattern).groups)
    subject, predicate, statement = map(filled, templates)
    return f"""SELECT rule_set, session_id, part, change_seq, snippet_seq, seg_idx, {q(rule_id)} AS rule_id, {q(category)} AS category,
        {subject} AS subject, {predicate} AS predicate, {statement} AS statement, {q(confidence)} AS confidence
      FROM (SELECT *, {groups} FROM segs JOIN chosen USING (session_id) WHERE rule_set = {q(rule_set)}
        AND (category_hint IS NULL OR category_hint = {q(category)} OR (category_hint = 'BUSINESS_RULE' AND {q(category)} = 'AUTHORIZATION')))
      WHERE g1 <> ''"""


_OWN_CTES = {
    "units": _units(), "segs": SEGS, "chosen": f"SELECT c_custkey AS session_id, {corpus.RULE_SET} AS rule_set FROM customer",
    "own": " UNION ALL ".join(_own_rule(r) for r in corpus.RULE_ROWS),
}
_OWN = "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in _OWN_CTES.items())
_CORRUPT = "o_orderkey % 13 IN (5, 6, 7)"
ORACLES |= {
    "evidence_counts": upto(
        "conflicts",
        """SELECT c.session_id, c.conflict_id, side, count(DISTINCT n.claim_id) AS n_refs, count(DISTINCT n.source_file) AS n_files
           FROM (SELECT session_id, conflict_id, canonical_subject, unnest([l_predicate, r_predicate]) AS side_predicate, unnest([0, 1]) AS side FROM conflicts) c
           JOIN norm n ON n.session_id = c.session_id AND n.canonical_subject = c.canonical_subject AND n.canonical_predicate = side_predicate
           GROUP BY ALL""",
    ),
    "status_log": f"""SELECT user_id AS session_id, arg_max({corpus.STATUS}, (ts, event_id)) AS status,
        arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM events GROUP BY 1""",
    "checked_files": f"SELECT session_id, branch_name, count(*) AS n_files, count(DISTINCT path) AS n_paths FROM ({CHANGED_ROWS}) GROUP BY ALL",
    "feature_request_errors": flaws(record_sql("orders", {"key": "o_orderkey", **corpus.FEATURE_REQUEST_RECORD}), "key", [
        ("'id'", _U.format(c="id"), "'id must be a UUID v4 string'"),
        no_text("title", "title"), no_text("description", "description"), no_text("submittedBy", "submitted_by"),
        ("'createdAt'", "NOT ends_with(created_at, 'Z')", "'must be an ISO-8601 UTC datetime string (e.g. 2024-08-01T12:00:00.000Z)'"),
    ]),
    "repository_errors": flaws(record_sql("customer", corpus.REPOSITORY_RECORD), "key", [
        ("'id'", _U.format(c="id"), "'id must be a UUID v4 string'"),
        no_text("name", "name"), no_text("cloneUrl", "clone_url"), no_text("provider", "provider"),
        ("'featureBranches'", "feature_branches IS NULL", "'at least one feature branch is required'"),
        ("'resolvedAt'", "NOT ends_with(resolved_at, 'Z')", "'must be an ISO-8601 UTC datetime string (e.g. 2024-08-01T12:00:00.000Z)'"),
    ]),
    "direct_verdicts": upto(
        "conflicts",
        """SELECT c_custkey AS session_id, coalesce(n_claims, 0) AS claims_found, coalesce(n, 0) AS conflicts_found,
             CASE WHEN n > 0 THEN 'CONFLICTS_FOUND' ELSE 'PASS' END AS status FROM customer
           LEFT JOIN (SELECT session_id, count(*) AS n_claims FROM claims GROUP BY 1) a ON a.session_id = c_custkey
           LEFT JOIN (SELECT session_id, count(*) AS n FROM conflicts WHERE direct GROUP BY 1) b ON b.session_id = c_custkey""",
    ),
    "rule_set_matches": _OWN + " SELECT * FROM own",
    "committed_results": f"""
      WITH lines AS (SELECT *, {corpus.RESULT_JSON} AS text FROM orders)
      SELECT 'good' AS kind, o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 8 THEN o_orderstatus END AS status,
        CASE WHEN o_orderkey % 13 <> 8 THEN 'r\u00e9po' END AS name,
        CASE WHEN o_orderkey % 13 <> 8 THEN 'feature/' || (o_orderkey % 3) || '|main' END AS branches,
        CASE WHEN o_orderkey % 13 <> 8 THEN o_orderkey % 4 END AS high,
        CASE WHEN o_orderkey % 13 <> 8 THEN 'a|b' || o_custkey ELSE '' END AS claims, md5('') AS text_md5 FROM lines WHERE NOT {_CORRUPT}
      UNION ALL SELECT 'corrupt', NULL, NULL, NULL, NULL, NULL, NULL, md5(text) FROM lines WHERE {_CORRUPT}""",
}
