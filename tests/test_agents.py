import json

import pytest

from claimgrid.operators import agents
from tests.helpers import rows

GOOD = {"statement": " Only owners ", "value": "owner", "branch": "a"}
RESPONSE = "session_id string, response_id int, agent string, branch_a string, branch_b string, raw_text string"


def wrap(*items):
    return json.dumps({"assumptions": list(items)})


CASES = {
    0: (wrap({**GOOD, "line": 3.0, "confidence": 7, "file": "x.ts", "evidence": "1\n2\n3\n4\n5\n6"}), None),
    1: ("```json\n" + wrap(GOOD) + "\n```", None),
    2: ("not json", "invalid JSON"),
    3: ("[1]", 'response must be a JSON object with an "assumptions" array'),
    4: ('{"a": 1}', 'response is missing the "assumptions" array'),
    5: ('{"assumptions": {}}', 'response is missing the "assumptions" array'),
    6: (wrap(GOOD, {**GOOD, "value": 5}), 'assumption #1: "value" must be a non-empty string'),
    7: (wrap({**GOOD, "branch": "zz"}), 'assumption #0: "branch" must be exactly "a" or "b"'),
    8: (wrap(None), 'assumption #0: "statement" must be a non-empty string'),
    9: (wrap({**GOOD, "statement": "???"}), 'assumption #0: "concept" is missing and cannot be derived'),
    10: (wrap(GOOD) + " trailing", "invalid JSON"),
    11: (wrap(*[{**GOOD, "value": f"v{i}"} for i in range(60)]), None),
    12: (wrap(*[GOOD] * 50, {}), 'assumption #50: "statement" must be a non-empty string'),
    13: (wrap({**GOOD, "line": 2.5, "confidence": "x", "concept": "own", "id": " i1 "}), None),
    14: ('{"assumptions": [], "assumptions": [' + json.dumps(GOOD) + "]}", None),
    15: (wrap({**GOOD, "confidence": -1, "line": 0, "evidence": "e"}), None),
    16: ("", "invalid JSON"),
    17: (wrap(GOOD) + "], [", "invalid JSON"),
}


@pytest.fixture(scope="module")
def read(spark):
    data = [("s", i, "intent", "a", "b", text) for i, (text, _) in CASES.items()]
    return agents.read_responses(spark.createDataFrame(data, RESPONSE)).cache()


@pytest.fixture(scope="module")
def claims(read):
    found = {}
    for r in agents.with_ids(agents.claims(read)).orderBy("response_id", "item_idx").collect():
        found.setdefault(r.response_id, []).append(r)
    return found


def test_reasons(read):
    assert {r.response_id: r.reason for r in read.collect()} == {i: reason for i, (_, reason) in CASES.items()}


def test_refused_responses_give_a_warning_and_no_claims(read, claims):
    refused = {i for i, (_, reason) in CASES.items() if reason}
    assert not refused & set(claims)
    warned = {r.response_id: r.message for r in agents.warnings(read).collect()}
    assert set(warned) == refused and warned[2] == "intent: invalid JSON"


def test_claim_fields(claims):
    first = claims[0][0]
    assert (first.statement, first.concept, first.line, first.numeric_confidence) == ("Only owners", "only-owners", 3, 1.0)
    assert (first.confidence, first.evidence_source, first.snippet) == ("HIGH", "FILE_CHANGE", "1\n2\n3\n4\n5\n6")
    plain = claims[1][0]
    assert (plain.source_file, plain.numeric_confidence, plain.confidence, plain.evidence_source) == ("—", 0.6, "MEDIUM", "INFERRED")
    assert claims[13][0].line is None and claims[13][0].concept == "own" and claims[13][0].id == "i1"
    assert claims[15][0].numeric_confidence == 0.0 and claims[15][0].evidence_source == "INFERRED"


def test_all_items_count(claims):
    assert [r.value for r in claims[11]] == [f"v{i}" for i in range(60)]
    assert 12 not in claims or not claims[12]
    assert len({r.id for r in claims[11]}) == 60


def test_lines_are_unique_in_order(spark):
    table = spark.createDataFrame(
        [("s", 0, "b\n a \n\nc"), ("s", 1, "a\nd\nb"), ("t", 0, "a")], "session_id string, response_id int, text string"
    )
    lines = agents.unique_lines(table, ["response_id"])
    got = [r.line for r in lines.filter("session_id = 's'").orderBy("response_id", "line_idx").collect()]
    assert got == ["b", "a", "c", "d"] and lines.filter("session_id = 't'").count() == 1


def test_claim_text_and_change_rows(spark, read):
    texts = agents.claim_text(agents.claims(read.filter("response_id in (0, 1)")))
    got = [t for (t,) in rows(texts, "text")]
    assert "[intent] Only owners — value: owner @ x.ts (a) :: 1\n2\n3\n4\n5\n6" in got
    assert "[intent] Only owners — value: owner @ — (a)" in got
    lines = agents.unique_lines(texts, ["response_id", "item_idx"])
    change, snippet = agents.as_change(lines, ["response_id", "item_idx"], 2)
    assert change.first().content == "—" and snippet.first().file_path == "agent-findings.txt"
    assert snippet.count() == lines.count() and change.count() == 1


def test_long_texts_come_in_parts(spark):
    table = spark.createDataFrame([(0, "x" * 12_000), (1, "y" * 12_001), (2, ""), (3, None)], "id int, text string")
    got = [(r.id, r.part, r.content) for r in agents.text_parts(table, "id").orderBy("id", "part").collect()]
    assert got == [(0, 0, "x" * 12_000), (1, 0, "y" * 12_000), (1, 1, "y"), (2, 0, ""), (3, 0, None)]
