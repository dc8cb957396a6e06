import hashlib
import os
import re

import numpy as np
import pytest

import corpus_pipeline
from claimgrid.llm import decontam, secrets
from claimgrid.llm.queries import QUERIES
from claimgrid.llm.vocabulary import library, place
from tests.llm.helpers import DOCS, shingles, similarity
from tests.llm.test_decontam import brute
from tests.llm.test_neardup import classes

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scan", "bpe_encoding"]


def test_pipeline_equals_brute_force(spark):
    """Quality verdicts are taken from query 4; everything after it is done plainly."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    good = {r.doc_id for r in QUERIES["op4_quality_rules"](spark, SF_DIR).where("kept").collect()}
    texts = [(i, docs[i].text) for i in sorted(good)]
    firsts = set(classes(texts).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    near = {i: s for i, s in ((i, shingles(t)) for i, t in items)}
    hits = [(i, t) for i, t in texts if i in firsts and any(not s.keys().isdisjoint(shingles(t)) for s in near.values())]
    dirty = {i for i, found in brute(hits, items).items() if found}
    kept = [(i, t) for i, t in texts if i in firsts and i not in dirty]
    assert dirty and len(firsts) < len(texts)

    owners = {}
    spans = {}
    patterns = [(re.compile(secrets.PATTERNS[k].replace("(?i:", "(?:"), re.I if k == "assign" else 0), secrets.VALUE_GROUP[k], secrets.MIN_LENGTH[k])
                for k in secrets.KINDS]
    for i, t in kept:
        spans[i] = [(m.start(), m.end(), m.group(g)) for p, g, least in patterns for m in p.finditer(t) if len(m.group(g)) >= least]
        for *_, value in spans[i]:
            owners.setdefault(value, set()).add(docs[i].source)
    tool = library(place("byte_bpe_50k.json"))
    want = {}
    for i, t in kept:
        live, out, at = sorted((a, b) for a, b, v in spans[i] if len(owners[v]) <= secrets.MAX_OWNERS), [], 0
        merged = []
        for a, b in live:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            out += [t[at:a], secrets.MASK]
            at = b
        ids = tool.encode("".join(out) + t[at:], add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "one two three four five six seven eight nine ten eleven", "en", "s", 55)], DOCS)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns
    assert [r.doc_id for r in docs.collect()] == [2]
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0
    assert decontam.THRESHOLD == 0.8 and similarity(shingles("a"), shingles("a")) == 1


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
