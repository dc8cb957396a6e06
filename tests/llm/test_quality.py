import random
import re
from collections import Counter
from math import comb

import numpy as np
import pytest

from claimgrid.llm import quality
from claimgrid.llm.texts import Texts
from tests.llm.helpers import DOCS, awkward, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_counts_equal_the_plain_ones():
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "中", "#", "|", "\n", "\n", " ", " ", "\t", "\x0b", "\x85", "\xa0", "word", "<x>", "\r\n", "a b c d e "]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 60))) for _ in range(400)] + ["", " \n ", "x" * 300, "a b c d e " * 50]
    raw = [t.encode() for t in texts]
    found = quality.measure(Texts(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])))
    for i, t in enumerate(texts):
        assert {k: int(found[k][i]) for k in plain(t)} == plain(t), repr(t)


def test_p_value_is_the_exact_binomial():
    for n, k, risk in ((10, 0, 0.05), (50, 3, 0.1), (200, 9, 0.05)):
        want = sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        assert quality.p_value(k, n, risk) == pytest.approx(want, rel=1e-9)
    assert quality.p_value(0, 0, 0.05) == 1.0


def test_certification_stops_at_the_first_step_that_rejects_too_much():
    zero = np.zeros(quality.STEPS + 1, dtype=np.int64)
    good, bad, held = zero.copy(), zero.copy(), zero.copy()
    bad[5], held[-1], good[-1] = 40, 500, 500
    assert quality.certified(good, bad, held, 0.05, 0.01) == 5
    held[4] = 100  # step 4 rejects a sixth of the good holdout
    assert quality.certified(good, bad, held, 0.05, 0.01) == 0
    held[:] = 0
    held[-1] = 20  # too few documents to certify anything
    assert quality.certified(good, bad, held, 0.05, 0.01) == -1


def test_false_rejections_stay_within_the_risk():
    """Over repeated draws, the certified step exceeds the risk no more often than the error allows."""
    rng, broken = np.random.default_rng(5), 0
    rates = np.linspace(0.0, 0.12, quality.STEPS)  # true false rejection by step
    for _ in range(300):
        first = np.searchsorted(rates, rng.random(400))
        held = np.bincount(first, minlength=quality.STEPS + 1)
        bad = np.zeros_like(held)
        bad[quality.STEPS - 1] = 10_000  # all gain lies at the strict end
        step = quality.certified(np.zeros_like(held), bad, held, 0.05, 0.05)
        broken += step >= 0 and rates[step] > 0.05
    assert broken / 300 <= 0.08


def test_junk_is_rejected_and_clean_documents_stay(spark):
    rng = random.Random(1)

    def clean():
        return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(500)) for _ in range(60)) + "."

    texts = [(i, clean() if i % 8 else " ".join(w + "$$$" for w in clean().split())) for i in range(2400)]
    docs = awkward(table(spark, texts))
    labels = spark.createDataFrame([(i, int(i % 8 != 0)) for i in range(0, 2400, 2)] + [(None, 1), (2, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.assess(docs, labels).collect()}
    assert all(got[i] == bool(i % 8) for i, _ in texts)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2100


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None), (None, "one two"), (2, ""), (3, long), (3, long), (4, "a b c d e " * 40), (5, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, None if i == 4 else "en", None, None) for i, t in rows], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.assess(docs, labels).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, True, False), (None, 2, True, False), (2, 0, True, False), (3, 20_000, False, True), (3, 20_000, False, True),
         (4, 200, True, False), (5, 1, True, False)], key=str)
    assert quality.assess(docs.limit(0), labels).count() == 0
