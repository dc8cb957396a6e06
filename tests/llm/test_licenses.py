import random

from claimgrid.llm import licenses
from claimgrid.llm.terms import terms
from tests.llm.helpers import awkward, table, words

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def brute(rows, known):
    """All places of all templates, by words."""
    out = []
    for d, text in rows:
        own = terms((text or "").encode())
        starts, base, labels, score = [], set(), set(), 0.0
        for label, wording, phrase in known:
            t = terms(wording.encode())
            if phrase:
                at = [i for i in range(len(own)) if own[i : i + len(t)] == t]
                starts += at
                if at:
                    base.add(label)
                    score = 1.0
                continue
            hits = [(i - j, j) for i in range(len(own) - 4) for j in range(len(t) - 4) if own[i : i + 5] == t[j : j + 5]]
            groups, last = [], None
            for diagonal, j in sorted(hits):
                if last is None or diagonal - last > licenses.DRIFT:
                    groups.append(set())
                groups[-1] |= set(range(j, j + 5))
                last = diagonal
            share = max((len(g) / len(t) for g in groups), default=0)
            if share >= licenses.SHARE:
                labels.add(label)
                score = max(score, share)
        ends = (min(starts), max(starts)) if starts else (None, None)
        out.append((d, len(own), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
    return sorted(out, key=str)


def check(spark, rows, known=None):
    frame = licenses.scanned(awkward(table(spark, rows)).repartition(3), known=known)
    assert frame.columns == COLUMNS
    got = sorted((tuple(r) for r in frame.collect()), key=str)
    assert got == brute(rows, known or licenses.templates())
    return got


def damaged(rng, wording):
    """A notice with words put in, left out or replaced."""
    w = wording.split()
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(w))
        w[at : at + rng.randrange(2)] = words(rng.random(), rng.randrange(3))
    return " ".join(w)


def test_labels_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for d in range(220):
        parts = words(d, rng.randrange(0, 80), 60)
        for _ in range(rng.randrange(3)):
            extra = damaged(rng, rng.choice(licenses.NOTICES)[1]) if rng.random() < 0.6 else rng.choice(list(licenses.PHRASES)).upper()
            parts.insert(rng.randrange(len(parts) + 1), extra)
        rows.append((d, " ".join(parts)))
    got = check(spark, rows)
    assert sum(bool(r[6]) for r in got) > 80 and sum(0 < r[7] < 1 for r in got) > 10


def test_awkward_rows(spark):
    long = "x " * 40_000 + "Apache License " + "cc by " * 30_000
    rows = [(1, None), (2, ""), (3, "mit"), (4, long), (5, "MIT-License"), (5, "MIT-License"), (None, "MIT license, mit LICENSE"),
            (7, "general public license gnu"), (8, "gnu gnu general public license license"), (9, "éapache license"), (10, "cc cc by by"),
            (5, "other text"), (None, None)]
    check(spark, rows)
    assert licenses.scanned(table(spark, [])).count() == 0


def test_repeats_and_drift(spark):
    known = [("rep", "a b a b a b a b a b", False), ("ab", "a b", True), ("long", " ".join(f"w{k}" for k in range(40)), False)]
    w = [f"w{k}" for k in range(40)]
    rows = [(1, "a b " * 9), (2, "b a b a b a b a"), (3, " ".join(w[:12] + ["x"] * 3 + w[12:30])), (4, " ".join(w[:12] + ["x"] * 5 + w[12:24])),
            (5, " ".join(w[20:] + w[:20])), (6, " ".join(w[:23])), (7, " ".join(w[:24])), (8, " ".join(["y"] + w + w))]
    check(spark, rows, known)


def test_templates_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_GRAMS", 1)
    check(spark, [(1, "Released under the MIT License."), (2, "apache license"), (3, None)])


def test_many_rows_in_slices(spark):
    rows = [(d, " ".join(words(d, 150, 500)) + (" MIT license" if d % 40 == 0 else "")) for d in range(3_000)]
    got = licenses.scanned(table(spark, rows).coalesce(1)).where("n_base > 0").collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 3_000, 40)) and all(r.n_words == 152 and r.first_word == 150 for r in got)
