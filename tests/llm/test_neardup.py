import random

import numpy as np

from claimgrid.llm import neardup
from claimgrid.llm.components import components
from tests.llm.helpers import awkward, shingles, similarity, table, words


def classes(pairs):
    """Least id of the component of every document, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in pairs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if find(a) != find(b) and similarity(sets[a], sets[b]) >= neardup.THRESHOLD - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def edited(base, seed, times):
    rng, out = random.Random(seed), list(base)
    for _ in range(times):
        kind, at = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"new{rng.randrange(10**6)}")
    return out


def test_classes_equal_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for g in range(12):
        base = words(g, rng.randrange(4, 260))
        texts += [" ".join(edited(base, (g, k).__hash__(), rng.randrange(0, 9)) if len(base) > 20 else base) for k in range(14)]
    texts += [" ".join(words(1000 + k, 150)) for k in range(60)]
    passage = words(5000, 120)  # a passage that many otherwise different texts share
    texts += [" ".join(words(6000 + k, 80) + passage) for k in range(60)]
    texts += ["a b c d e f " * n for n in (3, 4, 5, 30, 36, 37)]  # equal shingles, other counts
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    got = neardup.classes(awkward(table(spark, pairs))).collect()
    want = classes(pairs)
    assert {r.doc_id: r.class_id for r in got} == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted(set(want.values()))


def test_a_chain_of_copies_is_one_class(spark):
    base = words(1, 200)
    chain = [" ".join(base)]
    for k in range(12):
        base = edited(base, k, 2)
        chain.append(" ".join(base))
    assert similarity(shingles(chain[0]), shingles(chain[-1])) < 0.5
    got = neardup.classes(table(spark, chain, start=7)).collect()
    assert {r.class_id for r in got} == {7} and sum(r.kept for r in got) == 1


def test_awkward_rows(spark):
    text = " ".join(words(2, 300))
    long = " ".join(words(3, 20_000))
    rows = [(1, None), (1, None), (2, None), (3, ""), (4, " \n"), (None, text), (5, text), (5, text), (6, text + " end"), (7, long),
            (8, long), (9, "one two"), (10, "one two"), (11, "two one")]
    got = neardup.classes(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == sorted(
        [("1", "1", 2), ("1", "1", 2), ("2", "2", 1), ("3", "3", 1), ("4", "4", 1), ("None", "5", 4), ("5", "5", 4), ("5", "5", 4),
         ("6", "5", 4), ("7", "7", 2), ("8", "7", 2), ("9", "9", 2), ("10", "9", 2), ("11", "11", 1)])
    assert sorted(r.doc_id for r in got if r.kept) == [1, 2, 3, 4, 5, 7, 9, 11]
    kept = neardup.keep_one(awkward(table(spark, rows)))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 9, 11] and "elements" in kept.columns
    assert neardup.classes(table(spark, [])).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    size = 512
    for _ in range(6):
        keys = rng.integers(0, 2**63, 40, dtype=np.uint64)
        a, b = rng.integers(0, 20, 40), rng.integers(0, 20, 40)
        owner = np.concatenate((np.zeros(40, dtype=np.int64), np.ones(40, dtype=np.int64)))
        count = np.concatenate((a, b))
        use = count > 0
        parts = neardup.pieces(owner[use], np.concatenate((keys, keys))[use], count[use])
        sig = neardup.signatures(2, *parts, size=size)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 5 * np.sqrt(true * (1 - true) / size) + 1e-9


def test_components_equal_plain_ones(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + k, 501 + k) for k in range(40)] + [(None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
