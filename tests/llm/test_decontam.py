import random

import numpy as np

from claimgrid.llm import decontam
from tests.llm.helpers import awkward, shingles, similarity, table, words

ITEMS = "item_id long, text string"


def brute(texts, items):
    found = {}
    for d, t in texts:
        w, out = (t or "").split(), set()
        for i, item in items:
            n = len((item or "").split())
            if i is not None and n and any(
                similarity(shingles(" ".join(w[k : k + n])), shingles(item)) >= decontam.THRESHOLD
                for k in range(max(1, len(w) - n + 1))
            ):
                out.add(i)
        found[d] = sorted(out)
    return found


def test_passages_equal_brute_force(spark):
    rng = random.Random(2)
    items = [(k, " ".join(words(100 + k, rng.randrange(16, 60)))) for k in range(30)]
    items += [(50, "just four little words"), (51, "w1 w2"), (52, items[3][1]), (53, ""), (54, None)]
    texts = []
    for d in range(160):
        w = words(d, rng.randrange(0, 200), 50_000)
        if d % 3 == 0:
            item = rng.choice(items[:31])[1].split()
            if d % 6 == 0 and len(item) > 30:
                del item[0 if d % 12 else -1]  # an edge word is missing
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
        texts.append((d, " ".join(w)))
    got = decontam.contamination(awkward(table(spark, texts)), spark.createDataFrame(items, ITEMS)).collect()
    want = brute(texts, items)
    assert {r.doc_id: r.item_ids for r in got} == want
    assert sum(map(bool, want.values())) > 40 and all(r.contaminated == bool(r.item_ids) for r in got)


def test_awkward_rows(spark):
    passage = " ".join(words(7, 40))
    items = spark.createDataFrame([(1, passage), (1, passage), (2, passage), (None, "x y z"), (3, None), (4, " ")], ITEMS)
    long = " ".join(words(8, 15_000, 10**6) + passage.split() + words(9, 15_000, 10**6))
    rows = [(1, None), (2, ""), (3, long), (None, passage), (5, "x y z"), (6, "nothing here"), (6, passage), (7, "y z x")]
    got = decontam.contamination(table(spark, rows), items).collect()
    assert sorted((str(r.doc_id), r.contaminated, r.item_ids) for r in got) == sorted(
        [("1", False, []), ("2", False, []), ("3", True, [1, 2]), ("None", True, [1, 2]), ("5", True, []), ("6", False, []),
         ("6", True, [1, 2]), ("7", False, [])])
    kept = decontam.uncontaminated(awkward(table(spark, rows)), items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 7] and "item_ids" in kept.columns
    assert decontam.contamination(table(spark, rows), items.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(table(spark, []), items).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    items = [(k, " ".join(words(100 + k, 20))) for k in range(12)]
    frame = spark.createDataFrame(items, ITEMS)
    assert len(list(decontam.item_blocks(frame, "item_id", "text", 300))) > 4
    real = decontam.item_blocks
    monkeypatch.setattr(decontam, "item_blocks", lambda df, i, t: real(df, i, t, 300))
    got = decontam.contamination(table(spark, [(k, t) for k, t in items]), frame).collect()
    assert {r.doc_id: r.item_ids for r in got} == {k: [k] for k, _ in items}


def test_index_finds_everything_within_the_radius():
    rng = np.random.default_rng(1)
    own = words(3, 40)
    index = decontam.Index([(0, " ".join(own).encode())])
    (length, (known, *_)), = index.classes.items()
    flips = [known[0] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, r, replace=False))) for r in (0, 1, 2, 3) for _ in range(200)]
    window, entry = index.near(np.array(flips, dtype="<u8"), length)
    assert {int(w) for w, e in zip(window, entry) if e == 0} == set(range(800))
    assert length <= 40 and decontam.class_length(5) == 5 and length <= 20 and decontam.class_length(1) == 1


def test_passages_in_another_order_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(k, " ".join(words(300 + k, n, 10**6))) for k, n in enumerate((40, 48, 60, 62, 78, 78, 80, 112, 120, 150))]
    texts = []
    for d in range(120):
        own = items[d % len(items)][1].split()
        parts = 1 + rng.randrange(1, 5)
        cuts = [len(own) * k // parts for k in range(parts + 1)]
        moved = [own[a:b] for a, b in zip(cuts, cuts[1:])]
        rng.shuffle(moved)
        if d < 2 * len(items):  # halves swapped
            moved = [own[len(own) // 2 :], own[: len(own) // 2]]
        w = words(1000 + d, rng.randrange(0, 150), 10**6)
        at = rng.randrange(len(w) + 1)
        w[at:at] = [x for part in moved for x in part]
        texts.append((d, " ".join(w)))
    want = brute(texts, items)
    got = decontam.contamination(table(spark, texts), spark.createDataFrame(items, ITEMS)).collect()
    assert {r.doc_id: r.item_ids for r in got} == want
    assert all(want[d] for d in range(2 * len(items)) if len(items[d % len(items)][1].split()) >= 48)


def test_longest_part_of_a_copy():
    assert decontam.unbroken(48, 0.8) == 24 and decontam.unbroken(78, 0.8) == 26 and decontam.unbroken(3, 0.8) == 3
    item = words(5, 78, 10**6)
    swapped = item[52:] + item[26:52] + item[:26]
    index = decontam.Index([(0, " ".join(item).encode())])
    raw = " ".join(words(6, 30) + swapped + words(7, 30)).encode()
    assert index.search(decontam.Texts(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])), 0.8) == [{0}]


def test_case_and_edge_punctuation_do_not_matter(spark):
    plain = "die straße führt über den fluß und don't stop at the 3.5 km sign — it's near здесь же"
    items = spark.createDataFrame([(1, plain), (2, "... — !")], ITEMS)
    marked = " ".join(f"“({w})”," if w != "—" else w for w in plain.split())
    texts = [(1, plain), (2, plain.upper()), (3, f"x {plain.title().replace(chr(39) + 'T', chr(39) + 't')} y"), (4, marked), (5, f"¿{plain}?"),
             (6, plain.replace("3.5", "35").replace("don't", "dont").replace("fluß", "see")), (7, "— ... !"), (8, "... — !"), (9, "")]
    got = decontam.contamination(table(spark, texts), items).collect()
    assert {r.doc_id: r.item_ids for r in got} == {1: [1], 2: [1], 3: [1], 4: [1], 5: [1], 6: [], 7: [], 8: [2], 9: []}


def test_folded_words():
    raw = ["«Ab», c-d ...", "!", "", "x", "…Straße… Ω。"]
    data = [t.encode() for t in raw]
    texts = decontam.folded(decontam.Texts(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)])))
    starts, ends, at = texts.words()
    found = [texts.data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == ["ab", "c-d", "...", "!", "x", "strasse", "ω"] and at.tolist() == [0, 3, 4, 4, 5, 7]
