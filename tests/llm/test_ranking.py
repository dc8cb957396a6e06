import math
import random
import re
from collections import Counter

from claimgrid.llm import ranking
from tests.llm.helpers import awkward, table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, top=ranking.TOP):
    docs = [(d, Counter(cut(t))) for d, t in rows if cut(t)]
    n_docs, length = len(docs), sum(c.total() for _, c in docs)
    out = []
    for i, text in items:
        own, scored = set(cut(text)), []
        df = {t: sum(t in c for _, c in docs) for t in own}
        for d, c in docs:
            m = 50 + 50 * c.total() * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own & set(c)
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


def corpus(seed, n, vocabulary=300):
    rng = random.Random(seed)
    common = [f"T{k}é" for k in range(vocabulary)]
    rows = []
    for d in range(n):
        size = rng.choice((0, 1, 5, 40, 200))
        rows.append((d * 7 % n, " ".join(common[int(vocabulary * rng.random() ** 3)].swapcase() for _ in range(size))))
    return rows, rng, common


def test_ranks_equal_brute_force(spark):
    rows, rng, common = corpus(1, 900)
    items = [(i, "-".join(rng.sample(common, size))) for i, size in enumerate((1, 2, 5, 9, 20, 64, 90, 150))]
    frame = ranking.ranked(awkward(table(spark, rows)).repartition(7), spark.createDataFrame(items, ITEMS))
    assert got(frame) == brute(rows, items)


def test_blocks_of_items_and_of_documents(spark, monkeypatch):
    rows, rng, common = corpus(2, 400)
    items = [(i % 5, " ".join(rng.sample(common, 6))) for i in range(12)]
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 60)
    blocks = list(ranking.search_blocks(spark.createDataFrame(items, ITEMS), "item_id", "text", 60))
    assert len(blocks) > 3 and sum(len(b.ids) for b in blocks) == 12
    docs = table(spark, rows).coalesce(1)
    # Small blocks of documents give what one large block gives.
    whole = blocks[0]
    found = ranking.postings(docs, "doc_id", "text", whole.codes).toArrow()
    weights = ranking.np.arange(len(whole.codes)) + 1
    one, many = [ranking.Best(9) for _ in whole.terms], [ranking.Best(9) for _ in whole.terms]
    for block in [found]:
        for own, best in zip(whole.terms, one):
            ranking.Block(block, weights, 300, 9000).search(own, best)
    monkeypatch.setattr(ranking, "DOCS", 50)
    monkeypatch.setattr(ranking, "POSTINGS", 100)
    cuts = list(ranking._blocks(iter(found.combine_chunks().to_batches())))
    assert sum(c.num_rows for c in cuts) == found.num_rows and len(cuts) > 5
    for block in cuts:
        for own, best in zip(whole.terms, many):
            ranking.Block(block, weights, 300, 9000).search(own, best)
    assert [(b.score.tolist(), b.id.tolist()) for b in one] == [(b.score.tolist(), b.id.tolist()) for b in many]


def test_awkward_rows(spark):
    long = "filler " * 60_000 + "needle"
    rows = [(1, None), (2, ""), (3, "..--"), (4, long), (5, "Needle in hay"), (5, "Needle in hay"), (None, "needle in hay"),
            (7, "ÄRGER needle"), (-3, "needle in hay")]
    items = [(1, "needle"), (2, None), (3, " ,"), (None, "hay hay"), (4, "ärger"), (4, "ÄRGER"), (5, "unknown"), (1, "needle")]
    assert got(ranking.ranked(table(spark, rows), spark.createDataFrame(items, ITEMS))) == brute(rows, items)
    none = spark.createDataFrame([], ITEMS)
    assert ranking.ranked(table(spark, rows), none).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranking.ranked(table(spark, rows), none).count() == 0
    assert ranking.ranked(table(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0
    assert ranking.ranked(table(spark, [(1, None)]), spark.createDataFrame(items, ITEMS)).count() == 0


def test_ties_go_by_ascending_id(spark):
    rows = [(i, "same words here") for i in range(200, 0, -1)] + [(i, "other") for i in range(300, 700)]
    frame = ranking.ranked(table(spark, rows).repartition(5), spark.createDataFrame([(1, "same here")], ITEMS))
    assert [r.doc_id for r in frame.orderBy("rank").collect()] == list(range(1, 51))
