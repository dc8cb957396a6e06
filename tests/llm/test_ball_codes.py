import hashlib
import math
import random

import numpy as np
import pytest

from claimgrid.llm import ball_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Plain k-means over the parts, all entries compared."""
    kept = [(i, [math.floor(256 * x) for x in v] if max(map(abs, v), default=0) <= 2**18 else [], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = next(len(v) for _, v, _ in kept[:64] if v and len(v) % 16 == 0)
    cut = [r for r in kept if len(r[1]) == width]
    size = width // 16
    parts = lambda v: [v[k * size : k * size + size] for k in range(16)]
    books = [[parts(v)[p] for _, v, _ in kept[:64] if len(v) == width] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        for p in range(16):
            members = {}
            for _, v, _ in cut:
                members.setdefault(nearest(p, parts(v)[p])[1], []).append(parts(v)[p])
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, labels = [], {}
    for i, v, g in kept:
        if len(v) != width:
            out.append((i, None, None, g))
            continue
        found = [nearest(p, parts(v)[p]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), g))
        labels[g] = labels.get(g, 0) + out[-1][2]
    return sorted(((i, c, e, labels.get(g, 0), digest) for i, c, e, g in out), key=str)


def check(spark, rows):
    frame = ball_codes.coded(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert frame.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in frame.collect()), key=str) == brute(rows)


def made(seed, n, width, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return [(i, [float(np.float32(x)) for x in centres[i % 12] * spread + rng.normal(size=width) * 0.1], i % 5 or None) for i in range(n)]


@pytest.mark.parametrize("width", [16, 32, 64])
def test_codes_equal_plain_k_means(spark, width):
    rows = made(width, 400, width)
    random.Random(1).shuffle(rows)
    check(spark, rows)


def test_awkward_rows(spark):
    base = made(3, 90, 32)
    zero = [0.0] * 32
    rows = base + [(500, None, 1), (501, [None] * 32, 1), (502, [float("nan")] * 32, 2), (503, [float("inf")] + zero[1:], 2), (504, [], 3),
                   (505, zero[:31], 3), (None, zero, 9), (7, zero, 9), (7, zero, 9), (-4, [-0.001] * 32, 9),
                   (-9, zero[:16] + [1e30] + zero[17:], 9), (-8, [], 9), (-7, zero[:31], None)]
    check(spark, rows)


def test_ties_and_few_rows(spark):
    check(spark, [(1, [0.0] * 16, 1), (2, [0.0] * 16, 1), (3, [1 / 128] * 16, None), (4, [1 / 256] * 16, None)])
    check(spark, [(9, [0.5] * 16, 1)])


def test_tables_without_codes(spark):
    empty = ball_codes.coded(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns[0] == "vec_id"
    assert ball_codes.coded(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    uncut = ball_codes.coded(spark.createDataFrame([(1, [0.5] * 17, 1), (2, [], 1)], VECTORS)).collect()
    assert [(r.code, r.error, r.label_error) for r in uncut] == [(None, None, 0)] * 2
    huge = ball_codes.coded(spark.createDataFrame([(1, [1e30] * 16, 1)], VECTORS)).collect()
    assert [(r.code, r.error, r.label_error) for r in huge] == [(None, None, 0)]


def test_clashing_columns(spark):
    rows = made(5, 80, 16)
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' as v", "'x' as codes", "'x' as error", "'x' as _of")
    assert sorted((tuple(r) for r in ball_codes.coded(frame).collect()), key=str) == brute(rows)


def test_rings_equal_all_entries():
    rng = np.random.default_rng(8)
    for entries, reach in ((1, 5), (2, 3), (64, 4), (64, 300)):
        books = ball_codes.Codebooks(rng.integers(-reach, reach, size=(1, entries, 4)))
        x = rng.integers(-reach, reach, size=(3000, 4))
        want = books.all(0, x)
        for own in (rng.integers(0, entries, size=3000), want[0]):
            got = books.rings(0, x, own)
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
