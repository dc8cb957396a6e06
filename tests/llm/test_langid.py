import random
import zlib

import numpy as np

from claimgrid.llm import langid
from tests.llm.helpers import DOCS, awkward

STEMS = {"xx": ["ka", "mo", "ti", "ru"], "yy": ["bel", "dor", "vin", "sag"], "zz": ["йо", "ма", "ли", "ße"]}


def text(lang, rng, n=30):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n)) + ". 12!"


def table(spark, n=400):
    rng = random.Random(1)
    rows = [(i, lang := rng.choice(list(STEMS)), text(lang, rng)) for i in range(n)]
    return rows, spark.createDataFrame([(i, t, lang, f"src{i % 3}", len(t)) for i, lang, t in rows], DOCS)


def test_held_out_languages_are_learnt(spark):
    rows, docs = table(spark)
    got = {r.doc_id: r for r in langid.identified(awkward(docs)).collect()}
    for i, lang, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1


def test_rare_languages_keep_training_rows(spark):
    rng = random.Random(3)
    langs = ["xx"] * 300 + ["yy"] * 300 + ["zz"] * 6
    docs = spark.createDataFrame([(i, text(lang, rng), lang, "s", 0) for i, lang in enumerate(langs)], DOCS)
    model = langid.fit(docs, "doc_id", "text", "lang", sample=20, per_language=8)
    assert model.languages == ["xx", "yy", "zz"]
    got = langid.predicted(docs, model).where("doc_id >= 600").collect()
    assert [r.lang_pred for r in got] == ["zz"] * 6


def test_letters_have_one_form_at_every_size():
    for n in (1, 63, 64, 500):
        wide = "".join(chr(0xFF21 + k % 26) for k in range(n))
        assert np.array_equal(langid.characters(wide), langid.characters(wide.lower())) and langid.characters(wide)[1] == 0xFF41
        assert np.array_equal(langid.bins(langid.characters(wide + "x")), langid.bins(langid.characters(wide.lower() + "X")))
    marks = "\u0301\u0300 12 \u302a\ufe0f"
    assert not langid.has_letter(langid.characters(marks)) and langid.has_letter(langid.characters(marks + "\u4e2d"))
    assert not langid.has_letter(langid.characters("")) and langid.has_letter(langid.characters("é"))


def test_languages_are_bounded(spark):
    rng = random.Random(4)
    langs = ["xx"] * 60 + ["yy"] * 60 + [f"dirty-{k}" for k in range(80)]
    docs = spark.createDataFrame([(i, text("xx" if lang == "xx" else "yy", rng), lang, "s", 0) for i, lang in enumerate(langs)], DOCS)
    model = langid.fit(docs, "doc_id", "text", "lang", most_languages=3)
    assert model.languages == ["dirty-0", "xx", "yy"]


def test_regression_is_dense_kernel_ridge_regression():
    rng = random.Random(6)
    langs = [rng.choice(list(STEMS)) for _ in range(90)]
    size = 1 << 12
    made = langid.marked([langid.characters(text(lang, rng, 6)) for lang in langs], size)
    model = langid.train(np.packbits(made, axis=1), langs, landmarks=len(langs), size=size)
    x = langid.unit(made).astype(float)
    kernel, names = x @ x.T, sorted(set(langs))
    answer = np.array([names.index(lang) for lang in langs])
    target = np.where(answer[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1.0 / np.bincount(answer)[answer]
    # (K + ridge / weights) a + b = y with sum a = 0.
    system = np.block([[kernel + np.diag(langid.RIDGE * len(names) / share), np.ones((len(langs), 1))], [np.ones((1, len(langs))), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.vstack([target, np.zeros((1, len(names)))]))
    new = [langid.characters(text(rng.choice(list(STEMS)), rng, 5)) for _ in range(60)]
    want = langid.unit(langid.marked(new, size)).astype(float) @ x.T @ solved[:-1] + solved[-1]
    got = model.scores(new)
    assert np.allclose(got, want, atol=5e-3) and (got.argmax(axis=1) == want.argmax(axis=1)).all()


def test_only_texts_and_labels_outside_the_holdout_matter(spark):
    from pyspark.sql import functions as F

    _, docs = table(spark, 200)
    moved = docs.withColumn("lang", F.when(langid.held_out("doc_id"), "qq").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identified(d).collect()} for d in (docs, moved))
    assert a == b


def test_presence_kernel_is_the_plain_one():
    def grams(t):
        t = " " + t + " "
        return {t[k : k + n] for n in range(1, langid.LONGEST + 1) for k in range(len(t) - n + 1)}

    own = ["abc abd", "abd xyz", "éa b"]
    found = langid.unit(langid.marked([langid.characters(t) for t in own], size=1 << 22))
    for i, x in enumerate(own):
        for j, y in enumerate(own):
            a, b = grams(x), grams(y)
            assert abs(found[i] @ found[j] - len(a & b) / np.sqrt(len(a) * len(b))) < 1e-5


def test_awkward_rows(spark):
    _, docs = table(spark, 200)
    odd = spark.createDataFrame(
        [(1001, None, "xx", None, None), (None, "ka mo", "xx", None, None), (1005, "\u0301 12 \u302a", "yy", "s", 0), (1002, "12 !? \n", None, None, None), (1003, "", "yy", "s", 0),
         (1004, "belbel " * 20_000, None, "s", 0), (1004, "belbel", None, "s", 0)], DOCS)
    got = langid.identified(docs.union(odd)).where("doc_id is null or doc_id > 1000").collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [
        ("1001", "und"), ("1002", "und"), ("1003", "und"), ("1004", "yy"), ("1004", "yy"), ("1005", "und"), ("None", "xx")]
    assert all(r.score == 0 for r in got if r.lang_pred == "und") and all(r.held_out is not None for r in got)
    unlabelled = langid.identified(odd.withColumn("lang", odd.source))
    assert unlabelled.count() == 7 and langid.identified(docs.limit(0)).count() == 0
