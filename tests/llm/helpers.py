"""Small tables with every awkward case, and plain versions of what is counted."""

import random
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, lang="en", source="src1", start=1):
    """Documents from texts, or from (doc_id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, start)]
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in rows], DOCS)


def awkward(df):
    """``df`` with columns whose names an operator might use itself."""
    for name in ("h", "row", "rep", "elements", "_text_hash", "_id", "kept", "item_ids", "contaminated", "_q_kept", "lang_pred", "root"):
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def words(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingles(text, size=5):
    w = text.split()
    return Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / max(1, a.total() + b.total() - shared)
