"""Quality rules with risk-controlled thresholds.

Fixed base rules are joined by rules whose cutoffs are learnt from labelled
documents. The labelled documents of a stratum (its language) are halved by a
hash of their id. The *tuning* half gives each rule a ladder of cutoffs, from one
that rejects next to nothing to stricter ones. On the *holdout* half the ladder
is climbed from the lenient end: a step is certified while the exact binomial
p-value of "the share of good documents it rejects exceeds ``risk``" stays
within ``error / strata``. Fixed-sequence testing needs no further correction
along a ladder, and the division by the number of strata (Bonferroni) makes the
guarantee hold for all strata at once: with probability ``1 - error`` no stratum
falsely rejects more than ``risk`` of its good documents. Among the certified
steps the one with the fewest errors on the tuning half is used. A stratum in
which no step can be certified rejects nothing beyond the base rules.

Null or word-free texts fail the base rules (fewer than ten words). A null
language is a stratum of its own. A document labelled more than once takes its
lowest label; null labels and null ids are left out of the fit. The guarantee is about
the learnt cutoffs; what the base rules reject comes beside it. Repeated rows each get
their verdict, texts of any length are read whole, without labels only the base rules
reject, and an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import staged
from .texts import Texts, slices

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
RISK = 0.05
ERROR = 0.05
# Shares are counted in thousandths, so that the tables of the fit are bounded.
GRAIN = 1000
# The ladder: multiples of the largest share among good tuning documents, then
# the shares that this part of the good tuning documents exceeds.
SCALES = (4.0, 3.0, 2.0, 1.5, 1.25, 1.1, 1.0)
EXCEEDED = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.04)
STEPS = len(SCALES) + len(EXCEEDED)
RULES = ("symbol_share", "symbol_word_share", "upper_share", "repeat_share", "dup_line_share", "bang_share")

COUNTS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_BANG = np.zeros(256, dtype=bool)
_BANG[[ord("!"), ord("?")]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _per_word(texts: Texts, flags: np.ndarray) -> np.ndarray:
    starts, ends, _ = texts.words()
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[ends] - total[starts]


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[at])


def repeated_words(texts: Texts, window: int = 5) -> np.ndarray:
    """Per text, words inside windows that occur at least twice in that text."""
    hashes = texts.word_hashes()
    _, _, at = texts.words()
    n = np.diff(at)
    amount = np.maximum(n - window + 1, 0)
    if not amount.sum():
        return np.zeros(texts.count, dtype=np.int64)
    shingles, offsets = texts.shingles(window)
    whole = np.repeat(n >= window, np.diff(offsets))
    owner = np.repeat(np.arange(texts.count), amount)
    first = np.repeat(at[:-1], amount) + np.arange(amount.sum()) - np.repeat(np.cumsum(amount) - amount, amount)
    keys = shingles[whole]
    order = np.lexsort((keys, owner))
    keys, owner, first = keys[order], owner[order], first[order]
    same = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(hashes) + window + 1, dtype=np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + window, -1)
    return _per_text(np.cumsum(cover)[: len(hashes)] > 0, at)


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """Counts of each text, and the rule shares in thousandths."""
    data = texts.data
    _, _, at = texts.words()
    n_words = np.diff(at)
    word_chars = texts.sums(~_BLANK[data] & ((data & 0xC0) != 0x80))
    symbols = _SYMBOL[data]
    n_symbols = texts.sums(symbols)
    lines = np.array([repeated_lines(texts.text(i)) for i in range(texts.count)], dtype=np.int64).reshape(-1, 2)
    starts, ends, _ = texts.words()
    symbol_words = _per_text(_per_word(texts, symbols) * 2 >= ends - starts, at)
    repeat = repeated_words(texts)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.minimum(part * GRAIN // np.maximum(whole, 1), GRAIN)

    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": repeat,
        "symbol_share": share(n_symbols, word_chars),
        "symbol_word_share": share(symbol_words, n_words),
        "upper_share": share(texts.sums(_UPPER[data]), texts.sums(_LETTER[data])),
        "repeat_share": share(repeat, n_words),
        "dup_line_share": share(lines[:, 1], lines[:, 0]),
        "bang_share": share(texts.sums(_BANG[data]), n_words),
    }


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES)


def with_measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with a long column ``prefix + m`` for each measure ``m``."""
    fields = [T.StructField(prefix + m, T.LongType()) for m in MEASURED]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                found = measure(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(found[m], pa.int64()) for m in MEASURED)],
                    names=[*part.schema.names, *(prefix + m for m in MEASURED)],
                )

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, *fields]))


def p_value(rejected: int, good: int, risk: float) -> float:
    """Exact P(X <= rejected) for X binomial(good, risk): small if the true share is surely below ``risk``."""
    if good == 0:
        return 1.0
    k = np.arange(rejected + 1)
    lg = np.vectorize(math.lgamma)
    logs = lg(good + 1.0) - lg(k + 1.0) - lg(good - k + 1.0) + k * math.log(risk) + (good - k) * math.log1p(-risk)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def ladder(counts: np.ndarray) -> list[int]:
    """Cutoffs of one rule from the histogram of its shares (0..GRAIN) among good documents."""
    if not counts.sum():
        return [GRAIN] * STEPS
    top = int(np.flatnonzero(counts)[-1])
    above = counts.sum() - np.cumsum(counts)
    cuts = [min(GRAIN, math.ceil(max(top, 1) * s)) for s in SCALES]
    cuts += [int(np.flatnonzero(above <= e * counts.sum())[0]) for e in EXCEEDED]
    return np.minimum.accumulate(cuts).tolist()


def certified(good: np.ndarray, bad: np.ndarray, held: np.ndarray, risk: float, level: float) -> int:
    """The step to use, -1 for none.

    ``good``, ``bad`` and ``held`` count the tuning documents of either label
    and the good holdout documents by the first step that rejects them (the
    last entry: by none).
    """
    best, least = -1, None
    for step in range(STEPS):
        if p_value(int(held[: step + 1].sum()), int(held.sum()), risk) > level:
            break
        errors = int(good[: step + 1].sum() + bad[step + 1 :].sum())
        if least is None or errors < least:
            best, least = step, errors
    return best


def fit(measures: DataFrame, labels: DataFrame, stratum: str = "lang", id: str = "doc_id", quality: str = "quality",
        risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Cutoffs per stratum: (stratum, step, good_held, <rule>...); reject if a share exceeds its cutoff.

    ``measures`` has the id, the stratum and the rule columns. Only counts in
    bounded tables (strata x rules x thousandths) reach a group's task.
    """
    marks = (
        labels.select(F.col(id).alias("_id"), F.col(quality).cast("int").alias("_good"))
        .where("_id is not null and _good is not null")
        .groupBy("_id")
        .agg(F.min("_good").alias("_good"))
    )
    rows = (
        measures.select(F.col(id).alias("_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                        F.col(stratum).isNull().alias("no_stratum"), *RULES)
        .join(marks, "_id")
        .withColumn("held", F.pmod(F.xxhash64("_id"), F.lit(2)) == 1)
    )
    rows = staged(rows.select("stratum", "no_stratum", "held", "_good", *RULES), "quality-labelled")
    shares = rows.where("not held and _good = 1").select(
        "stratum", "no_stratum", F.posexplode(F.array(*RULES)).alias("rule", "share")
    ).groupBy("stratum", "no_stratum", "rule", "share").count()
    cut_fields = [T.StructField(f"cut_{r}", T.ArrayType(T.LongType())) for r in RULES]
    key_fields = [T.StructField("stratum", T.StringType()), T.StructField("no_stratum", T.BooleanType())]

    def ladders(frame: pd.DataFrame) -> pd.DataFrame:
        cuts = []
        for r in range(len(RULES)):
            own = frame[frame["rule"] == r]
            cuts.append(ladder(np.bincount(own["share"], weights=own["count"], minlength=GRAIN + 1).astype(np.int64)))
        return pd.DataFrame([[frame["stratum"].iloc[0], frame["no_stratum"].iloc[0], *cuts]], columns=[f.name for f in (*key_fields, *cut_fields)])

    keys = ["stratum", "no_stratum"]
    cuts = staged(shares.groupBy(*keys).applyInPandas(ladders, T.StructType([*key_fields, *cut_fields])), "quality-ladders")
    reached = rows.join(cuts, keys).select(*keys, "held", "_good", _first_step().alias("first")).groupBy(*keys, "held", "_good", "first").count()
    strata = cuts.agg(F.count(F.lit(1)).alias("strata"))
    out = T.StructType([*key_fields, T.StructField("step", T.LongType()), T.StructField("good_held", T.LongType())])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        def by_step(held: bool, good: int) -> np.ndarray:
            own = frame[(frame["held"] == held) & (frame["_good"] == good)]
            return np.bincount(own["first"], weights=own["count"], minlength=STEPS + 1).astype(np.int64)

        held = by_step(True, 1)
        step = certified(by_step(False, 1), by_step(False, 0), held, risk, error / int(frame["strata"].iloc[0]))
        return pd.DataFrame([[frame["stratum"].iloc[0], frame["no_stratum"].iloc[0], step, int(held.sum())]], columns=[f.name for f in out])

    # One row with the number of strata beside bounded counts.
    chosen = reached.join(F.broadcast(strata)).groupBy(*keys).applyInPandas(choose, out)
    never = F.lit(GRAIN)
    picked = cuts.join(chosen, keys).select(
        *keys, "step", "good_held",
        *[F.when(F.col("step") < 0, never).otherwise(F.element_at(f"cut_{r}", (F.col("step") + 1).cast("int"))).alias(f"at_{r}") for r in RULES],
    )
    return staged(picked, "quality-cutoffs")


def _first_step() -> Column:
    """First step of the ladders at which any rule rejects; STEPS if none does. Cutoffs fall from step to step."""
    return F.least(*[F.expr(f"size(filter(cut_{r}, c -> c >= {r}))") for r in RULES])


def judged(measures: DataFrame, cutoffs: DataFrame, stratum: str = "lang", prefix: str = "") -> DataFrame:
    """``measures`` with base_failed, kept and reasons (the learnt rules that reject); all its rows stay.

    The cutoffs are one row per stratum; adaptive execution broadcasts them by
    their measured size, and splits a hot stratum otherwise.
    """
    cut = cutoffs.select(
        F.col("stratum").alias("_stratum"), F.col("no_stratum").alias("_no_stratum"), *[F.col(f"at_{r}").alias(f"_at_{r}") for r in RULES]
    )
    joined = measures.join(
        cut,
        (F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("_stratum")) & (F.col(stratum).isNull() == F.col("_no_stratum")),
        "left",
    )
    why = F.array_compact(F.array(*[F.when(F.col(prefix + r) > F.col(f"_at_{r}"), F.lit(r)) for r in RULES]))
    failed = (F.col(prefix + "n_words") < MIN_WORDS) | (
        100 * F.col(prefix + "n_repeat_words") > MAX_REPEAT_PERCENT * F.col(prefix + "n_words")
    )
    return (
        joined.withColumn(prefix + "reasons", why)
        .withColumn(prefix + "base_failed", failed)
        .withColumn(prefix + "kept", ~failed & (F.size(why) == 0))
        .drop("_stratum", "_no_stratum", *[f"_at_{r}" for r in RULES])
    )


def assess(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per document: id, measures, base_failed, kept, reasons. Texts are read once."""
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(stratum).cast("string").alias("lang"))
    measures = staged(with_measures(narrow).drop("text"), "quality-measures")
    return judged(measures, fit(measures, labels.select(F.col("doc_id"), F.col("quality"))))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    The labelled fit reads the texts once, the filter a second time; no text is shuffled.
    """
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(stratum).cast("string").alias("lang"))
    cutoffs = fit(with_measures(narrow).drop("text"), labels.select(F.col("doc_id"), F.col("quality")))
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    marked = judged(with_measures(docs, text, prefix), cutoffs, stratum, prefix)
    return marked.where(prefix + "kept").select(*docs.columns)
