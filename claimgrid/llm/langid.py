"""Language identification by a blended-spectrum string kernel.

*Kernel.* A text is the set of its character n-grams of one to ``LONGEST``
characters, lower-cased, letters and single blanks only, each hashed to one of
``BINS`` bins. The kernel of two texts is the number of bins they share over the
geometric mean of their numbers of bins, blended over the lengths.

*Model.* ``SAMPLE`` labelled texts, the ones with the least hashes of id and text,
train the model, and with them the ``PER_LANGUAGE`` least of every language that has
fewer in that sample, so a language is learnt however rare it is. At most the
``LANGUAGES`` values with the most labelled rows are learnt (equal numbers by name), so a
dirty label column can't make the sample grow; texts with other labels are predicted
like all others. The bounds are parameters; texts without a letter don't count. Tasks turn the whole texts of
the sample into presence bits, which is all that reaches the driver. ``LANDMARKS``
of them, taken class by class, span the Nyström space: with C the kernel of the landmarks, a text
is C^(-1/2) k(text, landmarks). One-versus-rest kernel ridge regression on
targets +1 and -1 is solved in that space, rare classes weighted up.

*Scoring.* Presence matrices of batches of texts are multiplied with the
landmarks' matrix, and the result with the regression weights. As the kernel is
linear in presence vectors, both matrices are multiplied once beforehand, so a
batch needs one product. Whole texts are scored. The score is the softmax of the
class outputs for the winner.

Letters are lower-cased one by one by the same rule in texts of any length; marks stay
with their letters. The language, source and id of a document are not part of what is
scored. Null texts and texts without a letter (marks, digits and signs are none) are
``und`` with score 0. Without labelled rows everything is ``und``; an empty table gives
no rows. Repeated rows get equal results. Ties go to the language that sorts first.
Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import mix, slices

LONGEST = 4
BINS = 1 << 14
SAMPLE = 3000
PER_LANGUAGE = 100
LANGUAGES = 200
LANDMARKS = 300
RIDGE = 1e-3
SHARPNESS = 6.0
BATCH = 64
UNKNOWN = "und"


def _form(code: int) -> int:
    """A letter in lower case, a mark as it is, a blank for everything else."""
    char = chr(code)
    kind = unicodedata.category(char)[0]
    low = char.lower()
    return ord(low) if kind == "L" and len(low) == 1 else code if kind in "LM" else 32


# The forms of all code points below this one are a table; those of others are found once each.
NEAR = 0x3000
_TABLE = np.array([_form(code) for code in range(NEAR)], dtype=np.uint32)
_LETTER = np.array([unicodedata.category(chr(code))[0] == "L" for code in range(NEAR)], dtype=bool)
_far_form = lru_cache(maxsize=1 << 17)(_form)


def characters(text: str) -> np.ndarray:
    """Code points with everything but letters and marks as single blanks, a blank on either side."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    near = codes < NEAR
    out = _TABLE[np.where(near, codes, 32)].astype(np.uint64)
    if not near.all():
        kinds, at = np.unique(codes[~near], return_inverse=True)
        out[~near] = np.array([_far_form(c) for c in kinds.tolist()], dtype=np.uint64)[at]
    out = np.concatenate(([np.uint64(32)], out, [np.uint64(32)]))
    blank = out == 32
    return out[~(blank & np.append(False, blank[:-1]))]


def has_letter(chars: np.ndarray) -> bool:
    """Whether a letter is among ``characters``; marks alone are none."""
    near = chars < NEAR
    if _LETTER[chars[near].astype(np.int64)].any():
        return True
    return any(unicodedata.category(chr(c))[0] == "L" for c in np.unique(chars[~near]).tolist())


def bins(chars: np.ndarray, longest: int = LONGEST, size: int = BINS) -> np.ndarray:
    """Bins of all n-grams of a text, with repeats."""
    found = []
    gram = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, longest + 1):
        if len(chars) < n:
            break
        gram = gram[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :]
        found.append(mix(gram + np.uint64(n << 56)) % np.uint64(size))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, dtype=np.int64)


def marked(texts: list[np.ndarray], size: int = BINS, longest: int = LONGEST) -> np.ndarray:
    """Presence of each bin, one row a text."""
    out = np.zeros((len(texts), size), dtype=bool)
    for row, chars in zip(out, texts, strict=True):
        row[bins(chars, longest, size)] = True
    return out


def unit(presence: np.ndarray) -> np.ndarray:
    """Presence vectors scaled to unit length."""
    out = presence.astype(np.float32)
    return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bins x languages: landmarks' matrix times regression weights
    offset: np.ndarray
    longest: int = LONGEST

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Class outputs of texts, by one matrix product a batch."""
        if not self.languages:
            return np.zeros((len(texts), 0))
        parts = [
            unit(marked(texts[k : k + BATCH], len(self.weights), self.longest)) @ self.weights + self.offset for k in range(0, len(texts), BATCH)
        ]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        chars = [characters(t or "") for t in texts]
        known = np.array([has_letter(c) for c in chars], dtype=bool) & bool(self.languages)
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(known)
        outputs = self.scores([chars[k] for k in at])
        if len(at):
            power = np.exp(SHARPNESS * (outputs - outputs.max(axis=1, keepdims=True)))
            best = outputs.argmax(axis=1)
            score[at] = (power / power.sum(axis=1, keepdims=True))[np.arange(len(at)), best]
            for k, b in zip(at.tolist(), best.tolist(), strict=True):
                names[k] = self.languages[b]
        return names, score


def train(bits: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, longest: int = LONGEST,
          size: int = BINS) -> Model:
    """Nyström kernel ridge regression on packed presence bits, one row a text."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((size, 0), dtype=np.float32), np.zeros(0), longest)
    turn: dict[str, int] = {}
    order = []
    for k, name in enumerate(languages):
        turn[name] = turn.get(name, -1) + 1
        order.append((turn[name], k))
    chosen = [k for _, k in sorted(order)[:landmarks]]

    def vectors(rows) -> np.ndarray:
        return unit(np.unpackbits(bits[rows], axis=1, count=size))

    marks = vectors(chosen)
    values, axes = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > max(1e-8, values.max() * 1e-6)
    root = axes[:, good] / np.sqrt(values[good])  # C^(-1/2) up to a rotation
    kernel = np.concatenate([vectors(slice(k, k + BATCH)) @ marks.T for k in range(0, len(bits), BATCH)])
    space = np.hstack([kernel.astype(np.float64) @ root, np.ones((len(kernel), 1))])
    answer = np.array([names.index(x) for x in languages])
    target = np.where(answer[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1.0 / np.bincount(answer, minlength=len(names))[answer]
    weighted = space * share[:, None]
    penalty = ridge * np.eye(space.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.solve(weighted.T @ space + penalty * len(names), weighted.T @ target)
    return Model(names, (marks.T.astype(np.float64) @ root @ solved[:-1]).astype(np.float32), solved[-1], longest)


def fit(labelled: DataFrame, id: str, text: str, lang: str, sample: int = SAMPLE, per_language: int = PER_LANGUAGE,
        most_languages: int = LANGUAGES) -> Model:
    """A model from a bounded sample of labelled rows with a text and a language."""
    counted = labelled.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).count()
    names = [r["lang"] for r in counted.orderBy(F.desc("count"), "lang").limit(most_languages + 1).collect()]
    learnt = F.lit(True) if len(names) <= most_languages else F.col(lang).cast("string").isin(names[:most_languages])
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & learnt).select(
        F.xxhash64(F.col(id).cast("string"), text).alias("place"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    ).where(F.col("text").rlike(r"\p{L}"))
    # The place of the last row of the sample; only numbers are sorted.
    last = rows.select("place").orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    # The same in each language. Tasks keep their own least rows before they shuffle.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    first = rows.select("lang", "place").withColumn("nth", nth).where(F.col("nth") <= per_language)
    lasts = {r[0]: r[1] for r in first.groupBy("lang").agg(F.max("place").alias("last")).where(F.col("last") > F.lit(last)).collect()}
    rare = F.create_map(*[F.lit(x) for pair in lasts.items() for x in pair])[F.col("lang")] if lasts else F.lit(None).cast("long")
    schema = "place long, lang string, bits binary"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                chars = [characters(texts.text(i).decode("utf-8", "replace")) for i in range(texts.count)]
                bits = np.packbits(marked(chars), axis=1)
                use = [k for k, c in enumerate(chars) if has_letter(c)]
                kept = part.take(pa.array(use, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), pa.array([bits[k].tobytes() for k in use], pa.binary())], names=["place", "lang", "bits"]
                )

    found = []
    if last is not None:
        found += rows.where(F.col("place") <= last).mapInArrow(apply, schema).orderBy("place", "lang").limit(sample).collect()
    if lasts:
        more = rows.where((F.col("place") > last) & (F.col("place") <= rare)).mapInArrow(apply, schema)
        have = Counter(r["lang"] for r in found)
        more = more.withColumn("nth", nth).where(F.col("nth") <= per_language).orderBy("place", "lang").collect()
        found += [r for r in more if have[r["lang"]] + r["nth"] <= per_language]
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in found), dtype=np.uint8).reshape(-1, BINS // 8)
    return train(bits, [r["lang"] for r in found])


def held_out(id: str) -> Column:
    """Rows that the contract keeps out of the fit."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predicted(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    narrow = docs.select(F.col(id).alias("doc_id"), held_out(id).alias("held_out"), F.col(text).alias("text"))
    schema = T.StructType([
        narrow.schema["doc_id"], narrow.schema["held_out"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())
    ])
    # Bins x languages: bounded by the parameters and the number of languages.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                names, score = own.predict([texts.text(i).decode("utf-8", "replace") for i in range(texts.count)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=schema.names
                )

    return narrow.mapInArrow(apply, schema)


def identified(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the labelled rows that are not held out, then predict every row."""
    return predicted(docs, fit(docs.where(~held_out(id)), id, text, lang), id, text)
