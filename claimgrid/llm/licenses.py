"""License scans by diagonal voting.

Templates are the phrases that the contract names and standard notices of common
licenses, all as word sequences. Words are runs of ASCII letters, digits and
characters beyond ASCII, A-Z in lower case.

*Votes.* The hashes of all rolling word k-grams of every whole text are joined to the
template positions that have the same hash: pairs of words for phrases, ``GRAM`` words
for notices. A match at word i of the text and position t of the template votes for
the diagonal i - t. Votes are combined per text, template and diagonal. A phrase needs
all its pairs on one diagonal. For notices, diagonals at most ``DRIFT`` apart are
merged, because words that were put in or left out shift what follows; merged
diagonals whose votes could reach ``SHARE`` of the template are candidates.

*Verification.* Candidates go back to their texts, and words decide: a phrase must
stand there word by word; a notice's score is the share of its words in runs of
``GRAM`` or more equal words on the candidate's diagonals, and it counts from
``SHARE`` on. So a chance match of hashes never becomes a result.

Scale: hashes of one text leave Python as one array, are exploded inside a stage and
meet the templates in a broadcast join, whose size is known (``BROADCAST_GRAMS`` at
most; more templates are joined by shuffle). What is shuffled is votes, and each
belongs to one text. Votes are written once. So are word counts and, of texts that have
a gram of some template, the texts: only these few move to their candidates. They meet
by id and text hash, so copies and repeated ids don't share a key unless they are equal
in both, and then results are equal too.

A null text is empty: no words, no labels, score 0. Texts of any length are read
whole. Repeated rows each get their row. Null ids are ids like others. An empty table gives
no rows. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import staged
from .terms import FOLD, terms
from .texts import Texts, slices

# Fixed phrases and their labels, as the contract states them.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Fixed wording of public license notices.
NOTICES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

PAIR, GRAM = 2, 5
DRIFT = 4
SHARE = 0.6
# Template positions up to which they are broadcast (16 bytes each).
BROADCAST_GRAMS = 1_000_000

Template = tuple[str, str, bool]  # label, wording, whether it is a phrase


def templates() -> list[Template]:
    return [*((label, phrase, True) for phrase, label in PHRASES.items()), *((label, text, False) for label, text in NOTICES)]


def _folded(texts: Texts) -> Texts:
    return Texts(FOLD[texts.data], texts.offsets)


def template_places(known: list[Template]) -> list[tuple[int, int, int]]:
    """Hash, template and position of every gram of the templates."""
    places = []
    for k, (_, wording, phrase) in enumerate(known):
        raw = wording.encode()
        texts = _folded(Texts(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])))
        size = PAIR if phrase else GRAM
        if len(terms(raw)) < size:
            raise ValueError(f"a template needs {size} words: {wording!r}")
        places += [(h, k, t) for t, h in enumerate(texts.shingles(size)[0].view(np.int64).tolist())]
    return places


def template_grams(spark: SparkSession, known: list[Template]) -> DataFrame:
    """Those places as a table, with the broadcast hint if their number allows."""
    places = template_places(known)
    frame = spark.createDataFrame(places, "hash long, template int, t int")
    return F.broadcast(frame) if len(places) <= BROADCAST_GRAMS else frame


def rolling(docs: DataFrame) -> DataFrame:
    """Per text (doc_id, h, text): its number of pairs, and the hashes of all pairs and then of all longer grams."""
    schema = T.StructType([
        docs.schema["doc_id"], docs.schema["h"], T.StructField("pairs", T.IntegerType()),
        T.StructField("grams", T.ArrayType(T.LongType(), False)),
    ])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                folded = _folded(texts)
                (short, a), (long, b) = folded.shingles(PAIR), folded.shingles(GRAM)
                # Both ragged arrays, interleaved by text.
                both = np.empty(len(short) + len(long), dtype=np.uint64)
                both[np.arange(len(short)) + np.repeat(b[:-1], np.diff(a))] = short
                both[np.arange(len(long)) + np.repeat(a[1:], np.diff(b))] = long
                lists = pa.ListArray.from_arrays(pa.array(a + b, pa.int32()), pa.array(both.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(a), pa.int32()), lists], names=schema.names
                )

    return docs.mapInArrow(apply, schema)


def candidates(docs: DataFrame, known: list[Template]) -> DataFrame:
    """Merged diagonals that may hold a template: doc_id, h, template, low, high."""
    words = [len(terms(w.encode())) for _, w, _ in known]
    exploded = rolling(docs).select("doc_id", "h", "pairs", F.posexplode("grams").alias("at", "hash"))
    place = F.when(F.col("at") < F.col("pairs"), F.col("at")).otherwise(F.col("at") - F.col("pairs"))
    voted = exploded.join(template_grams(docs.sparkSession, known), "hash").select(
        "doc_id", "h", "template", "t", (place - F.col("t")).alias("diagonal")
    )
    # Equal rows of a table vote for the same places; a place counts once.
    per_diagonal = voted.groupBy("doc_id", "h", "template", "diagonal").agg(F.size(F.collect_set("t")).alias("votes"))
    per_diagonal = staged(per_diagonal, "license-votes")
    facts = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(n).alias("words")) for (_, _, p), n in zip(known, words, strict=True)])
    fact = F.element_at(facts, F.col("template") + 1)
    phrases = per_diagonal.where(fact["phrase"] & (F.col("votes") == fact["words"] - PAIR + 1)).select(
        "doc_id", "h", "template", F.col("diagonal").alias("low"), F.col("diagonal").alias("high")
    )
    along = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT).cast("int"), F.lit(1))
    merged = (
        per_diagonal.where(~fact["phrase"]).withColumn("opens", opens).withColumn("part", F.sum("opens").over(along))
        .groupBy("doc_id", "h", "template", "part")
        .agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    )
    notices = merged.where(F.col("votes") * GRAM >= fact["words"] * SHARE).select("doc_id", "h", "template", "low", "high")
    return phrases.union(notices)


def counted(docs: DataFrame, known: list[Template]) -> DataFrame:
    """Per text: doc_id, h, n_words, and the text itself if it has a gram of some template."""
    schema = T.StructType([
        docs.schema["doc_id"], docs.schema["h"], T.StructField("n_words", T.LongType()), T.StructField("text", T.StringType()),
    ])
    wanted = np.unique(np.array([h for h, _, _ in template_places(known)], dtype=np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                folded = _folded(texts)
                has = np.zeros(texts.count, dtype=bool)
                for size in (PAIR, GRAM):
                    hashes, at = folded.shingles(size)
                    place = np.minimum(np.searchsorted(grams, hashes), max(0, len(grams) - 1))
                    hits = np.concatenate(([0], np.cumsum(grams[place] == hashes))) if len(grams) else np.zeros(len(hashes) + 1)
                    has |= hits[at[1:]] > hits[at[:-1]]
                kept = part.column(2).take(pa.array(np.arange(texts.count), mask=~has))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(folded.words()[2]), pa.int64()), kept], names=schema.names
                )

    return staged(docs.mapInArrow(apply, schema), "license-texts")


class Checker:
    """Compares candidates with the words of their text."""

    def __init__(self, known: list[Template]):
        self.labels = [label for label, _, _ in known]
        self.phrase = [phrase for _, _, phrase in known]
        self.codes: dict[bytes, int] = {}
        self.words = [
            np.array([self.codes.setdefault(w, len(self.codes)) for w in terms(wording.encode())], dtype=np.int64) for _, wording, _ in known
        ]

    def share(self, text: np.ndarray, template: int, low: int, high: int) -> float:
        """Share of a notice's words in runs of ``GRAM`` equal words on these diagonals."""
        own = self.words[template]
        covered = np.zeros(len(own), dtype=bool)
        for diagonal in range(low, high + 1):
            first, last = max(0, -diagonal), min(len(own), len(text) - diagonal)
            if last - first < GRAM:
                continue
            equal = own[first:last] == text[first + diagonal : last + diagonal]
            runs = np.convolve(equal, np.ones(GRAM, dtype=np.int64), "valid") == GRAM
            covered[first:last] |= np.convolve(runs, np.ones(GRAM, dtype=np.int64)) > 0
        return covered.sum() / len(own)

    def check(self, raw: bytes, spans: list[dict] | None) -> tuple:
        own = terms(raw)
        if not spans:
            return len(own), 0, None, None, "", "", 0.0
        text = np.fromiter((self.codes.get(w, -1) for w in own), dtype=np.int64, count=len(own))
        starts: list[int] = []
        base, labels, score = set(), set(), 0.0
        for span in spans:
            k, low = span["template"], span["low"]
            if self.phrase[k]:
                words = self.words[k]
                if low >= 0 and np.array_equal(text[low : low + len(words)], words):
                    starts.append(low)
                    base.add(self.labels[k])
                    score = 1.0
                continue
            share = self.share(text, k, low, span["high"])
            if share >= SHARE:
                labels.add(self.labels[k])
                score = max(score, float(share))
        ends = (min(starts), max(starts)) if starts else (None, None)
        return len(own), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(base | labels)), score


@lru_cache(maxsize=4)
def _checker(known: tuple[Template, ...]) -> Checker:
    return Checker(list(known))


def scanned(docs: DataFrame, id: str = "doc_id", text: str = "text", known: list[Template] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    known = templates() if known is None else known
    narrow = docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    found = candidates(narrow, known)
    per_text = found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans"))
    per_text = per_text.withColumnsRenamed({"doc_id": "_of", "h": "_of_h"})
    every = counted(narrow, known)
    schema = T.StructType([
        every.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")],
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    ])
    none = [F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(schema.fields[2:], (0, None, None, "", "", 0.0), strict=True)]
    without = every.where("text is null").select("doc_id", "n_words", *none)
    both = every.where("text is not null").join(
        per_text, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("h") == F.col("_of_h")), "left"
    ).select("doc_id", "text", "spans")
    fixed = tuple(known)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = _checker(fixed).check
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            for part, texts in slices(batch, "text"):
                results = [check(texts.text(i), spans) for i, spans in enumerate(part.column("spans").to_pylist())]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*results, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return without.union(both.mapInArrow(apply, schema))
