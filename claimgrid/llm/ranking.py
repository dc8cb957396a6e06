"""Ranked lexical search by presence masks.

The items are a stated set of searches against all documents. They go over the
documents in blocks of at most ``BLOCK_BYTES`` of item text, so what a worker holds
of them is bounded however many there are.

*Postings.* One scan cuts every whole text into terms and writes, per document, its
number of terms and the items' terms in it with their occurrences. Corpus counts
(documents N, terms L, document frequency of each term) are combined from that
table; only the frequencies of one block's terms reach the driver.

*Groups.* A task reads postings in blocks of documents. Each term has a bitmap over
the block; the bitmaps of an item's terms, turned from terms to documents, give each
document the mask of the item's terms in it, and documents of equal masks form a
group. A mask's maximum score is the sum of the greatest contributions its terms make
anywhere in the block. Groups are scored exactly in descending order of that maximum
and the item is safely finished once the next maximum is below the least of its best
``top`` scores so far, which stay known from block to block. Equal scores go by
ascending id, so a group whose maximum equals that least score is still scored.

A task returns at most ``top`` rows an item. They are ranked in two steps, first
among ``FAN`` tasks, then over all, so no window holds more than a share of them.

Null and empty texts have no terms: such documents never appear, such items have no
rows. Every row of ``items`` is a search of its own, so repeated or null item ids get
one list each. Repeated documents all count and all appear; null document ids come
last among equal scores. Texts of any length are read whole. Empty tables give no
rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import staged
from .terms import terms
from .texts import slices

TOP = 50
BLOCK_BYTES = 1 << 20
# Bounds of a block of documents in a task.
DOCS, POSTINGS = 1 << 16, 1 << 21
# How many tasks' rows are ranked together first, and how many documents are scored at a time.
FAN, STEP = 256, 512

POSTING_SCHEMA = "doc_id long, n long, codes array<int>, tfs array<int>"


class Searches:
    """One block of items: their ids, and their distinct terms as codes."""

    def __init__(self, rows: list[tuple[object, bytes]]):
        self.codes: dict[bytes, int] = {}
        self.ids: list[object] = []
        self.terms: list[np.ndarray] = []
        for item, raw in rows:
            own = sorted({self.codes.setdefault(t, len(self.codes)) for t in terms(raw)})
            if own:
                self.ids.append(item)
                self.terms.append(np.array(own, dtype=np.int64))


def search_blocks(items: DataFrame, id: str, text: str, most: int = BLOCK_BYTES) -> Iterator[Searches]:
    """Items in blocks of at most ``most`` bytes of text, one item at least; the driver holds one block."""
    block, size = [], 0
    for item, value in items.select(id, text).where(F.col(text).isNotNull()).toLocalIterator():
        raw = value.encode()
        if block and size + len(raw) > most:
            yield Searches(block)
            block, size = [], 0
        block.append((item, raw))
        size += len(raw)
    if block:
        yield Searches(block)


def postings(docs: DataFrame, id: str, text: str, codes: dict[bytes, int]) -> DataFrame:
    """Per document: its id, number of terms, and codes and occurrences of known terms. Documents without terms are left out."""
    known = docs.sparkSession.sparkContext.broadcast(codes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, width = known.value.get, max(1, len(known.value))
        for batch in batches:
            for part, texts in slices(batch, "text"):
                own = [terms(texts.text(i)) for i in range(texts.count)]
                n = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
                found = np.concatenate([np.fromiter(map(code, x, repeat(-1)), dtype=np.int64, count=len(x)) for x in own])
                key = (np.repeat(np.arange(len(own)), n) * width + found)[found >= 0]
                key, tf = np.unique(key, return_counts=True)
                at = pa.array(np.searchsorted(key, np.arange(len(own) + 1) * width), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (key % width, tf)]
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], names=["doc_id", "n", "codes", "tfs"])
                yield rows.filter(pa.array(n > 0))

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(apply, POSTING_SCHEMA)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The best rows of one item so far."""

    def __init__(self, top: int):
        self.top = top
        self.score = np.zeros(0, dtype=np.int64)
        self.id = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)

    def least(self) -> int:
        """What a document must reach to enter."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, id: np.ndarray, null: np.ndarray) -> None:
        fits = score >= self.least()
        score, id, null = (np.concatenate((a, b[fits])) for a, b in ((self.score, score), (self.id, id), (self.null, null)))
        best = np.lexsort((id, null, -score))[: self.top]
        self.score, self.id, self.null = score[best], id[best], null[best]


class Block:
    """Postings of a block of documents, by term."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, documents: int, length: int):
        ids = rows.column("doc_id").combine_chunks()
        self.null = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        n = np.asarray(rows.column("n").combine_chunks())
        codes = rows.column("codes").combine_chunks()
        sizes = np.asarray(codes.value_lengths())
        code = np.asarray(codes.flatten()).astype(np.int64)
        tf = np.asarray(rows.column("tfs").combine_chunks().flatten()).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), sizes)
        m = 50 + (50 * n * documents) // length
        gain = weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.argsort(code, kind="stable")
        self.doc, self.gain, code = doc[order], gain[order], code[order]
        self.at = np.searchsorted(code, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), dtype=np.int64)
        used = np.flatnonzero(np.diff(self.at))
        if len(used):
            self.most[used] = np.maximum.reduceat(self.gain, self.at[used])
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, term: int) -> np.ndarray:
        """Documents that hold a term, a bit each."""
        if term not in self.bitmaps:
            present = np.zeros(len(self.ids), dtype=np.uint8)
            present[self.doc[self.at[term] : self.at[term + 1]]] = 1
            self.bitmaps[term] = np.packbits(present)
        return self.bitmaps[term]

    def groups(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents ordered by group, the offsets of the groups, and their maximum scores, highest first."""
        maps = np.stack([self.bitmap(t) for t in own.tolist()])
        holders = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(maps), count=len(self.ids)))
        masks = np.packbits(np.unpackbits(maps, axis=1, count=len(self.ids))[:, holders], axis=0)
        group = np.zeros(len(holders), dtype=np.int64)
        for k in range(0, len(masks), 7):  # seven bytes of the masks and the group so far at a time
            part = np.zeros(len(holders), dtype=np.int64)
            for byte in masks[k : k + 7]:
                part = part << 8 | byte
            part = np.unique(part, return_inverse=True)[1]
            group = np.unique(group * (part.max(initial=0) + 1) + part, return_inverse=True)[1]
        docs = np.argsort(group, kind="stable")
        at = np.searchsorted(group[docs], np.arange(group.max(initial=-1) + 2))
        held = np.unpackbits(masks[:, docs[at[:-1]]], axis=0, count=len(own))
        most = self.most[own] @ held.astype(np.int64)
        rank = np.argsort(-most, kind="stable")
        sizes = np.diff(at)[rank]
        ends = np.cumsum(sizes)
        ordered = docs[np.repeat(at[:-1][rank] - (ends - sizes), sizes) + np.arange(len(docs))]
        return holders[ordered], np.concatenate(([0], ends)), most[rank]

    def scores(self, docs: np.ndarray, own: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), dtype=np.int64)
        for term in own.tolist():
            lo, hi = self.at[term], self.at[term + 1]
            place = lo + np.searchsorted(self.doc[lo:hi], docs)
            place = np.minimum(place, hi - 1)
            total += np.where(self.doc[place] == docs, self.gain[place], 0)
        return total

    def search(self, own: np.ndarray, best: Best) -> None:
        """Bring ``best`` up to date with this block."""
        own = own[self.most[own] > 0]
        if not len(own) or self.most[own].sum() < best.least():
            return
        docs, at, most = self.groups(own)
        done, step = 0, STEP
        while done < len(most) and most[done] >= best.least():
            # The next groups, as many as hold about ``step`` documents, while their maxima may still count.
            stop = max(done + 1, int(np.searchsorted(at, at[done] + step, side="right")) - 1)
            stop = min(stop, done + int(np.searchsorted(-most[done:], -best.least(), side="right")))
            some = docs[at[done] : at[stop]]
            best.add(self.scores(some, own), self.ids[some], self.null[some])
            done, step = stop, 2 * step


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a task in blocks of bounded size, one row at least."""
    held: list[pa.RecordBatch] = []
    docs = size = 0
    for batch in batches:
        start = 0
        upto = np.asarray(batch.column("codes").offsets if batch.num_rows else [0]).astype(np.int64)
        while start < batch.num_rows:
            room = int(np.searchsorted(upto, upto[start] + POSTINGS - size, side="right")) - 1
            stop = min(max(room, start + (not held)), start + DOCS - docs, batch.num_rows)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                docs, size = docs + stop - start, size + int(upto[stop] - upto[start])
            if stop < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, docs, size = [], 0, 0
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def _candidates(found: DataFrame, block: Searches, weights: np.ndarray, documents: int, length: int, id_type: T.DataType, top: int) -> DataFrame:
    """At most ``top`` rows of each item from each task: slot, item_id, doc_id, score."""
    shared = found.sparkSession.sparkContext.broadcast((block.ids, block.terms, weights))
    schema = T.StructType([
        T.StructField("slot", T.IntegerType()), T.StructField("item_id", id_type),
        T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()),
    ])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ids, own, gains = shared.value
        best = [Best(top) for _ in own]
        for rows in _blocks(batches):
            part = Block(rows, gains, documents, length)
            for item, state in zip(own, best, strict=True):
                part.search(item, state)
        counts = [len(b.score) for b in best]
        if sum(counts):
            slots = np.repeat(np.arange(len(best)), counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slots, pa.int32()), pa.array([ids[s] for s in slots.tolist()], to_arrow_type(id_type)),
                    pa.array(np.concatenate([b.id for b in best]), mask=np.concatenate([b.null for b in best])),
                    pa.array(np.concatenate([b.score for b in best])),
                ],
                names=schema.names,
            )

    return found.mapInArrow(apply, schema)


def ranked(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP) -> DataFrame:
    """The ``top`` best documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    id_type = items.schema[item_id].dataType
    parts: list[DataFrame] = []
    for block in search_blocks(items, item_id, item_text):
        found = staged(postings(docs, id, text, block.codes), "ranking-postings")
        documents, length = found.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents or not block.ids:
            continue
        weights = np.zeros(len(block.codes), dtype=np.int64)
        for code, df in found.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1))).collect():
            weights[code] = weight(documents, df)
        rows = _candidates(found, block, weights, documents, length, id_type, top)
        rows = rows.withColumn("part", F.floor(F.spark_partition_id() / FAN))
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        for keys in (["slot", "part"], ["slot"]):
            rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
        parts.append(rows.select("item_id", "rank", "doc_id", "score"))
    if not parts:
        empty = T.StructType([
            T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()),
        ])
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.union, parts)
