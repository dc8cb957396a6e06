"""Vector codes by ball k-means over the parts of vectors.

A vector of integers (each component becomes floor(256 * x)) is cut into ``PARTS``
equal parts; every part position has a codebook of at most ``ENTRIES`` entries, and a
code is the indexes of the nearest entries. ``ROUNDS`` times all parts are assigned
and each entry becomes the componentwise floor of the mean of its parts; then they
are assigned once more.

*Balls.* The first assignment compares all entries. From then on every part has an
entry, and the parts of one entry in a block of rows are its ball, whose radius is
the distance of the farthest part. With d the distance of a part to its entry's new
place and D that between two entries, an entry with D > 2d is farther than the part's
own, by the triangle inequality. So an entry's neighbours are those within twice its
ball's radius; a part nearer than half the way to the nearest neighbour is in the
stable core and skips all work; for the others, sorted by D, the annular ring in
which d lies says how many of the nearest neighbours are compared exactly. All
comparisons are between squared integers, D = 2d counts as inside, and equal
distances go to the lower index, so the result is that of comparing all entries.

*Rounds.* Each round reads the table that the last one wrote (integers, codes), so a
lost executor repeats its tasks only. Sums and counts are added up inside a task, then
per part and entry over tasks; the codebooks (``PARTS * ENTRIES`` entries, whatever
the input) are all that reaches the driver.

A vector that is null or holds null or non-finite components is dropped. The seeds are
the vectors with the ``ENTRIES`` smallest ids, equal ids by components, null ids last;
fewer rows make fewer entries. All vectors should have the length of the first seed
that is a multiple of ``PARTS``; rows of other lengths (empty ones too) can't be cut,
and those with a finite component above ``LARGEST`` would leave 64 bits: both keep null
code and error, and a place among the seeds that stays empty. Repeated rows each
count. Rows with a null label form one group. Empty tables give no rows. Extra columns
aren't read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LARGEST = 2.0**18
# Rows that are worked on at a time.
ROWS = 8192


def integers(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """Kept rows: vec_id, label, v (array of long, empty if a component is too large)."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fits = F.forall(v, lambda x: F.abs(x) <= LARGEST)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    return vectors.where(v.isNotNull() & F.forall(v, finite)).select(
        F.col(id).alias("vec_id"), F.col(label).alias("label"),
        F.when(fits, whole).otherwise(F.array().cast("array<bigint>")).alias("v"),
    )


class Codebooks:
    """Entries of all parts, with the squared distances between them, nearest first."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # part, entry, position
        gap = entries[:, :, None, :] - entries[:, None, :, :]
        between = (gap * gap).sum(axis=3)
        own = np.arange(entries.shape[1])
        between[:, own, own] = -1  # an entry itself comes first and is never a neighbour
        self.order = np.argsort(between, axis=2, kind="stable")[:, :, 1:]
        self.between = np.take_along_axis(between, self.order, axis=2)

    def all(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance, from all entries."""
        gap = x[:, None, :] - self.entries[part][None]
        distance = (gap * gap).sum(axis=2)
        code = distance.argmin(axis=1)
        return code, distance[np.arange(len(x)), code]

    def rings(self, part: int, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, from the entry each part had: stable cores stay, rings limit the rest."""
        entries, between, order = self.entries[part], self.between[part], self.order[part]
        gap = x - entries[own]
        nearest = (gap * gap).sum(axis=1)
        code = own.copy()
        if not order.shape[1]:
            return code, nearest
        # The ball of each entry in this block, and how many entries lie within twice its radius.
        radius = np.full(len(entries), -1, dtype=np.int64)
        np.maximum.at(radius, own, nearest)
        neighbours = (between <= 4 * radius[:, None]).sum(axis=1)
        reach = 4 * nearest
        open_ = np.flatnonzero((neighbours[own] > 0) & (reach >= between[own, 0]))
        for ring in range(int(neighbours.max(initial=0))):
            open_ = open_[(ring < neighbours[own[open_]]) & (reach[open_] >= between[own[open_], ring])]
            if not len(open_):
                break
            candidate = order[own[open_], ring]
            gap = x[open_] - entries[candidate]
            distance = (gap * gap).sum(axis=1)
            better = (distance < nearest[open_]) | ((distance == nearest[open_]) & (candidate < code[open_]))
            at = open_[better]
            nearest[at], code[at] = distance[better], candidate[better]
        return code, nearest

    def assign(self, values: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes of whole vectors (rows, parts) and their summed squared distances."""
        parts, width = self.entries.shape[0], self.entries.shape[2]
        codes = np.zeros((len(values), parts), dtype=np.int64)
        error = np.zeros(len(values), dtype=np.int64)
        for p in range(parts):
            x = values[:, p * width : (p + 1) * width]
            codes[:, p], distance = self.all(p, x) if known is None else self.rings(p, x, known[:, p])
            error += distance
        return codes, error


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows, which of them have vectors of ``width``, and those vectors."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        v = part.column("v")
        fits = np.asarray(v.value_lengths()) == width
        values = np.asarray(v.filter(pa.array(fits)).flatten()).reshape(-1, width)
        yield part, fits, values


def assigned(rows: DataFrame, books: Codebooks, again: bool, last: bool = False) -> DataFrame:
    """``rows`` with codes by ``books``; ``again`` starts from the codes they have, ``last`` adds the error and drops the vector."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, _, length = books.entries.shape
    kept = [f for f in rows.schema.fields if f.name not in ("codes", *(["v"] if last else []))]
    added = [T.StructField("codes", T.BinaryType()), *([T.StructField("error", T.LongType())] if last else [])]
    schema = T.StructType([*kept, *added])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Codebooks = shared.value
        for batch in batches:
            for part, fits, values in _rows(batch, parts * length):
                known = None
                if again:
                    raw = part.column("codes").filter(pa.array(fits)).to_pylist()
                    known = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, parts).astype(np.int64)
                codes, error = own.assign(values, known)
                at = np.where(fits, np.cumsum(fits) - 1, 0)
                every = [x.tobytes() for x in codes.astype(np.uint8)] or [b""]
                columns = [part.column(f.name) for f in kept]
                columns.append(pa.array([every[k] if ok else None for k, ok in zip(at.tolist(), fits.tolist())], pa.binary()))
                if last:
                    columns.append(pa.array(np.append(error, 0)[at], mask=~fits))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(apply, schema)


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are the floored means of the parts that have them; unused entries stay."""
    parts, entries, length = books.entries.shape

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, length), dtype=np.int64)
        counts = np.zeros(parts * entries, dtype=np.int64)
        for batch in batches:
            for part, fits, values in _rows(batch, parts * length):
                raw = part.column("codes").filter(pa.array(fits)).to_pylist()
                codes = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, parts)
                for p in range(parts):
                    at = p * entries + codes[:, p].astype(np.int64)
                    counts += np.bincount(at, minlength=len(counts))
                    np.add.at(sums, at, values[:, p * length : (p + 1) * length])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["place", "n", "sums"]
        )

    partial = rows.mapInArrow(apply, "place long, n long, sums array<long>")
    per_entry = partial.groupBy("place").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(length)])
    new = books.entries.copy().reshape(parts * entries, length)
    for place, n, *sums in per_entry.collect():
        new[place] = [s // n for s in sums]
    return Codebooks(new.reshape(parts, entries, length))


def coded(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    # The raw integers are read twice and cheap to make, so only coded rows are written.
    rows = integers(vectors, id, vector, label)
    seeds = [r.v for r in rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()]
    schema = T.StructType([
        T.StructField("vec_id", vectors.schema[id].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
        T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType()),
    ])
    if not seeds:
        return vectors.sparkSession.createDataFrame([], schema)
    width = next((len(s) for s in seeds if s and len(s) % PARTS == 0), 0)
    if not width:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:3]]
        return rows.select("vec_id", *nothing, F.lit(0).cast("long").alias("label_error"), F.sha2(F.lit(""), 256).alias("codebooks_sha256"))
    first = np.array([s for s in seeds if len(s) == width], dtype=np.int64)
    books = Codebooks(first.reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2))
    for number in range(ROUNDS):
        rows = staged(assigned(rows, books, again=number > 0), f"ball-codes-{number}")
        books = moved(rows, books)
    done = staged(assigned(rows, books, again=True, last=True), "ball-codes")
    labels = done.groupBy("label").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error")).withColumnRenamed("label", "_of")
    digest = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    return done.join(labels, F.col("label").eqNullSafe(F.col("_of"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
