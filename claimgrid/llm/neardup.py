"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A text is the multiset of its five-word shingles; texts are linked if their
weighted Jaccard similarity (sum of minima over sum of maxima of the counts) is
0.8 or more, and a class is a connected component of links.

*Signature.* Every shingle carries Poisson processes over its discretised weight
axis: one on [0, 1) and one on each [2^k, 2^(k+1)), each with a rate equal to its
width. A text sees the points below its weight; a point in a piece that the
weight cuts belongs to a uniformly chosen cell of the piece, which is halving the
piece until the point's side is settled. Each point falls on one of ``SIZE``
places, and a place keeps its earliest point. Texts share a place with
probability equal to their weighted Jaccard similarity. Points come in order, so
a process stops once it is later than every place of its text.

*Bands.* ``BANDS`` bands of ``ROWS`` places: a pair at similarity 0.8 meets in
some band with probability 1 - 3e-6, and more alike pairs miss far less often.

*Verification without all pairs.* Texts with equal multisets become one node.
In every bucket all nodes are verified against its most central one (the one
whose buckets are largest, which in a group of copies is close to the original).
What is left to prove is that nodes of different components that meet in a bucket
are not linked. These open nodes order their elements by rarity. If two of them
reach the threshold, then the first element they share stands so early in both
orders that enough can follow it (the prefix and positional filters of exact
set joins). A far copy begins with elements of its own, so hardly a pair passes,
and those that do are verified. No link among open nodes is left out.

Null and word-free texts are copies only of rows with the same id. A text of one
to four words is one shingle. Rows with equal id and text are copies. All ids may
be null or repeated; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import fresh, staged
from .texts import Texts, mix, slices

THRESHOLD = 0.8
BANDS = 32
ROWS = 5
SIZE = BANDS * ROWS

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xD1B54A32D192ED03)
_CELL = np.uint64(0x8CB92BA72F3D8DD7)


def multisets(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per text: owner, shingle, count, and shingle totals per text."""
    shingles, offsets = texts.shingles()
    owner = np.repeat(np.arange(texts.count), np.diff(offsets))
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(shingles)))
    return owner[at], shingles[at], count, np.diff(offsets)


def pieces(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Dyadic pieces of the weight axes: owner, key, width, and cells below the weight."""
    parts = [(owner, mix(shingle), np.ones(len(owner)), np.ones(len(owner), dtype=np.int64))]
    low = 1
    while True:
        more = count > low
        if not more.any():
            break
        owner, shingle, count = owner[more], shingle[more], count[more]
        key = mix(shingle + np.uint64(low * int(_CELL) % 2**64))
        parts.append((owner, key, np.full(len(owner), float(low)), np.minimum(count - low, low)))
        low *= 2
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def signatures(texts: int, owner: np.ndarray, key: np.ndarray, width: np.ndarray, cells: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Earliest point of every place of every text (as float bits), shape (texts, size)."""
    times = np.full(texts * size, np.inf)
    last = np.zeros(len(owner))
    done, block = 0, 2
    while len(owner):
        rank = np.arange(done + 1, done + block + 1, dtype=np.uint64)
        state = mix(key[:, None] + rank * _STEP)
        gap = -np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0**-53) / width[:, None]
        point = last[:, None] + np.cumsum(gap, axis=1)
        spot = mix(state + _PLACE)
        place = ((spot >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        inside = (mix(spot + _CELL) % width.astype(np.uint64)[:, None]).astype(np.int64) < cells[:, None]
        flat = owner[:, None] * size + place.astype(np.int64)
        np.minimum.at(times, flat[inside], point[inside])
        last = point[:, -1]
        live = last <= times.reshape(texts, size).max(axis=1)[owner]
        owner, key, width, cells, last = owner[live], key[live], width[live], cells[live], last[live]
        done += block
        block = min(block * 2, max(2, (1 << 20) // max(1, len(owner))))
    return times.reshape(texts, size).view(np.uint64)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = signature.shape[1] // rows
    keys = np.arange(1, bands + 1, dtype=np.uint64) * _PLACE + np.zeros((len(signature), 1), dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * _STEP + signature[:, r::rows][:, :bands])
    return keys


def sketch(texts: Texts) -> dict[str, pa.Array]:
    owner, shingle, count, total = multisets(texts)
    keys = band_keys(signatures(texts.count, *pieces(owner, shingle, count))).astype(np.int64)

    def digest(salt: np.uint64) -> np.ndarray:
        summed = np.concatenate(([np.uint64(0)], np.cumsum(mix(mix(shingle + salt) + count.astype(np.uint64)))))
        at = np.searchsorted(owner, np.arange(texts.count + 1))
        return (summed[at[1:]] - summed[at[:-1]]).astype(np.int64)

    bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
    return {"n": pa.array(total), "hi": pa.array(digest(_PLACE)), "lo": pa.array(digest(_CELL)), "bands": bands}


def elements(texts: Texts) -> pa.Array:
    """Each multiset as a set: a shingle's n-th occurrence is an element of its own."""
    owner, shingle, count, _ = multisets(texts)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    values = mix(np.repeat(shingle, count) + nth.astype(np.uint64) * _STEP).astype(np.int64)
    at = np.searchsorted(np.repeat(owner, count), np.arange(texts.count + 1))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))


def _map(df: DataFrame, text: str, fields: list[T.StructField], make) -> DataFrame:
    """``df`` with its text replaced by the columns that ``make`` derives from it."""
    rest = [f for f in df.schema.fields if f.name != text]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                made = make(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(f.name)) for f in rest), *(made[f.name] for f in fields)],
                    names=[f.name for f in (*rest, *fields)],
                )

    return df.mapInArrow(apply, T.StructType([*rest, *fields]))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose exact weighted Jaccard similarity reaches the threshold."""
    a = sets.select(F.col("rep").alias("a"), F.col("elements").alias("of_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("elements").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
        .select("a", "b").join(b, "b").join(a, "a")
        .where(shared >= F.lit(threshold) * (F.size("of_a") + F.size("of_b") - shared) - 1e-9)
        .select("a", "b")
    )


# Rows of one key from which they are dealt over salts, and the number of these.
HOT, SALTS = 256, 64


def _identity(id: str, text: str) -> list[Column]:
    return [F.col(id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h")]


def _met(rows: DataFrame, facts: DataFrame, key: list[str], count: str) -> DataFrame:
    """``rows`` joined to the one row of ``facts`` with their key; ``count`` is how many rows a key has.

    Keys of more than ``HOT`` rows are repeated under ``SALTS`` salts, and their rows are
    dealt over these by place, so no task gets a whole hot key; all other rows meet
    their facts as usual.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    hot = facts.where(F.col(count) > HOT).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    many = dealt.join(hot, [*key, "_salt"]).drop("_salt")
    few = dealt.join(hot.select(*key, "_salt"), [*key, "_salt"], "left_anti").drop("_salt")
    return many.unionByName(few.join(facts.where(F.col(count) <= HOT), key))


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, h (hash of the text), class_id, kept, class_size.

    ``class_id`` is the least id of the class; ``kept`` is true for one row of it,
    which has that id. Ids must be integers.
    """
    source = docs.select(*_identity(id, text), F.col(text).alias("text"))
    long, bands = T.LongType(), T.ArrayType(T.LongType())
    fields = [T.StructField("n", long), T.StructField("hi", long), T.StructField("lo", long), T.StructField("bands", bands)]
    rows = staged(
        _map(source, "text", fields, sketch)
        .withColumn("alone", F.when(F.col("n") == 0, F.coalesce("doc_id", F.lit(-1))).otherwise(0))
        .withColumn("row", F.monotonically_increasing_id()),
        "neardup-sketches",
    )
    same = ["hi", "lo", "n", "alone"]
    reps = staged(rows.groupBy(*same).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")), "neardup-reps")
    nodes = rows.join(reps.select(F.col("rep").alias("row")), "row").where("n > 0")
    entries = nodes.select(F.col("row").alias("rep"), "n", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = staged(entries.join(buckets, "key"), "neardup-members")

    central = members.groupBy("rep", "n").agg(F.sum("members").alias("weight"))
    central = staged(central, "neardup-candidates")
    weighed = members.select("key", "rep").join(central, "rep")
    heaviest = weighed.groupBy("key").agg(F.max("weight").alias("weight"))
    leaders = weighed.join(heaviest, ["key", "weight"]).groupBy("key").agg(F.min("rep").alias("leader"))
    led = staged(
        weighed.select("key", "rep", "n").join(leaders, "key").select("key", "rep", "n", "leader"), "neardup-led"
    )
    stars = (
        led.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"), F.col("n").alias("n_b")).distinct()
        .join(central.select(F.col("rep").alias("a"), F.col("n").alias("n_a")), "a")
    )

    wanted = nodes.select("doc_id", "h", F.col("row").alias("rep")).join(central.select("rep"), "rep")
    texts = source.join(
        wanted.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "rep"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")),
    ).select("rep", "text").dropDuplicates(["rep"])
    sets = staged(
        _map(texts, "text", [T.StructField("elements", bands)], lambda t: {"elements": elements(t)}), "neardup-sets"
    )
    first = staged(_similar(stars, sets, threshold), "neardup-links")
    roots = staged(components(first, name="neardup-first"), "neardup-roots")

    placed = led.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = placed.join(mixed, "key").select("rep", "n", "root").distinct()
    elements_of = staged(
        sets.join(open_, "rep").select("rep", "n", "root", F.explode("elements").alias("element")), "neardup-open"
    )
    held = elements_of.groupBy("element").agg(
        F.count(F.lit(1)).alias("holders"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    # A node's own elements in order of rarity; a window never holds more than one text.
    rarest = Window.partitionBy("rep").orderBy("holders", "element")
    prefix = staged(
        elements_of.join(held, "element").withColumn("place", F.row_number().over(rarest))
        .where((F.col("low") < F.col("high")) & (F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1))
        .select("element", "rep", "n", "root", "place"),
        "neardup-prefixes",
    )
    left, right = (
        prefix.select(F.col("element").alias(f"element_{x}"), F.col("rep").alias(x), F.col("n").alias(f"n_{x}"),
                      F.col("root").alias(f"root_{x}"), F.col("place").alias(f"place_{x}"))
        for x in ("a", "b")
    )
    most = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    rest = (
        left.join(
            right,
            (F.col("element_a") == F.col("element_b")) & (F.col("root_a") < F.col("root_b"))
            & (most * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9),
        )
        .select("a", "b", "n_a", "n_b").distinct()
    )
    second = _similar(rest, sets, threshold)
    links = staged(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(second), "neardup-all")
    found = components(links, name="neardup-classes")

    # Copies meet their representative, and rows their class, in many tasks where these are many.
    held_by = _met(rows.select("row", "doc_id", "h", *same), reps, same, "copies")
    rooted = reps.select("rep", "copies").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    classed = _met(held_by.drop("copies"), rooted, ["rep"], "copies")
    keyed = staged(classed.select("row", "doc_id", "h", F.coalesce("root", "rep").alias("root")), "neardup-keyed")
    summary = keyed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    named = _met(keyed, staged(summary, "neardup-sizes"), ["root"], "class_size")
    first_row = named.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("row").alias("row"))
    return named.join(first_row.select("row", F.lit(True).alias("kept")), "row", "left").select(
        "doc_id", "h", "class_id", F.coalesce("kept", F.lit(False)).alias("kept"), "class_size"
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without all but one of each class, with their columns."""
    ids, hashes, h = fresh(docs, "_kept_id"), fresh(docs, "_kept_h"), fresh(docs, "_text_hash")
    kept = classes(docs, id, text, threshold).where("kept").select(F.col("doc_id").alias(ids), F.col("h").alias(hashes))
    return (
        docs.withColumn(h, F.xxhash64(text))
        .join(kept, F.col(id).cast("long").eqNullSafe(F.col(ids)) & (F.col(h) == F.col(hashes)), "left_semi")
        .dropDuplicates([id, h])
        .select(*docs.columns)
    )
