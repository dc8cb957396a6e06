"""Benchmark decontamination by SimHash windows of item size.

Words are compared without case and without the punctuation at their edges, on both
sides: texts are case-folded, then every word loses the punctuation around it unless
nothing else is in it. The number of words stays the same, so equal words stay equal
and no copy gets less similar.

Benchmark items are a stated query set. The windows of an item follow its size:
their length is the largest of a geometric grid not above half its words (eight at
least, or all of a shorter item, and 36 at most) nor above ``unbroken``, and each window of the item gives one 64-bit
SimHash of its words (a word counts as often as it occurs). Every window of each of
these lengths of every document is fingerprinted in the same way, from sums that
slide by a word. Four 16-bit blocks index the item fingerprints: two fingerprints
at a Hamming distance of at most three agree in one block at least, so the index
misses none within that radius.

A window within the radius is a seed. Every item-sized window of the document that
holds the seed is compared with the item, wherever the seed stands in the item: the
exact weighted Jaccard similarity of their five-word shingle multisets must reach
0.8. At a text's edges a window is as long as the text allows.

So many shared shingles leave the item's words in few parts: a place where words are
put in, left out or change their order costs four of its shingles, an altered word
five. ``unbroken`` is the least length of the longest part; a window in it has
distance zero, so the copy is found, also with its parts in another order. This
counts four-word runs as distinct; passages that repeat such runs could leave
shorter parts.

Items go to the tasks in blocks of at most ``BLOCK_BYTES`` of text (a longer item
is a block of its own), so what is broadcast does not grow with the benchmark;
each block is one more pass through the rows of a partition. Documents are
never shuffled or joined, so a passage that a third of them holds is no hot key.

Null and word-free documents and items match nothing. An item of one to four
words has one shingle. Equal items are all reported; an item without an id marks
a document and is left out of the list of ids. Repeated documents each get their
result, texts of any length are read whole, and an empty table of items matches
nothing. Columns added to the caller's take other names where they would clash.
"""

from __future__ import annotations

import math
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, staged
from .texts import SHINGLE_WORDS, Texts, slices

THRESHOLD = 0.8
RADIUS = 3
BLOCKS = RADIUS + 1
BLOCK_BITS = 64 // BLOCKS
GRID = 1.2
LEAST = 8
MOST = 36
BLOCK_BYTES = 4 << 20
# Few enough words that the sums of a slice stay in a core's cache.
WINDOW_SLICE = 1 << 17
PASSES_PER_STAGE = 4


_PUNCTUATION = np.array([unicodedata.category(chr(c))[0] == "P" or chr(c) in string.punctuation for c in range(1 << 16)])


def folded(texts: Texts) -> Texts:
    """The texts case-folded, with words that have no punctuation at their edges."""
    parts = [texts.text(i).decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape") for i in range(texts.count)]
    out = Texts(np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([0, *map(len, parts)]))
    data = out.data
    edge = _PUNCTUATION[data] & (data < 0x80)
    padded = np.concatenate((data, np.zeros(2, dtype=np.uint8))).astype(np.int64)
    for length, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F)):
        lead = np.flatnonzero((data >= low) & (data < high))
        code = padded[lead] & bits
        for k in range(1, length):
            code = code << 6 | padded[lead + k] & 0x3F
        lead = lead[_PUNCTUATION[code] & (lead + length <= len(data))]
        for k in range(length):
            edge[lead + k] = True
    starts, ends, at = out.words()
    solid = np.append(np.flatnonzero(~edge), len(data))
    begins = solid[np.searchsorted(solid, starts)]
    inner = begins < ends  # not punctuation only
    finishes = solid[np.searchsorted(solid, ends) - 1] + 1
    out._words = np.where(inner, begins, starts), np.where(inner, finishes, ends), at
    return out


def class_length(words: int) -> int:
    """Largest length of the grid 1, 2, ... 5, 6, 8, 9, 11, ... not above ``words``."""
    length = 1
    while (longer := max(length + 1, int(length * GRID))) <= words:
        length = longer
    return length


def unbroken(words: int, threshold: float) -> int:
    """Least length of the longest part that an item of ``words`` words keeps in a copy that reaches ``threshold``."""
    shingles = max(1, words - SHINGLE_WORDS + 1)
    lost = shingles - math.ceil(shingles * 2 * threshold / (1 + threshold) - 1e-9)
    breaks, trimmed = divmod(lost, SHINGLE_WORDS - 1)
    return max(1, -(-(words - trimmed) // (breaks + 1)))


def running(hashes: np.ndarray) -> np.ndarray:
    """Running sums over the words of the +1/-1 vectors that their hash bits give."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    sums = np.zeros((len(hashes) + 1, 64), dtype=np.int16)
    # Sixteen bits may overflow along a long text; differences over a window do not.
    np.cumsum(bits.view(np.int8) * np.int8(2) - np.int8(1), axis=0, dtype=np.int16, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, length: int) -> np.ndarray:
    """SimHash of every window of ``length`` words."""
    signs = (sums[length:] - sums[:-length]) > 0
    return np.packbits(signs.reshape(-1), bitorder="little").view("<u8")


def multiset(hashes: np.ndarray) -> Counter:
    words = hashes.tolist()
    return Counter(tuple(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / max(1, a.total() + b.total() - shared)


def holds(hashes: np.ndarray, low: int, high: int, first: int, last: int, words: int, item: Counter, threshold: float) -> bool:
    """Whether a window of ``words`` words that starts from ``first`` to ``last``, cut to [low, high), reaches ``threshold``."""
    least, most = max(first, low), min(last + words, high)
    if words < SHINGLE_WORDS:
        return any(similarity(multiset(hashes[max(k, low) : min(k + words, high)]), item) >= threshold for k in range(first, last + 1))
    region = hashes[least:most].tolist()
    grams = [tuple(region[k : k + SHINGLE_WORDS]) for k in range(len(region) - SHINGLE_WORDS + 1)]
    total, shared, seen = item.total(), 0, Counter()
    left = right = 0
    for start in range(first, last + 1):
        begin, end = max(start, low) - least, min(start + words, high) - least - SHINGLE_WORDS + 1
        if end <= begin:
            continue
        for gram in grams[right:end]:
            shared += seen[gram] < item[gram]
            seen[gram] += 1
        right = end
        for gram in grams[left:begin]:
            seen[gram] -= 1
            shared -= seen[gram] < item[gram]
        left = begin
        if shared / max(1, total + right - left - shared) >= threshold:
            return True
    return False


def _runs(places: list[int], back: int) -> Iterator[tuple[int, int]]:
    """Runs of starts that lie at most ``back`` before one of the ascending places."""
    first, last = places[0] - back, places[0]
    for place in places[1:]:
        if place - back > last + 1:
            yield first, last
            first = place - back
        last = place
    yield first, last


class Index:
    """Item fingerprints of one block of items, by class length."""

    def __init__(self, items: list[tuple[int | None, bytes]], threshold: float = THRESHOLD):
        self.ids = [i for i, _ in items]
        raw = np.frombuffer(b"".join(t for _, t in items), dtype=np.uint8)
        texts = folded(Texts(raw, np.cumsum([0, *(len(t) for _, t in items)])))
        hashes, (_, _, at) = texts.word_hashes(), texts.words()
        self.words = [hashes[at[i] : at[i + 1]] for i in range(len(items))]
        self.shingles = [multiset(w) for w in self.words]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, own in enumerate(self.words):
            if len(own):
                length = class_length(min(max(len(own) // 2, min(len(own), LEAST)), MOST, unbroken(len(own), threshold)))
                prints = fingerprints(running(own), length)
                found.setdefault(length, []).append((prints, np.full(len(prints), i), np.arange(len(prints))))
        self.classes = {}
        for length, parts in found.items():
            prints, item, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            blocks = []
            for b in range(BLOCKS):
                value = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(2**BLOCK_BITS - 1)).astype(np.int64)
                order = np.argsort(value, kind="stable")
                starts = np.searchsorted(value[order], np.arange(2**BLOCK_BITS + 1))
                blocks.append((order, starts, np.diff(starts) > 0))
            self.classes[length] = prints, item, offset, blocks

    def near(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item fingerprint) pairs within the radius."""
        known, _, _, blocks = self.classes[length]
        windows, matches = [], []
        parts = prints.view("<u2").reshape(-1, BLOCKS)
        for b, (order, starts, used) in enumerate(blocks):
            value = parts[:, b]
            hit = np.flatnonzero(used[value])
            if not len(hit):
                continue
            low = starts[value[hit]]
            amount = starts[value[hit].astype(np.int64) + 1] - low
            window = np.repeat(hit, amount)
            entry = order[np.repeat(low, amount) + np.arange(amount.sum()) - np.repeat(np.cumsum(amount) - amount, amount)]
            close = np.bitwise_count(prints[window] ^ known[entry]) <= RADIUS
            windows.append(window[close])
            matches.append(entry[close])
        if not windows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(windows), np.concatenate(matches)

    def search(self, texts: Texts, threshold: float) -> list[set[int]]:
        """Positions of the items that each text contains."""
        out: list[set[int]] = [set() for _ in range(texts.count)]
        texts = folded(texts)
        hashes, (_, _, at) = texts.word_hashes(), texts.words()
        if not len(hashes):
            return out
        sums = running(hashes)
        owner = np.repeat(np.arange(texts.count), np.diff(at))
        for length, (_, item, offset, _) in self.classes.items():
            if length > len(hashes):
                continue
            window, entry = self.near(fingerprints(sums, length), length)
            inside = owner[window] == owner[window + length - 1]
            seeds: dict[tuple[int, int], list[int]] = {}
            tried = set()
            for w, e in zip(window[inside].tolist(), entry[inside].tolist(), strict=True):
                doc, i = int(owner[w]), int(item[e])
                start = w - int(offset[e])
                if i in out[doc]:
                    continue
                seeds.setdefault((doc, i), []).append(w)
                if (i, start) in tried:
                    continue
                tried.add((i, start))
                # Most copies are in order: the window that lines up with the item comes first.
                lo, hi = max(start, int(at[doc])), min(start + len(self.words[i]), int(at[doc + 1]))
                if similarity(multiset(hashes[lo:hi]), self.shingles[i]) >= threshold:
                    out[doc].add(i)
            for (doc, i), places in seeds.items():
                if i in out[doc]:
                    continue
                words = len(self.words[i])
                for first, last in _runs(sorted(set(places)), words - length):
                    if holds(hashes, int(at[doc]), int(at[doc + 1]), first, last, words, self.shingles[i], threshold):
                        out[doc].add(i)
                        break
        return out


def item_blocks(items: DataFrame, id: str, text: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in blocks of at most ``most`` bytes; one block at a time is on the driver."""
    block, size = [], 0
    for row in items.select(F.col(id).cast("long"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        raw = row[1].encode()
        if block and size + len(raw) > most:
            yield block
            block, size = [], 0
        block.append((row[0], raw))
        size += len(raw)
    if block:
        yield block


def _search(docs: DataFrame, index, text: str, items: str, marked: str, threshold: float) -> DataFrame:
    names = [f.name for f in docs.schema.fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        for batch in batches:
            for part, texts in slices(batch, text, WINDOW_SLICE):
                found = known.search(texts, threshold)
                before = part.column(names.index(items)).to_pylist()
                lists = [
                    sorted({*(old or ()), *(known.ids[i] for i in new if known.ids[i] is not None)})
                    for old, new in zip(before, found, strict=True)
                ]
                hit = [bool(old) or bool(new) for old, new in zip(part.column(names.index(marked)).to_pylist(), found, strict=True)]
                columns = dict(zip(names, part.columns, strict=True))
                columns[items], columns[marked] = pa.array(lists, pa.list_(pa.int64())), pa.array(hit, pa.bool_())
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(apply, docs.schema)


def _marked(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, threshold: float, drop: bool):
    listed, marked = fresh(docs, "item_ids"), fresh(docs, "contaminated")
    nothing = F.array().cast(T.ArrayType(T.LongType()))
    rows = docs.withColumns({listed: F.when(F.lit(True), nothing), marked: F.lit(False)})
    rows = rows.to(T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]))
    context = docs.sparkSession.sparkContext
    for number, block in enumerate(item_blocks(items, item_id, item_text), 1):
        rows = _search(rows, context.broadcast(Index(block, threshold)), text, listed, marked, threshold)
        if drop:
            rows = rows.where(~F.col(marked))
        if number % PASSES_PER_STAGE == 0:
            rows = staged(rows, "decontam-pass")
    return rows, listed, marked


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, item_ids (ascending)."""
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    rows, listed, marked = _marked(narrow, items, "text", item_id, item_text, threshold, drop=False)
    return rows.select("doc_id", F.col(marked).alias("contaminated"), F.col(listed).alias("item_ids"))


def uncontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""
    rows, _, _ = _marked(docs, items, text, item_id, item_text, threshold, drop=True)
    return rows.select(*docs.columns)
