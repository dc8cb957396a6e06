"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of many texts lie one after the other in one array of symbol ids.
In each round the rank of every adjacent pair is looked up, each pre-token finds
its lowest rank, and all pre-tokens apply their lowest-rank pair at once, at every
place where it does not overlap itself, from the left. Merging a pair can only
create pairs of higher rank, so this equals merging one place at a time. A
pre-token without a mergeable pair is finished; the symbols left are its tokens.

Counts are kept per chunk between ASCII white space, which the file's pattern
drops and never joins across, so a frequent word is merged once per worker.
Normalising and cutting into pre-tokens are the library's own. Special strings
count as one token each, as the library takes them by default. A null text has no
bytes and no tokens. Texts of any length are counted whole, and repeated rows each get
their row. Other columns aren't read, so their names can't clash, and an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import slices
from .vocabulary import LONG, Coded, Vocabulary, byte_symbols, library, place, plain_parts, vocabulary

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
_NONE = np.int64(2**62)


class Merges:
    """Merge ranks as sorted arrays."""

    def __init__(self, words: Vocabulary):
        first: dict[int, tuple[int, int]] = {}
        for r, (a, b, c) in enumerate(words.merges):
            first.setdefault(a << 32 | b, (r, c))
        self.keys = np.array(sorted(first), dtype=np.int64)
        found = [first[k] for k in self.keys.tolist()]
        self.ranks = np.array([r for r, _ in found], dtype=np.int64)
        self.results = np.array([c for _, c in found], dtype=np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; rank ``_NONE`` if the merges have no such pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
        return (np.where(known, self.ranks[at], _NONE), self.results[at]) if len(self.keys) else (np.full(len(key), _NONE), key)

    def reduce(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each sequence once no pair can be merged, and how many they are."""
        final = sizes.copy()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        owner = np.repeat(np.arange(len(sizes)), sizes)
        while len(symbols):
            rank, result = self.look_up(symbols[:-1], symbols[1:])
            rank = np.append(np.where(owner[:-1] == owner[1:], rank, _NONE), _NONE)
            result = np.append(result, 0)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            over = least == _NONE
            if over.any():
                gone = np.repeat(over, counts)
                done.append((owner[gone], symbols[gone]))
                stay = ~gone
                symbols, owner, rank, result = symbols[stay], owner[stay], rank[stay], result[stay]
                least, counts = least[~over], counts[~over]
                if not len(symbols):
                    break
            take = rank == np.repeat(least, counts)
            # A run of takes is a pair that overlaps itself: every other one applies.
            place = np.arange(len(take))
            begin = np.maximum.accumulate(np.where(take & ~np.append(False, take[:-1]), place, 0))
            take &= (place - begin) % 2 == 0
            symbols = np.where(take, result, symbols)
            keep = ~np.append(False, take[:-1])
            symbols, owner = symbols[keep], owner[keep]
        if done:
            owners, left = (np.concatenate(x) for x in zip(*done, strict=True))
            order = np.argsort(owners, kind="stable")
            final = np.bincount(owners, minlength=len(sizes))
            return left[order], final
        return symbols, final


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str):
        words = vocabulary(path)
        tool = library(path)
        self.vocabulary, self.merges = words, Merges(words)
        self.normal = tool.normalizer.normalize_str if tool.normalizer else (lambda x: x)
        self.cut = tool.pre_tokenizer.pre_tokenize_str
        self.pieces: dict[str, int] = {}
        self.symbols = symbols = byte_symbols()
        # Whether plain chunks may be cut here: this holds for files that lower case.
        self.lower = bool(tool.normalizer) and words.suffix != ""
        self.inner = {s: words.ids[s] for s in symbols if s in words.ids}
        self.final = {s: words.ids[s + words.suffix] for s in symbols if s + words.suffix in words.ids}
        self.chunks = Coded(self._solve)

    def _solve(self, chunks: list[bytes]) -> list[tuple[int]]:
        counts = np.zeros(len(chunks), dtype=np.int64)
        pieces: dict[str, int] = {}
        used: list[int] = []
        owners: list[int] = []
        for i, chunk in enumerate(chunks):
            text = chunk.decode("utf-8", "replace")
            plain = self.lower and plain_parts(text)
            if plain:
                word, tail = plain[1].lower(), plain[2]
                cut = [word if word.isascii() else "".join([self.symbols[b] for b in word.encode()])]
                if tail:
                    cut.append(tail)
                for piece in cut:
                    used.append(pieces.setdefault(piece, len(pieces)))
                    owners.append(i)
                continue
            for part, special in self.vocabulary.parts(text):
                if special is not None:
                    counts[i] += 1
                    continue
                for piece, _ in self.cut(self.normal(part)):
                    used.append(pieces.setdefault(piece, len(pieces)))
                    owners.append(i)
        # What earlier batches have merged is kept; the rest is merged at once.
        new = [p for p in pieces if p not in self.pieces]
        symbols: list[int] = []
        sizes = np.zeros(len(new), dtype=np.int64)
        for k, piece in enumerate(new):
            row = [self.inner[s] for s in piece[:-1] if s in self.inner]
            if piece and piece[-1] in self.final:
                row.append(self.final[piece[-1]])
            symbols.extend(row)
            sizes[k] = len(row)
        _, merged = self.merges.reduce(np.array(symbols, dtype=np.int64), sizes)
        fresh = dict(zip(new, merged.tolist()))
        if used:
            left = np.array([self.pieces.get(p) if p in self.pieces else fresh[p] for p in pieces], dtype=np.int64)
            counts += np.bincount(owners, weights=left[used], minlength=len(chunks)).astype(np.int64)
        if len(self.pieces) > Coded.MOST:
            self.pieces.clear()
        self.pieces.update((p, n) for p, n in fresh.items() if len(p) <= LONG)
        return [(c,) for c in counts.tolist()]

    def count(self, texts: list[bytes]) -> np.ndarray:
        chunks: list[bytes] = []
        ends = [0]
        for text in texts:
            chunks.extend(text.split())
            ends.append(len(chunks))
        per_chunk = self.chunks.gather(self.chunks.look_up(chunks))
        return np.diff(np.concatenate(([0], np.cumsum(per_chunk)))[ends])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def counts(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([
        narrow.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(place(tokenizer)).count
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = count([texts.text(i) for i in range(texts.count)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(texts.offsets), pa.int64()), pa.array(found, pa.int64()), pa.array(found > limit, pa.bool_())],
                    names=schema.names,
                )

    return narrow.mapInArrow(apply, schema)
