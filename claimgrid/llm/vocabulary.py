"""What the tokenizer operators read from a public tokenizer file, and how they cut texts."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Characters that the file's patterns take for white space (\s).
WIDE_SPACES = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "\t-\r " + WIDE_SPACES
_WIDE_SPACE = re.compile(f"[{WIDE_SPACES}]")
_PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_BEFORE_SPACE = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")


def place(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [], 256
    for byte in range(256):
        if byte in prints:
            out.append(chr(byte))
        else:
            out.append(chr(free))
            free += 1
    return out


class Vocabulary:
    """Ids, merges by rank and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges]
        self.longest = max([1, *(len((a + b).removesuffix(self.suffix)) for a, b in merges)])
        self.special: dict[str, int] = {}
        for token in content.get("added_tokens") or []:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError(f"unsupported kind of added token: {token['content']}")
            self.special[token["content"]] = token["id"]
        names = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, names))) if names else None
        self.size = max([*self.ids.values(), *self.special.values()]) + 1

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """Stretches of ordinary text, and special strings with their ids, as the library's default takes them."""
        if not self.special_pattern or not any(s in text for s in self.special):
            return [(text, None)]
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            if m.start() > at:
                out.append((text[at : m.start()], None))
            out.append((m.group(), self.special[m.group()]))
            at = m.end()
        if at < len(text):
            out.append((text[at:], None))
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def spaced_chunks(text: str) -> list[str]:
    """Cut before white space, so that white space begins a chunk; byte-level pieces never cross such a cut."""
    wide = not text.isascii() and _WIDE_SPACE.search(text)
    if wide or any(s in text for s in _BEFORE_SPACE):
        return _PIECE.findall(text)
    first, *rest = text.split(" ")
    return [*([first] if first else []), *[" " + r for r in rest]]


class _Codes(dict):
    """Chunks to row numbers; an unknown chunk gets the next one and is noted."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, chunk) -> int:
        self[chunk] = row = len(self)
        self.new.append(chunk)
        return row


class Coded:
    """Results for chunks, kept up to a number of chunks; a result is a row of a ragged array.

    ``solve`` gets a list of new chunks and returns one sequence of ids for each, or
    a pair of arrays: how many ids each chunk has, and all ids one after the other.
    Once more than ``most`` chunks or sixteen times as many ids are kept, all are
    forgotten before the next batch, so the store is bounded by that and a batch.
    """

    MOST = 400_000

    def __init__(self, solve: Callable[[list], list | tuple[np.ndarray, np.ndarray]], most: int = MOST):
        self.solve, self.most = solve, most
        self._clear()

    def __contains__(self, chunk) -> bool:
        return chunk in self.codes

    def _clear(self) -> None:
        self.codes = _Codes()
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.sizes = np.zeros(1 << 12, dtype=np.int32)
        self.values = np.zeros(1 << 14, dtype=np.int32)
        self.rows = self.filled = 0

    @staticmethod
    def _room(array: np.ndarray, need: int) -> np.ndarray:
        return array if need <= len(array) else np.concatenate((array, np.zeros(max(need, 2 * len(array)) - len(array), dtype=array.dtype)))

    def look_up(self, chunks: list) -> np.ndarray:
        """Row numbers of the chunks; valid until the next call."""
        if self.rows > self.most or self.filled > 16 * self.most:
            self._clear()
        codes = self.codes
        out = np.fromiter(map(codes.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        new, codes.new = codes.new, []
        if new:
            results = self.solve(new)
            if isinstance(results, tuple):
                sizes, values = results
                total = len(values)
            else:
                sizes = np.fromiter(map(len, results), dtype=np.int64, count=len(new))
                total = int(sizes.sum())
                values = np.fromiter(chain.from_iterable(results), dtype=np.int32, count=total)
            rows = self.rows + len(new)
            self.starts, self.sizes = self._room(self.starts, rows), self._room(self.sizes, rows)
            self.values = self._room(self.values, self.filled + total)
            self.sizes[self.rows : rows] = sizes
            self.starts[self.rows : rows] = self.filled + np.cumsum(sizes) - sizes
            self.values[self.filled : self.filled + total] = values
            self.rows = rows
            self.filled += total
        return out

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """Values of the rows, one after the other."""
        sizes = self.sizes[rows].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        return self.values[np.repeat(self.starts[rows] - before, sizes) + np.arange(sizes.sum())]


# A chunk of letters, then ASCII punctuation without apostrophes: two stretches
# that the files' patterns never cut or join, and that only lower case changes.
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")
plain_parts = _PLAIN.fullmatch
# Longer pre-tokens are worked on where they occur and not kept.
LONG = 256
