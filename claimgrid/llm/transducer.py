"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

*Encoding.* The state after each symbol is the last token of the encoding of
the symbols so far. It is the one token that ends there, encodes to itself, and
follows the last token before it in the way the merges leave both alone; checking
neighbouring pairs is enough, because a token sequence is an encoding exactly if
each of its adjacent pairs is one. An automaton over all tokens names those that end
at each symbol; a pair is checked by undoing the merges along its border, from the
last made to the first. A later token starts at most as many symbols
back as the longest token of the merge list has: that length is the sufficient
lookahead. So whatever follows, the encoding continues from one of that many
states, and the tokens on which all of their backward chains agree are stable and
leave the transducer. What it holds is the lookahead and the symbols since the
chains parted, however long the stream is. Short pieces are streams that end within
one block; many of them go through the transducer side by side, a symbol of each at a time.

*Decoding.* Token bytes pass through an incremental UTF-8 state machine, so a
character that several tokens share comes out when it is complete; bytes that
can't continue become the replacement character.

Special strings in a text are single tokens, as the library takes them by default.
A null text is empty: no tokens, and the empty text again. Texts of any length are
encoded whole, and repeated rows each get their row. Other columns aren't read, so their
names can't clash, and an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import slices
from .vocabulary import LONG, Coded, Vocabulary, byte_symbols, library, place, spaced_chunks, vocabulary

TOKENIZER = "byte_bpe_50k.json"
PAIRS_KEPT = 500_000
PAIR_SLOTS = 18  # as a power of two
PIECES_KEPT = 100_000
CHUNKS_KEPT = 250_000
STRIDE = 256
# Pieces of at most so many symbols go side by side, at most so many at once.
SHORT = 64
ABREAST = 1 << 15
# The usual pattern of byte-level files, for text of ASCII and of these Latin letters.
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
LATIN_PIECES = re.compile(
    f"'(?:[sdmt]|ll|ve|re)| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
).findall
latin = re.compile(f"[\0-\x7f{_LATIN}]*").fullmatch
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) * _SPREAD >> np.uint64(64 - bits)).view(np.int64)


class Numbers:
    """A number for each of some distinct keys from 0 on, looked up for many keys at once; -1 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (3 * len(keys)).bit_length())
        self.last = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        at = _slots(keys, self.bits)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], at[~own] + 1 & self.last

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = _slots(keys, self.bits)
        there = self.keys[at]
        out = self.values[at]
        off = np.flatnonzero(there != keys)
        out[off] = -1
        off = off[there[off] >= 0]
        while len(off):
            at[off] = at[off] + 1 & self.last
            there = self.keys[at[off]]
            own = there == keys[off]
            out[off[own]] = self.values[at[off[own]]]
            off = off[~own & (there >= 0)]
        return out


class Transducer:
    """Encodes streams of byte symbols of one vocabulary."""

    def __init__(self, words: Vocabulary):
        self.vocabulary = words
        self.lookahead = words.longest
        self.rank = {(a, b): (r, c) for r, (a, b, c) in reversed(list(enumerate(words.merges)))}
        self.symbol = {s: words.ids[s] for s in byte_symbols() if s in words.ids}
        self.text = {i: s for s, i in words.ids.items()}
        self.pairs: dict[int, bool] = {}  # by both tokens in one number, which takes less room than a tuple
        # How the merges make each token that they make from its own text: the rank of
        # its last merge and that merge's sides; a symbol has rank -1.
        self.made: dict[int, tuple[int, int, int]] = {i: (-1, i, i) for i in self.symbol.values()}
        early = []
        for r, (a, b, c) in enumerate(words.merges):
            if a not in self.made or b not in self.made:
                early.append((a, b))
            elif c not in self.made and self._apart(a, b, r):
                self.made[c] = (r, a, b)
        if any(a in self.made and b in self.made for a, b in early):
            raise ValueError("a merge stands before those that make its sides")
        self.search = ahocorasick.Automaton()
        for token in self.made:
            self.search.add_word(self.text[token], (len(self.text[token]), token))
        self.search.make_automaton()
        self._tabulate()

    def _tabulate(self) -> None:
        """The same in arrays: the merges, the automaton, and what is known of pairs."""
        size = self.vocabulary.size
        pairs = np.array([(a, b, r) for (a, b), (r, _) in self.rank.items()], dtype=np.int64).reshape(-1, 3)
        self.merged = Numbers(pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2])
        self.sides = np.full((3, size), -1, dtype=np.int64)
        tokens = np.fromiter(self.made, dtype=np.int64, count=len(self.made))
        self.sides[:, tokens] = np.array(list(self.made.values()), dtype=np.int64).reshape(-1, 3).T
        self.pair_keys = np.full(1 << PAIR_SLOTS, -1, dtype=np.int64)
        self.pair_values = np.zeros(1 << PAIR_SLOTS, dtype=bool)

        self.bytes = np.full(1 << 16, -1, dtype=np.int16)
        self.bytes[[ord(s) for s in self.symbol]] = np.arange(len(self.symbol))
        names = [self.text[t] for t in tokens.tolist()]
        self.sizes = np.zeros(size, dtype=np.int64)
        self.sizes[tokens] = sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
        symbols = self._bytes(names).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        # States are numbered by depth; an edge's place among all edges gives the state it leads to.
        state = np.zeros(len(names), dtype=np.int64)
        levels, states = [], 1
        for depth in range(int(sizes.max(initial=0))):
            going = np.flatnonzero(sizes > depth)
            edges, into = np.unique(state[going] << 8 | symbols[starts[going] + depth], return_inverse=True)
            state[going] = states + into
            levels.append((states, edges))
            states += len(edges)
        every = np.concatenate([np.zeros(0, dtype=np.int64), *(e for _, e in levels)])
        self.edges = Numbers(every, np.arange(1, states))
        self.fall = np.full(states, -1, dtype=np.int64)  # the state of the longest proper end, -1 after none
        self.ending = np.full(states, -1, dtype=np.int64)  # the longest token that ends there
        self.ending[state] = tokens
        self.shorter = np.full(size, -1, dtype=np.int64)  # the next longest token that ends where a token does
        for first, edges in levels:
            here = np.arange(first, first + len(edges))
            self.fall[here] = fall = self._step(self.fall[edges >> 8], edges & 255)
            own = self.ending[here]
            self.shorter[own[own >= 0]] = self.ending[fall[own >= 0]]
            self.ending[here] = np.where(own < 0, self.ending[fall], own)

    def _bytes(self, texts: list[str]) -> np.ndarray:
        """The symbols of all texts, as numbers below 256."""
        return self.bytes[np.frombuffer("".join(texts).encode("utf-16-le", "surrogatepass"), dtype="<u2")]

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states of the automaton after a further symbol each; from -1 it goes to the first state."""
        out = np.zeros(len(state), dtype=np.int64)
        at = np.flatnonzero(state >= 0)
        state = state[at]
        while len(at):
            out[at] = found = self.edges(state << 8 | symbol[at])
            missed = np.flatnonzero(found < 0)
            at, state = at[missed], self.fall[state[missed]]
            out[at] = 0
            at, state = at[state >= 0], state[state >= 0]
        return out

    def _all_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_apart`` of many pairs, without a limit."""
        out = np.zeros(len(a), dtype=bool)
        at, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        ranks, left, right = self.sides
        while len(at):
            joined = self.merged(a << 32 | b)
            left_rank, right_rank = ranks[a], ranks[b]
            go = (joined < 0) | (joined >= limit)
            done = go & (left_rank < 0) & (right_rank < 0)
            out[at[done]] = True
            go &= ~done
            at, a, b, left_rank, right_rank = at[go], a[go], b[go], left_rank[go], right_rank[go]
            undo = left_rank > right_rank
            limit = np.where(undo, left_rank, right_rank + 1)
            a, b = np.where(undo, right[a], a), np.where(undo, b, left[b])
        return out

    def all_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``follows`` of many pairs; of those with one slot the last is remembered."""
        keys = a << 32 | b
        at = _slots(keys, PAIR_SLOTS)
        out = self.pair_values[at]
        new = np.flatnonzero(self.pair_keys[at] != keys)
        if len(new):
            out[new] = self._all_apart(a[new], b[new])
            self.pair_keys[at[new]] = keys[new]
            # Slots that several of them want belong to the key that is there now.
            own = new[self.pair_keys[at[new]] == keys[new]]
            self.pair_values[at[own]] = out[own]
        return out

    def _apart(self, a: int, b: int, limit: float) -> bool:
        """Whether no merge of a rank below ``limit`` joins ``a`` and ``b`` while they are made side by side.

        Merges are undone from the last to the first. What then meets at the border
        must not have a merge that would have come before the one just undone; of
        equal ranks the left place comes first.
        """
        rank, made = self.rank, self.made
        while True:
            joined = rank.get((a, b))
            if joined is not None and joined[0] < limit:
                return False
            (left_rank, _, inner), (right_rank, outer, _) = made[a], made[b]
            if left_rank > right_rank:
                limit, a = left_rank, inner
            elif right_rank >= 0:
                limit, b = right_rank + 1, outer
            else:
                return True

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` alone when they meet."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b, float("inf"))
        return known

    def _extend(self, found: Iterable[tuple[int, tuple[int, int]]], last: list[int], back: list[int], shift: int) -> None:
        """Go on with the tokens that end at further symbols, in order of ends; one of them is the last token there."""
        pairs, follows, held = self.pairs.get, self.follows, len(last)
        for at, (size, token) in found:
            if at + shift != held:
                continue
            start = held - size
            if start < 0:
                continue
            before = last[start]
            if before < 0 or (known := pairs(before << 32 | token)) or (known is None and follows(before, token)):
                last.append(token)
                back.append(start)
                held += 1

    def whole(self, symbols: str) -> list[int]:
        """Tokens of a short text that is there as a whole: one block of the stream."""
        last, back = [-1], [0]
        self._extend(self.search.iter(symbols), last, back, 1)
        if len(last) <= len(symbols):
            raise ValueError(f"symbols outside the vocabulary: {symbols!r}")
        return self._chain(last, back, len(symbols))

    def blocks(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each piece has, and the tokens of all pieces, one after the other."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        counts = np.zeros(len(pieces), dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        long = int(np.count_nonzero(lengths > SHORT))
        parts = []  # of the pieces in this order
        for i in order[:long].tolist():
            piece = pieces[i]
            ids = self.whole(piece) if len(piece) <= STRIDE else list(self.stream(piece))
            counts[i] = len(ids)
            parts.append(np.array(ids, dtype=np.int64))
        for at in range(long, len(pieces), ABREAST):
            some = order[at : at + ABREAST]
            counts[some], ids = self._abreast([pieces[i] for i in some.tolist()], lengths[some])
            parts.append(ids)
        values = np.concatenate([np.zeros(0, dtype=np.int64), *parts])
        sizes = counts[order]
        starts = np.empty(len(pieces), dtype=np.int64)
        starts[order] = np.cumsum(sizes) - sizes
        before = np.cumsum(counts) - counts
        return counts, values[np.repeat(starts - before, counts) + np.arange(len(values))]

    def _abreast(self, pieces: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of short pieces, the longest first; every round takes the next symbol of each."""
        symbols = self._bytes(pieces).astype(np.int64)
        if len(symbols) and symbols.min() < 0:
            raise ValueError("symbols outside the vocabulary")
        starts = np.cumsum(lengths) - lengths
        width = len(pieces)
        last = np.full((int(lengths.max(initial=0)) + 1, width), -1, dtype=np.int32)
        flat = last.reshape(-1)
        state = np.zeros(width, dtype=np.int64)
        for end in range(1, len(last)):
            going = int(np.searchsorted(-lengths, -end, side="right"))
            state = self._step(state[:going], symbols[starts[:going] + end - 1])
            here = np.arange(going)
            token = self.ending[state]
            while len(here):
                if token.min() < 0:
                    raise ValueError("symbols outside the vocabulary")
                before = flat[(end - self.sizes[token]) * width + here].astype(np.int64)
                good = before < 0
                check = np.flatnonzero(~good)
                good[check] = self.all_follow(before[check], token[check])
                last[end, here[good]] = token[good]
                here, token = here[~good], self.shorter[token[~good]]
        at, end, rounds = np.flatnonzero(lengths), lengths[lengths > 0], []
        counts = np.zeros(width, dtype=np.int64)
        while len(at):
            token = flat[end * width + at].astype(np.int64)
            rounds.append((at, token))
            counts[at] += 1
            end = end - self.sizes[token]
            at, end = at[end > 0], end[end > 0]
        out = np.empty(int(counts.sum()), dtype=np.int64)
        stops = np.cumsum(counts)
        for k, (at, token) in enumerate(rounds, 1):
            out[stops[at] - k] = token
        return counts, out

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Tokens of the symbols, each as soon as it is stable."""
        last, back = [-1], [0]  # after k held symbols: the last token, and where it starts
        taken = gone = 0  # symbols that have come, and those whose tokens have left
        found = self.search.iter("")
        symbols = iter(symbols)
        longest = self.lookahead
        while block := "".join(islice(symbols, STRIDE)):
            found.set(block, False)
            self._extend(found, last, back, 1 - gone)
            taken += len(block)
            end = len(last) - 1
            if end != taken - gone:
                raise ValueError(f"symbols outside the vocabulary: {block!r}")
            if len(block) == STRIDE and end > longest:
                common = end
                for state in range(end - 1, end - longest, -1):
                    while common != state:
                        if common > state:
                            common = back[common]
                        else:
                            state = back[state]
                    if not common:
                        break
                if common:
                    yield from self._chain(last, back, common)
                    # The token before the cut stays known: what follows must follow it.
                    last = last[common:]
                    back = [0, *(max(0, b - common) for b in back[common + 1 :])]
                    gone += common
        yield from self._chain(last, back, len(last) - 1)

    @staticmethod
    def _chain(last: list[int], back: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end = back[end]
        return out[::-1]


class Encoder:
    """Whole texts to ids: special strings, pieces of the file's pattern, and the transducer on each piece."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.split = library(path).pre_tokenizer.pre_tokenize_str
        self.transducer = Transducer(self.vocabulary)
        # Whether the pattern is the usual one for bytes, so Latin text may be cut here.
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        kind = json.loads(library(path).to_str())["pre_tokenizer"] or {}
        self.plain = usual.items() <= kind.items() and library(path).normalizer is None
        self.symbols = np.array([ord(s) for s in byte_symbols()], dtype="<u2")
        self.pieces = Coded(self.transducer.blocks, PIECES_KEPT)
        self.chunks = Coded(self._solve, CHUNKS_KEPT)

    def _in_symbols(self, pieces: list[str]) -> list[str]:
        """Pieces of text as symbols of their bytes."""
        data = np.frombuffer("".join(pieces).encode(), dtype=np.uint8)
        symbols = self.symbols[data].tobytes().decode("utf-16-le")
        places = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
        stops = places[np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))].tolist()
        return [symbols[a:b] for a, b in zip([0, *stops], stops)]

    def _cut(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of all chunks as symbols, one after the other, and their number in each chunk."""
        if self.plain:
            cuts = [LATIN_PIECES(c) if c.isascii() or latin(c) else None for c in chunks]
        else:
            cuts = [None] * len(chunks)
        own = self._in_symbols([p for c in cuts if c for p in c])
        if None in cuts:
            ready, own = iter(own), []
            for i, cut in enumerate(cuts):
                if cut is None:
                    cuts[i] = cut = [p for p, _ in self.split(chunks[i])]
                    own.extend(cut)
                else:
                    own.extend(islice(ready, len(cut)))
        return own, np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))

    def _solve(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and the ids of all chunks, one after the other."""
        pieces, numbers = self._cut(chunks)
        # A chunk of one piece is kept itself, so its piece need not be kept again.
        keep = np.repeat(numbers > 1, numbers)
        keep &= np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) <= LONG
        rows = self.pieces.look_up([p for p, k in zip(pieces, keep.tolist()) if k])
        counts, ids = self.transducer.blocks([p for p, k in zip(pieces, keep.tolist()) if not k])
        sizes = np.empty(len(pieces), dtype=np.int64)
        sizes[keep], sizes[~keep] = self.pieces.sizes[rows], counts
        at = np.concatenate(([0], np.cumsum(sizes)))
        kept = np.repeat(keep, sizes)
        values = np.empty(at[-1], dtype=np.int64)
        values[kept], values[~kept] = self.pieces.gather(rows), ids
        stops = np.cumsum(numbers)
        return at[stops] - at[stops - numbers], values

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        chunks, cuts = [], []  # a special string is a cut between chunks
        ends = []
        for text in texts:
            for part, special in self.vocabulary.parts(text):
                if special is None:
                    chunks.extend(spaced_chunks(part))
                else:
                    cuts.append((len(chunks), special))
            ends.append((len(chunks), len(cuts)))
        rows = self.chunks.look_up(chunks)
        ids = self.chunks.gather(rows)
        at = np.concatenate(([0], np.cumsum(self.chunks.sizes[rows])))
        if cuts:
            spots = at[[c for c, _ in cuts]]
            ids = np.insert(ids, spots, [s for _, s in cuts])
        stops = [int(at[c]) + n for c, n in ends]
        return [ids[a:b] for a, b in zip([0, *stops], stops)]


class Decoder:
    """Ids to text, a part at a time."""

    def __init__(self, words: Vocabulary):
        byte = {s: b for b, s in enumerate(byte_symbols())}
        self.bytes: list[bytes] = [b""] * words.size
        for token, i in words.ids.items():
            self.bytes[i] = bytes(byte[s] for s in token) if all(s in byte for s in token) else token.encode()
        for token, i in words.special.items():
            self.bytes[i] = token.encode()

    def stream(self, parts: Iterable[np.ndarray]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield state.decode(b"".join(map(self.bytes.__getitem__, ids.tolist())))
        yield state.decode(b"", True)

    def decode(self, ids: np.ndarray, part: int = 1 << 16) -> str:
        return "".join(self.stream(ids[i : i + part] for i in range(0, len(ids), part)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(vocabulary(path))


def round_trip(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, same_text, and the ids if asked for."""
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    fields = [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()), T.StructField("same_text", T.BooleanType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []),
    ]
    schema = T.StructType([narrow.schema["doc_id"], *fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = place(tokenizer)
        encode, decode = encoder(path).encode, decoder(path).decode
        for batch in batches:
            for part, texts in slices(batch, "text"):
                own = [texts.text(i).decode("utf-8", "replace") for i in range(texts.count)]
                found = encode(own)
                back = [decode(x) for x in found]
                columns = [
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                    pa.array([a == b for a, b in zip(own, back, strict=True)], pa.bool_()),
                ]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return narrow.mapInArrow(apply, schema)
