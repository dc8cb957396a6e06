"""Token ids in fixed-width bit-packed files.

*Format.* A file holds consecutive documents. First comes the data: blocks of
``BLOCK`` ids (the last one may be shorter), every id in the same number of bits,
the least that the vocabulary needs, most significant bit first; each block begins
on a byte. The footer has the document ids (int64, with a byte for null), the
document starts (uint64, one more than documents) and the block offsets (uint64,
one more than blocks), then six little-endian uint64: bits, ids a block, documents,
ids, blocks and the magic number. A reader takes the footer, then any range of ids
by its blocks, and unpacks a block with one numpy call.

*Order.* Documents are range-partitioned and sorted by id (ties by the text's
hash, null ids first), so file n comes before file n + 1 and a document's start
is the ids of earlier files plus its place in its own. Equal ids spread over files
by their texts. Files appear whole or not at all; a repeated task writes the same
file again.

A null text is an empty one and has the end id alone. Texts of any length are whole.
Repeated rows each have their place. Other columns aren't read, so their names can't
clash, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrid.session import stage_root

from .files import opened, written
from .texts import slices
from .vocabulary import LONG, Coded, library, place, plain_parts, vocabulary

TOKENIZER = "word_bpe_49k.json"
END = 1
BLOCK = 4096
MAGIC = int.from_bytes(b"GRIDPCK1", "little")
_TAIL = 6 * 8


def bits_for(size: int) -> int:
    """Bits that ids below ``size`` need."""
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8)).reshape(-1, 32)
    return np.packbits(wide[:, 32 - bits :].reshape(-1)).tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if bits in (8, 16, 32):
        return raw.view(f">u{bits // 8}")[:count].astype(np.uint32)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(raw, count=count * bits).reshape(count, bits)
    return np.packbits(wide.reshape(-1)).view(">u4").astype(np.uint32)


class Writer:
    """Appends documents to one file; holds one block and the footer's tables."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.offsets = [0]
        self.rest = np.zeros(0, dtype=np.uint32)
        self.total = 0

    def add(self, ids: list[int | None], sizes: np.ndarray, values: np.ndarray) -> None:
        """Documents with their sizes, and all their token ids one after the other."""
        if len(values) and int(values.max()) >> self.bits:
            raise ValueError("a token id does not fit the width of the file")
        self.ids.extend(ids)
        self.sizes.append(np.asarray(sizes, dtype=np.uint64))
        self.total += len(values)
        self.rest = np.concatenate((self.rest, values.astype(np.uint32)))
        whole = len(self.rest) - len(self.rest) % self.block
        for at in range(0, whole, self.block):
            self._block(self.rest[at : at + self.block])
        self.rest = self.rest[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        starts = np.concatenate(([0], np.cumsum(np.concatenate([*self.sizes, np.zeros(0, dtype=np.uint64)])))).astype("<u8")
        self.out.write(np.array([i or 0 for i in self.ids], dtype="<i8").tobytes())
        self.out.write(np.array([i is None for i in self.ids], dtype=np.uint8).tobytes())
        self.out.write(starts.tobytes())
        self.out.write(np.array(self.offsets, dtype="<u8").tobytes())
        tail = [self.bits, self.block, len(self.ids), self.total, len(self.offsets) - 1, MAGIC]
        self.out.write(np.array(tail, dtype="<u8").tobytes())


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = np.frombuffer(self._bytes(size - _TAIL, _TAIL), dtype="<u8").astype(np.int64)
        self.bits, self.block, docs, self.total, blocks = (int(x) for x in tail[:5])
        if np.uint64(MAGIC) != np.uint64(tail[5]):
            raise ValueError(f"not a packed id file: {uri}")
        footer = docs * 9 + (docs + 1) * 8 + (blocks + 1) * 8
        raw = self._bytes(size - _TAIL - footer, footer)
        ids = np.frombuffer(raw, dtype="<i8", count=docs)
        missing = np.frombuffer(raw, dtype=np.uint8, count=docs, offset=docs * 8)
        self.ids = [None if m else int(i) for i, m in zip(ids, missing, strict=True)]
        self.starts = np.frombuffer(raw, dtype="<u8", count=docs + 1, offset=docs * 9).astype(np.int64)
        self.offsets = np.frombuffer(raw, dtype="<u8", count=blocks + 1, offset=docs * 17 + 8).astype(np.int64)

    def _bytes(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at) if size else b""

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids at places ``start`` to ``stop`` of the file."""
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self._bytes(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        count = min(self.total, (last + 1) * self.block) - first * self.block
        if self.block * self.bits % 8 == 0:
            ids = unpack(data, count, self.bits)
        else:
            cut = self.offsets[first : last + 2] - self.offsets[first]
            ids = np.concatenate([
                unpack(data[a:b], min(self.block, count - k * self.block), self.bits) for k, (a, b) in enumerate(zip(cut, cut[1:]))
            ])
        return ids[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


_JOINED = 500
# Chunks and pieces that a worker keeps. Two workers share an executor with its JVM.
CHUNKS_KEPT = 600_000
PIECES_KEPT = 500_000


class Encoder:
    """The library's encoding, asked once for each distinct chunk between ASCII white space.

    The file's pattern drops white space and no step of it looks across, so a
    text's ids are those of its chunks, one after the other. Plain chunks are
    their word and their punctuation, which many chunks share; the library gets
    those joined by blanks, and the ids of each end with an end-of-word token.
    """

    def __init__(self, path: str):
        self.tool = library(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        words = vocabulary(path)
        self.ends = np.zeros(words.size, dtype=bool)
        self.ends[[i for s, i in words.ids.items() if words.suffix and s.endswith(words.suffix)]] = True
        # One object per id, which all pieces share; the library makes new ones each time.
        self.numbers = list(range(words.size))
        self.pieces: dict[str, tuple[int, ...]] = {"": ()}
        self.chunks = Coded(self._solve, CHUNKS_KEPT)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _solve(self, chunks: list[bytes]) -> list[Sequence[int]]:
        if len(self.pieces) > PIECES_KEPT:
            self.pieces = {"": ()}
        pieces, parts, other, new = self.pieces, [], [], {}
        number = self.numbers.__getitem__
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            found = plain_parts(text) if len(text) <= LONG else None
            if found:
                word, tail = found[1].lower(), found[2]
                parts.append((word, tail))
                if word not in pieces:
                    new[word] = None
                if tail not in pieces:
                    new[tail] = None
            else:
                parts.append(None)
                other.append(text)
        listed = list(new)
        for at in range(0, len(listed), _JOINED):
            some = listed[at : at + _JOINED]
            flat = self._ids([" ".join(some)])[0]
            cuts = (np.flatnonzero(self.ends[flat]) + 1).tolist()
            if len(cuts) != len(some):
                raise ValueError("a piece did not end with one end-of-word token")
            for x, a, b in zip(some, [0, *cuts], cuts):
                pieces[x] = tuple(map(number, flat[a:b]))
        rest = iter(self._ids(other))
        return [(pieces[p[0]] + pieces[p[1]] if p[1] else pieces[p[0]]) if p else next(rest) for p in parts]

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the texts, each closed by ``end``."""
        chunks: list[bytes] = []
        stops = []
        for text in texts:
            chunks.extend(text.split())
            stops.append(len(chunks))
        rows = self.chunks.look_up(chunks)
        at = np.concatenate(([0], np.cumsum(self.chunks.sizes[rows])))[stops]
        return np.diff(np.concatenate(([0], at))) + 1, np.insert(self.chunks.gather(rows), at, end)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end: int = END,
          block: int = BLOCK) -> DataFrame:
    """Write the files; returns (part, uri, documents, ids) of each, one row a file, as a local table."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    ordered = narrow.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    schema = "part long, uri string, documents long, ids long"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = place(tokenizer)
        part = TaskContext.get().partitionId()
        bits = bits_for(max(vocabulary(path).size, end + 1))
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri = f"{folder}/part-{part:06d}.ids"
        with written(uri) as out:
            writer = Writer(out, bits, block)
            batch = first
            while batch is not None:
                for rows, texts in slices(batch, "text"):
                    sizes, values = encoder(path).encode([texts.text(i) for i in range(texts.count)], end)
                    writer.add(rows.column(0).to_pylist(), sizes, values)
                batch = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "documents": [len(writer.ids)], "ids": [writer.total]})

    # One short row per file comes to the driver.
    files = ordered.mapInArrow(apply, schema).collect()
    return spark.createDataFrame(sorted(files), schema)


def read(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, in tasks of one file each."""
    spark = files.sparkSession
    rows, start = [], 0
    for f in files.orderBy("part").collect():
        rows.append((f["part"], f["uri"], start))
        start += f["ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                reader = Reader(file["uri"])
                docs = len(reader.ids)
                at = 0
                while at < docs:  # as many documents at once as have about a million ids
                    to = max(at + 1, int(np.searchsorted(reader.starts, reader.starts[at] + (1 << 20), side="right")) - 1)
                    to = min(to, docs)
                    values = reader.read(int(reader.starts[at]), int(reader.starts[to])).astype("<u4")
                    cut = reader.starts[at : to + 1] - reader.starts[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.ids[at:to], pa.int64()),
                            pa.array(file["start"] + reader.starts[at:to], pa.int64()),
                            pa.array(np.diff(cut), pa.int64()),
                            pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(cut, cut[1:])], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at = to

    empty = T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], empty)
    listed = spark.createDataFrame(rows, "part long, uri string, start long")
    return listed.repartitionByRange(len(rows), "part").mapInArrow(apply, schema)


def packed(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Write all documents under the shared folder and read them back."""
    folder = f"{stage_root(docs.sparkSession)}/packed-ids-{uuid.uuid4().hex}"
    return read(write(docs, folder, id, text, tokenizer, end))
