"""Token ids in patched frame-of-reference blocks.

Documents are tokenised in key order and their ids written to files of blocks: a
block keeps its smallest id, the rest as differences at the width that fits a
chosen share of them, and those that do not fit as exceptions with their places.
A file holds the index of its documents and of its block starts, so any document
is read without the blocks before it.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import keep, shared_path
from .files import open_mapped, write_whole

MAGIC, VERSION = b"PFOR", 2
#: Ids in a block, the share of a block's ids that its width must fit, and ids per file.
BLOCK, FIT, FILE_IDS = 1024, 0.9, 4_000_000
END_ID = 0
#: Characters tokenised at a time, and word pieces whose ids a worker remembers.
CHUNK_CHARS, CACHE_PIECES = 4_000_000, 1_500_000


# ---- file format -------------------------------------------------------------

def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values under 2**width, ``width`` bits each, lowest bit first."""
    if width == 0:
        return b""
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: memoryview, n: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, dtype=np.uint32)
    place = np.arange(n, dtype=np.int64) * width
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    words = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    return ((words[place >> 3] >> (place & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode_block(ids: np.ndarray, fit: float = FIT) -> bytes:
    """Smallest id, count, exceptions, width, packed differences, exception places and values."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    pick = int(np.partition(rest, int(fit * (len(rest) - 1)))[int(fit * (len(rest) - 1))])
    width = pick.bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    head = struct.pack("<IHHB", low, len(ids), len(odd), width)
    body = pack(rest & np.uint32((1 << width) - 1), width)
    return head + body + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()


def decode_block(data: memoryview) -> np.ndarray:
    low, n, n_odd, width = struct.unpack_from("<IHHB", data)
    at = 9
    size = (n * width + 7) // 8
    rest = unpack(data[at:at + size], n, width)
    at += size
    places = np.frombuffer(data, dtype="<u2", count=n_odd, offset=at)
    rest[places] = np.frombuffer(data, dtype="<u4", count=n_odd, offset=at + 2 * n_odd)
    return rest + np.uint32(low)


def encode_file(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray, keyless: int = 0) -> bytes:
    """Header, document keys and lengths, block starts, blocks; the first ``keyless`` documents have no key."""
    blocks = [encode_block(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = MAGIC + struct.pack("<HHQQQ", VERSION, BLOCK, len(keys), len(ids), keyless)
    return b"".join([head, keys.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), starts.tobytes(), *blocks])


class TokenFile:
    """Reads a file of blocks; documents in any order."""

    def __init__(self, data: memoryview):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a file of token blocks")
        version, self.block, n_docs, self.n_ids, self.keyless = struct.unpack_from("<HHQQQ", data, 4)
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        at = 32
        self.keys = np.frombuffer(data, dtype="<i8", count=n_docs, offset=at)
        self.lengths = np.frombuffer(data, dtype="<u4", count=n_docs, offset=at + 8 * n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        at += 12 * n_docs
        n_blocks = -(-self.n_ids // self.block)
        self.starts = np.frombuffer(data, dtype="<u8", count=n_blocks + 1, offset=at)
        self.data = data[at + 8 * (n_blocks + 1):]

    def ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from place ``first``; reads only the blocks that hold them."""
        if not count:
            return np.empty(0, np.uint32)
        a, b = first // self.block, (first + count - 1) // self.block
        found = np.concatenate([decode_block(self.data[int(self.starts[i]):int(self.starts[i + 1])]) for i in range(a, b + 1)])
        return found[first - a * self.block:first - a * self.block + count]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.lengths[i]))


# ---- tokenising ----------------------------------------------------------------

class _Pieces(dict):
    """Piece to its number; unseen ones get the next and wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class PieceEncoder:
    """Ids of whole texts by the library, asked once for every distinct piece.

    No token of this byte-level vocabulary crosses a single space or line break that
    stands between two other characters, and a space starts the token after it.  A
    text is cut there; where white space meets white space, the library gets the
    whole text.  Pieces are asked for joined together, since their joints are such
    places again; the byte lengths of the tokens say which piece each belongs to.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a byte-level token has a character for each of its bytes; added tokens are plain text
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.n_bytes[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.n_bytes[i] = len(token.content.encode())
        self.line = len(self._ask("\n"))
        self.forget()

    def forget(self) -> None:
        self.known, self.used = _Pieces(), 0
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.start, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _ask(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    @staticmethod
    def _safe(piece: str) -> bool:
        """Whether a piece stands between single spaces or line breaks, none of them inside or beside it."""
        bare = piece[1:] if piece[:1] == "\n" else piece
        return bool(bare) and not bare[0].isspace() and not bare[-1].isspace() and bare[0] not in "\u180e\u200b\ufeff"

    def _learn(self) -> None:
        """Store the ids of the new pieces; an unsafe one has size -1."""
        new, first = self.known.new, len(self.known) - len(self.known.new)
        self.known.new = []
        while len(self.known) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        good = [i for i, p in enumerate(new) if self._safe(p)]
        self.size[first:first + len(new)] = -1
        for at in range(0, len(good), 4096):
            own = good[at:at + 4096]
            asked = [new[i] if new[i][0] == "\n" else " " + new[i] for i in own]
            ids = self._ask("".join(asked))
            ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in asked])
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, side="right")
            at_cuts = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])[cuts]
            if cuts[-1] != len(ids) or (at_cuts != ends).any():
                continue  # not cut as expected: these pieces stay unsafe, and their texts go to the library whole
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used:self.used + len(ids)] = ids
            starts = np.concatenate([[0], cuts[:-1]])
            self.start[first + np.array(own)] = self.used + starts
            self.size[first + np.array(own)] = cuts - starts
            self.used += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_PIECES:
            self.forget()
        if not texts:
            return []
        # a line break starts a piece, a space is what pieces are split at; the break put in front is taken off again
        cut = [("\n" + t).replace("\n", " \n").split(" ")[1:] for t in texts]
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=sum(map(len, cut)))
        if self.known.new:
            self._learn()
        size = self.size[number]
        first = np.concatenate([[0], np.cumsum([len(c) for c in cut])[:-1]])
        whole = set(np.flatnonzero(np.minimum.reduceat(size, first) < 0).tolist())
        size = np.maximum(size, 0)
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[number] - ends + size, size) + np.arange(ends[-1])]
        bounds = np.append(np.concatenate([[0], ends])[first], ends[-1])
        return [self._ask(t) if i in whole else ids[bounds[i] + self.line:bounds[i + 1]] for i, t in enumerate(texts)]


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of this worker: what it knows serves all tasks that the worker runs."""
    return PieceEncoder(path)


def _writer(folder: str, vocabulary: str, file_ids: int):
    """Tokenises one partition in order and writes its files; yields a row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt, seq = context.partitionId(), uuid.uuid4().hex, 0
        encoder = worker_encoder(vocabulary)
        keys, parts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, parts, held, seq
            path = f"{folder}/{part:06d}-{seq:05d}-{attempt}.pfor"
            lengths = np.array([len(p) for p in parts], dtype=np.uint32)
            write_whole(path, encode_file(np.array([k or 0 for k in keys], dtype=np.int64), lengths, np.concatenate(parts), keys.count(None)))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(keys)], "n_ids": [held]},
                                             schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            keys, parts, held, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            own, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            first, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < CHUNK_CHARS and i < len(texts) - 1:
                    continue
                for key, ids in zip(own[first:i + 1], encoder.encode(texts[first:i + 1])):
                    if held and held + len(ids) + 1 > file_ids:
                        yield flush()
                    keys.append(key)
                    parts.append(np.append(ids, np.uint32(END_ID)))
                    held += len(ids) + 1
                first, size = i + 1, 0
        if keys:
            yield flush()

    return run


def write_tokens(df: DataFrame, vocabulary: str, folder: str | None = None, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write all texts in ascending key order; returns the manifest.

    One row per file: ``path``, ``n_docs``, ``n_ids`` and ``first``, the ids of all
    files before it.  Only files of the manifest count: a task that is run again
    writes others, under names of its own.  A document is never cut between files,
    so one file may be larger than ``file_ids``.

    Null and empty texts are the end id alone.  Rows without a key come before all
    others.  Repeated keys follow each other, in the order of a hash of
    their texts, so that one key with many rows is many tasks.
    An empty table gives an empty manifest; other columns are not read.
    """
    spark = df.sparkSession
    folder = folder or shared_path(spark, "tokens")
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = docs.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    files = keep(ordered.mapInArrow(_writer(folder, vocabulary, file_ids), "part int, seq int, path string, n_docs long, n_ids long"), "manifest")
    # one row per file of millions of ids: numbered in two steps all the same
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    placed = files.withColumn("_within", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(before, "part")
    return keep(placed.select("part", "seq", "path", "n_docs", "n_ids", (F.col("_before") + F.col("_within")).cast("long").alias("first")), "placed")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = TokenFile(open_mapped(path))
            for i in range(0, len(found.keys), 2000):
                last = min(i + 2000, len(found.keys))
                ids = found.ids(int(found.first[i]), int(found.first[last] - found.first[i])).astype("<u4")
                at = found.first[i:last + 1] - found.first[i]
                own = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys[i:last], mask=np.arange(i, last) < found.keyless), pa.array(first + found.first[i:last]), pa.array([len(o) for o in own], pa.int64()),
                     pa.array([zlib.crc32(o) for o in own], pa.int64()), pa.array([o.tobytes() for o in own], pa.binary())],
                    names=["id", "start", "n_tokens", "ids_crc32", "ids"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) of every document in the files of a manifest.

    ``ids`` are little-endian unsigned 32-bit integers; ``start`` counts the ids of
    all documents before it.
    """
    files = manifest.count()
    return manifest.select("path", "first").repartition(max(1, files)).mapInArrow(_reader, "id long, start long, n_tokens long, ids_crc32 long, ids binary")
