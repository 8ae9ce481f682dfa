"""A bigram language model in an Elias-Fano trie, learned and queried by Spark tasks.

Words are numbered by the order of their hashes.  The tokens of the corpus are laid
out by (context, word) so that equal stretches hold about equally many, and each
stretch becomes one file of the trie: its contexts, the pointers to their
successors, the successors, each list an Elias-Fano sequence, and quantised
discounted probabilities.  A very frequent context spreads over several files by
itself.  Files are memory-mapped; nothing of the corpus passes through the driver
but one row per file.

The model is absolute discounting over the add-half unigram:
p(w | v) = (c(v w) - D) / c(v) + D n(v) / c(v) * p(w), with n(v) the distinct
successors of v.  A text starts in the context of an end.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, shared_path
from .elias_fano import Sequence, encode
from .files import open_mapped, write_whole

#: The end of a text; no word is empty.
END = b""
DISCOUNT = 0.75
#: Tokens whose successors one file holds.
FILE_TOKENS = 2_000_000
#: Quantised log10 probabilities: 16 bits over this range.
LOWEST, STEPS = -12.0, 65535
#: Characters handled at a time, words a task counts before it passes them on, bigrams likewise, words a worker remembers.
CHUNK_CHARS, COUNT_WORDS, HELD_BIGRAMS, CACHE_WORDS = 3_000_000, 400_000, 3_000_000, 1_500_000


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, cut at the six ASCII spaces, then the end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 1) - (1 << 63)


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(log10 / LOWEST, 0, 1) * STEPS).astype("<u2")


def dequantise(steps: np.ndarray) -> np.ndarray:
    return steps * (LOWEST / STEPS)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


# ---- words ---------------------------------------------------------------------

def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_hash(w) for w in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["h", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(tokens(text))
            if len(counts) > COUNT_WORDS:
                yield out()
                counts.clear()
    yield out()


def _write_words(folder: str):
    """One file of sorted hashes and counts per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not found:
            return
        h, n = (np.concatenate(x) for x in zip(*found))
        path = f"{folder}/{uuid.uuid4().hex}.words"
        before = np.concatenate([[0], np.cumsum(n)[:-1]])
        write_whole(path, struct.pack("<Q", len(h)) + b"".join(x.astype("<i8").tobytes() for x in (h, n, before)))
        yield pa.RecordBatch.from_pydict({"path": [path], "first": [int(h[0])], "n_words": [len(h)], "n_tokens": [int(n.sum())]})

    return run


@dataclass
class Words:
    """Hashes and counts of all words, by number."""

    files: list[tuple[str, int, int, int]]  # path, first hash, words, tokens; in order of hashes
    opened: dict = field(default_factory=dict)

    @property
    def total(self) -> int:
        return sum(f[3] for f in self.files)

    @property
    def distinct(self) -> int:
        return sum(f[2] for f in self.files)

    def __getstate__(self):
        return {"files": self.files, "opened": {}}

    def _open(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if i not in self.opened:
            data = open_mapped(self.files[i][0])
            n = struct.unpack_from("<Q", data)[0]
            self.opened[i] = tuple(np.frombuffer(data, "<i8", n, 8 + 8 * n * column) for column in range(3))
        return self.opened[i]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number (-1: unknown), count and tokens of all words before, for each hash."""
        number, count, before = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        order = np.argsort(hashes, kind="stable")
        cuts = np.searchsorted(hashes[order], [f[1] for f in self.files])
        base = mass = 0
        for i, (_, _, n_words, n_tokens) in enumerate(self.files):
            mine = order[cuts[i]:cuts[i + 1] if i + 1 < len(self.files) else len(order)]
            if len(mine):
                h, c, cum = self._open(i)
                at = np.minimum(np.searchsorted(h, hashes[mine]), n_words - 1)
                hit = h[at] == hashes[mine]
                mine, at = mine[hit], at[hit]
                number[mine], count[mine], before[mine] = base + at, c[at], mass + cum[at]
            base, mass = base + n_words, mass + n_tokens
        return number, count, before


def count_words(train: DataFrame, text: str) -> Words:
    """Count all training tokens and write the words in order of their hashes."""
    counts = train.select(text).mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.repartitionByRange("h").sortWithinPartitions("h")
    folder = shared_path(train.sparkSession, "words")
    files = keep(rows.mapInArrow(_write_words(folder), "path string, first long, n_words long, n_tokens long"), "words-files")
    return Words(sorted((tuple(r) for r in files.collect()), key=lambda f: f[1]))  # one row per file


class _Seen(dict):
    """Word to its place in this worker's arrays; unseen words wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at


class Reader:
    """Turns texts into word numbers, counts and masses, asking the files once per word."""

    def __init__(self, words: Words):
        self.words = words
        self.forget()

    def forget(self) -> None:
        self.seen, self.table = _Seen(), np.zeros((1 << 12, 3), dtype=np.int64)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number, count and mass before of every token, and each text's first token."""
        if len(self.seen) > CACHE_WORDS:
            self.forget()
        cut = [tokens(t) for t in texts]
        sizes = np.array([len(c) for c in cut])
        at = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(sizes.sum()))
        if self.seen.new:
            new, self.seen.new = self.seen.new, []
            while len(self.seen) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            first = len(self.seen) - len(new)
            self.table[first:first + len(new)] = np.stack(self.words.lookup(np.array([_hash(w) for w in new], dtype=np.int64)), axis=1)
        found = self.table[at]
        return found[:, 0], found[:, 1], found[:, 2], np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def end(self) -> np.ndarray:
        return np.stack(self.words.lookup(np.array([_hash(END)], dtype=np.int64)), axis=1)[0]


def contexts(number: np.ndarray, count: np.ndarray, before: np.ndarray, starts: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same three of the token before each; of an end before the first."""
    out = []
    for x, e in zip((number, count, before), end):
        y = np.empty_like(x)
        y[1:] = x[:-1]
        y[starts] = e
        out.append(y)
    return tuple(out)


def file_of(context_before: np.ndarray, context_count: np.ndarray, word_before: np.ndarray, total: int, file_tokens: int) -> np.ndarray:
    """Which file a (context, word) belongs to: it never falls as the pair rises."""
    place = context_before + np.floor(context_count * (word_before / max(total, 1))).astype(np.int64)
    return np.minimum(place, np.maximum(context_before + context_count - 1, 0)) // file_tokens


# ---- bigrams -------------------------------------------------------------------

def _pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted (context, word) pairs and their counts, compressed column by column."""
    context, word = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
    step = np.diff(context, prepend=np.uint32(0)).astype("<u4")
    columns = [x.view(np.uint8).reshape(-1, 4).T.copy() for x in (step, word.astype("<u4"), counts.astype("<u4"))]
    return zstandard.compress(b"".join(c.tobytes() for c in columns), 1)


def _unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    step, word, counts = (c.reshape(4, -1).T.copy().view("<u4").ravel() for c in np.split(raw, 3))
    return (np.cumsum(step, dtype=np.uint64) << np.uint64(32)) | word.astype(np.uint64), counts.astype(np.int64)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def _count_bigrams(words: Words, file_tokens: int):
    """Sorted runs of bigram counts of one partition, cut by file."""
    total = words.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(words)
        end = reader.end()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, counts = _merge([k for k, _, _ in held], [c for _, c, _ in held])
            _, some = np.unique(np.concatenate([k for k, _, _ in held]), return_index=True)
            files = np.concatenate([f for _, _, f in held])[some]  # a key has the same file in every run
            edges = np.flatnonzero(np.concatenate([[True], files[1:] != files[:-1]]))
            held.clear()
            ends = np.append(edges[1:], len(keys))
            return pa.RecordBatch.from_arrays([pa.array(files[edges], pa.int64()), pa.array([_pack_counts(keys[a:b], counts[a:b]) for a, b in zip(edges, ends)], pa.binary())], names=["file", "runs"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _chunks(texts):
                number, count, before, starts = reader.read(texts[a:b])
                cn, cc, cb = contexts(number, count, before, starts, end)
                keys, at, n = np.unique((cn.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64), return_index=True, return_counts=True)
                held.append((keys, n, file_of(cb[at], cc[at], before[at], total, file_tokens)))
                if sum(len(k) for k, _, _ in held) > HELD_BIGRAMS:
                    yield out()
        if held:
            yield out()

    return run


MAGIC = b"EFT1"


def encode_file(keys: np.ndarray, counts: np.ndarray, context_counts: np.ndarray, words: int) -> bytes:
    """Contexts, pointers, successors and quantised probabilities of one stretch.

    ``context_counts`` are the counts of each pair's context.  A successor is stored
    as its number plus ``words`` times the place of its context, which makes the
    whole level one rising sequence.
    """
    context = keys >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    successor = (keys & np.uint64(0xFFFFFFFF)) + owner.astype(np.uint64) * np.uint64(words)
    steps = quantise(np.log10((counts - DISCOUNT) / context_counts))
    return MAGIC + encode(context[first]) + encode(np.append(first, len(keys))) + encode(successor) + steps.tobytes()


class TrieFile:
    """Queries one stretch of the trie."""

    def __init__(self, data: memoryview, words: int):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a file of the trie")
        self.words = words
        self.contexts = Sequence(data, 4)
        self.pointers = Sequence(data, self.contexts.end)
        self.successors = Sequence(data, self.pointers.end)
        self.steps = np.frombuffer(data, dtype="<u2", count=self.successors.n, offset=self.successors.end)

    def query(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the discounted part (-inf: never seen) and the context's successors here."""
        owner, inverse = np.unique(keys >> np.uint64(32), return_inverse=True)
        place = self.contexts.find(owner)
        known = np.flatnonzero(place >= 0)
        sizes = np.zeros(len(owner), dtype=np.int64)
        sizes[known] = (self.pointers[place[known] + 1] - self.pointers[place[known]]).astype(np.int64)
        mine = np.flatnonzero((place[inverse] >= 0) & ((keys & np.uint64(0xFFFFFFFF)) < np.uint64(self.words)))
        at = self.successors.find((keys[mine] & np.uint64(0xFFFFFFFF)) + place[inverse[mine]].astype(np.uint64) * np.uint64(self.words))
        out = np.full(len(keys), -np.inf)
        out[mine[at >= 0]] = dequantise(self.steps[at[at >= 0]])
        return out, sizes[inverse]


def _build(folder: str, words: Words):
    """Merge the runs of each file, which come one after another, and write it."""
    n_words = words.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def out(file: int, runs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, counts = _merge([k for k, _ in runs], [c for _, c in runs])
            context = (keys >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            sizes = np.diff(np.append(first, len(keys)))
            path = f"{folder}/{file:08d}-{uuid.uuid4().hex}.trie"
            write_whole(path, encode_file(keys, counts, np.repeat(_counts(words, context[first]), sizes), n_words))
            ends = sorted({0, len(first) - 1})
            return pa.RecordBatch.from_pydict(
                {"file": [file], "path": [path], "n_bigrams": [len(keys)], "edge": [[int(context[first[i]]) for i in ends]], "edge_n": [[int(sizes[i]) for i in ends]]},
                schema=pa.schema([("file", pa.int64()), ("path", pa.string()), ("n_bigrams", pa.int64()), ("edge", pa.list_(pa.int64())), ("edge_n", pa.list_(pa.int64()))]))

        current, runs = None, []
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if runs and file != current:
                    yield out(current, runs)
                    runs = []
                current = file
                runs.append(_unpack_counts(data.as_buffer().to_pybytes()))
                if sum(len(k) for k, _ in runs) > HELD_BIGRAMS:
                    runs = [_merge([k for k, _ in runs], [c for _, c in runs])]
        if runs:
            yield out(current, runs)

    return run


def _counts(words: Words, numbers: np.ndarray) -> np.ndarray:
    """Counts of words by their numbers."""
    out, base = np.zeros(len(numbers), dtype=np.int64), 0
    for i, (_, _, n, _) in enumerate(words.files):
        mine = (numbers >= base) & (numbers < base + n)
        if mine.any():
            out[mine] = words._open(i)[1][numbers[mine] - base]
        base += n
    return out


@dataclass
class Trie:
    """Words, the paths of the trie's files, and how many successors the outermost contexts of each file have in all."""

    words: Words
    paths: dict[int, str]
    spanning: dict[int, int]
    file_tokens: int
    opened: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "opened": {}}

    def file(self, number: int) -> TrieFile:
        if number not in self.opened:
            self.opened[number] = TrieFile(open_mapped(self.paths[number]), self.words.distinct)
        return self.opened[number]


def fit(train: DataFrame, text: str = "text", file_tokens: int = FILE_TOKENS) -> Trie:
    """Learn from all texts of ``train``; null is an empty text."""
    spark = train.sparkSession
    words = count_words(train, text)
    runs = train.select(text).mapInArrow(_count_bigrams(words, file_tokens), "file long, runs binary")
    folder = shared_path(spark, "trie")
    n_files = -(-words.total // file_tokens)
    built = runs.repartition(max(1, n_files), "file").sortWithinPartitions("file").mapInArrow(
        _build(folder, words), "file long, path string, n_bigrams long, edge array<long>, edge_n array<long>")
    rows = keep(built, "trie-files").collect()  # one row per file
    edges: dict[int, list[int]] = {}
    for r in rows:
        for context, n in zip(r["edge"], r["edge_n"]):
            edges.setdefault(context, []).append(n)
    return Trie(words, {r["file"]: r["path"] for r in rows}, {c: sum(n) for c, n in edges.items()}, file_tokens)


def score_texts(texts: list[str | None], trie: Trie, reader: Reader, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and score of each text."""
    total, distinct = trie.words.total, trie.words.distinct
    number, count, before, starts = reader.read(texts)
    base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
    cn, cc, cb = contexts(number, count, before, starts, end)
    score = base.copy()
    known_context = np.flatnonzero(cn >= 0)
    # unknown words have no successors to be found among, but their contexts back off
    key = (cn[known_context].astype(np.uint64) << np.uint64(32)) | np.where(number[known_context] >= 0, number[known_context], 0xFFFFFFFF).astype(np.uint64)
    keys, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    at = known_context[at]
    part, sizes = np.full(len(keys), -np.inf), np.zeros(len(keys), dtype=np.int64)
    files = file_of(cb[at], cc[at], before[at], total, trie.file_tokens)
    order = np.argsort(files, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], files[order][1:] != files[order][:-1]])) if len(order) else []
    for a, b in zip(edges, np.append(edges[1:], len(order)) if len(order) else []):
        mine = order[a:b]
        if int(files[mine[0]]) in trie.paths:
            part[mine], sizes[mine] = trie.file(int(files[mine[0]])).query(keys[mine])
    if trie.spanning:
        wide = np.array(sorted(trie.spanning))
        spot = np.minimum(np.searchsorted(wide, cn[at]), len(wide) - 1)
        sizes = np.where(wide[spot] == cn[at], np.array([trie.spanning[int(c)] for c in wide])[spot], sizes)
    back = DISCOUNT * sizes / np.maximum(cc[at], 1)
    probability = np.power(10.0, part)[inverse] + np.where(sizes > 0, back, 1.0)[inverse] * np.power(10.0, base[known_context])
    score[known_context] = np.log10(probability)
    n_tokens = np.diff(np.append(starts, len(number)))
    return n_tokens, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(score, starts)


def score(df: DataFrame, trie: Trie, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    Scores are log10 probabilities of the whole text and its end; null is an empty
    text.  With nothing learned both scores are 0.  Rows are scored each by itself,
    so repeated rows get equal scores; an empty table gives an empty result; other
    columns are not read.
    """
    source = df.select(F.col(key), F.col(text))
    shared = df.sparkSession.sparkContext.broadcast(trie)  # paths and counts of files, not their content
    total = trie.words.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = Reader(own.words)
        end = reader.end()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                n, known, base, found = score_texts(texts[a:b], own, reader, end)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(known), pa.array(np.full(b - a, total)), pa.array(base), pa.array(found)],
                                                 names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(key: Column, modulus: int = 5, rest: int = 1) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % modulus == rest
