"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter counts by at
most two in L1 distance.  Words of one length are a k-d tree; a word asks the tree of
its own length for vectors two away and the tree of the next length for vectors one away.
Subtrees whose bounding box lies farther off are pruned, and what is left is verified
letter by letter.

The top of every tree is cut into cells that Spark deals out.  Its planes come from a
bounded sample of the words and are small; every word is in the tree, in the cell where
the planes put it, and asks all cells that its ball meets.  Within a cell the tree goes on
over all of its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, keep

#: Small letters, Latin-1 letters and the two signs between them; one byte each in Latin-1.
RUN = re.compile("[a-zÀ-ÿ]+")
#: a-z and the other letters by their number modulo six; sums of counts only shorten distances.
DIMENSIONS, OTHERS = 32, 6
LEAF = 8
#: Words a cell should hold, and the most words the planes are learned from.
CELL_WORDS, SAMPLE = 131_072, 131_072
_FLUSH, _ASK, _PAIRS, _FAR = 200_000, 2_048, 2_000_000, 1 << 30


def _tallies(noise: int, min_length: int):
    """(word, n) of the runs of each batch, counted before they leave the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                head = zlib.crc32(f"{'' if key is None else key}:".encode())
                lower = (text.as_py() or b"").lower().decode("utf-8", "replace")  # of bytes: A-Z only
                for w, n in Counter(RUN.findall(lower)).items():
                    if noise and len(w) >= min_length:
                        h = zlib.crc32(w.encode(), head)
                        if h % noise == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                    if len(w) >= min_length:
                        counts[w] = counts.get(w, 0) + n
                if len(counts) > _FLUSH:
                    yield flush()
        if counts:
            yield flush()

    return run


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, noise: int = 31) -> DataFrame:
    """(word, n): the distinct words of all whole texts with their counts.

    A word is a run of letters, A-Z lower-cased.  ``noise`` spells words wrongly on
    purpose: of a word whose crc32 of ``key:word`` it divides, one letter goes; 0 takes
    words as they are.  A null key counts as an empty one, a null text as no words.
    """
    counted = df.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(_tallies(noise, min_length), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def letter_counts(words: Sequence[str]) -> np.ndarray:
    """The vector of every word: how often each letter occurs."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    axis = np.where((flat >= 97) & (flat <= 122), flat - 97, 26 + flat % OTHERS)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * DIMENSIONS + axis, minlength=len(words) * DIMENSIONS).reshape(len(words), DIMENSIONS).astype(np.int32)


def unary(points: np.ndarray, bits: int = 4) -> np.ndarray:
    """Each count, up to ``bits``, as so many bits of a row of words: differing bits are the L1 distance or less."""
    marks = (1 << np.minimum(points, bits)) - 1
    if bits == 4:
        marks = marks[:, ::2] | marks[:, 1::2] << 4
    return np.ascontiguousarray(marks).astype(np.uint8).view(np.uint64)


def halves(points: np.ndarray) -> tuple[int, int] | None:
    """(axis, value) of the plane that cuts points nearest to half: those up to the value go left; None if all are equal."""
    best = None
    for axis in np.argsort(points.max(axis=0) - points.min(axis=0), kind="stable")[::-1][:8].tolist():
        values, counts = np.unique(points[:, axis], return_counts=True)
        if len(values) < 2:
            continue
        left = np.cumsum(counts)[:-1]
        k = int(np.argmin(np.abs(2 * left - len(points))))
        off = abs(2 * int(left[k]) - len(points))
        if best is None or off < best[0]:
            best = (off, axis, int(values[k]))
    return None if best is None else best[1:]


class Planes:
    """The top of a tree as nested planes; its leaves are cells."""

    def __init__(self, points: np.ndarray, largest: int, first: int):
        self.first, self.cells = first, 0
        self.root = self._cut(points, largest)

    def _cut(self, points: np.ndarray, largest: int):
        plane = halves(points) if len(points) > largest else None
        if plane is None:
            self.cells += 1
            return self.first + self.cells - 1
        left = points[:, plane[0]] <= plane[1]
        return (*plane, self._cut(points[left], largest), self._cut(points[~left], largest))

    def place(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that a point's ball meets; with radius 0, of its own."""
        rows, cells = [], []

        def down(node, at: np.ndarray, box: dict[int, tuple[int, int]]) -> None:
            apart = np.zeros(len(at), np.int64)
            for axis, (low, high) in box.items():
                x = points[at, axis]
                apart += np.maximum(low - x, 0) + np.maximum(x - high, 0)
            at = at[apart <= radius]
            if isinstance(node, int):
                rows.append(at)
                cells.append(np.full(len(at), node))
            elif len(at):
                axis, value, left, right = node
                low, high = box.get(axis, (0, _FAR))
                down(left, at, {**box, axis: (low, min(high, value))})
                down(right, at, {**box, axis: (max(low, value + 1), high)})

        down(self.root, np.arange(len(points)), {})
        return np.concatenate(rows), np.concatenate(cells)


def _columns(codes: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(c) for c in codes.T]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Tree:
    """A k-d tree over all words of a cell, built and searched a level at a time.

    A node is cut at the mean of its letter of largest variance.  Boxes and words are unary
    codes, so the distance from a box is the bits that its least counts have over a word's,
    and a word's over its largest.
    """

    def __init__(self, points: np.ndarray, bits: int = 4):
        self.bits, codes = bits, unary(points, bits)
        order, start, size = np.arange(len(points)), np.zeros(1, np.int64), np.array([len(points)])
        levels, first = [], 0
        while len(start):
            own, edges = points[order], start
            where = np.searchsorted(order_ends(start, size), np.arange(len(order)), "right") if len(start) > 1 else np.zeros(len(order), np.int64)
            sums, squares = np.add.reduceat(own, edges, axis=0), np.add.reduceat(own * own, edges, axis=0)
            spread = squares * size[:, None] - sums * sums
            axis = spread.argmax(axis=1)
            split = (size > LEAF) & (spread[np.arange(len(size)), axis] > 0)
            low, high = np.bitwise_and.reduceat(codes[order], edges, axis=0), np.bitwise_or.reduceat(codes[order], edges, axis=0)
            places = order
            child = np.full(len(start), -1, np.int64)
            child[split] = first + len(start) + 2 * np.arange(int(split.sum()))
            levels.append((low, high, child, start, size, places))
            first += len(start)
            # words of the nodes that are cut go on, those up to the mean first
            going = split[where]
            order, where = order[going], where[going]
            value = sums[np.arange(len(size)), axis] // size
            right = points[order, axis[where]] > value[where]
            key = 2 * (np.cumsum(split) - 1)[where] + right
            order = order[np.argsort(key, kind="stable")]
            size = np.bincount(key, minlength=2 * int(split.sum()))
            start = np.cumsum(size) - size
        low, high, self.child = (np.concatenate([lv[i] for lv in levels]) for i in range(3))
        self.low, self.high = _columns(low), _columns(high)
        # every leaf's words, one leaf after another
        sizes = np.concatenate([lv[4] for lv in levels])
        leaf = self.child < 0
        self.size = np.where(leaf, sizes, 0)
        self.start = np.cumsum(self.size) - self.size
        self.words = np.concatenate([lv[5][_ranges(lv[3][own], lv[4][own])] for lv in levels if (own := lv[2] < 0).any()])
        self.codes = _columns(codes[self.words])

    def within(self, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asked row, point) pairs, all that are at most ``radius`` apart among them."""
        codes = _columns(unary(asked, self.bits))
        at, node = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        leaves = []
        while len(at):
            apart = np.zeros(len(at), np.uint8)
            for code, low, high in zip(codes, self.low, self.high):
                q = code[at]
                apart += np.bitwise_count(low[node] & ~q)
                apart += np.bitwise_count(q & ~high[node])
            near = apart <= radius
            at, node = at[near], node[near]
            below = self.child[node]
            inner = below >= 0
            leaves.append((at[~inner], node[~inner]))
            at, below = at[inner], below[inner]
            at, node = np.concatenate([at, at]), np.concatenate([below, below + 1])
        at, node = (np.concatenate(x) for x in zip(*leaves))
        size = self.size[node]
        upto = np.cumsum(size)
        first = 0
        while first < len(at):  # in blocks, as a leaf of equal vectors can be large
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _PAIRS, "right")))
            block = slice(first, last)
            r, p = np.repeat(at[block], size[block]), _ranges(self.start[node[block]], size[block])
            apart = np.zeros(len(r), np.uint8)
            for code, own in zip(codes, self.codes):
                apart += np.bitwise_count(code[r] ^ own[p])
            ok = apart <= radius
            yield r[ok], self.words[p[ok]]
            first = last


def order_ends(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where each of some neighbouring ranges ends."""
    return start + size


def letters(words: Sequence[str]) -> np.ndarray:
    """Words of one length as rows of characters, filled up to whole words of eight."""
    rows = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))


def one_edit(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray, size: int, other: int) -> np.ndarray:
    """Which rows ``at`` of ``a`` (of ``size`` letters) differ from rows ``to`` of ``b`` by a letter replaced, or by one more in ``b`` (of ``other``)."""
    if other == size:
        x = a.view(np.uint64)[at] ^ b.view(np.uint64)[to]
        low = np.uint64(0x7F7F7F7F7F7F7F7F)
        changed = ((x & low) + low | x) & ~low  # the top bit of every byte that is not zero
        return np.bitwise_count(changed).sum(axis=1) == 1
    short, long = a[at, :size], b[to, :other]
    head = np.cumprod(short == long[:, :size], axis=1).sum(axis=1)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= size


def _router(trees: dict[int, Planes]):
    """Every word as a point of its own cell, and as a question to all cells it may have neighbours in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False)
            sizes = np.array([len(w) for w in words])
            out = []
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                points = letter_counts(words[at])
                out.append((*_placed(trees, size, points, 0, at), 0))
                out.append((*_placed(trees, size, points, 2, at), 1))
                if size + 1 in trees:
                    out.append((*_placed(trees, size + 1, points, 1, at), 1))
            rows = np.concatenate([o[0] for o in out])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([np.full(len(o[0]), o[2], np.int32) for o in out])),
                                              pa.array(words[rows], pa.string()), pa.array(n[rows])], names=["cell", "role", "word", "n"])

    return run


def _placed(trees, size, points, radius, at):
    row, cell = trees[size].place(points, radius)
    return at[row], cell


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n) both ways, of all words one edit apart, from rows sorted by cell with its points first."""
    cell, points, counts, tree = None, [], [], None
    asked: list[tuple[str, int]] = []

    def answer() -> Iterator[pa.RecordBatch]:
        nonlocal tree
        if points and asked:
            other = len(points[0])
            if tree is None:
                # longer words hold letters more often
                tree = (Tree(letter_counts(points), 4 if other <= 20 else 8), letters(points), np.array(points, object), np.array(counts, np.int64))
            index, spelled, names, often = tree
            for size in sorted({len(w) for w, _ in asked}):
                own = [q for q in asked if len(q[0]) == size]
                words, n = np.array([w for w, _ in own], object), np.array([c for _, c in own], np.int64)
                chars = letters(words)
                for r, p in index.within(letter_counts(words), 2 if size == other else 1):
                    ok = one_edit(chars, spelled, r, p, size, other)
                    r, p = r[ok], p[ok]
                    if not len(r):
                        continue
                    one, two, m = words[r], names[p], often[p]
                    if size != other:  # the longer words do not ask the shorter ones
                        one, two, m = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([m, n[r]])
                    yield pa.RecordBatch.from_arrays([pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(m)], names=["a", "b", "n"])
        asked.clear()

    for batch in batches:
        for c, role, word, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if c != cell:
                yield from answer()
                cell, points, counts, tree = c, [], [], None
            if role == 0:
                points.append(word)
                counts.append(n)
            else:
                asked.append((word, n))
                if len(asked) >= _ASK:
                    yield from answer()
    yield from answer()


def planes(words: DataFrame, cell_words: int = CELL_WORDS, sample: int = SAMPLE) -> dict[int, Planes]:
    """The planes of the tree of every length, from at most ``sample`` words in the order of their hashes."""
    sizes = {r["size"]: r["n"] for r in words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = min(1.0, sample / max(1, total))
    cut = int(share * (1 << 31))
    drawn: dict[int, list[str]] = {}
    for row in words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 31)) < cut).select("word").limit(2 * sample).toLocalIterator():
        drawn.setdefault(len(row["word"]), []).append(row["word"])
    out, first = {}, 0
    for size in sorted(sizes):
        own = sorted(drawn.get(size, []))
        points = letter_counts(own) if own else np.zeros((0, DIMENSIONS), np.int32)
        out[size] = Planes(points, max(32, int(cell_words * share)), first)
        first += out[size].cells
    return out


def neighbours(words: DataFrame, cell_words: int = CELL_WORDS, sample: int = SAMPLE) -> DataFrame:
    """(a, b, n): every two words one edit apart, each way, with the count of ``b``."""
    trees = planes(words, cell_words, sample)
    routed = words.select("word", "n").mapInArrow(_router(trees), "cell bigint, role int, word string, n bigint")
    return routed.repartition("cell").sortWithinPartitions("cell", "role").mapInArrow(_neighbours, "a string, b string, n bigint")


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, noise: int = 31, ratio: int = 10,
             cell_words: int = CELL_WORDS, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of the texts with the commoner spelling next to it.

    ``n_near`` counts the words one edit away; ``form`` is the one of them with the largest
    count, the smallest in code-point order of several, if that count is ``ratio`` times the
    word's own; else null.  ``root`` is the last word reached by following forms.  Lengths
    are in code points.  Null, empty and letterless texts have no words; repeated rows count
    again; a null key counts as empty in ``noise``; an empty table gives an empty result;
    other columns are not read.
    """
    words = keep(vocabulary(df, key, text, min_length, min_count, noise), "words")
    links = neighbours(words, cell_words, sample)
    # strings compare by bytes, which is the order of code points
    best = links.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("back"), "b")).alias("top"))
    near = keep(best.select(F.col("a").alias("word"), "n_near", F.col("top.b").alias("best"), (-F.col("top.back")).alias("best_n")), "near")
    joined = words.join(near, "word", "left")
    strong = F.col("best_n") >= ratio * F.col("n")
    formed = keep(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")), "forms")
    # counts grow by the ratio with every step, so paths are short; each round doubles what a word has followed
    ends = keep(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "ends")
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = keep(ends.join(broadcast_if_small(ahead), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ends")
        ends = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
