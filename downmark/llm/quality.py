"""Quality by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.  A
text is compressed with either; how much smaller one result is than the other,
for its size, becomes a calibrated probability.  Texts are compressed in short
pieces, so that the dictionary matters from the first to the last of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text compressed at a time and of a dictionary.
PIECE, DICTIONARY = 1024, 64 << 10


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


class Compressors:
    """The two compressors of a model, made once per worker."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.pair = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), write_content_size=False,
                                              write_dict_id=False, write_checksum=False) for d in (good, bad)]

    def sizes(self, raw: bytes) -> tuple[int, int]:
        """Compressed bytes of all pieces with the good and with the bad dictionary."""
        cut = pieces(raw)
        good, bad = ([len(c.compress(p)) for p in cut] for c in self.pair)
        return sum(good), sum(bad)


def difference(good: float, bad: float) -> float:
    """How much smaller the good dictionary makes a text, for its size; 0 for an empty one."""
    return 10 * (bad - good) / (bad + good) if bad + good else 0.0


@dataclass
class QualityModel:
    """Two dictionaries and the calibration; ``weights`` ends with the intercept."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    prior: float

    def score(self, raw: bytes, compressors: Compressors | None) -> float:
        if not raw or compressors is None:
            return self.prior
        x = np.array([difference(*compressors.sizes(raw)), 1.0])
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.weights))))))


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps until they vanish, with a slight pull to zero."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(cut: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, cut).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(cut)[-DICTIONARY:]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pieces of each text."""
    for batch in batches:
        kinds, found = [], []
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = pieces(t)
            found += own
            kinds += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(found, pa.binary())], names=["y", "piece"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", docs_per_label: int = 1500) -> QualityModel:
    """Fit on about ``docs_per_label`` labelled documents of each kind, drawn by hash of their keys.

    The draw reads ``labels`` (key and label) alone; its few rows are then looked up in
    ``docs``.  A third of them calibrate, the others make the dictionaries.  The driver
    takes the whole texts of the latter and the differences of the former.  Rows without key, text or label teach nothing; with one kind only, the
    score is its share of the labels.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(F.col("k").isNotNull() & F.col("y").isin(0, 1))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    nothing = QualityModel(b"", b"", np.zeros(0), prior)
    if len(sizes) < 2:
        return nothing
    share = F.when(F.col("y") == 1, F.lit(docs_per_label / sizes[1])).otherwise(F.lit(docs_per_label / sizes[0]))
    drawn = known.withColumn("draw", F.xxhash64(F.lit("quality"), F.col("k"))).filter(F.pmod("draw", F.lit(1 << 20)) / F.lit(float(1 << 20)) < share)
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).filter(F.octet_length("t") > 0)
    sample = texts.join(F.broadcast(drawn), "k")  # about twice docs_per_label rows, whatever the input
    calibrates = F.pmod(F.shiftright("draw", 20), F.lit(3)) == 0
    cut = sorted((r["y"], bytes(r["piece"])) for r in sample.filter(~calibrates).select("y", "t").mapInArrow(_cut, "y int, piece binary").collect())
    if len({y for y, _ in cut}) < 2:
        return nothing
    good, bad = (_dictionary([p for v, p in cut if v == y]) for y in (1, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(good, bad)
        for batch in batches:
            found = [difference(*compressors.sizes(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["y", "x"])

    held = sorted((r["y"], r["x"]) for r in sample.filter(calibrates).select("y", "t").mapInArrow(measure, "y int, x double").collect())
    y = np.array([v for v, _ in held], dtype=float)
    if len(set(y)) < 2:
        return nothing
    weights = _calibrate(np.array([[x] for _, x in held]), y)
    # the sample has as many of either kind as it could; the intercept goes back to their true shares
    weights[-1] += math.log(sizes[1] / sizes[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return QualityModel(good, bad, weights, prior)


def score(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The columns of ``df`` with ``quality_score`` (0 to 1, higher: better) added.

    Null and empty texts get the share of good documents.  Each row is scored by
    itself from its whole text; repeated rows get equal scores, an empty table gives
    an empty result, a column of this name is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    rest = [c for c in df.columns if c != "quality_score"]
    source = df.select(*rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        compressors = Compressors(own.good, own.bad) if len(own.weights) else None
        for batch in batches:
            out = [own.score((t or "").encode(), compressors) for t in batch.column(rest.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*rest, "quality_score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]
    return source.mapInArrow(run, ", ".join([*fields, "quality_score double"]))
