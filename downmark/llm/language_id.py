"""Language identification of mixed texts.

A word's script narrows the languages it may belong to, its letter trigrams score
those that remain, and Viterbi with a penalty for switching labels the spans of a
text.  The model is fitted on a bounded sample of labelled rows; every text is
read whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _ranges(kinds: str) -> str:
    """The characters of some general categories as the inside of a pattern's set."""
    out, first = [], None
    for point in range(sys.maxunicode + 2):
        inside = point <= sys.maxunicode and unicodedata.category(chr(point))[0] in kinds
        if inside and first is None:
            first = point
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{point - 1:08x}")
            first = None
    return "".join(out)


#: A word is a letter and the letters and combining marks that follow it; numbers of any kind are none.
WORD = re.compile(f"[{_ranges('L')}][{_ranges('LM')}]*")
#: Below U+0300 there are no marks, and six numbers besides the digits: a text of these is read by a simpler pattern.
_PLAIN, _BEYOND = re.compile(r"[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+"), re.compile("[\u0300-\u1fff\u2070-\u209f\u20d0-\U0010ffff]")
#: First and last code point of the scripts that tell languages apart.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),), "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),), "tamil": ((0xB80, 0xBFF),), "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "kana": ((0x3040, 0x30FF),), "han": ((0x3400, 0x9FFF),),
}
UNKNOWN = "und"
#: Characters of text handled at a time within a task, and words whose scores a worker remembers.
CHUNK_CHARS, CACHE_WORDS = 2_000_000, 600_000


def words_of(text: str) -> list[str]:
    """The words of a text in small letters."""
    small = text.lower()
    return (WORD if _BEYOND.search(small) else _PLAIN).findall(small)


def script_of(word: str) -> str:
    """The script of the first letter that has one; ``other`` if none has."""
    for c in word:
        point = ord(c)
        if point < 0x250:
            return "latin"
        for name, ranges in SCRIPTS.items():
            if any(a <= point <= b for a, b in ranges):
                return name
    return "other"


def trigrams(word: str) -> list[str]:
    edged = f"^{word}$"
    return [edged[i:i + 3] for i in range(len(edged) - 2)]


@dataclass
class LanguageModel:
    """Log probabilities of trigrams by language, and the languages of each script."""

    languages: list[str]
    rows: dict[str, int]
    table: np.ndarray
    floor: np.ndarray
    scripts: dict[str, np.ndarray]

    def score(self, words: list[str]) -> np.ndarray:
        """Scores relative to the best candidate (0), never under -12; all 0 if a word tells nothing."""
        sizes = np.array([len(w) for w in words])  # a word has as many edged trigrams as letters
        at = np.fromiter((self.rows.get(g, -1) for w in words for g in trigrams(w)), dtype=np.int64, count=int(sizes.sum()))
        known = np.concatenate([self.table, self.floor[None, :]])[at]  # -1 is the last row
        total = np.add.reduceat(known, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.float64)
        names = [script_of(w) for w in words]
        kinds = {name: i for i, name in enumerate(sorted(set(names)))}
        allowed = np.array([self.scripts.get(name, np.zeros(len(self.languages), dtype=bool)) for name in kinds])[[kinds[n] for n in names]]
        total = np.where(allowed, total, total.min(axis=1, keepdims=True) - 12.0)
        out = np.maximum(total - total.max(axis=1, keepdims=True), -12.0)
        return np.where(allowed.any(axis=1, keepdims=True), out, 0.0).astype(np.float32)

    def seen(self, words: list[str]) -> np.ndarray:
        """The share of each word's trigrams that each language has been seen to use."""
        sizes = np.array([len(w) for w in words])
        at = np.fromiter((self.rows.get(g, -1) for w in words for g in trigrams(w)), dtype=np.int64, count=int(sizes.sum()))
        used = np.concatenate([self.table > self.floor + 1e-3, np.zeros((1, len(self.languages)), bool)])[at]
        return np.add.reduceat(used, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.float32) / sizes[:, None].astype(np.float32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts by language of one partition of the sample."""
    grams: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in Counter(words_of(text)).items():
                grams[lang, "s", script_of(word)] += n
                for g in trigrams(word):
                    grams[lang, "g", g] += n
    keys = list(grams)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
         pa.array([k[2] for k in keys], pa.string()), pa.array([grams[k] for k in keys], pa.int64())], names=["lang", "kind", "item", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        docs_per_language: int = 2000, script_share: float = 0.01) -> LanguageModel:
    """Fit on about ``docs_per_language`` documents of each language, drawn by hash.

    Rows without text or language teach nothing.  The sample bound bounds the model,
    which the driver holds: distinct letter trigrams and one row per language.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).dropna(subset=["lang", "text"])
    sizes = rows.groupBy("lang").count().collect()
    shares = [(r["lang"], min(1.0, docs_per_language / r["count"])) for r in sizes]
    if not shares:
        return LanguageModel([], {}, np.zeros((0, 0), np.float32), np.zeros(0, np.float32), {})
    share = labelled.sparkSession.createDataFrame(shares, "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.lit("language"), F.col("k"), F.crc32(F.col("text").cast("binary"))), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    sample = rows.join(F.broadcast(share), "lang").filter(drawn).select("lang", "text")  # one row per language
    counted = sample.mapInArrow(_count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).toPandas()
    counted = counted.sort_values(["lang", "kind", "item"])
    languages = sorted(counted["lang"].unique())
    place = {name: i for i, name in enumerate(languages)}
    grams = counted[counted["kind"] == "g"]
    names = sorted(grams["item"].unique())
    at = {g: i for i, g in enumerate(names)}
    counts = np.zeros((len(names), len(languages)))
    counts[[at[g] for g in grams["item"]], [place[x] for x in grams["lang"]]] = grams["n"]
    mass = counts.sum(axis=0) + 0.1 * (len(names) + 1)
    table = np.log((counts + 0.1) / mass).astype(np.float32)
    scripts = {}
    seen = counted[counted["kind"] == "s"].pivot(index="item", columns="lang", values="n").reindex(columns=languages).fillna(0)
    own = seen / seen.sum(axis=0)
    for name in own.index:
        if (own.loc[name] >= script_share).any():
            scripts[name] = (own.loc[name] >= script_share).to_numpy()
    return LanguageModel(languages, at, table, np.log(0.1 / mass).astype(np.float32), scripts)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best label of every word of several texts, one step for all texts at once."""
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([scores[i] for i in order])
    n_labels = flat.shape[1]
    back = np.zeros(flat.shape, dtype=np.int16)
    best = flat[starts].astype(np.float64)
    stay = np.arange(n_labels)
    for step in range(1, int(lengths[0])):
        live = int(np.searchsorted(-lengths, -step, side="left"))  # texts with more than `step` words
        top = best[:live].argmax(axis=1)
        moved = best[np.arange(live), top] - penalty
        switch = moved[:, None] > best[:live]
        at = starts[:live] + step
        back[at] = np.where(switch, top[:, None], stay)
        best[:live] = np.where(switch, moved[:, None], best[:live]) + flat[at]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    for row, i in enumerate(order):
        steps = back[starts[row]:starts[row] + lengths[row]]
        labels = np.empty(lengths[row], dtype=np.int64)
        label = int(best[row].argmax())
        for t in range(int(lengths[row]) - 1, -1, -1):
            labels[t] = label
            label = int(steps[t, label])
        out[i] = labels
    return out


def one_language(scores: np.ndarray, starts: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The best single label of each text, and whether no path with a switch can beat it.

    A stretch of words given to another label gains at most the largest sum of score
    differences over a run of words.  With ``k`` such stretches a path pays for at
    least ``k - 1`` switches, ``k`` if it uses the best label anywhere, so gains of
    at most half a penalty never pay off.
    """
    totals = np.add.reduceat(scores, starts, axis=0, dtype=np.float64)
    best = totals.argmax(axis=1)
    sizes = np.diff(np.append(starts, len(scores)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    safe = np.ones(len(starts), dtype=bool)
    for label in range(scores.shape[1]):
        gain = scores[:, label].astype(np.float64) - scores[np.arange(len(scores)), best[owner]]
        run = np.cumsum(gain)
        before = run - gain
        low = 1.0 + np.abs(gain).sum()
        floor = np.minimum.accumulate(before - owner * 2 * low) + owner * 2 * low  # starts anew with every text
        safe &= np.maximum.reduceat(run - floor, starts) <= penalty / 2
    return best, safe


class _Words(dict):
    """Word to row of ``scores``; unseen words get the next row and wait in ``new``."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.new = model, []
        self.scores = np.zeros((1024, len(model.languages)), np.float32)
        self.fits = np.zeros_like(self.scores)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def rows(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The scores and fits of all words of several texts, one after another."""
        if len(self) > CACHE_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), dtype=np.int64)
        if self.new:
            new, self.new = self.new, []
            while len(self) > len(self.scores):
                self.scores, self.fits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.fits))
            own = slice(len(self) - len(new), len(self))
            self.scores[own], self.fits[own] = self.model.score(new), self.model.seen(new)
        return self.scores[at], self.fits[at]


def label_texts(texts: list[str | None], model: LanguageModel, penalty: float, known: _Words) -> list[list[tuple[str, int, int]]]:
    """The spans (language, first word, words) of each text; none without letters."""
    return fitted_texts(texts, model, penalty, known)[0]


def fitted_texts(texts: list[str | None], model: LanguageModel, penalty: float, known: _Words) -> tuple[list[list[tuple[str, int, int]]], list[float]]:
    """The spans of each text, and how well its words fit the languages they are given (0 to 1)."""
    found = [words_of(t) if t else [] for t in texts]
    live = [i for i, w in enumerate(found) if w]
    spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    fits = [0.0] * len(texts)
    if not live or not model.languages:
        return spans, fits
    scores, seen = known.rows([found[i] for i in live])
    sizes = np.array([len(found[i]) for i in live])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    best, safe = one_language(scores, starts, penalty)
    mixed = [j for j in range(len(live)) if not safe[j]]
    paths = dict(zip(mixed, viterbi([scores[starts[j]:starts[j] + sizes[j]] for j in mixed], penalty)))
    for j, i in enumerate(live):
        own = seen[starts[j]:starts[j] + sizes[j]]
        fits[i] = float(own[np.arange(sizes[j]), paths[j]].mean() if j in paths else own[:, best[j]].mean())
        if j not in paths:
            spans[i] = [(model.languages[best[j]], 0, int(sizes[j]))]
            continue
        cuts = np.concatenate([[0], np.nonzero(np.diff(paths[j]))[0] + 1, [sizes[j]]])
        spans[i] = [(model.languages[paths[j][a]], int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
    return spans, fits


def summary(spans: list[tuple[str, int, int]]) -> tuple[str, float]:
    """The language with most words (ties: first by name) and its share of the words."""
    if not spans:
        return UNKNOWN, 0.0
    total: Counter = Counter()
    for lang, _, n in spans:
        total[lang] += n
    lang, n = min(total.items(), key=lambda x: (-x[1], x[0]))
    return lang, n / sum(total.values())


def identify(df: DataFrame, model: LanguageModel, text: str = "text", penalty: float = 10.0) -> DataFrame:
    """The columns of ``df`` with ``lang_pred``, ``lang_score``, ``lang_fit`` and ``spans`` added.

    Spans are (language, first word, words), a word being letters with their marks.
    ``lang_score`` is the share of words that the language has; ``lang_fit`` the share of
    the words' trigrams that their languages were seen to use, so that a text of a script
    or language that was never learned has a low one, whatever it is labelled.  Null,
    empty and letterless texts are ``und`` with score 0 and no spans, and so is every
    text if nothing was learned.  Rows are labelled each by itself, so repeated rows
    get equal results; an empty table gives an empty result.  Columns of these names
    are replaced, all others stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    rest = [c for c in df.columns if c not in ("lang_pred", "lang_score", "lang_fit", "spans")]
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(shared.value)
        for batch in batches:
            first, size, texts = 0, 0, batch.column(rest.index(text)).to_pylist()
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= CHUNK_CHARS or i == len(texts) - 1:
                    spans, fits = fitted_texts(texts[first:i + 1], shared.value, penalty, known)
                    said = [summary(s) for s in spans]
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), pa.array(fits, pa.float64()),
                         pa.array([[dict(zip(("lang", "start", "words"), x)) for x in s] for s in spans], kind)],
                        names=[*rest, "lang_pred", "lang_score", "lang_fit", "spans"])
                    first, size = i + 1, 0

    source = df.select(*rest)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]
    schema = ", ".join([*fields, "lang_pred string", "lang_score double", "lang_fit double", "spans array<struct<lang:string,start:int,words:int>>"])
    return source.mapInArrow(run, schema)
