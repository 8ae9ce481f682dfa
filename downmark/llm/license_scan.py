"""License scan by ordered signature rules.

A text is read as lower-case words with one space between them.  One pass of an
Aho-Corasick automaton over it finds which keywords it holds, and only the rules all of
whose keywords are there run their patterns.  Detections are then resolved: one goes if
its interval lies inside that of another of higher priority, or of the same priority and
longer, or the same and written earlier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE, RULES, W

#: A word is a run of letters, digits and characters outside ASCII; on UTF-8 the bytes of the latter are all over 7F.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: What a detection says for its label, by priority.
CONFIDENCE = {1: 0.3, 2: 0.6, 3: 0.8, 4: 0.95, 5: 0.99}
BASE_PRIORITY = 2
SPAN = "array<struct<label:string,rule:int,start:bigint,stop:bigint,priority:int,base:boolean,kept:boolean>>"


@dataclass(frozen=True)
class Rule:
    """One signature: its place in the order, label, priority, keywords and pattern over words."""

    number: int
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str
    base: bool = False


def parse(text: str = RULES, base: Sequence[tuple[str, str]] = BASE) -> tuple[Rule, ...]:
    """The base phrases and then the rules of ``text``, in the order written."""
    out = [Rule(i, label, BASE_PRIORITY, (max(phrase.split(), key=len),), re.escape(phrase), True) for i, (label, phrase) in enumerate(base)]
    label = None
    for line in text.splitlines():
        if line.startswith("="):
            label = line[1:].strip()
        elif line.strip():
            priority, keywords, pattern = (part.strip() for part in line.split("|", 2))
            out.append(Rule(len(out), label, int(priority), tuple(keywords.split("+")), re.sub(r"\bW\b", W, pattern)))
    return tuple(out)


@lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]):
    """The automaton over all keywords, and each rule's pattern between word edges."""
    numbers = {}
    for rule in rules:
        for word in rule.keywords:
            numbers.setdefault(word, len(numbers))
    automaton = ahocorasick.Automaton()
    for word, n in numbers.items():
        automaton.add_word(word, n)
    automaton.make_automaton()
    needs = [frozenset(numbers[w] for w in rule.keywords) for rule in rules]
    patterns = [re.compile(rb"(?<= )(?:" + rule.pattern.encode() + rb")(?= )") for rule in rules]
    return automaton, needs, patterns, len(numbers)


def contained(kept: tuple[np.ndarray, np.ndarray], start: int, stop: int) -> bool:
    """Whether an interval lies in one of those given as sorted starts and the largest stop up to each."""
    at = int(np.searchsorted(kept[0], start, "right")) - 1
    return at >= 0 and int(kept[1][at]) >= stop


def resolve(found: list[tuple[int, int, int, int]]) -> list[bool]:
    """Which of the detections (start, stop, priority, rule) stay, by priority and containment."""
    stay = [False] * len(found)
    kept = (np.empty(0, np.int64), np.empty(0, np.int64))
    for priority in sorted({f[2] for f in found}, reverse=True):
        level = sorted((i for i, f in enumerate(found) if f[2] == priority), key=lambda i: (found[i][0], -found[i][1], found[i][3]))
        reach = -1
        for i in level:
            start, stop = found[i][:2]
            stay[i] = stop > reach and not contained(kept, start, stop)
            reach = max(reach, stop)
        spans = sorted(found[i][:2] for i in range(len(found)) if stay[i])
        kept = (np.array([s for s, _ in spans], np.int64), np.maximum.accumulate(np.array([e for _, e in spans], np.int64)) if spans else np.empty(0, np.int64))
    return stay


def detect(text: bytes | None, rules: tuple[Rule, ...]) -> tuple[int, list[dict]]:
    """The number of words of a text, and all detections in the order of their places."""
    words = WORD.findall((text or b"").lower())
    automaton, needs, patterns, n_keywords = _compiled(rules)
    line = b" " + b" ".join(words) + b" "
    seen = set()
    for _, n in automaton.iter(line.decode("latin-1")):
        seen.add(n)
        if len(seen) == n_keywords:
            break
    found = []
    if seen:
        gaps = None
        for rule, need, pattern in zip(rules, needs, patterns):
            if need <= seen:
                for m in pattern.finditer(line):
                    if gaps is None:
                        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                    # the word after the k-th gap is word k
                    found.append((int(np.searchsorted(gaps, m.start())) - 1, int(np.searchsorted(gaps, m.end())), rule.priority, rule.number))
    found.sort(key=lambda f: (f[0], f[1], f[3]))
    by_number = {r.number: r for r in rules}
    spans = [{"label": by_number[f[3]].label, "rule": f[3], "start": f[0], "stop": f[1], "priority": f[2], "base": by_number[f[3]].base, "kept": k}
             for f, k in zip(found, resolve(found))]
    return len(words), spans


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """key, ``n_words`` and ``found``: every detection (label, rule, start, stop, priority, base, kept) of every row.

    Places count words from 0, ``stop`` is the word after the last.  Detections that
    another one covers have ``kept`` false; those of the base phrases are reported like
    all others.  Null texts are empty; empty texts and those without words have none.
    Repeated rows each get a row, null keys stay, an empty table gives an empty result,
    and other columns are not read.
    """
    given = tuple(rules) if rules is not None else parse()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [detect(t.as_py(), given) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], _SPANS)],
                                             names=["id", "n_words", "found"])

    source = df.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_words bigint, found {SPAN}")
    return out.withColumnRenamed("id", key)


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("priority", pa.int32()), ("base", pa.bool_()), ("kept", pa.bool_())]))


def joined_labels(spans: Column) -> Column:
    """The distinct labels of some detections, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def certainty(spans: Column) -> Column:
    """0 to 1: how sure it is that the text states a license, taking kept detections as independent."""
    weight = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    missed = F.aggregate(F.filter(spans, lambda s: s["kept"]), F.lit(1.0), lambda p, s: p * (1.0 - weight[s["priority"]]))
    return 1.0 - missed


def summary(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per row of ``df``: words, places of base phrases, labels and score; see ``scan``."""
    base = F.filter("found", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    return scan(df, key, text, rules).select(
        key, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined_labels(base).alias("base_labels"), joined_labels(F.filter("found", lambda s: s["base"] | s["kept"])).alias("labels"),
        certainty(F.col("found")).alias("score"))
