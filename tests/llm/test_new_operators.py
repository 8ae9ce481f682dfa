"""License scan, spelling variants and collocations, against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from downmark.llm import collocations, license_scan, spelling

A = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- license scan -----------------------------------------------------------------------------------------------

LICENSED = [
    (1, "Licensed under CC BY-NC 4.0."), (2, "x MIT  License, mit-license"), (3, "This work is licensed under the GNU General Public License, version 3."),
    (4, "SPDX-License-Identifier: GPL-3.0-or-later"), (5, "permit licenses of a submit license"), (6, None), (7, ""), (8, " \n.,!"),
    (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"),
    (10, "é mit license é GNU General\nPublic License"), (11, "word " * 5000 + "Apache License, Version 2.0 " * 50), (None, "apache license"), (2, "x MIT  License, mit-license"),
    (12, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


@pytest.fixture(scope="module")
def licensed(spark):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in LICENSED], "doc_id long, text string, found int, n_words string")


def test_base_phrases_as_by_brute_force(licensed):
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan.summary(licensed).collect())
    want = Counter()
    for k, t in LICENSED:
        n, places = base_places(t)
        want[(k, n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places})))] += 1
    assert got == want


def test_labels_of_rules(licensed):
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.summary(licensed).collect()}
    assert got[1][0] == "cc-by,cc-by-nc-4.0" and got[3][0] == "gpl,gpl-3.0" and got[4][0] == "gpl-3.0-or-later"
    assert got[5] == ("", 0.0) and got[6] == ("", 0.0) and got[9][0] == "mit" and got[11][0] == "apache,apache-2.0" and got[12][0] == "bsd"
    assert all(0 <= s <= 1 for _, s in got.values()) and got[1][1] > 0.9


def test_every_rule_runs_as_without_the_prefilter_and_resolves_as_by_definition():
    rules = license_scan.parse()
    assert len(rules) > 250 and len({r.number for r in rules}) == len(rules)
    rng = np.random.default_rng(0)
    bits = "spdx license identifier mit gpl 2 0 or later gnu general public license version 3 cc by nc sa 4 0 apache licence under the terms of licensed bsd clause creative commons mozilla x".split()
    texts = [" ".join(rng.choice(bits, 300)) for _ in range(20)] + [(t or "") for _, t in LICENSED]
    for t in texts:
        n, found = license_scan.detect(t.encode(), rules)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(A))
        line, all_ = " " + " ".join(words) + " ", []
        for rule in rules:
            for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", line):
                all_.append((line[:m.start()].count(" ") - 1, line[:m.end()].count(" "), rule.number))
        assert n == len(words) and sorted(all_) == sorted((f["start"], f["stop"], f["rule"]) for f in found)
        place = lambda f: (-f["priority"], f["start"] - f["stop"], f["start"], f["rule"])
        for f in found:
            covers = any(g is not f and g["start"] <= f["start"] and f["stop"] <= g["stop"] and place(g) < place(f) for g in found)
            assert f["kept"] == (not covers)


def test_rules_are_a_parameter(spark):
    rules = license_scan.parse("= odd\n3 | odd | an odd W\n", base=())
    df = spark.createDataFrame([(1, "It is an ODD one, an odd two"), (2, "odd")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["label"], s["start"], s["stop"]) for s in r["found"]] for r in license_scan.scan(df, rules=rules).collect()}
    assert got == {1: [("odd", 2, 5), ("odd", 5, 8)], 2: []}
    assert license_scan.scan(df.limit(0)).count() == 0


# --- spelling variants ------------------------------------------------------------------------------------------


def slow_vocabulary(rows, noise=31, length=7, least=2):
    counts = Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(A)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if noise and h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_variants(rows, **options):
    counts = slow_vocabulary(rows, **options)
    near = {w: [v for v in counts if v != w and edit_one(v, w)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def spelled(seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdeéöß")
    stems = ["".join(rng.choice(letters, int(rng.integers(6, 11)))) for _ in range(60)]
    stems += [stems[0][::-1], "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Übermut", "übermut", "naïvetés", "a" * 400, "a" * 401, "a" * 400 + "b"]
    rows = []
    for d in range(60):
        words = []
        for _ in range(int(rng.integers(0, 120))):
            w = stems[min(len(stems) - 1, int(rng.zipf(1.4)) - 1)]
            if rng.random() < 0.15:
                i = int(rng.integers(0, len(w)))
                w = (w[:i] + w[i + 1:], w[:i] + "e" + w[i:], w[:i] + "c" + w[i + 1:])[int(rng.integers(0, 3))]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, " ".join(words)))
    return rows + [(None, " ".join(stems)), (3, rows[3][1]), (70, None), (71, ""), (72, "12 ??")]


@pytest.mark.parametrize(("cell", "sample"), [(32_768, 131_072), (40, 131_072), (40, 60)])
def test_variants_as_by_brute_force(spark, cell, sample):
    rows = spelled(4)
    df = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "doc_id long, text string, n int, cell int, word string").repartition(3)
    got = {tuple(r) for r in spelling.variants(df, cell_words=cell, sample=sample).collect()}
    want = slow_variants(rows)
    assert len(want) > 120 and sum(w[1] is not None for w in want) > 20 and sum(w[4] for w in want) > 150
    assert got == want


def test_balls_meet_their_cells():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 9, (2000, spelling.DIMENSIONS)).astype(np.int32)
    points[:, 3:] = 0  # few axes, so that planes cut the same ones again and again
    planes = spelling.Planes(points, 50, 7)
    home = dict(zip(*(x.tolist() for x in planes.place(points, 0))))
    assert len(home) == len(points) and min(home.values()) >= 7
    rows, cells = planes.place(points[:200], 2)
    meets = defaultdict(set)
    for r, c in zip(rows.tolist(), cells.tolist()):
        meets[r].add(c)
    for i in range(200):
        assert meets[i] >= {home[j] for j in np.flatnonzero(np.abs(points - points[i]).sum(axis=1) <= 2).tolist()}


def test_no_words_no_rows(spark, empty):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string")).count() == 0


# --- collocations -----------------------------------------------------------------------------------------------


def slow_collocations(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(A)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i:i + size])] += 1
    out = []
    for lang, found in counts.items():
        cand = {p: a for p, a in found.items() if 2 <= len(p) and a >= least}
        kept = []
        for p, a in cand.items():
            inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and b >= a and inside(q) for q, b in cand.items()):
                continue
            cuts = [(int(Fraction(1000 * a * totals[lang], found[p[:j]] * found[p[j:]])), j) for j in range(1, len(p))]
            score, j = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), found[p[:j]], found[p[j:]]))
        for r, (s, a, p, l, rr) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, r, p.decode(), -a, l, rr, totals[lang], -s))
    return sorted(out)


def phrased(seed, n=150):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = []
        for _ in range(int(rng.integers(0, 60))):
            words.append(("to be or not to be", "New York", "of the", "b", "c", "d,", "e.", "f\tg", "h\x0bx", "so\xa0on", "é")[int(rng.integers(0, 11))])
        rows.append((("en", "de", None)[i % 3], " ".join(words)))
    return rows + [("en", None), ("en", ""), ("en", " .,;"), ("de", "b " * 3000), rows[0], ("fr", "one word")]


@pytest.mark.parametrize("shard_words", [1 << 21, 97])
def test_collocations_as_by_brute_force(spark, shard_words, monkeypatch):
    rows = phrased(6)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, text string, count int, number int, start string").repartition(4)
    if shard_words < 1000:  # many buckets too
        monkeypatch.setattr(collocations.frequent_phrases, "__defaults__", (*collocations.frequent_phrases.__defaults__[:-2], 500, 50))
    for least, top in ((5, 2000), (12, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(df, min_count=least, top=top, shard_words=shard_words).collect())
        want = slow_collocations(rows, least, 5, top)
        assert len(want) > 15 and got == want


def test_index_answers_as_the_text_does():
    rng = np.random.default_rng(7)
    ids = np.concatenate([np.append(rng.integers(1, 4, int(rng.integers(1, 40))), 0) for _ in range(30)]).astype(np.int32)
    tail = lambda i: [(0, j) if x == 0 else (1, int(x)) for j, x in enumerate(ids[i:], i)]
    order = collocations.suffix_order(ids)
    assert order.tolist() == sorted(range(len(ids)), key=tail)
    index = collocations.Index(collocations.transform(ids))
    starts, sizes = index.words()
    text = ids.tolist()
    for phrase in ([1], [2, 3], [1, 1, 2], [3, 2, 1, 1], [3] * 9):
        lo, hi = int(starts[phrase[-1] - 1]), int(starts[phrase[-1] - 1] + sizes[phrase[-1] - 1])
        for w in reversed(phrase[:-1]):
            lo, hi = index.before(w, lo, hi)
        assert hi - lo == sum(text[i:i + len(phrase)] == phrase for i in range(len(text)))


def test_scores_are_exact_over_64_bits(spark):
    a, n, l, r = 7_777_777_777, 9_999_999_999_999, 8_888_888_888, 99_999_999_999
    got = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").select(collocations.floor_ratio(*(spark_col(c) for c in "anlr"))).first()[0]
    assert got == 1000 * a * n // (l * r)


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_buckets_answer_a_shard_in_one_row():
    """What goes back to the shards grows with buckets and shards, not with words and pairs."""
    zip_ = zstandard.ZstdCompressor().compress
    words = pa.RecordBatch.from_pylist([{"bucket": 3, "shard": s, "lang": "en", "words": zip_(b"a\nb\nc"), "blob": collocations.pack(np.array([0, 7, 9]), np.array([7, 2, 5]))} for s in (11, 12)])
    grams = pa.RecordBatch.from_pylist([{"bucket": 3, "shard": s, "blob": collocations.pack(np.array([4, 2, 3]), np.array([7, 2, 5]), np.array([1, 1, 2]), np.array([1, 2, 2]))} for s in (11, 12)])
    for step, batch, starts in ((collocations._frequent_words(10), words, [0, 9]), (collocations._frequent_grams(10), grams, [4, 9])):
        rows = [r for out in step(iter([batch])) for r in out.to_pylist()]
        back = [r for r in rows if r["kind"] == 2]
        assert [r["shard"] for r in back] == [11, 12] and sum(r["kind"] == 1 for r in rows) == 2
        for r in back:
            gap, size, number = collocations.unpack(r["blob"], 3)
            assert np.cumsum(gap).tolist() == starts and size.tolist() == [7, 5] and number.tolist() == [3 << 32, (3 << 32) + 1]


def test_nothing_to_mine(empty):
    assert collocations.collocations(empty).count() == 0
