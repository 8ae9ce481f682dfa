"""Language model, token blocks, quality, language and vector search."""

import math
import struct
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from downmark.llm import language_id, language_model, quality, token_blocks, vector_search
from downmark.llm.elias_fano import Sequence, encode

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize(("n", "top"), [(1, 1), (7, 40), (100, 101), (3000, 4000), (5000, 1 << 45)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n).astype(np.uint64))
    data = memoryview(b"head" + encode(values) + encode(values[:1]))
    read = Sequence(data, 4)
    assert (read[np.arange(len(values))] == values).all()
    asked = np.concatenate([values, rng.integers(0, top + 9, 500).astype(np.uint64)])
    at = {int(v): i for i, v in enumerate(values)}
    assert read.find(asked).tolist() == [at.get(int(x), -1) for x in asked]
    assert Sequence(data, read.end)[np.array([0])][0] == values[0]


@pytest.mark.parametrize("file_tokens", [500, 10**6])
def test_language_model_as_by_hand(spark, docs, rows, file_tokens):
    """Also with many files, so that frequent contexts span several."""
    train = docs.filter("doc_id % 5 <> 1")
    trie = language_model.fit(train, file_tokens=file_tokens)
    assert (len(trie.paths) > 20) == (file_tokens == 500)
    got = language_model.score(docs, trie).collect()
    read = lambda t: [*(t or "").encode().lower().split(), b""]
    learned = [read(r[1]) for r in rows if r[0] is not None and r[0] % 5 != 1]
    c = Counter(w for t in learned for w in t)
    pairs = Counter(p for t in learned for p in zip([b"", *t], t))
    after = Counter(a for a, _ in pairs)
    total, distinct = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.5) / (total + 0.5 * (distinct + 1))
    want = {}
    for r in rows:
        t = read(r[1])
        score = 0.0
        for v, w in zip([b"", *t], t):
            score += math.log10((max(pairs[v, w] - 0.75, 0) + 0.75 * after[v] * p1(w)) / c[v] if c[v] else p1(w))
        want.setdefault((r[0], len(t), sum(w in c for w in t)), []).append((sum(math.log10(p1(w)) for w in t), score))
    assert len(got) == len(rows)
    for r in got:
        assert r["train_tokens"] == total
        near = want[r["doc_id"], r["n_tokens"], r["n_known"]]
        assert any(abs(r["base_score"] - b) < 1e-6 and abs(r["score"] - s) < 2e-4 * r["n_tokens"] for b, s in near)


def test_language_model_of_nothing(docs, empty):
    trie = language_model.fit(empty)
    assert {(r["base_score"], r["score"]) for r in language_model.score(docs, trie).collect()} == {(0.0, 0.0)}
    assert language_model.score(empty, language_model.fit(docs)).count() == 0


ODD = ["", "  a  b", "a\n\nb \nc\n", " x", "x ", "\n", "<|endoftext|> a<|endoftext|>b it's we'll 12 34", "tab\tx  y\r\nz", "日本語 テキスト", "a b 　c", "a\x1cb \x85c", "😀 😀😀 x", None]


def test_pieces_give_the_library_s_ids(rows):
    texts = [t or "" for t in [*ODD, *(r[1] for r in rows)]]
    encoder = token_blocks.PieceEncoder(VOCABULARY)
    for _ in range(2):  # once learning, once knowing
        got = encoder.encode(texts)
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [g.tolist() for g in got] == want


@pytest.mark.parametrize("kind", ["flat", "small", "odd ones", "one", "wide"])
def test_blocks_round_trip(kind):
    rng = np.random.default_rng(1)
    ids = {"flat": np.full(1024, 7), "small": rng.integers(0, 60, 1024), "odd ones": np.where(rng.random(1000) < 0.05, 2**32 - 1, rng.integers(5, 90, 1000)),
           "one": np.array([50256]), "wide": rng.integers(0, 2**32, 513)}[kind].astype(np.uint32)
    data = token_blocks.encode_block(ids)
    assert (token_blocks.decode_block(memoryview(data)) == ids).all()
    low, n, odd, width = struct.unpack_from("<IHHB", data)
    assert n == len(ids) and odd <= 0.1 * n + 1
    if kind == "odd ones":  # outliers do not widen the block
        assert width <= 7 and len(data) < 1000 + 9 + 6 * odd


def test_tokens_written_and_read(docs, rows, empty):
    manifest = token_blocks.write_tokens(docs, VOCABULARY, file_ids=3000)
    assert manifest.count() > 5
    got = sorted(token_blocks.read_tokens(manifest).collect(), key=lambda r: r["start"])
    encoder = token_blocks.PieceEncoder(VOCABULARY).tokenizer
    want = []
    for r in rows:
        ids = np.array([*encoder.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((r[0], len(ids), crc32(ids.tobytes())))
    assert Counter((r["id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(want)
    keys = [(r["id"] is not None, r["id"] or 0) for r in got]  # rows without a key come first
    assert keys == sorted(keys) and got[0]["id"] is None
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    found = [token_blocks.TokenFile(token_blocks.open_mapped(m["path"])) for m in manifest.orderBy("first").collect()]
    assert [None if i < f.keyless else int(k) for f in found for i, k in enumerate(f.keys)] == [r["id"] for r in got]
    middle = found[1]
    assert crc32(middle.document(1).astype("<u4").tobytes()) == got[len(found[0].keys) + 1]["ids_crc32"]
    assert token_blocks.read_tokens(token_blocks.write_tokens(empty, VOCABULARY)).count() == 0


def test_quality_held_out(spark, rows):
    labelled = []
    for i in range(400):
        words = (rows[i % 40][1] or "none").split()[:60]
        bad = i % 4 == 0
        labelled.append((i, " ".join(w + "###" for w in words) if bad else " ".join(words), int(not bad)))
    df = spark.createDataFrame(labelled, "doc_id long, text string, quality int")
    model = quality.fit(df, df.filter("doc_id % 3 <> 0"))
    odd = spark.createDataFrame([(1000, None, 1), (1001, "", 0), (1002, "x", 1), (None, "word " * 50000, 1)], df.schema)
    got = quality.score(df.union(odd), model).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["doc_id"] % 3 == 0]
    assert sum((r["quality_score"] >= 0.7) == (r["quality"] == 1) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["quality_score"] <= 1 for r in got) and len(got) == 404
    assert quality.fit(df, df.filter("quality = 1")).prior > 0.9
    assert {r["quality_score"] for r in quality.score(df, quality.fit(df, df.limit(0))).collect()} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0


def test_languages_and_spans(spark, docs, rows, empty):
    model = language_id.fit(docs.filter("doc_id % 3 <> 1 OR doc_id IS NULL"))
    assert model.languages == ["de", "en"]
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows)
    letters = [r for r in got if r["text"] and any(c.isalpha() for c in r["text"])]
    assert all((r["lang_pred"] == "und") == (r not in letters) for r in got)
    known = [r for r in letters if r["lang"] is not None]
    assert sum(r["lang_pred"] == r["lang"] for r in known) >= 0.97 * len(known)
    one, two = rows[16][1], rows[15][1]
    mixed = spark.createDataFrame([(f"{one} {two}",), ("Жизнь",), (None,)], "text string")
    spans = language_id.identify(mixed, model).collect()
    assert [s["lang"] for s in spans[0]["spans"]] == ["en", "de"]
    assert abs(spans[0]["spans"][0]["words"] - len(language_id.WORD.findall(one))) <= 8
    assert spans[2]["lang_pred"] == "und" and spans[2]["spans"] == []
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(empty)).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_viterbi_as_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    texts = [rng.normal(0, 3, (n, 3)).astype(np.float32) for n in (1, 4, 6, 7)]
    starts = np.cumsum([0, 1, 4, 6])
    for penalty in (0.0, 2.0, 30.0):
        total = lambda s, p: sum(s[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        top = [max(total(s, p) for p in product(range(3), repeat=len(s))) for s in texts]
        for s, labels, best in zip(texts, language_id.viterbi(texts, penalty), top):
            assert total(s, labels.tolist()) == pytest.approx(best, abs=1e-4)
        label, safe = language_id.one_language(np.concatenate(texts), starts, penalty)
        for s, x, sure, best in zip(texts, label, safe, top):
            assert not sure or total(s, [int(x)] * len(s)) == pytest.approx(best, abs=1e-4)


@pytest.mark.parametrize("block", [30, 4096])
def test_top_k_as_by_brute_force(spark, block):
    rng = np.random.default_rng(block)
    base = rng.normal(0, 0.3, (300, 8)) * rng.choice([0.2, 1, 3], (300, 1))
    base[50:150] = base[50]  # a very common vector: many ties
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    vectors += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (404, [float("inf")] * 8), (405, [1.0, 2.0]), (None, [1.0] * 8), (410, [0.0] * 8)]
    df = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<double>, id int, block int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vector_search.top_k(df, F.col("vec_id") % 10 == 0, 5, block=block, query_block=13, head=3).collect()}
    whole = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in whole:
        if q % 10 == 0:
            scores = sorted((-int(whole[q] @ whole[x]), x) for x in whole if x != q and len(whole[x]) == len(whole[q]))
            want |= {(q, k + 1): (x, -s) for k, (s, x) in enumerate(scores[:5])}
    assert got == want
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.fixture(scope="module")
def two_languages(spark):
    rows = [(i, "the house of the nation and the morning", "en") if i % 2 else (i, "la maison de la nation et le matin", "fr") for i in range(40)]
    return language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_numbers_are_no_letters_and_marks_join_words(spark, two_languages):
    texts = ["\u00bd", "\u00b2", "\u2460 \u2461", "\u2167", "12 34", "\u0301", "la maison", "\u0939\u093f\u0928\u094d\u0926\u0940"]
    got = {r["text"]: r for r in language_id.identify(spark.createDataFrame([(t,) for t in texts], "text string"), two_languages).collect()}
    assert [got[t]["lang_pred"] for t in texts[:6]] == ["und"] * 6 and got["la maison"]["lang_pred"] == "fr"
    assert language_id.WORD.findall(texts[7]) == [texts[7]]


def test_unlearned_scripts_and_languages_fit_badly(spark, two_languages):
    texts = ["\u0416\u0438\u0437\u043d\u044c \u044d\u0442\u043e", "xyzzy qwrtp zzgkw", "the house of the morning", None]
    got = {r["text"]: r for r in language_id.identify(spark.createDataFrame([(t,) for t in texts], "text string"), two_languages).collect()}
    assert got[texts[0]]["lang_fit"] == 0 and got[texts[1]]["lang_fit"] < 0.3 and got[texts[2]]["lang_fit"] > 0.9 and got[None]["lang_fit"] == 0
    assert got[texts[0]]["lang_pred"] in ("en", "fr")


@pytest.mark.parametrize("scale", [3e7, 1e19, 1e37])
def test_large_vectors_take_part(spark, scale):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (60, 8)).astype(float) * scale
    vectors[::7] /= scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.top_k(df, F.col("vec_id") % 5 == 0, k=3, block=8, query_block=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [[int(np.floor(256 * x)) for x in v] for v in vectors]
    for q in range(0, 60, 5):
        dots = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], whole[c])))), c) for c in range(60) if c != q]
        assert sorted(got[q]) == [(k, c, -s) for k, (s, c) in enumerate(sorted(dots)[:3], 1)]
