"""SimHash near-duplicates, components and decontamination, against brute force."""

import os
from collections import Counter

import numpy as np
import pytest
import xxhash

from downmark.llm import components, decontaminate, near_dup


def slow_fingerprint(text, size):
    """The rule of the fingerprint, word by word."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, near):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def shared(a, b, size=5):
    """Shared shingles over all shingles of two texts, repeats counted."""
    bags = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        bags.append(Counter(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter())
    whole = sum((bags[0] | bags[1]).values())
    return sum((bags[0] & bags[1]).values()) / whole if whole else 1.0


def test_fingerprints_and_components(docs, rows):
    got = near_dup.near_duplicates(docs, shingle=4, radius=4).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(r[1], 4) for r in rows]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((r[0], f"{f:016x}") for r, f in zip(rows, fps))
    tops = slow_components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[tops[f]] = min(least.get(tops[f], r[0]), r[0])
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((r[0], least.get(tops[f])) for r, f in zip(rows, fps))


@pytest.mark.parametrize(("radius", "cell"), [(0, 4096), (3, 4096), (4, 6), (5, 4096), (9, 20), (9, 4096)])
def test_every_link_is_found(spark, radius, cell, monkeypatch):
    rng = np.random.default_rng(radius)
    centres = rng.integers(-(1 << 63), 1 << 63, 12)
    fps = []
    for c in centres:  # groups of two to many around a centre, some bits changed
        for _ in range(int(rng.integers(2, 60))):
            flips = rng.choice(64, int(rng.integers(0, 9)), replace=False)
            fps.append(int(c) ^ (sum(1 << int(b) for b in flips) - (1 << 64) * (63 in flips)))
    fps = sorted(set(fps))
    monkeypatch.setattr(near_dup, "SMALL", 20)
    df = spark.createDataFrame([(f, f) for f in fps], "fp long, node long")
    got = components.roots(near_dup.near_links(df, radius, cell).mapInArrow(components.contract, "a long, b long")).collect()
    want = slow_components(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius)
    assert {(r["a"], r["b"]) for r in got} == {(n, t) for n, t in want.items() if n != t}


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = components.roots(spark.createDataFrame([*path, *star, (5, 5)], "a long, b long")).collect()
    assert {(r["a"], r["b"]) for r in got} == {(i, 0) for i in range(1, 61)} | {(1000 + i, 1000) for i in range(1, 300)}


def test_one_of_each_group_stays(docs, rows):
    got = near_dup.distinct_texts(docs)
    assert got.columns == docs.columns
    kept = Counter(tuple(r) for r in got.collect())
    texts = sorted({r[1] or "" for r in rows})
    tops = slow_components(range(len(texts)), lambda a, b: shared(texts[a], texts[b]) >= 0.8)
    group = {t: tops[i] for i, t in enumerate(texts)}
    least = {}
    for r in rows:
        place = (r[0] is None, r[0] or 0)
        least[group[r[1] or ""]] = min(least.get(group[r[1] or ""], place), place)
    assert len(kept) == len(least) == sum(kept.values())
    assert {(r[0] is None, r[0] or 0, group[r[1] or ""]) for r in kept} == {(*p, g) for g, p in least.items()}
    assert set(kept) <= set(rows)


def edited(rng, words, n, tag):
    """The words with ``n`` of them changed, far enough apart that no shingle loses two."""
    out, step = list(words), len(words) // n
    for k in range(n):
        out[k * step + int(rng.integers(4, step - 5))] = f"{tag}x{k}"
    return out


def test_every_pair_at_the_threshold_is_found(spark):
    rng, texts = np.random.default_rng(1), []
    for p in range(80):
        n = (60, 300)[p % 2]
        words = [f"w{i}" for i in rng.integers(0, 5000, n)]
        texts += [" ".join(words), " ".join(edited(rng, words, n // 50, f"e{p}"))]
    assert all(0.8 <= shared(a, b) < 0.86 for a, b in zip(texts[::2], texts[1::2]))
    kept = near_dup.distinct_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] // 2 for r in kept) == list(range(80))


@pytest.mark.parametrize(("copies", "cell"), [(60, 4096), (60, 16)])
def test_copies_of_one_original_go(spark, copies, cell):
    """Each copy is near the original, and no two copies are near each other; small cells cut the listings."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    texts = [" ".join(edited(rng, words, 6, f"c{k}")) for k in range(copies)] + [" ".join(words)]
    assert all(shared(texts[-1], t) >= 0.8 for t in texts) and shared(texts[1], texts[2]) < 0.8
    kept = near_dup.distinct_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), cell=cell).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_variants_give_the_first_links(spark, monkeypatch):
    """The links of the fingerprints' deletion variants come first; other texts are found by their shingles."""
    rng, found, links = np.random.default_rng(4), [], near_dup.near_links

    def spied(*args, **kwargs):
        found.append(near_dup.keep(links(*args, **kwargs), "spied"))
        return found[-1]

    monkeypatch.setattr(near_dup, "near_links", spied)
    texts = []
    for p in range(6):
        words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
        texts += [" ".join(words), " ".join(edited(rng, words, 1 if p % 2 else 8, f"e{p}"))]
    kept = near_dup.distinct_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 12, 2))
    assert len(found) == 1 and found[0].filter("a <> b").count() >= 2


@pytest.mark.parametrize("cell", [4096, 8])
def test_chains_and_boilerplate_as_by_brute_force(spark, cell):
    """Texts that drift apart link by link, and unlike texts that share most of their words."""
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"n{i}" for i in rng.integers(0, 10**9, n)]
    common, texts = fresh(160), []
    for _ in range(14):  # boilerplate with 20 words of their own: some pairs near 0.8
        texts.append(" ".join([*common, *fresh(int(rng.integers(8, 60)))]))
    drift = fresh(100)
    for _ in range(12):
        at = int(rng.integers(0, 96))
        drift = [*drift[:at], *fresh(3), *drift[at + 3:]]
        texts.append(" ".join(drift))
    texts += ["", "   ", None, "one two", "one two", "one two three four five six"]
    own = [t or "" for t in texts]
    tops = slow_components(range(len(own)), lambda a, b: own[a] == own[b] or shared(own[a], own[b]) >= 0.8)
    kept = near_dup.distinct_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), cell=cell).collect()
    assert {r["doc_id"] for r in kept} == set(tops.values())


def test_a_round_compares_a_component_with_one_other(spark):
    """Listings with other first texts each gave a pair for every text and listing; now a component has one pair a round."""
    rows = spark.createDataFrame([(b, n, 5, n) for b in range(15) for n in range(b + 1, 21)], "bucket long, node long, listed long, top long")
    tested, rounds = set(), []
    for _ in range(3):
        known = spark.createDataFrame(sorted(tested), "a long, b long")
        rounds.append({tuple(r) for r in near_dup._stars(rows, known).collect()})
        assert 1 < len(rounds[-1]) <= 20 and not rounds[-1] & tested
        tested |= rounds[-1]
    assert tested <= {(b + 1, n) for b in range(15) for n in range(b + 2, 21)}


def test_parities_leave_out_unlike_texts_and_no_link():
    rng = np.random.default_rng(6)
    share = near_dup.differing(0.8)
    for n in (1, 10, 300, 5000):
        one = rng.integers(0, 2**64, n, dtype=np.uint64)
        for k in (0, 1, n // 9, n // 2):
            two = one.copy()
            two[:k] = rng.integers(0, 2**64, k, dtype=np.uint64)
            assert near_dup._apart(near_dup.parities(one), near_dup.parities(two)) <= 2 * k
    one, two = (rng.integers(0, 2**64, 300, dtype=np.uint64) for _ in range(2))
    two[:150] = one[:150]
    assert near_dup._apart(near_dup.parities(one), near_dup.parities(two)) > share * 600


def test_working_tables_go(spark, docs, monkeypatch):
    """Only what the result still reads is left in the shared folder."""
    made, write = {}, near_dup.keep

    def spied(df, name, rows=None):
        out = write(df, name, rows)
        made[out._kept_at.removeprefix("file:")] = name
        return out

    for module in (near_dup, components):
        monkeypatch.setattr(module, "keep", spied)
    assert near_dup.distinct_texts(docs).count()
    assert {"sketches", "met", "marks", "stay"} <= set(made.values())
    assert {name for path, name in made.items() if os.path.exists(path)} <= {"stay", "crowded"}


def test_columns_may_have_the_names_of_working_ones(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", 1, 2, 3, 4, 5, 6), (2, "a b c d e f g", 1, 2, 3, 4, 5, 6)], "doc_id long, text string, node int, stays int, stay_key int, _node int, _least int, top int")
    assert [tuple(r) for r in near_dup.distinct_texts(df).collect()] == [(1, "a b c d e f g", 1, 2, 3, 4, 5, 6)]


def test_rarest_first_is_one_order(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k, k + 30)),) for k in range(40)], "text string")
    ranks = near_dup.rarity(df, 5)
    assert len(ranks) == near_dup.SLOTS and ranks.max() == int(8 * np.log2(1 + 26))
    hashes = near_dup.shingle_hashes("rare words come first " + " ".join(f"w{i}" for i in range(20, 50)), 5)
    first = near_dup.rare_first(hashes, ranks, 0.8)
    rank = {int(h): int(ranks[near_dup._slots(np.array([h], np.uint64))[0]]) for h in hashes}
    assert len(first) == near_dup.prefix_length(len(hashes), 0.8)
    assert max(rank[int(h)] for h in first) <= min(rank[int(h)] for h in hashes if h not in set(first))


def test_nothing_in_nothing_out(empty):
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.distinct_texts(empty).count() == 0


@pytest.fixture(scope="module")
def leaks(spark, rows):
    """Items, and documents that hold them whole, changed, at an edge, twice or not at all."""
    long, short = rows[30][1].split()[:40], rows[30][1].split()[100:112]
    items = [(0, " ".join(long)), (1, " ".join(short)), (2, "four words and end"), (3, None), (4, ""), (5, " ".join(long[:20] * 2)), (5, " ".join(long[:20] * 2))]
    changed = list(long)
    changed[1] = "otherwise"
    docs = [(100, " ".join(["before", *long, "after"])), (101, " ".join(long).upper()), (102, " ".join(["x"] * 5 + changed)), (103, " ".join(short[:11])),
            (104, " ".join([*long, "and", *long])), (105, None), (106, ""), (107, " ".join(long[:9])), (None, " ".join(short)), (108, "four words and end"),
            (100, "clean text under the same number, with more than five words"), (100, " ".join(["before", *long, "after"]))]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_leaks_as_by_brute_force(leaks):
    docs, items, doc_rows, item_rows = leaks
    got = {(r["id"], r["item"], r["start"], round(r["similarity"], 9)) for r in decontaminate.find(docs, items).collect()}
    want = set()
    for d, t in doc_rows:
        w = (t or "").split()
        for i, u in set(item_rows):
            n = len((u or "").split())
            if n < 5 or len(w) < 5:
                continue
            windows = [(shared(" ".join(w[s:s + n]), u), -s) for s in range(max(1, len(w) - n + 1))]
            best, back = max(windows)
            if best >= 0.8:
                want.add((d, i, -back, round(best, 9)))
    assert got == want
    assert {(d, i) for d, i, _, _ in got} >= {(100, 0), (101, 0), (102, 0), (103, 1), (104, 0), (None, 1)}


def test_reordered_passages_are_leaks(spark):
    """No window in line with a shingle holds both halves of an item that are swapped."""
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rows, items = [], []
    for k, n in enumerate((50, 59)):
        item = words(f"i{k}", n)
        items.append((k, " ".join(item)))
        rows.append((k, " ".join([*words("a", 100), *item[n // 2:], *item[:n // 2], *words("b", 100)])))
        rows.append((10 + k, " ".join([*words("a", 100), *item[n // 2:], *words("c", 20), *item[:n // 2]])))
    got = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(k, k, 100): shared(" ".join(rows[2 * k][1].split()[100:100 + n]), items[k][1]) for k, n in enumerate((50, 59))}
    assert {(r["id"], r["item"], r["start"]): r["similarity"] for r in got} == pytest.approx(want)


def test_clean_rows_stay(leaks, spark):
    docs, items, _, _ = leaks
    kept = {(r["doc_id"], r["text"]) for r in decontaminate.clean(docs, items).collect()}
    assert {d for d, _ in kept} == {105, 106, 107, 108, 100}
    assert [t for d, t in kept if d == 100] == ["clean text under the same number, with more than five words"]
    assert decontaminate.find(docs.limit(0), items).count() == 0 and decontaminate.find(docs, items.limit(0)).count() == 0
