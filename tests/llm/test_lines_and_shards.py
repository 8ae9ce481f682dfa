"""Line dedup, sharding and mixture."""

from collections import Counter, defaultdict
from zlib import crc32

from downmark.llm import line_dedup, mixture, sharding
from downmark.llm.queries import LEVELS, WEIGHTS, with_domain

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_lines_as_by_hand(docs, rows):
    docs_of = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if r[0] is not None and len(key(line)) >= 40:
                docs_of[key(line)].add(r[0])
    expected = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(docs_of.get(key(x), ())) < 5 or r[0] is None or r[0] == max(docs_of[key(x)])]
        expected[r[0], "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == expected
    assert sum(k[3] for k in got) == 6  # seven documents share the line, the last keeps it


def test_lines_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def test_shards_are_even_and_gapless(docs, rows):
    got = sharding.shard_records(docs, 4).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 8, crc32((r[1] or "").encode())) for r in rows)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shards_come_near_in_bytes(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "repeat('x', cast(id % 300 AS int)) AS text")
    loads = [r[0] for r in sharding.shard_records(df, 24).groupBy("shard").sum("size").select("sum(size)").collect()]
    assert max(loads) - min(loads) < 0.01 * max(loads)


def test_growing_only_fills_the_new_shard(spark, tmp_path):
    weights = {i: 50 + i % 17 for i in range(sharding.SLOTS)}
    old = sharding.new_map(weights, 24)
    new = sharding.grow(old, weights)
    assert all(b in (a, 24) for a, b in zip(old.shard_of, new.shard_of))
    load = Counter()
    for slot, shard in enumerate(new.shard_of):
        load[shard] += weights[slot]
    assert max(load.values()) < 1.03 * min(load.values())
    path = str(tmp_path / "map")
    old.write(spark, path)
    new.write(spark, path)
    assert sharding.SlotMap.read(spark, path) == new and sharding.SlotMap.read(spark, path, 1) == old


def test_the_stored_map_decides_and_is_edited_when_bytes_change(docs, spark, tmp_path):
    history = str(tmp_path / "history")
    first = sharding.shard_records(docs, 4, slots=64, history=history).collect()
    stored = sharding.SlotMap.read(spark, history)
    assert stored.version == 1 and all(stored.shard_of[r["vslot"]] == r["shard"] and r["map_version"] == 1 for r in first)
    again = sharding.shard_records(docs, 4, slots=64, history=history).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, first), key=str)
    uneven = sharding.SlotMap(7, 4, tuple(0 for _ in range(64)))
    uneven.write(spark, history)
    edited = sharding.shard_records(docs, 4, slots=64, history=history).collect()
    assert {r["map_version"] for r in edited} == {8} and len({r["shard"] for r in edited}) == 4
    assert sharding.SlotMap.read(spark, history, 7) == uneven
    even = sharding.rebalanced(sharding.SlotMap(1, 2, (0, 0, 0, 0, 1)), {0: 5, 1: 5, 2: 5, 3: 5, 4: 2})
    assert even.version == 2 and sorted((sum(w for w, s in zip((5, 5, 5, 5, 2), even.shard_of) if s == k)) for k in (0, 1)) == [10, 12]


def test_a_row_repeated_very_often(spark):
    df = spark.createDataFrame([(7, "same")] * 5000 + [(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    got = sharding.shard_records(df, 3).collect()
    for shard in range(3):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert len(got) == 5100


def test_shards_of_nothing(empty):
    assert sharding.shard_records(empty).count() == 0


def share_out(tree, budget, weights, levels):
    """By hand: pour a budget down a tree of {name: subtree or capacity}."""
    cap = lambda t: t if isinstance(t, int) else sum(cap(x) for x in t.values())
    if isinstance(tree, int):
        return min(tree, budget)
    weight = {n: weights.get(levels[0], {}).get(n, 1) for n in tree}
    out, rest, left = {}, dict(tree), budget
    while rest:
        level = left / sum(weight[n] for n in rest)
        full = [n for n in rest if cap(rest[n]) <= level * weight[n]]
        if not full:
            out |= {n: share_out(t, int(level * weight[n]), weights, levels[1:]) for n, t in rest.items()}
            break
        for n in full:
            left -= cap(rest[n])
            out[n] = share_out(rest.pop(n), cap(tree[n]), weights, levels[1:])
    return out


def test_budgets_as_by_hand(spark):
    tree = {"web": {"en": {"a": 900, "b": 10, "c": 500}, "de": {"d": 30}}, "books": {"en": {"e": 4000}, "fr": {"f": 70, "g": 2000}}}
    weights = {"domain": {"web": 3}, "lang": {"en": 2}, "source": {"c": 4}}
    leaves = [(d, x, s, n) for d, t in tree.items() for x, u in t.items() for s, n in u.items()]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for total in (100, 2000, 5000, 7510, 9000):
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixture.budgets(df, LEVELS, total, 1, weights).collect()}
        want = share_out(tree, min(total, 7510), weights, LEVELS)
        assert got == {(d, x, s): want[d][x][s] for d, x, s, _ in leaves}, total
        if total == 5000:  # web/en cannot use its share of b: its siblings get it, not other domains
            assert got["web", "en", "b"] == 10 and got["web", "en", "a"] == 900


def test_prefixes_fit_their_budgets(docs, rows):
    got = mixture.mix(with_domain(docs), LEVELS, fraction=0.5, max_epochs=3, weights=WEIGHTS).collect()
    assert len(got) == len(rows)
    leaf = defaultdict(lambda: [0, 0, 0])
    for r in got:
        at = leaf[r["domain"], r["lang"], r["source"]]
        at[0] += r["tokens"]
        at[1] += r["tokens"] * r["copies"]
        at[2] = r["budget"]
    for tokens, taken, budget in leaf.values():
        assert taken <= budget <= 3 * tokens
    for r in got:  # no leaf repeats a record before it has taken all of them
        whole = leaf[r["domain"], r["lang"], r["source"]]
        assert not whole[0] or whole[2] // whole[0] <= r["copies"] <= whole[2] // whole[0] + 1


def test_taking_keeps_columns_and_nothing_is_nothing(docs, empty):
    out = mixture.take(with_domain(docs), LEVELS, fraction=0.6, max_epochs=1, weights=WEIGHTS)
    assert out.columns == with_domain(docs).columns
    assert 0 < out.count() < docs.count()
    assert mixture.mix(with_domain(empty), LEVELS, fraction=0.6).count() == 0
