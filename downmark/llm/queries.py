"""The numbered queries over the driver tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, decontaminate, language_id, language_model, license_scan, line_dedup, mixture, near_dup, quality, sharding, spelling,
               token_blocks, vector_search)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its DuckDB twin."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf}/documents.parquet")


def remainder(modulus: int):
    """crc32 of the document's number as text, by which rows are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op1_decontaminate", r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
bs AS (SELECT item_id, len(w) AS n, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM items WHERE len(w) >= 5)),
spots AS (SELECT DISTINCT d.doc_id, greatest(0, least(d.pos - b.pos, d.n - b.n)) AS start, b.n FROM ds d JOIN bs b ON d.s = b.s),
wins AS (SELECT p.doc_id, p.start, p.n, d.s, count(*) AS c FROM spots p JOIN ds d ON d.doc_id = p.doc_id AND d.pos >= p.start AND d.pos <= p.start + p.n - 5 GROUP BY ALL),
size AS (SELECT doc_id, start, n, sum(c) AS m FROM wins GROUP BY ALL),
bcc AS (SELECT item_id, n, s, count(*) AS c FROM bs GROUP BY ALL),
bc AS (SELECT *, sum(c) OVER (PARTITION BY item_id) AS m FROM bcc),
met AS (SELECT w.doc_id, b.item_id, w.start, w.n, sum(least(w.c, b.c)) AS x, any_value(b.m) AS bm FROM wins w JOIN bc b ON w.n = b.n AND w.s = b.s GROUP BY ALL),
sims AS (SELECT met.doc_id, item_id, met.start, met.n, CAST(x AS DOUBLE) / CAST(z.m + bm - x AS DOUBLE) AS similarity FROM met JOIN size z ON met.doc_id = z.doc_id AND met.start = z.start AND met.n = z.n)
SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(n AS INT) AS n_words, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM sims WHERE similarity >= 0.8) WHERE r = 1""")
def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark items that each document holds, with the best window of each."""
    items = spark.read.schema("item_id bigint, text string").parquet(f"{sf}/benchmark.parquet")
    out = decontaminate.find(documents(spark, sf), items)
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", "similarity")


@query("op2_language_model")
def op2_language_model(spark: SparkSession, sf: str) -> DataFrame:
    """Log probabilities of all texts under a bigram trie learned from four fifths of them."""
    docs = documents(spark, sf).select("doc_id", "text")
    trie = language_model.fit(docs.filter(remainder(5) != 1))
    return language_model.score(docs, trie).withColumn("held_out", remainder(5) == 1)


@query("op3_token_blocks")
def op3_token_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents tokenised, written in blocks and read back."""
    import public_tokenizers

    manifest = token_blocks.write_tokens(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))
    return token_blocks.read_tokens(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op4_line_dedup", r"""
WITH lines AS (SELECT doc_id, i AS pos, l[i] AS line, regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
keyed AS (SELECT *, CASE WHEN length(bare) >= 40 THEN translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT a.doc_id, a.pos, a.line, s.keeper IS NOT NULL AND a.doc_id < s.keeper AS gone FROM keyed a LEFT JOIN shared s ON a.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id""")
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of five documents or more stay in one of them."""
    out = line_dedup.dedup_lines(documents(spark, sf))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document; four-word shingles, at most four differing bits."""
    return near_dup.near_duplicates(documents(spark, sf), shingle=4, radius=4)


#: The tree of the mixture: domains are groups of sources.
LEVELS = ("domain", "lang", "source")
WEIGHTS = {
    "domain": {"web": 5, "books": 3, "code": 2},
    "lang": {"en": 6, "de": 3, "fr": 3, "es": 2},
    "source": {"src0": 2},
}
FRACTION, EPOCHS = 0.8, 4


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    """The domain of a source, by its number: a third of them each, ``web`` if it has none."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    part = F.when(number == "", F.lit(0)).otherwise(number.cast("int") % 3)
    return docs.withColumn(name, F.when(part == 1, "books").when(part == 2, "code").otherwise("web"))


def _mixture_sql() -> str:
    case = {lvl: "CASE " + " ".join(f"WHEN {lvl} = '{k}' THEN {v}" for k, v in WEIGHTS[lvl].items()) + " ELSE 1 END" for lvl in LEVELS}
    parts = [f"""
WITH docs AS (SELECT doc_id, CASE n % 3 WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'web' END AS domain, lang, source, tokens, md5(coalesce(text, '')) AS h
  FROM (SELECT *, coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS INT), 0) AS n,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents)),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS BIGINT) * {EPOCHS} AS cap FROM docs GROUP BY ALL),
b0 AS (SELECT *, (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * {FRACTION}) AS BIGINT) FROM leaves) AS b FROM leaves)"""]
    for i, level in enumerate(LEVELS):
        up = ", ".join(["1", *LEVELS[:i]])
        path = ", ".join(LEVELS[:i + 1])
        on = " AND ".join(f"x.{c} IS NOT DISTINCT FROM s.{c}" for c in LEVELS[:i + 1])
        parts.append(f""",
c{i} AS (SELECT {path}, CAST(sum(cap) AS BIGINT) AS c, {case[level]} AS w, any_value(b) AS b FROM b{i} GROUP BY {path}),
l{i} AS (SELECT *, (b - coalesce(sum(c) OVER (PARTITION BY {up} ORDER BY c / w, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(w) OVER (PARTITION BY {up} ORDER BY c / w, {path} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl FROM c{i}),
s{i} AS (SELECT *, greatest(0, CAST(CASE WHEN c <= lvl * w THEN c ELSE floor(max(CASE WHEN c <= lvl * w THEN NULL ELSE lvl END) OVER (PARTITION BY {up}) * w) END AS BIGINT)) AS nb FROM l{i}),
b{i + 1} AS (SELECT x.domain, x.lang, x.source, x.tokens, x.cap, s.nb AS b FROM b{i} x JOIN s{i} s ON {on})""")
    parts.append(f""",
shares AS (SELECT domain, lang, source, b AS budget, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS f, CASE WHEN tokens > 0 THEN b % tokens ELSE -1 END AS r FROM b{len(LEVELS)}),
placed AS (SELECT d.*, s.budget, s.f, s.r, md5(concat('7|', CAST(s.f AS VARCHAR), '|', CAST(doc_id AS VARCHAR), '|', h)) AS o FROM docs d JOIN shares s
  ON d.domain IS NOT DISTINCT FROM s.domain AND d.lang IS NOT DISTINCT FROM s.lang AND d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, domain, lang, source, tokens, budget,
  CAST(f + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= r THEN 1 ELSE 0 END AS INT) AS copies FROM placed""")
    return "".join(parts)


@query("op6_mixture", _mixture_sql())
def op6_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is taken so that domains, languages and sources meet their weights."""
    return mixture.mix(with_domain(documents(spark, sf)), LEVELS, fraction=FRACTION, max_epochs=EPOCHS, weights=WEIGHTS)


@query("op7_compression_quality")
def op7_compression_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality scores learned from three quarters of the labelled documents."""
    docs = documents(spark, sf).select("doc_id", "text")
    labels = spark.read.schema("doc_id bigint, quality int, toxic int").parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    out = quality.score(docs, quality.fit(docs, labels.filter(remainder(4) != 2)))
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), F.col("quality_score").alias("score"),
                      F.when(F.col("quality_score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op8_virtual_slots")
def op8_virtual_slots(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return sharding.shard_records(documents(spark, sf), 24)


@query("op9_language_spans")
def op9_language_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The main language of every text, learned from two thirds of the labelled ones."""
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(remainder(3) != 1))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), F.col("lang_pred"), F.col("lang_score").alias("score"), F.size("spans").alias("n_spans"))


@query("op10_top_inner_products", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op10_top_inner_products(spark: SparkSession, sf: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    vectors = spark.read.schema("vec_id bigint, embedding array<float>, label int").parquet(f"{sf}/embeddings.parquet")
    return vector_search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


@query("op11_license_scan")
def op11_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """License labels of every document, from base phrases and signature rules."""
    return license_scan.summary(documents(spark, sf))


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Words of seven letters or more with their commoner spelling, ten times as frequent and one edit away."""
    return spelling.variants(documents(spark, sf), min_length=7, min_count=2, noise=31, ratio=10)


@query("op13_collocations", r"""
WITH w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE k >= 2),
cuts AS (SELECT c.lang, c.phrase, c.k, c.a, total.n, j, x.a AS l, y.a AS r, CAST((1000 * CAST(c.a AS HUGEINT) * total.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.s[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.s[j + 1:c.k], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS q FROM cuts) WHERE q = 1),
held AS (SELECT lang, phrase, max(a) AS most FROM (
  SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(s[i:i + m - 1], ' '))) AS phrase FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.phrase) AS rank
  FROM best LEFT JOIN held ON best.lang = held.lang AND best.phrase = held.phrase WHERE most IS NULL OR most < best.a) WHERE rank <= 2000""")
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The 2,000 strongest phrases of two to five words of every language."""
    return collocations.collocations(documents(spark, sf), min_count=100, longest=5, top=2000)
