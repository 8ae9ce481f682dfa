"""The corpus pipeline: documents in, a deduplicated, clean, mixed and sharded corpus out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept,
and is written as Parquet before the next one reads it.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from downmark.llm import decontaminate, language_id, mixture, near_dup, sharding
from downmark.llm.common import keep, set_aside
from downmark.llm.queries import DOCUMENTS, LEVELS, WEIGHTS, with_domain

#: Share of the words that the main language of a document must have.
MAIN_LANGUAGE = 0.5
#: Share of a document's letter trigrams that its languages must have been seen to use.
LANGUAGE_FIT = 0.5
#: Tokens the mixture takes, of all that reach it; every document at most once.
MIX_FRACTION = 0.8
SHARDS = 24


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, without a main language or in none of the languages learned go.

    Null and empty texts have no letters.  Repeated rows and rows with one key are judged
    each by itself; an empty table stays empty; other columns stay as they are.
    """
    model = language_id.fit(docs)
    read, back = set_aside(docs, "lang_pred", "lang_score", "lang_fit", "spans")
    known = language_id.identify(read, model)
    told = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= MAIN_LANGUAGE) & (F.col("lang_fit") >= LANGUAGE_FIT)
    return known.filter(told).select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more.

    SimHash fingerprints and their deletion variants give the first links, rarest shingles
    all that these miss; exact similarities decide.
    A group is what chains of such pairs join; the smallest key of it stays, null keys last.
    Null, empty and blank texts are a group; repeated rows stay once; an empty table stays
    empty; other columns stay as they are.
    """
    return near_dup.distinct_texts(docs, shingle=5, least=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none.  Rows with one key are told apart by their texts,
    repeated rows go or stay together; an empty table or benchmark takes nothing away.
    """
    items = spark.read.schema("item_id bigint, text string").parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources get their budgets; no document is taken twice, so none is a copy again.

    Null levels are leaves of their own.  Texts without words are taken whenever the prefix
    reaches them; repeated rows are taken together; an empty table stays empty.
    """
    read, back = set_aside(docs, "domain")
    return mixture.take(with_domain(read), LEVELS, fraction=MIX_FRACTION, max_epochs=1, weights=WEIGHTS).select(*back)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every document and its place there.

    Null texts count as empty, null keys as a key like any other; equal rows all get places
    of their own; an empty table gives an empty result.
    """
    return sharding.shard_records(docs, SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("sharding", shard),
]

#: The near-duplicate and language stages cannot be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
