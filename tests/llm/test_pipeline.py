"""The pipeline against brute force, and that the rest does not need these operators."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from downmark.llm import queries

ROOT = Path(__file__).parents[2]


@pytest.fixture(scope="module")
def tables(spark, docs, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.selectExpr("doc_id", "text", "lang", "source", "length(text) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    item = " ".join(rows[16][1].split()[2:30])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_every_stage_takes_effect(spark, tables):
    from test_near_dup import shared

    folder, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before, kept = docs.columns, docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        kept[name] = docs.collect()
        if name == "sharding":
            break
        assert docs.columns == columns and set(kept[name]) <= set(before)
    assert {r["doc_id"] for r in set(before) - set(kept["language_id"])} >= {41, 42, 43, 44}
    texts = [r["text"] for r in kept["near_duplicates"]]
    assert not any(shared(a, b) >= 0.9 for i, a in enumerate(texts) for b in texts[:i])
    gone = set(kept["near_duplicates"]) - set(kept["decontamination"])
    assert {r["doc_id"] for r in gone} == {16} and item in " ".join(next(iter(gone))["text"].split())
    words = lambda rows_: sum(len((r["text"] or "").split()) for r in rows_)
    assert words(kept["mixture"]) <= corpus_pipeline.MIX_FRACTION * words(kept["decontamination"])
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] or -1 for r in whole) == sorted(r["doc_id"] or -1 for r in kept["mixture"]) == sorted(r["doc_id"] or -1 for r in kept["sharding"])


def test_pipeline_of_nothing(spark, tables, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    import check_oracle

    sf = "/root/testdata/sf0.001"
    out = check_oracle.compare(queries.QUERIES[name](spark, sf), check_oracle.connect(sf), queries.ORACLES[name])
    assert out.startswith("ok"), out


def test_nothing_else_imports_these_operators():
    code = "import sys, __spark_entry__ as e; from downmark.plans import catalog; catalog.load(); sys.exit(any(m.startswith('downmark.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
