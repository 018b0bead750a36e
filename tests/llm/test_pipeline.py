"""The queries of this subpackage against DuckDB, and the pipeline, at the smallest size."""

import os

import duckdb
import pytest

import corpus_pipeline
from kinfolio.llm import jaccard, registry
from kinfolio.plans.lineage import cut

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    want = sorted(tuple(map(str, r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall())
    assert got == want


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert docs.where("n_chars <> length(text)").count() == 0
        kept.append(docs)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & {r["doc_id"] for r in kept[0].collect()}) < len(toxic) / 2
    left = jaccard.similar(kept[2], shingle=5, percent=80)
    assert left.where("doc_id <> component_id").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_registered_queries(spark):
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in registry.QUERIES if k != "pipeline"}
    for name in ("op5_fingerprints", "op6_pack_sequences", "op7_pii_spans", "op9_toxicity", "op10_nearest_neighbours"):
        assert registry.QUERIES[name](spark, SF).count() > 0
