"""Components of streamed edges, and files of several views as one format."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolio.operators.components import connected_components
from kinfolio.plans.lineage import fresh
from kinfolio.sources.adapters import ManifestAdapter, all_records
from kinfolio.sources.multiview import FormatAdapter, register
from kinfolio.streaming.components import add_batch, follow, labels


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def found(df):
    return {r["node"]: r["component"] for r in df.collect()}


def test_streamed_components(spark):
    """Stars, paths that meet later, repeats, loops and nulls, in four batches of which one is empty and one is added twice."""
    rng = np.random.default_rng(4)
    batches = [
        [(9, 8), (8, 7), (20, 21), (30, 30), (None, 5), (5, None)], [(7, 21), (9, 8), (40, 41), *((100, i) for i in range(101, 140))], [],
        [(1, 140), (139, 41), (41, 2), *((int(a), int(b)) for a, b in rng.integers(200, 260, (30, 2)))],
    ]
    folder = fresh(spark, "test")
    for i, b in enumerate(batches):
        add_batch(edges(spark, b), i, folder)
        if i == 1:
            add_batch(edges(spark, b), i, folder)
        want = found(connected_components(edges(spark, [e for x in batches[: i + 1] for e in x])))
        assert found(labels(spark, folder, i + 1)) == want
    assert found(labels(spark, folder, 1)) == {7: 7, 8: 7, 9: 7, 20: 20, 21: 20}
    assert not spark.conf.get("kinfolio.scope", "")


def test_a_stream_goes_on_after_a_stop(spark):
    folder = fresh(spark, "test")
    for part in ([(1, 2), (3, 4)], [(4, 5), (2, 3)]):
        edges(spark, part).write.mode("append").parquet(f"{folder}/in")
        q = follow(spark.readStream.schema("a long, b long").parquet(f"{folder}/in"), folder, availableNow=True)
        q.awaitTermination()
    assert found(labels(spark, folder, q.lastProgress["batchId"] + 1)) == {i: 1 for i in range(1, 6)}


def files(folder):
    rows = [{"q": f"question {i}", "a": f"answer {i % 3}", "lang": None if i % 2 else "fr"} for i in range(9000)]
    spec = {"dataset": "d", "revision": "r", "sources": []}
    for n, (view, split, ends) in enumerate([("chat", "train", "\n"), ("chat", "validation", "\r\n"), ("code", "train", "\n\n  \n"), ("chat", "train", "\n")]):
        name = f"{n}.jsonl" + (".gz" if n % 2 else "")
        with (gzip.open if n % 2 else open)(folder / name, "wt", encoding="utf-8", newline="") as f:
            f.writelines(json.dumps(r, ensure_ascii=False) + ends for r in rows[n :: 2 if n < 2 else 50])
        spec["sources"].append({"view": view, "split": split, "path": name, "mapping": {"context": "q", "responses": ["a"]}, "language": "lang"})
    (folder / "m.json").write_text(json.dumps(spec))
    return str(folder / "m.json")


def test_format_reads_what_the_adapter_reads(spark, tmp_path):
    m = files(tmp_path)
    plain, through = (all_records(spark, a).drop("atoms") for a in (ManifestAdapter(m), FormatAdapter(m)))
    assert through.columns == plain.columns and through.count() == 9000 + 180 + 180
    assert through.exceptAll(plain).isEmpty() and plain.exceptAll(through).isEmpty()


def test_filters_choose_files(spark, tmp_path):
    m = files(tmp_path)
    register(spark)
    d = spark.read.format("multiview").load(m)
    assert d.rdd.getNumPartitions() == 4
    chat = d.where("view = 'chat' and split in ('train', 'test')")
    assert chat.rdd.getNumPartitions() == 2 and chat.count() == 4500 + 180
    assert d.where("view = 'none'").count() == 0
    (tmp_path / "2.jsonl").write_text("[1]\n")
    assert chat.where(F.col("source_index") == 0).count() == 2  # the file of the other view isn't opened
    with pytest.raises(Exception, match="non-object"):
        all_records(spark, FormatAdapter(m)).collect()
