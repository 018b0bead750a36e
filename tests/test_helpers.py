"""Helpers that no query reaches, on small tables and files."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from kinfolio.functions import numbers, text
from kinfolio.operators import expect, reports, splits
from kinfolio.sources import adapters, sinks


def test_expectations(spark):
    cells = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    grid = cells.select("k").distinct().crossJoin(cells.select("v").distinct())
    with pytest.raises(AssertionError, match="missing"):
        expect.complete_grid(cells, grid)
    assert expect.complete_grid(grid, cells) is grid
    with pytest.raises(AssertionError, match="small"):
        expect.holds(cells.withColumn("v", F.when(F.col("k") == "a", F.col("v"))), F.col("v") > 0, "small")
    assert expect.holds(cells, F.col("v") > 0, "small") is cells


def test_ordered_hash_and_rows(spark):
    d = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "position long, id string")
    assert splits.ordered_hash(d, "position", "id").first()["order_hash"] == hashlib.sha256(b"a\nb\nc").hexdigest()
    got = reports.summary_rows(spark, {"m": {"target": {"estimate": 1, "interval": [0, 2]}, "other": {}}}).collect()
    assert [tuple(r) for r in got] == [("m", "target", 1.0, 0.0, 2.0)]


def test_disjoint_sets(spark):
    rows = spark.createDataFrame([(i, f"c{i % 12}", f"x{i % 30}") for i in range(90)], "id long, component string, context string")
    shared = spark.createDataFrame([(200 + i, f"c{i}", "y") for i in range(3)], rows.schema)
    none = rows.where("false")
    dev, base, kept = splits.disjoint_mixture(rows, shared, excluded=rows.where("component = 'c5'"), contexts=rows.where("context = 'x7'"), development=4, base=12, retained=2, seed=3)
    of = lambda d, c: {r[c] for r in d.collect()}
    assert dev.count() == 4 and base.count() == 12 and kept.count() == 2
    assert not of(dev, "component") & (of(base, "component") | {"c0", "c1", "c2"}) and "c5" not in of(dev, "component") | of(base, "component") and "x7" not in of(dev, "context") | of(base, "context")
    assert base.groupBy("component", "context").count().where("count > 1").count() == 0
    with pytest.raises(ValueError, match="are needed"):
        splits.disjoint_mixture(rows, shared, excluded=none, contexts=none, development=400, base=1, retained=1, seed=3)
    one, others = splits.component_disjoint(rows, "component", development=3, base=5, seed=1)
    assert one.count() == 3 and not of(one, "component") & of(others, "component")


def test_manifests(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text("x\n2\n")
    with gzip.open(tmp_path / "c.gz", "wb") as f:
        f.write(b"held")
    assert adapters.content_sha256(tmp_path / "c.gz") == hashlib.sha256(b"held").hexdigest()
    d = adapters.file_digests(spark, str(tmp_path), recursive=True, excluded=("sub",))
    m = sinks.artifact_manifest(d)
    assert m["file_count"] == 2 and m["total_bytes"] == sum(f["bytes"] for f in m["files"]) and m["files"][0]["sha256"] == hashlib.sha256(b"x\n1\n").hexdigest()
    expected = d.unionByName(spark.createDataFrame([("gone", 1, "0")], d.schema))
    found = d.withColumn("sha256", F.when(F.col("path").endswith("c.gz"), "f").otherwise(F.col("sha256")))
    r = sinks.verification_report(expected, found)
    assert (r["files"], r["missing"], r["changed"], r["valid"]) == (3, 1, 1, False) and sinks.verification_report(d, d)["valid"]
    reg = sinks.evidence_registry(tmp_path, {"claim": [("a.csv", "table"), ("sub/b.csv", "table")], "other": [("a.csv", "source")]})
    assert [f["path"] for f in reg["files"]] == ["a.csv", "sub/b.csv"] and reg["claims"]["other"] == [{"path": "a.csv", "role": "source"}]
    with pytest.raises(FileNotFoundError):
        sinks.evidence_registry(tmp_path, {"claim": [("none", "table")]})
    assert [p.name for p in adapters.prediction_files(tmp_path)] == ["a.csv", "b.csv"] and adapters.prediction_files(tmp_path / "a.csv") == [tmp_path / "a.csv"]
    with pytest.raises(FileNotFoundError):
        adapters.prediction_files(tmp_path / "sub" / "none")
    sinks.write_macros(tmp_path / "m.tex", {"b": 0.5, "a": 0.12345})
    assert (tmp_path / "m.tex").read_text() == "\\newcommand{\\a}{12.35}\n\\newcommand{\\b}{50.00}\n" or "12.34" in (tmp_path / "m.tex").read_text()
    with pytest.raises(FileExistsError):
        sinks.write_macros(tmp_path / "m.tex", {})
    draws = spark.createDataFrame([("did", 0, 0.5)], "metric string, replicate int, value double")
    sinks.write_draws(draws, str(tmp_path / "draws"))
    assert spark.read.parquet(str(tmp_path / "draws")).collect() == draws.collect()


def test_external_pairs(spark):
    rows = spark.createDataFrame([(0, "p  q", "a"), (1, "p q", "b"), (2, "r", "c")], "row_index long, prompt string, response string")
    contract = spark.createDataFrame([("x", 0, 1, 1), ("y", 1, 0, 0)], "pair_id string, index1 long, index2 long, label int")
    got = {r["pair_id"]: (r["response1"], r["response2"], r["overall_preference"]) for r in adapters.external_pairs(contract, rows).collect()}
    assert got == {"x": ("a", "b", 1), "y": ("b", "a", -1)}
    with pytest.raises(Exception, match="prompts differ"):
        adapters.external_pairs(spark.createDataFrame([("z", 0, 2, 1)], contract.schema), rows).collect()


def test_closed_forms(spark):
    d = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<double>, b array<double>")
    assert d.select(text.squared_distance(F.col("a"), F.col("b"))).first()[0] == 25
    r = spark.range(1).select(numbers.logistic(F.lit(0.0)), numbers.logistic(F.lit(-99.0)), numbers.close(F.lit(1.0), F.lit(1.0 + 1e-13)), numbers.event_time(F.lit(4.0), F.lit(1.0), F.lit(8.0))).first()
    assert r[0] == 0.5 and 0 < r[1] < 1e-17 and r[2] and r[3] == pytest.approx(4 / 8 - 1.5 / 8)


def test_construct_serializer():
    encode = lambda s: list(s.encode())
    whole = text.serialize_construct(encode, "c", "o", ["f", "g"], "e", most=2000, start=[1], end=[2])
    assert bytes(whole[1:-1]) == b"[CONTEXT]c[ORIGINAL_RESPONSE]o[FEEDBACK][ENTRY 1/2]f[ENTRY 2/2]g[CANDIDATE_EDIT]e" and (whole[0], whole[-1]) == (1, 2)
    long = text.serialize_construct(encode, "c" * 900, "o" * 900, ["f" * 300, "g" * 5, "h" * 300], "e" * 900, most=600, end=[2])
    shown = bytes(long[:-1]).decode()
    assert len(long) == 600 and shown.count("[...OMITTED...]") >= 4 and "ggggg" in shown
    parts = dict(zip(("context", "original", "feedback", "candidate"), [p for p in __import__("re").split(r"\[CONTEXT\]|\[ORIGINAL_RESPONSE\]|\[FEEDBACK\]|\[CANDIDATE_EDIT\]", shown)][1:], strict=True))
    assert len(parts["context"]) == 64 and len(parts["original"]) == 80 and len(parts["feedback"]) == 144 and len(parts["candidate"]) > 160
    for bad in (("", "o", ["f"], "e"), ("c", "o", [" "], "e"), ("c", "o", ["f"], "")):
        with pytest.raises(ValueError, match="empty"):
            text.serialize_construct(encode, *bad)
    with pytest.raises(ValueError, match="too few"):
        text.serialize_construct(encode, "c", "o", ["f"], "e", most=400)


def test_list_digests(spark):
    """Lists over many batches, null texts, keys that repeat across batches, no rows; against hashing the joined list."""
    from kinfolio.operators.digests import list_digests

    rows = [(i % 3, f"k{i % 2}", i, None if i % 7 == 0 else f"t{i}é") for i in range(500)] + [(9, None, 1, "alone"), (9, None, 0, None), (8, "only null", 0, None)]
    d = spark.createDataFrame(rows, "a int, b string, at int, text string").repartition(5)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r["a"], r["b"]): r["digest"] for r in list_digests(d, ["a", "b"], [F.col("at")], F.col("text"), before='["', between='","', after='"]').collect()}
            want = {}
            for a, b, _, t in sorted(rows, key=lambda r: r[2]):
                want.setdefault((a, b), []).append(t)
            assert got == {k: hashlib.sha256(('["' + '","'.join(t for t in v if t is not None) + '"]').encode()).hexdigest() for k, v in want.items()}
            whole = list_digests(d, [], [F.col("at"), F.col("a")], F.col("text"), between="\n").collect()
            order = sorted(rows, key=lambda r: (r[2], r[0]))
            assert [r["digest"] for r in whole] == [hashlib.sha256("\n".join(r[3] for r in order if r[3] is not None).encode()).hexdigest()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert list_digests(d.where("a > 99"), ["a"], [F.col("at")], F.col("text")).count() == 0


def test_digests_of_large_files(spark, tmp_path):
    """A file beyond 2 GB is hashed in blocks; the path may hold blanks."""
    folder = tmp_path / "a b"
    folder.mkdir()
    with (folder / "sparse file.bin").open("wb") as f:
        f.truncate((1 << 31) + 5)
    with gzip.open(folder / "x.gz", "wb") as f:
        f.write(b"held" * 1000)
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["bytes"], r["sha256"]) for r in adapters.file_digests(spark, str(folder), content=True).collect()}
    state = hashlib.sha256()
    for _ in range(1 << 7):
        state.update(bytes(1 << 24))
    state.update(bytes(5))
    assert got["sparse file.bin"] == ((1 << 31) + 5, state.hexdigest())
    assert got["x.gz"][1] == hashlib.sha256(b"held" * 1000).hexdigest()


def test_serialized_pairs(spark):
    """The table operator against one pair at a time, with parts of all lengths, many entries and empty parts."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from kinfolio.operators import serialize

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    encode = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    rng = np.random.default_rng(3)
    words = lambda most: " ".join(rng.choice(["alpha", "beta", "naïve", "x1", "漢字"], rng.integers(1, most)))
    rows = [(i, words(5 if i % 2 else 900), words(4 if i % 3 else 500), [words(3 if i % 5 else 300) for _ in range(1 + i % 6)], words(6 if i % 4 else 700)) for i in range(60)]
    rows += [(100, "", "a", ["b"], "c"), (101, "a", None, ["b"], "c"), (102, "a", "b", [], "c"), (103, "a", "b", ["x"] * 200, "c"), (104, "a", "b", [" ", "y"], "c"), (105, None, "b", ["x"], " ")]
    d = spark.createDataFrame(rows, "pair_id long, context string, original string, feedback array<string>, candidate string").repartition(3)
    got = {r["pair_id"]: r for r in serialize.serialized(d, path, start=[1], end=[2]).collect()}
    assert len(got) == len(rows)
    for i, context, original, feedback, candidate in rows:
        try:
            want = text.serialize_construct(encode, context or "", original or "", feedback, candidate, start=[1], end=[2])
            assert got[i]["tokens"] == want and len(want) <= 512 and got[i]["problem"] is None
        except ValueError as wrong:
            assert got[i]["tokens"] is None and got[i]["problem"] == str(wrong)
    assert sum(r["tokens"] is None for r in got.values()) == 6
    with pytest.raises(Exception, match="too few"):
        serialize.serialized(d, path, most=64).collect()


def test_recomputed_cells(spark):
    from kinfolio.operators import serialize

    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 3.0), ("z", 1.0, 1.0)], "k string, n double, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-13, None), ("y", 2.1, 3.0), ("w", 1.0, 1.0)], "k string, n double, v double")
    got = {(r["k"], r["value"]): r["status"] for r in serialize.recomputed(a, b, ["k"], ["n", "v"]).collect()}
    assert got == {("x", "n"): "same", ("x", "v"): "same", ("y", "n"): "differs", ("y", "v"): "same", ("z", "n"): "missing", ("z", "v"): "missing", ("w", "n"): "extra", ("w", "v"): "extra"}
