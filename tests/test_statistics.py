"""Splits, effects and resampling on small fixtures, and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolio.functions import numbers, text
from kinfolio.operators import effects, expect, resample, splits


def test_quotas_are_exact_and_capped(spark):
    c = spark.createDataFrame([("a", 8), ("b", 2), ("c", 0)], "stratum string, capacity long")
    assert {r["stratum"]: r["quota"] for r in splits.quotas(c, 7).collect()} == {"a": 6, "b": 1}
    with pytest.raises(Exception, match="only 10"):
        splits.quotas(c, 11).collect()


def test_prefix_sizes_halves_to_even(spark):
    got = spark.createDataFrame([(f,) for f in (0.2, 0.4, 0.6, 0.8, 1.0)], "f double").select(numbers.prefix_size(4512, F.col("f"))).collect()
    assert [r[0] for r in got] == [902, 1805, 2707, 3610, 4512]


def test_smd_tv_and_wilson(spark):
    d = spark.createDataFrame([("l", 1.0), ("l", 2.0), ("r", 1.0), ("r", 2.0)], "side string, x double")
    assert splits.standardized_mean_difference(d, "x", F.col("side") == "l").first()[0] == 0
    assert splits.total_variation(d.where("side = 'l'"), d.where("side = 'r'"), "x").first()[0] == 0
    assert splits.total_variation(d.where("side = 'l'"), d.where("x > 9"), "x").first()[0] == 1
    low, high = numbers.wilson(F.lit(317), F.lit(400))
    r = spark.range(1).select(low, high).first()
    assert r[0] == pytest.approx(0.75007, abs=1e-5) and r[1] == pytest.approx(0.82937, abs=1e-5)
    assert numbers.mcnemar_exact(67, 51) == pytest.approx(0.16705, abs=1e-5)


def test_competence_of_ties(spark):
    d = spark.createDataFrame([(1.0,)] * 317 + [(-1.0,)] * 82 + [(0.0,)], "m double")
    r = d.agg(F.avg(numbers.correctness(F.col("m"))), F.avg(numbers.correctness(F.col("m"), tie=0.0))).first()
    assert tuple(r) == (0.79375, 0.7925)


def predictions(spark):
    rows = [("m", s, b, f, e, i, 0, 0.1, int(e == "target" and b == "naive" and i < 3)) for s in (1, 2) for b in ("naive", "safe") for f in (0.2, 1.0) for e in ("target", "clean") for i in range(4)]
    return spark.createDataFrame(rows, "model string, seed int, boundary string, fraction double, evaluation_set string, pair_id int, label int, margin double, correct int")


def test_did_and_missing_partner(spark):
    p = predictions(spark)
    assert {r["did"] for r in effects.did(effects.paired(p)).collect()} == {0.75}
    with pytest.raises(Exception, match="no partner"):
        effects.paired(p.where("not (boundary = 'safe' and pair_id = 0)")).collect()


def test_earliest_tie_is_selected(spark):
    a = spark.createDataFrame([("m", 1, f, "t", v) for f, v in ((0.2, 0.5), (0.4, 0.5), (0.6, 0.1))], "model string, seed int, fraction double, evaluation_set string, accuracy double")
    assert effects.selected(a, "t").first()["fraction"] == 0.2


def test_constant_contrast_survives_resampling():
    t, c = np.full((2, 3, 4, 10), 0.75), np.full((2, 3, 4, 8), 0.25)
    d = resample.parity_did(t, c, replicates=30, seed=1)
    assert d.shape == (30, 2, 4) and np.allclose(d, 0.5)
    assert np.array_equal(d, resample.parity_did(t, c, replicates=30, seed=1))
    assert np.allclose(resample.parity_effect(c, replicates=5, seed=2), 0.25)
    x = np.zeros((1, 2, 3, 6))
    x[:, :, 1] = 1
    y = np.zeros((1, 2, 3, 6))
    y[:, :, 2] = 1
    down = np.zeros((1, 2, 3, 6))
    down[:, :, 1] = 0.5
    p = resample.parity_policies(x, y, [down], replicates=7, seed=3)[0]
    assert np.allclose(p["target_minus_clean"], 0.5) and np.allclose(p["target_minus_final"], 0.5) and np.allclose(p["clean_minus_final"], 0)


def test_arrival_modes():
    mask = np.zeros((2, 3, 40), bool)
    mask[:, :, ::2] = True
    delta = np.where(mask[None], 0.75, 0.25)
    b = resample.parity_arrival(delta, mask, np.full(delta.shape, 0.1), mask, replicates=9, seed=1)
    assert np.allclose(b["target"], 0.5) and np.allclose(b["placebo"], 0) and np.allclose(b["difference"], 0.5)
    pos = np.tile(np.arange(40), (2, 1))
    r = [resample.parity_permutation(delta, pos, np.array([10, 20, 30]), replicates=6, seed=4) for _ in range(2)]
    assert np.array_equal(*r) and r[0].shape == (6, 1)
    assert resample.nested_bootstrap(delta, delta, replicates=3, seed=1).shape == (3, 1)


def test_native_bootstrap_keeps_a_constant(spark):
    d = effects.paired(predictions(spark).where("pair_id < 3"))
    assert {round(r["did"], 12) for r in resample.did_bootstrap(d, 5).collect()} == {1.0}


def test_event_ols_recovers_a_line(spark):
    rows = spark.createDataFrame([(i % 3, 1.0, float(i), 2.0 + 0.5 * i) for i in range(30)], "u int, one double, x double, y double")
    beta, xx, xy = resample.event_ols(rows, ["one", "x"], "y", ["u"])
    assert np.allclose(beta, [2, 0.5]) and xx.shape == (3, 2, 2)
    assert np.allclose(resample.ols_bootstrap(xx, xy, replicates=3, seed=1)[:, 1], 0.5)


def test_nearest_pairs_take_turns(spark):
    t = spark.createDataFrame([(i, "s", [float(i), 0.0]) for i in range(2)], "id long, stratum string, features array<double>")
    c = spark.createDataFrame([(10 + i, "s", [float(i), 0.0]) for i in range(5)], "id long, stratum string, features array<double>")
    q = spark.createDataFrame([("s", 2)], "stratum string, quota long")
    r = splits.nearest_pairs(t, c, q, seed=1).collect()
    used = [x for y in r for x in (y["validation_id"], y["test_id"])]
    assert len(r) == 2 and len(set(used)) == 4


def test_budgets_and_truncation(spark):
    assert text.shared_quota([3, 10, 10], 12) == [3, 5, 4]
    assert sum(text.part_budgets({"original": 500, "feedback": 10, "candidate": 500, "context": 500}, 700).values()) == 700
    r = spark.range(1).select(text.head_tail(F.array(*map(F.lit, range(10))), 6, [99]).alias("x"), text.head_tail(F.array(*map(F.lit, range(10))), 2, [99]).alias("y")).first()
    assert r["x"] == [0, 1, 2, 99, 8, 9] and r["y"] == [0, 1]
    assert text.serialize_candidate([1] * 5, [2] * 20, most=12, context_share=0.5, marker=[9]) == [1] * 5 + [2, 2, 2, 9, 2, 2, 2]


def test_expectations(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    for bad in (lambda: expect.unique(d, "k"), lambda: expect.one_value(d, "k", "v"), lambda: expect.row_count(d, 3), lambda: expect.not_blank(d.selectExpr("' ' as v"), "v"), lambda: expect.disjoint(d, d, "k")):
        with pytest.raises(AssertionError):
            bad()
    expect.subset(d, d, "k", "v")
    expect.same_keys(d, d, "k", "v")


def test_learner_prefers_the_marked_word(spark):
    from kinfolio.operators import learners

    rows = [(i, f"plain words {i % 3}", f"plain good words {i % 3}", 1) if i % 2 else (i, f"plain good words {i % 3}", f"plain words {i % 3}", 0) for i in range(24)]
    d = spark.createDataFrame(rows, "pair_id int, response1 string, response2 string, label int")
    p = learners.fit_predict(d, d).collect()
    assert all((r["margin"] > 0) == (r["label"] == 1) for r in p)


def test_registered_learners_are_the_surveyed_ones(spark, monkeypatch):
    from kinfolio import registry
    from kinfolio.operators import learners

    asked = []
    monkeypatch.setattr(learners, "fit_predict", lambda train, evaluation, terms=learners.word_terms, **how: asked.append((terms, how)))
    for name in ("sparse_learner", "sparse_learner_char"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    same = {"iterations": 1500, "least_documents": 3}
    assert asked == [(learners.word_terms, {"c": 0.3, "most_features": 120_000} | same), (learners.char_terms, {"c": 1.0, "most_features": 160_000} | same)]


def test_streaming_exposure(spark, tmp_path):
    from kinfolio.streaming.exposure import exposed_stream

    s = "record_id long, view string, atom_type string, value_hash string, field string, ts timestamp"
    spark.sql("select 1L record_id, 'a' view, 'context' atom_type, 'h' value_hash, 'context' field, timestamp'2024-01-01' ts union all select 1L, 'a', 'context', 'h', 'context', timestamp'2024-01-01' union all select 2L, 'b', 'context', 'z', 'context', timestamp'2024-01-01'").write.parquet(str(tmp_path / "in"))
    train = spark.sql("select 'context' atom_type, 'h' value_hash, 'b' view")
    q = exposed_stream(spark.readStream.schema(s).parquet(str(tmp_path / "in")), train).writeStream.format("memory").queryName("exposed").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["record_id"], r["same_view"]) for r in spark.table("exposed").collect()] == [(1, False)]


def test_learner_grid(spark):
    """Every model at every prefix on every set, and the same as fitting that prefix alone."""
    from pyspark.sql import functions as F

    from kinfolio.operators import learners

    rows = [(i, i, f"plain words here {i % 5}", f"good words {'fine' if i % 2 else 'plain'} there {i % 3}", i % 2) for i in range(40)]
    pairs = spark.createDataFrame(rows, "pair_id long, position long, response1 string, response2 string, label int")
    sets = {"a": pairs.where("pair_id < 10"), "b": pairs.where("pair_id >= 30")}
    models = {k: learners.MODELS[k] for k in ("word",)}
    got = learners.grid(pairs, sets, fractions=(0.5, 1.0), models=models, iterations=20).collect()
    assert len(got) == 2 * (10 + 10) and {r["fraction"] for r in got} == {0.5, 1.0}
    assert all((r["margin"] > 0) == (r["label"] > 0) for r in got if r["fraction"] == 1.0)
    alone = learners.fit_predict(pairs.where(F.col("position") < 20), sets["b"], learners.word_terms, c=0.3, iterations=20).collect()
    of = {r["pair_id"]: r["margin"] for r in got if r["fraction"] == 0.5 and r["evaluation_set"] == "b"}
    assert all(abs(of[r["pair_id"]] - r["margin"]) < 1e-9 for r in alone)


def test_learner_against_a_small_solver(spark):
    """Margins of the model agree with Newton steps on a dense matrix of the same differences."""
    import math
    import re

    from kinfolio.operators import learners

    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda: " ".join(rng.choice(vocabulary, rng.integers(1, 9)))
    rows = [(i, i, text(), text(), int(rng.integers(0, 2))) for i in range(60)] + [(60, 60, "", text(), 1), (61, 61, text(), "zz yy", 0)]
    pairs = spark.createDataFrame(rows, "pair_id long, position long, response1 string, response2 string, label int")
    terms = lambda t: (w := [x for x in re.split(r"\W+", t.lower()) if len(x) > 1]) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    for fraction, c in ((1.0, 0.3), (0.5, 2.0)):
        k = round(len(rows) * fraction)
        docs = [terms(x) for r in rows[:k] for x in r[2:4]]
        df = {w: sum(w in x for x in docs) for x in docs for w in x}
        used = sorted(w for w, n in df.items() if n >= 3)
        idf = {w: math.log((1 + 2 * k) / (1 + df[w])) + 1 for w in used}

        def vector(t):
            w = terms(t)
            v = np.array([(1 + math.log(w.count(u))) * idf[u] if u in w else 0.0 for u in used])
            return v / (np.linalg.norm(v) or 1)

        x = np.array([[*(vector(r[3]) - vector(r[2])), 1.0] for r in rows])
        y, a, beta = np.array([r[4] for r in rows[:k]]), x[:k], np.zeros(len(used) + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ beta))
            beta -= np.linalg.solve(np.eye(len(beta)) / c + a.T @ (a * (p * (1 - p))[:, None]), beta / c + a.T @ (p - y))
        got = learners.grid(pairs, {"all": pairs}, fractions=(fraction,), models={"m": (learners.word_terms, c, 1000)}, iterations=300).collect()
        margins = {r["pair_id"]: r["margin"] for r in got}
        assert np.allclose([margins[r[0]] for r in rows], x @ beta, atol=2e-3)
        assert all(abs(r["probability"] - 1 / (1 + math.exp(-r["margin"]))) < 1e-12 for r in got)


def test_model_rankings_share_places_whatever_the_order_of_seeds(spark):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1 in doubles; the models are equal."""
    rows = [("b", 1.0, "s", m, a) for m, seeds in (("x", (0.1, 0.2, 0.3)), ("y", (0.3, 0.2, 0.1)), ("z", (0.1, 0.1, 0.1))) for a in seeds]
    d = spark.createDataFrame(rows, "boundary string, fraction double, evaluation_set string, model string, accuracy double").coalesce(1)
    got = {r["model"]: (r["rank"], r["accuracy"]) for r in effects.model_rankings(d).collect()}
    assert got == {"x": (1, 0.2), "y": (1, 0.2), "z": (3, 0.1)}


def _marked(spark):
    """Pairs that "good" decides, and pairs of one long text twice, whose weights differ by rounding at most."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, i, f"plain words {i % 3}", f"plain good words {i % 3}", 1) if i % 2 else (i, i, f"plain good words {i % 3}", f"plain words {i % 3}", 0) for i in range(48)]
    for i in range(48, 90):
        same = " ".join(np.random.default_rng(i).permutation(np.repeat(words[i % 5 :: 5], 1 + i % 4)))
        rows.append((i, i, same, same, i // 2 % 2))
    return spark.createDataFrame(rows, "pair_id long, position long, response1 string, response2 string, label int")


def test_learner_isnt_stopped_by_pairs_of_equal_texts(spark):
    """Columns that only rounding fills made the former solver give up and return no weight."""
    from kinfolio.operators import learners

    d = _marked(spark)
    margins = {r["pair_id"]: r["margin"] for r in learners.fit_predict(d, d, iterations=1500).collect()}
    assert all((margins[i] > 0) == (i % 2 == 1) and abs(margins[i]) > 0.1 for i in range(48))


def test_learner_passes_in_tasks_as_on_the_driver(spark, monkeypatch):
    """Two tables that share pairs, one of them with a pair twice, in small slices and tasks: the same margins."""
    from kinfolio.operators import learners

    d = _marked(spark)
    some = d.where("pair_id % 3 > 0").selectExpr("pair_id", "pair_id - 1 - pair_id div 3 AS position", "response1", "response2", "label")
    trains = {"all": d, "some": some.unionByName(some.where("pair_id = 1").selectExpr("pair_id", "60L AS position", "response1", "response2", "label"))}

    def margins():
        g = learners.grid(trains, {"a": d}, fractions=(0.5, 1.0), models={"m": (learners.word_terms, 1.0, 150)}, iterations=300).collect()
        assert len(g) == 4 * 90
        return {(r["boundary"], r["fraction"], r["pair_id"]): r["margin"] for r in g}

    whole = margins()
    alone = {r["pair_id"]: r["margin"] for r in learners.fit_predict(trains["some"], d, learners.word_terms, c=1.0, iterations=300, most_features=150).collect()}
    assert all(abs(whole["some", 1.0, k] - m) < 1e-4 for k, m in alone.items())
    monkeypatch.setattr(learners, "SLICE", 300)
    monkeypatch.setattr(learners, "TASK_CHARACTERS", 1000)
    for most in (learners.HERE_TERMS, 1000):
        monkeypatch.setattr(learners, "HERE_TERMS", most)
        parts = margins()
        assert all(abs(whole[k] - parts[k]) < 1e-4 for k in whole)


def test_slices_are_all_of_a_batch_whatever_the_lengths(monkeypatch):
    import pyarrow as pa

    from kinfolio.operators import learners

    monkeypatch.setattr(learners, "SLICE", 10)
    for lengths in ([], [0], [0, 0], [3, 3, 3, 3, 3], [100], [1, 100, 1], [10, 10, 0], [0, 25, 25, 0, 1]):
        parts = [p.column("characters").to_pylist() for p in learners._slices(pa.record_batch({"characters": pa.array(lengths, pa.int64())}))]
        assert sum(parts, []) == lengths and all(p and sum(p) - max(p) <= 20 for p in parts)


def test_runs_of_characters_are_those_of_the_column(spark):
    """Made by slices of many texts, without a string a run: the same runs as often, and the same margins."""
    from collections import Counter

    from kinfolio.operators import learners

    rng = np.random.default_rng(3)
    texts = ["", "a", "ab", "abc", "A  \t\nB c", "\U0001f600\U0001f601 \U0001f600\U0001f601\u4e2d\u6587", "\u00c9t\u00e9 \u0130x", "abab" * 50, *("".join(rng.choice(list("abcd \u00e9\u4e2d"), int(n))) for n in rng.integers(0, 60, 40))]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in (d.orderBy("i").select(learners.char_terms(d["text"]).alias("t"), learners._sequences(d["text"], learners.char_terms).alias("s")).toArrow(),):
        rows, ids, names = learners._terms(r.column("s").combine_chunks(), learners.char_terms)
        assert len(set(names)) == len(names)
        got = Counter((i, names[j]) for i, j in zip(rows.tolist(), ids.tolist(), strict=True))
        assert got == Counter((i, x) for i, t in enumerate(r.column("t").to_pylist()) for x in t)
    pairs = spark.createDataFrame([(i, texts[8 + i], texts[7 + 2 * i % 40], i % 2) for i in range(40)], "pair_id int, response1 string, response2 string, label int")
    margins = [{r["pair_id"]: r["margin"] for r in learners.fit_predict(pairs, pairs, t, iterations=200).collect()} for t in (learners.char_terms, lambda c: learners.char_terms(c))]
    assert any(margins[0].values()) and all(abs(m - margins[1][k]) < 1e-6 for k, m in margins[0].items())
