"""Event study, nested draws and cluster draws against plain Python on small tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolio.operators import event_study, reports, resample


def number(seed, namespace, name):
    return int(hashlib.sha256(f"{seed}\0{namespace}\0{name}".encode()).hexdigest()[:8], 16)


def test_swept_equations():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(50), rng.normal(size=(50, 3))])
    x = np.column_stack([x, x[:, 1] + x[:, 2]])  # follows from others
    y = rng.normal(size=50)
    beta = event_study.swept(np.column_stack([x.T @ x, x.T @ y]))
    assert beta[4] == 0 and np.allclose(beta[:4], np.linalg.lstsq(x[:, :4], y, rcond=None)[0])


def dummies(bin_, slot, checkpoint, bins, slots, checkpoints):
    one = lambda k, n: [float(k == i) for i in range(1, n)]
    return [1.0, *one(bin_, bins), *one(slot, slots), *one(checkpoint, checkpoints)]


def test_event_study_of_rows(spark):
    """Each replicate is least squares on the rows that were drawn, one by one."""
    rng = np.random.default_rng(2)
    rows = [(s, i, c, int(rng.integers(0, 4)), float(rng.integers(-1, 2))) for s in (5, 7, 9) for i in range(9) for c in range(3)]
    d = spark.createDataFrame(rows, "seed int, item long, checkpoint int, bin int, outcome double").repartition(3)
    got = {}
    for r in event_study.event_draws(d, 6, seed=3, bins=4, checkpoints=3).collect():
        got.setdefault(r["replicate"], {})[r["bin"]] = r["estimate"]
    assert set(got) == {-1, *range(6)}
    for replicate, found in got.items():
        x, y = [], []
        for slot in range(3):
            seed = (5, 7, 9)[slot if replicate < 0 else number(3, "event:seed", f"{replicate}:{slot}") % 3]
            items = range(9) if replicate < 0 else [number(3, "event:item", f"{replicate}:{slot}:{k}") % 9 for k in range(9)]
            for i in items:
                for s, item, c, b, out in rows:
                    if s == seed and item == i:
                        x.append(dummies(b, slot, c, 4, 3, 3))
                        y.append(out)
        beta = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)[0]
        for b in range(4):
            g = np.mean([dummies(b, s, c, 4, 3, 3) for s in range(3) for c in range(3)], axis=0)
            assert found[b] == pytest.approx(g @ beta, abs=1e-9)
    table = {r["bin"]: r for r in event_study.event_study(d, 6, seed=3, bins=4, checkpoints=3).collect()}
    assert sum(r["observations"] for r in table.values()) == len(rows) and all(r["low"] <= r["high"] for r in table.values())
    for b, r in table.items():
        low, high = np.quantile([100 * got[k][b] for k in range(6)], [0.025, 0.975])
        assert (r["estimate"], r["low"], r["high"]) == (pytest.approx(100 * got[-1][b]), pytest.approx(low), pytest.approx(high))


def test_bins_without_rows(spark):
    """A time bin that never occurs has no estimate; the others aren't touched by it."""
    rows = [(1, i, c, 1 + c, float(c)) for i in range(4) for c in range(2)]
    d = spark.createDataFrame(rows, "seed int, item long, checkpoint int, bin int, outcome double")
    got = {r["bin"]: r["estimate"] for r in event_study.event_draws(d, 2, bins=4, checkpoints=2).where("replicate = -1").collect()}
    assert got[0] is None and got[3] is None and got[1] is not None
    mean = event_study.marginal_means([{"slot": 0, "bin": b, "checkpoint": c, "n": 2.0, "y": 2.0 * (b + 3 * c)} for b in (1, 2) for c in (0, 1)], 4, 1, 2)
    assert mean[0] is None and mean[1] == pytest.approx(2.5) and mean[2] == pytest.approx(3.5)


def test_event_rows(spark):
    deltas = [(s, f, f"t{i}", (3 - i) / 4, float(i)) for s in (1, 2) for f in (0.25, 0.5) for i in range(3)]
    target = spark.createDataFrame(deltas, "seed int, fraction double, pair_id string, position double, delta double")
    clean = spark.createDataFrame([(s, f, f"c{i}", 10.0 * i) for s in (1, 2) for f in (0.25, 0.5) for i in range(3)], "seed int, fraction double, pair_id string, delta double")
    got = {(r["seed"], r["item"], r["checkpoint"]): (r["bin"], r["outcome"]) for r in event_study.event_rows(target, clean, (0.25, 0.5)).collect()}
    for s in (1, 2):
        order = sorted(range(3), key=lambda i: hashlib.sha256(f"{s}\0clean_placebo_arrival\0c{i}".encode()).hexdigest())
        for item in range(3):  # positions 1/4, 2/4, 3/4 belong to t2, t1, t0
            for c, f in enumerate((0.25, 0.5)):
                time = f - (item + 1) / 4
                assert got[s, item, c] == (sum(time >= e for e in (-0.4, -0.2, 0.0, 0.2, 0.4)), (2 - item) - 10.0 * order[item])
    with pytest.raises(ValueError, match="seed 1: 3 target items and 2 clean ones"):
        event_study.event_rows(target, clean.where("pair_id <> 'c0'"), (0.25, 0.5))


def test_nested_draws(spark):
    rng = np.random.default_rng(4)
    rows = [(m, s, e, i, float(rng.integers(0, 2)), float(rng.integers(0, 2))) for m in "xy" for s in (1, 2) for e in ("target", "clean", "untouched") for i in range(7)]
    d = spark.createDataFrame(rows, "model string, seed int, evaluation_set string, pair_id long, naive double, safe double").repartition(3)
    got = {(r["replicate"], r["model"]): r for r in resample.nested_bootstrap_native(d, 5, seed=6).collect()}
    assert len(got) == 10
    value = {r[:4]: r[4:] for r in rows}
    for (replicate, model), r in got.items():
        mean = {}
        for e in ("target", "clean", "untouched"):
            per = []
            for slot in range(2):
                seed = (1, 2)[number(6, "nested:seed", f"{replicate}:{slot}") % 2]
                per.append(np.mean([value[model, seed, e, number(6, f"nested:{e}", f"{replicate}:{slot}:{k}") % 7] for k in range(7)], axis=0))
            mean[e] = np.mean(per, axis=0)
            assert (r[f"{e}_naive"], r[f"{e}_safe"]) == (pytest.approx(mean[e][0]), pytest.approx(mean[e][1]))
        gap = {e: m[0] - m[1] for e, m in mean.items()}
        assert r["did"] == pytest.approx(gap["target"] - gap["clean"]) and r["untouched_gap"] == pytest.approx(gap["untouched"])


def test_cluster_draws(spark):
    """Whole clusters are drawn; a rate is drawn hits over drawn rows."""
    cells = [(i, "v", "context", view, i % 3 == 0 and view == "w") for i in range(12) for view in ("v", "w")]
    d = spark.createDataFrame(cells, "record_id long, evaluation_view string, atom_type string, source_view string, exposed boolean")
    clusters = spark.createDataFrame([(i, f"c{i // 4}") for i in range(8)], "record_id long, cluster string")
    r = {x["scope"]: x for x in reports.focal_intervals(d, clusters, "v", 40, seed=2).collect()}
    assert (r["any_view"]["rows"], r["any_view"]["exposed_rows"], r["same_view"]["exposed_rows"]) == (12, 4, 0)
    names = sorted({"c0", "c1", *(f"record:{i}" for i in range(8, 12))})
    hits = {"c0": (2, 4), "c1": (1, 4)} | {f"record:{i}": (int(i % 3 == 0), 1) for i in range(8, 12)}
    ratios = []
    for b in range(40):
        drawn = [names[number(2, "boot:cluster", f"{b}:{k}") % 6] for k in range(6)]
        ratios.append(sum(hits[c][0] for c in drawn) / sum(hits[c][1] for c in drawn))
    low, high = np.quantile(ratios, [0.025, 0.975])
    assert r["any_view"]["low"] == pytest.approx(low) and r["any_view"]["high"] == pytest.approx(high) and r["same_view"]["high"] == 0


def test_numbers_of_items(spark):
    """Items are numbered in order over ranges, whatever their type."""
    rng = np.random.default_rng(7)
    numbers = sorted({int(x) for x in rng.integers(-10**9, 10**9, 300)})
    got, n = resample.numbered_items(spark.createDataFrame([(x,) for x in numbers], "x long").repartition(5), "x")
    assert n == 300 and sorted((r["x"], r["i"]) for r in got.collect()) == list(zip(numbers, range(300), strict=True))
    words = sorted({hashlib.md5(str(x).encode()).hexdigest()[: 1 + x % 5] for x in numbers})
    got, n = resample.numbered_items(spark.createDataFrame([(x,) for x in words], "x string"), "x")
    assert n == len(words) and sorted((r["x"], r["i"]) for r in got.collect()) == list(zip(words, range(n), strict=True))
    assert resample.numbered_items(spark.createDataFrame([], "x long"), "x")[1] == 0
    one, n = resample.numbered_items(spark.createDataFrame([(5,)], "x int"), "x")
    assert n == 1 and one.where(F.col("i") == 0).count() == 1
