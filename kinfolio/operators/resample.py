"""Bootstrap and randomisation, in two modes.

Native: replicates are rows and draws are hashes, so any engine gives the same
numbers and replicates spread over the cluster. Parity: the small matrix of
deltas goes to one place, and NumPy draws in batches, as saved results were
drawn. The modes agree in distribution, not in digits.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.types import NumericType

from ..functions.canonical import hash_number, is_odd, stable_rank
from .splits import numbered


def numbered_items(items: DataFrame, order: str) -> tuple[DataFrame, int]:
    """Items (distinct) with i, their number by ``order`` from 0, and how many there are. Ranges of
    ``order`` are counted and numbered apart, so no task sees all items."""
    if isinstance(items.schema[order].dataType, NumericType):
        ends = items.agg(F.min(order).cast("double").alias("low"), F.max(order).cast("double").alias("high"), F.count("*").alias("n")).first()
        if not ends["n"]:
            return items.withColumn("i", F.lit(0).cast("long")), 0
        part = F.floor((F.col(order).cast("double") - F.lit(ends["low"])) * 255 / F.lit((ends["high"] - ends["low"]) or 1.0))
        n = ends["n"]
    else:
        part, n = F.substring(F.col(order).cast("string"), 1, 2), items.count()
    return numbered(items, F.col(order), "i", part=part), n


#: Draws that one task holds, about.
TASK_DRAWS = 1_000_000


def draw_tasks(spark: SparkSession, n: int) -> int:
    """Tasks for ``n`` draws: their number grows with the draws, not what each holds."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / TASK_DRAWS))


def drawn_rows(values: DataFrame, items: DataFrame, n: int, order: str, slots: DataFrame, number: Column, each: int, on: tuple[str, ...] = ()) -> DataFrame:
    """The rows of drawn items, one for each time that an item is drawn: the columns of ``slots`` with those of ``values``.
    ``items`` has ``order`` and i, from 0 to ``n``; each of the ``slots`` (``each`` in all; they are sent along) draws ``n`` times,
    time k the item of ``number`` % n. Rows also agree ``on`` columns of slots. Draws and values meet by item, in tasks whose number
    grows with the draws, and are not counted before; an item's rows go as one array."""
    spark = values.sparkSession
    tasks = draw_tasks(spark, n * each)
    k = items.select(F.col("i").alias("k")).repartition(tasks, "k")
    drawn = k.crossJoin(F.broadcast(slots)).withColumn("i", number % F.lit(max(1, n))).drop("k").repartition(tasks, "i")
    held = [c for c in values.columns if c != order]
    own = values.join(items, order).groupBy("i").agg(F.collect_list(F.struct(*held)).alias("held")).repartition(tasks, "i")
    mine = F.col("held") if not on else F.filter("held", lambda x: reduce(and_, (x[c] == F.col(c) for c in on)))
    return drawn.join(own.hint("shuffle_hash"), "i").select(*slots.columns, F.inline(F.transform(mine, lambda x: F.struct(*(x[c].alias(c) for c in held if c not in on)))))


def draws(items: DataFrame, replicates: int, *, seed: int, namespace: str, order: str = "pair_id") -> DataFrame:
    """replicate and the value columns of the drawn items: as many draws a
    replicate as there are items (one a pair, a small table), with replacement."""
    numbered_, n = numbered_items(items, order)
    spark = items.sparkSession
    name = F.concat_ws(":", F.col("replicate").cast("string"), F.col("slot").cast("string"))
    slots = numbered_.select(F.col("i").alias("slot")).crossJoin(F.broadcast(spark.range(replicates).select(F.col("id").cast("int").alias("replicate"))))
    at = slots.select("replicate", (hash_number(stable_rank(seed, namespace, name)) % F.lit(max(1, n))).alias("i"))
    return at.join(numbered_, "i").drop("i")


def did_bootstrap(deltas: DataFrame, replicates: int, *, seed: int = 1) -> DataFrame:
    """replicate, model, fraction and did: one draw of target items and one of clean
    items a replicate, shared by all models, seeds and fractions, and seeds drawn
    with replacement. Items are drawn first and averaged by (seed, model,
    fraction); seeds weigh by how often they were drawn."""
    def means(which: str) -> DataFrame:
        d = deltas.where(F.col("evaluation_set") == which)
        times = draws(d.select("pair_id").distinct(), replicates, seed=seed, namespace=f"boot:{which}").groupBy("replicate", "pair_id").agg(F.count("*").alias("times"))
        return d.join(times, "pair_id").groupBy("replicate", "model", "seed", "fraction").agg((F.sum(F.col("delta") * F.col("times")) / F.sum("times")).alias(which))

    seeds = draws(deltas.select("seed").distinct(), replicates, seed=seed, namespace="boot:seed", order="seed").groupBy("replicate", "seed").agg(F.count("*").alias("weight"))
    both = means("target").join(means("clean"), ["replicate", "model", "seed", "fraction"]).join(seeds, ["replicate", "seed"])
    return both.groupBy("replicate", "model", "fraction").agg((F.sum((F.col("target") - F.col("clean")) * F.col("weight")) / F.sum("weight")).alias("did"))


def effect_bootstrap(deltas: DataFrame, replicates: int, *, seed: int = 2) -> DataFrame:
    """replicate, model, fraction and effect, for one evaluation set."""
    times = draws(deltas.select("pair_id").distinct(), replicates, seed=seed, namespace="boot:effect").groupBy("replicate", "pair_id").agg(F.count("*").alias("times"))
    seeds = draws(deltas.select("seed").distinct(), replicates, seed=seed, namespace="boot:seed", order="seed").groupBy("replicate", "seed").agg(F.count("*").alias("weight"))
    m = deltas.join(times, "pair_id").groupBy("replicate", "model", "seed", "fraction").agg((F.sum(F.col("delta") * F.col("times")) / F.sum("times")).alias("mean"))
    return m.join(seeds, ["replicate", "seed"]).groupBy("replicate", "model", "fraction").agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("effect"))


def sign_randomization(deltas: DataFrame, replicates: int, *, seed: int = 3) -> DataFrame:
    """model, fraction, observed and p: each pair's delta keeps or changes its sign
    by a hash, independently by set, and the difference of means is compared with
    the observed one, counting it among the draws."""
    mean = deltas.groupBy("model", "fraction", "evaluation_set", "pair_id").agg(F.avg("delta").alias("delta")).where(F.col("evaluation_set").isin("target", "clean"))
    spark = deltas.sparkSession
    name = F.concat_ws(":", F.col("replicate").cast("string"), F.col("evaluation_set"), F.col("pair_id").cast("string"))
    r = mean.crossJoin(F.broadcast(spark.range(replicates).select(F.col("id").cast("int").alias("replicate"))))
    signed = F.when(is_odd(stable_rank(seed, "sign", name), 1), -F.col("delta")).otherwise(F.col("delta"))
    of = lambda s, v: F.avg(F.when(F.col("evaluation_set") == s, v))
    drawn = r.groupBy("model", "fraction", "replicate").agg((of("target", signed) - of("clean", signed)).alias("draw"))
    observed = mean.groupBy("model", "fraction").agg((of("target", F.col("delta")) - of("clean", F.col("delta"))).alias("observed"))
    return plus_one_p(drawn.join(observed, ["model", "fraction"]), ["model", "fraction"])


def plus_one_p(drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sided p of ``observed`` among ``draw``, with the observed one counted."""
    n = F.count_if(F.abs("draw") >= F.abs("observed") - 1e-12)
    return drawn.groupBy(*keys, "observed").agg(((n + 1) / (F.count("*") + 1)).alias("p"))


def position_permutation(deltas: DataFrame, replicates: int, *, seed: int = 4, evaluation_set: str = "target") -> DataFrame:
    """model, observed and p of the mean arrival contrast over seeds and fractions
    below 1, against positions dealt anew among the items in each replicate."""
    d = deltas.where((F.col("evaluation_set") == evaluation_set) & (F.col("fraction") < 1))
    items = d.select("pair_id", "position").distinct()
    spark = deltas.sparkSession
    r = items.crossJoin(F.broadcast(spark.range(-1, replicates).select(F.col("id").cast("int").alias("replicate"))))
    rank = stable_rank(seed, "perm", F.concat_ws(":", F.col("replicate").cast("string"), F.col("pair_id").cast("string")))
    by_hash, by_place = Window.partitionBy("replicate").orderBy(rank, "pair_id"), Window.partitionBy("replicate").orderBy("position", "pair_id")
    r = r.withColumn("a", F.row_number().over(by_hash)).withColumn("b", F.row_number().over(by_place))
    dealt = r.select("replicate", "pair_id", "a").join(r.select("replicate", F.col("b").alias("a"), F.col("position").alias("p")), ["replicate", "a"]).drop("a")
    real = items.select(F.lit(-1).alias("replicate"), "pair_id", F.col("position").alias("p"))
    dealt = dealt.where("replicate >= 0").unionByName(real)
    seen = F.col("p") < F.col("fraction")
    cells = d.join(dealt, "pair_id").groupBy("replicate", "model", "seed", "fraction").agg((F.avg(F.when(seen, F.col("delta"))) - F.avg(F.when(~seen, F.col("delta")))).alias("c"))
    means = cells.groupBy("replicate", "model").agg(F.avg("c").alias("draw"))
    observed = means.where("replicate = -1").select("model", F.col("draw").alias("observed"))
    return plus_one_p(means.where("replicate >= 0").join(observed, "model"), ["model"])


def intervals(draws_: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact 2.5 % and 97.5 % points, by linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws_.groupBy(*keys).agg(q.alias("q")).select(*keys, F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def winner_probabilities(values: DataFrame, replicates: int, *, seed: int = 5) -> DataFrame:
    """candidate and the share of replicates in which its mean is highest; rows
    (pair_id, candidate, correct) are drawn by pair, ties go to the smaller name."""
    times = draws(values.select("pair_id").distinct(), replicates, seed=seed, namespace="boot:winner").groupBy("replicate", "pair_id").agg(F.count("*").alias("times"))
    m = values.join(times, "pair_id").groupBy("replicate", "candidate").agg((F.sum(F.col("correct") * F.col("times")) / F.sum("times")).alias("m"))
    best = m.groupBy("replicate").agg(F.min_by("candidate", F.struct(-F.bround("m", 12), F.col("candidate"))).alias("candidate"))
    return best.groupBy("candidate").agg((F.count("*") / F.lit(replicates)).alias("probability"))


def _times(items: DataFrame, replicates: int, seed: int, namespace: str, order: str = "pair_id") -> DataFrame:
    """replicate, item and how often it is drawn."""
    return draws(items, replicates, seed=seed, namespace=namespace, order=order).groupBy("replicate", order).agg(F.count("*").alias("times"))


def candidate_means(values: DataFrame, replicates: int, *, seed: int = 6) -> DataFrame:
    """replicate, candidate, exposed and clean: mean accuracy over drawn pairs; the
    pairs of either set are drawn apart, and all candidates keep the same ones. Rounded,
    so that ties are ties in any order of adding."""
    def of(which: str, name: str) -> DataFrame:
        v = values.where(F.col("evaluation_set") == which)
        m = v.join(_times(v.select("pair_id").distinct(), replicates, seed, f"boot:{name}"), "pair_id")
        return m.groupBy("replicate", "candidate").agg(F.bround(F.sum(F.col("correct") * F.col("times")) / F.sum("times"), 12).alias(name))

    return of("target", "exposed").join(of("clean", "clean"), ["replicate", "candidate"])


def weighted_winners(means: DataFrame, replicates: int, weights: int = 101) -> DataFrame:
    """exposed_weight, candidate and winner_probability: the share of replicates in
    which the candidate is best by weight * exposed + (1 - weight) * clean; of equal ones
    the smaller. Candidates that never win have no row."""
    steps = means.sparkSession.range(weights).select((F.col("id") / F.lit(weights - 1)).alias("exposed_weight"))
    value = F.bround(F.col("exposed_weight") * F.col("exposed") + (1 - F.col("exposed_weight")) * F.col("clean"), 10)
    best = means.crossJoin(F.broadcast(steps)).groupBy("exposed_weight", "replicate").agg(F.min_by("candidate", F.struct(-value, F.col("candidate"))).alias("candidate"))
    return best.groupBy("exposed_weight", "candidate").agg((F.count("*") / F.lit(replicates)).alias("winner_probability"))


def endpoint_stability(means: DataFrame, summary: DataFrame, replicates: int) -> DataFrame:
    """criterion, candidate, winner_probability and whether it is the observed winner; all candidates."""
    def of(name: str, rank: str) -> DataFrame:
        best = means.groupBy("replicate").agg(F.min_by("candidate", F.struct(-F.col(name), F.col("candidate"))).alias("candidate"))
        wins = best.groupBy("candidate").agg((F.count("*") / F.lit(replicates)).alias("p"))
        return summary.join(wins, "candidate", "left").select(F.lit(name).alias("criterion"), "candidate", F.coalesce("p", F.lit(0.0)).alias("winner_probability"), (F.col(rank) == 1).alias("observed_winner"))

    return of("exposed", "exposed_rank").unionByName(of("clean", "clean_rank"))


def policy_bootstrap(predictions: DataFrame, replicates: int, *, target: str = "target", clean: str = "clean", downstream: str = "untouched", boundary: str = "naive", seed: int = 7) -> DataFrame:
    """replicate, model and what three policies differ in downstream: selecting the
    checkpoint on the target set, on the clean set, or taking the last one. Items of
    each set and seeds are drawn, and selection is made anew in every replicate; the
    earliest of equal checkpoints is selected."""
    p = predictions.where(F.col("boundary") == boundary)

    def means(which: str, name: str) -> DataFrame:
        v = p.where(F.col("evaluation_set") == which)
        m = v.join(_times(v.select("pair_id").distinct(), replicates, seed, f"boot:{name}"), "pair_id")
        return m.groupBy("replicate", "model", "seed", "fraction").agg(F.bround(F.sum(F.col("correct") * F.col("times")) / F.sum("times"), 12).alias("m"))

    key = ["replicate", "model", "seed"]
    pick = lambda which, name: means(which, name).groupBy(*key).agg(F.min_by("fraction", F.struct(-F.col("m"), F.col("fraction"))).alias(name))
    down = means(downstream, "downstream").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("fraction", "m"))).alias("at"), F.max_by("m", "fraction").alias("final"))  # a few checkpoints
    weights = _times(p.select("seed").distinct(), replicates, seed, "boot:seed", "seed").withColumnRenamed("times", "weight")
    both = pick(target, "target").join(pick(clean, "clean"), key).join(down, key).join(weights, ["replicate", "seed"])
    t, c = F.col("at")[F.col("target")], F.col("at")[F.col("clean")]
    mean = lambda x: F.sum(x * F.col("weight")) / F.sum("weight")
    return both.groupBy("replicate", "model").agg(mean(t - c).alias("target_minus_clean"), mean(t - F.col("final")).alias("target_minus_final"), mean(c - F.col("final")).alias("clean_minus_final"))


def arrival_bootstrap(deltas: DataFrame, replicates: int, *, seed: int = 8) -> DataFrame:
    """replicate, model, fraction, target, placebo and difference: arrival contrasts
    over drawn items, as ratios of drawn sums by seed, then over drawn seeds. ``deltas``
    has the position of every item; clean items have the placebo's. An arm that a
    replicate leaves without items raises."""
    def contrast(which: str, name: str) -> DataFrame:
        d = deltas.where((F.col("evaluation_set") == which) & (F.col("fraction") < 1))
        m = d.join(_times(d.select("pair_id").distinct(), replicates, seed, f"boot:{name}"), "pair_id")
        seen = F.col("position") < F.col("fraction")
        of = lambda arm: F.try_divide(F.sum(F.when(arm, F.col("delta") * F.col("times"))), F.sum(F.when(arm, F.col("times"))))
        empty = F.raise_error(F.concat(F.lit("an arm without items in replicate "), F.col("replicate").cast("string"))).cast("double")
        return m.groupBy("replicate", "model", "seed", "fraction").agg((of(seen) - of(~seen)).alias("c")).select("replicate", "model", "seed", "fraction", F.coalesce("c", empty).alias(name))

    weights = _times(deltas.select("seed").distinct(), replicates, seed, "boot:seed", "seed").withColumnRenamed("times", "weight")
    both = contrast("target", "target").join(contrast("clean", "placebo"), ["replicate", "model", "seed", "fraction"]).join(weights, ["replicate", "seed"])
    mean = lambda c: F.sum(F.col(c) * F.col("weight")) / F.sum("weight")
    return both.groupBy("replicate", "model", "fraction").agg(mean("target").alias("target"), mean("placebo").alias("placebo"), (mean("target") - mean("placebo")).alias("difference"))


def nested_bootstrap_native(pairs: DataFrame, replicates: int, *, seed: int = 9, sets: tuple[str, ...] = ("target", "clean", "untouched")) -> DataFrame:
    """replicate, model, for each set its accuracy under either boundary, did and the gap of the last set.

    Two levels of draws: seeds first, then for every drawn seed fresh items of each set. ``pairs`` has model,
    seed, evaluation_set, pair_id, naive and safe of whole runs. Values are averaged within a drawn seed, then over the drawn ones."""
    spark = pairs.sparkSession
    seeds, n_seeds = numbered_items(pairs.select("seed").distinct(), "seed")
    number = lambda what, *by: hash_number(stable_rank(seed, f"nested:{what}", F.concat_ws(":", *(F.col(c).cast("string") for c in by))))
    slots = spark.range(replicates).select(F.col("id").cast("int").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(max(0, n_seeds - 1)))).alias("slot"))
    slots = slots.withColumn("i", number("seed", "replicate", "slot") % F.lit(max(1, n_seeds))).join(F.broadcast(seeds), "i").select("replicate", "slot", "seed")
    out = None
    for which in sets:
        own = pairs.where(F.col("evaluation_set") == which)
        items, n = numbered_items(own.select("pair_id").distinct(), "pair_id")
        values = own.select("seed", "pair_id", "model", *(F.col(c).cast("double").alias(c) for c in ("naive", "safe")))
        drawn = drawn_rows(values, items, n, "pair_id", slots, number(which, "replicate", "slot", "k"), replicates * n_seeds, ("seed",))
        m = drawn.groupBy("replicate", "slot", "model").agg(F.avg("naive").alias("naive"), F.avg("safe").alias("safe"))
        m = m.groupBy("replicate", "model").agg(F.avg("naive").alias(f"{which}_naive"), F.avg("safe").alias(f"{which}_safe"))
        out = m if out is None else out.join(m, ["replicate", "model"])
    gap = lambda s: F.col(f"{s}_naive") - F.col(f"{s}_safe")
    return out.withColumns({"did": gap(sets[0]) - gap(sets[1]), f"{sets[-1]}_gap": gap(sets[-1])})


def ratio_bootstrap(sums: DataFrame, keys: list[str], replicates: int, *, seed: int = 10) -> DataFrame:
    """``keys``, replicate and ratio: hits over rows of drawn clusters. ``sums`` has a row a key and
    cluster, with hits and rows; whole clusters are drawn, the same ones for all keys."""
    drawn = _times(sums.select("cluster").distinct(), replicates, seed, "boot:cluster", "cluster")
    total = lambda c: F.sum(F.col(c) * F.col("times"))
    return sums.join(drawn, "cluster").groupBy(*keys, "replicate").agg(F.try_divide(total("hits"), total("rows")).alias("ratio"))


# --- parity mode: arrays of (model, seed, checkpoint, item) on the driver


def to_array(deltas: DataFrame, evaluation_set: str, most: int = 5_000_000) -> np.ndarray:
    """The deltas of a set as an array, for parity mode; more than ``most`` numbers raise."""
    d = deltas.where(F.col("evaluation_set") == evaluation_set).select("model", "seed", "fraction", "pair_id", "delta")
    if d.count() > most:
        raise ValueError("too many deltas for parity mode; use the native mode")
    p = d.toPandas().pivot_table(index=["model", "seed", "fraction"], columns="pair_id", values="delta")
    if p.isna().any().any():
        raise ValueError("the grid of deltas isn't complete")
    shape = [len(level) for level in p.index.levels]
    return p.sort_index().to_numpy().reshape(*shape, -1)


def _batches(replicates: int, size: int):
    return ((a, min(replicates, a + size)) for a in range(0, replicates, size))


def _means(x: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Mean over drawn items, as (replicate, model, seed, checkpoint)."""
    counts = np.stack([np.bincount(r, minlength=x.shape[-1]) for r in idx])
    return np.moveaxis(x @ counts.T / idx.shape[1], -1, 0)


def _weights(idx: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(r, minlength=n) for r in idx]) / idx.shape[1]


def parity_did(target: np.ndarray, clean: np.ndarray, *, replicates: int, seed: int, batch: int = 200) -> np.ndarray:
    """(replicate, model, checkpoint). The stream is drawn target, clean, seeds, batch by batch."""
    if target.ndim != 4 or target.shape[:3] != clean.shape[:3]:
        raise ValueError("arrays must be model x seed x checkpoint x item, and agree but for items")
    rng, out, s = np.random.default_rng(seed), [], target.shape[1]
    for a, b in _batches(replicates, batch):
        t, c = (rng.integers(0, x.shape[-1], size=(b - a, x.shape[-1])) for x in (target, clean))
        w = _weights(rng.integers(0, s, size=(b - a, s)), s)
        out.append(np.einsum("rmsc,rs->rmc", _means(target, t) - _means(clean, c), w))
    return np.concatenate(out)


def parity_effect(delta: np.ndarray, *, replicates: int, seed: int, batch: int = 250) -> np.ndarray:
    if delta.ndim != 4:
        raise ValueError("array must be model x seed x checkpoint x item")
    rng, out, s = np.random.default_rng(seed), [], delta.shape[1]
    for a, b in _batches(replicates, batch):
        i = rng.integers(0, delta.shape[-1], size=(b - a, delta.shape[-1]))
        out.append(np.einsum("rmsc,rs->rmc", _means(delta, i), _weights(rng.integers(0, s, size=(b - a, s)), s)))
    return np.concatenate(out)


def parity_policies(target: np.ndarray, clean: np.ndarray, downstream: list[np.ndarray], *, replicates: int, seed: int, batch: int = 150) -> list[dict[str, np.ndarray]]:
    """For each downstream set the three contrasts of selecting checkpoints on the
    target set, on the clean set, and taking the last one; selection is made anew
    in every replicate."""
    if not downstream:
        raise ValueError("a downstream array is needed")
    rng, s = np.random.default_rng(seed), target.shape[1]
    out: list[dict[str, list]] = [{"target_minus_clean": [], "target_minus_final": [], "clean_minus_final": []} for _ in downstream]
    for a, b in _batches(replicates, batch):
        drawn = [rng.integers(0, x.shape[-1], size=(b - a, x.shape[-1])) for x in (target, clean)]
        pick = [_means(x, i).argmax(axis=-1)[..., None] for x, i in zip((target, clean), drawn, strict=True)]
        w = _weights(rng.integers(0, s, size=(b - a, s)), s)
        for held, x in zip(out, downstream, strict=True):
            m = _means(x, rng.integers(0, x.shape[-1], size=(b - a, x.shape[-1])))
            t, c = (np.take_along_axis(m, p, axis=3)[..., 0] for p in pick)
            for k, v in (("target_minus_clean", t - c), ("target_minus_final", t - m[..., -1]), ("clean_minus_final", c - m[..., -1])):
                held[k].append(np.einsum("rms,rs->rm", v, w))
    return [{k: np.concatenate(v) for k, v in held.items()} for held in out]


def parity_arrival(target: np.ndarray, target_mask: np.ndarray, clean: np.ndarray, clean_mask: np.ndarray, *, replicates: int, seed: int, batch: int = 100) -> dict[str, np.ndarray]:
    """Arrival contrasts of target and placebo and their difference, (replicate,
    model, checkpoint), as ratios of drawn sums; an empty arm raises."""
    rng, s, out = np.random.default_rng(seed), target.shape[1], {"target": [], "placebo": [], "difference": []}

    def contrast(x: np.ndarray, mask: np.ndarray, idx: np.ndarray, w: np.ndarray) -> np.ndarray:
        counts = np.stack([np.bincount(r, minlength=x.shape[-1]) for r in idx]).astype(float)
        seen, other = np.einsum("sci,ri->rsc", mask, counts), np.einsum("sci,ri->rsc", ~mask, counts)
        if (seen == 0).any() or (other == 0).any():
            raise ValueError("a replicate has an arm without items")
        a = np.einsum("msci,ri->rmsc", x * mask, counts) / seen[:, None]
        b = np.einsum("msci,ri->rmsc", x * ~mask, counts) / other[:, None]
        return np.einsum("rmsc,rs->rmc", a - b, w)

    for a, b in _batches(replicates, batch):
        i, j = (rng.integers(0, x.shape[-1], size=(b - a, x.shape[-1])) for x in (target, clean))
        w = _weights(rng.integers(0, s, size=(b - a, s)), s)
        t, c = contrast(target, target_mask, i, w), contrast(clean, clean_mask, j, w)
        for k, v in (("target", t), ("placebo", c), ("difference", t - c)):
            out[k].append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def parity_permutation(delta: np.ndarray, positions: np.ndarray, thresholds: np.ndarray, *, replicates: int, seed: int, batch: int = 200) -> np.ndarray:
    """(replicate, model): the mean contrast with positions permuted within each seed."""
    rng, out = np.random.default_rng(seed), []
    for a, b in _batches(replicates, batch):
        p = rng.permuted(np.broadcast_to(positions, (b - a, *positions.shape)), axis=-1)
        mask = p[:, :, None, :] < np.asarray(thresholds)[None, None, :, None]
        n = mask.sum(axis=-1)
        seen = np.einsum("msci,rsci->rmsc", delta, mask) / n[:, None]
        other = np.einsum("msci,rsci->rmsc", delta, ~mask) / (delta.shape[-1] - n)[:, None]
        out.append((seen - other).mean(axis=(2, 3)))
    return np.concatenate(out)


def nested_bootstrap(target: np.ndarray, clean: np.ndarray, *, replicates: int, seed: int) -> np.ndarray:
    """Another design: seeds first, then fresh items for every drawn seed; (replicate, model) at the last checkpoint."""
    rng, s, out = np.random.default_rng(seed), target.shape[1], np.empty((replicates, target.shape[0]))
    for r in range(replicates):
        total = 0.0
        for k in rng.integers(0, s, size=s):
            i, j = (rng.integers(0, x.shape[-1], size=x.shape[-1]) for x in (target, clean))
            total = total + target[:, k, -1, i].mean(axis=-1) - clean[:, k, -1, j].mean(axis=-1)
        out[r] = total / s
    return out


def event_ols(rows: DataFrame, features: list[str], value: str, unit: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, XtX, Xty) where the last two are stacked by ``unit``: a unit's
    sufficient statistics are summed once, so a bootstrap only weighs them."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    sums = rows.groupBy(*unit).agg(*(F.sum(F.col(a) * F.col(b)).alias(f"x{i}") for i, (a, b) in enumerate(pairs)), *(F.sum(F.col(a) * F.col(value)).alias(f"y{i}") for i, a in enumerate(features))).toPandas()
    k, at = len(features), {f: i for i, f in enumerate(features)}
    xx, xy = np.zeros((len(sums), k, k)), sums[[f"y{i}" for i in range(k)]].to_numpy(float)
    for i, (a, b) in enumerate(pairs):
        xx[:, at[a], at[b]] = xx[:, at[b], at[a]] = sums[f"x{i}"].to_numpy(float)
    return np.linalg.lstsq(xx.sum(axis=0), xy.sum(axis=0), rcond=None)[0], xx, xy


def ols_bootstrap(xx: np.ndarray, xy: np.ndarray, *, replicates: int, seed: int) -> np.ndarray:
    rng, n = np.random.default_rng(seed), len(xx)
    w = np.stack([np.bincount(rng.integers(0, n, size=n), minlength=n) for _ in range(replicates)]).astype(float)
    return np.stack([np.linalg.lstsq(np.tensordot(r, xx, 1), r @ xy, rcond=None)[0] for r in w])
