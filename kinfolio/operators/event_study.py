"""Event-aligned estimates: effects by time since an ancestor's arrival, adjusted and bootstrapped.

The design has factors only (time bin, slot, checkpoint), so a replicate's normal
equations are made of counts and sums by cell: items and seeds that are
drawn weigh cells in one grouping, and a few numbers a replicate are solved in tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.canonical import hash_number, stable_rank
from ..functions.numbers import event_bin
from .resample import drawn_rows, intervals, numbered_items
from .splits import numbered

#: Where time bins end.
EVENT_EDGES = (-0.8, -0.4, -0.2, 0.0, 0.2, 0.4, 0.8)
#: A pivot below this means that a column follows from those before it.
PIVOT = 1e-9


def event_rows(target: DataFrame, clean: DataFrame, fractions: tuple[float, ...], *, time: Column | None = None, edges: tuple[float, ...] = EVENT_EDGES, strict: bool = True) -> DataFrame:
    """seed, item, checkpoint, bin and outcome: what each target item's delta has over that of
    its placebo. Of each seed the target items in order of position meet the clean items in order
    of their hash. ``target`` has seed, fraction, pair_id, position and delta, ``clean`` all but position. With
    ``strict`` both must have as many items; else the longer one's last ones are left out."""
    seeds = sorted(r["seed"] for r in target.select("seed").distinct().collect())  # a few
    place = lambda d, s: d.where(F.col("seed") == s).select("pair_id", *(c for c in ("position",) if c in d.columns)).distinct()
    maps = []
    for s in seeds:
        t = numbered(place(target, s), F.struct("position", "pair_id"), "item", part=F.floor(F.col("position") * 256))
        c = numbered(place(clean, s), stable_rank(s, "clean_placebo_arrival", F.col("pair_id")), "item")
        if strict and (a := t.count()) != (b := c.count()):
            raise ValueError(f"seed {s}: {a} target items and {b} clean ones")
        maps.append(t.select("item", "position", F.col("pair_id").alias("target_id")).join(c.select("item", F.col("pair_id").alias("clean_id")), "item").withColumn("seed", F.lit(s)))
    both = reduce(DataFrame.unionByName, maps)
    of = lambda d, name: d.where(F.col("fraction").isin(*fractions)).select("seed", "fraction", F.col("pair_id").alias(f"{name}_id"), F.col("delta").alias(name))
    rows = both.join(of(target, "target"), ["seed", "target_id"]).join(of(clean, "clean"), ["seed", "fraction", "clean_id"])
    checkpoint = F.array_position(F.array(*map(F.lit, fractions)), F.col("fraction")).cast("int") - 1
    return rows.select("seed", "item", checkpoint.alias("checkpoint"), event_bin(F.col("fraction") - F.col("position") if time is None else time, edges).alias("bin"), (F.col("target") - F.col("clean")).alias("outcome"))


def swept(equations: np.ndarray) -> np.ndarray:
    """The solution of normal equations (a row a parameter, the right side last). A parameter that follows
    from those before it is 0."""
    m = equations.astype(float)
    for k in range(len(m)):
        if abs(m[k, k]) < PIVOT:
            m[k] = 0.0
            continue
        m[k] /= m[k, k]
        others = np.arange(len(m)) != k
        m[others] -= m[others, k : k + 1] * m[k]
    return m[:, -1]


def marginal_means(cells: list[dict], bins: int, slots: int, checkpoints: int) -> list[float | None]:
    """For each bin the fitted outcome, averaged over slots and checkpoints; null for a bin
    without observations. ``cells`` has slot, bin, checkpoint, n and y, the sum of outcomes."""
    width = bins + slots + checkpoints - 2
    equations, seen = np.zeros((width, width + 1)), set()
    for c in cells:
        at = [0, *([c["bin"]] if c["bin"] else []), *([bins - 1 + c["slot"]] if c["slot"] else []), *([bins + slots - 2 + c["checkpoint"]] if c["checkpoint"] else [])]
        equations[np.ix_(at, at)] += c["n"]
        equations[at, -1] += c["y"]
        seen.add(c["bin"])
    beta = swept(equations)
    rest = beta[0] + beta[bins : bins + slots - 1].sum() / slots + beta[bins + slots - 1 :].sum() / checkpoints
    return [float(rest + (beta[b] if b else 0.0)) if b in seen else None for b in range(bins)]


@F.arrow_udf(ArrayType(DoubleType()))
def _means(cells: pa.Array, bins: pa.Array, slots: pa.Array, checkpoints: pa.Array) -> pa.Array:
    return pa.array([marginal_means(*x) for x in zip(*(c.to_pylist() for c in (cells, bins, slots, checkpoints)), strict=True)], pa.list_(pa.float64()))


def event_draws(rows: DataFrame, replicates: int, *, seed: int = 11, bins: int = len(EVENT_EDGES) - 1, checkpoints: int) -> DataFrame:
    """replicate, bin and estimate; replicate -1 is the observed one. A slot stands for each seed: in a
    replicate every slot draws a seed, then items of its own, with replacement."""
    spark = rows.sparkSession
    seeds, n_seeds = numbered_items(rows.select("seed").distinct(), "seed")
    items, n_items = numbered_items(rows.select("item").distinct(), "item")
    draw = lambda what, *by: hash_number(stable_rank(seed, f"event:{what}", F.concat_ws(":", *(F.col(c).cast("string") for c in by))))
    slots = spark.range(replicates).select(F.col("id").cast("int").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))).alias("slot"))
    slots = slots.withColumn("i", draw("seed", "replicate", "slot") % F.lit(n_seeds)).join(F.broadcast(seeds), "i").select("replicate", "slot", "seed")
    weighed = drawn_rows(rows, items, n_items, "item", slots, draw("item", "replicate", "slot", "k"), replicates * n_seeds, ("seed",))
    own = rows.join(F.broadcast(seeds.withColumnRenamed("i", "slot")), "seed").select(F.lit(-1).alias("replicate"), F.col("slot").cast("int").alias("slot"), "checkpoint", "bin", "outcome")
    cells = weighed.drop("seed").unionByName(own).groupBy("replicate", "slot", "bin", "checkpoint").agg(F.count("*").cast("double").alias("n"), F.sum("outcome").alias("y"))
    whole = cells.groupBy("replicate").agg(F.collect_list(F.struct("slot", "bin", "checkpoint", "n", "y")).alias("cells"))  # slots x bins x checkpoints at most
    return whole.select("replicate", F.posexplode(_means("cells", F.lit(bins), F.lit(n_seeds), F.lit(checkpoints))).alias("bin", "estimate"))


def event_study(rows: DataFrame, replicates: int, *, checkpoints: int, **how) -> DataFrame:
    """bin, estimate, low, high (in points) and observations."""
    d = event_draws(rows, replicates, checkpoints=checkpoints, **how)
    seen = rows.groupBy("bin").agg(F.count("*").alias("observations"))
    point = d.where("replicate = -1").select("bin", (F.col("estimate") * 100).alias("estimate"))
    spread = intervals(d.where("replicate >= 0").withColumn("estimate", F.col("estimate") * 100), ["bin"], "estimate")
    return point.join(spread, "bin", "left").join(seen, "bin", "left").select("bin", "estimate", "low", "high", F.coalesce("observations", F.lit(0)).alias("observations"))
