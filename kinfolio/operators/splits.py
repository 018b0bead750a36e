"""Matched, leak-controlled splits: ranks by hash, donors, quotas, slots."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import is_odd, stable_rank
from .digests import list_digests


def best_per(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """The row of least rank of each key; a grouped minimum, summed before it is shuffled."""
    kept = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(rank, *keys)).alias("best"))
    return out.select(*keys, "best.*")


def dedup_by_hash(rows: DataFrame, key: str) -> DataFrame:
    """One row of each hash; rows that share it are the same."""
    return rows.dropDuplicates([key])


def top_by_hash(rows: DataFrame, rank: Column, n: int, skip: int = 0) -> DataFrame:
    """Rows ``skip`` to ``skip + n`` by rank; raises if there are fewer."""
    out = rows.withColumn("__rank", rank).orderBy("__rank").limit(skip + n)
    if skip:
        out = out.orderBy("__rank").offset(skip)
    if (found := out.count()) < n:
        raise ValueError(f"{found} rows where {n} are needed")
    return out.drop("__rank")


def donors(targets: DataFrame, pool: DataFrame, on: str, *, seed: int) -> DataFrame:
    """target_id and donor_id: of the pool rows that share ``on`` with a target the
    one of least rank in that target's namespace; then of the targets that chose
    the same donor the one of least rank. Equal to going through targets in rank
    order, since each has chosen before."""
    pairs = targets.select("target_id", on).join(pool.select("donor_id", on), on)
    rank = stable_rank(seed, F.concat(F.lit("donor_for:"), F.col("target_id").cast("string")), F.col("donor_id"))
    chosen = pairs.groupBy("target_id").agg(F.min_by("donor_id", F.struct(rank, "donor_id")).alias("donor_id"))
    claim = F.struct(stable_rank(seed, "target", F.col("target_id")), "target_id")
    return chosen.groupBy("donor_id").agg(F.min_by("target_id", claim).alias("target_id")).select("target_id", "donor_id")


def strict_clean(rows: DataFrame, *taken: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose value in each column isn't in the table given with it."""
    for other, on in taken:
        rows = rows.join(other.select(on).distinct(), on, "left_anti")
    return rows


def capacities(targets: DataFrame, clean: DataFrame, stratum: str = "stratum") -> DataFrame:
    """What each stratum can hold: its targets, or half of its clean rows if fewer."""
    t, c = targets.groupBy(stratum).agg(F.count("*").alias("t")), clean.groupBy(stratum).agg(F.count("*").alias("c"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return t.join(c, stratum, "full").select(stratum, F.least(zero("t"), F.floor(zero("c") / 2)).cast("long").alias("capacity"))


def quotas(capacity: DataFrame, total: int, stratum: str = "stratum") -> DataFrame:
    """Exactly ``total`` slots in proportion to capacities, by largest remainder,
    none above its capacity. One pass over the strata, which are few. Raises if
    capacities are short."""
    usable = capacity.where("capacity > 0")
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = usable.withColumn("sum", F.sum("capacity").over(all_rows)).withColumn("raw", F.lit(total) * F.col("capacity") / F.col("sum"))
    c = c.withColumn("base", F.least("capacity", F.floor("raw"))).withColumn("rest", F.lit(total) - F.sum("base").over(all_rows))
    order = Window.orderBy((F.col("raw") - F.floor("raw")).desc(), F.col("capacity").desc(), stratum)
    quota = F.least("capacity", F.col("base") + (F.row_number().over(order) <= F.col("rest")).cast("long"))
    short = F.concat(F.lit("only "), F.col("sum").cast("string"), F.lit(f" matched slots are available, {total} are needed"))
    return c.select(stratum, "capacity", F.when(F.col("sum") < total, F.raise_error(short).cast("long")).otherwise(quota).alias("quota"))


def nearest_pairs(targets: DataFrame, clean: DataFrame, quota: DataFrame, *, seed: int) -> DataFrame:
    """For each stratum its first ``quota`` targets by rank, and for each of these,
    in turn, the two nearest clean rows that are left, by squared distance of
    their features and then by rank; a hash says which validates and which tests.

    Both tables have id, stratum and features (array of two). Turns depend on each
    other within a stratum only, so a stratum is one Arrow group; it holds
    targets up to the quota and the stratum's clean ids and features.
    """
    q = targets.join(F.broadcast(quota.select("stratum", "quota")), "stratum")
    rank = stable_rank(seed, F.concat(F.lit("target:"), F.col("stratum")), F.col("id"))
    w = Window.partitionBy("stratum").orderBy("rank", "id")
    q = q.withColumn("rank", rank).withColumn("nth", F.row_number().over(w)).where("nth <= quota")
    coin = is_odd(stable_rank(seed, "clean_arm", F.col("id")), 8)
    q = q.select("stratum", "id", "nth", "features", coin.alias("coin"))
    c = clean.select(*(F.col(n).alias(n) for n in ("stratum", "id", "features")), stable_rank(seed, "clean_nearest_tie", F.col("id")).alias("tie"))

    def match(t: pa.Table, pool: pa.Table) -> pa.Table:
        t, pool = t.sort_by("nth"), pool.sort_by("tie")
        out = {k: [] for k in ("stratum", "target_id", "validation_id", "test_id")}
        ids, x = pool.column("id").to_pylist(), np.array(pool.column("features").to_pylist(), float).reshape(-1, 2)
        free = np.ones(len(ids), bool)
        for stratum, target, f, odd in zip(*(t.column(k).to_pylist() for k in ("stratum", "id", "features", "coin")), strict=True):
            if free.sum() < 2:
                raise ValueError(f"stratum {stratum} ran out of clean rows")
            d = np.where(free, ((x - np.array(f)) ** 2).sum(axis=1), np.inf)
            second = np.partition(d, 1)[1]
            near = np.flatnonzero(d <= second)
            near = near[np.argsort(d[near], kind="stable")][:2]
            free[near] = False
            left, right = (ids[i] for i in near)
            for k, v in zip(out, (stratum, target, *((left, right) if odd else (right, left))), strict=True):
                out[k].append(v)
        kind = t.schema.field("id").type
        return pa.table({"stratum": pa.array(out["stratum"], pa.string()), **{k: pa.array(out[k], kind) for k in list(out)[1:]}})

    kind = targets.schema["id"].dataType.simpleString()
    return q.groupBy("stratum").cogroup(c.groupBy("stratum")).applyInArrow(match, f"stratum string, target_id {kind}, validation_id {kind}, test_id {kind}")


def numbered(rows: DataFrame, rank: Column, name: str, *, part: Column | None = None) -> DataFrame:
    """Adds ``name``: 0-based numbers in rank order over the whole table. Rows are
    dealt out by ranges of the rank's first digits (a hash, so ranges are even), or by
    ``part``, which rises with the rank; parts are counted and numbered within, so
    nothing is sorted in one task."""
    d = rows.withColumn("__rank", rank).withColumn("__part", F.substring("__rank", 1, 2) if part is None else part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))  # 256 rows
    within = Window.partitionBy("__part").orderBy("__rank")
    d = d.join(F.broadcast(counts.select("__part", "__before")), "__part")
    return d.withColumn(name, (F.col("__before") + F.row_number().over(within) - 1).cast("long")).drop("__rank", "__part", "__before")


def slots(base: DataFrame, boundary: DataFrame, *, seed: int) -> DataFrame:
    """position, kind (base or boundary) and id: both tables' ids in one seeded
    order. Training files that fill boundary slots with donors or with fillers,
    by number, differ there alone."""
    all_ = base.select("id", F.lit("base").alias("kind")).unionByName(boundary.select("id", F.lit("boundary").alias("kind")))
    return numbered(all_, stable_rank(seed, F.concat(F.lit("slot:"), F.col("kind")), F.col("id")), "position")


def boundary_counts(slotted: DataFrame, n: int | Column, intervals: int = 5) -> DataFrame:
    """Boundary rows that arrive in each of so many equal stretches."""
    total = n if isinstance(n, Column) else F.lit(n)
    bucket = F.least(F.lit(intervals), F.floor(F.col("position") * intervals / total) + 1) * (100 // intervals)
    return slotted.where("kind = 'boundary'").groupBy(bucket.cast("int").alias("percent")).agg(F.count("*").alias("boundary_rows"))


def crossings(sets: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """left_set, right_set and shared values of pairs of sets (columns set_name and
    value); pairs in ``allowed`` are left out. Sets are few: each value's sets are
    gathered once, and pairs are made of these."""
    per = sets.distinct().groupBy("value").agg(F.sort_array(F.collect_set("set_name")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda b: F.struct(a.alias("left_set"), b.alias("right_set")))))
    out = per.select(F.inline(pairs)).groupBy("left_set", "right_set").agg(F.count("*").alias("shared"))
    return out.join(allowed, ["left_set", "right_set"], "left_anti") if allowed is not None else out


def total_variation(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: half the summed difference of two distributions; 1 if one is empty."""
    both = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    g = both.groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    n = g.agg(F.sum("l").alias("ln"), F.sum("r").alias("rn"))
    return g.crossJoin(F.broadcast(n)).agg(F.when(F.coalesce(F.min(F.least("ln", "rn")), F.lit(0)) == 0, 1.0).otherwise(F.sum(F.abs(F.try_divide("l", "ln") - F.try_divide("r", "rn"))) / 2).alias("total_variation"))


def standardized_mean_difference(rows: DataFrame, value: str, left: Column) -> DataFrame:
    """One row: difference of means over the pooled deviation; 0 if that is 0."""
    l, r = F.when(left, F.col(value)), F.when(~left, F.col(value))  # noqa: E741
    pooled = F.sqrt((F.var_samp(l) + F.var_samp(r)) / 2)
    smd = F.when(pooled == 0, 0.0).otherwise((F.avg(l) - F.avg(r)) / pooled)
    few = F.least(F.count(l), F.count(r)) < 2
    return rows.agg(F.when(few, F.raise_error(F.lit("two observations of each group are needed")).cast("double")).otherwise(smd).alias("smd"))


def assert_balanced(tv: float, *differences: float, most_tv: float = 0.05, most_smd: float = 0.15) -> None:
    if tv > most_tv or any(abs(d) > most_smd for d in differences):
        raise AssertionError(f"unbalanced: total variation {tv}, mean differences {differences}")


def ordered_hash(rows: DataFrame, position: str, identifier: str) -> DataFrame:
    """One row: the hash of ids joined by line ends in order of position, fed one by one."""
    text = F.col(identifier).cast("string")
    return list_digests(rows, [], [F.col(position), text], text, between="\n", name="order_hash")


def component_disjoint(rows: DataFrame, component: str, *, development: int, base: int, seed: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """A development set, one row a component, and a base set from other components."""
    one = best_per(rows, [component], stable_rank(seed, "development", F.col(key)))
    dev = top_by_hash(one, stable_rank(seed, "development", F.col(key)), development)
    rest = rows.join(dev.select(component), component, "left_anti")
    return dev, top_by_hash(rest, stable_rank(seed, "base", F.col(key)), base)


def disjoint_mixture(rows: DataFrame, shared: DataFrame, *, excluded: DataFrame, contexts: DataFrame, development: int, base: int, retained: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A development set, a base set and retained shared rows, where no component of
    the development set is in the others.

    ``rows`` and ``shared`` have id, component and context. Rows of components in
    ``excluded`` or with contexts in ``contexts`` don't count; of each component and context
    the row of least rank stands for all. Development rows come from components without
    shared rows, base rows from components that the development set leaves. Raises if
    either is short."""
    rank = lambda ns: stable_rank(seed, ns, F.col("id"))
    clean = strict_clean(rows.select("id", "component", "context"), (excluded, "component"), (contexts, "context"))
    one = best_per(clean, ["component", "context"], F.struct(rank("within_component"), F.col("id")))
    dev = top_by_hash(one.join(shared.select("component").distinct(), "component", "left_anti"), rank("development"), development)
    train = top_by_hash(one.join(dev.select("component").distinct(), "component", "left_anti"), rank("training"), base)
    return dev, train, top_by_hash(shared.select("id", "component", "context"), rank("retained"), retained)
