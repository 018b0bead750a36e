"""Joins against a table that is usually small but has no proven size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 100_000
#: Copies of the other table beyond that; a key with a third of all rows is dealt out to as many tasks.
SALTS = 64


#: Keys that are sent along at most: those that hold one row in so many, of which there can't be more.
HEAVY = 10_000


def join_heavy(big: DataFrame, sums: DataFrame, on: list[str], spread: Column, *, count: str = "n") -> DataFrame:
    """``big`` joined to ``sums``, which has one row a key and how many rows of ``big`` hold it in
    ``count``; rows without a key in ``sums`` are left out.

    Keys with one row in HEAVY or more are sent to all tasks, HEAVY rows at most by their counts alone. Rows that
    found theirs are dealt out by ``spread`` for the rest of the way, all others by their key. So no
    task gets a key's rows, however many they are, and nothing depends on splitting at run time."""
    values = [c for c in sums.columns if c not in on]
    taken = {c.lower() for c in [*big.columns, *sums.columns]}

    def own(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        return name

    total, salt, its_salt = own("total"), own("salt"), own("salt")
    keys, found = {k: own(f"{k}_") for k in on}, {v: own(f"{v}_") for v in values}
    heavy = sums.crossJoin(F.broadcast(sums.agg(F.sum(count).alias(total)))).where(F.col(count) * HEAVY >= F.col(total)).drop(total)
    heavy = heavy.withColumnsRenamed(keys | found)
    b = big.join(F.broadcast(heavy), [big[k] == heavy[v] for k, v in keys.items()], "left").drop(*keys.values())
    b = b.withColumn(salt, F.when(F.col(found[count]).isNotNull(), F.pmod(F.xxhash64(spread), F.lit(HEAVY)) + 1).otherwise(0))
    light = sums.withColumnsRenamed(keys).withColumn(its_salt, F.least(F.col(count).cast("long"), F.lit(0)))  # 0; a literal would leave the join's keys
    out = b.join(light, [*(b[k] == light[v] for k, v in keys.items()), b[salt].cast("long") == light[its_salt]], "left")
    out = out.withColumns({v: F.coalesce(f, v) for v, f in found.items()})
    return out.where(F.col(count).isNotNull()).drop(salt, its_salt, *keys.values(), *found.values())


def join_counted(big: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "inner", *, rows: int | None = None) -> DataFrame:
    """``big`` joined null-safely to ``small``, whose rows are counted first, or are known
    to be ``rows`` at most.

    Up to BROADCAST_ROWS rows are broadcast. A larger ``small`` is copied SALTS
    times and joined on its key and a salt made of ``spread``, so that no key of
    ``big`` meets in one task. Columns of ``small`` named in ``on`` are dropped.
    """
    taken = {c.lower() for c in [*big.columns, *small.columns]}

    def own(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        return name

    keys = {k: own(f"{k}_") for k in on}
    small = small.withColumnsRenamed(keys)
    same = [big[k].eqNullSafe(small[v]) for k, v in keys.items()]
    if (small.count() if rows is None else rows) <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), same, how).drop(*keys.values())
    salt, its = own("salt"), own("salt")
    big = big.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    small = small.withColumn(its, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = [big[k].eqNullSafe(small[v]) for k, v in keys.items()] + [big[salt] == small[its]]
    return big.join(small, same, how).drop(salt, its, *keys.values())
