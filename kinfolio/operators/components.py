"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.joins import join_heavy
from ..plans.lineage import cut

#: Rounds after which something must be wrong; the rounds needed grow with the logarithm of the longest path.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component of every node in ``edges`` (columns a and b); a
    component is named by its least node.

    Each round links every node to the least of its neighbours (large star),
    then hangs its smaller neighbours below that one (small star), as in
    Kiveris et al., SoCC 2014. A round is two grouped minima, summed before they
    are shuffled, and two joins that send heavy nodes' minima along, so no task gets
    all edges of a node; it is one job, written to the shared folder, so a lost executor
    costs one round at most. Edges with a
    null end and loops link nothing. Without edges the result is empty.
    """

    def written(e: DataFrame) -> tuple[DataFrame, dict]:
        """``e`` in the shared folder, with its count and hash as of that writing."""
        seen = Observation()
        return cut(e.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("all")), "components"), seen.get

    e, state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MOST_ROUNDS):
        if not state["n"]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_heavy(both.where("v > u"), least, ["u"], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_heavy(large, low, ["u"], F.col("v")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, (e, state) = state, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if state == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
