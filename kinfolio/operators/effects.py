"""Effects on saved predictions: paired gaps, differences of them, selection, arrival.

Predictions are long: model, seed, boundary, fraction, evaluation_set, pair_id,
label, margin, correct. The two boundaries meet by one grouping, not by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import wilson
from .digests import list_digests

CELL = ["model", "seed", "fraction", "evaluation_set"]


def paired(predictions: DataFrame, value: str = "correct") -> DataFrame:
    """delta, naive minus safe, for each pair; a pair without both raises."""
    side = lambda b: F.max(F.when(F.col("boundary") == b, F.col(value).cast("double")))
    wide = predictions.groupBy(*CELL, "pair_id").agg(side("naive").alias("naive"), side("safe").alias("safe"))
    lost = F.raise_error(F.concat(F.lit("no partner for pair "), F.col("pair_id").cast("string"))).cast("double")
    return wide.withColumn("delta", F.coalesce(F.col("naive") - F.col("safe"), lost))


def accuracy_cells(predictions: DataFrame) -> DataFrame:
    m = F.col("margin")
    return predictions.groupBy("model", "seed", "boundary", "fraction", "evaluation_set").agg(
        F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg(m).alias("margin_mean"), F.stddev_samp(m).alias("margin_std"), F.avg((m > 0).cast("double")).alias("positive_margin_rate"))


def collapse_block(predictions: DataFrame) -> DataFrame:
    """Wilson bounds, spread of margins, and whether scores have collapsed, by cell."""
    m = F.col("margin")
    g = predictions.groupBy("model", "seed", "boundary", "fraction", "evaluation_set").agg(
        F.count("*").alias("n"), F.sum("correct").alias("k"), F.median(m).alias("margin_median"), F.min(m).alias("margin_min"), F.max(m).alias("margin_max"),
        F.stddev_samp(m).alias("margin_std"), F.count_distinct(F.bround(m, 4)).alias("distinct_margins"), F.bool_and(~F.isnan(m) & (F.abs(m) < float("inf"))).alias("finite"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.withColumns({"wilson_low": low, "wilson_high": high, "noncollapsed": (F.col("margin_std") >= 0.05) & (F.col("distinct_margins") >= 10)})


def auroc(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the curve by rank sums with average ranks. Equal margins are
    grouped first, so the window runs over distinct margins of a cell."""
    g = predictions.groupBy(*keys, "margin").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    before = Window.partitionBy(*keys).orderBy("margin").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    s = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    return s.select(*keys, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auroc"))


def paired_gaps(predictions: DataFrame) -> DataFrame:
    return paired(predictions).groupBy(*CELL).agg(F.avg("delta").alias("gap"), F.count("*").alias("pairs"))


def did_by_seed(deltas: DataFrame) -> DataFrame:
    """Target minus clean gap by model, seed and fraction."""
    of = lambda s: F.avg(F.when(F.col("evaluation_set") == s, F.col("delta")))
    return deltas.groupBy("model", "seed", "fraction").agg((of("target") - of("clean")).alias("did"))


def did(deltas: DataFrame) -> DataFrame:
    return did_by_seed(deltas).groupBy("model", "fraction").agg(F.avg("did").alias("did"))


def seed_representatives(predictions: DataFrame) -> DataFrame:
    """Seeds of a model that predict alike, by a digest of all they predict; the first stands for them."""
    order = ["boundary", "fraction", "evaluation_set", "pair_id", "correct"]
    text = F.concat_ws(":", *(F.col(c).cast("string") for c in order))
    digests = list_digests(predictions, ["model", "seed"], [F.col(c) for c in order], text, between=",")
    return digests.groupBy("model", "digest").agg(F.min("seed").alias("representative"), F.count("*").alias("seeds")).select("model", "representative", "seeds")


def interactions(deltas: DataFrame, left: str, right: str) -> DataFrame:
    """Difference of two models' differences-in-differences, by fraction."""
    of = lambda m: F.avg(F.when(F.col("model") == m, F.col("did")))
    return did_by_seed(deltas).where(F.col("model").isin(left, right)).groupBy("fraction").agg((of(left) - of(right)).alias("interaction"))


def selected(accuracy: DataFrame, evaluation_set: str) -> DataFrame:
    """model, seed and the earliest fraction of highest accuracy."""
    best = F.min_by("fraction", F.struct(-F.col("accuracy"), F.col("fraction")))
    return accuracy.where(F.col("evaluation_set") == evaluation_set).groupBy("model", "seed").agg(best.alias("fraction"))


def selection_regret(predictions: DataFrame, *, target: str = "target", clean: str = "clean", downstream: str = "untouched", boundary: str = "naive") -> DataFrame:
    """What selecting checkpoints on the target set gains downstream over selecting
    on the clean set, by model."""
    acc = predictions.where(F.col("boundary") == boundary).groupBy("model", "seed", "fraction", "evaluation_set").agg(F.avg("correct").alias("accuracy"))
    down = acc.where(F.col("evaluation_set") == downstream).select("model", "seed", "fraction", "accuracy")
    of = lambda s, name: selected(acc, s).join(down, ["model", "seed", "fraction"]).select("model", "seed", F.col("accuracy").alias(name))
    return of(target, "a").join(of(clean, "b"), ["model", "seed"]).groupBy("model").agg(F.avg(F.col("a") - F.col("b")).alias("regret"))


def arrival_contrast(deltas: DataFrame, evaluation_set: str = "target") -> DataFrame:
    """Mean delta of items whose ancestor has arrived (position below fraction)
    minus that of the others, by seed, then over seeds; full runs have no others."""
    d = deltas.where((F.col("evaluation_set") == evaluation_set) & (F.col("fraction") < 1))
    seen = F.col("position") < F.col("fraction")
    by_seed = d.groupBy("model", "fraction", "seed").agg((F.avg(F.when(seen, F.col("delta"))) - F.avg(F.when(~seen, F.col("delta")))).alias("contrast"))
    return by_seed.groupBy("model", "fraction").agg(F.avg("contrast").alias("contrast"))


def arrival_counts(positions: DataFrame, fractions: tuple[float, ...]) -> DataFrame:
    """Items that have arrived at each fraction; the fractions are a few thresholds."""
    t = positions.sparkSession.createDataFrame([(f,) for f in fractions], "fraction double")
    return positions.crossJoin(F.broadcast(t)).groupBy("fraction").agg(F.count_if(F.col("position") < F.col("fraction")).alias("arrived"), F.count("*").alias("items"))


def trajectories(did_rows: DataFrame) -> DataFrame:
    """Area under a model's trajectory (trapezoids), its mean height, and the first fraction at 0.05 or more."""
    w = Window.partitionBy("model").orderBy("fraction")
    step = F.col("fraction") - F.lag("fraction").over(w)
    d = did_rows.withColumn("area", step * (F.col("did") + F.lag("did").over(w)) / 2)
    span = F.max("fraction") - F.min("fraction")
    return d.groupBy("model").agg(F.sum("area").alias("auc"), F.try_divide(F.sum("area"), span).alias("mean_height"), F.min(F.when(F.col("did") >= 0.05, F.col("fraction"))).alias("first_at_5_points"))


def model_rankings(accuracy: DataFrame) -> DataFrame:
    """Models by mean accuracy over seeds, in each boundary, set and fraction. Means are rounded before they
    are ranked: the order in which seeds are added up must not part equal models."""
    a = accuracy.groupBy("boundary", "fraction", "evaluation_set", "model").agg(F.round(F.avg("accuracy"), 9).alias("accuracy"))
    return a.withColumn("rank", F.rank().over(Window.partitionBy("boundary", "fraction", "evaluation_set").orderBy(F.col("accuracy").desc())))


def discordance(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the 2 x 2 table of naive and safe."""
    a, b = F.col("naive") > 0.5, F.col("safe") > 0.5
    return paired(predictions).groupBy(*keys).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("naive_only"), F.count_if(~a & b).alias("safe_only"), F.count_if(~a & ~b).alias("neither"))


def event_effects(deltas: DataFrame, bin_: Column, keys: list[str]) -> DataFrame:
    """Mean delta by event bin."""
    return deltas.withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.avg("delta").alias("effect"), F.count("*").alias("n"))


def wide(cells: DataFrame, keys: list[str], names: list[str], value: str, expected: list[str]) -> DataFrame:
    """One column for each expected name."""
    return cells.withColumn("__name", F.concat_ws("_", *names)).groupBy(*keys).pivot("__name", expected).agg(F.first(value))


def winner_regions(lines: DataFrame) -> DataFrame:
    """Where on [0, 1] each candidate of (candidate, clean, exposed) is highest on
    the line from clean to exposed: left, right, candidate. Candidates are few;
    crossings are pairs of them. Ties go to the smaller name; neighbours merge."""
    a, b = lines.alias("a"), lines.alias("b")
    gap, slope = F.col("a.clean") - F.col("b.clean"), (F.col("b.exposed") - F.col("b.clean")) - (F.col("a.exposed") - F.col("a.clean"))
    x = a.join(b, F.col("a.candidate") < F.col("b.candidate")).select(F.try_divide(gap, slope).alias("x")).where("x > 0 and x < 1")
    x = x.union(lines.sparkSession.createDataFrame([(0.0,), (1.0,)], "x double")).distinct()
    cuts = x.withColumn("right", F.lead("x").over(Window.orderBy("x"))).where("right is not null")
    mid = (F.col("x") + F.col("right")) / 2
    height = F.col("clean") + mid * (F.col("exposed") - F.col("clean"))
    best = cuts.crossJoin(F.broadcast(lines)).groupBy("x", "right").agg(F.min_by("candidate", F.struct(-height, F.col("candidate"))).alias("candidate"))
    w = Window.orderBy("x")
    best = best.withColumn("g", F.sum(F.coalesce((F.col("candidate") != F.lag("candidate").over(w)).cast("int"), F.lit(1))).over(w))
    return best.groupBy("g", "candidate").agg(F.min("x").alias("left"), F.max("right").alias("right")).select("candidate", "left", "right")


def frozen_ranks(scores: DataFrame, score: str, name: str, order: str = "candidate") -> DataFrame:
    """Adds ``name``: places from 1, the highest score first; of equal ones the smaller
    ``order``, so that no place is shared. Candidates are few."""
    return scores.withColumn(name, F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(order))))


def candidate_summary(values: DataFrame) -> DataFrame:
    """candidate, its accuracy on the exposed and the clean set, and its places by
    either; ``values`` has candidate, evaluation_set and correct."""
    of = lambda s: F.avg(F.when(F.col("evaluation_set") == s, F.col("correct")))
    c = values.groupBy("candidate").agg(F.round(of("target"), 12).alias("exposed_accuracy"), F.round(of("clean"), 12).alias("clean_accuracy"))
    return frozen_ranks(frozen_ranks(c, "exposed_accuracy", "exposed_rank"), "clean_accuracy", "clean_rank")
