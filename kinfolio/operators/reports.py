"""Tables behind reports: exposure in percent, final and item effects, nested summaries as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import signed_margin
from .resample import intervals, ratio_bootstrap


def focal_exposure(summary: DataFrame, evaluation_view: str, types: list[str] | None = None) -> DataFrame:
    """Of one evaluation view, a row for each type and scope (same_view, any_view)."""
    s = summary.where(F.col("evaluation_view") == evaluation_view)
    if types is not None:
        s = s.where(F.col("atom_type").isin(types))
    scopes = F.array(*(F.struct(F.lit(k).alias("scope"), F.col(f"{k}_exposed_rows").alias("exposed_rows")) for k in ("same_view", "any_view")))
    return s.select("atom_type", F.col("validation_rows").alias("rows"), F.inline(scopes)).select("atom_type", "scope", "rows", "exposed_rows", F.try_divide("exposed_rows", "rows").alias("estimate"))


def focal_intervals(cells: DataFrame, clusters: DataFrame, evaluation_view: str, replicates: int, *, seed: int = 10) -> DataFrame:
    """As ``focal_exposure``, with low and high: 95 % of the rates when contexts are drawn with
    replacement, each with all its records. ``cells`` are rows of the tensor, ``clusters`` has record_id and
    cluster; records without one stand alone. Records are summed by cluster before anything is drawn."""
    e = cells.where((F.col("evaluation_view") == evaluation_view)).groupBy("record_id", "atom_type").agg(F.bool_or(F.col("exposed") & (F.col("source_view") == evaluation_view)).alias("same_view"), F.bool_or("exposed").alias("any_view"))
    e = e.join(clusters, "record_id", "left").withColumn("cluster", F.coalesce("cluster", F.concat(F.lit("record:"), F.col("record_id").cast("string"))))
    scopes = F.array(*(F.struct(F.lit(k).alias("scope"), F.col(k).cast("int").alias("hit")) for k in ("same_view", "any_view")))
    sums = e.select("atom_type", "cluster", F.inline(scopes)).groupBy("atom_type", "scope", "cluster").agg(F.sum("hit").alias("hits"), F.count("*").alias("rows"))
    spread = intervals(ratio_bootstrap(sums, ["atom_type", "scope"], replicates, seed=seed), ["atom_type", "scope"], "ratio")
    whole = sums.groupBy("atom_type", "scope").agg(F.sum("rows").alias("rows"), F.sum("hits").alias("exposed_rows"))
    return whole.withColumn("estimate", F.try_divide("exposed_rows", "rows")).join(spread, ["atom_type", "scope"])


def exposure_tensor(summary: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Rates in percent; ``chosen`` (evaluation_view, atom_type) keeps some rows."""
    s = summary if chosen is None else summary.join(F.broadcast(chosen), ["evaluation_view", "atom_type"], "left_semi")
    rates = {"same_percent": "same_view_exposure_rate", "any_percent": "any_view_exposure_rate", "cross_only_percent": "cross_view_only_rate"}
    return s.select("evaluation_view", "atom_type", *((F.col(v) * 100).alias(k) for k, v in rates.items()))


def final_effects(gaps: DataFrame) -> DataFrame:
    """Gaps of whole runs, in points."""
    return gaps.where("fraction = 1").select("model", "seed", "evaluation_set", (F.col("gap") * 100).alias("effect_points"))


def item_effects(predictions: DataFrame) -> DataFrame:
    """A row an item, seed and fraction: whether its ancestor has arrived, and what
    naive has over safe in correctness and signed margin."""
    side = lambda b, v: F.max(F.when(F.col("boundary") == b, v))
    correct, margin = F.col("correct").cast("double"), signed_margin(F.col("label"), F.col("margin"))
    g = predictions.groupBy("model", "seed", "fraction", "pair_id").agg(F.first("position").alias("position"), (side("naive", correct) - side("safe", correct)).alias("naive_minus_safe_correct"), (side("naive", margin) - side("safe", margin)).alias("naive_minus_safe_signed_margin"))
    return g.withColumn("ancestor_seen", F.col("position") < F.col("fraction"))


def summary_rows(spark: SparkSession, summary: dict, outcomes: tuple[str, ...] = ("target", "placebo", "difference")) -> DataFrame:
    """model, outcome, estimate, low and high of a summary nested by model and outcome."""
    rows = [(m, o, float(v[o]["estimate"]), float(v[o]["interval"][0]), float(v[o]["interval"][1])) for m, v in sorted(summary.items()) for o in outcomes if o in v]
    return spark.createDataFrame(rows, "model string, outcome string, estimate double, low double, high double")
