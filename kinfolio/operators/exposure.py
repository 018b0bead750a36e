"""Which evaluation records share atoms with training records, by view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["atom_type", "value_hash"]
CELL = ["record_id", "evaluation_view", "atom_type", "source_view"]
#: Training records of a view from which a value that they share is hot.
HOT = 1000


def _sides(atoms: DataFrame, training: str, evaluation: str) -> tuple[DataFrame, DataFrame]:
    t = atoms.where(F.col("split") == training).select(*KEY, F.col("view").alias("source_view"), F.col("record_id").alias("source_id")).distinct()
    e = atoms.where(F.col("split") == evaluation).select("record_id", F.col("view").alias("evaluation_view"), *KEY, "field", "linkable").distinct()
    return t, e


def matches(atoms: DataFrame, *, training: str = "train", evaluation: str = "validation") -> DataFrame:
    """Exposed cells alone: record_id, evaluation_view, atom_type, source_view,
    matching_atoms, matching_training_records.

    ``atoms`` has record_id, view, split and the columns of an atom. Training
    atoms are counted by key and view before they meet evaluation atoms, so a
    key that a third of all records hold makes a row a view, not one for each
    pair. Only records that match with several values of one type need training
    records, to count those they share once: see ``_distinct_sources``.
    """
    t, e = _sides(atoms, training, evaluation)
    counted = t.groupBy(*KEY, "source_view").agg(F.count("*").alias("n"))
    own = e.groupBy("record_id", "evaluation_view", *KEY).agg(F.count("*").alias("fields"))
    met = own.join(counted, KEY)
    values = F.collect_list(F.struct("value_hash", (F.col("n") > HOT).alias("hot")))
    cells = met.groupBy(*CELL).agg(F.sum("fields").alias("matching_atoms"), F.max("n").alias("n"), F.when(F.count("*") > 1, values).alias("values"))
    sets = cells.where("values is not null").select("atom_type", "source_view", F.array_sort("values").alias("values")).distinct()
    out = cells.withColumn("values", F.array_sort("values")).join(_distinct_sources(sets, t, counted), ["atom_type", "source_view", "values"], "left")
    return out.select(*CELL, "matching_atoms", F.coalesce("m", "n").alias("matching_training_records"))


def _distinct_sources(sets: DataFrame, t: DataFrame, counted: DataFrame) -> DataFrame:
    """For each set of values (with whether each is hot) of a type and view, m: the
    training records that hold any of them.

    A value that more than HOT training records hold never meets these one by one:
    records are grouped by which hot values they hold, and groups that share one with the
    set are summed. The others are at most HOT for each value of a set; they are counted
    unless they hold one of the set's hot values. Records with the same values ask once."""
    side = ["atom_type", "source_view"]
    s = sets.withColumn("hot", F.transform(F.filter("values", lambda v: v["hot"]), lambda v: v["value_hash"]))
    hot = counted.where(F.col("n") > HOT).select(*side, "value_hash")
    holders = t.join(hot, [*side, "value_hash"]).groupBy(*side, "source_id").agg(F.sort_array(F.collect_set("value_hash")).alias("holds"))
    groups = holders.groupBy(*side, "holds").agg(F.count("*").alias("n"))
    asked = s.where(F.size("hot") > 0).select(*side, "hot").distinct()
    shared = asked.withColumn("value_hash", F.explode("hot")).join(groups.withColumn("value_hash", F.explode("holds")), [*side, "value_hash"]).select(*side, "hot", "holds", "n").distinct()
    of_hot = shared.groupBy(*side, "hot").agg(F.sum("n").alias("of_hot"))
    rare = s.select(*side, "values", "hot", F.explode(F.filter("values", lambda v: ~v["hot"])).alias("v")).withColumn("value_hash", F.col("v.value_hash"))
    few = rare.join(t, [*side, "value_hash"]).select(*side, "values", "hot", "source_id").distinct()
    few = few.join(holders, [*side, "source_id"], "left").where(F.col("holds").isNull() | ~F.arrays_overlap("holds", "hot"))
    of_few = few.groupBy(*side, "values").agg(F.count("*").alias("of_few"))
    out = s.join(of_hot, [*side, "hot"], "left").join(of_few, [*side, "values"], "left")
    return out.select(*side, "values", (F.coalesce("of_hot", F.lit(0)) + F.coalesce("of_few", F.lit(0))).alias("m"))


def _dense(atoms: DataFrame, evaluation: str) -> DataFrame:
    """Every evaluation record by every atom type and view that occurs anywhere. Types and views are few: they are schema, not data."""
    records = atoms.where(F.col("split") == evaluation).select("record_id", F.col("view").alias("evaluation_view")).distinct()
    types, views = atoms.select("atom_type").distinct(), atoms.select(F.col("view").alias("source_view")).distinct()
    return records.crossJoin(F.broadcast(types)).crossJoin(F.broadcast(views))


def exposure_rows(atoms: DataFrame, **splits: str) -> DataFrame:
    """The whole tensor, with zeros."""
    dense = _dense(atoms, splits.get("evaluation", "validation")).join(matches(atoms, **splits), CELL, "left")
    m = F.coalesce("matching_training_records", F.lit(0))
    return dense.select(*CELL, (m > 0).alias("exposed"), F.coalesce("matching_atoms", F.lit(0)).alias("matching_atoms"), m.alias("matching_training_records"))


def _met(atoms: DataFrame, training: str, evaluation: str) -> DataFrame:
    """CELL of exposed cells, several times perhaps. Presence alone: the training side is one row a key and view."""
    t = atoms.where(F.col("split") == training).select(*KEY, F.col("view").alias("source_view")).distinct()
    e = atoms.where(F.col("split") == evaluation).select("record_id", F.col("view").alias("evaluation_view"), *KEY).distinct()
    return e.join(t, KEY)


def exposed_cells(atoms: DataFrame, *, training: str = "train", evaluation: str = "validation") -> DataFrame:
    """The cells of the tensor and whether they are exposed, without its counts: no training record is looked at by itself."""
    met = _met(atoms, training, evaluation).select(*CELL).distinct().withColumn("found", F.lit(True))
    return _dense(atoms, evaluation).join(met, CELL, "left").select(*CELL, F.coalesce("found", F.lit(False)).alias("exposed"))


def _frame(atoms: DataFrame, evaluation: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation records by view, and the atom types."""
    records = atoms.where(F.col("split") == evaluation).select("record_id", F.col("view").alias("evaluation_view")).distinct()
    return records.groupBy("evaluation_view").agg(F.count("*").alias("validation_rows")), atoms.select("atom_type").distinct()


def by_source_view(atoms: DataFrame, *, training: str = "train", evaluation: str = "validation") -> DataFrame:
    """Exposed records and sums of matches by evaluation view, source view and
    type. Made from exposed cells; zeros come from the three small dimensions."""
    n, types = _frame(atoms, evaluation)
    key = ["evaluation_view", "source_view", "atom_type"]
    sums = matches(atoms, training=training, evaluation=evaluation).groupBy(*key).agg(F.count("*").alias("e"), F.sum("matching_atoms").alias("a"), F.sum("matching_training_records").alias("r"))
    grid = n.crossJoin(F.broadcast(types)).crossJoin(F.broadcast(atoms.select(F.col("view").alias("source_view")).distinct()))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return grid.join(sums, key, "left").select(*key, "validation_rows", zero("e").alias("exposed_rows"), F.try_divide(zero("e"), "validation_rows").alias("exposure_rate"), zero("a").alias("matching_atoms"), zero("r").alias("matching_training_records"))


def same_and_any_view(atoms: DataFrame, *, training: str = "train", evaluation: str = "validation") -> DataFrame:
    """Records exposed within their view, in any, and in others alone."""
    n, types = _frame(atoms, evaluation)
    key = ["evaluation_view", "atom_type"]
    per = _met(atoms, training, evaluation).groupBy("record_id", *key).agg(F.bool_or(F.col("source_view") == F.col("evaluation_view")).alias("same"))
    sums = per.groupBy(*key).agg(F.count("*").alias("any_n"), F.count_if("same").alias("same_n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rate = lambda c: F.try_divide(c, "validation_rows")
    cross = zero("any_n") - zero("same_n")
    return n.crossJoin(F.broadcast(types)).join(sums, key, "left").select(
        *key, "validation_rows", zero("same_n").alias("same_view_exposed_rows"), rate(zero("same_n")).alias("same_view_exposure_rate"), zero("any_n").alias("any_view_exposed_rows"),
        rate(zero("any_n")).alias("any_view_exposure_rate"), cross.alias("cross_view_only_rows"), rate(cross).alias("cross_view_only_rate"),
    )


def inspection_queue(atoms: DataFrame, *, training: str = "train", evaluation: str = "validation") -> DataFrame:
    """A row for each key, evaluation record and field with training records in
    another view: those views, and the least (view, source_index, field) there.
    ``atoms`` has source_index too. Training atoms are one row a key and view."""
    t = atoms.where(F.col("split") == training).groupBy(*KEY, F.col("view").alias("source_view")).agg(F.min(F.struct("view", "source_index", "field")).alias("example"))
    e = atoms.where(F.col("split") == evaluation).select(*KEY, F.col("view").alias("validation_view"), F.col("source_index").alias("validation_source_index"), F.col("field").alias("validation_field")).distinct()
    met = e.join(t, KEY).where("source_view <> validation_view")
    rows = met.groupBy(*KEY, "validation_view", "validation_source_index", "validation_field").agg(F.array_join(F.sort_array(F.collect_set("source_view")), "|").alias("source_views"), F.min("example").alias("x"))
    return rows.select(*rows.columns[:6], F.col("x.view").alias("example_train_view"), F.col("x.source_index").alias("example_train_source_index"), F.col("x.field").alias("example_train_field"))
