"""Records linked through keys, components of them, and folds of components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .digests import list_digests

KEY = ["atom_type", "value_hash"]


def linking_keys(atoms: DataFrame, *, types: list[str] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """record_id by key, of keys that two or more records hold and that link: a
    key links if any atom with it does, then for all its records. ``types``
    says which types link instead; keys in ``excluded`` never do."""
    if types is not None:  # the type is a part of the key
        atoms = atoms.where(F.col("atom_type").isin(types))
    link = F.bool_or("linkable") if types is None else F.lit(True)
    keys = atoms.groupBy(*KEY).agg(link.alias("links"), F.min("record_id").alias("low"), F.max("record_id").alias("high")).where("links and low < high").select(*KEY, "low")
    if excluded is not None:
        keys = keys.join(excluded.select(*KEY), KEY, "left_anti")
    return atoms.select("record_id", *KEY).distinct().join(keys, KEY)


def components(atoms: DataFrame, **policy) -> DataFrame:
    """record_id and label: the least record_id of the component. Each key links
    its records to its least one, so a key of any size makes as many edges as it
    has records; records that nothing links are their own."""
    members = linking_keys(atoms, **policy)
    found = connected_components(members.select(F.col("record_id").alias("a"), F.col("low").alias("b")))
    records = atoms.select("record_id").distinct()
    return records.join(found, F.col("record_id") == F.col("node"), "left").select("record_id", F.coalesce("component", "record_id").alias("label"))


def union_events(atoms: DataFrame, **policy) -> DataFrame:
    """One row: over linking keys, the members beyond the first."""
    return linking_keys(atoms, **policy).groupBy(*KEY).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("union_events"))


def hashed_ids(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """label and component_id, the hash of the sorted ids of its records, fed one by one."""
    return list_digests(labels.join(ids, "record_id"), ["label"], [F.col("record_hash_id")], F.col("record_hash_id"), before='["', between='","', after='"]', name="component_id")


def component_sizes(labels: DataFrame, records: DataFrame) -> DataFrame:
    """A row a component: its size, whether both splits are in it, and its views."""
    return labels.join(records.select("record_id", "view", "split"), "record_id").groupBy("label").agg(
        F.count("*").alias("size"), (F.bool_or(F.col("split") == "train") & F.bool_or(F.col("split") == "validation")).alias("cross_split"), F.count_distinct("view").alias("views"))


def component_summary(labels: DataFrame, records: DataFrame, atoms: DataFrame) -> DataFrame:
    """One row of totals."""
    cross, multi = F.col("cross_split"), F.col("views") >= 2
    s = component_sizes(labels, records).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("records"), F.count("*").alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component_records"),
        F.count_if(cross).alias("cross_split_components"), F.coalesce(F.sum(F.when(cross, F.col("size"))), F.lit(0)).alias("records_in_cross_split_components"),
        F.count_if(multi).alias("multi_view_components"), F.coalesce(F.sum(F.when(multi, F.col("size"))), F.lit(0)).alias("records_in_multi_view_components"))
    return s.crossJoin(atoms.select(*KEY).distinct().agg(F.count("*").alias("atoms")))


def size_histogram(labels: DataFrame, records: DataFrame) -> DataFrame:
    return component_sizes(labels, records).groupBy(F.col("size").cast("string").alias("size")).agg(F.count("*").alias("components"))


def component_folds(labels: DataFrame, records: DataFrame, *, folds: int = 20, seed: int = 20260725) -> DataFrame:
    """component_id and component_fold. Components come by size, largest first, then by
    id; each goes where it costs least. The cost of a fold is the square of its
    relative distance from an even share of all records with the component in it, plus the
    same for each view that the component has; equal costs are decided by hash.

    Counts, order and shares are made in Spark. Each choice depends on all before it, so
    one task reads the counts, a row a component, in order; it holds the folds' totals
    and nothing else, and its input is sorted on disk, so there is no most."""
    if folds < 2:
        raise ValueError(f"{folds} folds; two at least are needed")
    counts = labels.join(records.select("record_id", "view"), "record_id").groupBy("component_id", "view").agg(F.count("*").alias("n"))
    totals = sorted((r["view"], r["n"]) for r in counts.groupBy("view").agg(F.sum("n").alias("n")).collect())  # views are schema
    if not totals:
        return labels.sparkSession.createDataFrame([], "component_id string, component_fold int")
    share = np.array([max(n / folds, 1.0) for _, n in totals])
    even = sum(n for _, n in totals) / folds
    row = F.array(*(F.coalesce(F.sum(F.when(F.col("view") == v, F.col("n"))), F.lit(0)) for v, _ in totals))
    rows = counts.groupBy("component_id").agg(F.sum("n").alias("size"), row.alias("by_view"))
    rows = rows.repartition(1).sortWithinPartitions(F.col("size").desc(), "component_id")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, by_view = np.zeros(folds), np.zeros((len(share), folds))
        for batch in batches:
            chosen = []
            for name, size, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = np.flatnonzero(own)
                n = np.array(own)[have, None]
                cost = np.square((filled + size - even) / even) + np.square((by_view[have] + n - share[have, None]) / share[have, None]).sum(axis=0)
                tied = np.flatnonzero(cost == cost.min()).tolist()
                fold = tied[0] if len(tied) == 1 else min(tied, key=lambda f: (hashlib.sha256(f"{seed}:{name}:{f}".encode()).digest(), f))
                filled[fold] += size
                by_view[have, fold] += n[:, 0]
                chosen.append(fold)
            yield pa.record_batch([batch.column(0), pa.array(chosen, pa.int32())], names=["component_id", "component_fold"])

    return rows.mapInArrow(choose, "component_id string, component_fold int")


def assert_whole(assignments: DataFrame) -> None:
    """Raises if the records of some component lie in several folds."""
    bad = assignments.groupBy("component_id").agg(F.count_distinct("component_fold").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise AssertionError(f"component {bad[0]['component_id']} lies in {bad[0]['n']} folds")
