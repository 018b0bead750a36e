"""Components of a graph whose edges arrive in batches.

An extension: the batch operators know no streams. What is known is kept as tables in a folder
that all executors see, never in one task:

    nodes/batch=N    nodes seen first in batch N, with their component as of then
    merged/batch=N   components that have gone up in others by then, with the one they are part of now

A batch looks up the nodes it names, finds components among their components alone, and adds its own two tables. So
its work grows with its edges and with what has merged so far, while labels written earlier are never rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.components import connected_components
from ..plans.joins import join_counted, join_heavy
from ..plans.lineage import cut, scope


def _tables(spark: SparkSession, folder: str, kind: str, before: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of batches below ``before``, and what has merged by then."""
    nodes = spark.read.schema(f"node {kind}, component {kind}, batch long").parquet(f"{folder}/nodes").where(F.col("batch") < before).drop("batch")
    return nodes, spark.read.schema(f"component {kind}, `into` {kind}").parquet(f"{folder}/merged/batch={before - 1}")


def _resolved(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """``nodes`` with the component that theirs is part of; a component of any size keeps no task busy alone."""
    sums = nodes.groupBy("component").agg(F.count("*").alias("n")).join(merged, "component", "left").select("component", "n", F.coalesce("into", "component").alias("label"))
    return join_heavy(nodes, sums, ["component"], F.col("node")).select("node", F.col("label").alias("component"))


def add_batch(edges: DataFrame, batch: int, folder: str) -> None:
    """Adds edges (columns a and b) as batch number ``batch``, counted from 0 without gaps. The same batch can be
    added again after a failure: it reads earlier batches only, and replaces what it has written."""
    spark, kind = edges.sparkSession, edges.schema["a"].dataType.simpleString()
    if batch == 0:
        for name, columns in (("nodes", f"node {kind}, component {kind}"), ("merged", f"component {kind}, `into` {kind}")):
            spark.createDataFrame([], columns).write.mode("overwrite").parquet(f"{folder}/{name}/batch=-1")
    nodes, merged = _tables(spark, folder, kind, batch)
    with scope(spark, "stream"):
        e = cut(edges.where("a <> b").select("a", "b").distinct(), "edges")
        ends = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
        seen = _resolved(nodes.join(ends.select("node"), "node"), merged)
        ends = cut(ends.join(seen, "node", "left").select("node", "n", F.coalesce("component", "node").alias("label"), F.col("component").isNotNull().alias("known")), "ends")
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            e = join_heavy(e, ends.select(F.col("node").alias(end), "n", F.col("label").alias("label_" + end)), [end], F.col(other)).drop("n")
        found = cut(connected_components(e.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))), "found")
        moved = found.where("node <> component").join(ends.where("known").select(F.col("label").alias("node")).distinct(), "node").select("node", F.col("component").alias("later"))
        moved = cut(moved, "moved")
        fresh = ends.where("not known").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        fresh.write.mode("overwrite").parquet(f"{folder}/nodes/batch={batch}")
        older = join_counted(merged, moved.withColumnRenamed("node", "into"), ["into"], F.col("component"), "left").select("component", F.coalesce("later", "into").alias("into"))
        older.unionByName(moved.select(F.col("node").alias("component"), F.col("later").alias("into"))).write.mode("overwrite").parquet(f"{folder}/merged/batch={batch}")


def follow(edges: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Starts to follow a stream of edges (columns a and b), with its progress in ``folder`` too; ``trigger`` as in
    ``DataStreamWriter.trigger``. Loops and edges with a null end link nothing."""
    out = edges.select("a", "b").writeStream.option("checkpointLocation", f"{folder}/progress")
    return (out.trigger(**trigger) if trigger else out).foreachBatch(lambda e, i: add_batch(e, i, folder)).start()


def labels(spark: SparkSession, folder: str, batches: int, kind: str = "bigint") -> DataFrame:
    """node and component, the least node that is reached, after so many batches; as of an earlier batch if fewer."""
    return _resolved(*_tables(spark, folder, kind, batches))
