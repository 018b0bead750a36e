"""Exposure of records as they arrive, against training atoms that don't change.

An extension: the batch operators know no streams. Records are deduplicated by
id within the watermark, and meet a static table of training keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["atom_type", "value_hash"]


def exposed_stream(evaluation: DataFrame, training: DataFrame, *, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Rows of a stream of evaluation atoms (record_id, view, atom_type,
    value_hash, field and a timestamp) that training atoms match: source_view,
    and whether it is the record's own. Late repeats beyond ``delay`` are dropped."""
    keys = training.select(*KEY, F.col("view").alias("source_view")).distinct()
    fresh = evaluation.withWatermark(time, delay).dropDuplicatesWithinWatermark(["record_id", *KEY, "field"])
    return fresh.join(keys, KEY).withColumn("same_view", F.col("view") == F.col("source_view"))
