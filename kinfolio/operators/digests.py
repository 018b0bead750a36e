"""Digests of long ordered lists, fed row by row.

A list's digest is SHA-256 of its entries joined by a separator, as saved results
have it. Rows are sorted on disk by key and order; a task carries the hash of the
open key from batch to batch, so no list is ever in one row or in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_digests(rows: DataFrame, keys: list[str], order: list[Column], text: Column, *, before: str = "", between: str = "", after: str = "", name: str = "digest") -> DataFrame:
    """``keys`` and the digest of each key's texts in ``order``, between ``before`` and ``after``. Null texts
    don't count; a key without others has the digest of an empty list. Without keys there is one list, and one row of
    it, if there are rows at all. A list is hashed in one task, as its digest is of one sequence."""
    marks = [f"__o{i}" for i in range(len(order))]
    d = rows.select(*keys, *(o.alias(m) for o, m in zip(order, marks, strict=True)), text.cast("string").alias("__text"))
    d = (d.repartition(*keys) if keys else d.repartition(1)).sortWithinPartitions(*keys, *marks).select(*keys, "__text")
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), f"`{name}` string"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state, empty = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_pylist() for c in batch.columns[: len(keys)]]
            own = list(zip(*columns, strict=True)) if keys else [()] * batch.num_rows
            texts, done, start = batch.column(len(keys)).to_pylist(), [], 0
            for end in [i for i in range(1, len(own)) if own[i] != own[i - 1]] + [len(own)]:
                if state is None or own[start] != open_key:
                    if state is not None:
                        done.append((open_key, state))
                    open_key, state, empty = own[start], hashlib.sha256(before.encode()), True
                part = [t for t in texts[start:end] if t is not None]
                if part:
                    state.update(((("" if empty else between) + between.join(part))).encode())
                    empty = False
                start = end
            if done:
                yield written(done, batch.schema)
        if state is not None:
            yield written([(open_key, state)], batch.schema)

    def written(done: list, kinds: pa.Schema) -> pa.RecordBatch:
        for _, state in done:
            state.update(after.encode())
        columns = [pa.array([k[i] for k, _ in done], kinds.field(i).type) for i in range(len(keys))]
        return pa.record_batch([*columns, pa.array([s.hexdigest() for _, s in done], pa.string())], names=[*keys, name])

    return d.mapInArrow(hashed, schema)
