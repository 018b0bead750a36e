"""Tables of pairs as token sequences: budgets of parts for whole batches, entries row by row.

The vocabulary is a file of ``tokenizers``, named by its path, which every task reads once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import OMITTED, PART_LEAST, PART_MARKERS, SPARE_ORDER, joined_entries, without_middle

#: Parts in the order in which they stand.
PARTS = tuple(PART_MARKERS)
#: Rows that are encoded at once: their encodings take many times their texts' memory.
ROWS = 128


def budgets(lengths: np.ndarray, room: int) -> np.ndarray:
    """Tokens for each part (columns as PARTS) of each row: least ones first, what is left to those that
    need more, in their order; all rows at once."""
    least = np.array([PART_LEAST[p] for p in PARTS])
    out = np.minimum(lengths, least)
    left = room - out.sum(axis=1)
    for p in SPARE_ORDER:
        k = PARTS.index(p)
        more = np.clip(np.minimum(left, lengths[:, k] - out[:, k]), 0, None)
        out[:, k] += more
        left = left - more
    return out


def serialized(pairs: DataFrame, vocabulary: str, *, most: int = 512, start: Sequence[int] = (), end: Sequence[int] = ()) -> DataFrame:
    """pair_id, tokens, each part's tokens before (n_context ...) and problem, for ``pairs`` with pair_id, context,
    original, feedback (array) and candidate.

    Every part stands behind its marker and keeps some tokens; middles give way to a marker; feedback entries share
    their part's budget evenly, what short ones leave goes to the others. Rows with an empty part, or with more entries than their
    budget holds, have null tokens and say so in ``problem``. Raises if ``most`` can't hold the parts' least budgets."""
    least, n = sum(PART_LEAST.values()), [f"n_{p}" for p in PARTS]
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        encode = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        markers, omitted = dict(zip(PARTS, encode([PART_MARKERS[p] for p in PARTS]), strict=True)), encode([OMITTED])[0]
        room = most - sum(map(len, markers.values())) - len(start) - len(end)
        if room < least:
            raise ValueError(f"{most} tokens are too few for the parts' least budgets")
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            rows = batch.to_pydict()
            entries = [[(x or "").strip() for x in f or []] for f in rows["feedback"]]
            flat = encode([x for f in entries for x in f])
            heads = encode([f"[ENTRY {i}/{len(f)}]" for f in entries for i in range(1, len(f) + 1)])
            at = np.cumsum([0, *map(len, entries)])
            contents, headers = ([x[a:b] for a, b in zip(at, at[1:], strict=False)] for x in (flat, heads))
            held = {"context": encode([x or "" for x in rows["context"]])} | {p: encode([(x or "").strip() for x in rows[p]]) for p in ("original", "candidate")}
            size = {p: list(map(len, held[p])) for p in held} | {"feedback": [sum(map(len, h)) + sum(map(len, c)) for h, c in zip(headers, contents, strict=True)]}
            lengths = np.array([size[p] for p in PARTS]).T.reshape(-1, len(PARTS))
            given, tokens, problem = budgets(lengths, room), [], []
            for i, row in enumerate(given):
                own = dict(zip(PARTS, row.tolist(), strict=True))
                empty = [p for p, k in zip(PARTS, lengths[i], strict=True) if not k]
                try:
                    if empty:
                        raise ValueError(f"empty parts: {', '.join(empty)}")
                    parts = {p: without_middle(held[p][i], own[p], omitted) for p in held} | {"feedback": joined_entries(headers[i], contents[i], own["feedback"], omitted)}
                    tokens.append([*start, *(t for p in PARTS for t in (*markers[p], *parts[p])), *end])
                    problem.append(None)
                except ValueError as wrong:
                    tokens.append(None)
                    problem.append(str(wrong))
            yield pa.record_batch([batch.column(0), pa.array(tokens, pa.list_(pa.int32())), *(pa.array(lengths[:, k].astype(np.int64)) for k in range(len(PARTS))), pa.array(problem, pa.string())], names=["pair_id", "tokens", *n, "problem"])

    schema = f"pair_id {kind}, tokens array<int>, {', '.join(f'{c} long' for c in n)}, problem string"
    return pairs.select("pair_id", "context", "original", "feedback", "candidate").mapInArrow(made, schema)


def recomputed(published: DataFrame, again: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """``keys``, value, published, recomputed and status of each number of two tables: same within ``tolerance``,
    differs, missing (not found again) or extra (not published)."""
    long = lambda d, name: d.select(*keys, F.inline(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias(name)) for v in values))))
    both = long(published, "published").withColumn("p", F.lit(True)).join(long(again, "recomputed").withColumn("a", F.lit(True)), [*keys, "value"], "full")
    close = F.abs(F.col("published") - F.col("recomputed")) <= tolerance
    status = F.when(F.col("a").isNull(), "missing").when(F.col("p").isNull(), "extra").when(F.coalesce(close, F.col("published").isNull() & F.col("recomputed").isNull()), "same").otherwise("differs")
    return both.select(*keys, "value", "published", "recomputed", status.alias("status"))
