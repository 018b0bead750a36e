"""Substring dedup by level-wise doubling of repeated windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import flat_lists, fresh, least_of, only, rolled, slices, table, word_hashes, words

#: Words of a window.
WINDOW = 13
#: Words that a worker handles at once.
CHUNK = 1 << 20
#: ``at`` of a row that stands for several documents of its chunk; from PASSED down it is a result already.
SEVERAL, PASSED = -1, -2
ROWS = "key long, doc_id long, at long"


def _tag(text: Column) -> Column:
    """A number above 0, of 30 bits, that tells apart the texts of rows with one doc_id."""
    return F.hash(text).bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(1))


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple]:
    """Of some documents at a time: word hashes, and for each whole window its
    start, its document's row in the batch, that document's id and first word;
    then the batch. Documents without an id have no windows."""
    for batch in batches:
        h, offsets = word_hashes(batch.column(1))
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy()
        lengths = np.diff(offsets)
        for a, b in slices(lengths, CHUNK):
            x = h[offsets[a] : offsets[b]]
            if len(x) < window:
                continue
            row = np.repeat(np.arange(a, b), lengths[a:b])[: len(x) - window + 1]
            at = np.arange(len(row))
            inside = (at + window <= offsets[row + 1] - offsets[a]) & known[row]
            row, at = row[inside], at[inside]
            if len(at):
                yield x, at, row, ids[row], offsets[row] - offsets[a], batch


def _rows(key: np.ndarray, doc_id: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(key.view(np.int64)), pa.array(doc_id), pa.array(at.astype(np.int64))], names=["key", "doc_id", "at"])


def _half_windows(x: np.ndarray, window: int) -> np.ndarray:
    """For each window the least hash of the half-length windows in it; equal
    windows have the same, and neighbours mostly share it."""
    half = (window + 1) // 2
    return least_of(rolled(x, half), window - half + 1)


def _first_level(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for x, at, _, ids, _, _ in _chunks(batches, window):
        key = _half_windows(x, window)[at]
        new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
        key, ids = key[new], ids[new]
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
        key, ids = key[new], ids[new]
        first = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(first) - 1
        several = (np.bincount(group) > 1)[group]
        # a window of several documents here is known to be repeated: one row tells the others
        yield _rows(key[first], ids[first], np.where(several, SEVERAL, 0)[first])
        if several.any():
            yield _rows(key[several], ids[several], np.full(several.sum(), PASSED))


def _second_level(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    odd = np.uint64(0x9E3779B97F4A7C15)
    for x, at, row, ids, begin, batch in _chunks(batches, window):
        lists, tag = batch.column(2), batch.column(3).to_numpy().astype(np.int64)
        held, offsets = flat_lists(lists)
        a, b = row[0], row[-1] + 1
        with np.errstate(over="ignore"):
            owner = np.repeat(np.arange(a, b), np.diff(offsets[a : b + 1])).astype(np.uint64) * odd
            wanted = held[offsets[a] : offsets[b]].view(np.uint64) ^ owner
            hit = np.isin(_half_windows(x, window)[at] ^ (row.astype(np.uint64) * odd), wanted)
        if not hit.any():
            continue
        key, ids, start = rolled(x, window, 0xA24BAED4963EE407)[at[hit]], ids[hit], (at - begin)[hit] | tag[row[hit]] << 32
        order = np.lexsort((start, ids, key))
        key, ids, start = key[order], ids[order], start[order]
        group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
        least = ids[np.append(True, key[1:] != key[:-1])][group]
        own = ids == least
        yield _rows(key[own], ids[own], start[own])
        if not own.all():
            yield _rows(key[~own], ids[~own], PASSED - start[~own])


def _judge(batches: Iterator[pa.RecordBatch], later: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; of each run of a key those whose window is repeated in
    another document (``later``: in a smaller doc_id), and all that passed. A
    run has a row a chunk at most, or one for each place in its document."""
    rest: list[np.ndarray] | None = None

    def judged(key: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        first = np.append(True, key[1:] != key[:-1])
        group, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        open_ = at > PASSED
        low = np.minimum.reduceat(np.where(open_, ids, np.iinfo(np.int64).max), starts)[group]
        if later:
            keep = ~open_ | (ids > low)
            return _rows(key[keep], ids[keep], np.where(open_, at, PASSED - at)[keep])
        high = np.maximum.reduceat(np.where(open_, ids, np.iinfo(np.int64).min), starts)[group]
        told = np.maximum.reduceat((at == SEVERAL).astype(np.int8), starts)[group] > 0
        keep = ~open_ | ((at == 0) & (told | (low < high)))
        return _rows(key[keep], ids[keep], at[keep])

    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()]
        now = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        rest = [x[cut:] for x in now]
        if cut:
            yield judged(*(x[:cut] for x in now))
    if rest:
        yield judged(*rest)


def _met(rows: DataFrame, later: bool) -> DataFrame:
    """Open rows go to where their key goes, passed ones to where their document goes."""
    met = rows.repartition(F.when(F.col("at") > PASSED, F.col("key")).otherwise(F.xxhash64("doc_id"))).sortWithinPartitions("key")
    return met.mapInArrow(lambda b: _judge(b, later), ROWS)


def repeated_windows(documents: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, tag and starts (array): where windows start that also start in a document
    with a smaller doc_id. Of ids that several texts share, each ``_tag`` has rows of its
    own; for all others the tag is 0, which costs the shuffle next to nothing.

    First level: windows of half the length, rounded up; of those inside each
    whole window the one with the least hash is tried, so that equal windows try
    the same and only some positions move. Second level: windows alone that hold
    a repeated half are extended to ``window`` words and tried in turn. Longer
    repeats are made of windows, so no further level can change what is found.

    A window that many documents share makes one row a chunk of words on either
    level, however many they are; its other documents are settled in the chunk.
    Windows are compared by 64-bit hashes of both levels.
    """
    docs = only(documents)
    tried = docs.mapInArrow(lambda b: _first_level(b, window), ROWS)
    halves = _met(tried, False).groupBy("doc_id").agg(F.collect_list("key").alias("halves")).withColumnRenamed("doc_id", "its_id")
    # an outer join, as below, so that the texts are shuffled once for both
    both = docs.join(halves, docs["doc_id"] == halves["its_id"], "left")
    tag = _tag(F.col("text"))
    shared = docs.groupBy("doc_id").agg(F.min(tag).alias("low"), F.max(tag).alias("high")).where("low < high").select(F.col("doc_id").alias("shared_id"))
    both = both.join(shared, both["doc_id"] == shared["shared_id"], "left").withColumn("tag", F.when(F.col("shared_id").isNotNull(), tag).otherwise(0))
    text = F.when(F.col("halves").isNotNull(), F.col("text")).otherwise("")
    tried = both.select("doc_id", text.alias("text"), F.coalesce("halves", F.array().cast("array<bigint>")).alias("halves"), "tag").mapInArrow(lambda b: _second_level(b, window), ROWS)
    place = _met(tried, True).select("doc_id", F.shiftright("at", 32).cast("int").alias("tag"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"))
    return place.groupBy("doc_id", "tag").agg(F.collect_list("at").alias("starts"))


@F.arrow_udf(ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())])))
def _ranges(starts: pa.Array, window: pa.Array) -> pa.Array:
    """Sorted, disjoint stretches of words that windows cover."""
    out = []
    for s, w in zip(starts, window.to_pylist(), strict=True):
        if not s.is_valid or not len(s):
            out.append(None)
            continue
        x = np.unique(s.values.to_numpy())
        gap = np.flatnonzero(np.diff(x) > w)
        a, b = x[np.append(0, gap + 1)], x[np.append(gap, len(x) - 1)] + w
        out.append([{"a": i, "b": j} for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    return pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))


def remove_repeats(documents: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Adds n_words, n_removed, removed (stretches of words, end exclusive) and
    kept_text: the words that stay, joined by one space.

    A word goes if a window of ``window`` words over it also starts in a document
    with a smaller doc_id; windows are judged on the texts as they come. Repeats
    within one document stay, and so do texts shorter than a window. Null texts
    have no words and keep the empty text. Rows without a doc_id keep all and
    remove nothing. Rows that repeat a doc_id are texts of one document: each loses
    what stands in smaller doc_ids, none what stands in another of them. Other columns stay; those named like the new ones give
    way. An empty table gives an empty result.
    """
    new = ("n_words", "n_removed", "removed", "kept_text")
    documents = documents.drop(*new)
    w, kept_c, id_c, tag_c = (fresh(documents, c) for c in ("words", "kept", "its_id", "tag"))
    found = repeated_windows(documents, window=window).select(F.col("doc_id").alias(id_c), F.col("tag").alias(tag_c), _ranges(F.col("starts"), F.lit(window)).alias("removed"))
    out = documents.join(found, (documents["doc_id"] == found[id_c]) & ((found[tag_c] == 0) | (found[tag_c] == _tag(documents["text"]))), "left").drop(id_c, tag_c).withColumn(w, words(F.col("text")))
    r = F.col("removed")
    stretches = F.transform(
        F.sequence(F.lit(0), F.size(r)),
        lambda k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.get(r, k - 1)["b"]).alias("a"),
            F.when(k == F.size(r), F.size(w)).otherwise(F.get(r, k)["a"]).alias("b"),
        ),
    )
    kept = F.when(r.isNull(), F.col(w)).otherwise(F.flatten(F.transform(stretches, lambda s: F.slice(w, s["a"] + 1, F.greatest(s["b"] - s["a"], F.lit(0))))))
    out = out.withColumn("n_words", F.size(w).cast("long")).withColumn(kept_c, kept)
    return out.withColumn("n_removed", F.col("n_words") - F.size(kept_c)).withColumn("kept_text", F.array_join(kept_c, " ")).drop(w, kept_c)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(only(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS seq FROM s),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS first FROM h),
g AS (SELECT DISTINCT doc_id, i + o AS n FROM f, range(0, 13) r(o) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS n, unnest(w) AS word FROM d),
k AS (SELECT x.doc_id, count(g.n) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.n) FILTER (WHERE g.n IS NULL), '') AS kept
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.n = g.n GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
QUERIES, ORACLES = {"op4_substring_dedup": query}, {"op4_substring_dedup": SQL}
