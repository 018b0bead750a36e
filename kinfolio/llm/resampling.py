"""Importance resampling of documents towards the distribution of a target."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import slices, table, text_bytes

#: Buckets of features, and words of the longest feature.
BUCKETS, RUNS = 10_000, 1
#: Fewest words of a document that can be drawn, percent of those that are, and the seed of the draw.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Ranges of scores that are counted on the driver.
BINS = 4096
#: Bytes of text that are searched at once but for one text's, and of a word that is hashed along with others.
SEARCHED, LONG = 1 << 21, 48

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

def _crc_table() -> np.ndarray:
    """What CRC-32 makes of each byte: eight steps of division by its polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


_CRC = _crc_table()


def _fed(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after the stretches of ``data`` have been fed to them, byte by byte for all at once."""
    state = state.copy()
    for i in np.flatnonzero(length > LONG).tolist():
        state[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = np.argsort(length, kind="stable")
    order = order[: np.searchsorted(length[order], LONG, side="right")]
    sizes = length[order]
    for j in range(int(sizes[-1]) if len(sizes) else 0):
        at = order[np.searchsorted(sizes, j, side="right") :]
        s = state[at]
        state[at] = _CRC[(s ^ data[start[at] + j]) & 0xFF] ^ (s >> np.uint32(8))
    return state


def features(texts: pa.Array, *, buckets: int = BUCKETS, runs: int = RUNS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Of texts a to b at a time: the bucket of each feature and the text (from a on) that it
    stands in, and the words of each text. Features are runs of 1 to ``runs`` words, joined
    by a space; their bucket is the CRC-32 of their bytes modulo ``buckets``."""
    data, bounds = text_bytes(texts)
    for a, b in slices(np.diff(bounds), SEARCHED):
        part, at = _LOWER[data[bounds[a] : bounds[b]]], bounds[a : b + 1] - bounds[a]
        word = _WORD[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[at] = True
        before = np.append(False, word)[:-1] & ~edge[:-1] if len(part) else word
        start = np.flatnonzero(word & ~before)
        last = np.append(word[1:], False) & ~edge[1:] if len(part) else word
        length = np.flatnonzero(word & ~last) + 1 - start
        text = np.searchsorted(at, start, side="right") - 1
        words = np.bincount(text, minlength=b - a)[: b - a]
        found, where = [], []
        state = np.full(len(start), 0xFFFFFFFF, np.uint32)
        for n in range(runs):
            if n:  # a space and the word that is n further on, where it is of the same text
                inside = len(start) - n
                if inside <= 0:
                    break
                state = _CRC[(state[:inside] ^ np.uint32(32)) & 0xFF] ^ (state[:inside] >> np.uint32(8))
            state = _fed(state, part, start[n:], length[n:])
            same = text[n:] == text[: len(start) - n]
            found.append((~state[same]) % np.uint32(buckets))
            where.append(text[: len(start) - n][same])
        yield np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64), np.concatenate(where) if where else np.empty(0, np.int64), words, a, b


def bucket_counts(texts: DataFrame, *, buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """bucket and n, the features of all of ``texts`` (column text) in it; a task sends a row a bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, *_ in features(batch.column(0), buckets=buckets, runs=runs):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """For each bucket floor(1000 ln) of how much likelier a feature of it is in ``target``
    than in ``source``, each bucket with one more: an array of ``buckets`` numbers."""

    def counts(texts: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in bucket_counts(texts, buckets=buckets, runs=runs).collect():  # a row a bucket
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(source), counts(target)
    up, down = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((y + 1) * up / ((x + 1) * down))) for x, y in zip(s, t, strict=True)], np.int64)


def _noise(doc_id: Column, seed: int) -> Column:
    """A thousandfold Gumbel draw, rounded down, that depends on the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(documents: DataFrame, gain: np.ndarray, *, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    buckets = len(gain)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, text, words, a, b in features(batch.column(1), buckets=buckets, runs=runs):
                total = np.zeros(b - a, np.int64)
                np.add.at(total, text, gain[bucket])
                n = np.bincount(text, minlength=b - a)[: b - a]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    of = documents.schema["doc_id"].dataType.simpleString()
    out = documents.select(documents["doc_id"].alias("doc_id"), documents["text"].alias("text")).mapInArrow(weighed, f"doc_id {of}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def ranked(scores: DataFrame, drawn: int, *, bins: int = BINS) -> DataFrame:
    """``scores`` (doc_id, score, ...) of the ``drawn`` highest rows alone, with rank from 1; of equal scores
    the smaller doc_id comes first, null last.

    An exact histogram of the whole-number scores: ranges of scores are counted first, ``bins`` of them; what lies above a range is its
    offset. Within the ranges that reach the drawn ones, counts of each score, summed from above, give the rank
    offset of the score. Only rows whose score survives are moved; each score numbers its own by doc_id."""
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if drawn <= 0 or ends["low"] is None:
        return scores.withColumn("rank", F.lit(None).cast("long")).where("false")
    width = (ends["high"] - ends["low"]) // bins + 1
    which = F.expr(f"(score - ({ends['low']}L)) div {width}L")
    above, offsets = 0, []
    for r in sorted(scores.groupBy(which.alias("bin")).count().collect(), key=lambda r: -r["bin"]):  # a row a range
        if above >= drawn:
            break
        offsets.append((r["bin"], above))
        above += r["count"]
    floor = ends["low"] + offsets[-1][0] * width
    open_ = scores.where(F.col("score") >= floor)
    starts = scores.sparkSession.createDataFrame(offsets, "bin long, above long")
    counts = open_.groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", which)
    higher = Window.partitionBy("bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("in_bin", F.coalesce(F.sum("n").over(higher), F.lit(0))).join(F.broadcast(starts), "bin")
    counts = counts.select(F.col("score").alias("its_score"), (F.col("above") + F.col("in_bin")).alias("offset")).where(F.col("offset") < drawn)
    met = open_.join(counts, open_["score"] == counts["its_score"])
    nth = F.row_number().over(Window.partitionBy("its_score").orderBy(F.col("doc_id").asc_nulls_last()))
    return met.withColumn("rank", (F.col("offset") + nth).cast("long")).where(F.col("rank") <= drawn).drop("its_score", "offset")


def resample(documents: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, runs: int = RUNS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null where it isn't drawn.

    Words are runs of letters and digits, lower-cased in A to Z alone, all but ASCII taken as letters. A document weighs the sum of its
    features' ``gains``; a Gumbel draw by id is added, so the highest scores are a sample without replacement
    by weight. Of the documents with ``least_words`` or more ``percent`` in a hundred are drawn, rounded down, of equal
    scores the smaller doc_id. Counts and gains cover all texts; scores are written once and read for the ranges, the histogram and the rows.

    Null and empty texts have no features, weigh 0 and aren't drawn. A null doc_id draws as the empty
    string and comes last among equals. Rows that repeat an id are scored and counted one by one. Other columns
    don't matter. Without documents the result is empty; without a target all weigh by rarity alone."""
    gain = gains(documents, target, buckets=buckets, runs=runs)
    own = cut(scored(documents, gain, runs=runs, seed=seed).withColumn("place", F.monotonically_increasing_id()), "scores")
    open_ = own.where(F.col("n_words") >= least_words)
    drawn = cut(ranked(open_.select("doc_id", "score", "place"), open_.count() * percent // 100), "drawn").select(F.col("place").alias("its_place"), "rank")
    return own.join(drawn, own["place"] == drawn["its_place"], "left").drop("place", "its_place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def _words_sql(source: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {source}"


#: DuckDB has no CRC-32: it is worked out for each distinct word, byte by byte and bit by bit.
SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_words_sql('documents')}), b AS MATERIALIZED (SELECT {_words_sql('benchmark')}),
x AS (SELECT doc_id, unnest(w) AS word FROM d), y AS (SELECT unnest(w) AS word FROM b),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM x UNION SELECT word FROM y)),
tb AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(i))),
by_ AS (SELECT word, list_concat([4294967295], list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)) AS bytes FROM v),
k AS MATERIALIZED (SELECT word, xor(list_reduce(bytes, lambda c, z: xor(t[(xor(c, z) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM by_, tb),
s AS (SELECT bucket, count(*) AS s FROM x JOIN k USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM y JOIN k USING (word) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000 AS up, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000 AS down),
g AS (SELECT bucket, floor(1000::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * up / ((coalesce(s, 0) + 1)::DOUBLE * down)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
o AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM x JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN o USING (doc_id)),
f AS (SELECT *, weight + floor(-1000::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM f WHERE n_features >= 20)
SELECT f.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM f LEFT JOIN r USING (doc_id)
"""
QUERIES, ORACLES = {"op11_importance_resampling": query}, {"op11_importance_resampling": SQL}
