"""Toxicity by multiple-instance learning: labels of documents, scores of sentences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, slices, table

#: Labelled documents of each class from which the model is learned, at most.
PER_CLASS = 1_500
#: Characters of the texts from which it is learned, of each class, at most: documents in their seeded order as far as they fit.
LEARN_CHARS = 16_000_000
#: Features that a worker scores at once, but for one document's.
CHUNK = 1 << 18
#: A word or word start counts if so many documents of the sample hold it.
LEAST_DOCS = 4
#: Lengths of the word starts that count beside whole words.
STARTS = (4, 5)


def sentences(text: Column) -> Column:
    """Stretches of a text between full stops, question and exclamation marks and line ends."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[.!?\n]+")


def word_ids(text: Column) -> Column:
    """For each sentence the hashes of its words and of their first letters;
    words are runs of letters."""

    def ids(s: Column) -> Column:
        w = F.split(s, r"[^\p{L}]+")
        return F.concat(F.transform(w, lambda x: F.hash(F.lit(0), x)), *(starts(w, n) for n in STARTS))

    def starts(w: Column, n: int) -> Column:
        return F.transform(F.filter(w, lambda x: F.length(x) > n), lambda x: F.hash(F.lit(n), F.substring(x, 1, n)))

    return F.transform(sentences(text), ids)


@dataclass
class Model:
    """A sentence is toxic with probability sigmoid(bias + the weights of its
    features), a document if any sentence is: 1 - product of (1 - p). Features
    are 32-bit hashes in rising order; all others weigh nothing."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of sentences that start at ``starts``; split gives none an empty list."""
        if not len(starts) or not len(self.features):
            return np.full(len(starts), self.bias)
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        hit = np.flatnonzero(self.features[at] == features)
        sentence = np.searchsorted(starts, hit, side="right") - 1
        once = np.unique(sentence.astype(np.int64) * len(self.features) + at[hit])
        return np.bincount(once // len(self.features), weights=self.weights[once % len(self.features)], minlength=len(starts)) + self.bias


def learn(features: np.ndarray, sentence_starts: np.ndarray, doc_starts: np.ndarray, toxic: np.ndarray, *, rounds: int = 400, l1: float = 3e-4) -> Model:
    """Fits a Model to documents given as features, the features at which
    sentences start and the sentences at which documents start: full-batch Adam
    on the log loss of the noisy-or, with an L1 penalty that leaves few
    features. Without both classes the score is 0 or 1 for all."""
    none = np.empty(0, features.dtype), np.empty(0)
    if not toxic.any() or toxic.all():
        return Model(*none, 30.0 if len(toxic) and toxic.all() else -30.0)
    doc_of = np.repeat(np.arange(len(doc_starts), dtype=np.int32), np.diff(np.append(doc_starts, len(sentence_starts))))
    sentence_of = np.repeat(np.arange(len(sentence_starts), dtype=np.int32), np.diff(np.append(sentence_starts, len(features))))
    part, row, col, words, n = features.view(np.uint32) >> np.uint32(29), [], [], [], 0
    for k in (4, 5, 6, 7, 0, 1, 2, 3):  # an eighth at a time, in rising order, so that memory stays near that of the features
        own = np.flatnonzero(part == k)
        f = features[own]
        order = np.argsort(f, kind="stable")
        f, sentence = f[order], sentence_of[own[order]]
        doc = doc_of[sentence]
        new = np.append(True, f[1:] != f[:-1])[: len(f)]
        first_in_doc = new | np.append(True, doc[1:] != doc[:-1])[: len(f)]  # stable: documents rise within a feature
        group = np.cumsum(new, dtype=np.int32) - 1
        enough = np.bincount(group, weights=first_in_doc, minlength=int(new.sum())) >= LEAST_DOCS
        number, keep = np.cumsum(enough) - 1, enough[group]
        width = max(1, int(enough.sum()))
        pairs = np.unique(sentence[keep].astype(np.int64) * width + number[group[keep]])
        row.append((pairs // width).astype(np.int32))
        col.append((pairs % width + n).astype(np.int32))
        words.append(f[new][enough])
        n += len(words[-1])
    row, col, vocabulary = np.concatenate(row), np.concatenate(col), np.concatenate(words)
    del part, own, f, order, sentence, doc, new, first_in_doc, group, keep, pairs, sentence_of
    y = toxic.astype(float)
    w, bias, m, v, mb, vb, step = np.zeros(n), -3.0, np.zeros(n), np.zeros(n), 0.0, 0.0, 0.1
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col], minlength=len(sentence_starts)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), doc_starts))
        pull = np.where(toxic, -clean / np.maximum(1 - clean, 1e-9), 1 - y) / len(y)
        g_z = p * pull[doc_of]
        g, gb = np.bincount(col, weights=g_z[row], minlength=n), g_z.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate_t = step / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        w = w - rate_t * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - rate_t * l1, 0)
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    used = w != 0
    return Model(vocabulary[used], w[used], bias)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, learn_chars: int = LEARN_CHARS, seed: int = 5) -> Model:
    """Learns from labelled documents whose id isn't held out (CRC-32 of the id
    as text, modulo 5, is 0). Of each class the ``per_class`` labels with the
    least seeded hash are taken; their ids are broadcast, and only their texts move.
    An id counts once, with the least of its texts. Texts of more than a 64th of
    ``learn_chars`` aren't learned from, the others in the seeded order until a class's have ``learn_chars`` characters; so rows and bytes that come to
    the driver are bounded. A document with several labels is toxic if one says so;
    null labels and ids count for nothing."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).where(~_held_out(F.col("doc_id")))
    one = one.withColumn("place", F.xxhash64(F.lit(seed), "doc_id"))
    picked = one.where("toxic").orderBy("place", "doc_id").limit(per_class).unionByName(one.where("not toxic").orderBy("place", "doc_id").limit(per_class))
    texts = documents.select(documents["doc_id"].alias("doc_id"), F.coalesce(documents["text"], F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text")).where(F.length("text") <= learn_chars // 64)
    so_far = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy("place", "doc_id"))  # per_class rows a class at most
    got = texts.withColumn("so_far", so_far).where(F.col("so_far") <= learn_chars).select("toxic", word_ids(F.col("text")).alias("words")).toArrow().combine_chunks()
    if not len(got):
        return Model(np.empty(0, np.int32), np.empty(0), -30.0)
    words, sentence_starts, doc_starts = _unnest(got.column("words").combine_chunks())
    return learn(words, sentence_starts, doc_starts, got.column("toxic").to_numpy())


def _unnest(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    outer = column.offsets.to_numpy()
    inner = column.values.slice(outer[0], outer[-1] - outer[0])
    offsets = inner.offsets.to_numpy()
    words = inner.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return words, offsets[:-1] - offsets[0], outer[:-1] - outer[0]


def _spans(words: np.ndarray, sentence_starts: np.ndarray, doc_starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First and last sentence, first and last feature of some documents at a time."""
    edges = np.append(sentence_starts[doc_starts], len(words))
    for i, j in slices(np.diff(edges), CHUNK):
        yield doc_starts[i], doc_starts[j] if j < len(doc_starts) else len(sentence_starts), edges[i], edges[j]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Adds toxicity (0 to 1) and offending: the numbers, from 0, of the
    sentences that alone would be called toxic.

    Only the text is scored. Null and empty texts are one empty sentence, so
    they score what the bias gives. Every row is scored on its own; other
    columns stay, except those two names.
    """
    @F.arrow_udf("struct<score:double,offending:array<int>>")
    def scored(column: pa.Array) -> pa.Array:
        words, sentence_starts, doc_starts = _unnest(column)
        if not len(doc_starts):
            return pa.array([], pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.int32()))]))
        z = np.concatenate([model.logits(words[a:b], sentence_starts[s:t] - a) for s, t, a, b in _spans(words, sentence_starts, doc_starts)])
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        of_docs = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), doc_starts))
        bad = np.flatnonzero(p >= 0.5)
        doc = np.searchsorted(doc_starts, bad, side="right") - 1
        offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(doc_starts))))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array((bad - doc_starts[doc]).astype(np.int32)))
        return pa.StructArray.from_arrays([pa.array(of_docs), lists], ["score", "offending"])

    documents = documents.drop("toxicity", "offending")
    got = fresh(documents, "scored")
    return documents.withColumn(got, scored(word_ids(F.col("text")))).withColumns({"toxicity": F.col(got)["score"], "offending": F.col(got)["offending"]}).drop(got)


def stage(documents: DataFrame, labels: DataFrame, *, most: float = 0.5) -> DataFrame:
    """The documents that score below ``most``; columns as they were."""
    model = train(documents, labels)
    return score(documents, model).where(F.col("toxicity") < most).select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(d, train(d, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "offending")


QUERIES, ORACLES = {"op9_toxicity": query}, {}
