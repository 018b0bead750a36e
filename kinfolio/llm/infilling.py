"""Fill-in-the-middle transformation by a parallel automaton scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.lineage import cut
from .common import fresh, only, slices, table, text_bytes

#: Bytes of a chunk. Longer texts are scanned by many tasks.
CHUNK = 1 << 16
#: Bytes of text that are scanned at once but for one text's.
SEARCHED = 1 << 21
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts these stay plain from, and of a hundred others these are given suffix first; the seed of the draws.
PLAIN_FROM, SUFFIX_FIRST, SEED = 90, 20, 1

#: The automaton of the tokens ``[A-Za-z]+|[^A-Za-z]`` over bytes. Classes: 0 a letter, 1 the first byte of another
#: character, 2 a further byte of one. States: 0 outside of a run of letters, 1 inside. After each class the
#: state that follows, and whether a token starts there, by the state before.
NEXT = np.array([[1, 0, 0], [1, 0, 0]])
STARTS = np.array([[1, 1, 0], [0, 1, 0]])
_CLASS = np.ones(256, np.int8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 0
_CLASS[0x80:0xC0] = 2


def transition(data: np.ndarray) -> tuple[list[int], list[int], int]:
    """What a chunk does: for each state before it the state after it and the tokens that
    start in it; and its code points. Every class leads to one state whatever
    the state before, so only the first byte's tokens depend on that."""
    if not len(data):
        return list(range(len(NEXT))), [0] * len(NEXT), 0
    kind = _CLASS[data]
    if (NEXT != NEXT[0]).any():
        raise ValueError("an automaton with states that depend on more than the last class isn't scanned by this")
    inner = int(STARTS[NEXT[0][kind[:-1]], kind[1:]].sum())
    return [int(NEXT[s][kind[-1]]) for s in range(len(NEXT))], [int(STARTS[s][kind[0]]) + inner for s in range(len(NEXT))], int((kind != 2).sum())


def token_starts(data: np.ndarray, state: int = 0) -> np.ndarray:
    """Where tokens start in a chunk that is entered in ``state``."""
    kind = _CLASS[data]
    before = np.append(state, NEXT[0][kind[:-1]])[: len(kind)]
    return np.flatnonzero(STARTS[before, kind])


_CUTS = StructType([StructField(c, LongType()) for c in ("n", "prefix_chars", "middle_chars")])


@F.arrow_udf(_CUTS)
def _cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Tokens of whole texts, and the code points of prefix and middle."""
    data, bounds = text_bytes(texts)
    draws = [h.to_numpy() for h in (h1, h2)]
    out = [[np.empty(0, np.int64)] for _ in range(3)]
    for a, b in slices(np.diff(bounds), SEARCHED):
        part, at = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        kind = _CLASS[part]
        before = np.append(0, NEXT[0][kind[:-1]])[: len(kind)]
        before[at[:-1][at[:-1] < len(kind)]] = 0  # each text is entered anew
        starts = np.flatnonzero(STARTS[before, kind])
        chars = np.append(0, np.cumsum(kind != 2))
        low, high = np.searchsorted(starts, at[:-1]), np.searchsorted(starts, at[1:])
        n = high - low
        u, v = (h[a:b] % (n + 1) for h in draws)
        ends = np.append(starts, len(part))
        place = [np.where(k < n, ends[np.minimum(low + k, len(starts))], at[1:]) for k in (np.minimum(u, v), np.maximum(u, v))]
        first, second = (chars[p] - chars[at[:-1]] for p in place)
        for held, x in zip(out, (n, first, second - first), strict=True):
            held.append(x.astype(np.int64))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in out], ["n", "prefix_chars", "middle_chars"])


def _draws(doc_id: Column, seed: int) -> list[Column]:
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, text) as rows (place, chunk, bytes); no character is cut."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        for i, place in enumerate(batch.column(0).to_pylist()):
            a, k = int(bounds[i]), 0
            while a < bounds[i + 1]:
                b = min(a + CHUNK, int(bounds[i + 1]))
                while b < bounds[i + 1] and _CLASS[data[b]] == 2:
                    b -= 1
                yield pa.record_batch([pa.array([place], pa.int64()), pa.array([k], pa.int32()), pa.array([data[a:b].tobytes()], pa.binary())], names=["place", "chunk", "bytes"])
                a, k = b, k + 1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [transition(np.frombuffer(x.as_buffer(), np.uint8)) for x in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([d[0] for d in done], pa.list_(pa.int32())), pa.array([d[1] for d in done], pa.list_(pa.int64())), pa.array([d[2] for d in done], pa.int64())], names=["place", "chunk", "after", "tokens", "chars"])


_ENTRIES = "place long, n long, chunk int, state int, cut int, token long, chars_before long"


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a giant text (place, h1, h2, its chunks' summaries in order): how many tokens it
    has, and for either cut its chunk, that chunk's entry state, the token in
    the chunk before which it stands, and the code points before the chunk. Functions are composed from the left; composition
    is associative, so any grouping of chunks gives the same entry states."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            state, tokens, chars, entry = 0, 0, 0, []
            for s in r["chunks"]:
                entry.append((state, tokens, chars))
                tokens, chars, state = tokens + s["tokens"][state], chars + s["chars"], s["after"][state]
            for which, token in enumerate(sorted((r["h1"] % (tokens + 1), r["h2"] % (tokens + 1)))):
                k = int(np.searchsorted([t for _, t, _ in entry], token, side="right")) - 1 if token < tokens else len(entry) - 1
                rows.append({"place": r["place"], "n": tokens, "chunk": k, "state": entry[k][0], "cut": which, "token": token - entry[k][1], "chars_before": entry[k][2]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("place", pa.int64()), ("n", pa.int64()), ("chunk", pa.int32()), ("state", pa.int32()), ("cut", pa.int32()), ("token", pa.int64()), ("chars_before", pa.int64())]))


@F.arrow_udf(LongType())
def _chars_to(data: pa.Array, state: pa.Array, token: pa.Array) -> pa.Array:
    """Code points of a chunk before its token of that number, all if it has fewer."""
    out = []
    for x, s, t in zip(data, state.to_pylist(), token.to_pylist(), strict=True):
        b = np.frombuffer(x.as_buffer(), np.uint8)
        starts = token_starts(b, s)
        out.append(int((_CLASS[b[: starts[t] if t < len(starts) else len(b)]] != 2).sum()))
    return pa.array(out, pa.int64())


def _giants(rows: DataFrame) -> DataFrame:
    """place, n, prefix_chars and middle_chars of rows (place, text, h1, h2) with long texts, whose chunks
    are dealt out over all tasks: they are written once, summed up, and only those with a cut are looked at again."""
    chunks = cut(rows.select("place", "text").mapInArrow(_chunks, "place long, chunk int, bytes binary").repartition("place", "chunk"), "chunks")
    sums = chunks.mapInArrow(_summaries, "place long, chunk int, after array<int>, tokens array<long>, chars long")
    whole = sums.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("chunk", "after", "tokens", "chars"))).alias("chunks"))  # a few numbers a chunk
    entries = rows.select("place", "h1", "h2").join(whole, "place").mapInArrow(_selected, _ENTRIES)
    found = chunks.join(entries, ["place", "chunk"]).withColumn("at", F.col("chars_before") + _chars_to("bytes", "state", "token"))
    by = found.groupBy("place").agg(F.max("n").alias("n"), F.min("at").alias("prefix_chars"), F.max("at").alias("last"))
    return by.select("place", "n", "prefix_chars", (F.col("last") - F.col("prefix_chars")).alias("middle_chars"))


def transform(documents: DataFrame, *, plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """Adds n (tokens ``[A-Za-z]+|[^A-Za-z]``), form, prefix_chars, middle_chars and output.

    A text is cut at two tokens drawn by its id, and written as prefix, suffix, middle (psm) or
    suffix, prefix, middle (spm), each behind its marker. It stays plain, with null cuts, if it is empty, holds a marker, or by a
    draw. Cuts are found by an automaton whose states tell if a token goes on: a chunk's effect is a function of the state before it, with a
    count of tokens for each. Texts up to CHUNK bytes are one chunk, scanned where they are; longer ones are dealt out
    chunk by chunk, their functions composed, and the cuts looked up in the chunks that hold them.

    Null texts are empty. A null doc_id draws as the empty string; rows that repeat an id draw alike, each from its
    own text. Other columns stay; those named like the new ones give way. An empty table gives an empty result."""
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    documents = documents.drop(*new)
    cuts_c, place_c, text_c, *h_c = (fresh(documents, c) for c in ("cuts", "place", "whole", "h1", "h2", "h3", "h4"))
    d = documents.withColumn(text_c, F.coalesce("text", F.lit(""))).withColumns(dict(zip(h_c, _draws(documents["doc_id"], seed), strict=True)))
    long = F.octet_length(text_c) > CHUNK
    small = d.where(~long).withColumn(cuts_c, _cuts(F.col(text_c), F.col(h_c[0]), F.col(h_c[1])))
    own = cut(d.where(long).withColumn(place_c, F.monotonically_increasing_id()), "giants")
    found = _giants(own.select(F.col(place_c).alias("place"), F.col(text_c).alias("text"), F.col(h_c[0]).alias("h1"), F.col(h_c[1]).alias("h2")))
    found = found.select(F.col("place").alias("its_place_"), F.struct("n", "prefix_chars", "middle_chars").alias(cuts_c))
    giant = own.join(found, own[place_c] == found["its_place_"]).drop(place_c, "its_place_")
    out = small.unionByName(giant)
    t, c = F.col(text_c), F.col(cuts_c)
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    plain = (t == "") | marked | (F.col(h_c[2]) % 100 >= plain_from)
    out = out.withColumn("form", F.when(plain, "plain").when(F.col(h_c[3]) % 100 < suffix_first, "spm").otherwise("psm"))
    first, last = c["prefix_chars"].cast("int"), (c["prefix_chars"] + c["middle_chars"]).cast("int")
    prefix, middle, suffix = F.substring(t, F.lit(1), first), F.substring(t, first + 1, c["middle_chars"].cast("int")), F.substring(t, last + 1, F.length(t) - last)
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    out = out.withColumn("output", F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", psm).otherwise(spm))
    at = lambda name: F.when(F.col("form") != "plain", c[name]).alias(name)
    return out.select(*documents.columns, c["n"].alias("n"), "form", at("prefix_chars"), at("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form were made of. Parts can't hold a marker, nor make one with their neighbours."""
    part = lambda i: F.get(F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE))), F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(only(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, len(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM p
"""
QUERIES, ORACLES = {"op13_fill_in_middle": query}, {"op13_fill_in_middle": SQL}
