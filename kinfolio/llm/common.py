"""Tables, words and small array kernels that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and U+0009 to U+000D, nothing else.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(documents: DataFrame) -> DataFrame:
    """doc_id and text alone; other columns can have any names."""
    return documents.select(documents["doc_id"].alias("doc_id"), documents["text"].alias("text"))


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose lengths add up to ``most`` or that are one row."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def rolled(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of all runs of ``k`` values of ``h``, by doubling: a run of a + b
    is a run of a followed by a run of b. Position i holds the run that starts there. A
    polynomial modulo 2^64 of values that are hashes themselves; the strings by which such
    polynomials fail whatever their base have 1024 values or more, so ``k`` is to stay below."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    power, have, acc, done = np.uint64(base), h.astype(np.uint64), None, 0
    shift = np.uint64(1)  # base ** done
    width, rest = 1, k
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if acc is None:
                    acc, done, shift = have, width, power
                else:  # the run so far, then one of this width
                    n = len(h) - done - width + 1
                    acc = acc[:n] * power + have[done : done + n]
                    done += width
                    shift = shift * power
            rest >>= 1
            if rest:
                n = len(have) - width
                have = have[:n] * power + have[width : width + n]
                power, width = power * power, width * 2
        return mixed(acc)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def least_of(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours, by doubling."""
    if len(x) < w:
        return np.empty(0, x.dtype)
    have, width = x, 1
    while width * 2 <= w:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    return have if width == w else np.minimum(have[: len(x) - w + 1], have[w - width :][: len(x) - w + 1])


def flat_lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of an Arrow list column without nulls."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of text that are hashed at once, and that are searched for words at once but for one text's.
SEGMENT, SEARCHED = 1 << 18, 1 << 21
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Places in a word whose bytes' values are looked up; further ones are worked out.
_PLACES = 32


def _value(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What a byte at a place in its word adds to the word's hash: a number that looks random for each pair."""
    with np.errstate(over="ignore"):
        return mixed(mixed((place.astype(np.uint64) + np.uint64(1)) * _ODD) + (byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


_FIRST = _value(np.tile(np.arange(256), _PLACES), np.repeat(np.arange(_PLACES), 256))
_SAME = np.arange(256, dtype=np.uint8)
_FOLDED = _SAME.copy()
_FOLDED[65:91] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts (null: none) and where each text starts and ends in them."""
    binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    texts = texts.fill_null(b"" if binary else "") if texts.null_count else texts
    _, at, data = texts.buffers()
    bounds = np.frombuffer(at, np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def word_hashes(texts: pa.Array, *, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of an Arrow column of texts, and row offsets.

    A word's hash is the sum of a value for each of its bytes and the byte's place, so
    words differ as if by chance, without a rule as polynomials modulo 2^64 have one. ``fold`` reads A to Z as
    a to z. Memory is a few times SEARCHED beside the texts and the result."""
    data, bounds = text_bytes(texts)
    done, offsets = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in slices(np.diff(bounds), SEARCHED):
        h, at = _words_of(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], _FOLDED if fold else _SAME)
        done.append(h)
        offsets.append(at[1:] + offsets[-1][-1])
    return np.concatenate(done), np.concatenate(offsets)


def _values(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``_value`` of bytes, most from the table."""
    near = place < _PLACES
    if near.all():
        return _FIRST[place * 256 + data]
    out = np.empty(len(data), np.uint64)
    out[near] = _FIRST[place[near] * 256 + data[near]]
    out[~near] = _value(data[~near], place[~near])
    return out


def _words_of(data: np.ndarray, bounds: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, of texts that start and end at ``bounds``; bytes are ``read`` as others."""
    blank = _BLANK[data]
    opens = np.append(True, blank[:-1])[: len(blank)]
    opens[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(opens & ~blank)
    del opens
    out, i = np.empty(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            a = starts[i]
            j = max(i + 1, int(np.searchsorted(starts, a + SEGMENT)))
            b = starts[j] if j < len(starts) else len(data)
            if b - a > SEGMENT and j > i + 1:
                j -= 1
                b = starts[j]
            if j > i + 1 or b - a <= SEGMENT:
                at = starts[i:j] - a
                place = np.arange(b - a) - np.repeat(at, np.diff(np.append(at, b - a)))
                value = _values(read[data[a:b]], place)
                value[blank[a:b]] = 0
                out[i:j] = np.add.reduceat(value, at)
            else:  # one word, longer than a segment
                total = np.uint64(0)
                for s in range(a, b, SEGMENT):
                    e = min(b, s + SEGMENT)
                    value = _values(read[data[s:e]], np.arange(s - a, e - a))
                    value[blank[s:e]] = 0
                    total += value.sum(dtype=np.uint64)
                out[i] = total
            i = j
        return mixed(out), np.searchsorted(starts, bounds)


def by_row_and(token: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order of few rows' tokens by row, then token; twice as fast as lexsort."""
    order = np.argsort(token)
    if len(row) and row[-1] < 1 << 16:
        return order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    return np.lexsort((token, row))
