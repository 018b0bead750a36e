"""Substring dedup by suffix arrays: external induced sorting, shard by shard.

Strings that could repeat are dealt out to shards by their content, so equal ones
meet; each shard is sorted as a suffix array with common prefixes, by induction.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import SEGMENT, flat_lists, fresh, least_of, mixed, only, rolled, table, text_bytes
from .substrings import PASSED, SEVERAL, _rows, _tag

#: Bytes of a window, of the least window, and at most of the anchor in it whose hash says where the window goes.
WINDOW, LEAST, ANCHOR = 50, 16, 20
#: Bytes of text that a worker handles at once, and windows of one row at most.
PIECE, RUN = 1 << 21, 1 << 12
#: Bytes that are sorted as one shard, unless one key has more; suffixes of a shard that are held in memory at a time.
SHARD, HELD = 1 << 22, 1 << 22
#: Suffixes that are induced from at once.
STEP = 1 << 15
#: One document in so many is looked at to see which anchors are frequent; from a share of SHARE of them on, and TIMES at least, their windows are dealt out one by one.
SAMPLED, SHARE, TIMES, MOST_FREQUENT = 64, 1 / 100, 8, 1 << 16
#: Rows of the first level that a task packs at once, that it unpacks at once about, that it sorts at once about, and ranges of keys for each partition that they are dealt out to.
PACKED, UNPACKED, SORTED, RANGES = 1 << 18, 1 << 15, 1 << 19, 4

#: Bits of an anchor's hash; ``at`` of a row whose run stands in a smaller document as it is.
BITS, SAME = 40, -3
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# --- the suffix array of one shard


class Queue:
    """A priority queue on disk for induction. A suffix has the character that it starts
    with as its priority, then its arrival: suffixes come in the order of those that they
    precede by one character, so arrival is their order. Each comes with its position and the
    length of the prefix that it shares with the one before it. Beyond ``held`` suffixes
    all go to a file without a name, which ends with the queue."""

    def __init__(self, held: int = 0):
        self.most, self.inside, self.file = held or HELD, 0, None
        self.of: dict[int, list] = {}

    def push(self, char: np.ndarray, at: np.ndarray, common: np.ndarray) -> None:
        """Suffixes by rising character, of equal ones in their order."""
        if not len(char):
            return
        cuts = np.flatnonzero(np.diff(char)) + 1
        bounds = [0, *cuts.tolist(), len(char)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            self.of.setdefault(int(char[a]), []).append((at[a:b], common[a:b]))
        self.inside += len(char)
        if self.inside > self.most:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="suffixes-")
        for parts in self.of.values():
            loose = [i for i, p in enumerate(parts) if len(p) == 2]
            if loose:
                at, common = (np.concatenate([parts[i][k] for i in loose]) for k in (0, 1))
                where = self.file.seek(0, 2)
                self.file.write(at.tobytes())
                self.file.write(common.tobytes())
                parts[loose[0] :] = [(where, len(at), None)]  # parts in files come first
        self.inside = 0

    def _read(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        where, n, _ = part
        self.file.seek(where)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)

    def pop(self, char: int, *, last_first: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The suffixes of a character, also those that are pushed meanwhile, STEP at most at a time."""
        parts = self.of.get(char, [])
        while parts:
            loose = len(parts) - 1 if last_first else 0  # neighbours in memory come as one
            while 0 <= loose < len(parts) and len(parts[loose]) == 2:
                loose += -1 if last_first else 1
            a, b = (loose + 1, len(parts)) if last_first else (0, loose)
            if a < b:
                at, common = (np.concatenate([p[k] for p in parts[a:b]]) for k in (0, 1))
                self.inside -= len(at)
                del parts[a:b]
            else:
                at, common = self._read(parts.pop(-1 if last_first else 0))
            steps = range(0, len(at), STEP)
            for i in reversed(steps) if last_first else steps:
                yield at[i : i + STEP], common[i : i + STEP]


def _kinds(x: np.ndarray) -> np.ndarray:
    """For each place whether the suffix there is less than the next one (as the end, 0, is)."""
    n = len(x)
    differs = np.append(x[1:] != x[:-1], True)
    settles = np.flatnonzero(differs)
    less = np.empty(n, bool)
    less[settles[:-1]] = x[settles[:-1]] < x[settles[:-1] + 1]
    less[n - 1] = True
    less = np.repeat(less[settles], np.diff(settles, prepend=-1))
    less[x == 0] = True
    return less


def _names(symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Numbers of the stretches of ``symbols``: equal ones share one, and they are in the
    stretches' order. No stretch is the beginning of another one."""
    bits = max(1, int(symbols.max()).bit_length())
    pack = max(1, 63 // bits)
    name, open_, done = np.zeros(len(start), np.int64), np.arange(len(start)), 0
    while len(open_):
        word = np.zeros(len(open_), np.int64)
        for j in range(done, done + pack):
            inside = length[open_] > j
            word = (word << bits) | np.where(inside, symbols[np.minimum(start[open_] + j, len(symbols) - 1)], 0)
        order = np.lexsort((word, name[open_])) if done else np.argsort(word)
        g, w = name[open_][order], word[order]
        first_g = np.append(True, g[1:] != g[:-1])
        first = first_g | np.append(True, w[1:] != w[:-1])
        at = np.flatnonzero(first)
        base = np.flatnonzero(first_g)[np.cumsum(first_g) - 1]
        run = np.cumsum(first) - 1
        name[open_[order]] = g + at[run] - base
        size = np.diff(np.append(at, len(order)))[run]
        done += pack
        open_ = np.sort(open_[order][(size > 1) & (length[open_[order]] > done)])
    return name


def _stars(x: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Where a suffix is less than the next one and the one before is not; every end is among them."""
    star = np.zeros(len(x), bool)
    star[1:] = less[1:] & ~less[:-1]
    star[x == 0] = True
    return np.flatnonzero(star)


def _star_ranks(x: np.ndarray, less: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at ``stars``: the stretches from star to star are named, and
    where names repeat, the suffixes of the string of names are ranked in turn."""
    end = x[stars] == 0
    inner = np.flatnonzero(~end)
    name = np.zeros(len(stars), np.int64)
    if len(inner):
        name[inner] = _names(x.astype(np.int64) * 2 + less, stars[inner], stars[inner + 1] - stars[inner] + 1) + 1
    distinct, name = np.unique(name, return_inverse=True)
    if len(distinct) - bool(end.any()) == len(inner):
        return name
    return _ranks(name)


def _chained(x: np.ndarray, member: np.ndarray, first: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of one kind and of those they lead to. A suffix in ``member``
    is its character and the suffix after it; chains of them end in a suffix that
    has a ``rank``. Of one character, those where ``first`` is set come before the others."""
    place = np.flatnonzero(member | (rank >= 0))
    index = np.full(len(x) + 1, -1)
    index[place] = np.arange(len(place))
    inner = member[place]
    word = (x[place].astype(np.int64) * 2 + ~first[place]) * (len(x) + 1) + np.where(inner, 0, rank[place])
    key = np.argsort(word)
    opens = np.append(True, np.diff(word[key]) != 0)[: len(place)]
    of = np.empty(len(place), np.int64)  # a group's first place in the order is its number
    of[key] = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    own = np.arange(len(place))
    after = np.where(inner, index[np.minimum(place + 1, len(x))], own)
    while True:
        tied = np.flatnonzero((np.bincount(of, minlength=1)[of] > 1) & (after != own))
        if not len(tied):
            return _spread(of, place, len(x))
        pair = of[tied] * (len(place) + 1) + of[after[tied]]
        order = np.argsort(pair)
        opens = np.append(True, np.diff(pair[order]) != 0)
        group = np.append(True, np.diff(of[tied][order]) != 0)
        at = np.flatnonzero(opens)[np.cumsum(opens) - 1] - np.flatnonzero(group)[np.cumsum(group) - 1]
        refined = of.copy()
        refined[tied[order]] = of[tied][order] + at
        ended = after[after] == after
        of, after = refined, np.where(ended, own, after[after])


def _spread(of: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -1, np.int64)
    out[place] = of
    return out


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of strings that end in 0; equal ones share theirs. Stars
    first, by recursion; the greater suffixes are induced from them, then the lesser ones."""
    less = _kinds(x)
    stars = _stars(x, less)
    star_rank = np.full(len(x), -1, np.int64)
    star_rank[stars] = _star_ranks(x, less, stars)
    falling = _chained(x, ~less, ~less, star_rank)
    falling[less] = -1  # stars are induced again
    ends = x == 0
    falling[ends] = 0
    out = _chained(x, less & ~ends, ~less | ends, falling)
    return out


def _words_at(raw: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, the first as the highest."""
    return np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))


def _common(words: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the suffixes at a and b share, ``most`` at most; ``left`` bytes are before their ends."""
    out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    limit = np.minimum(np.minimum(left[a], left[b]), most)
    for k in range(0, most, 8):
        inside = limit[open_] > k
        open_ = open_[inside]
        if not len(open_):
            break
        differ = words[a[open_] + k] ^ words[b[open_] + k]
        same = np.zeros(len(open_), np.int64)
        for byte in range(1, 9):
            same += differ < np.uint64(1 << (64 - 8 * byte)) if byte < 8 else differ == 0
        out[open_] = k + same
        open_ = open_[same == 8]
    return np.minimum(out, limit).astype(np.uint8)


class _Induced:
    """One sweep of induction: scanned suffixes push the ones before them, with the least
    common prefix since the last push of their character, and one more."""

    def __init__(self, x: np.ndarray, most: int, held: int):
        self.x, self.most, self.queue = x, most, Queue(held)
        self.least = np.full(258, -1, np.int16)  # -1: nothing pushed yet

    def scan(self, at: np.ndarray, common: np.ndarray, takes) -> None:
        before = self.x[at - 1]
        where = np.flatnonzero(takes(before) & (before > 0))
        if not len(where):
            self.least = np.minimum(self.least, common.min())
            return
        order = where[np.argsort(before[where], kind="stable")]
        char = before[order]
        opens = np.append(True, char[1:] != char[:-1])
        low = np.where(opens, 0, np.append(0, order[:-1] + 1))
        span = order - low + 1
        level = np.frexp(span.astype(np.float64))[1] - 1
        tables = [common]
        while 2 << (len(tables) - 1) <= int(span.max()):
            t, w = tables[-1], 1 << (len(tables) - 1)
            tables.append(np.append(np.minimum(t[: len(t) - w], t[w:]), t[len(t) - w :]))
        t = np.concatenate(tables)
        n = len(common)
        shared = np.minimum(t[level * n + low], t[level * n + order - (1 << level) + 1]).astype(np.int16)
        shared[opens] = np.minimum(shared[opens], self.least[char[opens]])
        closes = np.append(opens[1:], True)
        rest = np.append(np.minimum.accumulate(common[::-1])[::-1].astype(np.int16), self.most)
        self.least = np.minimum(self.least, common.min())
        self.least[char[closes]] = rest[order[closes] + 1]
        self.queue.push(char, at[order] - 1, np.minimum(shared + 1, self.most).astype(np.uint8))


def suffixes(texts: list | pa.Array, most: int, *, held: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of some byte strings in falling order, a piece at a time: their
    places in the strings set one behind another with one place before each (the first
    string starts at 1), and how many bytes each shares with the one given before it,
    ``most`` (255 at most) at most.

    Stars are sorted by recursion on their names. A sweep over the characters induces the suffixes
    that are greater than their next from them, a sweep back all others. Both carry
    positions and common prefixes in queues that go to disk beyond ``held`` suffixes, so what is in memory
    is the text, its stars and ``held`` suffixes a queue."""
    data, bounds = text_bytes(pa.array(texts, pa.binary()) if isinstance(texts, list) else texts)
    n = len(data) + len(bounds)
    ends = bounds + np.arange(len(bounds))  # places of the ends; the first stands before all
    x = np.zeros(n, np.int16)
    inside = np.ones(n, bool)
    inside[ends] = False
    x[inside] = data.astype(np.int16) + 1
    raw = np.zeros(n + most + 8, np.uint8)
    raw[:n][inside] = data
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    words = _words_at(raw)

    less = _kinds(x)
    stars = _stars(x, less)
    stars = stars[np.argsort(_star_ranks(x, less, stars), kind="stable")]
    shared = np.append(np.uint8(0), _common(words, left, stars[1:], stars[:-1], most))
    del less
    chars = x[stars]
    rise, kept = _Induced(x, most, held), Queue(held)
    present = np.flatnonzero(np.bincount(x, minlength=257)).tolist()
    # a star meets the greatest suffix of its character that isn't less than its next
    for c in present:
        last = None
        for at, common in rise.queue.pop(c):
            kept.push(np.full(len(at), c, np.int16), at, common)
            rise.scan(at, common, lambda p, c=c: p >= c)
            last = at[-1:]
        a, b = np.searchsorted(chars, [c, c + 1])
        for i in range(a, b, STEP):
            at, common = stars[i : min(b, i + STEP)], shared[i : min(b, i + STEP)].copy()
            if i == a:
                common[0] = _common(words, left, last, at[:1], most)[0] if last is not None else 0
            rise.scan(at, common, lambda p, c=c: p > c)
    fall = _Induced(x, most, held)
    for c in reversed(present):
        if not c:
            break
        last = None
        for at, common in fall.queue.pop(c):
            yield at, common
            fall.scan(at, common, lambda p, c=c: p <= c)
            last = at[-1:]
        follows = None  # what the next one shares with the one before it
        for at, common in kept.pop(c, last_first=True):
            at, down = at[::-1], np.append(np.uint8(0), common[:0:-1])
            down[0] = follows if follows is not None else (_common(words, left, last, at[:1], most)[0] if last is not None else 0)
            follows = common[0]
            yield at, down
            fall.scan(at, down, lambda p, c=c: p < c)


def repeats(texts: pa.Array, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of every window of ``texts`` that also starts in one of a smaller
    owner, sorted: suffixes that share ``window`` bytes stand next to each other."""
    bounds = text_bytes(texts)[1]
    starts = bounds + np.arange(len(bounds)) + 1  # places of the texts, and one beyond
    found: list[np.ndarray] = []
    open_: list[np.ndarray] = []

    def settle(at: np.ndarray, opens: np.ndarray) -> None:
        several = ~(opens & np.append(opens[1:], True))
        at, opens = at[several], opens[several]
        if not len(at):
            return
        group = np.cumsum(opens) - 1
        own = owner[np.searchsorted(starts, at, side="right") - 1]
        least = np.minimum.reduceat(own, np.flatnonzero(opens))[group]
        found.append(at[own > least])

    for at, common in suffixes(texts, window):
        opens = common < window
        cuts = np.flatnonzero(opens)
        if not len(cuts):
            open_.append(at)
            continue
        if open_:
            held = np.concatenate([*open_, at[: cuts[0]]])
            if len(held) > 1:
                settle(held, np.append(True, np.zeros(len(held) - 1, bool)))
        a, b = cuts[0], cuts[-1]
        if b > a:
            settle(at[a:b], opens[a:b])
        open_ = [at[b:]]
    if open_ and sum(map(len, open_)) > 1:
        held = np.concatenate(open_)
        settle(held, np.append(True, np.zeros(len(held) - 1, bool)))
    at = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    text = np.searchsorted(starts, at, side="right") - 1
    return text, at - starts[text]


# --- which windows could repeat, and where they go


def _pieces(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts of a batch at a time: their bytes, and for each window its start in
    them, its row and its start in its text. Longer texts come in several pieces that overlap by a window less one."""
    data, bounds = text_bytes(batch.column(1))
    known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    cuts: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(known & (np.diff(bounds) >= window)).tolist():
        cuts += [(i, int(s), int(min(bounds[i + 1], s + PIECE + window - 1))) for s in range(bounds[i], bounds[i + 1] - window + 1, PIECE)]
    at, total = 0, 0
    for k, (_, s, e) in enumerate(cuts):
        total += e - s
        if total >= PIECE or k == len(cuts) - 1:
            some = cuts[at : k + 1]
            lengths = np.array([z - a for _, a, z in some])
            first = np.cumsum(lengths) - lengths
            counts = lengths - window + 1
            row, begin = np.array([i for i, _, _ in some]), np.array([a for _, a, _ in some])
            each = lambda x, counts=counts: np.repeat(x.astype(np.int32), counts)
            place = np.arange(counts.sum(), dtype=np.int32)
            before = np.cumsum(counts) - counts
            yield np.concatenate([data[a:z] for _, a, z in some]), place + each(first - before), each(row), place + each(begin - bounds[row] - before)
            at, total = k + 1, 0


def _anchor(window: int) -> int:
    """Bytes of an anchor. Longer ones are repeated less often where no window is, but more of them are tried."""
    return min(ANCHOR, max(LEAST, 2 * window // 5))


def _anchors(data: np.ndarray, window: int) -> np.ndarray:
    """For each window 40 bits of the least hash of the anchors in it. Equal windows have the
    same, and neighbours mostly share it; others that share it by chance cost their way only."""
    out = np.empty(max(0, len(data) - window + 1), np.uint64)
    for a in range(0, len(out), SEGMENT):  # a segment at a time, for memory
        own = rolled(_CODE[data[a : a + SEGMENT + window - 1]], _anchor(window))
        np.right_shift(least_of(own, window - _anchor(window) + 1), np.uint64(64 - BITS), out=out[a : a + SEGMENT])
    return out


def _opens(key: np.ndarray, at: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where runs of neighbouring windows of one text with one key start."""
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (start[1:] != start[:-1] + 1)))


def _digests(data: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """48 bits for each stretch of ``data``; equal stretches have the same. Polynomials modulo 2^64 fail from 1024 values on
    whatever their base, so longer stretches have one that depends on ``other``: they count as different."""
    powers = lambda base, n: np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))
    sums, own, power = np.zeros(len(data) + 1, np.uint64), powers(_BASE, SEGMENT), 1
    with np.errstate(over="ignore"):
        for a in range(0, len(data), SEGMENT):  # a segment at a time, for memory
            some = data[a : a + SEGMENT]
            np.cumsum(_CODE[some] * own[: len(some)] * np.uint64(power), out=sums[a + 1 : a + 1 + len(some)])
            sums[a + 1 : a + 1 + len(some)] += sums[a]
            power = power * pow(_BASE, SEGMENT, 1 << 64) % (1 << 64)
        back = powers(pow(_INVERSE, SEGMENT, 1 << 64), len(data) // SEGMENT + 1)[start // SEGMENT] * powers(_INVERSE, SEGMENT)[start % SEGMENT]
        code = (sums[start + size] - sums[start]) * back + mixed(size.astype(np.uint64))
        code = np.where(size < 1024, code, mixed(other.astype(np.uint64)) ^ start.astype(np.uint64))
    return (mixed(code) >> np.uint64(16)).view(np.int64)


def _first_level(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A row an anchor, document and digest of the run of windows that try the anchor, as ``at``; anchors that several
    documents of a piece hold are known to be repeated, and their runs are compared by their bytes."""
    for batch in batches:
        ids = batch.column(0).fill_null(0).to_numpy()
        for data, at, row, start in _pieces(batch, window):
            key = _anchors(data, window)[at]
            opens = _opens(key, at, row, start)
            doc = ids[row[opens]]
            code = _digests(data, at[opens], np.diff(np.append(opens, len(key))) + window - 1, doc)
            key = key[opens]
            order = np.lexsort((code, doc, key))
            key, doc, code = key[order], doc[order], code[order]
            new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))
            key, doc, code = key[new], doc[new], code[new]
            first = np.append(True, key[1:] != key[:-1])
            group, opens = np.cumsum(first) - 1, np.flatnonzero(first)
            several = (np.maximum.reduceat(doc, opens) > np.minimum.reduceat(doc, opens))[group] if len(key) else first[:0]
            kept = first | ~several
            yield _rows(key[kept], doc[kept], np.where(several, SEVERAL, code)[kept])
            if several.any():
                own = several & np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
                yield _rows(key[own], doc[own], np.full(own.sum(), PASSED))


def _lows(ranges: int, window: int) -> np.ndarray:
    """The least keys of all ranges but the first, so that the anchors which are tried fill the ranges evenly. They are the least of their
    neighbours, so of uniform hashes u the share that is tried up to u is as below."""
    n, u = window - _anchor(window), np.linspace(0, 1, 1 << 18)
    share = 1 - (1 - u) ** (n + 1) * (n + 2 - n * (1 - u)) / 2
    return (np.interp(np.arange(1, ranges) / ranges, share, u) * (1 << BITS)).astype(np.uint64)


def _dealt(batches: Iterator[pa.RecordBatch], ranges: int, lows: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of key, doc_id and at, packed by where they go: ``to`` and a blob of rows sorted by key, whose numbers are
    written as differences, byte by byte in planes, and compressed. ``to`` is the range of the key, by the least keys of all ranges but
    the first or else by equal ranges; of results it comes from the doc_id."""
    press = zstandard.ZstdCompressor(level=1)
    lows = np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << BITS) // ranges) if lows is None else lows

    def packed(rows: pa.Table) -> pa.RecordBatch:
        key, ids, at = (rows.column(i).to_numpy() for i in range(3))
        to = np.where(at > PASSED, np.searchsorted(lows, key.view(np.uint64), side="right"), (mixed(ids.view(np.uint64)) % np.uint64(ranges)).astype(np.int64))
        order = np.argsort(to << BITS | key)
        to, numbers = to[order].astype(np.int32), np.stack((key[order], ids[order], at[order]))
        cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
        with np.errstate(over="ignore"):
            numbers[:2, 1:] -= numbers[:2, :-1].copy()
        numbers[1] = numbers[1] << 1 ^ numbers[1] >> 63  # small ones of either sign have high bytes of 0
        blobs = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = numbers[:, a:b].copy()
            own[:2, 0] = key[order[a]], ids[order[a]]
            blobs.append(press.compress(np.ascontiguousarray(own.view(np.uint8).reshape(3, b - a, 8).transpose(0, 2, 1)).data))
        return pa.record_batch([pa.array(to[cuts[:-1]]), pa.array(blobs, pa.binary())], names=["to", "rows"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= PACKED:
            yield packed(pa.Table.from_batches(waiting))
            waiting = []
    if waiting:
        yield packed(pa.Table.from_batches(waiting))


def _unpacked(press: zstandard.ZstdDecompressor, blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys, ids and at of a blob, sorted by key."""
    planes = np.frombuffer(press.decompress(blob), np.uint8).reshape(3, 8, -1)
    key, ids, at = planes.transpose(0, 2, 1).copy().view(np.int64)[:, :, 0]
    with np.errstate(over="ignore"):
        ids[1:] = ids[1:].view(np.uint64) >> np.uint64(1) ^ -(ids[1:] & 1).view(np.uint64)
        return np.cumsum(key), np.cumsum(ids), at


def _undealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in blobs."""
    press, waiting = zstandard.ZstdDecompressor(), []
    for batch in batches:
        for blob in batch.column(1):
            waiting.append(_unpacked(press, blob.as_buffer()))
            if sum(len(x[0]) for x in waiting) >= UNPACKED or len(waiting) >= 64:
                yield _rows(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting = []
    if waiting:
        yield _rows(*map(np.concatenate, zip(*waiting, strict=True)))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key. Of keys that several documents hold: if all runs are the same, the documents
    beyond the least, as SAME, and nothing has to be compared any more; otherwise all of them, as 0 or PASSED."""
    rest: list[np.ndarray] | None = None

    def judged(key: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        first = np.append(True, key[1:] != key[:-1])
        group, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        open_, most = at > PASSED, np.iinfo(np.int64)
        low = np.minimum.reduceat(np.where(open_, ids, most.max), starts)[group]
        high = np.maximum.reduceat(np.where(open_, ids, most.min), starts)[group]
        told = np.maximum.reduceat((at == SEVERAL).astype(np.int8), starts)[group] > 0
        one = np.minimum.reduceat(np.where(at >= 0, at, most.max), starts) == np.maximum.reduceat(np.where(at >= 0, at, most.min), starts)
        same = one[group] & ~told
        keep = ~open_ | ((at >= 0) & (told | (low < high)) & (~same | (ids > low)))
        return _rows(key[keep], ids[keep], np.where(open_, np.where(same, SAME, 0), at)[keep])

    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(3)]
        now = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        rest = [x[cut:] for x in now]
        if cut:
            yield judged(*(x[:cut] for x in now))
    if rest:
        yield judged(*rest)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs sorted by where they go, as ``_judged`` gives their rows. A range's rows are sorted at a time, or a part of its keys' where a
    range has more than SORTED rows; the rest stays packed meanwhile."""
    press, aside = zstandard.ZstdDecompressor(), []

    def rows(blobs: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        parts = -(-sum(map(zstandard.frame_content_size, blobs)) // (24 * SORTED))
        cuts = np.empty(0, np.int64)
        if parts > 1:
            some = np.sort(np.concatenate([_unpacked(press, x)[0][::64] for x in blobs]))
            cuts = np.unique(some[len(some) * np.arange(1, parts) // parts])
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            own = []
            for key, ids, at in (_unpacked(press, x) for x in blobs):
                a, b = 0 if low is None else np.searchsorted(key, low), len(key) if high is None else np.searchsorted(key, high)
                own.append((key[a:b], ids[a:b], at[a:b]))
            key, ids, at = map(np.concatenate, zip(*own, strict=True))
            del own
            done = at <= PASSED
            if done.any():
                aside.append(_rows(key[done], ids[done], at[done]))
                key, ids, at = key[~done], ids[~done], at[~done]
            order = np.argsort(key)
            yield _rows(key[order], ids[order], at[order])

    def ranges() -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for to, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if to != now and blobs:
                    yield from rows(blobs)
                    blobs = []
                now = to
                blobs.append(blob.as_buffer())
        if blobs:
            yield from rows(blobs)

    for batch in _judged(ranges()):
        yield batch
        yield from aside
        aside.clear()
    yield from aside


def _frequent(docs: DataFrame, window: int) -> np.ndarray:
    """Anchors that a share of documents hold, judged by a sample of them; at most as
    many as MOST_FREQUENT. They only say how windows are dealt out, not which are found."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at, row, _ in _pieces(batch, window):
                key = _anchors(data, window)[at]
                new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))
                pair = np.unique(np.stack((key[new].view(np.int64), row[new])), axis=1)
                key, n = np.unique(pair[0], return_counts=True)
                yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])
            yield pa.record_batch([pa.array([0], pa.int64()), pa.array([batch.num_rows], pa.int64())], names=["key", "n"])  # 0 stands for all

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    counts = sample.mapInArrow(held, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)
    top = counts.orderBy(F.col("n").desc(), "key").limit(MOST_FREQUENT).collect()
    total = next((r["n"] for r in top if r["key"] == 0), 0)
    return np.sort(np.array([r["key"] for r in top if r["key"] and r["n"] >= SHARE * total], np.int64).view(np.uint64))


_OUT = "key long, doc_id long, at long, n int, text binary"


def _out(key, doc, at, n, text) -> pa.RecordBatch:
    return pa.record_batch([pa.array(key), pa.array(doc), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int32)), text], names=["key", "doc_id", "at", "n", "text"])


def _packed(text: str) -> Column:
    """A text for its way. No Python makes it: Spark takes what Python made twice for different, and would move it twice."""
    return F.col(text)


def _settled(key: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, ids: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
    """Runs in the order of their texts that are known to be repeated, neighbours as one."""
    opens = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1])))
    n, row, start = np.add.reduceat(n, opens), row[opens], start[opens]
    return _out(key[opens].view(np.int64), ids[row], start | tag[row] << 32, n, pa.nulls(len(n), pa.binary()))


def _second_level(batches: Iterator[pa.RecordBatch], window: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of windows with a repeated anchor, with their bytes; of equal ones in a piece
    only the first document's, the others are settled and have none, nor have runs that are the SAME in a smaller document."""
    for batch in batches:
        ids, tag = batch.column(0).fill_null(0).to_numpy(), batch.column(3).to_numpy().astype(np.int64)
        held, offsets = flat_lists(batch.column(2))
        owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(offsets)) << BITS
        for data, at, row, start in _pieces(batch, window):
            a, b = offsets[row[0]], offsets[row[-1] + 1]
            if a == b:
                continue
            key = _anchors(data, window)[at]
            opens = _opens(key, at, row, start)
            n = np.diff(np.append(opens, len(key)))
            its, wanted, of = row[opens].astype(np.int64) << BITS | key[opens].view(np.int64), held[a:b], owner[a:b]
            settled = np.flatnonzero(np.isin(its, of[wanted < 0] | ~wanted[wanted < 0]))
            if len(settled):  # neighbours as one
                o = opens[settled]
                yield _settled(key[o], row[o], start[o], n[settled], ids, tag)
            hit = np.flatnonzero(np.repeat(np.isin(its, of[wanted >= 0] | wanted[wanted >= 0]), n))
            if not len(hit):
                continue
            key, at, row, start = key[hit], at[hit], row[hit], start[hit]
            alone = np.isin(key, frequent)
            if alone.any():
                key = key.copy()
                key[alone] = rolled(_CODE[data], window)[at[alone]] >> np.uint64(16)
            opens = _opens(key, at, row, start)
            within = np.arange(len(key)) - np.repeat(opens, np.diff(np.append(opens, len(key))))
            opens = np.flatnonzero(within % RUN == 0)
            n = np.diff(np.append(opens, len(key)))
            key, at, row, start = key[opens], at[opens], row[opens], start[opens]
            size = n + window - 1
            ends = np.cumsum(size)
            taken = data[np.arange(ends[-1]) + np.repeat(at - (ends - size), size)]
            text = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(taken)])
            code = text.dictionary_encode().indices.to_numpy()
            doc, place = ids[row], start | tag[row] << 32
            order = np.lexsort((place, doc, code))
            first = np.append(True, code[order][1:] != code[order][:-1])
            own = np.zeros(len(code), bool)
            own[order] = doc[order] == doc[order][first][np.cumsum(first) - 1]
            k = key.view(np.int64)
            yield _out(k[own], doc[own], place[own], n[own], text.filter(pa.array(own)))
            if not own.all():
                yield _settled(key[~own], row[~own], start[~own], n[~own], ids, tag)


_FOUND = "doc_id long, at long, n int"


def _found(doc, at, n) -> pa.RecordBatch:
    return pa.record_batch([pa.array(doc), pa.array(at), pa.array(n.astype(np.int32))], names=["doc_id", "at", "n"])


def _sorted_shards(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and bytes: runs of windows that also start in a smaller doc_id."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def judged(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, doc, at, n, text = rows.columns
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        key, doc, at, n = (c.to_numpy() for c in (key, doc, at, n))
        code = text.dictionary_encode()
        code, kinds = code.indices.to_numpy().astype(np.int64), code.dictionary
        order = np.lexsort((doc, code, key))
        k, c, d = key[order], code[order], doc[order]
        first = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
        group = np.cumsum(first) - 1
        least = d[first]
        later = d > least[group]
        if later.any():  # the same run of bytes stands in a smaller document
            yield _found(d[later], at[order][later], n[order][later])
        # keys of several kinds are sorted as one shard
        gk = k[first]
        many = np.isin(gk, gk[1:][gk[1:] == gk[:-1]])
        if not many.any():
            return
        chosen = np.flatnonzero(many)
        hit, start = repeats(kinds.take(pa.array(c[first][chosen])), least[chosen], window)
        if not len(hit):
            return
        new = np.append(True, (hit[1:] != hit[:-1]) | (start[1:] != start[:-1] + 1))
        run = np.flatnonzero(new)
        hit, start, length = chosen[hit[run]], start[run], np.diff(np.append(run, len(hit)))
        # the runs of a kind hold for each place where its first document has it
        own = np.flatnonzero(~later)
        lo, hi = np.searchsorted(group[own], hit), np.searchsorted(group[own], hit, side="right")
        times = hi - lo
        each = np.repeat(np.arange(len(hit)), times)
        place = own[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        yield _found(d[place], at[order][place] + start[each], length[each])

    def settled(rows: pa.RecordBatch) -> pa.RecordBatch:
        return _found(*(rows.column(i).to_numpy() for i in (1, 2, 3)))

    for batch in batches:
        open_ = batch.column(4).is_valid()
        if batch.column(4).null_count:
            yield settled(batch.filter(pa.compute.invert(open_)))
            batch = batch.filter(open_)
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.column(4).nbytes
        if size >= SHARD:
            key = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            if cut or len(waiting) > 1 and waiting[-2].column(0)[-1].as_py() != key[0]:
                yield from judged(_together([*waiting[:-1], batch.slice(0, cut)]))
                waiting = [batch.slice(cut)]
                size = waiting[0].column(4).nbytes
    if waiting:
        yield from judged(_together(waiting))


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def repeated_runs(docs: DataFrame, moved: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, tag and runs (array of at, n): n windows from byte ``at`` on also start in a smaller
    doc_id. ``docs`` has doc_id and text, ``moved`` the same rows dealt out by doc_id, as doc_id,
    packed (the text) and tag. Tags are as in operator 4.

    1. Of the anchors in each window the one with the least hash is tried, so equal windows
       try the same and only some places move, each with a digest of the run of windows that try it: anchors that
       two documents hold go on. Where all runs of an anchor are one string, as inside copies, that is settled: documents beyond the least lose it.
    2. Runs of neighbouring windows with such an anchor go, with their bytes, to where
       their anchor goes. Equal runs of a piece go once, whoever holds them. Windows of anchors that
       many documents hold (by a sample) go one by one, by their own hash, so no anchor gathers
       what differs around a passage.
    3. Equal runs are settled by their least doc_id. What differs is sorted as a suffix array
       with common prefixes, a shard of several keys at a time, and neighbours that share a window are
       compared by doc_id. Here bytes decide. In step 1 strings are the same if 40 bits of the anchor's hash and 48 of the string's are.
    """
    rows = "key long, doc_id long, at long"
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lows = _lows(RANGES * partitions, window)
    tried = docs.mapInArrow(lambda b: _dealt(_first_level(b, window), len(lows) + 1, lows), "to int, rows binary")
    met = tried.repartitionById(partitions, (F.col("to") / RANGES).cast("int")).sortWithinPartitions("to").mapInArrow(_met, rows)
    known = F.when(F.col("at") == SAME, F.bitwise_not("key")).otherwise(F.col("key"))
    anchors = met.groupBy("doc_id").agg(F.collect_list(known).alias("anchors")).withColumnRenamed("doc_id", "its_id")
    tag = _tag(F.col("text"))
    shared = docs.groupBy("doc_id").agg(F.min(tag).alias("low"), F.max(tag).alias("high")).where("low < high").select(F.col("doc_id").alias("shared_id"))
    # no inner join: it would filter ``moved``, and Spark would move the texts for it once more
    both = moved.join(anchors, moved["doc_id"] == anchors["its_id"], "left").join(shared, moved["doc_id"] == shared["shared_id"], "left")
    frequent = _frequent(docs, window)
    wanted = F.coalesce("anchors", F.array().cast("array<bigint>")).alias("anchors")
    asked = both.select("doc_id", "packed", wanted, F.when(F.col("shared_id").isNotNull(), F.col("tag")).otherwise(0).alias("tag"))
    runs = asked.mapInArrow(lambda b: _second_level(b, window, frequent), _OUT)
    runs = runs.repartition(F.when(F.col("text").isNotNull(), F.col("key")).otherwise(F.xxhash64("doc_id"))).sortWithinPartitions("key", "text")
    found = runs.mapInArrow(lambda b: _sorted_shards(b, window), _FOUND)
    place = F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"), "n")
    return found.groupBy("doc_id", F.shiftright("at", 32).cast("int").alias("tag")).agg(F.collect_list(place).alias("runs"))


_SPANS = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))


@F.arrow_udf(StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("removed", _SPANS), StructField("kept", BinaryType())]))
def _without(texts: pa.Array, runs: pa.Array, window: pa.Array) -> pa.Array:
    """What is left of texts without the bytes that windows cover."""
    data, bounds = text_bytes(texts)
    out = []
    for i, (r, w) in enumerate(zip(runs, window.to_pylist(), strict=True)):
        own = data[bounds[i] : bounds[i + 1]]
        if not r.is_valid or not len(r):
            out.append({"n_bytes": len(own), "n_removed": 0, "removed": [], "kept": own.tobytes()})
            continue
        at, n = (r.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
        order = np.argsort(at, kind="stable")
        a, b = at[order], np.maximum.accumulate((at + n + w - 1)[order])
        gap = np.flatnonzero(a[1:] > b[:-1])
        a, b = a[np.append(0, gap + 1)], b[np.append(gap, len(b) - 1)]
        gone = np.zeros(len(own) + 1, np.int8)
        gone[a] += 1
        gone[b] -= 1
        kept = own[np.cumsum(gone[:-1], dtype=np.int8) == 0]
        out.append({"n_bytes": len(own), "n_removed": int((b - a).sum()), "removed": [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], "kept": kept.tobytes()})
    spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", spans), ("kept", pa.binary())]))


def remove_repeated_bytes(documents: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Adds n_bytes, n_removed, removed (maximal stretches of bytes, end exclusive) and kept (binary): the
    UTF-8 bytes of the text that stay, one behind another; they need not be whole characters.

    A byte goes if a string of ``window`` bytes over it also starts in a document with a
    smaller doc_id; strings are judged on the texts as they come and never cross texts. Repeats
    within one document stay, and so do texts shorter than a window. Null texts are empty. Rows without a doc_id
    keep all and remove nothing. Rows that repeat a doc_id are texts of one document: each
    loses what stands in smaller doc_ids, none what stands in another of them. Other columns stay;
    those named like the new ones give way. An empty table gives an empty result. ``window`` is LEAST at least and 255 at most.
    """
    if not LEAST <= window <= 255:
        raise ValueError(f"a window of {window} bytes; {LEAST} to 255 can be sorted")
    new = ("n_bytes", "n_removed", "removed", "kept")
    documents = documents.drop(*new)
    id_c, tag_c, runs_c, out_c = (fresh(documents, c) for c in ("its_id", "tag", "runs", "out"))
    moved = documents.repartition("doc_id")  # texts move once: both joins read what this wrote
    found = repeated_runs(only(documents), moved.select("doc_id", _packed("text").alias("packed"), _tag(F.col("text")).alias("tag")), window=window)
    found = found.select(F.col("doc_id").alias(id_c), F.col("tag").alias(tag_c), F.col("runs").alias(runs_c))
    same = (moved["doc_id"] == found[id_c]) & ((found[tag_c] == 0) | (found[tag_c] == _tag(moved["text"])))
    out = moved.join(found, same, "left").withColumn(out_c, _without(moved["text"], F.col(runs_c), F.lit(window)))
    return out.select(*documents.columns, *(_field(out_c, c) for c in new))


def _field(column: str, name: str) -> Column:
    return F.col(f"{column}.{name}").alias(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(only(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, q, substr(x, 1000 * q + 1, 1098) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 1000 + 1)) AS q FROM d)),
s AS (SELECT doc_id, 500 * q + j AS i, substr(y, 2 * j - 1, 100) AS w FROM (SELECT *, unnest(range(1, len(y) // 2 - 48)) AS j FROM c)),
h AS (SELECT w, min(doc_id) AS first FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
f AS (SELECT doc_id, i FROM s JOIN h ON s.w = h.w WHERE first < doc_id),
o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM f),
g AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) GROUP BY doc_id, run),
r AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, n_removed, n_spans, substr(x, 1, 2 * starts[1] - 2) || array_to_string(list_transform(range(1, len(starts) + 1), lambda j: substr(x, 2 * ends[j] - 1, 2 * (coalesce(starts[j + 1], len(x) // 2 + 1) - ends[j]))), '') AS kept FROM d JOIN r ON d.doc_id = r.doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
QUERIES, ORACLES = {"op12_suffix_dedup": query}, {"op12_suffix_dedup": SQL}
