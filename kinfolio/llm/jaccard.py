"""N-gram Jaccard join: rare-first prefixes, filters, one verification a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.lineage import cut
from .common import by_row_and, fresh, mixed, only, rolled, slices, table, text_bytes, word_hashes

#: Bytes of text that a worker handles at once, but for one text's.
CHUNK = 1 << 21
#: Width of the table of frequencies, which bounds it: a byte each.
SKETCH = 1 << 20
#: From this logarithm of its count on, an n-gram is known to be shared and is dealt out by set as well.
HOT = 10
#: Sets of a bucket of which all pairs are tried at once; of a larger one, sets that
#: all others are compared with first, and rows of a block in which all pairs are.
SMALL, PIVOTS, BLOCK = 8, 4, 1024
#: Partners whose texts are compared with one pivot's in one go.
PARTNERS = 128
#: 64-bit words of the table that tells which texts are asked for, which bounds it.
ASKED = 1 << 20
_BITS = [f"bits{i}" for i in range(4)]


def _sets(texts: pa.Array, k: int) -> Iterator[tuple]:
    """Of some rows at a time: rows from a to b, their sets' n-grams (sorted
    hashes, one set after the other), the row of each and the sizes. A to Z are
    lower-cased, and no other letters."""
    for a, b in slices(np.diff(text_bytes(texts)[1]), CHUNK):
        x, offsets = word_hashes(texts.slice(a, b - a), fold=True)
        n, begin = np.diff(offsets), offsets[:-1]
        tokens, rows = [], []
        if len(x) >= k:
            row = np.repeat(np.arange(b - a), n)[: len(x) - k + 1]
            inside = np.arange(len(row)) + k <= (begin + n)[row]
            tokens.append(rolled(x, k)[inside])
            rows.append(row[inside])
        for r in np.flatnonzero((n > 0) & (n < k)).tolist():  # too short: all words are one n-gram
            tokens.append(rolled(x[begin[r] : begin[r] + n[r]], int(n[r])) ^ np.uint64(n[r]))
            rows.append(np.array([r]))
        if tokens:
            token, row = np.concatenate(tokens), np.concatenate(rows)
            if len(tokens) > 1:
                order = np.argsort(row, kind="stable")
                token, row = token[order], row[order]
            order = by_row_and(token, row)
            token, row = token[order], row[order]
            new = np.append(True, (token[1:] != token[:-1]) | (row[1:] != row[:-1]))
            token, row = token[new], row[new]
        else:
            token, row = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield a, b, token, row, np.bincount(row, minlength=b - a)


def _names(token: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; that of the empty set is 0."""
    name = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        with np.errstate(over="ignore"):
            name[full] = mixed(np.add.reduceat(mixed(token ^ np.uint64(0x5851F42D4C957F2D)), np.searchsorted(row, full)) + size[full].astype(np.uint64))
    return name.view(np.int64)


def _parity(token: np.ndarray, row: np.ndarray, size: np.ndarray) -> pa.Array:
    """Of each set whether an odd number of its n-grams falls on each of 64 bits or
    more, the next power of two above its size."""
    width = 64 << np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(width)))
    bit = ((token >> np.uint64(16)) & (width - 1).astype(np.uint64)[row]).astype(np.int64)
    odd = (np.bincount(begin[row] + bit, minlength=begin[-1]) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((begin // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd, bitorder="little"))])


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each document: its set's name, size and parity bitmaps, one of 256
    bits and one that grows with the set; and for n-grams that several sets of a chunk
    hold, their places in the table of frequencies and counts (kind 1)."""
    names = ["kind", "id", "text_hash", "name", "size", "parity", *_BITS]
    for batch in batches:
        for a, b, token, row, size in _sets(batch.column(2), k):
            name = _names(token, row, size)
            bit = (token >> np.uint64(56)).astype(np.int64)
            odd = (np.bincount(row * 256 + bit, minlength=256 * (b - a)) & 1).astype(np.uint8).reshape(-1, 256)
            bits = np.packbits(odd, axis=1).view(np.int64)
            yield pa.record_batch([pa.array(np.zeros(b - a, np.int8)), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(name), pa.array(size), _parity(token, row, size), *(pa.array(bits[:, i].copy()) for i in range(4))], names=names)
            _, once = np.unique(name, return_index=True)  # copies count once
            mask = np.zeros(b - a, bool)
            mask[once] = True
            shared, count = np.unique(token[mask[row]], return_counts=True)
            shared, count = shared[count > 1], count[count > 1]
            if len(shared):
                place = (mixed(shared) & np.uint64(SKETCH - 1)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                place, count = place[order], count[order]
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                nulls = pa.nulls(len(first), pa.int64())
                yield pa.record_batch([pa.array(np.ones(len(first), np.int8)), pa.array(place[first]), nulls, nulls, pa.array(np.maximum.reduceat(count, first)), pa.nulls(len(first), pa.binary()), nulls, nulls, nulls, nulls], names=names)


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, percent: int, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rarest n-grams of each set, as many as a partner must share one of."""
    for batch in batches:
        for _, _, token, row, size in _sets(batch.column(0), k):
            name = _names(token, row, size)
            _, once = np.unique(name, return_index=True)
            mask = np.zeros(len(size), bool)
            mask[once] = True
            mask &= size > 0
            keep = mask[row]
            token, row = token[keep], row[keep]
            if not len(token):
                continue
            freq = often[(mixed(token) & np.uint64(SKETCH - 1)).astype(np.int64)]
            order = np.argsort(row * 64 + freq, kind="stable")  # tokens rise within a row already
            token, freq = token[order], freq[order]
            start = np.searchsorted(row, np.arange(len(size)))
            pos = np.arange(len(row)) - start[row]
            head = pos < (size - (percent * size + 99) // 100 + 1)[row]
            r = row[head]
            yield pa.record_batch([pa.array(token[head].view(np.int64)), pa.array(name[r]), pa.array(size[r].astype(np.int32)), pa.array(pos[head].astype(np.int32)), pa.array(freq[head] >= HOT)], names=["token", "name", "size", "pos", "hot"])


_BUCKETED = "token long, a long, b long, size int, pos int"


def _buckets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token and name: of buckets of 2 to SMALL sets all pairs
    that pass the length and positional filters (a, b); of larger ones, and of
    those that are dealt out, each set once (token, a, size, pos). What is
    carried from batch to batch is one bucket of SMALL sets at most."""
    none = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool)]
    held, large, last = none, None, None  # rows of a bucket that goes on; the token of one that is large, and the last name out of it

    def settled(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, name, size, pos, hot = rows
        if not len(token):
            return
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        n = np.diff(np.append(first, len(token)))
        lefts, rights = [], []
        for width in range(2, SMALL + 1):
            at = first[(n == width) & ~hot[first]]
            for i in range(width - 1):
                for j in range(i + 1, width):
                    if len(at):
                        x, y = at + i, at + j
                        s, t = size[x].astype(np.int64), size[y].astype(np.int64)
                        need = -(-percent * (s + t) // (100 + percent))
                        ok = (100 * np.minimum(s, t) >= percent * np.maximum(s, t)) & (np.minimum(s - pos[x], t - pos[y]) >= need)
                        lefts.append(name[x][ok])
                        rights.append(name[y][ok])
        if lefts:
            both = np.unique(np.column_stack((np.concatenate(lefts), np.concatenate(rights))), axis=0)
            nulls = pa.nulls(len(both))
            yield pa.record_batch([nulls.cast(pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), nulls.cast(pa.int32()), nulls.cast(pa.int32())], names=["token", "a", "b", "size", "pos"])
        yield from spread([c[np.repeat((n > SMALL) | hot[first], n)] for c in rows])

    def spread(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(rows[0]):
            yield pa.record_batch([pa.array(rows[0]), pa.array(rows[1]), pa.nulls(len(rows[0]), pa.int64()), pa.array(rows[2]), pa.array(rows[3])], names=["token", "a", "b", "size", "pos"])

    for batch in batches:
        rows = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
        new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) if len(rows[0]) else np.empty(0, bool)
        rows = [c[new] for c in rows]
        if large is not None and len(rows[0]):  # the bucket that was large goes on
            end = int(np.searchsorted(rows[0], large, side="right"))
            go_on = [c[:end] for c in rows]
            if end and go_on[1][0] == last:
                go_on = [c[1:] for c in go_on]
            if len(go_on[0]):
                last = go_on[1][-1]
            yield from spread(go_on)
            if end == len(rows[0]):
                held = none
                continue
            rows, large = [c[end:] for c in rows], None
        if not len(rows[0]):
            held = none
            continue
        at = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from settled([c[:at] for c in rows])
        held = [c[at:] for c in rows]
        if len(held[0]) > SMALL:
            large, last = held[0][-1], held[1][-1]
            yield from spread(held)
            held = none
    yield from settled(held)


def _passes(a: str, b: str, percent: int) -> Column:
    """Length, positional and suffix filter of two rows. With the overlap that
    similarity needs, what is left after the shared n-gram must suffice; and the
    sets can differ in no more n-grams than their parity bitmaps do in bits."""
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    need = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - F.lit(1e-9))
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _BITS), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos")) >= need) & (apart <= n + m - 2 * need)


def _crossing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of sets with different labels that pass the filters, from rows
    sorted by group (token and two blocks). A group has 2 * BLOCK rows, more or less."""
    rest: pa.Table | None = None

    def pairs(t: pa.RecordBatch) -> pa.RecordBatch:
        g0, g1, g2 = (t.column(i).to_numpy() for i in range(3))
        name, size, pos, label, side = (t.column(i).to_numpy() for i in range(3, 8))
        bits = np.column_stack([t.column(i).to_numpy() for i in range(8, 12)]).view(np.uint64)
        starts = np.flatnonzero(np.append(True, (g0[1:] != g0[:-1]) | (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])))
        left, right = [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(name)], strict=True):
            one = g1[s] == g2[s]
            if (label[s:e] == label[s]).all():
                continue
            for i in range(s, e - 1):
                j = np.arange(i + 1, e)
                j = j[label[j] != label[i]] if one else j[(label[j] != label[i]) & (side[j] != side[i])]
                if not len(j):
                    continue
                a, b = int(size[i]), size[j].astype(np.int64)
                need = -(-percent * (a + b) // (100 + percent))
                ok = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (np.minimum(a - pos[i], b - pos[j]) >= need)
                j, b, need = j[ok], b[ok], need[ok]
                if len(j):
                    j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= a + b - 2 * need]
                    left.append(np.minimum(name[j], name[i]))
                    right.append(np.maximum(name[j], name[i]))
        cat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right)]
        both = np.unique(np.column_stack(cat), axis=0)
        return pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]).combine_chunks() if rest is not None else now
        if not now.num_rows:
            continue
        g = [now.column(i).to_numpy() for i in range(3)]
        end = np.flatnonzero((g[0] != g[0][-1]) | (g[1] != g[1][-1]) | (g[2] != g[2][-1]))
        cut_at = int(end[-1]) + 1 if len(end) else 0
        rest = now.slice(cut_at)
        if cut_at:
            yield pairs(now.slice(0, cut_at).combine_chunks().to_batches()[0])
    if rest is not None and rest.num_rows:
        yield pairs(rest.combine_chunks().to_batches()[0])


def _verified(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The links among pairs, from rows sorted by pivot, part and whether the
    row is a partner: pivot, name (that the row's set must have), partner, text."""
    open_, held = None, np.empty(0, np.uint64)  # pivot, and its set once it is known
    for batch in batches:
        pivot, name, partner = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        links = []
        for lo, hi, token, row, size in _sets(batch.column(3), k):
            found, ends = _names(token, row, size), np.concatenate(([0], np.cumsum(size)))
            for r in np.flatnonzero(found == name[lo:hi]).tolist():
                own = token[ends[r] : ends[r + 1]]
                if not partner[lo + r]:
                    open_, held = pivot[lo + r], own
                elif open_ == pivot[lo + r]:
                    at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                    both = int((held[at] == own).sum())
                    if 100 * both >= percent * (len(own) + len(held) - both):
                        links.append((open_, name[lo + r]))
        if links:
            yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text. A row's key is its id and the hash of its text."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def similar(documents: DataFrame, *, shingle: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every document.

    A document's set holds its distinct n-grams of ``shingle`` words, with A to Z
    lower-cased; fewer words are one n-gram; without words the set is empty and
    linked with nothing. Two sets link when 100 * shared >= percent * all.
    class_id is the least doc_id with the same set, component_id the least that
    links reach. Every link between different sets either is verified or joins
    two sets that verified links already join.

    1. Sets are named; equal sets are one from here on. N-grams that several
       sets of a chunk of words share are counted in a table of fixed width.
    2. N-grams are ordered by that table, rare ones first, then by hash. Each
       set moves its first size - ceil(percent * size / 100) + 1; sets that link
       share one of these. Buckets of one set are dropped. In those of up to
       SMALL sets all pairs pass the length and positional filters.
    3. In larger buckets the PIVOTS sets with the fewest rarer n-grams are paired
       with all others; they differ from bucket to bucket, so a group of near copies
       is compared with many of its members, and not with all. Pairs of both kinds
       are made distinct, pass the filter by bitmaps and are verified on the whole
       texts: a pivot's text meets PARTNERS partners in one go.
    4. Components of these links. Pairs of each larger bucket whose components
       differ and that pass the filters are verified next: large groups of near
       copies are one component by now, so few are left. Buckets are cut into blocks
       of BLOCK rows, and pairs of blocks are dealt out, so none meets in one task.

    Null texts have no words. Rows that repeat an id are rows of the result each;
    component_id ignores null ids (it is null only for an empty set without id or
    where no id is reached). An empty table gives an empty result. Hashes have 64 bits.
    """
    docs = only(documents)
    schema = "kind byte, id long, text_hash long, name long, size long, parity binary, " + ", ".join(f"{c} long" for c in _BITS)
    described = cut(_keyed(docs).mapInArrow(lambda b: _describe(b, shingle), schema), "jaccard-sets")
    often = np.zeros(SKETCH, np.uint8)
    counts = described.where("kind = 1").groupBy("id").agg(F.sum("size").alias("n")).toArrow()  # SKETCH rows at most
    often[counts.column("id").to_numpy()] = np.ceil(np.log2(counts.column("n").to_numpy())).astype(np.uint8)
    sets = described.where("kind = 0").select(F.col("id").alias("doc_id"), "text_hash", "name", "size", "parity", *_BITS)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = sets.where("size > 0").groupBy("name").agg(F.min(place).alias("first"), *(F.first(c).alias(c) for c in ("size", "parity", *_BITS)))
    classes = cut(classes.select("name", F.col("first.doc_id").alias("class_id"), F.col("first.text_hash").alias("text_hash"), F.col("size").cast("int"), "parity", *_BITS), "jaccard-classes")

    rows = docs.select("text").mapInArrow(lambda b: _prefixes(b, shingle, percent, often), "token long, name long, size int, pos int, hot boolean")
    rows = rows.repartition("token", F.when(F.col("hot"), F.col("name"))).sortWithinPartitions("token", "name")
    buckets = cut(rows.mapInArrow(lambda b: _buckets(b, percent), _BUCKETED), "jaccard-buckets")

    wide = buckets.where("token is not null").select("token", F.col("a").alias("name"), "pos")
    wide = cut(wide.join(classes.select("name", "size", *_BITS), "name"), "jaccard-wide")
    first = Window.partitionBy("token").orderBy("pos", "size", "name")
    pivots = wide.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PIVOTS).drop("nth")
    x, p = wide.alias("x"), pivots.alias("p")
    pairs = x.join(p, F.col("x.token") == F.col("p.token")).where((F.struct("x.pos", "x.size", "x.name") > F.struct("p.pos", "p.size", "p.name")) & _passes("x", "p", percent)).select(F.least("p.name", "x.name").alias("a"), F.greatest("p.name", "x.name").alias("b"))
    pairs = buckets.where("b is not null").select("a", "b").unionByName(pairs).distinct()
    pairs = cut(_alike(pairs, classes, percent), "jaccard-pairs")
    links = _verify(docs, classes, pairs, shingle, percent)

    labels = connected_components(links)
    named = wide.join(labels.withColumnRenamed("node", "name"), "name", "left").withColumn("label", F.coalesce("component", "name")).drop("component")
    named = cut(named, "jaccard-labelled")
    open_ = named.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    open_ = open_.select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = named.join(open_, "token").withColumn("own", F.pmod(F.xxhash64(F.lit(9), "name"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("token", F.least("own", "other").alias("g1"), F.greatest("own", "other").alias("g2"), "name", "size", "pos", "label", F.col("own").alias("side"), *_BITS)
    blocks = blocks.repartition("token", "g1", "g2").sortWithinPartitions("token", "g1", "g2")
    rest = blocks.mapInArrow(lambda b: _crossing(b, percent), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    rest = cut(_alike(rest, classes, percent), "jaccard-rest")
    if rest.count():
        more = _verify(docs, classes, rest, shingle, percent)
        if more.count():
            links = links.unionByName(more)
            labels = connected_components(links)

    names = classes.select("name", "class_id").join(labels.withColumnRenamed("node", "name"), "name", "left").select("name", "class_id", F.coalesce("component", "name").alias("component"))
    names = cut(names, "jaccard-labels")
    found = names.groupBy("component").agg(F.min("class_id").alias("component_id"))
    names = names.join(found, "component").select(F.col("name").alias("its"), "class_id", "component_id")
    out = sets.join(names, F.col("name") == F.col("its"), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the suffix filter: the sets can differ in no fewer n-grams
    than their parity bitmaps do in bits, and in no more than similarity allows."""
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("name").alias(end), F.col("size").alias(f"n{end}"), F.col("parity").alias(f"p{end}")), end)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
                most = total - 2 * -(-percent * total // (100 + percent))
                apart = np.array([_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
                yield batch.select([0, 1]).filter(pa.array(apart <= most))

    return pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(near, "a long, b long")


def _apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the wider one folded."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose whole texts link. Texts that no pair asks for are left
    where they are, but for those that share a bit with one in a table of
    ASKED words (beyond some 50 million texts asked for, most would); the others
    move once, and then once for each pair, and for every PARTNERS pairs their pivot."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    key = lambda doc_id: F.xxhash64(F.coalesce(doc_id, F.lit(0)), "text_hash")
    of = classes.select("name", key("class_id").alias("h"), "text_hash")
    ends = dealt.select(F.col("a").alias("pivot"), "part", F.lit(True).alias("partner"), F.col("b").alias("name"))
    ends = ends.unionByName(dealt.select(F.col("a").alias("pivot"), "part", F.lit(False).alias("partner"), F.col("a").alias("name")).distinct())
    ends = cut(ends.join(of, "name"), "jaccard-ends")

    word = F.shiftrightunsigned("h", 64 - ASKED.bit_length() + 1)
    asked = ends.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63))")).alias("mask"))
    keyed = _keyed(docs).withColumn("h", key("doc_id")).withColumn("word", word)
    keyed = keyed.join(F.broadcast(asked), "word").where("shiftrightunsigned(mask, int(h & 63)) & 1 = 1")
    texts = keyed.groupBy("h", "text_hash").agg(F.first("text").alias("text"))
    rows = ends.join(texts, ["h", "text_hash"])
    rows = rows.select("pivot", "name", "partner", "text", "part").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "partner")
    return cut(rows.drop("part").mapInArrow(lambda b: _verified(b, shingle, percent), "a long, b long"), "jaccard-links")


def stage(documents: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that with the least doc_id (null last), then
    the least hash of its text, then the first; rows without words stay. Ids can
    repeat or be null: rows are numbered and compared as such. Columns as they were."""
    row = fresh(documents, "row")
    rows = cut(documents.withColumn(row, F.monotonically_increasing_id()), "jaccard-stage")
    s = similar(rows.select(F.col(row).alias("doc_id"), "text"), shingle=shingle, percent=percent).where("n_shingles > 0")
    s = cut(s.select(F.col("doc_id").alias(row), "component_id"), "jaccard-components")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), row)
    placed = rows.select(row, place.alias("place")).join(s, row)
    firsts = placed.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col(f"first.{row}").alias(row))
    return rows.join(s.select(row).join(firsts, row, "left_anti"), row, "left_anti").select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS MATERIALIZED (
  SELECT doc_id, hash(g) AS g FROM (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS node, x AS reach FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.lowest, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT node, min(reach) AS lowest FROM r GROUP BY node) m ON m.node = d.doc_id
"""
QUERIES, ORACLES = {"op8_jaccard_join": query}, {"op8_jaccard_join": SQL}
