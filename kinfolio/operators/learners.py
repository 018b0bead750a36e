"""Sparse pairwise preference learners: TF-IDF of two responses, logistic on the difference.

For the difference table terms are rows, so counts, weights and lengths are grouped sums and no Python
runs. The models count and encode terms by Arrow batches and pass over what is encoded.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import logistic
from ..plans.lineage import cut


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) > 1)


def word_terms(text: Column) -> Column:
    """Words of two or more word characters, lower-cased, and pairs of neighbours."""
    w = _words(text)
    fewer = F.greatest(F.size(w) - 1, F.lit(0))
    return F.concat(w, F.zip_with(F.slice(w, 1, fewer), F.slice(w, 2, fewer), lambda a, b: F.concat_ws(" ", a, b)))


def _characters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", " ")


#: Lengths of runs of characters.
LOW, HIGH = 3, 5


def char_terms(text: Column, low: int = LOW, high: int = HIGH) -> Column:
    """Runs of ``low`` to ``high`` characters, lower-cased, white space as one space. A text is cut into its characters
    once: a substring would be looked for from the text's start, and a long text would take its length squared."""

    def of(c: Column, n: int) -> Column:
        return F.transform(c, lambda x, i: F.concat(x, *(F.get(c, i + k) for k in range(1, n))))  # null where the text ends before

    # in an array of one, so that the characters are made once and not for each run
    characters = F.array_remove(F.split(_characters(text), ""), "")
    return F.flatten(F.transform(F.array(characters), lambda c: F.array_compact(F.concat(*(of(c, n) for n in range(low, high + 1))))))


#: Characters whose terms a task counts, and counted terms that it weighs, about.
TASK_CHARACTERS, TASK_TERMS = 1_000_000, 1_000_000
#: Characters, or encoded terms, that are worked on at a time, about.
SLICE = 1_000_000
#: Encoded terms up to which the driver passes over them itself, and bytes of sums that come to it at once.
HERE_TERMS, SUM_BYTES = 2_000_000, 256_000_000


def _tasks(spark: SparkSession, n: int, each: int) -> int:
    """Tasks for ``n``: their number grows with the input, not what each holds."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / each))


#: The surveyed models: terms, C, most features.
MODELS = {"word": (word_terms, 0.3, 120_000), "char": (char_terms, 1.0, 160_000)}


def term_counts(pairs: DataFrame, terms, *keep: str) -> DataFrame:
    """pair_id, side (-1 for response1, 1 for response2), term, n and what is to ``keep`` of pairs. Pairs are dealt out
    once, by how long their texts are; all that follows by pair stays where it is."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("text")) for s, c in ((-1, "response1"), (1, "response2"))))
    each = pairs.select("pair_id", *keep, F.inline(sides))
    characters = each.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    each = each.repartition(_tasks(pairs.sparkSession, characters, TASK_CHARACTERS), "pair_id")
    return each.select("pair_id", "side", *keep, F.explode(terms(F.col("text"))).alias("term")).groupBy("pair_id", "side", "term", *keep).agg(F.count("*").alias("n"))


def _most(document_counts: DataFrame, documents: int, least_documents: int, most_features: int) -> DataFrame:
    most = document_counts.where(F.col("df") >= least_documents).orderBy(F.col("total").desc(), "term").limit(most_features)
    return most.select("term", (F.log((F.lit(documents) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def vocabulary(document_counts: DataFrame, documents: int, *, least_documents: int, most_features: int) -> DataFrame:
    """term, at and idf of the terms that ``least_documents`` hold, at most ``most_features`` of
    them: the most frequent, of equal ones the smaller. ``document_counts`` has term, df
    and total. idf is ln((1 + documents) / (1 + df)) + 1."""
    at = F.row_number().over(Window.orderBy("term")) - 1  # most_features rows at most
    return _most(document_counts, documents, least_documents, most_features).select("term", at.alias("at"), "idf")


def differences(counts: DataFrame, vocabulary: DataFrame, *, dealt: bool = False) -> DataFrame:
    """pair_id, at, term and value: the vector of response2 less that of response1. A term weighs (1 + ln n) times its
    idf, and each response's weights have length 1. The vocabulary has a bound, so it is sent along. Counts that come straight from
    ``term_counts`` are ``dealt`` out by pair: they are made where they are used, and no term moves."""
    if not dealt:
        counts = counts.repartition(_tasks(counts.sparkSession, counts.count(), TASK_TERMS), "pair_id")
    w = counts.join(F.broadcast(vocabulary), "term").withColumn("w", (1 + F.log(F.col("n").cast("double"))) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("pair_id", "side")))
    return w.withColumn("w", F.col("side") * F.col("w") / length).groupBy("pair_id", "at", "term").agg(F.sum("w").alias("value"))


def _sequences(text: Column, terms) -> Column:
    """What ``_terms`` cuts a text's terms from: its words or characters for the models here, and other terms themselves."""
    return _words(text) if terms is word_terms else _characters(text) if terms is char_terms else terms(text)


def _dense(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys numbered from 0 without gaps, and for each number a place in ``at`` where its key stands."""
    most = int(key.max()) + 1 if len(key) else 0
    if most > 4 * SLICE:
        _, first, ids = np.unique(key, return_index=True, return_inverse=True)
        return ids, at[first]
    first = np.full(most, -1, np.int64)
    first[key] = at
    there = first >= 0
    return (np.cumsum(there) - 1)[key], first[there]


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``_terms`` of texts: their runs of LOW to HIGH characters. A run is the number of the run one shorter and its last character, so
    no string is made but one for each different run."""
    lengths, whole = np.array([len(t) for t in texts], np.int64), "".join(texts)
    at, rows = np.arange(len(whole)), np.repeat(np.arange(len(texts)), lengths)
    behind = np.cumsum(lengths)[rows] - at  # characters from here to the text's end
    symbols, _ = _dense(np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.int64), at)
    ids, out_rows, out_ids, names = symbols, [], [], []
    for n in range(2, HIGH + 1):
        there = behind[at] >= n
        at = at[there]
        ids, first = _dense(ids[there] * (int(symbols.max(initial=0)) + 1) + symbols[at + n - 1], at)
        if n >= LOW:
            out_rows.append(rows[at])
            out_ids.append(ids + len(names))
            names += [whole[i : i + n] for i in first.tolist()]
    return np.concatenate(out_rows), np.concatenate(out_ids), names


def _terms(sequences: pa.Array, terms) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The row and the number of each term in ``sequences``, and the numbered terms."""
    if terms is char_terms:
        return _runs(sequences.to_pylist())
    lengths = pc.fill_null(pc.list_value_length(sequences), 0).to_numpy().astype(np.int64)
    coded = sequences.flatten().dictionary_encode()
    symbols, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    rows = np.repeat(np.arange(len(lengths)), lengths)
    if terms is not word_terms or not len(symbols):
        return rows, symbols, names
    pairs = np.flatnonzero(rows[1:] == rows[:-1])
    ids, first = _dense(symbols[pairs] * len(names) + symbols[pairs + 1], pairs)
    both = [f"{names[i]} {names[j]}" for i, j in zip(symbols[first].tolist(), symbols[first + 1].tolist(), strict=True)]
    return np.concatenate([rows, rows[pairs]]), np.concatenate([symbols, ids + len(names)]), names + both


def _slices(batch: pa.RecordBatch):
    """Parts of a batch with SLICE characters each, about; a row at least."""
    ends = np.cumsum(batch.column("characters").to_numpy())
    cuts = np.unique(np.searchsorted(ends, np.arange(SLICE, (ends[-1] if len(ends) else 0) + SLICE, SLICE), "right").clip(1, len(ends))) if len(ends) else []
    start = 0
    for cut_at in [*cuts, len(ends)]:
        if cut_at > start:
            yield batch.slice(start, cut_at - start)
        start = max(start, int(cut_at))


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """Bytes of rows of equal length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _sides(batch: pa.RecordBatch, terms) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``_terms`` of both responses; rows are 2 * pair + (1 for response2)."""
    rows, ids, names = _terms(pa.concat_arrays([batch.column("first"), batch.column("second")]), terms)
    return 2 * (rows % batch.num_rows) + rows // batch.num_rows, ids, names


def _frequencies(pairs: DataFrame, terms, fits: int) -> DataFrame:
    """term and for each fit df and total (df0, total0, ...). Terms are counted where their pair is; what goes out is a row a
    different term of some SLICE characters."""
    names = [f"{k}{i}" for i in range(fits) for k in ("df", "total")]

    def count(batches):
        for batch in batches:
            for part in _slices(batch):
                rows, ids, strings = _sides(part, terms)
                member = _matrix(part.column("member"), "<i4", fits)
                key, n = np.unique(rows * max(1, len(strings)) + ids, return_counts=True)
                row, ids = key // max(1, len(strings)) // 2, key % max(1, len(strings))
                sums = [np.bincount(ids, weights=w, minlength=len(strings)).astype(np.int64) for i in range(fits) for w in (member[row, i], member[row, i] * n)]
                yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), *map(pa.array, sums)], ["term", *names])

    counted = pairs.select("first", "second", "characters", "member").mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in names))
    return counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in names))


def _spread(pairs: DataFrame, terms) -> DataFrame:
    """``pairs`` with the sequences of both responses, written once and dealt out by how long their texts are."""
    text = lambda c: F.coalesce(c, F.lit(""))
    p = pairs.withColumn("characters", (F.length(text("response1")) + F.length(text("response2"))).cast("long"))
    total = p.agg(F.sum("characters")).first()[0] or 0
    p = p.repartition(_tasks(pairs.sparkSession, total, TASK_CHARACTERS), "pair_id")
    kept = [c for c in p.columns if c not in ("response1", "response2")]
    return p.select(*kept, *(_sequences(text(c), terms).alias(k) for c, k in (("response1", "first"), ("response2", "second"))))


def _encoded(pairs: DataFrame, terms, vocabulary: list[str], idf: np.ndarray) -> DataFrame:
    """A row a pair: pair_id, label, member, the places of its terms in ``vocabulary`` (int32) with how often they stand (int32), response1's
    first, of which there are ``left``, and for each fit and side one by the length of the side's weights. Weights of all fits follow
    from these, so a pair's terms are found once, however many fits there are."""
    shared = pairs.sparkSession.sparkContext.broadcast((vocabulary, idf))

    def encode(batches):
        strings, idf = shared.value
        known = pa.array(strings, pa.string())
        for batch in batches:
            for part in _slices(batch):
                rows, ids, names = _sides(part, terms)
                at = pc.fill_null(pc.index_in(pa.array(names, pa.string()), value_set=known), -1).to_numpy().astype(np.int64)[ids] if names else ids
                key, n = np.unique((rows * max(1, len(known)) + at)[at >= 0], return_counts=True)
                side, at, n = key // max(1, len(known)), (key % max(1, len(known))).astype("<i4"), n.astype("<i4")
                ends = np.searchsorted(side, np.arange(2 * part.num_rows + 1))
                b = 1 + np.log(n)
                squares = np.stack([np.bincount(side, weights=(b * w[at]) ** 2, minlength=2 * part.num_rows) for w in idf], 1).astype(float)  # whole numbers where nothing is counted
                scale = np.divide(1, np.sqrt(squares), out=np.zeros_like(squares), where=squares > 0).reshape(part.num_rows, -1)
                cells = lambda v, e: [v[i:j].tobytes() for i, j in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)]
                columns = [part.column("pair_id"), part.column("label"), part.column("member"), *(pa.array(cells(v, ends[::2]), pa.binary()) for v in (at, n)), pa.array((ends[1::2] - ends[:-1:2]).astype(np.int32)), pa.array([r.tobytes() for r in scale], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["pair_id", "label", "member", "at", "n", "left", "scale"])

    id_type = pairs.schema["pair_id"].dataType.simpleString()
    read = pairs.select("pair_id", "label", "member", "first", "second", "characters")
    return read.mapInArrow(encode, f"pair_id {id_type}, label double, member binary, at binary, n binary, left int, scale binary")


#: 1 + ln n of small n.
_LOG = 1 + np.log(np.arange(1, 4097))


def _parts(batch: pa.RecordBatch, fits: int):
    """Parts of some SLICE terms of an encoded batch: where they start and end, terms' places and 1 + ln n, ends of sides, and scale (pairs, fits, sides)."""
    ends = np.cumsum(pc.binary_length(batch.column("at")).to_numpy().astype(np.int64)) // 4
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
        part = batch.slice(start, stop - start)
        at, n = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<i4") for c in ("at", "n"))
        b = _LOG[np.minimum(n, len(_LOG)) - 1]
        often = n > len(_LOG)
        b[often] = 1 + np.log(n[often])
        own = np.diff(ends[start:stop], prepend=ends[start - 1] if start else 0)
        left = part.column("left").to_numpy()
        sides = np.stack([left, own - left], 1).ravel()
        yield part, at, b, sides, _matrix(part.column("scale"), "<f8", 2 * fits).reshape(-1, 2, fits)
        start = stop


def _margins(at: np.ndarray, b: np.ndarray, sides: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums of pairs: of response2 less that of response1. ``scale`` is (pairs, sides)."""
    whole = np.concatenate([[0], np.cumsum(sides)])
    sums, some = np.zeros(len(sides)), sides > 0
    if len(at):
        sums[some] = np.add.reduceat(b * weights[at], whole[:-1][some])
    sums = sums.reshape(-1, 2) * scale
    return sums[:, 1] - sums[:, 0]


def _sums(batches, fits: int, asked: list[tuple[int, np.ndarray, float]], size: int, squares: bool) -> list[tuple[float, float, np.ndarray]]:
    """For each fit that is ``asked`` with weights (times idf) and a constant: the loss, its derivative by the constant and by the weighted terms, or with
    ``squares`` the number of pairs and the sums of squares instead."""
    out = [[0.0, 0.0, np.zeros(size)] for _ in asked]
    for batch in batches:
        for part, at, b, sides, scale in _parts(batch, fits):
            member, label = _matrix(part.column("member"), "<i4", fits), part.column("label").to_numpy()
            for o, (i, weights, constant) in zip(out, asked, strict=True):
                s, times = scale[:, :, i], member[:, i]
                if not times.any():
                    continue
                if squares:
                    o[1] += times.sum()
                    each = times[:, None] * s * s
                    o[2] += np.bincount(at, weights=b * b * np.repeat(each.ravel(), sides), minlength=size)
                    continue
                m = _margins(at, b, sides, s, weights) + constant
                o[0] += float(times @ (np.logaddexp(0, m) - label * m))
                r = times * (0.5 * (1 + np.tanh(m / 2)) - label)
                o[1] += r.sum()
                o[2] += np.bincount(at, weights=b * np.repeat((r[:, None] * s * [-1, 1]).ravel(), sides), minlength=size)
    return [tuple(o) for o in out]


class _Pairs:
    """Encoded pairs that are passed over again and again: here if they are few, in as many tasks as there are cores otherwise. A
    task holds a number a term of ``used`` and fit, and all that come to the driver at once take SUM_BYTES at most, or one task's.
    Weights go to tasks and sums come from them on the terms that the fit uses."""

    def __init__(self, encoded: DataFrame, used: list[np.ndarray], size: int):
        self.encoded, self.used, self.size = encoded.select("label", "member", "at", "n", "left", "scale"), used, size
        self.sc = encoded.sparkSession.sparkContext
        self.terms = encoded.agg(F.sum(F.length("at").cast("long") / 4 + 4 * len(used))).first()[0] or 0
        self.here = self.encoded.toArrow().to_batches() if self.terms <= HERE_TERMS else None
        self.known = self.sc.broadcast(used)

    def sums(self, asked: list[tuple[int, np.ndarray, float]], squares: bool = False) -> list[tuple[float, float, np.ndarray]]:
        size = self.size

        def of(batches, asked, used):
            whole = []
            for i, w, constant in asked:
                whole.append((i, np.zeros(size), constant))
                whole[-1][1][used[i]] = w
            return [(loss, constant, g[used[i]]) for (i, _, _), (loss, constant, g) in zip(asked, _sums(batches, len(used), whole, size, squares), strict=True)]

        if self.here is not None:
            return of(self.here, asked, self.used)
        shared, known = self.sc.broadcast(asked), self.known

        def task(batches):
            for i, (loss, constant, g) in enumerate(of(batches, shared.value, known.value)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([loss]), pa.array([float(constant)]), pa.array([g.tobytes()], pa.binary())], ["i", "loss", "constant", "g"])

        each = 8 * sum(len(w) for _, w, _ in asked)
        tasks = max(1, min(self.sc.defaultParallelism, math.ceil(self.terms / (4 * size + 1)), SUM_BYTES // max(1, each)))  # a task's terms outweigh its sums
        out = [[0.0, 0.0, np.zeros(len(w))] for _, w, _ in asked]
        for batch in self.encoded.coalesce(tasks).mapInArrow(task, "i int, loss double, constant double, g binary").toArrow().to_batches():
            for i, loss, constant, g in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column("g"), strict=True):
                out[i][0] += loss
                out[i][1] += constant
                out[i][2] += np.frombuffer(g.as_buffer())
        shared.destroy()
        return [tuple(o) for o in out]


def _descent(scale: np.ndarray, iterations: int, tolerance: float = 1e-6, memory: int = 10):
    """Least value of a smooth convex function by limited-memory BFGS in coordinates divided by ``scale``: yields points, is sent
    value and gradient there, and returns the last point. It ends where the gradient, in these coordinates, is ``tolerance`` of the first one."""
    u = np.zeros(len(scale))
    value, g = yield scale * u
    g = g * scale
    least, kept = tolerance * np.linalg.norm(g), []
    for _ in range(iterations):
        if not np.linalg.norm(g) > least:
            break
        d, coefficients = -g, []
        for s, y, sy in reversed(kept):
            coefficients.append(s @ d / sy)
            d = d - coefficients[-1] * y
        if kept:
            s, y, sy = kept[-1]
            d = d * (sy / (y @ y))
        for (s, y, sy), a in zip(kept, reversed(coefficients), strict=True):
            d = d + (a - y @ d / sy) * s
        slope, step = g @ d, 1.0 if kept else min(1.0, 1 / np.linalg.norm(g))
        for _ in range(40):
            new, grown = yield scale * (u + step * d)
            if new <= value + 1e-4 * step * slope + 1e-13 * abs(value):
                break
            step *= 0.5
        else:
            break  # no double is lower
        grown = grown * scale
        s, y = step * d, grown - g
        u, value, g = u + s, new, grown
        if s @ y > 1e-14 * (y @ y):
            kept = [*kept[1 - memory :], (s, y, s @ y)]
    return scale * u


def _fit(pairs: _Pairs, idf: np.ndarray, *, c: float, iterations: int) -> list[np.ndarray]:
    """Weights of each fit's own terms and the constant: logistic models of label (response2 preferred) that make half the sum of
    squared weights, the constant's too, plus c times the summed loss least. All fits go on together, so a pass over the pairs serves all of them. A weight is
    scaled by a bound of its curvature, so frequent terms don't hold up rare ones."""
    runs, points, found = {}, {}, {}
    idf = [w[u] for w, u in zip(idf, pairs.used, strict=True)]
    for i, (_, n, q) in enumerate(pairs.sums([(i, w, 0.0) for i, w in enumerate(idf)], squares=True)):
        runs[i] = _descent(1 / np.sqrt(1 + c / 4 * np.append(q * idf[i] ** 2, n)), iterations)
        points[i] = next(runs[i])
    while points:
        asked = list(points.items())
        for (i, w), (loss, constant, g) in zip(asked, pairs.sums([(i, w[:-1] * idf[i], float(w[-1])) for i, w in asked]), strict=True):
            try:
                points[i] = runs[i].send((0.5 * w @ w + c * loss, w + c * np.append(g * idf[i], constant)))
            except StopIteration as done:
                found[i] = done.value
                del points[i]
    return [found[i] for i in range(len(idf))]


def _scored(encoded: DataFrame, weights: list[tuple[np.ndarray, float]]) -> DataFrame:
    """fit, pair_id, label and margin."""
    shared = encoded.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        for batch in batches:
            for part, at, b, sides, scale in _parts(batch, len(shared.value)):
                for i, (w, constant) in enumerate(shared.value):
                    m = _margins(at, b, sides, scale[:, :, i], w) + constant
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), i, np.int32)), part.column("pair_id"), part.column("label"), pa.array(m)], ["fit", "pair_id", "label", "margin"])

    return encoded.mapInArrow(score, f"fit int, pair_id {encoded.schema['pair_id'].dataType.simpleString()}, label double, margin double")


def _member(counts: list[Column]) -> Column:
    """Counts as bytes, four each, the least first."""
    digits = [F.lpad(F.hex(n.cast("long")), 8, "0") for n in counts]
    return F.unhex(F.concat(*(F.substring(h, k, 2) for h in digits for k in (7, 5, 3, 1))))


def grid(trains: DataFrame | dict[str, DataFrame], evaluations: dict[str, DataFrame], *, fractions: tuple[float, ...], models: dict, least_documents: int = 3, iterations: int = 100) -> DataFrame:
    """Predictions of every model at every prefix of every training table on every evaluation set, as model, boundary (the table's name),
    fraction, evaluation_set, pair_id, label, margin and probability.

    A prefix is the first round(n * fraction) rows by ``position``. Pairs that several tables share are one row that knows how often each prefix
    holds it. Terms of a pair are made twice, to count them for all prefixes of all tables and to encode them; all fits work on what is encoded."""
    trains = {k: cut(x, "train") for k, x in (trains if isinstance(trains, dict) else {"": trains}).items()}
    fits = [(boundary, fraction, round(train.count() * fraction)) for boundary, train in trains.items() for fraction in fractions]
    columns = ("pair_id", "response1", "response2", "label")
    rows = reduce(DataFrame.unionByName, (x.select(*columns[:3], F.col("label").cast("double").alias("label"), F.lit(k).alias("boundary"), "position") for k, x in trains.items()))
    inside = [(F.col("boundary") == boundary) & (F.col("position") < size) for boundary, _, size in fits]
    if len(trains) == 1:
        train = rows.select(*columns, _member([q.cast("int") for q in inside]).alias("member"))
    else:
        train = rows.groupBy(*columns).agg(*(F.count_if(q).alias(f"member{i}") for i, q in enumerate(inside)))
        train = train.select(*columns, _member([F.col(f"member{i}") for i in range(len(fits))]).alias("member"))
    train = cut(train, "train")
    evaluations = {k: cut(e.select(*columns[:3], F.col("label").cast("double").alias("label"), _member([F.lit(0)] * len(fits)).alias("member")), "evaluation") for k, e in evaluations.items()}
    out = []
    for name, (terms, c, most) in models.items():
        spread = cut(_spread(train, terms), "sequences")
        held = reduce(lambda a, b: a | b, (F.col(f"df{i}") >= least_documents for i in range(len(fits))))
        by_term = cut(_frequencies(spread, terms, len(fits)).where(held), "frequencies")
        own = [_most(by_term.select("term", F.col(f"df{i}").alias("df"), F.col(f"total{i}").alias("total")), 2 * size, least_documents, most).toArrow() for i, (_, _, size) in enumerate(fits)]
        union = sorted({x for v in own for x in v.column("term").to_pylist()}, key=str.encode)
        idf, known = np.zeros((len(fits), len(union))), pa.array(union, pa.string())
        for w, v in zip(idf, own, strict=True):
            w[pc.index_in(v.column("term").cast(pa.string()), value_set=known).to_numpy()] = v.column("idf").to_numpy()
        used = [np.flatnonzero(w) for w in idf]  # idf is 1 at least
        weights = _fit(_Pairs(cut(_encoded(spread, terms, union, idf), "learner"), used, len(union)), idf, c=c, iterations=iterations)
        of = []
        for i, w in enumerate(weights):
            full = np.zeros(len(union))
            full[used[i]] = w[:-1]
            of.append((full * idf[i], float(w[-1])))
        at = F.col("fit") + 1
        for set_name, e in evaluations.items():
            p = _scored(cut(_encoded(_spread(e, terms), terms, union, idf), "scored"), of)
            p = p.select(F.element_at(F.array(*(F.lit(f[0]) for f in fits)), at).alias("boundary"), F.element_at(F.array(*(F.lit(f[1]) for f in fits)), at).alias("fraction"), "pair_id", "label", "margin", logistic(F.col("margin")).alias("probability"))
            out.append(p.select(F.lit(name).alias("model"), "boundary", "fraction", F.lit(set_name).alias("evaluation_set"), "pair_id", "label", "margin", "probability"))
    return reduce(DataFrame.unionByName, out)


def predict_sets(train: DataFrame, evaluations: dict[str, DataFrame], terms=word_terms, *, c: float = 1.0, iterations: int = 100, least_documents: int = 3, most_features: int = 120_000) -> dict[str, DataFrame]:
    """For each evaluation set pair_id, label, margin and probability, learned from all of ``train``."""
    g = grid(train.withColumn("position", F.lit(0)), evaluations, fractions=(1.0,), models={"": (terms, c, most_features)}, least_documents=least_documents, iterations=iterations)
    return {k: g.where(F.col("evaluation_set") == k).select("pair_id", "label", "margin", "probability") for k in evaluations}


def fit_predict(train: DataFrame, evaluation: DataFrame, terms=word_terms, **how) -> DataFrame:
    """``predict_sets`` for one set."""
    return predict_sets(train, {"": evaluation}, terms, **how)[""]
