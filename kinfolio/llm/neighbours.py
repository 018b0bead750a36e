"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import flat_lists, mixed, table

#: Trees; vectors to which they are fitted, at most; of these, vectors in a leaf.
TREES, SAMPLE, LEAF = 8, 20_000, 24
#: A query visits leaves, over all trees, until they hold so many rows, or this
#: share of the indexed rows if that is more.
BUDGET, SHARE = 32_768, 0.64
#: Queries whose visits are sent on, or whose distances are computed, at a time.
CHUNK = 64
#: Rows of a leaf that meet in one task; a larger leaf is dealt out by vec_id.
CELL = 16_384


@dataclass
class Forest:
    """Inner nodes of all trees: a direction, an offset, two children (an inner
    node, or -1 - leaf). ``rows`` is how many rows of the sample each leaf has."""

    directions: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    rows: np.ndarray

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, as (vectors, trees)."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, idx = todo.pop()
                if node < 0:
                    out[idx, t] = -1 - node
                elif len(idx):
                    right = x[idx] @ self.directions[node] > self.offsets[node]
                    todo += [(int(self.children[node, 0]), idx[~right]), (int(self.children[node, 1]), idx[right])]
        return out

    def visit(self, q: np.ndarray, budget: float, scale: float) -> list[int]:
        """Leaves in the order of one queue that all trees share, until they hold
        ``budget`` rows; a branch's priority is the sum of the squared margins by
        which ``q`` lies on the other side."""
        margins = self.directions @ q - self.offsets if len(self.offsets) else np.empty(0)
        queue, found, held = [(0.0, r) for r in self.roots], [], 0.0
        heapq.heapify(queue)
        while queue and held < budget:
            far, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                held += self.rows[-1 - node] * scale
            else:
                m = margins[node]
                a, b = self.children[node]
                near, other = (b, a) if m > 0 else (a, b)
                heapq.heappush(queue, (far, int(near)))
                heapq.heappush(queue, (far + m * m, int(other)))
        return found


def fit(x: np.ndarray, *, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
    """Splits at the median of a projection, which starts at random and is turned
    towards the difference of the two halves; until a leaf has ``leaf`` vectors
    or they can't be split."""
    rng = np.random.default_rng(seed)
    directions, offsets, children, rows, roots = [], [], [], [], []
    for _ in range(trees):
        root: list[int] = []
        todo = [(np.arange(len(x)), root, 0)]
        while todo:
            idx, place, at = todo.pop()
            node, right = 0, None
            if len(idx) > leaf:
                w = rng.normal(size=x.shape[1])
                some = idx if len(idx) <= 1000 else rng.choice(idx, 1000, replace=False)
                for _ in range(3):
                    p = x[some] @ w
                    up = p > np.median(p)
                    if up.any():
                        w = x[some[up]].mean(0) - x[some[~up]].mean(0)
                p = x[idx] @ w / (np.linalg.norm(w) or 1)
                right = p > np.median(p)
            if right is None or not right.any():
                node = -1 - len(rows)
                rows.append(len(idx))
            else:
                node = len(directions)
                directions.append(w / np.linalg.norm(w))
                offsets.append(np.median(p))
                children.append([0, 0])
                todo += [(idx[~right], children[node], 0), (idx[right], children[node], 1)]
            if place is root:
                root.append(node)
            else:
                place[at] = node
        roots += root
    return Forest(np.array(directions).reshape(-1, x.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), roots, np.array(rows, np.float64))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = flat_lists(column)
    return values.astype(np.float64).reshape(len(offsets) - 1, -1)


def proper(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding and width of the vectors that take part: those that are not
    null, not empty, not zero, and finite in all components."""
    e = embeddings.select(embeddings["vec_id"].alias("vec_id"), embeddings["embedding"].alias("embedding"))
    finite = lambda v: F.coalesce((F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v), F.lit(False))
    e = e.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0))
    return e.withColumn("width", F.size("embedding"))


_FOUND = "query_id long, rank int, vec_id long, score double"


def nearest(embeddings: DataFrame, queries: DataFrame, *, k: int = 10, budget: int = BUDGET, share: float = SHARE, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """The ``k`` nearest found, by Euclidean distance, of each row of ``queries``.

    A forest is fitted to the ``sample`` vectors with the least seeded hash,
    which bounds what the driver holds and what is sent along. Every vector is
    indexed: it goes to its leaf in each tree. Each query visits leaves through
    one priority queue over all trees, until they hold ``budget`` rows or
    ``share`` of all, whichever is more, and goes to those leaves; there its
    distances to the leaf's vectors are computed exactly, and the best are
    merged. A leaf of more than CELL rows is dealt out into cells, so none outgrows a
    task. Vectors that are equal in all components are indexed as k rows of each of
    their k + 1 smallest ids, which loses no answer, so no leaf fills up with copies.

    A query isn't its own neighbour, by vec_id. Ties go to the smaller vec_id.
    Null, empty, zero and non-finite vectors take no part; see ``proper``. Vectors are
    compared with those of their own length, each length by a forest of its own.
    Every other row is a candidate of its own, also where it repeats an id, or an id
    and its vector; queries that share an id are answered one by one, but those that
    share a vector too once. If there are fewer candidates
    than k, all are returned; without any the result is empty. Returns query_id,
    rank (from 1), vec_id and score.
    """
    same = [F.xxhash64("embedding"), F.col("embedding")]
    by_id, in_id = Window.partitionBy(*same).orderBy("vec_id"), Window.partitionBy(*same, "vec_id").orderBy("vec_id")
    rows = proper(embeddings).withColumns({"ids": F.dense_rank().over(by_id), "nth": F.row_number().over(in_id)})
    rows = cut(rows.where((F.col("ids") <= k + 1) & (F.col("nth") <= k)).drop("ids", "nth").withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    # As many partitions as are named: adaptive execution would put the queries, a small table, into one, and all their visits come out of it.
    asked = proper(queries).repartition(int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "vec_id", "embedding").dropDuplicates(["vec_id", "embedding"])
    asked = cut(asked.withColumn("row", F.monotonically_increasing_id()), "ann-queries")
    widths = sorted(tuple(r) for r in rows.groupBy("width").count().collect())  # as many as there are lengths of vectors
    each = [_among(rows.where(F.col("width") == w), asked.where(F.col("width") == w), n, k, max(budget, share * n), trees, sample, leaf) for w, n in widths]
    if not each:
        return embeddings.sparkSession.createDataFrame([], _FOUND)
    best = Window.partitionBy("asked", "query_id").orderBy("score", "vec_id")
    pairs = reduce(DataFrame.unionByName, each).groupBy("asked", "query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _among(rows: DataFrame, asked: DataFrame, n: int, k: int, budget: float, trees: int, sample: int, leaf: int) -> DataFrame:
    """asked and query_id, row and vec_id, and score of near vectors; all ``n`` rows and all queries are of one length."""
    forest = fit(_matrix(rows.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0)), trees=trees, leaf=leaf)
    scale = n / forest.rows.sum() * trees
    cells = np.ceil(forest.rows * scale / CELL).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(cells)))[:-1]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = forest.leaves_of(_matrix(batch.column(1)))
                row = np.repeat(np.arange(len(leaves)), trees)
                at = mixed(batch.column(0).cast(pa.int64()).to_numpy().astype(np.uint64))[row] % cells[leaves.ravel()].astype(np.uint64)
                yield pa.record_batch([pa.array(first[leaves.ravel()] + at.astype(np.int64)), *(batch.column(c).take(row) for c in range(3))], names=["cell", "vec_id", "embedding", "row"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                visits = [np.array(forest.visit(q, budget, scale), np.int64) for q in _matrix(batch.column(1))]
                found = [np.repeat(first[v] - np.cumsum(cells[v]) + cells[v], cells[v]) + np.arange(cells[v].sum()) for v in visits]  # all cells of those leaves
                row = np.repeat(np.arange(len(found)), [len(v) for v in found])
                yield pa.record_batch([pa.array(np.concatenate(found)), *(batch.column(c).take(row) for c in range(3))], names=["cell", "vec_id", "embedding", "row"])

    def rerank(queries: pa.Table, found: pa.Table) -> pa.Table:
        out = ([], [], [], [], [])
        if found.num_rows and queries.num_rows:
            ids, rows_of, x = found.column("vec_id").to_numpy(), found.column("row").to_numpy(), _matrix(found.column("embedding"))
            lengths, own, asked_of, q = (x * x).sum(axis=1), queries.column("vec_id").to_numpy(), queries.column("row").to_numpy(), _matrix(queries.column("embedding"))
            for a in range(0, len(q), CHUNK):
                y, me = q[a : a + CHUNK], own[a : a + CHUNK]
                d = lengths - 2 * (y @ x.T) + (y * y).sum(axis=1)[:, None]  # close to the squared distances: tells what is worth the exact ones
                d[me[:, None] == ids] = np.inf
                last = np.partition(d, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(y), np.inf)
                r, c = np.nonzero((d <= last[:, None] + 1e-9 * (lengths.max() + (y * y).sum(axis=1)[:, None])) & np.isfinite(d))
                apart = x[c] - y[r]
                for column, values in zip(out, (asked_of[a + r], me[r], rows_of[c], ids[c], np.sqrt((apart * apart).sum(axis=1))), strict=True):
                    column.append(values)
        cat = [np.concatenate(o) if o else np.empty(0) for o in out]
        return pa.table([c.astype(np.float64 if n == "score" else np.int64) for n, c in zip(names, cat, strict=True)], names)

    kind = rows.schema["embedding"].dataType.simpleString()
    placed, names = f"cell long, vec_id long, embedding {kind}, row long", ["asked", "query_id", "row", "vec_id", "score"]
    a = asked.select(F.col("vec_id").cast("long"), "embedding", "row").mapInArrow(search, placed).groupBy("cell")
    b = rows.select(F.col("vec_id").cast("long"), "embedding", "row").mapInArrow(index, placed).groupBy("cell")
    return a.cogroup(b).applyInArrow(rerank, "asked long, query_id long, row long, vec_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"))


_SQUARES = [f"list_sum(list_transform(range({j}, len(q.e), 8), lambda i: (q.e[i + 1] - v.e[i + 1]) * (q.e[i + 1] - v.e[i + 1])))" for j in range(8)]
#: Exact. Where all trees together index no more than BUDGET rows, every leaf is visited.
#: Squares are added up as NumPy does it: eight sums of every eighth, then these.
SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, q.e, v.vec_id, sqrt((({_SQUARES[0]} + {_SQUARES[1]}) + ({_SQUARES[2]} + {_SQUARES[3]})) + (({_SQUARES[4]} + {_SQUARES[5]}) + ({_SQUARES[6]} + {_SQUARES[7]}))) AS score FROM (SELECT DISTINCT vec_id, e FROM v) q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, e ORDER BY score, vec_id) AS nth, vec_id, score FROM p)
SELECT query_id, nth::INT AS rank, vec_id, score FROM r WHERE nth <= 10
"""
QUERIES, ORACLES = {"op10_nearest_neighbours": query}, {"op10_nearest_neighbours": SQL}
