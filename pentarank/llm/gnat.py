"""Hard negatives by exact search in a multiway hyperplane tree.

Scores are inner products of integer vectors. One more coordinate, ``sqrt(M - |x|^2)`` for a row
and 0 for a query, turns them into distances: ``d^2 = |q|^2 + M - 2 score``, with ``M`` the largest
squared length, so that a window of scores is an annulus around the query.

Each inner node of the tree holds a few split points; a row goes to the nearest one. For each split
point and each child the node stores the range of distances from the point to all rows below
that child. A query measures its distances to the split points and drops each child whose
ranges cannot meet any of its annuli. Leaves are scanned exactly, so nothing is lost.

The split points come from a bounded sample; ranges and leaves are those of all rows. Leaves are
cut into blocks of bounded size, one of which is in memory at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pentarank.llm.common import cut

DEGREE = 8
CANDIDATES = 64
LEAVES = 1024
SAMPLE = 4096
CHUNK = 256
LARGEST = 2.0**50

_FOUND = "anchor long, place int, id long, score long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _gaps(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(1)[:, None] + (others * others).sum(1)[None, :] - 2.0 * (points @ others.T)
    return np.sqrt(np.maximum(0.0, squares))


@dataclass
class Node:
    points: np.ndarray | None = None
    children: list[int] = field(default_factory=list)
    leaf: int = -1
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Gnat:
    """The tree; ``top`` is the largest squared length of all rows. Parents come before children."""

    def __init__(self, sample: np.ndarray, top: float, rows: int, leaf_rows: int, leaves: int = LEAVES):
        self.top, self.slack = top, 1e-6 * math.sqrt(top) + 1e-9
        points = self.lift(sample)
        self.nodes = [Node()]
        share = rows / max(1, len(points))
        waiting = [(-len(points), 0, np.arange(len(points)))]
        ends = 1
        while waiting and ends + DEGREE - 1 <= leaves:
            _, at, mine = heapq.heappop(waiting)
            if len(mine) * share <= leaf_rows:
                break
            chosen = self._far_apart(points[mine[:CANDIDATES]])
            if len(chosen) < 2:
                continue
            node = self.nodes[at]
            node.points = points[mine[chosen]]
            nearest = _gaps(points[mine], node.points).argmin(1)
            ends += len(chosen) - 1
            for j in range(len(chosen)):
                node.children.append(len(self.nodes))
                heapq.heappush(waiting, (-int((nearest == j).sum()), len(self.nodes), mine[nearest == j]))
                self.nodes.append(Node())
        for number, node in enumerate(n for n in self.nodes if not n.children):
            node.leaf = number
        self.leaves = sum(not n.children for n in self.nodes)

    @staticmethod
    def _far_apart(points: np.ndarray) -> list[int]:
        """Split points: each the candidate farthest from those chosen so far."""
        chosen = [0]
        near = _gaps(points, points[:1])[:, 0]
        while len(chosen) < min(DEGREE, len(points)):
            far = int(near.argmax())
            if near[far] <= 1e-6 * (1.0 + float(np.abs(points).max())):
                break
            chosen.append(far)
            near = np.minimum(near, _gaps(points, points[far : far + 1])[:, 0])
        return chosen

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.top - (vectors * vectors).sum(1)))
        return np.concatenate([vectors, rest[:, None]], 1)

    def _walk(self, points: np.ndarray) -> Iterator[tuple[int, Node, np.ndarray, np.ndarray, np.ndarray]]:
        """Inner nodes with the rows below them, their distances to the split points and their children."""
        at = np.zeros(len(points), np.int64)
        for number, node in enumerate(self.nodes):
            mine = np.flatnonzero(at == number)
            if len(mine) and node.children:
                gaps = _gaps(points[mine], node.points)
                nearest = gaps.argmin(1)
                at[mine] = np.array(node.children)[nearest]
                yield number, node, mine, gaps, nearest
        self._last = at

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        for _ in self._walk(self.lift(vectors)):
            pass
        return np.array([n.leaf for n in self.nodes], np.int64)[self._last]

    def ranges(self, vectors: np.ndarray) -> Iterator[tuple[int, int, int, float, float]]:
        """``(node, point, child, low, high)`` of the distances from split points to rows below children."""
        for number, node, _, gaps, nearest in self._walk(self.lift(vectors)):
            for j in np.unique(nearest):
                below = gaps[nearest == j]
                for i, (low, high) in enumerate(zip(below.min(0), below.max(0))):
                    yield number, i, int(j), float(low), float(high)

    def set_ranges(self, rows) -> None:
        for node in self.nodes:
            if node.children:
                size = len(node.children)
                node.low, node.high = np.full((size, size), np.inf), np.full((size, size), -np.inf)
        for number, i, j, low, high in rows:
            self.nodes[number].low[i, j], self.nodes[number].high[i, j] = low, high

    def meeting(self, queries: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """``(queries, leaf)``: all leaves that may hold a score within any window ``lows .. highs``."""
        squares = (queries * queries).sum(1)[:, None] + self.top
        near = np.sqrt(np.maximum(0.0, squares - 2.0 * highs)) - self.slack
        far = np.sqrt(np.maximum(0.0, squares - 2.0 * lows)) + self.slack
        void = lows > highs
        near[void], far[void] = np.inf, -np.inf
        points = np.concatenate([queries, np.zeros((len(queries), 1))], 1)
        alive = {0: np.flatnonzero((~void).any(1))}
        for number, node in enumerate(self.nodes):
            rows = alive.pop(number, None)
            if rows is None or not len(rows):
                continue
            if not node.children:
                yield rows, node.leaf
                continue
            gaps = _gaps(points[rows], node.points)[:, :, None]
            least = np.maximum(gaps - node.high, node.low - gaps).max(1)
            most = (gaps + node.high).min(1)
            meets = ((far[rows][:, :, None] >= least[:, None, :]) & (near[rows][:, :, None] <= most[:, None, :])).any(1)
            for j, child in enumerate(node.children):
                alive[child] = rows[meets[:, j]]


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _windows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


class Block:
    """Rows of one block in the order of their ids, searched exactly."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int):
        ids = np.concatenate([_longs(p, "id") for p in parts])
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.keys = np.concatenate([_longs(p, "key") for p in parts])[order]
        self.labels = np.concatenate([_longs(p, "label") for p in parts])[order]
        self.vectors = np.concatenate([_matrix(p, dim) for p in parts])[order]

    def best(self, queries, keys, labels, lows, highs, same: bool, count: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(query, window, rows, scores)``: the first ``count`` rows in each window, ties by place."""
        for lo in range(0, len(queries), CHUNK):
            part = slice(lo, lo + CHUNK)
            # Sums stay below 2**50, so products of doubles are exact.
            scores = np.rint(queries[part] @ self.vectors.T).astype(np.int64)
            fits = (self.labels[None, :] == labels[part][:, None]) == same
            if same:
                fits &= self.keys[None, :] != keys[part][:, None]
            fits &= (scores >= lows[part].min(1)[:, None]) & (scores <= highs[part].max(1)[:, None])
            for k in range(len(scores)):
                rows = np.flatnonzero(fits[k])
                if not len(rows):
                    continue
                mine = scores[k, rows]
                order = np.argsort(-mine, kind="stable")
                rows, mine = rows[order], mine[order]
                for w, (low, high) in enumerate(zip(lows[lo + k], highs[lo + k])):
                    first = int(np.searchsorted(-mine, -high, side="left"))
                    last = min(first + count, int(np.searchsorted(-mine, -low, side="right")))
                    if first < last:
                        yield lo + k, w, rows[first:last], mine[first:last]


def _raised(sample: Block, queries, keys, labels, lows, highs, same: bool, count: int) -> np.ndarray:
    """Lower ends of windows, raised to the score of the ``count``-th sample row in them."""
    lows = lows.copy()
    for k, w, _, scores in sample.best(queries, keys, labels, lows, highs, same, count):
        if len(scores) == count:
            lows[k, w] = scores[-1]
    return lows


def _plan(tree: Gnat, sample: list[pa.RecordBatch], dim: int, same: bool, count: int):
    """Adds to each query the leaves it must search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Block(sample, dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            queries, lows, highs = _matrix(batch, dim), _windows(batch, "lows"), _windows(batch, "highs")
            lows = _raised(known, queries, _longs(batch, "key"), _longs(batch, "label"), lows, highs, same, count)
            leaves: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for rows, leaf in tree.meeting(queries, lows.astype(np.float64), highs.astype(np.float64)):
                for k in rows:
                    leaves[k].append(leaf)
            names = ["key", "id", "label", "v", "highs"]
            columns = [batch.column(n) for n in names] + [pa.array(lows.tolist(), pa.list_(pa.int64())), pa.array(leaves, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lows", "leaves"])

    return run


def _scan(dim: int, same: bool, count: int):
    """Rows of a block, then the queries it gets, in batches; the next block follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            marks = _longs(batch, "cell") * 2 + _longs(batch, "kind")
            edges = [0, *(np.flatnonzero(np.diff(marks)) + 1), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part, here = batch.slice(a, b - a), marks[a] // 2
                if here != cell:
                    cell, held, block = here, [], None
                if marks[a] % 2 == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                block = block or Block(held, dim)
                keys = _longs(part, "key")
                windows = _windows(part, "lows"), _windows(part, "highs")
                for k, w, rows, scores in block.best(_matrix(part, dim), keys, _longs(part, "label"), *windows, same, count):
                    size = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, keys[k])), pa.array(np.full(size, w, np.int32)), pa.array(block.ids[rows]), pa.array(scores)],
                        ["anchor", "place", "id", "score"],
                    )

    return run


def _first(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows of each window over all blocks, with their rank."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


@dataclass
class Index:
    """All rows with their leaves, and what tasks need of the tree."""

    rows: DataFrame
    tree: Gnat
    sample: list[pa.RecordBatch]
    dim: int
    first: np.ndarray

    def search(self, asked: DataFrame, same: bool, count: int) -> DataFrame:
        """``(anchor, place, id, score, rank)``: the first ``count`` rows in every window of the queries.

        ``asked`` holds ``key, id, label, v, lows, highs``; rows of the query's own label count
        if ``same``, those of others if not.
        """
        schema = "key long, id long, label long, v array<int>, highs array<long>, lows array<long>, leaves array<int>"
        names = ["key", "id", "label", "v", "lows", "highs"]
        planned = asked.select(*names).mapInArrow(_plan(self.tree, self.sample, self.dim, same, count), schema)
        ends = F.sequence(F.get(F.lit(self.first[:-1].tolist()), F.col("leaf")), F.get(F.lit(self.first[1:].tolist()), F.col("leaf")) - 1)
        queries = planned.select(*names, F.explode("leaves").alias("leaf")).filter(F.get(F.lit(np.diff(self.first).tolist()), F.col("leaf")) > 0)
        queries = queries.select(*names, F.explode(ends.cast("array<int>")).alias("cell"), F.lit(1).alias("kind"))
        none = F.lit(None).cast("array<long>")
        stored = self.rows.select("key", "id", "label", "v", none.alias("lows"), none.alias("highs"), "cell", F.lit(0).alias("kind"))
        width = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = stored.unionByName(queries).repartition(width, "cell").sortWithinPartitions("cell", "kind")
        return _first(dealt.mapInArrow(_scan(self.dim, same, count), _FOUND), count)


def build_index(rows: DataFrame, leaf_rows: int, block: int) -> Index | None:
    """Index of ``(key, id, label, v)``; None for no rows."""
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    facts = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.max(square)).first()
    total, dim, top = facts
    if not total:
        return None
    if top >= LARGEST:
        raise ValueError("components are too large for exact scores: squared lengths must stay below 2**50")
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), dim - F.size("v"))))
    wanted = min(SAMPLE, (1 << 22) // max(1, dim))
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < wanted / total * (1 << 30)
    sample = rows.filter(drawn).select("key", "id", "label", "v").orderBy(F.xxhash64("key")).limit(wanted).toArrow()
    sample = sample.combine_chunks().to_batches() or rows.select("key", "id", "label", "v").limit(1).toArrow().to_batches()
    tree = Gnat(np.concatenate([_matrix(b, dim) for b in sample]), top, total, leaf_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.leaf_of(_matrix(batch, dim)).astype(np.int32)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(tree.ranges(_matrix(batch, dim)))
            if made:
                yield pa.RecordBatch.from_pylist([dict(zip(("node", "point", "child", "low", "high"), r)) for r in made])

    placed = cut(rows.select("key", "id", "label", "v").mapInArrow(place, "key long, id long, label long, v array<int>, leaf int"))
    ranges = placed.select("v").mapInArrow(measure, "node long, point long, child long, low double, high double")
    # As many rows as the tree has ranges, and leaves: bounded by LEAVES and DEGREE.
    tree.set_ranges(ranges.groupBy("node", "point", "child").agg(F.min("low"), F.max("high")).collect())
    slots = np.zeros(tree.leaves, np.int64)
    for leaf, count in placed.groupBy("leaf").count().collect():
        slots[leaf] = -(-count // block)
    first = np.concatenate([[0], np.cumsum(slots)])
    start, width = F.lit(first[:-1].tolist()), F.lit(np.maximum(1, slots).tolist())
    cell = F.get(start, F.col("leaf")) + F.pmod(F.xxhash64("key"), F.get(width, F.col("leaf")))
    return Index(placed.withColumn("cell", cell.cast("int")), tree, sample, dim, first)


def mine_negatives(
    vectors: DataFrame,
    anchors: Column,
    n_positive: int = 5,
    n_negative: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    leaf_rows: int = 512,
    block: int = 2048,
) -> DataFrame:
    """Rows of other labels that score high, but not too high, against an anchor.

    Components count as ``floor(scale * x)``, scores are integer inner products; higher scores come first,
    ties by smaller id. An anchor's positives are the first ``n_positive`` other rows of its label. For
    each, the first ``n_negative`` rows of other labels with ``low * positive_score <= 100 * score <= high *
    positive_score`` come back as ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` is a condition on ``vectors``; labels are integers. Rows whose id, label or vector is NULL, or
    with a NULL or non-finite component, take no part. Shorter vectors count as filled up with
    zeros. Repeated rows are rows of their own: each is an anchor, a positive and a negative
    for itself, and one copy is a positive of another. Scaled components that leave 32
    bits, or squared lengths from 2**50, raise. An anchor without positives, or a
    positive without negatives, gives no row; an empty table gives an empty result; other
    columns are ignored. Runs jobs while it builds the result.

    Every anchor is searched in all blocks that its windows meet; how many those are depends on
    how far the vectors cluster. Its windows are first narrowed by the best rows of the sample.
    """
    spark = vectors.sparkSession
    v = F.col("_v.v")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.select(
        F.struct(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"),
                 F.coalesce(anchors, F.lit(False)).alias("asked")).alias("_v")
    )
    rows = rows.filter(F.col("_v.id").isNotNull() & F.col("_v.label").isNotNull() & v.isNotNull() & finite)
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("key"), "_v.id", "_v.label", scaled.alias("v"), "_v.asked"))
    index = build_index(rows.select("key", "id", "label", "v"), leaf_rows, block)
    if index is None:
        return spark.createDataFrame([], _RESULT)
    anchor = cut(index.rows.join(rows.filter("asked").select("key"), "key", "left_semi").select("key", "id", "label", "v"))
    widest = int(LARGEST)
    every = anchor.withColumns({"lows": F.array(F.lit(-widest)), "highs": F.array(F.lit(widest))})
    positives = index.search(every, True, n_positive).select(
        F.col("anchor").alias("key"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("place")
    )
    positives = cut(positives)
    scores = F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"])
    windows = positives.groupBy("key").agg(scores.alias("scores"))
    # Windows of all anchors have one width; those not in use are empty. Division rounds down.
    filled = F.concat("scores", F.array_repeat(F.lit(None).cast("long"), n_positive - F.size("scores")))
    windows = windows.withColumn("s", filled).select(
        "key",
        F.expr(f"transform(s, s -> coalesce(-((-{low} * s - pmod(-{low} * s, 100L)) div 100), 1L))").alias("lows"),
        F.expr(f"transform(s, s -> coalesce(({high} * s - pmod({high} * s, 100L)) div 100, 0L))").alias("highs"),
    )
    found = index.search(anchor.join(windows, "key"), False, n_negative)
    told = found.join(positives, (found["anchor"] == positives["key"]) & (found["place"] == positives["place"]))
    told = told.select("key", found["rank"].cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "positive_id", "positive_score")
    named = told.join(anchor.select("key", F.col("id").alias("anchor_id")), "key")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

