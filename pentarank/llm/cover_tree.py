"""Exact near-duplicate pairs of vectors by a dual traversal of cover trees.

The upper levels are rows of a table: vectors of one label are split around pivots, again and again until
a node holds a block's worth, each node knowing the true distance to its farthest member. Pairs of nodes are
followed from the root, level by level. Below, each block's task builds its cover
tree once: nested levels of centres whose nominal radii halve, with covering radii too, and two trees are
traversed together. On all levels a pair of nodes is
dropped when its centres are farther apart than the link distance plus both covering
radii; otherwise the nodes are replaced by their children. What is left are pairs of
single vectors, decided by their cosine in double precision.

For unit vectors ``|a - b|^2 = 2 - 2 cos``, so a cosine bound is a distance bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentarank.llm.common import cut
from pentarank.llm.links import components, forest

BLOCK = 1024
PAIRS = 1 << 15
PIVOTS = 64
SPARSE = 32
SLACK = 1e-6
TIE = 1e-7


class CoverTree:
    """Levels ``0 .. depth`` of one set of unit vectors.

    ``centres[l]`` are the members that are centres on level ``l``, the first of them those of the
    level above (nested). ``parent[l]`` names each one's position among the centres of level
    ``l - 1``, ``radius[l]`` the distance to its farthest descendant. The last level holds
    every vector with radius zero.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        size = len(points)
        # A net of more centres than this prunes nothing: the level of all vectors follows instead.
        crowd = max(SPARSE, size // 4)
        centres, nearest = np.zeros(1, np.int64), np.zeros(size, np.int64)
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points @ points[0])))
        reach = 2.0
        self.centres, self.parent, owners = [centres], [np.zeros(1, np.int64)], [nearest]
        while len(centres) < size and apart.max() > 0 and reach > 1e-3:
            reach /= 2.0
            chosen, parents = list(centres), list(range(len(centres)))
            nearest = owners[-1].copy()
            above = owners[-1]
            # Greedy net: the farthest uncovered vector becomes a centre until all are covered.
            while True:
                far = int(np.argmax(apart))
                if apart[far] <= reach:
                    break
                away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points @ points[far])))
                # A centre serves the members of its own parent only: the levels form a tree.
                closer = (away < apart) & (above == above[far])
                closer[far] = True
                nearest[closer], apart[closer] = len(chosen), away[closer]
                apart[far] = 0.0
                chosen.append(far)
                parents.append(int(above[far]))
                if len(chosen) == size or len(chosen) > crowd:
                    break
            if len(chosen) > crowd:
                break
            centres = np.array(chosen, np.int64)
            self.centres.append(centres)
            self.parent.append(np.array(parents, np.int64))
            owners.append(nearest)
        if len(centres) < size:
            rest = np.setdiff1d(np.arange(size), centres)
            last = np.concatenate([centres, rest])
            self.centres.append(last)
            self.parent.append(np.concatenate([np.arange(len(centres)), owners[-1][rest]]))
            place = np.empty(size, np.int64)
            place[last] = np.arange(size)
            owners.append(place)
        self.radius = []
        for level, owner in zip(self.centres, owners):
            gap = np.sqrt(np.maximum(0.0, ((points - points[level[owner]]) ** 2).sum(axis=1)))
            widest = np.zeros(len(level))
            np.maximum.at(widest, owner, gap)
            self.radius.append(widest)
        self.children = []
        for level in range(1, len(self.centres)):
            order = np.argsort(self.parent[level], kind="stable")
            first = np.searchsorted(self.parent[level][order], np.arange(len(self.centres[level - 1]) + 1))
            self.children.append((order, first))

    def __len__(self) -> int:
        return len(self.centres)


def _expand(order, first, nodes):
    """Children of ``nodes``, and for each the place of its parent in ``nodes``."""
    count = first[nodes + 1] - first[nodes]
    which = np.repeat(np.arange(len(nodes)), count)
    at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return order[first[nodes][which] + at], which


def _gap(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def dual_pairs(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ``(i, j)`` with cosine at least ``cosine``; within one tree each unordered pair once.

    Node pairs wait on a stack in bounded slices, so memory does not follow their number.
    """
    own = a is b
    bound = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + SLACK
    stack = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, x, y = stack.pop()
        i, j = a.centres[la][x], b.centres[lb][y]
        dots = np.einsum("ij,ij->i", a.points[i], b.points[j])
        keep = _gap(dots) <= bound + a.radius[la][x] + b.radius[lb][y]
        last_a, last_b = la == len(a) - 1, lb == len(b) - 1
        if last_a and last_b:
            hit = dots >= cosine
            if own:
                hit &= i != j
            yield i[hit], j[hit]
            continue
        x, y = x[keep], y[keep]
        if len(x):
            stack += _descend(a, b, la, lb, x, y, bound)


def _descend(a: CoverTree, b: CoverTree, la: int, lb: int, x: np.ndarray, y: np.ndarray, bound: float) -> list:
    """Children times children of the node pairs, in slices; a last level stays where it is."""
    na, cx, wx = (la, x, np.arange(len(x))) if la == len(a) - 1 else (la + 1, *_expand(*a.children[la], x))
    nb, cy, wy = (lb, y, np.arange(len(y))) if lb == len(b) - 1 else (lb + 1, *_expand(*b.children[lb], y))
    own = a is b
    count_x, count_y = np.bincount(wx, minlength=len(x)), np.bincount(wy, minlength=len(x))
    first_x, first_y = np.cumsum(count_x) - count_x, np.cumsum(count_y) - count_y
    ends = np.cumsum(count_x * count_y)
    out, lo = [], 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PAIRS, side="right")))
        if hi == lo + 1:
            left = cx[first_x[lo] : first_x[lo] + count_x[lo]]
            right = cy[first_y[lo] : first_y[lo] + count_y[lo]]
            out += _product(a, b, na, nb, left, right, own and x[lo] == y[lo], bound)
        else:
            which = np.arange(lo, hi)
            i_own = np.repeat(which, count_x[lo:hi])
            i = cx[first_x[lo] : first_x[lo] + len(i_own)]
            width = count_y[i_own]
            parent, i = np.repeat(i_own, width), np.repeat(i, width)
            at = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
            j = cy[first_y[parent] + at]
            if own:
                once = (x[parent] != y[parent]) | (i <= j)
                i, j = i[once], j[once]
            out.append((na, nb, i, j))
        lo = hi
    return out


def _product(a, b, na, nb, left, right, same: bool, bound: float) -> list:
    """Children of one node pair against each other, pruned by blocks of a matrix product."""
    out = []
    other, radius = b.points[b.centres[nb][right]], b.radius[nb][right]
    step = max(1, PAIRS * 8 // max(1, len(right)))
    for k in range(0, len(left), step):
        part = left[k : k + step]
        gap = _gap(a.points[a.centres[na][part]] @ other.T)
        keep = gap <= bound + a.radius[na][part][:, None] + radius[None, :]
        if same:
            keep &= part[:, None] <= right[None, :]
        i, j = np.nonzero(keep)
        out += [(na, nb, part[i[s : s + PAIRS]], right[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]
    return out


class _Block:
    """The vectors of one block, their tree, and what links them so far."""

    def __init__(self, parts: list[pa.RecordBatch], cosine: float):
        self.ids, self.copies, points = _arrays(parts)
        self.tree, self.cosine = CoverTree(points), cosine
        self.links, self.root = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))
        self._join(dual_pairs(self.tree, self.tree, cosine))

    def _join(self, found: Iterator, ids=None, copies=None) -> np.ndarray:
        """Count pairs and unite what they link; with ``ids``, pairs of own and of foreign vectors."""
        size, more = len(self.ids), 0 if ids is None else len(ids)
        root, links = np.concatenate([self.root, np.arange(size, size + more)]), np.zeros(size + more, np.int64)
        offset = 0 if ids is None else size
        weight = self.copies if ids is None else np.concatenate([self.copies, copies])
        for i, j in found:
            if len(i):
                j = j + offset
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                root = forest(np.concatenate([i, np.arange(size + more)]), np.concatenate([j, root]), size + more)
        self.links += links[:size]
        self.root = root[:size]
        return np.stack([links[size:], root[size:]])

    def meet(self, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Pairs of own vectors and foreign ones; what the foreign ones are told."""
        ids, copies, points = _arrays(parts)
        links, root = self._join(dual_pairs(self.tree, CoverTree(points), self.cosine), ids, copies)
        some = np.flatnonzero(links)
        return _told(ids[some], links[some], self.ids[root[some]])

    def told(self) -> pa.RecordBatch:
        some = np.flatnonzero((self.links > 0) | (self.root != np.arange(len(self.ids))))
        return _told(self.ids[some], self.links[some], self.ids[self.root[some]])


def _told(ids: np.ndarray, links: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, links, roots)], ["vec", "links", "root"])


def _arrays(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, copies = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("vec", "copies"))
    points = np.concatenate([p.column("unit").flatten().to_numpy().reshape(p.num_rows, -1) for p in parts])
    order = np.argsort(ids, kind="stable")
    return ids[order], copies[order], points[order]


def _scan(cosine: float, block: int):
    """Blocks one after the other: own vectors first, then foreign ones, a block's worth at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own, tree, foreign, waiting = None, [], None, [], 0

        def met():
            nonlocal tree, own, foreign, waiting
            if tree is None and own:
                tree, own = _Block(own, cosine), []
            held, foreign, waiting = foreign, [], 0
            if tree is not None and held:
                yield tree.meet(held)

        for batch in batches:
            if not batch.num_rows:
                continue
            cells, kinds = batch.column("cell").to_pylist(), batch.column("kind").to_numpy()
            changes = [k for k in range(1, len(cells)) if cells[k] != cells[k - 1] or kinds[k] != kinds[k - 1]]
            for a, b in zip([0, *changes], [*changes, len(cells)]):
                if cells[a] != cell:
                    yield from met()
                    if tree is not None:
                        yield tree.told()
                    cell, own, tree = cells[a], [], None
                if kinds[a] == 0:
                    own.append(batch.slice(a, b - a))
                    continue
                for at in range(a, b, block):
                    part = batch.slice(at, min(block, b - at))
                    foreign.append(part)
                    waiting += part.num_rows
                    if waiting >= block:
                        yield from met()
        yield from met()
        if tree is not None:
            yield tree.told()

    return run


def link_vectors(
    vectors: DataFrame,
    cosine: float = 0.93,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row, linking equal labels at ``cosine`` or more.

    Vectors that are NULL, empty, of zero length or hold NULL or non-finite numbers, and rows whose label is
    NULL, link with nothing, and so do vectors of different dimension. Equal vectors of a
    label form one class: they link with each other and are compared once, so copies are
    never expanded. Repeated ids are counted as vectors of their own and share a row's
    values. Other columns are ignored. Runs jobs while it builds the result.

    A label's classes are split around pivots into blocks of at most ``block`` vectors, in as many levels as it takes.
    A block's tree is built once; vectors of other blocks come to it only if they lie within its radius and the link distance
    of its centre. Work is that of exact search: it is pruned where vectors lie in clusters, and quadratic
    per label where they do not.
    """
    bound = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + SLACK
    value = F.col("v").cast("array<double>")
    # Scaled by the largest part first, so that squares neither overflow nor vanish.
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")
    ).withColumn("top", F.array_max(F.transform(value, lambda x: F.when(F.isnan(x), F.lit(float("inf"))).otherwise(F.abs(x)))))
    sound = (
        F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("top").isNotNull() & (F.col("top") > 0)
        & (F.col("top") < float("inf")) & ~F.exists("v", lambda x: x.isNull())
    )
    scaled = F.transform(value, lambda x: x / F.col("top"))
    rows = rows.select("id", "label", F.when(sound, F.struct(scaled.alias("s"))).alias("s"))
    length = F.sqrt(F.aggregate("s.s", F.lit(0.0), lambda t, x: t + x * x))
    good = rows.filter("s is not null").withColumn("length", length)
    good = good.select("id", "label", F.expr("transform(s.s, x -> x / length + 0.0D)").alias("unit"))
    members = cut(good.withColumn("class", F.struct("label", F.sha2(F.array_join(F.transform("unit", lambda x: x.cast("string")), ","), 256).alias("h"))))
    classes = cut(
        members.groupBy("class").agg(F.min("id").alias("vec"), F.count("*").alias("copies"), F.any_value("unit").alias("unit"))
        .select("vec", "copies", "unit", F.col("class.label").alias("label"), F.col("class.h").alias("h"), F.size("unit").alias("dim"))
    )
    return _finish(rows, members, classes, _links(classes, bound, cosine, block), id_col)


def _distance(one: str, other: str) -> Column:
    return F.expr(f"sqrt(greatest(0.0D, 2.0D - 2.0D * aggregate(zip_with({one}, {other}, (s, t) -> s * t), 0.0D, (s, t) -> s + t)))")


def _grown(classes: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``(members, nodes)``: every vector with its leaf, and the nodes above the blocks.

    Nodes that hold more than ``block`` vectors are split, each vector to the nearest of up to
    ``PIVOTS`` pivots drawn from the node, round after round: there are as many levels as the largest label asks for.
    A node is named after its label, dimension and place; ``r`` is the distance from its centre to the farthest member.
    """
    here = F.concat_ws("|", F.col("label").cast("string"), F.col("dim").cast("string"), F.lit(""))
    waiting = classes.select(here.alias("node"), "vec", "copies", "unit", "h")
    roots = waiting.groupBy("node").agg(F.min_by("unit", "h").alias("c")).withColumns({"parent": F.lit(None).cast("string"), "r": F.lit(2.0)})
    settled, nodes, level = [], [roots.select("node", "parent", "c", "r")], 0
    while True:
        sizes = cut(waiting.groupBy("node").agg(F.count("*").alias("n"), F.min("h").alias("least"), F.max("h").alias("most")))
        big = sizes.filter(F.col("n") > block)
        settled.append(waiting.join(big, "node", "left_anti"))
        if big.isEmpty():
            break
        # The first and the last by digest are always among the pivots, so every split makes progress.
        drawn = F.pmod(F.xxhash64("h", F.lit(level)), F.lit(1 << 30)) * F.col("n") < F.least(F.ceil(F.col("n") * 2 / block), F.lit(PIVOTS)) * float(1 << 30)
        crowd = waiting.join(big, "node")
        chosen = crowd.filter(drawn | (F.col("h") == F.col("least")) | (F.col("h") == F.col("most")))
        pivots = cut(chosen.groupBy("node").agg(F.expr("transform(array_sort(collect_list(struct(h, unit))), p -> p.unit)").alias("pivots")))
        apart = F.expr(
            "transform(pivots, p -> sqrt(greatest(0.0D, 2.0D - 2.0D * aggregate(zip_with(p, unit, (s, t) -> s * t), 0.0D, (s, t) -> s + t))))"
        )
        moved = waiting.join(pivots, "node").withColumn("apart", apart).withColumn("near", F.array_min("apart"))
        # Pivots that are equally near share what is nearest to them, so that a crowd of all but equal vectors is split too.
        near = F.expr(f"filter(sequence(0, size(apart) - 1), i -> apart[i] <= near + {TIE!r}D)")
        moved = moved.withColumn("same", near).withColumn("p", F.get("same", F.pmod(F.xxhash64("h", F.lit(level)), F.size("same")).cast("int")))
        waiting = cut(
            moved.select(
                F.col("node").alias("parent"), F.concat("node", F.lit("."), F.col("p").cast("string")).alias("node"),
                "vec", "copies", "unit", "h", F.get("apart", F.col("p")).alias("near"), F.get("pivots", F.col("p")).alias("c"),
            )
        )
        nodes.append(waiting.groupBy("node", "parent").agg(F.any_value("c").alias("c"), (F.max("near") + SLACK).alias("r")).select("node", "parent", "c", "r"))
        waiting = waiting.select("node", "vec", "copies", "unit", "h")
        level += 1
    members, table = settled[0], nodes[0]
    for more in settled[1:]:
        members = members.unionByName(more)
    for more in nodes[1:]:
        table = table.unionByName(more)
    return cut(members), cut(table)


def _meeting(nodes: DataFrame, bound: float) -> DataFrame:
    """``(a, b)``: leaves, ``a <= b``, that may hold a pair of linked vectors; by dual traversal from the roots."""
    inner = nodes.select(F.col("parent").alias("node")).filter("node is not null").distinct()
    leaves = nodes.join(inner, "node", "left_anti")
    # A leaf is its own child, so that both sides of a pair go down by one level together.
    kids = cut(nodes.filter("parent is not null").unionByName(leaves.withColumn("parent", F.col("node"))))
    left, right = (kids.select(F.col("parent").alias(f"p{s}"), F.col("node").alias(s), F.col("c").alias(f"c{s}"), F.col("r").alias(f"r{s}")) for s in "ab")
    pairs = cut(nodes.filter("parent is null").select(F.col("node").alias("pa"), F.col("node").alias("pb")))
    while True:
        down = pairs.join(left, "pa").join(right, "pb").filter((F.col("pa") != F.col("pb")) | (F.col("a") <= F.col("b")))
        near = down.filter((F.col("a") == F.col("b")) | (_distance("ca", "cb") <= F.col("ra") + F.col("rb") + bound))
        pairs = cut(near.select(F.least("a", "b").alias("pa"), F.greatest("a", "b").alias("pb")))
        if all(pairs.join(inner, pairs[side] == inner["node"], "left_semi").isEmpty() for side in ("pa", "pb")):
            return pairs.select(F.col("pa").alias("a"), F.col("pb").alias("b"))


def _links(classes: DataFrame, bound: float, cosine: float, block: int) -> DataFrame:
    """Per class and block: links counted and the smallest class reached.

    For two leaves that meet, the vectors of one that come within reach of the other go there; which of the
    two is decided by a hash, so that no leaf gets all of them.
    """
    members, nodes = _grown(classes, block)
    pairs = _meeting(nodes, bound).filter("a <> b")
    turned = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
    ways = pairs.select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("cell"))
    goals = nodes.select(F.col("node").alias("cell"), "c", "r")
    foreign = members.join(ways.join(goals, "cell"), "node").filter(_distance("unit", "c") <= F.col("r") + bound)
    foreign = foreign.select("cell", F.lit(1).alias("kind"), "vec", "copies", "unit")
    own = members.select(F.col("node").alias("cell"), F.lit(0).alias("kind"), "vec", "copies", "unit")
    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(foreign).repartition(width, "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(_scan(cosine, block), "vec long, links long, root long")


def _finish(rows: DataFrame, members: DataFrame, classes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    found = cut(links)
    counts = found.groupBy("vec").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")))
    table = cut(
        classes.select("vec", "copies", "label", "h").join(counts, "vec", "left")
        .join(roots.withColumnRenamed("node", "vec"), "vec", "left")
        .select(
            F.struct("label", "h").alias("class"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("root", "vec").alias("root"),
        )
    )
    linked = members.select("id", "class").join(table, "class").select("id", "links", "root")
    alone = rows.filter("s is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("root"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("root").alias("component_id"),
        F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"),
    )
