"""SimHash near-duplicates: fingerprints, and a self-join of their binary trie.

The trie is traversed as pairs of nodes. A pair carries the number of bits in which its two
prefixes differ and is dropped once that exceeds the budget. Two tries are walked, one over
the fingerprint's bits in order and one that starts at bit 32: of at most three differing
bits one half holds at most one, so each walk needs a budget of ``distance // 2`` in its
first half. Every pair within the distance is met by at least one of the two walks.

The first bits of the trie deal the work out: a fingerprint goes to the cell of its prefix
and to the cells it shares with each prefix within the first half's budget. Prefixes of
more than ``BLOCK`` fingerprints are split into blocks, every pair of which is a cell, so a
task's memory is bounded however alike the texts are.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pentarank.llm.common import WORD_PATTERN, cut, lower_ascii, spread
from pentarank.llm.links import components, forest

SEED = 42
BITS = 64
HALF = 32
BLOCK = 4096
CHUNK = 1 << 15
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def fingerprint(text: str, shingle: int, word=re.compile(WORD_PATTERN)) -> int:
    """64-bit SimHash of a text that is lower-cased already; 0 when it has no word."""
    found = word.findall(text)
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < shingle:
        return digest(" ".join(found).encode(), SEED)
    grams = map(" ".join, zip(*(itertools.islice(found, i, None) for i in range(shingle))))
    count = len(found) - shingle + 1
    sums = np.zeros(BITS, dtype=np.int64)
    while block := [digest(g.encode(), SEED) for g in itertools.islice(grams, CHUNK)]:
        raw = np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * sums > count).tolist())


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed long, computed where the rows are."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return docs.withColumn("fp", hashed(lower_ascii(F.coalesce(F.col(text_col), F.lit("")))))


def _popcount(x: np.ndarray) -> np.ndarray:
    return _POPCOUNT[x.view(np.uint8).reshape(len(x), 8)].sum(axis=1, dtype=np.int64)


def trie_pairs(left: np.ndarray, right: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted fingerprints within ``distance`` bits and the first half's budget.

    ``right`` is None for the trie against itself. A node is a range of the sorted array, so
    a level costs a few vector operations over the pairs of nodes that are left.
    """
    own = right is None
    right = left if own else right
    budget = distance // 2
    top = np.array([0])
    nodes = (top, top + len(left), top, top + len(right), top)
    for depth in range(BITS):
        lo_a, hi_a, lo_b, hi_b, wrong = nodes
        small = (hi_a - lo_a) * (hi_b - lo_b) <= 16
        if small.any():
            yield from _compare(left, right, [x[small] for x in nodes], distance, depth, own)
            nodes = lo_a, hi_a, lo_b, hi_b, wrong = tuple(x[~small] for x in nodes)
        if not len(lo_a):
            return
        shift = np.uint64(BITS - 1 - depth)
        zeros_a = np.concatenate(([0], np.cumsum((left >> shift) & np.uint64(1) == 0)))
        zeros_b = zeros_a if own else np.concatenate(([0], np.cumsum((right >> shift) & np.uint64(1) == 0)))
        mid_a = lo_a + zeros_a[hi_a] - zeros_a[lo_a]
        mid_b = lo_b + zeros_b[hi_b] - zeros_b[lo_b]
        same = (lo_a == lo_b) & own
        parts = [
            (lo_a, mid_a, lo_b, mid_b, wrong, None),
            (mid_a, hi_a, mid_b, hi_b, wrong, None),
            (lo_a, mid_a, mid_b, hi_b, wrong + 1, None),
            (mid_a, hi_a, lo_b, mid_b, wrong + 1, ~same),
        ]
        limit = budget if depth < HALF else distance
        kept = []
        for a, b, c, d, e, also in parts:
            keep = (a < b) & (c < d) & (e <= limit)
            if also is not None:
                keep &= also
            kept.append([x[keep] for x in (a, b, c, d, e)])
        nodes = tuple(np.concatenate(x) for x in zip(*kept))
    lo_a, hi_a, lo_b, hi_b, wrong = nodes  # equal prefixes of all bits: equal fingerprints
    yield from _compare(left, right, list(nodes), distance, BITS, own)


def _compare(left, right, nodes, distance: int, depth: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare all members of small node pairs, a bounded number of pairs at a time."""
    lo_a, hi_a, lo_b, hi_b, _ = nodes
    size = (hi_a - lo_a) * (hi_b - lo_b)
    ends = np.cumsum(size)
    for start in range(0, len(size), 1 << 16):
        part = slice(start, start + (1 << 16))
        which = np.repeat(np.arange(len(size))[part], size[part])
        at = np.arange(len(which)) + (ends[start] - size[start]) - (ends - size)[which]
        width = (hi_b - lo_b)[which]
        i, j = lo_a[which] + at // width, lo_b[which] + at % width
        if own:
            keep = i < j
            i, j = i[keep], j[keep]
        off = left[i] ^ right[j]
        top = _popcount(np.ascontiguousarray(off >> np.uint64(HALF)))
        keep = (top <= distance // 2) & (_popcount(off) <= distance)
        yield i[keep], j[keep]


def _turn(values: np.ndarray, order: int) -> np.ndarray:
    half = np.uint64(HALF)
    return (values << half) | (values >> half) if order else values


def _cell(distance: int):
    """Forest edges of one cell: the fingerprints of one block, or of two blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        order = int(rows["ord"].iloc[0])
        values = _turn(rows["fp"].to_numpy(np.int64).view(np.uint64), order)
        second = rows["second"].to_numpy(bool)
        first = np.sort(values[~second])
        other = np.sort(values[second]) if rows["two"].iloc[0] else None
        both = first if other is None else np.concatenate([first, other])
        offset = 0 if other is None else len(first)
        root = np.arange(len(both))
        for i, j in trie_pairs(first, other, distance):
            if len(i):
                # roots so far stand in for the pairs seen before
                root = forest(np.concatenate([i, np.arange(len(both))]), np.concatenate([j + offset, root]), len(both))
        moved = np.flatnonzero(root != np.arange(len(both)))
        plain = _turn(both, order).view(np.int64)
        return pd.DataFrame({"a": plain[moved], "b": plain[root[moved]]})

    return run


def fingerprint_links(fps: DataFrame, count: int, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges ``a, b`` that connect every two of the distinct ``fp`` within ``distance`` bits.

    A spanning set: each cell returns the forest of its pairs, never all pairs. ``count`` is
    the number of fingerprints; it only sets how many leading bits deal the work out.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3: the first half's budget is at most one bit")
    bits = min(24, max(4, math.ceil(math.log2(max(count, 1) / (block // 8)))) if count else 4)
    orders = F.explode(F.array(F.lit(0), F.lit(1)))
    turned = F.when(F.col("ord") == 1, F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))).otherwise(F.col("fp"))
    placed = fps.select("fp", orders.alias("ord")).withColumn(
        "prefix", F.shiftrightunsigned(turned, BITS - bits).cast("int")
    )
    # Blocks per prefix, for prefixes that hold too many for one task.
    sizes = cut(
        placed.groupBy("ord", "prefix").count()
        .select("ord", F.col("prefix").alias("near"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    )
    own_sizes = sizes.select("ord", F.col("near").alias("prefix"), F.col("blocks").alias("own_blocks"))
    flips = [F.col("prefix")] + [F.col("prefix").bitwiseXOR(F.lit(1 << i)) for i in range(bits) if distance >= 2]
    reach = (
        placed.join(own_sizes, ["ord", "prefix"])
        .withColumn("slot", F.pmod(F.xxhash64("fp"), F.col("own_blocks")).cast("int"))
        .withColumn("near", F.explode(F.array(*flips)))
        .join(sizes, ["ord", "near"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    mine, theirs = F.struct("prefix", "slot"), F.struct(F.col("near").alias("prefix"), F.col("other").alias("slot"))
    cells = reach.select(
        "ord", "fp", F.least(mine, theirs).alias("x"), F.greatest(mine, theirs).alias("y"), (mine > theirs).alias("second"),
        (mine != theirs).alias("two"),
    )
    return spread(cells, "ord", "x", "y").groupBy("ord", "x", "y").applyInPandas(_cell(distance), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row of ``docs``, by linked fingerprints.

    ``component_id`` is the smallest id reachable over fingerprints that differ in at most
    ``distance`` bits. Texts of equal fingerprint form one class and are linked once, so copies
    cost one fingerprint. NULL and blank texts have fingerprint zero and are linked like any
    other. Texts of fewer words than ``shingle`` hash their whole word sequence. Repeated rows
    are all returned; a NULL id is returned with the component its text belongs to. Other
    columns are ignored. Runs jobs while it builds the result.
    """
    rows = with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle)
    rows = cut(rows.select("id", "fp"))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    edges = fingerprint_links(classes.select("fp"), classes.count(), distance)
    roots = components(edges)
    placed = cut(
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    )
    least = cut(placed.groupBy("root").agg(F.min("least_id").alias("component_id")))
    # Written before the last joins: these then read plain exchanges, which can be split.
    table = cut(placed.join(least, "root").select("fp", "component_id"))
    return rows.join(table, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: the row with the smallest id.

    Of several rows with that same id one stays. A row whose id is NULL cannot be told from
    others, so it stays. All columns are kept.
    """
    groups = near_duplicates(docs, id_col, text_col, shingle, distance)
    kept = cut(
        groups.filter(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n"))
    )
    # The caller's columns travel in one struct, so their names meet no others.
    rows = docs.select(F.struct("*").alias("_row"))
    stay = rows.join(kept, F.col("_row")[id_col] == F.col("_id"))
    once = stay.filter("_n = 1").select("_row")
    if not kept.filter("_n > 1").isEmpty():
        once = once.unionByName(stay.filter("_n > 1").dropDuplicates(["_id"]).select("_row"))
    return once.unionByName(rows.filter(F.col("_row")[id_col].isNull())).select("_row.*")
