"""Removal of repeated word passages, by prefix-partitioned suffix trees.

A suffix matters only up to the window's length, so the trees are cut off there: a window is repeated when
its leaf lies below an internal node at least that deep. The suffixes are split by prefixes
of two lengths. Ordinary groups share the window's minimiser: of its eight-word strings
the one that hashes lowest, which every copy of the window has too. Consecutive windows of
one minimiser travel together, as one stretch of text. A minimiser with more than ``HOT``
stretches would not make a memory-sized group: its windows are split by their
whole length instead, where a group is one node of the tree and needs no more than a count.

Only minimisers that occur twice are followed, so text moves for passages that may repeat,
not for all suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pentarank.llm.common import fresh_folder, spread

WINDOW = 35
GRAM = 8
STRETCH = 32
HOT = 256
BATCH = 16_384
SALTS = 16
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def minimisers(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, keys, times)``: first window of each stretch, the minimiser its windows share,
    and how often that string occurs in the text, which may be within one stretch.

    A stretch has at most ``STRETCH`` windows. Fewer words than a window give none.
    """
    gram = min(GRAM, window)
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * STEP + hashed[k : k + len(grams)]
    grams = (grams ^ (grams >> np.uint64(31))) * MIX
    least, reach = grams, 1
    wide = window - gram + 1
    while reach * 2 <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(words) - window + 1], least[wide - reach :])
    new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    inside = np.arange(len(least)) - np.repeat(new, np.diff(np.append(new, len(least))))
    starts = np.flatnonzero(inside % STRETCH == 0)
    keys, ordered = least[starts], np.sort(grams)
    return starts, keys, np.searchsorted(ordered, keys, side="right") - np.searchsorted(ordered, keys)


def repeated_windows(stretches: list[bytes], window: int) -> list[int]:
    """For each stretch a bit mask of its windows whose words start elsewhere among ``stretches``.

    The suffix tree is built breadth first, its nodes' depths doubling: a node is a class of equal
    strings, a node of depth ``2 d`` two nodes of depth ``d`` one after the other. A suffix that is alone
    in its class is a leaf and is not followed further.
    """
    known: dict[bytes, int] = {}
    split = [s.split() for s in stretches]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    total = int(sizes.sum())
    node = np.fromiter((known.setdefault(w, len(known)) for s in split for w in s), np.int64, total)
    ends = np.repeat(np.cumsum(sizes), sizes)
    room = ends - np.arange(total)
    alive, depth = np.arange(total), 1
    counts = np.bincount(node)
    node = np.where(counts[node] > 1, node, -1)
    while depth < window:
        reach = min(depth, window - depth)
        alive = alive[(room[alive] >= depth + reach)]
        alive = alive[(node[alive] >= 0) & (node[alive + reach] >= 0)]
        below = np.full(total, -1, np.int64)
        if len(alive):
            pair = node[alive] * (int(node.max()) + 1) + node[alive + reach]
            _, child, counts = np.unique(pair, return_inverse=True, return_counts=True)
            shared = counts[child] > 1
            below[alive[shared]] = child[shared]
            alive = alive[shared]
        node, depth = below, depth + reach
    firsts = np.cumsum(sizes) - sizes
    owner = np.searchsorted(firsts, alive, side="right") - 1
    masks = np.zeros(len(split), np.int64)
    np.bitwise_or.at(masks, owner, np.int64(1) << (alive - firsts[owner]))
    return masks.tolist()


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    """``(id, mark, v, n)``: the minimisers of each row and how often they occur in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                keys, counts = [], []
                for text in part.column(2):
                    _, found, times = minimisers(text.as_py().encode().split(), window)
                    got, first, n = np.unique(found, return_index=True, return_counts=True)
                    keys.append(got.view(np.int64))
                    counts.append(np.maximum(n, times[first]).astype(np.int32))
                rows = pa.array(np.repeat(np.arange(len(part)), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))],
                    ["id", "mark", "v", "n"],
                )

    return rows.select("id", "mark", "text").mapInArrow(run, f"{_id(rows)}, mark long, v long, n int")


def _id(rows: DataFrame) -> str:
    return f"id {rows.schema['id'].dataType.simpleString()}"


def _stretches(joined: DataFrame, window: int, keys_col: str) -> DataFrame:
    """``(id, mark, start, v, words)`` of the stretches of the minimisers listed in ``keys_col``.

    Texts without any are not even split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            rows = []
            schema = schema or pa.schema([("id", batch.schema.field(0).type), ("mark", pa.int64()), ("start", pa.int32()), ("v", pa.int64()), ("words", pa.string())])
            for key, mark, text, listed in zip(*batch.columns):
                if not listed.is_valid or not len(listed):
                    continue
                words = text.as_py().encode().split()
                starts, keys, _ = minimisers(words, window)
                keys = keys.view(np.int64)
                ends = np.append(starts[1:], len(words) - window + 1)
                follow = np.isin(keys, listed.values.to_numpy())
                for k in np.flatnonzero(follow).tolist():
                    s = int(starts[k])
                    rows.append((key.as_py(), mark.as_py(), s, int(keys[k]), b" ".join(words[s : int(ends[k]) + window - 1]).decode()))
                if len(rows) > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return joined.select("id", "mark", "text", keys_col).mapInArrow(
        run, f"{_id(joined)}, mark long, start int, v long, words string"
    )


def _tree_masks(cold: DataFrame, window: int) -> DataFrame:
    """``(id, mark, start, mask)`` of stretches, a suffix tree for some groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def masks(table: pa.Table) -> Iterator[pa.RecordBatch]:
            found = np.array(repeated_windows([w.encode() for w in table["words"].to_pylist()], window), np.int64)
            some = pa.array(found != 0)
            out = table.select(["id", "mark", "start"]).append_column("mask", pa.array(found)).filter(some)
            yield from out.combine_chunks().to_batches()

        rows = 0
        for batch in batches:
            for lo in range(0, len(batch), BATCH):
                part = batch.slice(lo, BATCH)
                held.append(part)
                rows += len(part)
                if rows < BATCH:
                    continue
                table = pa.Table.from_batches(held)
                v = table["v"].to_numpy()
                cut = int(np.searchsorted(v, v[-1]))  # the last group may go on
                if cut:
                    yield from masks(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows = len(table) - cut
        if rows:
            yield from masks(pa.Table.from_batches(held))

    dealt = spread(cold, "v").sortWithinPartitions("v")
    return dealt.select("id", "mark", "start", "v", "words").mapInArrow(run, f"{_id(cold)}, mark long, start int, mask long")


def _counted_masks(hot: DataFrame, window: int) -> DataFrame:
    """``(id, mark, start, mask)`` of stretches whose windows are split by their whole length."""
    keyed = hot.select("id", "mark", "start", F.unhex(F.md5("words")).alias("key"), "words")
    texts = keyed.groupBy("key", "words").agg(F.count("*").alias("n"))
    windows = texts.select("key", "n", F.split("words", " ").alias("w")).select(
        "key", "n",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - window), lambda i: F.unhex(F.md5(F.array_join(F.slice("w", i + 1, window), " "))))).alias("at", "leaf"),
    )
    nodes = windows.groupBy("leaf").agg(F.sum("n").alias("n")).filter("n > 1").select("leaf")
    found = _salted_join(windows.select("key", "at", "leaf"), nodes, "leaf", ["key", "at"])
    masks = found.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    placed = _salted_join(keyed.select("id", "mark", "start", "key"), masks, "key", ["id", "mark", "start"])
    return placed.select("id", "mark", "start", "mask")


def _salted_join(many: DataFrame, one: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    """Join on ``key``, which one value may have in a third of ``many``'s rows but once in ``one``.

    Such rows are dealt to ``SALTS`` tasks, to each of which the row of ``one`` goes.
    """
    left = many.withColumn("salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    right = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "salt"]).drop("salt")


def _kept(joined: DataFrame, window: int) -> DataFrame:
    """What is left of each text without the words its repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, repeated in zip(batch.column(1), batch.column(2)):
                words = text.as_py().encode().split()
                kept = words
                if repeated.is_valid:
                    marks = np.array([(r["start"], r["mask"]) for r in repeated.as_py()], np.int64)
                    edges = np.zeros(len(words) + 1, np.int64)
                    for bit in range(STRETCH):
                        at = marks[marks[:, 1] >> bit & 1 == 1, 0] + bit
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + window, -1)
                    covered = np.cumsum(edges[:-1]) > 0
                    kept = [words[k] for k in np.flatnonzero(~covered).tolist()]
                text_left = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text_left).hexdigest(), text_left.decode()))
            n, removed, digest, left = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.string())],
                ["id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return joined.select("id", "text", "repeated").mapInArrow(
        run, f"{_id(joined)}, n_words long, n_removed long, kept_sha256 string, kept string"
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, kept)`` of every row of ``docs``.

    A word is removed when a window of ``window`` consecutive words covers it whose words also
    start anywhere else, in the same text or another; windows are judged on the input. Words
    are separated by ASCII white space and compared as they are. Texts are read whole. NULL
    and blank texts have no words; texts shorter than a window lose none. Repeated rows are
    texts of their own, so they are copies of each other. Other columns are ignored.

    ``kept`` is the text that stays, its words joined by one space. Minimisers are written to the shared
    folder first. The rest is one plan, in which the texts are dealt out once by id and digest
    and read from that exchange three times.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("mark"))
    folder = fresh_folder(spark, "minimisers")
    _anchors(rows, window).write.parquet(folder)
    anchors = spark.read.parquet(folder)
    twice = anchors.groupBy("v").agg(F.sum("n").alias("total")).filter("total > 1")
    followed = (
        anchors.join(twice, "v").groupBy(F.col("id").alias("i"), F.col("mark").alias("m"))
        .agg(
            # Sets: rows of equal id and text, NULL ids for example, say the same and count once.
            F.collect_set(F.when(F.col("total") <= hot, F.col("v"))).alias("cold"),
            F.collect_set(F.when(F.col("total") > hot, F.col("v"))).alias("warm"),
        )
    )
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))
    joined = rows.join(followed.hint("shuffle_hash"), same, "left")
    masks = _tree_masks(_stretches(joined, window, "cold"), window).unionByName(
        _counted_masks(_stretches(joined, window, "warm"), window)
    )
    repeated = masks.groupBy(F.col("id").alias("i"), F.col("mark").alias("m")).agg(
        F.collect_set(F.struct("start", "mask")).alias("repeated")
    )
    return _kept(rows.join(repeated.hint("shuffle_hash"), same, "left"), window).withColumnRenamed("id", id_col)
