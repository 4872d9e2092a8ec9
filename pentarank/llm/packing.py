"""Packing of documents into training sequences.

Documents are tokenised where they are, cut into pieces of at most a sequence, and only the
pieces' lengths and digests move: to randomised groups, each packed on its own by first-fit
decreasing. A tournament tree over the bins' free room finds the first bin that fits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pentarank.llm.common import spread
from pentarank.llm.vocabulary import word_ids

GROUP_DOCS = 4096
COPIES = 4096
PIECE_SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """Free room of bins in a complete binary tree; a node holds the larger of its two."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take ``size`` from the first bin that has it and return that bin."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            room = max(best[2 * node], best[2 * node + 1])
            if room == best[node]:
                break
            best[node] = room
        return found


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset in the bin)`` of each size; equal sizes go in the order given."""
    order = np.argsort(-sizes, kind="stable")
    tree = Tournament(max(1, len(sizes)), room)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used = np.zeros(max(1, len(sizes)), np.int64)
    for k in order.tolist():
        b = tree.place(int(sizes[k]))
        bins[k], offsets[k] = b, used[b]
        used[b] += sizes[k]
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer_path: str, room: int, end_id: int) -> DataFrame:
    """Pieces ``(id, start, length, ids_crc32, doc_tokens)`` of documents ``(id, text)``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path).encode
        schema = pa.schema([(n, pa.int64()) for n in ("id", "start", "length", "ids_crc32", "doc_tokens")])
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                rows += [
                    (key.as_py(), s, min(room, total - s), zlib.crc32(ids[4 * s : 4 * (s + room)]), total)
                    for s in range(0, total, room)
                ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return docs.mapInArrow(run, PIECE_SCHEMA)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    room: int = 4096,
    end_id: int = 2,
    group_docs: int = GROUP_DOCS,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces with their place: ``sequence_id`` and ``offset`` in it, besides what ``cut_pieces`` tells.

    A document is its ids and ``end_id``; NULL and empty texts are the end alone. It is cut
    every ``room`` ids; whole pieces fill a sequence each, the rest is packed. Groups hold
    about ``group_docs`` documents, dealt by a hash of id, length and digest, and copies of one piece, counted
    before they move, by their number too: no group grows with them, and the result
    does not depend on Spark's partitions. Every row is packed, repeated rows too; NULL ids
    stay NULL. An empty table gives no rows. ``sequence_id`` is the group's number times
    2^32 plus the bin's. Counts the rows of ``docs`` first.
    """
    groups = max(1, -(-docs.count() // group_docs))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = cut_pieces(rows, tokenizer_path, room, end_id)
    counted = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("copies"))
    # In blocks, so that no array grows with the number of copies.
    blocks = counted.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    each = blocks.withColumn("copy", F.explode(F.expr(f"sequence(block * {COPIES}L, least(copies, (block + 1) * {COPIES}L) - 1)")))
    # The first copy goes where a piece without copies would.
    number = F.when(F.col("copy") > 0, F.col("copy"))
    grp = F.pmod(F.xxhash64("id", "doc_tokens", "ids_crc32", F.lit(seed), number), F.lit(groups))
    pieces = each.select(*pieces.columns, grp.alias("grp"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "id", "start", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), room)
        return part.assign(sequence_id=part["grp"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns="grp")

    packed = spread(pieces, "grp").groupBy("grp").applyInPandas(pack, f"{PIECE_SCHEMA}, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
