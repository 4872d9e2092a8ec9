"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct shingles, each partition's upper
bound a power of two. An item's sketch is its smallest shingle hashes, as many as its
partition's bound leaves unmatched at the wanted containment, and one more: a document that
holds enough of the item's shingles holds at least one of these, so the search misses nothing. Documents
are probed whole, by one pass over their shingle hashes. Candidate pairs are then verified
by the exact containment of the shingles themselves, as text.

Estimating containment from MinHash bands, as for sets of like size, would lose nearly all
items here: a short item inside a long document has almost no Jaccard similarity to it.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentarank.llm.common import cut, lower_ascii, words

SHINGLE = 5
CONTAINMENT = 0.8
# Rows up to which a table is sent to all executors; a row is under 100 bytes.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, computed once, marked for broadcast if it is counted to be small enough."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingles(parts: Column, size: int, join) -> Column:
    """``join`` of each ``size`` consecutive words; fewer words give none."""
    made = F.transform(
        F.sequence(F.lit(0), F.size(parts) - size), lambda i: join([F.get(parts, i + k) for k in range(size)])
    )
    return F.when(F.size(parts) >= size, made)


def _hashes(parts: Column, size: int) -> Column:
    return _shingles(parts, size, lambda w: F.xxhash64(*w))


def _texts(parts: Column, size: int) -> Column:
    return _shingles(parts, size, lambda w: F.concat_ws(" ", *w))


def _of_widths(make, parts: Column, widths: list[int]) -> Column:
    """Shingles of several widths in one array."""
    none = F.slice(make(parts, widths[0]), 1, 0)
    return F.concat(*[F.coalesce(make(parts, width), none, F.array()) for width in widths])


def item_sets(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(key, item_id, width, shingles)`` of the items that have a word; repeated rows count once.

    An item of fewer words than ``size`` is one shingle of all its words; ``width`` is its shingles' number of words.
    """
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    parts = rows.select("item_id", F.xxhash64("item_id", "text").alias("key"), words(lower_ascii(F.col("text"))).alias("w"))
    made = F.coalesce(F.array_distinct(_texts(F.col("w"), size)), F.array(F.array_join("w", " ")))
    width = F.least(F.size("w"), F.lit(size))
    return parts.filter("size(w) > 0").select("key", "item_id", width.alias("width"), made.alias("shingles"))


def sketches(sets: DataFrame, size: int, containment: float) -> DataFrame:
    """``(key, h)``: the sketch of every item, its length set by the item's partition."""
    # ceil() of products like 0.8 * 15 must not be pushed up by rounding.
    bounds = [2**k - 1 for k in range(1, 31)]
    length = F.lit(None).cast("int")
    for bound in reversed(bounds):
        needed = math.ceil(containment * bound - 1e-9)
        length = F.when(F.size("shingles") <= bound, F.lit(bound - needed + 1)).otherwise(length)
    # Missing words leave a hash as it is, so shorter shingles hash as those of their own width do.
    hashes = F.transform("shingles", lambda s: F.xxhash64(*[F.get(F.split(s, " "), F.lit(k)) for k in range(size)]))
    return sets.select("key", F.explode(F.slice(F.array_sort(hashes), F.lit(1), length)).alias("h")).distinct()


def containments(
    docs: DataFrame,
    items: DataFrame,
    size: int = SHINGLE,
    containment: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(id, mark, item_id, n_shared, n_item, containment)`` of every document and item it holds.

    Shingles are ``size`` words, A-Z lower-cased, each counted once per text; the containment is
    the share of the item's shingles that the document has. ``mark`` hashes the document's
    text: it tells rows of equal id apart. An item of fewer words than ``size`` is one shingle of all its
    words, found wherever they follow each other; items without words are in no document, and NULL, empty and blank
    documents hold nothing. Repeated rows of either table count once; several texts of one item id give its best match. NULL
    ids are kept. Other columns are ignored. Runs jobs while it builds the result.

    Sketches and candidates are broadcast only when counted to be small; beyond that the joins are
    ordinary ones, which adaptive execution splits where an item or shingle is hot.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = rows.select("id", "mark", lower_ascii(F.col("text")).alias("low"))
    sets = cut(item_sets(items, size, item_id_col, item_text_col))
    # At most ``size`` widths, and only those that occur are looked for.
    widths = sorted({size, *[row.width for row in sets.select("width").distinct().collect()]}, reverse=True)
    probes = rows.select("id", "mark", words(F.col("low")).alias("w"))
    probes = probes.select("id", "mark", F.explode(_of_widths(_hashes, F.col("w"), widths)).alias("h"))
    found = probes.join(_small(sketches(sets, size, containment)), "h").select("id", "mark", "key").distinct()
    found = _small(found.select(F.col("id").alias("i"), F.col("mark").alias("m"), "key"))
    texts = rows.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")))
    texts = texts.select("id", "mark", "key", words(F.col("low")).alias("w"))
    texts = texts.select("id", "mark", "key", _of_widths(_texts, F.col("w"), widths).alias("all"))
    pairs = texts.join(sets, "key").select(
        "id", "mark", "item_id",
        F.size(F.array_intersect("all", "shingles")).alias("n_shared"), F.size("shingles").alias("n_item"),
    )
    pairs = pairs.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    held = pairs.filter(F.col("n_shared") >= containment * F.col("n_item") - 1e-9)
    best = held.groupBy("id", "mark", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("best"))
    return best.select("id", "mark", "item_id", "best.n_shared", "best.n_item", "best.containment").withColumnRenamed("id", id_col)


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that hold no item, with all their columns."""
    # The caller's columns travel in one struct, so their names meet no others.
    rows = docs.select(F.struct("*").alias("_row"))
    hits = containments(docs, items, id_col=id_col, text_col=text_col, **options)
    hits = _small(hits.select(F.col(id_col).alias("_i"), F.col("mark").alias("_m")).distinct())
    row = F.col("_row")
    same = row[id_col].eqNullSafe(F.col("_i")) & (F.xxhash64(row[text_col]) == F.col("_m"))
    return rows.join(hits, same, "left_anti").select("_row.*")
