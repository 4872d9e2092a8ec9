"""Document fingerprints: Merkle trees over the paragraphs and sections of a text.

A paragraph ends after a line break or the end of a sentence or clause, with at least 16 characters
before it, or after 200 characters without one; paragraphs join to the whole text. A section ends
after a blank line or a paragraph whose digest starts with 0, so sections hold about 16
paragraphs and an edit moves no boundary beyond its own surroundings. A section's digest covers
those of its paragraphs, the root covers those of the sections.

A fingerprint is a string, ``root/section:paragraph:paragraph/section:...``: the root in full,
the branches cut to ten digits. Equal texts have equal roots; where roots differ, only
branches that differ need be looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pentarank.functions.arrays import let
from pentarank.llm.common import cut

# Written for Java's and RE2's regular expressions alike.
_SPACE = r"[ \t\n\x0B\f\r]"
PARAGRAPH = rf"(?s).{{16,200}}?(?:[.!?;|,]{_SPACE}+|\n+|\z)|.{{200}}|.{{1,200}}\z"
BLANK_LINE = r"\n[ \t\r]*\n"
BRANCH_DIGITS = 10
COPIES = 4096


def _branch(digest: Column) -> Column:
    return F.substring(digest, 1, BRANCH_DIGITS)


def _serialised(paragraphs: Column) -> Column:
    """The fingerprint from ``array<struct<digest, last>>``; ``last`` marks the end of a section."""

    def assemble(ends: Column) -> Column:
        def section(end: Column, k: Column) -> Column:
            start = F.coalesce(F.get(ends, k - 1), F.lit(0))
            digests = F.transform(F.slice(paragraphs, start + 1, end - start), lambda p: p["digest"])
            return F.struct(
                F.sha2(F.concat(F.lit("s"), F.array_join(digests, "")), 256).alias("digest"),
                F.array_join(F.transform(digests, _branch), ":").alias("under"),
            )

        def whole(sections: Column) -> Column:
            root = F.sha2(F.concat(F.lit("r"), F.array_join(F.transform(sections, lambda s: s["digest"]), "")), 256)
            parts = F.transform(sections, lambda s: F.concat(_branch(s["digest"]), F.lit(":"), s["under"]))
            return F.array_join(F.concat(F.array(root), parts), "/")

        return let(F.transform(ends, section), whole)

    count = F.size(paragraphs)
    numbered = F.transform(paragraphs, lambda p, i: F.struct(p["last"].alias("last"), (i + 1).alias("at")))
    ends = F.transform(F.filter(numbered, lambda p: p["last"] | (p["at"] == count)), lambda p: p["at"])
    return let(ends, assemble)


def fingerprint(text: Column | str) -> Column:
    """Fingerprint of a whole text; NULL counts as empty, an empty text has a root alone."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def paragraph(piece: Column) -> Column:
        return let(
            F.sha2(piece, 256),
            lambda d: F.struct(d.alias("digest"), (F.startswith(d, F.lit("0")) | F.regexp_like(piece, F.lit(BLANK_LINE))).alias("last")),
        )

    pieces = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return let(F.transform(pieces, paragraph), _serialised)


def root(fingerprint: Column | str) -> Column:
    """Texts are equal exactly if their roots are."""
    return F.substring(fingerprint, 1, 64)


def paragraphs(fingerprint: Column | str) -> Column:
    """Digests of the paragraphs in order."""
    return F.regexp_extract_all(fingerprint, F.lit(rf":([0-9a-f]{{{BRANCH_DIGITS}}})"), F.lit(1))


def likeness(one: Column, other: Column) -> Column:
    """Share of common paragraphs, 0 to 1: twice the common ones over those of both, copies counted once.

    Equal roots give 1; paragraphs of equal text in another order do too.
    """

    def dice(a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(a, b)) * 2.0 / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))

    shared = let(paragraphs(one), lambda a: let(paragraphs(other), lambda b: dice(a, b)))
    return F.when(root(one) == root(other), F.lit(1.0)).otherwise(shared)


def locate_edits(prints: DataFrame, id_col: str = "doc_id", old: str = "fingerprint", new: str = "edited_fingerprint") -> DataFrame:
    """``(id, section, paragraph)`` of the new text that the old one lacks, numbered from 0.

    Roots are compared first, then the sections of rows that differ, then the paragraphs
    of sections that differ; equal branches are never opened. Ids are unique; a NULL id takes no part.
    """
    told = prints.select(F.col(id_col).alias("id"), F.col(old).alias("a"), F.col(new).alias("b")).filter(root("a") != root("b"))

    def sections(side: str) -> DataFrame:
        parts = F.slice(F.split(side, "/"), 2, F.greatest(F.size(F.split(side, "/")) - 1, F.lit(0)))
        return told.select("id", F.posexplode(parts).alias("section", "branch"))

    def opened(branches: DataFrame) -> DataFrame:
        inner = F.split("branch", ":")
        return branches.select("id", "section", F.posexplode(F.slice(inner, 2, F.size(inner) - 1)).alias("paragraph", "digest"))

    changed = sections("b").join(sections("a"), ["id", "branch"], "left_anti")
    # A paragraph may have moved to another section, so the old side is opened whole.
    fresh = opened(changed).join(opened(sections("a")).select("id", "digest"), ["id", "digest"], "left_anti")
    return fresh.select(F.col("id").alias(id_col), "section", "paragraph")


def _ring(keys: DataFrame) -> DataFrame:
    """For each distinct row, the key and length of the row before it, cyclically.

    Rows are dealt out by ranges of ``(id, digest)``; neighbours within a range come from
    a window, those across ranges from one row per range.
    """
    ranged = cut(keys.repartitionByRange("id", "digest").withColumn("part", F.spark_partition_id()))
    here = F.struct("key", "n")
    # One row for each range: as many as there are partitions.
    lasts = ranged.groupBy("part").agg(F.max_by(here, F.struct("id", "digest")).alias("last"))
    wrapped = F.last("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = lasts.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), wrapped).alias("edge"))
    before = Window.partitionBy("part").orderBy("id", "digest")
    linked = ranged.withColumn("prev", F.lag(here).over(before)).join(F.broadcast(edges), "part")
    prev = F.coalesce("prev", "edge")
    return linked.select("key", "n", prev["key"].alias("prev_key"), prev["n"].alias("prev_n"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness to each other and to the next text.

    ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``. In the edited
    form the last ``floor(n / part)`` code points give way to as many first ones of the next
    document's text, or all it has.

    Documents follow each other by id, NULL ids first, rows of one id by the SHA-256 of their
    text, and the first one follows the last. A NULL text counts as empty. Repeated rows are compared once and
    come back as often as they were given: all but the last are followed by a copy of
    themselves. An empty table gives an empty result; other columns are ignored. Runs jobs while
    it builds the result.

    A text is shuffled once, by its key, and sends its successor's part, no longer than
    the quarter that it replaces, and its fingerprint one row back.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.sha2("text", 256))
    rows = rows.withColumn("key", F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("digest")))
    slim = rows.select("key", "id", "digest", F.length("text").alias("n"))
    ring = _ring(slim.groupBy("key", "id", "digest").agg(F.any_value("n").alias("n")))
    # Both sides of the join below need the same columns of it, so that the texts are shuffled once for both.
    whole = rows.groupBy("key").agg(F.any_value("text").alias("text"), F.count("*").alias("copies")).filter("copies > 0")
    placed = whole.join(ring, "key")

    def quarter(n: str) -> Column:
        return F.expr(f"{n} div {part}").cast("int")

    sent = placed.select(
        F.col("prev_key").alias("key"), F.substring("text", F.lit(1), quarter("prev_n")).alias("begins"),
        fingerprint("text").alias("next_print"),
    )
    own_id = F.nullif(F.substring_index("key", ":", 1), F.lit("")).cast(docs.schema[id_col].dataType)
    kept = placed.select("key", own_id.alias("id"), "text", "n", "copies").join(sent, "key")
    # What stands for the copies before the last, which have themselves as successor, and for the last.
    itself = F.struct(F.substring("text", F.lit(1), quarter("n")).alias("begins"), F.lit(True).alias("same"), (F.col("copies") - 1).alias("times"))
    other = F.struct(F.col("begins"), F.lit(False).alias("same"), F.lit(1).cast("long").alias("times"))
    forms = F.filter(F.array(itself, other), lambda f: f["times"] > 0)
    made = kept.withColumn("print", fingerprint("text")).withColumn("form", F.explode(forms))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - quarter("n")), F.col("form.begins"))
    made = made.select("id", "n", "print", "next_print", "form", edited.alias("edited"))
    made = made.select(
        "id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("print").alias("fingerprint"),
        fingerprint("edited").alias("edited_fingerprint"), "next_print", "form.same", "form.times",
    )
    told = made.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.when(F.col("same"), F.lit(1.0)).otherwise(likeness(F.col("fingerprint"), F.col("next_print"))).alias("near_next"),
        "times",
    )
    # Copies are counted out in blocks, so that no array grows with their number.
    blocks = told.withColumn("_block", F.explode(F.expr(f"sequence(0L, (times - 1) div {COPIES})")))
    each = blocks.withColumn("_copy", F.explode(F.expr(f"sequence(1L, least({COPIES}L, times - _block * {COPIES}))")))
    return each.drop("times", "_block", "_copy")
