"""Kind and size of picture files from their first bytes, as column expressions.

A picture is decoded only to see its pixels; to drop what is none, or too small, its header is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pentarank.functions.arrays import as_column, let

# Signatures, as hexadecimal digits.
PNG = "89504E470D0A1A0A"
JPEG = "FFD8"
RIFF, WEBP = "52494646", "57454250"
LOSSY, LOSSLESS, EXTENDED = "56503820", "5650384C", "56503858"
# Frame headers of JPEG are C0 to CF without these three.
NO_FRAME = ("C4", "C8", "CC")
SEGMENTS = 256


def _hex(content: Column, start: int | Column, count: int) -> Column:
    """Digits of ``count`` bytes from ``start``, counted from 0."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.hex(F.substring(content, (start + 1).cast("int"), F.lit(count)))


def _big(digits: Column) -> Column:
    return F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("int")


def _little(digits: Column) -> Column:
    turned = F.concat(*[F.substring(digits, k, 2) for k in (5, 3, 1)])
    return _big(turned)


def _size(kind: str, width: Column, height: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), width.alias("width"), height.alias("height"))


def _jpeg(content: Column) -> Column:
    """Goes from segment to segment up to the first frame header."""

    def step(at: Column, _: Column) -> Column:
        mark = _hex(content, at["pos"], 4)
        code = F.substring(mark, 3, 2)
        frame = code.between("C0", "CF") & ~code.isin(*NO_FRAME)
        broken = ~F.startswith(mark, F.lit("FF")) | (F.length(mark) < 8)
        ends = at["done"] | frame | broken | code.isin("D9", "DA")
        # A mark may be filled up with FF, and has a length after it unless it stands alone.
        filled, alone = code == "FF", code.between("D0", "D7") | (code == "01")
        further = F.when(filled, 1).when(alone, 2).otherwise(2 + _big(F.substring(mark, 5, 4)))
        return F.struct(
            F.when(ends, at["pos"]).otherwise(at["pos"] + further).alias("pos"),
            ends.alias("done"),
            (at["found"] | (~at["done"] & frame & ~broken)).alias("found"),
        )

    start = F.struct(F.lit(2).alias("pos"), F.lit(False).alias("done"), F.lit(False).alias("found"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step)

    def read(frame: Column) -> Column:
        height, width = _big(_hex(content, frame["pos"] + 5, 2)), _big(_hex(content, frame["pos"] + 7, 2))
        return F.when(frame["found"], _size("jpeg", width, height))

    return let(last, read)


def _webp(content: Column) -> Column:
    kind = _hex(content, 12, 4)

    def packed(digits: Column) -> Column:
        """Two sizes less one, of 14 bits each, from the lowest bit on."""
        whole = F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
        return _size("webp", (whole.bitwiseAND(F.lit(0x3FFF)) + 1).cast("int"), (F.shiftright(whole, 14).bitwiseAND(F.lit(0x3FFF)) + 1).cast("int"))

    def plain(start: int) -> Column:
        turned = lambda d: F.conv(F.concat(F.substring(d, 3, 2), F.substring(d, 1, 2)), 16, 10).cast("int").bitwiseAND(F.lit(0x3FFF))
        return _size("webp", turned(_hex(content, start, 2)), turned(_hex(content, start + 2, 2)))

    long_enough = F.octet_length(content) >= 30
    extended = _size("webp", _little(_hex(content, 24, 3)) + 1, _little(_hex(content, 27, 3)) + 1)
    return F.when(
        long_enough,
        F.when(kind == EXTENDED, extended).when((kind == LOSSLESS) & (_hex(content, 20, 1) == "2F"), packed(_hex(content, 21, 4)))
        .when((kind == LOSSY) & (_hex(content, 23, 3) == "9D012A"), plain(26)),
    )


def picture_size(content: Column | str) -> Column:
    """``struct<kind, width, height>`` of a PNG, JPEG or WebP file; NULL for anything else.

    A file that ends before its size, that has no pixels, or a JPEG with more than 256 segments before its frame
    is NULL too. Only headers are looked at: what follows may still be damaged.
    """
    content = as_column(content)
    png = F.when(
        (_hex(content, 12, 4) == "49484452") & (F.octet_length(content) >= 24),
        _size("png", _big(_hex(content, 16, 4)), _big(_hex(content, 20, 4))),
    )
    head = _hex(content, 0, 12)
    found = (
        F.when(F.startswith(head, F.lit(PNG)), png)
        .when(F.startswith(head, F.lit(JPEG)), _jpeg(content))
        .when(F.startswith(head, F.lit(RIFF)) & F.endswith(head, F.lit(WEBP)), _webp(content))
    )
    return let(found, lambda size: F.when((size["width"] > 0) & (size["height"] > 0), size))
