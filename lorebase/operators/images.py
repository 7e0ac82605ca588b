"""Pictures: their type and size from the first bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col


def _hex(c, start: int, n: int) -> Column:
    return F.hex(F.substring(col(c), start, n))


def image_type(c) -> Column:
    """P20: by magic bytes."""
    h = _hex(c, 1, 12)
    return F.when(h.startswith("89504E470D0A1A0A"), "PNG").when(h.startswith("FFD8FF"), "JPEG").when(h.startswith("474946383761") | h.startswith("474946383961"), "GIF").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "WEBP").otherwise("UNKNOWN")


def _number(c, start: int, n: int, little: bool = False) -> Column:
    parts = [_hex(c, start + k, 1) for k in range(n)]
    return F.conv(F.concat(*(parts[::-1] if little else parts)), 16, 10).cast("int")


def jpeg_size(c) -> Column:
    """X11: a walk over markers, whose lengths tell where the next one is; only JPEG rows come here."""

    @F.pandas_udf("struct<width:int,height:int>")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for data in column:
            size, at = (None, None), 2
            while data is not None and at + 9 <= len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                marker = data[at + 1]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    size = (int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big"))
                    break
                at += 2 if marker in (0x01, 0xFF) or 0xD0 <= marker <= 0xD9 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
            rows.append(size)
        return pd.DataFrame(rows, columns=["width", "height"]).astype("Int32")

    return run(c)


def image_size(c) -> Column:
    """X11: a struct of width and height, null where they can't be read."""
    b, kind = col(c), image_type(c)
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    long = F.length(b) >= 24
    webp = _hex(c, 13, 4)
    extended = size(_number(c, 25, 3, True) + 1, _number(c, 28, 3, True) + 1)
    lossy = size(_number(c, 27, 2, True).bitwiseAND(0x3FFF), _number(c, 29, 2, True).bitwiseAND(0x3FFF))
    packed = _number(c, 22, 4, True).cast("long")
    lossless = size((packed.bitwiseAND(0x3FFF) + 1).cast("int"), (F.shiftright(packed, 14).bitwiseAND(0x3FFF) + 1).cast("int"))
    jpeg = jpeg_size(F.when(kind == "JPEG", b))
    return (
        F.when((kind == "PNG") & long, size(_number(c, 17, 4), _number(c, 21, 4)))
        .when((kind == "GIF") & (F.length(b) >= 10), size(_number(c, 7, 2, True), _number(c, 9, 2, True)))
        .when((kind == "WEBP") & (webp == "56503858") & (F.length(b) >= 30), extended)
        .when((kind == "WEBP") & (webp == "56503820") & (F.length(b) >= 30), lossy)
        .when((kind == "WEBP") & (webp == "5650384C") & (F.length(b) >= 25), lossless)
        .when(kind == "JPEG", jpeg)
    )
