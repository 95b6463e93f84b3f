"""Image headers as native expressions at fixed offsets."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrays import let
from .formats import begins, detect_image
from .markup import attribute, first_element, leading_float
from .scalars import hex_magic, read_int, read_uint
from .text import latin1
from .xmltext import is_valid_xml


def bmp_header(content: Column) -> Column:
    """file_size, data_offset, width, height, bit_count, compression, colors_used, error."""
    header, planes, depth, compression = read_uint(content, 14, 4), read_uint(content, 26, 2), read_uint(content, 28, 2), read_uint(content, 30, 4)
    error = (
        F.when(~F.coalesce(begins(content, "424D"), F.lit(False)), "not a BMP file")
        .when(F.octet_length(content) < 54, "truncated header")
        .when(header != 40, "unsupported header size")
        .when(planes != 1, "planes must be 1")
        .when(~depth.isin(1, 4, 8, 24, 32), "unsupported colour depth")
        .when(compression != 0, "compressed files are not supported")
    )
    return F.struct(
        read_uint(content, 2, 4).alias("file_size"), read_uint(content, 10, 4).alias("data_offset"), read_int(content, 18, 4).alias("width"),
        read_int(content, 22, 4).alias("height"), depth.alias("bit_count"), compression.alias("compression"),
        read_uint(content, 46, 4).alias("colors_used"), error.alias("error"),
    )


def bmp_palette(content: Column) -> Column:
    """``array<struct<red, green, blue>>`` of files with eight bits or fewer, null for the others."""
    depth, used = read_uint(content, 28, 2), read_uint(content, 46, 4)
    full = F.when(depth == 1, 2).when(depth == 4, 16).otherwise(256)
    count = F.least(F.when(used > 0, used).otherwise(full), F.floor((F.octet_length(content) - 54) / 4))
    colour = lambda at: F.struct(
        read_uint(content, at + 2, 1).alias("red"), read_uint(content, at + 1, 1).alias("green"), read_uint(content, at, 1).alias("blue"))
    readable = bmp_header(content)["error"].isNull() & (depth <= 8)
    return F.when(readable, let(count, lambda n: F.when(n > 0, F.transform(
        F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: colour(i * 4 + 54)))))


# Colour modes by number.
PSD_MODES = {0: "BITMAP", 1: "GRAYSCALE", 2: "INDEXED", 3: "RGB", 4: "CMYK", 7: "MULTICHANNEL", 8: "DUOTONE", 9: "LAB"}


def psd_header(content: Column) -> Column:
    """version, channels, height, width, depth, color_mode and its name; null without the signature."""
    mode = read_uint(content, 24, 2, little=False)
    names = F.create_map(*[F.lit(x) for k, v in PSD_MODES.items() for x in (k, v)])
    be = lambda at, n: read_uint(content, at, n, little=False)
    return F.when(begins(content, "38425053"), F.struct(
        be(4, 2).alias("version"), be(12, 2).alias("channels"), be(14, 4).alias("height"), be(18, 4).alias("width"), be(22, 2).alias("depth"),
        mode.alias("color_mode"), F.try_element_at(names, mode.cast("int")).alias("mode_name")))


# Pixels per unit.
SVG_UNITS = {"": 1.0, "px": 1.0, "pt": 96 / 72, "pc": 96 * 12 / 72, "mm": 96 / 25.4, "cm": 96 / 2.54, "in": 96.0, "%": 1.0}


def _svg_length(value: Column) -> Column:
    pattern = "^([\\d.]+)(px|pt|pc|mm|cm|in|%)?$"
    units = F.create_map(*[F.lit(x) for kv in SVG_UNITS.items() for x in kv])
    pixels = leading_float(F.regexp_extract(value, pattern, 1)) * F.try_element_at(units, F.regexp_extract(value, pattern, 2))
    return F.nullif(pixels, F.lit(0.0))


def svg_size(svg: Column) -> Column:
    """width, height, valid: own attributes, then the view box, then 300 by 150."""
    def read(root: Column) -> Column:
        box = F.split(F.trim(attribute(root, "viewBox")), "\\s+|,", -1)
        side = lambda i: let(box, lambda b: F.when(F.size(b) == 4, F.nullif(leading_float(F.get(b, F.lit(i))), F.lit(0.0))))
        return F.struct(
            F.coalesce(_svg_length(attribute(root, "width")), side(2), F.lit(300.0)).alias("width"),
            F.coalesce(_svg_length(attribute(root, "height")), side(3), F.lit(150.0)).alias("height"), F.lit(True).alias("valid"),
        )

    invalid = F.struct(F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"), F.lit(False).alias("valid"))
    root = F.when(is_valid_xml(svg), first_element(svg, "svg"))
    return let(root, lambda r: F.when(r.isNotNull(), read(r)).otherwise(invalid))


def webp_animated(content: Column) -> Column:
    """Whether the extended header's animation flag is set, or an animation chunk stands in the leading bytes.

    Other chunks, such as a colour profile of any length, may stand before the animation chunk.
    """
    webp = begins(content, "52494646") & (hex_magic(content, 8, 4) == "57454250")
    flags = F.conv(hex_magic(content, 20, 1), 16, 10).cast("int")
    flagged = (hex_magic(content, 12, 4) == "56503858") & (flags.bitwiseAND(F.lit(2)) == 2)
    named = latin1(F.substring(content, 13, 88)).rlike("ANIM|ANMF")
    return F.coalesce(webp & (F.coalesce(flagged, F.lit(False)) | named), F.lit(False))


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def _jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Frame size of a JPEG file: its segments have variable lengths, so they are walked."""
    def one(b: bytes | None) -> tuple[int | None, int | None]:
        at = 2
        while b is not None and at + 9 <= len(b) and b[at] == 0xFF:
            marker = b[at + 1]
            if marker == 0xFF:
                at += 1
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", b, at + 5)
                return width, height
            elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
                at += 2
            else:
                at += 2 + struct.unpack_from(">H", b, at + 2)[0]
        return None, None

    return pd.DataFrame([one(b) for b in content], columns=["width", "height"]).astype("Int64")


def image_size(content: Column) -> Column:
    """format, width, height from the header; only JPEG contents reach the Arrow worker."""
    kind = detect_image(F.substring(content, 1, 16))
    chunk = hex_magic(content, 12, 4)
    u = lambda at, n, little: read_uint(content, at, n, little)
    pair = lambda w, h: F.struct(w.cast("bigint").alias("width"), h.cast("bigint").alias("height"))
    lossless = u(21, 4, True)
    mask14 = F.lit(0x3FFF).cast("bigint")
    size = (
        F.when(kind == "png", pair(u(16, 4, False), u(20, 4, False)))
        .when(kind == "gif", pair(u(6, 2, True), u(8, 2, True)))
        .when(kind == "bmp", pair(read_int(content, 18, 4), F.abs(read_int(content, 22, 4))))
        .when(kind == "psd", pair(u(18, 4, False), u(14, 4, False)))
        .when((kind == "webp") & (chunk == "56503858"), pair(u(24, 3, True) + 1, u(27, 3, True) + 1))
        .when((kind == "webp") & (chunk == "56503820"), pair(u(26, 2, True).bitwiseAND(mask14), u(28, 2, True).bitwiseAND(mask14)))
        .when((kind == "webp") & (chunk == "5650384C"),
              pair(lossless.bitwiseAND(mask14) + 1, F.shiftrightunsigned(lossless, 14).bitwiseAND(mask14) + 1))
        .otherwise(_jpeg_size(F.when(kind == "jpg", content)))
    )
    return let(size, lambda s: F.struct(kind.alias("format"), s["width"].alias("width"), s["height"].alias("height"),
                                        F.try_divide(s["width"], s["height"]).alias("aspect_ratio")))


