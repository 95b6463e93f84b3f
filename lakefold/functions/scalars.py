"""Scalar functions: typed byte reads, formatting, small geometry, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import at

# ---------------------------------------------------------------- typed reads


def _off(offset: Column | int) -> Column:
    return offset if isinstance(offset, Column) else F.lit(offset)


def byte_slice(content: Column, offset: Column | int, n: int) -> Column:
    """``n`` bytes at a zero-based offset, null when the content is too short."""
    off = _off(offset)
    return F.when(F.octet_length(content) >= off + n, F.substring(content, off + 1, F.lit(n)))


def _swapped(raw: Column, n: int) -> Column:
    return raw if n == 1 else F.concat(*[F.substring(raw, n - k, 1) for k in range(n)])


def _hex_at(content: Column, offset: Column | int, n: int, little: bool) -> Column:
    raw = byte_slice(content, offset, n)
    return F.hex(_swapped(raw, n) if little else raw)


def read_uint(content: Column, offset: Column | int, n: int, little: bool = True) -> Column:
    """Unsigned integer of 1, 2, 4 bytes as BIGINT, of 8 bytes as DECIMAL(20,0)."""
    digits = F.conv(_hex_at(content, offset, n, little), 16, 10)
    return digits.cast("decimal(20,0)" if n == 8 else "bigint")


def read_int(content: Column, offset: Column | int, n: int, little: bool = True) -> Column:
    if n == 8:
        return F.conv(_hex_at(content, offset, 8, little), 16, -10).cast("bigint")
    value = read_uint(content, offset, n, little)
    return F.when(value >= 1 << (8 * n - 1), value - (1 << (8 * n))).otherwise(value)


def read_float(content: Column, offset: Column | int, n: int = 4, little: bool = True) -> Column:
    """IEEE 754 single (``n=4``) or double (``n=8``) from its sign, exponent and fraction bits."""
    mant_bits, bias = (23, 127) if n == 4 else (52, 1023)
    exp_mask = (1 << (8 * n - 1 - mant_bits)) - 1
    raw = read_int(content, offset, n, little)
    bits = raw if n == 8 else raw.cast("bigint")
    exponent = F.shiftrightunsigned(bits, mant_bits).bitwiseAND(F.lit(exp_mask).cast("bigint"))
    mantissa = bits.bitwiseAND(F.lit((1 << mant_bits) - 1).cast("bigint")).cast("double") / float(1 << mant_bits)
    sign = F.when(raw < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when((exponent == exp_mask) & (mantissa == 0), sign * F.lit(float("inf")))
        .when(exponent == exp_mask, F.lit(float("nan")))
        .when(exponent == 0, sign * mantissa * F.pow(F.lit(2.0), F.lit(1.0 - bias)))
        .when(raw.isNotNull(), sign * (mantissa + 1.0) * F.pow(F.lit(2.0), (exponent - bias).cast("double")))
    )


def pack_uint(value: Column, n: int, little: bool = True) -> Column:
    """Bytes of a non-negative integer; the inverse of :func:`read_uint`."""
    raw = F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * n, "0"))
    return _swapped(raw, n) if little else raw


def hex_magic(content: Column, offset: int = 0, length: int = 8) -> Column:
    return F.hex(F.substring(content, offset + 1, length))


def match_magic(content: Column, expected_hex: str, offset: int = 0) -> Column:
    return hex_magic(content, offset, len(expected_hex) // 2) == expected_hex.upper()


def cstring(content: Column, offset: Column | int = 0) -> Column:
    """Text up to the next NUL and the offset after it."""
    text = F.split_part(
        F.decode(F.substring(content, _off(offset) + 1, F.lit(2147483647)), "ISO-8859-1"), F.lit("\x00"), F.lit(1)
    )
    return F.struct(text.alias("text"), (_off(offset) + F.length(text) + 1).cast("bigint").alias("next_offset"))


def fixed_string(content: Column, offset: Column | int, length: int, charset: str = "UTF-8") -> Column:
    return F.decode(F.substring(content, _off(offset) + 1, F.lit(length)), charset)


# ---------------------------------------------------------------- formatting

_UNITS = ["B", "KB", "MB", "GB", "TB"]


def _fixed2(x: Column) -> Column:
    return F.format_string("%.2f", F.round(x, 2))


def format_bytes(size: Column, style: str = "short") -> Column:
    """Human-readable size.

    ``short`` strips trailing zeros and reaches TB, ``short_gb`` stops at GB, ``fixed`` keeps two
    decimals (none for bytes) and prints nulls as ``0 B``, ``plain`` keeps two decimals above 1 KB
    and treats zero like any byte count.  Sizes beyond the last unit stay in the last unit.
    """
    last = 4 if style == "short" else 3
    scaled = [size.cast("double") / float(1024**k) for k in range(last + 1)]
    render = (lambda x: F.regexp_replace(_fixed2(x), "\\.?0+$", "")) if style.startswith("short") else _fixed2
    out = F.concat(size.cast("bigint").cast("string"), F.lit(" B"))
    for k in range(1, last + 1):
        out = F.when(size >= 1024**k, F.concat(render(scaled[k]), F.lit(" " + _UNITS[k]))).otherwise(out)
    return F.coalesce(out, F.lit("0 B")) if style == "fixed" else out


def format_duration(seconds: Column) -> Column:
    """``h:mm:ss`` or ``m:ss``; null and NaN print ``0:00``."""
    usable = seconds.isNotNull() & ~F.isnan(seconds)
    total = F.floor(F.when(usable, seconds).otherwise(F.lit(0.0)))
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60

    def two(c: Column) -> Column:
        return F.lpad(c.cast("string"), 2, "0")

    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(
        F.concat_ws(":", m.cast("string"), two(s))
    )


def format_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("-"))


def to_base64(content: Column) -> Column:
    return F.regexp_replace(F.base64(content), "\\s", "")


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), to_base64(content))


# ---------------------------------------------------------------- colours and styles


def parse_color(color: Column) -> Column:
    """``#RRGGBB``, ``#AARRGGBB``, ``rgb()``/``rgba()``; anything else is opaque black."""
    rgb = F.split(F.regexp_extract(color, "rgba?\\(([^)]+)\\)", 1), ",")

    def pair(k: int) -> Column:
        return F.conv(F.substring(color, 2 + 2 * k, 2), 16, 10).cast("double")

    def num(k: int) -> Column:
        return F.trim(at(rgb, k)).try_cast("double")

    def rec(r: Column, g: Column, b: Column, a: Column) -> Column:
        return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))

    one = F.lit(1.0)
    return (
        F.when(color.rlike("^#[0-9A-Fa-f]{6}$"), rec(pair(0), pair(1), pair(2), one))
        .when(color.rlike("^#[0-9A-Fa-f]{8}$"), rec(pair(1), pair(2), pair(3), pair(0) / 255.0))
        .when(color.rlike("rgba?\\([^)]+\\)"), rec(num(0), num(1), num(2), F.coalesce(num(3), one)))
        .otherwise(rec(F.lit(0.0), F.lit(0.0), F.lit(0.0), one))
    )


def parse_hex_color(color: Column) -> Column:
    """``RRGGBB`` or ``AARRGGBB`` run colours to ``#RRGGBB``; black for anything else."""
    return (
        F.when(F.length(color) == 6, F.concat(F.lit("#"), color))
        .when(F.length(color) == 8, F.concat(F.lit("#"), F.substring(color, 3, 6)))
        .otherwise(F.lit("#000000"))
    )


def parse_style(style: Column) -> Column:
    """``a:b;c:d`` to a map; a value ends at the next colon, incomplete pairs are skipped, last key wins."""
    pairs = F.transform(
        F.split(style, ";"),
        lambda p: F.struct(
            F.trim(F.split_part(p, F.lit(":"), F.lit(1))).alias("key"),
            F.split_part(p, F.lit(":"), F.lit(2)).alias("value"),
            F.split_part(p, F.lit(":"), F.lit(1)).alias("raw"),
        ),
    )
    kept = F.filter(pairs, lambda p: (p["raw"] != "") & (p["value"] != ""))
    last = F.filter(
        kept,
        lambda p, i: ~F.exists(F.slice(kept, i + 2, F.greatest(F.size(kept), F.lit(1))), lambda q: q["key"] == p["key"]),
    )
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], F.trim(p["value"]))))


# ---------------------------------------------------------------- bounds and geometry


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(value, low), high)


# The zoom steps thumbnails snap to.
SCALE_LEVELS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]


def nearest_bucket(value: Column, levels: list[float] = SCALE_LEVELS) -> Column:
    """The level nearest to ``value``; the earlier level wins a tie."""
    ranked = [F.struct(F.abs(value - level).alias("d"), F.lit(i).alias("i"), F.lit(level).alias("level"))
              for i, level in enumerate(levels)]
    return F.array_min(F.array(*ranked))["level"]


def fit_ratio(width: Column, height: Column, box_w: float, box_h: float,
              padding: float = 0, contain: bool = True, cap: float = 1.0) -> Column:
    """Scale that fits (or covers) a box, capped above and kept at 0.01 or more."""
    sx = F.lit(box_w - 2 * padding) / F.nullif(width, F.lit(0))
    sy = F.lit(box_h - 2 * padding) / F.nullif(height, F.lit(0))
    scale = (F.least if contain else F.greatest)(sx, sy)
    usable = (width != 0) & (height != 0)
    return F.when(usable, F.greatest(F.least(scale, F.lit(cap)), F.lit(0.01))).otherwise(F.lit(1.0))


def page_index(index: Column, pages: Column) -> Column:
    """A page number kept within ``[0, pages - 1]``."""
    return F.greatest(F.lit(0), F.least(index, pages - 1))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def emu_to_px(value: Column, default: int) -> Column:
    """EMU to pixels; a missing element keeps the default unscaled."""
    return F.coalesce(F.floor(value / 9525.0 + 0.5).cast("bigint"), F.lit(default).cast("bigint"))


# ---------------------------------------------------------------- paths


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Leading part of a path with its closing slash, or the empty string."""
    return F.regexp_replace(path, "[^/]*$", "")


def file_ext(name: Column) -> Column:
    """Lower-case text after the last dot; null without a dot or with a trailing one."""
    return F.lower(F.nullif(F.regexp_extract(name, "\\.([^.]+)$", 1), F.lit("")))


def file_ext_loose(name: Column) -> Column:
    """Lower-case last dot-separated piece, the whole name when there is no dot."""
    return F.lower(F.element_at(F.split(name, "\\."), -1))
