"""Text column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, prefix_sums

# Fixed value: the code points a script engine treats as white space (Java's \s is ASCII only).
SCRIPT_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def trim_space(text: Column) -> Column:
    """Strip leading and trailing white space in the script sense."""
    return F.regexp_replace(text, f"^[{SCRIPT_SPACE}]++|(?<![{SCRIPT_SPACE}])[{SCRIPT_SPACE}]++\\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SCRIPT_SPACE}]")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def text_profile(text: Column) -> Column:
    """line_count, char_count, size in bytes, has_non_ascii."""
    return F.struct(
        F.size(lines_of(text)).cast("bigint").alias("line_count"),
        F.length(text).cast("bigint").alias("char_count"),
        F.octet_length(text).cast("bigint").alias("size"),
        text.rlike("[^\\x00-\\x7F]").alias("has_non_ascii"),
    )


def literal_pattern(keyword: str) -> str:
    """Case-insensitive Java pattern matching ``keyword`` literally."""
    return "(?iu)" + "".join(re.escape(c) if c.isascii() and not c.isalnum() else c for c in keyword)


def line_hit_starts(line: Column, keyword: str) -> Column:
    """Zero-based starts of the non-overlapping matches of ``keyword`` in one line."""
    pieces = F.split(line, literal_pattern(keyword), -1)
    widths = F.transform(
        let(pieces, lambda p: F.slice(p, F.lit(1), F.size(p) - 1)), lambda p: F.length(p) + F.lit(len(keyword))
    )
    return let(widths, lambda ws: F.zip_with(prefix_sums(ws), ws, lambda s, w: s + w - F.lit(len(keyword))))


def highlight(text: Column, keyword: str, css_class: str = "txt-search-highlight") -> Column:
    return F.regexp_replace(text, literal_pattern(keyword), f'<span class="{css_class}">$0</span>')


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SCRIPT_SPACE}]+")).cast("bigint")


# The five predefined entities, in replacement order (ampersand first, both ways).
_XML_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def xml_escape(text: Column) -> Column:
    return _replace_all(text, _XML_ENTITIES)


def xml_unescape(text: Column) -> Column:
    """Inverse replacements in the same order, so ``&amp;lt;`` becomes ``<``."""
    return _replace_all(text, [(b, a) for a, b in _XML_ENTITIES])


def html_escape(text: Column) -> Column:
    """Like :func:`xml_escape` but with the numeric apostrophe HTML 4 readers know."""
    return _replace_all(text, _XML_ENTITIES[:4] + [("'", "&#39;")])


def latin1(content: Column) -> Column:
    """Bytes as text, one character per byte."""
    return F.decode(content, "ISO-8859-1")


def salvage_ascii(content: Column) -> Column:
    """The printable ASCII bytes of a binary file, everything else dropped."""
    return F.regexp_replace(latin1(content), "[^ -~]", "")


def salvage_pieces(content: Column, start: int, end: int | None) -> Column:
    """Latin-1 text of the readable bytes of a window: line breaks, ASCII, two-byte pairs."""
    window = F.substring(content, start + 1, 2147483647 if end is None else end - start)
    tokens = F.regexp_extract_all(
        latin1(window), F.lit("([\\xC0-\\xFF][\\x00-\\xFF]|[\\r\\n\\x20-\\x7E])"), F.lit(1)
    )
    return F.array_join(F.transform(tokens, lambda t: F.when(t == "\r", F.lit("\n")).otherwise(t)), "")
