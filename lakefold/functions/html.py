"""HTML held in a text column."""

from __future__ import annotations

from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# What the sanitiser lets through and what it removes with its content.
ALLOWED_TAGS = [
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "br", "strong", "em", "a", "code", "pre", "ul", "ol", "li",
    "blockquote", "hr", "table", "thead", "tbody", "tr", "th", "td", "img", "div", "span",
]
ALLOWED_ATTRIBUTES = ["href", "title", "src", "alt", "class", "id", "style"]
FORBIDDEN_TAGS = ["script", "style", "iframe", "object", "embed"]

# Control characters that a numeric reference may not name, beside the ranges below.
_NO_CHARACTER = [*range(0x1, 0x9), 0xB, *range(0xE, 0x20), 0x7F, *range(0xFDD0, 0xFDF0)]


def _named() -> Column:
    """References by name, as one folded map: the standard library's table of HTML, which has some names without a semicolon as well."""
    table = "\x1e".join(f"&{name}\x1f{char}" for name, char in entities.html5.items())
    return F.str_to_map(F.lit(table), F.lit("\x1e"), F.lit("\x1f"))


def _windows(code: int) -> str:
    """What a reference to 128..159 means: the character of that Windows byte, or the code itself."""
    return bytes([code]).decode("cp1252", "ignore") or chr(code)


def html_unescape(text: Column, unclosed: bool = True) -> Column:
    """Character references of HTML, named and numeric, each resolved once.

    Names come from the table of HTML; names of the older standard also count without their semicolon and in front of
    other letters.  Numbers that name no character give the replacement character or nothing, as HTML has it.  Without
    ``unclosed`` only references that end in a semicolon count, so a text that was cut inside one keeps what is left.
    """
    names = _named()
    special = F.create_map(*[F.lit(x) for code in range(0x80, 0xA0) for x in (code, _windows(code))], F.lit(0), F.lit("\ufffd"), F.lit(13), F.lit("\r"))
    bare = "|".join(sorted((n for n in entities.html5 if not n.endswith(";")), key=len, reverse=True))

    def numbered(piece: Column) -> Column:
        hexed = F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]+)", 1)
        digits = F.regexp_extract(piece, "^&#0*([0-9]+)", 1)
        code = F.when(piece.rlike("^&#[xX]"), F.when(F.length(hexed) <= 8, F.conv(hexed, 16, 10).try_cast("bigint"))).otherwise(
            F.when(F.length(digits) <= 10, digits.try_cast("bigint")))
        return let(F.coalesce(code, F.lit(1 << 40)), lambda n: F.coalesce(F.try_element_at(special, n.try_cast("int")),
            F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").when(n.cast("int").isin(*_NO_CHARACTER) | n.bitwiseAND(F.lit(0xFFFF)).isin(0xFFFE, 0xFFFF), "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))))

    def one(piece: Column) -> Column:
        short = F.regexp_extract(piece, f"^(&(?:{bare}))", 1)
        return (
            F.when(~piece.startswith("&") | (F.length(piece) == 1) | (F.lit(not unclosed) & ~piece.endswith(";")), piece).when(piece.startswith("&#"), numbered(piece))
            .otherwise(F.coalesce(F.try_element_at(names, piece), F.when(short != "", F.concat(F.try_element_at(names, short), F.substring(piece, F.length(short) + 1, F.length(piece)))), piece))
        )

    def resolve(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit("(&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[a-zA-Z][a-zA-Z0-9]{0,30};?|[^&]++|&)"), F.lit(1))
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(t)

    return let(text, resolve)


def html_title(html: Column, unclosed: bool = True) -> Column:
    return html_unescape(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), unclosed)


def html_text(html: Column, unclosed: bool = True) -> Column:
    """Text content of the markup; the text of script and style elements counts as text."""
    bare = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    return html_unescape(F.regexp_replace(bare, "<[^>]+>", ""), unclosed)


def html_sanitize(html: Column) -> Column:
    """Allow-list clean-up of tags and attributes.

    A content normaliser for analytics, not a security boundary: it works on patterns, not on a
    parsed document.
    """
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in [*FORBIDDEN_TAGS, "title"]:
        out = F.regexp_replace(out, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", "")
    tags = "|".join(ALLOWED_TAGS)
    out = F.regexp_replace(out, f"(?i)<(?!/?(?:{tags})\\b)[/!a-z][^>]*>", "")
    attributes = "|".join(ALLOWED_ATTRIBUTES)
    value = "(?:\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s>\"']+))?"
    foreign = f"(?i)\\s+(?!(?:{attributes})\\s*=)[a-z_:][\\w:.-]*{value}"
    pieces = F.regexp_extract_all(out, F.lit("(<(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')++>|[^<]++|<)"), F.lit(1))
    return F.array_join(
        F.transform(pieces, lambda p: F.when(p.rlike("^<[a-zA-Z]"), F.regexp_replace(p, foreign, "")).otherwise(p)), ""
    )
