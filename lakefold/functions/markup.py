"""Parts of a package and elements of their markup, as column expressions.

``from_xml`` with a narrow schema reads fixed shapes.  Where elements may sit at any depth and
document order matters (paragraphs, runs, shapes) the element texts are cut out by tag name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.files import utf8_text
from .arrays import let
from .xmltext import xml_struct, xml_tokens



def part(parts: Column, name: Column | str) -> Column:
    """Bytes of a package member, null when it is missing."""
    return F.try_element_at(parts, name if isinstance(name, Column) else F.lit(name))


def part_text(parts: Column, name: Column | str) -> Column:
    return utf8_text(part(parts, name))


def first_part_text(parts: Column, names: list[str]) -> Column:
    """Text of the first of several member names that exists."""
    return utf8_text(F.coalesce(*[part(parts, n) for n in names]))


def part_struct(parts: Column, name: Column | str, schema: str) -> Column:
    """A member read with a declared schema; malformed members are null."""
    parsed = xml_struct(part_text(parts, name), schema + ", _corrupt_record STRING")
    return let(parsed, lambda p: F.when(p["_corrupt_record"].isNull(), p))


def plain_markup(text: Column) -> Column:
    """Well-formed markup without what misleads patterns: comments go, character data and signs in attributes are escaped.

    Markup that has none of these, which is nearly all, is only looked through.
    """

    def escaped(t: Column) -> Column:
        return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def one(token: Column) -> Column:
        data = F.substring(token, F.lit(10), F.length(token) - 12)
        inside = F.substring(token, F.lit(2), F.length(token) - 2)
        return (
            F.when(token.startswith("<!--"), "").when(token.startswith("<![CDATA["), escaped(F.replace(data, F.lit("&"), F.lit("&amp;"))))
            .when(token.rlike("^<[^!?]") & F.contains(inside, F.lit(">")), F.concat(F.lit("<"), F.replace(inside, F.lit(">"), F.lit("&gt;")), F.lit(">")))
            .otherwise(token)
        )

    misleading = F.contains(text, F.lit("<!--")) | F.contains(text, F.lit("<![CDATA[")) | text.rlike("=\\s*+(?:\"[^\"<>]*+>|'[^'<>]*+>)")
    return F.when(misleading, F.array_join(F.transform(xml_tokens(text), one), "")).otherwise(text)


def elements(markup: Column, tag: str) -> Column:
    """Source text of the elements of a local name, at any depth, in document order.

    Elements of one name must not nest in each other.
    """
    name = f"(?:\\w+:)?{tag}"
    return F.regexp_extract_all(
        markup, F.lit(f"(?s)(<{name}(?:\\s[^>]*?)?(?:/>|>.*?</{name}\\s*>))"), F.lit(1)
    )


def has_element(markup: Column, tag: str) -> Column:
    return markup.rlike(f"<(?:\\w+:)?{tag}[\\s/>]")


def first_element(markup: Column, tag: str) -> Column:
    return F.get(elements(markup, tag), F.lit(0))


def attribute(element: Column, name: str) -> Column:
    """Attribute of the element's own start tag, null when absent."""
    pattern = f"(?s)^<[^>]*?\\s{name}\\s*=\\s*([\"'])(.*?)\\1"
    return unescape(F.get(F.regexp_extract_all(element, F.lit(pattern), F.lit(2)), F.lit(0)))


# The predefined entities other than the ampersand.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """Predefined and numeric character references, each resolved once."""
    names = F.create_map(*[F.lit(v) for kv in _ENTITIES.items() for v in kv])

    def one(piece: Column) -> Column:
        number = F.when(piece.startswith("&#x"), F.regexp_extract(piece, "^&#x([0-9a-fA-F]{1,6});$", 1)).otherwise(
            F.hex(F.regexp_extract(piece, "^&#(\\d{1,7});$", 1).try_cast("bigint"))
        )
        char = F.decode(F.unhex(F.lpad(F.nullif(number, F.lit("")), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(names, piece), F.when(piece.startswith("&#"), char), piece)

    def resolve(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit("(&#?\\w+;|[^&]++|&)"), F.lit(1))
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(t)

    return let(text, resolve)


def text_content(element: Column) -> Column:
    """Text of an element with the tags removed and entities resolved."""
    return unescape(F.regexp_replace(element, "(?s)<[^>]*>", ""))


def texts_of(markup: Column, tag: str) -> Column:
    return F.transform(elements(markup, tag), text_content)


def leading_int(text: Column) -> Column:
    return F.regexp_extract(text, "^\\s*([-+]?\\d+)", 1).try_cast("bigint")


def leading_float(text: Column) -> Column:
    return F.regexp_extract(text, "^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)", 1).try_cast("double")


def resolve_target(source_dir: str, target: Column) -> Column:
    """Part name of a relationship target: absolute, or relative to the folder of its source part."""
    up = source_dir.rstrip("/").rsplit("/", 1)[0] + "/" if "/" in source_dir.rstrip("/") else ""
    return let(
        target,
        lambda t: F.when(t.startswith("/"), F.substring(t, 2, 2147483647))
        .when(t.startswith("../"), F.concat(F.lit(up), F.substring(t, 4, 2147483647)))
        .otherwise(F.concat(F.lit(source_dir), t)),
    )


RELS_SCHEMA = "Relationship ARRAY<STRUCT<_Id: STRING, _Type: STRING, _Target: STRING>>"
