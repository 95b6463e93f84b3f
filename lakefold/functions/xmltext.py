"""XML held in a text column.

``xpath*`` raises on malformed input, so every use here sits behind :func:`is_valid_xml`, which is
the permissive ``from_xml`` reader asked for its corrupt-record column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, prefix_sums
from .text import trim_space

_NAME = "[^\\s/>=]+"
# comments, CDATA, instructions, doctype; then tags with quoted attributes; then text
XML_TOKEN = (
    "(<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>|<\\?.*?\\?>|<!DOCTYPE[^>\\[]*+(?:\\[[^\\]]*+\\])?[^>]*+>"
    "|</?(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')++>|[^<]++)"
)


def is_valid_xml(text: Column) -> Column:
    parsed = F.from_xml(
        text,
        "_corrupt_record STRING, _probe STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    return F.coalesce(
        F.contains(text, F.lit("<")) & parsed.isNotNull() & parsed["_corrupt_record"].isNull(), F.lit(False)
    )


def xml_fault(text: Column) -> Column:
    """Why markup cannot be read: ``missing part``, ``malformed part``, or null for well-formed markup."""
    return F.when(text.isNull(), "missing part").when(~is_valid_xml(text), "malformed part")


def gated(text: Column, expression: Column) -> Column:
    """``expression`` for well-formed documents, null for the rest."""
    return F.when(is_valid_xml(text), expression)


def xml_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)" + XML_TOKEN), F.lit(1))


def _is_open(t: Column) -> Column:
    return t.rlike("^<[^/!?]") & ~t.endswith("/>")


def _is_element(t: Column) -> Column:
    return t.rlike("^<[^/!?]")


def _is_close(t: Column) -> Column:
    return t.startswith("</")


def xml_profile(text: Column) -> Column:
    """valid, root_element, element_count, max_depth, has_doctype, declaration, size."""
    tags = F.filter(xml_tokens(text), lambda t: t.startswith("<") & ~t.rlike("^<[!?]"))
    return let(F.struct(tags.alias("tags"), is_valid_xml(text).alias("valid")), lambda m: _profile(text, m["tags"], m["valid"]))


def _profile(text: Column, tokens: Column, valid: Column) -> Column:
    depth = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("level"), F.lit(0).alias("deepest")),
        lambda acc, t: F.struct(
            (acc["level"] + F.when(_is_close(t), -1).when(t.endswith("/>"), 0).otherwise(1)).alias("level"),
            F.greatest(acc["deepest"], acc["level"] + F.when(_is_close(t), 0).otherwise(1)).alias("deepest"),
        ),
    )
    return F.struct(
        valid.alias("valid"),
        F.when(valid, F.regexp_extract(F.get(tokens, F.lit(0)), f"^<({_NAME})", 1)).alias("root_element"),
        F.when(valid, F.size(F.filter(tokens, lambda t: ~_is_close(t)))).cast("bigint").alias("element_count"),
        F.when(valid, depth["deepest"]).cast("bigint").alias("max_depth"),
        F.contains(text, F.lit("<!DOCTYPE")).alias("has_doctype"),
        F.nullif(F.regexp_extract(text, "^(<\\?xml[^>]*\\?>)", 1), F.lit("")).alias("declaration"),
        F.octet_length(text).cast("bigint").alias("size"),
    )


def xml_nodes(text: Column) -> Column:
    """Document walk: one struct per element, own text or comment, in document order.

    ``level`` is 1 for the root; ``kind`` is element, empty (nothing inside), text or comment.
    """
    return let(xml_tokens(text), _walk)


def _walk(tokens: Column) -> Column:
    steps = F.transform(tokens, lambda t: F.when(_is_open(t), 1).when(_is_close(t), -1).otherwise(0))
    walked = F.zip_with(
        F.zip_with(tokens, prefix_sums(steps), lambda t, l: F.struct(t.alias("t"), l.alias("l"))),
        F.transform(tokens, lambda t, i: F.get(tokens, i + 1)),
        lambda a, nxt: F.struct(a["t"].alias("t"), (a["l"] + 1).alias("level"), nxt.alias("nxt")),
    )
    shown = F.filter(
        walked, lambda w: _is_element(w["t"]) | w["t"].startswith("<!--")
        | w["t"].startswith("<![CDATA[") | (~w["t"].startswith("<") & (trim_space(w["t"]) != ""))
    )

    def render(w: Column) -> Column:
        t = w["t"]
        element = _is_element(t)
        comment = t.startswith("<!--")
        return F.struct(
            w["level"].cast("int").alias("level"),
            F.when(element & (t.endswith("/>") | _is_close(w["nxt"])), "empty")
            .when(element, "element").when(comment, "comment").otherwise("text").alias("kind"),
            F.when(element, F.regexp_extract(t, f"^<({_NAME})", 1)).alias("tag"),
            F.when(element, F.trim(F.regexp_replace(t, f"(?s)^<{_NAME}|/?>$", ""))).alias("attributes"),
            F.when(comment, F.regexp_replace(t, "(?s)^<!--|-->$", ""))
            .when(~element, trim_space(F.regexp_replace(t, "(?s)^<!\\[CDATA\\[|\\]\\]>$", ""))).alias("text"),
        )

    return F.transform(shown, render)


def xml_struct(text: Column, schema: str, keep_space: bool = True) -> Column:
    """Attributes as ``_name``, text as ``_VALUE``, repeats as arrays; namespace prefixes stripped."""
    return F.from_xml(
        text,
        schema,
        {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false" if keep_space else "true"},
    )


def xml_query(text: Column, path: str) -> Column:
    return gated(text, F.xpath(text, F.lit(path)))


def xml_values(text: Column, **paths: str) -> Column:
    """Struct of the string values of several XPath expressions, by one parse of the document; null for malformed ones.

    The values come joined by U+FFFF, which no XML document can hold.
    """
    joined = ', "\uffff", '.join(f"string({p})" for p in paths.values())
    found = gated(text, F.split(F.xpath_string(text, F.lit(f'concat({joined}, "\uffff")')), "\uffff"))
    return let(found, lambda v: F.when(v.isNotNull(), F.struct(*[F.get(v, F.lit(k)).alias(name) for k, name in enumerate(paths)])))


def xml_text(text: Column, tag: str) -> Column:
    """Text of the first element of that local name, empty when absent."""
    return F.coalesce(gated(text, F.xpath_string(text, F.lit(f'//*[local-name()="{tag}"]'))), F.lit(""))


def xml_by_tag(text: Column, tag: str) -> Column:
    """Texts of all elements of that local name, any namespace."""
    return xml_query(text, f'//*[local-name()="{tag}"]/text()')


def xml_attr(text: Column, tag: str, attribute: str, default: str = "") -> Column:
    value = gated(text, F.xpath_string(text, F.lit(f'//*[local-name()="{tag}"]/@{attribute}')))
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def xml_number_attr(text: Column, tag: str, attribute: str, default: int = 0) -> Column:
    """Leading integer of an attribute, the default when it is missing."""
    return leading_integer(xml_attr(text, tag, attribute), default)


def leading_integer(value: Column, default: int) -> Column:
    return F.coalesce(F.regexp_extract(value, "^\\s*([-+]?\\d+)", 1).try_cast("bigint"), F.lit(default).cast("bigint"))
