"""Markdown held in a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .text import is_blank, lines_of, trim_space

HEADING = "^(#{1,6})\\s+(.+)$"
LINK = "\\[([^\\]]+)\\]\\(([^)]+)\\)"


def _numbered(text: Column) -> Column:
    return F.transform(lines_of(text), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))


def md_headings(text: Column) -> Column:
    """level, text, line of every heading line, fenced or not."""
    return F.transform(
        F.filter(_numbered(text), lambda n: n["line"].startswith("#") & n["line"].rlike(HEADING)),
        lambda n: F.struct(
            F.length(F.regexp_extract(n["line"], HEADING, 1)).alias("level"),
            trim_space(F.regexp_extract(n["line"], HEADING, 2)).alias("text"),
            n["line_no"].alias("line"),
        ),
    )


def md_code_blocks(text: Column) -> Column:
    """language, start_line, end_line, lines of each closed fence pair; an open last fence is dropped."""
    return let(F.filter(_numbered(text), lambda n: n["line"].startswith("```")), _fence_pairs)


def _fence_pairs(fences: Column) -> Column:
    pairs = F.floor(F.size(fences) / 2).cast("int")
    opens = F.filter(fences, lambda f, i: (i % 2 == 0) & (i < pairs * 2))
    closes = F.filter(fences, lambda f, i: i % 2 == 1)
    return F.zip_with(
        opens,
        closes,
        lambda a, b: F.struct(
            trim_space(F.substring(a["line"], F.lit(4), F.length(a["line"]))).alias("language"),
            a["line_no"].alias("start_line"),
            b["line_no"].alias("end_line"),
            (b["line_no"] - a["line_no"] - 1).alias("lines"),
        ),
    )


def md_links(text: Column) -> Column:
    """text, url, line of every inline link, the inner match for images."""
    per_line = F.transform(
        F.filter(_numbered(text), lambda n: F.contains(n["line"], F.lit("]("))),
        lambda n: F.zip_with(
            F.regexp_extract_all(n["line"], F.lit(LINK), F.lit(1)),
            F.regexp_extract_all(n["line"], F.lit(LINK), F.lit(2)),
            lambda label, url: F.struct(label.alias("text"), url.alias("url"), n["line_no"].alias("line")),
        ),
    )
    return F.flatten(per_line)


def md_tables(text: Column) -> Column:
    """line and cell count of every line with more than one non-blank piped cell."""
    counted = F.transform(
        F.filter(_numbered(text), lambda n: F.contains(n["line"], F.lit("|"))),
        lambda n: F.struct(
            n["line_no"].alias("line"),
            F.size(F.filter(F.split(n["line"], "[|]", -1), lambda c: ~is_blank(c))).alias("cell_count"),
        ),
    )
    return F.filter(counted, lambda c: c["cell_count"] > 1)


def md_profile(text: Column) -> Column:
    return F.struct(
        F.size(lines_of(text)).cast("bigint").alias("line_count"),
        F.size(md_headings(text)).cast("bigint").alias("heading_count"),
        F.size(md_code_blocks(text)).cast("bigint").alias("code_block_count"),
        F.size(md_links(text)).cast("bigint").alias("link_count"),
        F.octet_length(text).cast("bigint").alias("size"),
    )


# The two conversion tables, (pattern, replacement) in the order they apply.
_HEADING_RULES = [(f"(?im)^{'#' * n} (.*$)", f"<h{n}>$1</h{n}>") for n in range(1, 7)]
_BOLD = ("\\*\\*(.*?)\\*\\*", "<strong>$1</strong>")
_EMPHASIS = ("\\*(.*?)\\*", "<em>$1</em>")
DOCUMENT_RULES = [
    *reversed(_HEADING_RULES),
    _BOLD,
    _EMPHASIS,
    (LINK, '<a href="$2">$1</a>'),
    ("```(\\w+)?\\n([\\s\\S]*?)```", '<pre><code class="language-$1">$2</code></pre>'),
    ("`([^`]+)`", "<code>$1</code>"),
    ("\\n\\n", "</p><p>"),
]
INLINE_RULES = [
    *_HEADING_RULES,
    _BOLD,
    _EMPHASIS,
    ("`(.*?)`", "<code>$1</code>"),
    ("\\[(.*?)\\]\\((.*?)\\)", '<a href="$2">$1</a>'),
    ("\\n", "<br>"),
]


def md_to_html(text: Column, style: str = "document") -> Column:
    """Regex conversion; ``document`` wraps paragraphs, ``inline`` turns line feeds into breaks."""
    html = text
    for pattern, replacement in DOCUMENT_RULES if style == "document" else INLINE_RULES:
        html = F.regexp_replace(html, pattern, replacement)
    return F.concat(F.lit("<p>"), html, F.lit("</p>")) if style == "document" else html
