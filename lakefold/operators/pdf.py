"""PDF operators: profile, pages, content, information, fonts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.arrays import let
from ..functions.text import latin1, lines_of, trim_space

_LITERAL = "\\s*(\\((?:[^()\\\\]|\\\\.)*+\\))"


def pdf_profile(content: Column) -> Column:
    """valid, version, encrypted, size; a trailer or a cross-reference stream anywhere in the file counts."""
    size = F.octet_length(content)
    text = latin1(content)
    head = F.regexp_extract(text, "(?s)\\A.*?(%PDF-\\d+\\.\\d+)", 1)
    trailer = _trailer(text)
    return F.struct(
        F.coalesce(F.startswith(content, F.unhex(F.lit("25504446"))), F.lit(False)).alias("valid"),
        F.coalesce(F.nullif(F.regexp_extract(head, "%PDF-(\\d+\\.\\d+)", 1), F.lit("")), F.lit("1.4")).alias("version"),
        F.coalesce(F.contains(trailer, F.lit("/Encrypt")), F.lit(False)).alias("encrypted"),
        size.cast("bigint").alias("size"),
    )


def _trailer(text: Column) -> Column:
    """Text of the dictionaries of all trailers and cross-reference streams, the newest last."""
    tables = F.regexp_extract_all(text, F.lit("(?s)\\btrailer\\s*<<(.*?)(?:startxref|\\z)"), F.lit(1))
    streams = F.regexp_extract_all(text, F.lit("(?s)\\bobj\\s*(<<(?:(?!\\bstream\\b|\\bendobj\\b).)*+)"), F.lit(1))
    return F.array_join(F.concat(F.filter(streams, lambda d: d.rlike("/Type\\s*/XRef\\b")), tables), "\n")


def pdf_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(path, page_no, width, height)`` and the columns to ``keep``, 612 by 792 where neither the page nor a node above it states a box."""
    side = lambda k: F.floor(F.get("box", F.lit(k + 2)) - F.get("box", F.lit(k)) + 0.5)
    return pages.filter("page_no IS NOT NULL").select(
        "path", "page_no", F.coalesce(side(0), F.lit(612)).cast("int").alias("width"), F.coalesce(side(1), F.lit(792)).cast("int").alias("height"), *keep
    )


def pdf_page_contents(pages: DataFrame) -> DataFrame:
    """``(path, page_no, contents)``: the page's streams in order, each of a list followed by a line feed."""
    return pages.filter("page_no IS NOT NULL").select("path", "page_no", "contents")


def pdf_errors(pages: DataFrame) -> DataFrame:
    """``(path, page_no, error)`` of files that are no PDF and of pages whose content is damaged."""
    return pages.filter("error IS NOT NULL").select("path", "page_no", "error")


def pdf_shown_text(operations: DataFrame) -> DataFrame:
    """``(path, page_no, op_no, op, text, font, font_size, x, y)`` of every operator that shows text."""
    return operations.filter(F.col("op").isin("Tj", "TJ", "'", '"')).select("path", "page_no", "op_no", "op", "text", "font", "font_size", "x", "y")


def pdf_drawn_objects(operations: DataFrame) -> DataFrame:
    """``(path, page_no, op_no, name)`` of drawn external objects; inline images have no name."""
    return operations.filter(F.col("op").isin("Do", "BI")).select("path", "page_no", "op_no", "name")


def pdf_string(text: Column) -> Column:
    """A literal string without its parentheses and with its escapes resolved."""
    bare = F.regexp_replace(F.regexp_replace(text, "^\\(", ""), "\\)$", "")
    tokens = lambda b: F.regexp_extract_all(b, F.lit("(?s)(\\\\[0-7]{1,3}|\\\\.|[^\\\\]++|\\\\)"), F.lit(1))

    def one(t: Column) -> Column:
        return (
            F.when(~t.startswith("\\") | (F.length(t) == 1), t)
            .when(t.rlike("^\\\\[0-7]"), F.chr(F.conv(F.substring(t, 2, 3), 8, 10).cast("bigint")))
            .when(t == "\\n", "\n").when(t == "\\r", "\r").when(t == "\\t", "\t").otherwise(F.substring(t, 2, 1))
        )

    return let(bare, lambda b: F.when(F.contains(b, F.lit("\\")), F.array_join(F.transform(tokens(b), one), "")).otherwise(b))


def _content_lines(contents: DataFrame) -> DataFrame:
    return contents.select("path", "page_no", F.posexplode(F.transform(lines_of(F.col("contents")), trim_space)).alias("line_no", "line"))


def pdf_text_ops(contents: DataFrame, arrays: bool = False) -> DataFrame:
    """``(path, page_no, line_no, text)`` of lines that end in ``Tj``; ``arrays`` adds ``TJ`` lists.

    The line rule of simple files; :func:`pdf_shown_text` reads operators anywhere on a line.
    """
    lines = _content_lines(contents)
    shown = F.when(F.col("line").endswith("Tj"), pdf_string(trim_space(F.expr("substring(line, 1, length(line) - 2)"))))
    if arrays:
        pieces = F.regexp_extract_all("line", F.lit("(\\((?:[^()\\\\]|\\\\.)*+\\))"), F.lit(1))
        shown = F.coalesce(shown, F.when(F.col("line").endswith("TJ"), F.array_join(F.transform(pieces, pdf_string), "")))
    return lines.withColumn("text", shown).filter("text IS NOT NULL").select("path", "page_no", "line_no", "text")


def pdf_image_ops(contents: DataFrame) -> DataFrame:
    """``(path, page_no, line_no, name)`` of lines that end in drawing an external object, by the same line rule."""
    words = F.split("line", "\\s+")
    return _content_lines(contents).filter(F.col("line").endswith("Do")).select(
        "path", "page_no", "line_no", F.get(words, F.size(words) - 2).alias("name")
    )


# Information keys and the columns they fill.
_INFO = [("Title", "title"), ("Author", "author"), ("Subject", "subject"), ("Keywords", "keywords"), ("Creator", "creator"),
         ("Producer", "producer"), ("CreationDate", "creation_date"), ("ModDate", "mod_date")]


def pdf_info(documents: DataFrame) -> DataFrame:
    """Information dictionary and page count per file; empty strings where nothing is stated."""
    return documents.filter("error IS NULL").select(
        "path", F.col("page_count").cast("bigint").alias("page_count"),
        *[F.coalesce(pdf_string(F.regexp_extract("info", f"/{key}{_LITERAL}", 1)), F.lit("")).alias(name) for key, name in _INFO],
    )


def pdf_fonts(objects: DataFrame) -> DataFrame:
    """``(path, obj_no, base_font, subtype, encoding, is_standard)``."""
    name = lambda key: F.nullif(F.regexp_extract("body", f"/{key}\\s*/([^\\s/<>\\[\\]()]+)", 1), F.lit(""))
    fonts = objects.filter(F.col("body").rlike("/Type\\s*/Font\\b(?!Desc)"))
    return fonts.select(
        "path", "obj_no", name("BaseFont").alias("base_font"), name("Subtype").alias("subtype"),
        F.coalesce(name("Encoding"), F.lit("WinAnsiEncoding")).alias("encoding"),
        F.coalesce(name("BaseFont").isin(*R.STANDARD_FONTS), F.lit(False)).alias("is_standard"),
    )
