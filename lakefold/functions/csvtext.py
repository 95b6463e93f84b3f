"""CSV held in a text column, parsed record by record and field by field.

All patterns are possessive: the regex engine then loops instead of recursing, so a record of any
length is matched with constant stack.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import at, let
from .text import is_blank, lines_of, trim_space


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    has_header: bool = True

    @property
    def q(self) -> str:
        return re.escape(self.quote)

    @property
    def d(self) -> str:
        return re.escape(self.delimiter)

    @property
    def escaped_quote(self) -> str:
        return re.escape(self.escape) + self.q

    @property
    def quoted_body(self) -> str:
        """Inside of a quoted section: escaped quotes or anything that is not a quote."""
        return f"(?:{self.escaped_quote}|[^{self.q}])*+"


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def csv_records(text: Column, opt: CsvOptions = CsvOptions()) -> Column:
    """Records split on line feeds outside quotes; every quote character toggles the state."""
    q = opt.q
    pattern = f"([^{q}\\n]*+(?:{q}[^{q}]*+(?:{q}|\\z)[^{q}\\n]*+)*+)(?:\\n|\\z)"
    found = F.regexp_extract_all(normalize_newlines(text), F.lit(pattern), F.lit(1))
    # the end of the text always matches once more with an empty record
    return let(found, lambda r: F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))))


def csv_fields(record: Column, opt: CsvOptions = CsvOptions()) -> Column:
    """Fields of one record, trimmed, quotes removed and escaped quotes restored."""
    quoted = f"{opt.q}{opt.quoted_body}{opt.q}"
    rest = F.regexp_replace(record, opt.escaped_quote, "") if opt.escape != opt.quote else record
    open_ended = F.regexp_count(rest, F.lit(opt.q)) % 2 == 1
    closed = F.when(open_ended, F.concat(record, F.lit(opt.quote))).otherwise(record)
    raw = F.regexp_extract_all(
        F.concat(closed, F.lit(opt.delimiter)),
        F.lit(f"((?:[^{opt.q}{opt.d}]|{quoted})*+){opt.d}"),
        F.lit(1),
    )

    def unquote(field: Column) -> Column:
        bare = F.regexp_replace(field, f"{opt.q}({opt.quoted_body}){opt.q}", "$1")
        return F.when(F.contains(field, F.lit(opt.quote)), F.replace(bare, F.lit(opt.escape + opt.quote), F.lit(opt.quote))
                      ).otherwise(field)

    return F.transform(raw, lambda f: trim_space(unquote(f)))


def csv_rows(text: Column, opt: CsvOptions = CsvOptions()) -> Column:
    """``array<struct<row_num, columns, raw_line>>`` of the non-blank records, header included."""
    numbered = F.transform(
        csv_records(text, opt), lambda r, i: F.struct((i + 1).cast("int").alias("row_num"), r.alias("raw_line"))
    )
    return F.transform(
        F.filter(numbered, lambda r: ~is_blank(r["raw_line"])),
        lambda r: F.struct(r["row_num"], csv_fields(r["raw_line"], opt).alias("columns"), r["raw_line"]),
    )


def csv_header(rows: Column, opt: CsvOptions = CsvOptions()) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(at(rows, 0)["columns"], empty) if opt.has_header else empty


def csv_data(rows: Column, opt: CsvOptions = CsvOptions()) -> Column:
    return let(rows, lambda r: F.slice(r, F.lit(2), F.greatest(F.size(r), F.lit(1)))) if opt.has_header else rows


def header_map(header: Column, columns: Column) -> Column:
    """Header-keyed values; missing fields null, surplus dropped, the last of equal headers wins."""
    def build(head: Column) -> Column:
        entries = F.transform(head, lambda h, i: F.struct(h.alias("key"), F.get(columns, i).alias("value"), i.alias("i")))
        last = F.filter(entries, lambda e: ~F.exists(F.slice(head, e["i"] + 2, F.size(head)), lambda h: h == e["key"]))
        return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))

    return let(header, build)


def csv_profile(text: Column, opt: CsvOptions = CsvOptions()) -> Column:
    """Estimates from physical lines: non-blank lines (header counted), width of the first one, size."""
    lines = F.filter(lines_of(normalize_newlines(text)), lambda line: ~is_blank(line))
    return F.struct(
        F.size(lines).cast("bigint").alias("estimated_rows"),
        F.size(csv_fields(F.coalesce(at(lines, 0), F.lit("")), opt)).cast("bigint").alias("estimated_columns"),
        F.octet_length(text).cast("bigint").alias("size"),
        F.lit(opt.delimiter).alias("delimiter"),
        F.lit(opt.has_header).alias("has_header"),
    )


def is_valid_csv(text: Column) -> Column:
    return F.coalesce(~is_blank(text), F.lit(False))


def csv_escape(value: Column, opt: CsvOptions = CsvOptions()) -> Column:
    """Quote a value only when it holds the delimiter, a line feed or the quote; null is empty."""
    text = value.cast("string")
    special = text.rlike(f"[{opt.d}\\n{opt.q}]")
    doubled = F.replace(text, F.lit(opt.quote), F.lit(opt.escape + opt.quote))
    return F.when(text.isNull(), F.lit("")).when(
        special, F.concat(F.lit(opt.quote), doubled, F.lit(opt.quote))
    ).otherwise(text)


def csv_line(*values: Column, opt: CsvOptions = CsvOptions()) -> Column:
    return F.concat_ws(opt.delimiter, *[csv_escape(v, opt) for v in values])
