"""Text operators over a (key, text) DataFrame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import is_blank, line_hit_starts, lines_of, literal_pattern, salvage_pieces, trim_space


def number_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line with its 1-based number."""
    return docs.select(key, F.posexplode(lines_of(F.col(text))).alias("pos", "line")).select(
        key, (F.col("pos") + 1).alias("line_no"), "line"
    )


def keyword_hits(docs: DataFrame, key: str, text: str, keyword: str) -> DataFrame:
    """line (1-based), start and end (0-based) of every literal, case-insensitive match."""
    return (
        number_lines(docs, key, text)
        .filter(F.col("line").rlike(literal_pattern(keyword)))
        .select(key, "line_no", F.explode(line_hit_starts(F.col("line"), keyword)).alias("start_index"))
        .withColumn("end_index", F.col("start_index") + len(keyword))
    )


def hit_navigation(docs: DataFrame, key: str, text: str, keyword: str) -> DataFrame:
    """Each hit with its ``current/total`` label and the lines of its circular neighbours."""
    hits = F.flatten(
        F.transform(
            lines_of(F.col(text)),
            lambda line, i: F.transform(
                line_hit_starts(line, keyword), lambda s: F.struct((i + 1).alias("line_no"), s.alias("start_index"))
            ),
        )
    )
    found = docs.select(key, hits.alias("hits")).withColumn("total", F.size("hits")).filter("total > 0")
    h, n = F.col("hits"), F.col("total")
    linked = F.transform(
        h,
        lambda hit, i: F.struct(
            (i + 1).alias("current"),
            n.alias("total"),
            hit["line_no"].alias("line_no"),
            hit["start_index"].alias("start_index"),
            F.get(h, (i + 1) % n)["line_no"].alias("next_line"),
            F.get(h, (i - 1 + n) % n)["line_no"].alias("previous_line"),
        ),
    )
    return found.select(key, F.inline(linked))


@F.pandas_udf(StringType())
def _decode_gbk(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace"))


def salvage_text(content: Column, start: int = 1024, end: int | None = None) -> Column:
    """Readable text of a legacy binary: ASCII, line feeds and GBK pairs of bytes from ``start`` on.

    The charset is outside what the JVM's ``decode`` accepts, so contents that hold high bytes take
    one Arrow round trip; pure ASCII ones are passed to the worker as nulls.
    """
    pieces = salvage_pieces(content, start, end)
    high = pieces.rlike("[\\x80-\\xFF]")
    decoded = _decode_gbk(F.when(high, F.encode(pieces, "ISO-8859-1")))
    return trim_space(F.coalesce(decoded, pieces))


# One RTF token: escaped symbol, hex character, control word (with one trailing blank), group mark, text.
_RTF_TOKEN = (
    "(\\\\[\\\\{}]|\\\\'[0-9a-fA-F]{2}|\\\\[a-zA-Z]++(?:-?\\d++)? ?|\\\\[^a-zA-Z]|[{}]|[^\\\\{}]++)"
)


def rtf_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Styled text runs of RTF documents.

    A run ends at a closing brace, ``\\par`` or ``\\line`` and carries the style in force there.
    One window per document follows the style state and numbers the runs; the closing aggregation
    reuses that partitioning.
    """
    tokens = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(_RTF_TOKEN), F.lit(1))).alias("pos", "tok"))
    word = F.regexp_extract("tok", "^\\\\([a-zA-Z]+)", 1)
    param = F.regexp_extract("tok", "^\\\\[a-zA-Z]+(-?\\d+)", 1).try_cast("int")
    t = tokens.select(
        key, "pos", "tok",
        F.when(F.col("tok").rlike("^\\\\[a-zA-Z]"), word).alias("word"),
        F.when(F.col("tok").rlike("^\\\\[a-zA-Z]"), param).alias("param"),
    )
    flush = (F.col("tok") == "}") | F.col("word").isin("par", "line")
    piece = (
        F.when(F.col("word") == "tab", "\t")
        .when(F.col("tok").rlike("^\\\\[\\\\{}]$"), F.substring("tok", 2, 1))
        .when(F.col("tok").startswith("\\'"), F.decode(F.unhex(F.substring("tok", 3, 2)), "ISO-8859-1"))
        .when(~F.col("tok").rlike("^[\\\\{}]"), F.col("tok"))
    )

    def setting(name: str, value: Column) -> Column:
        return F.when(F.col("word") == name, value)

    p = F.col("param")
    states = {
        "font": setting("f", F.coalesce(p, F.lit(0))),
        "color": setting("cf", F.coalesce(p, F.lit(0))),
        "bg_color": setting("cb", F.coalesce(F.nullif(p, F.lit(0)), F.lit(-1))),
        "font_size": setting("fs", F.coalesce(F.nullif(p, F.lit(0)), F.lit(24)) / 2),
        "bold": setting("b", F.coalesce(p != 0, F.lit(True))),
        "italic": setting("i", F.coalesce(p != 0, F.lit(True))),
        "underline": setting("ul", F.coalesce(p != 0, F.lit(True))),
    }
    start = {"font": 0, "color": 0, "bg_color": -1, "font_size": 12.0, "bold": False, "italic": False, "underline": False}
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = t.select(
        key, "pos", piece.alias("piece"),
        F.coalesce(F.count(F.when(flush, 1)).over(before), F.lit(0)).alias("run"),
        F.struct(*[
            F.coalesce(F.last(value, ignorenulls=True).over(so_far), F.lit(start[name])).alias(name)
            for name, value in states.items()
        ]).alias("style"),
    )
    runs = marked.groupBy(key, "run").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))),
                        lambda x: x["piece"]), "").alias("raw"),
        F.max_by("style", "pos").alias("style"),
    )
    in_order = Window.partitionBy(key).orderBy("run")
    return runs.filter(~is_blank(F.col("raw"))).select(
        key, F.row_number().over(in_order).alias("run_no"), trim_space(F.col("raw")).alias("text"), "style.*"
    )


def rtf_meta(text: Column) -> Column:
    """valid, title, author, create_time of an RTF document, the groups taken as written."""
    def group(name: str, pattern: str, index: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern.format(name), index), F.lit(""))

    inner = "\\{{\\\\\\*\\\\{}([^}}]+)\\}}"
    return F.struct(
        trim_space(text).startswith("{\\rtf1").alias("valid"),
        group("title", inner, 1).alias("title"),
        group("author", inner, 1).alias("author"),
        group("creatim", inner, 0).alias("create_time"),
    )
