"""Queries: scalar functions and plain-text operators."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import scalars as S
from ..functions import text as T
from ..functions.markdown import md_headings, md_tables
from ..operators import geometry, text as OT
from .tables import query, table


@query(
    "language_content_profile",
    """
    SELECT d.lang, count(*) AS documents, sum(len(string_split(text, chr(10)))) AS lines,
           sum(length(text)) AS characters,
           sum(len([l for l in string_split(text, chr(10)) if regexp_matches(l, '^(#{1,6})\\s+(.+)$')])) AS headings,
           sum(len([l for l in string_split(text, chr(10))
                    if len([c for c in string_split(l, '|') if regexp_matches(c, '\\S')]) > 1])) AS table_rows,
           count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) AS non_ascii_documents,
           round(avg(quality), 6) AS mean_quality
    FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.lang
    """,
)
def language_content_profile(spark, sf):
    """Flagship: content profile per language with the mean label quality."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    profile = T.text_profile(F.col("text"))
    return (
        docs.select(
            "doc_id", "lang", profile.alias("p"),
            F.size(md_headings(F.col("text"))).alias("headings"),
            F.size(md_tables(F.col("text"))).alias("table_rows"),
        )
        .join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.sum("p.line_count").alias("lines"),
            F.sum("p.char_count").alias("characters"),
            F.sum("headings").alias("headings"),
            F.sum("table_rows").alias("table_rows"),
            F.count_if("p.has_non_ascii").alias("non_ascii_documents"),
            F.round(F.avg("quality"), 6).alias("mean_quality"),
        )
    )


# ------------------------------------------------------------------ scalars


@query(
    "byte_reads",
    """
    SELECT o_orderkey, o_orderkey AS le_u32, o_orderkey AS be_u32, o_custkey % 65536 AS le_u16,
           o_custkey % 65536 AS be_u16, -(o_orderkey + 1) AS le_i32, -(o_custkey % 128) - 1 AS i8,
           o_orderkey % 256 AS u8, CAST(o_orderkey * 1000003 AS VARCHAR) AS le_u64, o_orderkey * 1000003 AS be_i64,
           '18446744073709551615' AS max_u64, -1 AS minus_one
    FROM orders
    """,
)
def byte_reads(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    blob = F.concat(
        S.pack_uint(k, 4), S.pack_uint(k, 4, False), S.pack_uint(c % 65536, 2), S.pack_uint(c % 65536, 2, False),
        S.pack_uint(F.lit(4294967295) - k, 4), S.pack_uint(F.lit(255) - c % 128, 1), S.pack_uint(k % 256, 1),
        S.pack_uint(k * 1000003, 8), S.pack_uint(k * 1000003, 8, False), F.unhex(F.lit("FF" * 8)),
    )
    b = F.col("blob")
    return table(spark, sf, "orders").select("o_orderkey", blob.alias("blob")).select(
        "o_orderkey",
        S.read_uint(b, 0, 4).alias("le_u32"), S.read_uint(b, 4, 4, False).alias("be_u32"),
        S.read_uint(b, 8, 2).alias("le_u16"), S.read_uint(b, 10, 2, False).alias("be_u16"),
        S.read_int(b, 12, 4).alias("le_i32"), S.read_int(b, 16, 1).alias("i8"), S.read_uint(b, 17, 1).alias("u8"),
        S.read_uint(b, 18, 8).cast("string").alias("le_u64"), S.read_int(b, 26, 8, False).alias("be_i64"),
        S.read_uint(b, 34, 8).cast("string").alias("max_u64"), S.read_int(b, 34, 8).alias("minus_one"),
    )


@F.pandas_udf(BinaryType())
def _ieee_bytes(x: pd.Series) -> pd.Series:
    """Fixture bytes: little-endian double, big-endian double, little-endian single."""
    return x.map(lambda v: struct.pack("<d", v) + struct.pack(">d", v) + struct.pack("<f", round(v) / 4))


@query(
    "byte_floats",
    """
    SELECT c_custkey, c_acctbal AS le_f64, -c_acctbal AS be_f64, round_even(c_acctbal, 0) / 4 AS le_f32
    FROM customer
    """,
)
def byte_floats(spark, sf):
    b = F.col("blob")
    return (
        table(spark, sf, "customer")
        .select("c_custkey", _ieee_bytes("c_acctbal").alias("blob"))
        .select("c_custkey", S.read_float(b, 0, 8).alias("le_f64"), (-S.read_float(b, 8, 8, False)).alias("be_f64"),
                S.read_float(b, 16, 4).alias("le_f32"))
    )


_SIZES = "CAST(floor(o_totalprice) AS BIGINT) * CAST(power(1024, o_orderkey % 4) AS BIGINT) - CASE WHEN o_orderkey % 5 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) * CAST(power(1024, o_orderkey % 4) AS BIGINT) - o_orderkey ELSE 0 END"


@query(
    "format_bytes",
    f"""
    WITH s AS (SELECT o_orderkey, {_SIZES} AS b FROM orders),
    u AS (SELECT o_orderkey, b,
      CASE WHEN b >= 1099511627776 THEN 4 WHEN b >= 1073741824 THEN 3 WHEN b >= 1048576 THEN 2
           WHEN b >= 1024 THEN 1 ELSE 0 END AS i5 FROM s),
    f AS (SELECT o_orderkey, b, i5, least(i5, 3) AS i4,
      format('{{:.2f}}', round(b / power(1024, i5), 2)) AS v5, format('{{:.2f}}', round(b / power(1024, least(i5, 3)), 2)) AS v4 FROM u)
    SELECT o_orderkey, b AS size,
      CASE WHEN i5 = 0 THEN b || ' B' ELSE regexp_replace(v5, '\\.?0+$', '') || ' ' || ['B','KB','MB','GB','TB'][i5 + 1] END AS short,
      CASE WHEN i4 = 0 THEN b || ' B' ELSE regexp_replace(v4, '\\.?0+$', '') || ' ' || ['B','KB','MB','GB'][i4 + 1] END AS short_gb,
      CASE WHEN i4 = 0 THEN b || ' B' ELSE v4 || ' ' || ['B','KB','MB','GB'][i4 + 1] END AS fixed,
      CASE WHEN i4 = 0 THEN b || ' B' ELSE v4 || ' ' || ['B','KB','MB','GB'][i4 + 1] END AS plain
    FROM f
    """,
)
def format_bytes(spark, sf):
    sized = table(spark, sf, "orders").select("o_orderkey", F.expr(_SIZES).alias("size"))
    return sized.select(
        "o_orderkey", "size", *[S.format_bytes(F.col("size"), s).alias(s) for s in ("short", "short_gb", "fixed", "plain")]
    )


@query(
    "format_duration",
    """
    WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice / 10 END AS v FROM orders),
    t AS (SELECT o_orderkey, CAST(floor(coalesce(v, 0)) AS BIGINT) AS n FROM s)
    SELECT o_orderkey, CASE WHEN n >= 3600
      THEN (n // 3600) || ':' || lpad(CAST(n % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0')
      ELSE (n // 60) || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') END AS shown
    FROM t
    """,
)
def format_duration(spark, sf):
    seconds = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice") / 10)
    return table(spark, sf, "orders").select("o_orderkey", S.format_duration(seconds).alias("shown"))


@query(
    "format_date",
    """
    SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '-' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS shown FROM events
    """,
)
def format_date(spark, sf):
    ts = F.when(F.col("event_id") % 10 != 0, F.col("ts"))
    return table(spark, sf, "events").select("event_id", S.format_date(ts).alias("shown"))


@query(
    "parse_color",
    """
    WITH c AS (SELECT o_orderkey, o_orderkey % 256 AS r, o_custkey % 256 AS g, (o_orderkey + o_custkey) % 256 AS b,
                      o_orderkey % 5 AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k = 4 THEN 0 ELSE r END AS r, CASE WHEN k = 4 THEN 0 ELSE g END AS g,
           CASE WHEN k = 4 THEN 0 ELSE b END AS b,
           round(CASE WHEN k = 1 THEN 128 / 255.0 WHEN k = 3 THEN 0.25 ELSE 1 END, 6) AS a
    FROM c
    """,
)
def parse_color(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = [k % 256, c % 256, (k + c) % 256]
    hexed = F.concat(*[F.lpad(F.lower(F.hex(p)), 2, "0") for p in parts])
    decimal = F.concat_ws(", ", *[p.cast("string") for p in parts])
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("#"), hexed))
        .when(k % 5 == 1, F.concat(F.lit("#80"), hexed))
        .when(k % 5 == 2, F.concat(F.lit("rgb("), decimal, F.lit(")")))
        .when(k % 5 == 3, F.concat(F.lit("rgba("), decimal, F.lit(", 0.25)")))
        .otherwise(F.lit("tomato"))
    )
    col = S.parse_color(F.col("c"))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("c")).select(
        "o_orderkey", col["r"].alias("r"), col["g"].alias("g"), col["b"].alias("b"), F.round(col["a"], 6).alias("a")
    )


@query(
    "parse_style",
    """
    SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) || 'pt' AS size, p_brand AS font, 'http' AS url, 4 AS entries
    FROM part
    """,
)
def parse_style(spark, sf):
    text = F.concat(
        F.lit(" name : old;name: "), "p_name", F.lit(" ;;size:"), F.col("p_size").cast("string"), F.lit("pt; font :"), "p_brand",
        F.lit(";url:http://x;broken;empty:"),
    )
    m = F.col("m")
    return table(spark, sf, "part").select("p_partkey", S.parse_style(text).alias("m")).select(
        "p_partkey", *[m[k].alias(k) for k in ("name", "size", "font", "url")], F.size(m).alias("entries")
    )


@query(
    "clamp_nearest_fit",
    """
    WITH v AS (SELECT c_custkey, c_acctbal / 2000 AS x, c_acctbal AS w, abs(c_acctbal) / 3 + 1 AS h FROM customer)
    SELECT c_custkey, least(greatest(x, 0.1), 4.0) AS clamped,
      CASE WHEN x <= 0.375 THEN 0.25 WHEN x <= 0.625 THEN 0.5 WHEN x <= 0.875 THEN 0.75 WHEN x <= 1.25 THEN 1
           WHEN x <= 1.75 THEN 1.5 WHEN x <= 2.5 THEN 2 WHEN x <= 3.5 THEN 3 ELSE 4 END AS nearest,
      round(CASE WHEN w = 0 THEN 1 ELSE greatest(least(least(780 / w, 580 / h), 1), 0.01) END, 9) AS contain,
      round(CASE WHEN w = 0 THEN 1 ELSE greatest(least(greatest(800 / w, 600 / h), 2), 0.01) END, 9) AS cover
    FROM v
    """,
)
def clamp_nearest_fit(spark, sf):
    bal = F.col("c_acctbal")
    x, w, h = bal / 2000, bal, F.abs(bal) / 3 + 1
    return table(spark, sf, "customer").select(
        "c_custkey", S.clamp(x, 0.1, 4.0).alias("clamped"), S.nearest_bucket(x).alias("nearest"),
        F.round(S.fit_ratio(w, h, 800, 600, padding=10), 9).alias("contain"),
        F.round(S.fit_ratio(w, h, 800, 600, contain=False, cap=2.0), 9).alias("cover"),
    )


@query(
    "page_slice",
    """
    WITH l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS page, unnest(ls) AS content, len(ls) AS n
               FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
    SELECT doc_id, page, content FROM l WHERE page = greatest(0, least(doc_id % 12 - 2, n - 1))
    """,
)
def page_slice(spark, sf):
    pages = OT.number_lines(table(spark, sf, "documents"), "doc_id", "text").select(
        "doc_id", (F.col("line_no") - 1).alias("page"), F.col("line").alias("content")
    )
    return geometry.page_slice(pages, ["doc_id"], "page", (F.col("doc_id") % 12 - 2).cast("int"))


@query(
    "point_distance",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(power(l_quantity - 10, 2) + power(l_linenumber - 3, 2)), 9) AS distance
    FROM lineitem
    """,
)
def point_distance(spark, sf):
    d = S.distance(F.lit(10.0), F.lit(3.0), F.col("l_quantity"), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(d, 9).alias("distance"))


@query(
    "point_centroid",
    """
    SELECT l_suppkey, avg(l_quantity) AS x, avg(l_linenumber) AS y FROM lineitem GROUP BY l_suppkey
    """,
)
def point_centroid(spark, sf):
    return geometry.centroid(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_linenumber")


@query(
    "hex_magic",
    """
    SELECT doc_id, upper(hex(encode(text))[1:16]) AS magic, hex(encode(text))[1:4] = '4573' AS starts_es FROM documents
    """,
)
def hex_magic(spark, sf):
    raw = F.encode("text", "UTF-8")
    return table(spark, sf, "documents").select(
        "doc_id", S.hex_magic(raw).alias("magic"), S.match_magic(raw, "4573").alias("starts_es")
    )


@query(
    "cstrings",
    """
    SELECT c_custkey, c_name AS first, length(c_name) + 1 AS next_offset, c_mktsegment AS second, 'BUILDING'[1:4] AS fixed FROM customer
    """,
)
def cstrings(spark, sf):
    nul = F.unhex(F.lit("00"))
    blob = F.concat(F.encode("c_name", "UTF-8"), nul, F.encode("c_mktsegment", "UTF-8"), nul, F.encode(F.lit("BUILDING"), "UTF-8"))
    first = S.cstring(F.col("blob"))
    second = S.cstring(F.col("blob"), F.col("first.next_offset"))
    return (
        table(spark, sf, "customer").select("c_custkey", blob.alias("blob")).withColumn("first", first)
        .withColumn("second", second)
        .select("c_custkey", "first.text", "first.next_offset", F.col("second.text").alias("second"),
                S.fixed_string(F.col("blob"), F.col("second.next_offset"), 4).alias("fixed"))
        .withColumnRenamed("text", "first")
    )


@query(
    "data_uris",
    """
    SELECT doc_id, to_base64(encode(text)) AS payload, 'data:text/plain;base64,' || to_base64(encode(text)) AS uri FROM documents
    """,
)
def data_uris(spark, sf):
    raw = F.encode("text", "UTF-8")
    return table(spark, sf, "documents").select(
        "doc_id", S.to_base64(raw).alias("payload"), S.data_uri(F.lit("text/plain"), raw).alias("uri")
    )


@query(
    "path_parts",
    """
    SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(url, '[^/]*$', '') AS dir FROM pages
    """,
)
def path_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.basename(F.col("url")).alias("base"), S.dirname(F.col("url")).alias("dir"))


# ------------------------------------------------------------------ text


@query(
    "text_profile",
    """
    SELECT doc_id, len(string_split(text, chr(10))) AS line_count, length(text) AS char_count, strlen(text) AS size,
           regexp_matches(text, '[^\\x00-\\x7F]') AS has_non_ascii
    FROM documents
    """,
)
def text_profile(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.text_profile(F.col("text")).alias("p")).select("doc_id", "p.*")


_LINES = """l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line
               FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


@query("number_lines", f"WITH {_LINES} SELECT doc_id, line_no, line FROM l")
def number_lines(spark, sf):
    return OT.number_lines(table(spark, sf, "documents"), "doc_id", "text")


_HITS = f"""{_LINES},
    p AS (SELECT doc_id, line_no, string_split(lower(line), 'en') AS parts FROM l WHERE contains(lower(line), 'en')),
    h AS (SELECT doc_id, line_no, k, list_sum([len(x) for x in parts[1:k]]) + (k - 1) * 2 AS start_index
          FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS k FROM p))"""


@query("keyword_hits", f"WITH {_HITS} SELECT doc_id, line_no, start_index, start_index + 2 AS end_index FROM h")
def keyword_hits(spark, sf):
    return OT.keyword_hits(table(spark, sf, "documents"), "doc_id", "text", "en")


@query(
    "hit_navigation",
    f"""
    WITH {_HITS},
    o AS (SELECT *, row_number() OVER w AS current, count(*) OVER (PARTITION BY doc_id) AS total,
                 lead(line_no) OVER w AS nx, lag(line_no) OVER w AS pv,
                 min(line_no) OVER (PARTITION BY doc_id) AS first_line, max(line_no) OVER (PARTITION BY doc_id) AS last_line
          FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, start_index))
    SELECT doc_id, current, total, line_no, start_index, coalesce(nx, first_line) AS next_line,
           coalesce(pv, last_line) AS previous_line FROM o
    """,
)
def hit_navigation(spark, sf):
    return OT.hit_navigation(table(spark, sf, "documents"), "doc_id", "text", "en")


@query(
    "highlight",
    """
    SELECT doc_id, regexp_replace(text, '(?i)en', '<span class="txt-search-highlight">\\0</span>', 'g') AS html FROM documents
    """,
)
def highlight(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.highlight(F.col("text"), "en").alias("html"))


@query(
    "word_char_count",
    """
    SELECT conv_id, turn, len(regexp_extract_all(text, '[^\\s]+')) AS words, length(text) AS chars FROM conversations
    """,
)
def word_char_count(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.word_count(F.col("text")).alias("words"), F.length("text").cast("bigint").alias("chars")
    )


@query(
    "entity_escapes",
    """
    SELECT page_id,
      replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml,
      replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
      replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''') AS plain
    FROM pages
    """,
)
def entity_escapes(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", T.xml_escape(h).alias("xml"), T.html_escape(h).alias("html"), T.xml_unescape(h).alias("plain")
    )


@query("salvage_ascii", "SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS salvaged FROM documents")
def salvage_ascii(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.salvage_ascii(F.encode("text", "UTF-8")).alias("salvaged"))


@query(
    "salvage_text",
    """
    SELECT c_custkey, c_name || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '你们' ELSE '' END || c_mktsegment AS doc_text,
           'tail' || chr(10) || c_name AS slide_text
    FROM customer
    """,
)
def salvage_text(spark, sf):
    """Legacy binaries built from customer rows: header bytes, CR, control bytes, GBK pairs, stray low bytes."""
    name, seg = F.encode("c_name", "UTF-8"), F.encode("c_mktsegment", "UTF-8")
    gbk = F.when(F.col("c_custkey") % 2 == 0, F.unhex(F.lit("C4E3C3C7"))).otherwise(F.unhex(F.lit("80BF")))
    doc = F.concat(F.unhex(F.lit("41" * 1024)), name, F.unhex(F.lit("0D0107")), gbk, seg, F.unhex(F.lit("0020")))
    slide = F.concat(F.unhex(F.lit("42" * 512)), F.unhex(F.lit("0A")), F.encode(F.lit("tail"), "UTF-8"), F.unhex(F.lit("0A7F")), name)
    return table(spark, sf, "customer").select("c_custkey", doc.alias("doc"), slide.alias("slide")).select(
        "c_custkey", OT.salvage_text(F.col("doc")).alias("doc_text"), OT.salvage_text(F.col("slide"), 512).alias("slide_text")
    )


@query(
    "rtf_runs",
    """
    SELECT p_partkey, r.run_no, CASE r.run_no WHEN 1 THEN 'Arial;' WHEN 2 THEN p_name ELSE p_brand || ' {x} é' END AS text,
           r.font, r.color, r.bg_color, CASE r.run_no WHEN 1 THEN 12.0 ELSE p_size END AS font_size,
           r.bold, r.italic, r.underline
    FROM part, (VALUES (1, 3, 0, -1, false, false, false), (2, 0, 2, -1, true, false, false),
                       (3, 0, 2, 5, false, true, true)) r(run_no, font, color, bg_color, bold, italic, underline)
    """,
)
def rtf_runs(spark, sf):
    text = F.concat(
        F.lit("{\\rtf1\\ansi{\\fonttbl{\\f3 Arial;}}\\f0\\fs"), (F.col("p_size") * 2).cast("string"), F.lit("\\cf2\\b "), "p_name",
        F.lit("\\par\\b0\\i\\ul\\cb5 "), "p_brand", F.lit(" \\{x\\} \\'e9\\par   \\par}"),
    )
    return OT.rtf_runs(table(spark, sf, "part").select("p_partkey", text.alias("rtf")), "p_partkey", "rtf")


@query(
    "rtf_meta",
    """
    SELECT p_partkey, p_partkey % 9 <> 0 AS valid, ' ' || p_name AS title,
           CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_brand END AS author, '{' || chr(92) || '*' || chr(92) || 'creatim 2020}' AS create_time
    FROM part
    """,
)
def rtf_meta(spark, sf):
    text = F.concat(
        F.when(F.col("p_partkey") % 9 == 0, F.lit("{\\rtx1")).otherwise(F.lit(" {\\rtf1")),
        F.lit("{\\*\\title "), "p_name", F.lit("}"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("{\\*\\author "), F.col("p_brand"), F.lit("}"))).otherwise(F.lit("")),
        F.lit("{\\*\\creatim 2020}}"),
    )
    return table(spark, sf, "part").select("p_partkey", OT.rtf_meta(text).alias("m")).select("p_partkey", "m.*")
