"""Queries: word-processor and presentation packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive as OA
from ..operators import docs as OP
from ..operators import slides as OL
from ..sources.archive import archive_parts
from . import fixtures as X
from .tables import query, table


def _docx(spark, sf, media=False):
    return OP.open_documents(X.docx_documents(table(spark, sf, "documents")), media)


_LINES = """g AS (SELECT *, 'd' || doc_id || '.docx' AS path, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id % 10 <> 7),
    l AS (SELECT path, unnest(generate_series(0, len(ls) - 1)) AS i, unnest(ls) AS line, len(ls) AS n FROM g)"""
_TAIL = """SELECT path, len(ls) AS i, lang AS text, true AS in_table FROM g UNION ALL SELECT path, len(ls) + 1, source, true FROM g UNION ALL SELECT path, len(ls) + 2, 'n', true FROM g
    UNION ALL SELECT path, len(ls) + 3, CAST(doc_id AS VARCHAR), true FROM g UNION ALL SELECT path, len(ls) + 4, 'out', false FROM g UNION ALL SELECT path, len(ls) + 5, 'boxed', false FROM g"""
_PARS = f"""{_LINES}, tail AS ({_TAIL}), pars AS (SELECT path, i, line AS text, CASE WHEN i % 2 = 0 THEN 'center' END AS align, false AS in_table FROM l WHERE line <> ''
    UNION ALL SELECT path, i, text, NULL, in_table FROM tail), p AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS par_no FROM pars)"""


@query("paragraphs", f"WITH {_PARS} SELECT path, par_no, text, in_table FROM p")
def paragraphs(spark, sf):
    return OP.paragraphs(_docx(spark, sf)).select("path", "par_no", "text", "in_table")


@query("paragraph_align", f"WITH {_PARS} SELECT path, par_no, align FROM p")
def paragraph_align(spark, sf):
    return OP.paragraphs(_docx(spark, sf)).select("path", "par_no", "align")


@query(
    "paragraphs_trimmed",
    f"""
    WITH {_LINES}, tail AS ({_TAIL})
    SELECT path, i AS par_no, line AS text, true AS bold, true AS italic, true AS underline, 14 AS font_size, '#000000' AS color FROM l WHERE regexp_matches(line, '\\S')
    UNION ALL SELECT path, i, text, false, false, false, NULL, NULL FROM tail
    """,
)
def paragraphs_trimmed(spark, sf):
    return OP.paragraphs_trimmed(_docx(spark, sf))


@query(
    "runs",
    f"""
    WITH {_PARS}, r AS (SELECT path, par_no, 0 AS run_no, CASE WHEN align IS NULL AND i >= (SELECT max(n) FROM l WHERE l.path = p.path) THEN text ELSE text[1:5] END AS text,
        i < (SELECT max(n) FROM l WHERE l.path = p.path) AS styled FROM p)
    SELECT path, par_no, run_no, text, styled AS bold, false AS italic, CAST(NULL AS VARCHAR) AS underline, CASE WHEN styled THEN 14 END AS font_size,
      CASE WHEN styled THEN '#FF0000' END AS color, CASE WHEN styled THEN 'Arial' END AS font_family FROM r
    UNION ALL SELECT path, par_no, 1, text[6:], false, true, 'single', NULL, NULL, NULL FROM p
      WHERE length(text) > 5 AND i < (SELECT max(n) FROM l WHERE l.path = p.path)
    """,
)
def runs(spark, sf):
    return OP.runs(_docx(spark, sf))


@query(
    "doc_tables",
    f"""
    WITH {_LINES} SELECT path, 0 AS table_no, 1 AS depth, 0 AS row_no, 0 AS col_no, lang AS text FROM g UNION ALL SELECT path, 0, 1, 0, 1, source || 'n' FROM g
    UNION ALL SELECT path, 0, 1, 1, 0, CAST(doc_id AS VARCHAR) FROM g UNION ALL SELECT path, 1, 2, 0, 0, 'n' FROM g
    """,
)
def doc_tables(spark, sf):
    return OP.doc_tables(_docx(spark, sf))


@query(
    "doc_styles",
    f"""
    WITH {_LINES} SELECT path, v.* FROM g, (VALUES ('T1', 'paragraph', 'Title', 'Normal'), ('H1', 'paragraph', 'heading 1', ''), ('Odd', 'paragraph', 'Odd Style', '')) v(style_id, type, name, based_on)
    """,
)
def doc_styles(spark, sf):
    return OP.doc_styles(_docx(spark, sf))


@query(
    "doc_relationships",
    f"""
    WITH {_LINES} SELECT path, v.* FROM g, (VALUES ('rId1', 'urn/styles', 'styles.xml'), ('rId2', 'urn/image', 'media/image1.png'), ('rId3', 'urn/image', '../media/two.JPG'),
      ('rId4', 'urn/image', 'media/none.png')) v(id, type, target)
    """,
)
def doc_relationships(spark, sf):
    return OP.doc_relationships(_docx(spark, sf))


@query(
    "doc_images",
    f"""
    WITH {_LINES} SELECT path, 'rId2' AS id, 'image/png' AS mime_type, 'media/image1.png' AS original_path, 'word/media/image1.png' AS part, source AS content FROM g
    UNION ALL SELECT path, 'rId3', 'image/jpeg', '../media/two.JPG', 'media/two.JPG', lang FROM g
    """,
)
def doc_images(spark, sf):
    return OP.doc_images(_docx(spark, sf, media=True)).withColumn("content", F.col("data").cast("string")).drop("data")


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_HTML = f"""h AS (SELECT path, string_agg(CASE WHEN line = '' THEN '' ELSE '<' || tag || '><strong>' || {_ESC.format('line[1:5]')} || '</strong>' ||
    CASE WHEN length(line) > 5 THEN '<em>' || {_ESC.format('line[6:]')} || '</em>' ELSE '' END || '</' || tag || '>' END, '' ORDER BY i) AS html
    FROM (SELECT *, CASE i WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' ELSE 'p' END AS tag FROM l) GROUP BY path)"""
_RAW = "array_to_string(ls || [lang, source, 'n', CAST(doc_id AS VARCHAR), 'out', 'boxed', ''], chr(10) || chr(10))"


@query(
    "docx_html",
    f"""
    WITH {_LINES}, {_HTML}
    SELECT path, html || '<table><tr><td><p>' || lang || '</p></td><td><p>' || source || '</p><table><tr><td><p>n</p></td></tr></table></td></tr><tr><td><p>' || doc_id
        || '</p></td></tr></table><p>out</p><p>boxed</p>' AS html, {_RAW} AS raw_text,
      CASE WHEN len(ls) > 2 AND NOT (ls[3] = '') THEN 'Unrecognised paragraph style: Odd Style' ELSE '' END AS warnings, '' AS errors
    FROM g JOIN h USING (path)
    UNION ALL SELECT 'd' || doc_id || '.docx', NULL, NULL, NULL, 'BadZipFile' FROM documents WHERE doc_id % 10 = 7
    """,
)
def docx_html(spark, sf):
    out = OP.docx_html(_docx(spark, sf))
    return out.select("path", "html", "raw_text", F.array_join("warnings", "|").alias("warnings"),
                      F.array_join(F.transform("errors", lambda e: F.split_part(e, F.lit(":"), F.lit(1))), "|").alias("errors"))


@query(
    "doc_info",
    f"""
    WITH {_LINES} SELECT path, true AS sized, len(regexp_extract_all({_RAW}, '[^\\s]+')) AS word_count, length({_RAW}) AS char_count FROM g
    UNION ALL SELECT 'd' || doc_id || '.docx', true, NULL, NULL FROM documents WHERE doc_id % 10 = 7
    """,
)
def doc_info(spark, sf):
    files = X.docx_documents(table(spark, sf, "documents"))
    return OP.doc_info(files, OP.open_documents(files)).select("path", (F.col("file_size") > 100).alias("sized"), "word_count", "char_count")


# ------------------------------------------------------------------ WPS


def _wps(spark, sf):
    return OP.open_wps(X.wps_parts(table(spark, sf, "part")))


@query(
    "wps_content",
    """
    WITH p AS (SELECT *, 'p' || p_partkey || '.wps' AS path, p_partkey % 3 AS k FROM part)
    SELECT path, 'paragraph' AS kind, 0 AS block_no, NULL AS row_no, NULL AS col_no, p_name || ' é&' AS text, 'center' AS align FROM p WHERE k = 0
    UNION ALL SELECT path, 'paragraph', 1, NULL, NULL, 'whole ' || p_brand, 'left' FROM p WHERE k = 0
    UNION ALL SELECT path, 'table', 0, 0, 0, p_name, NULL FROM p WHERE k > 0
    UNION ALL SELECT path, 'table', 0, k - 1, 2 - k, p_brand, NULL FROM p WHERE k > 0
    """,
)
def wps_content(spark, sf):
    return OP.wps_content(_wps(spark, sf))


@query(
    "wps_styles",
    """
    SELECT 'p' || p_partkey || '.wps' AS path, v.* FROM part, (VALUES ('s1', 3, 'Arial'), ('only', 2, NULL)) v(style_id, attributes, font)
    """,
)
def wps_styles(spark, sf):
    return OP.wps_styles(_wps(spark, sf)).select("path", "style_id", F.size("attributes").alias("attributes"), F.try_element_at("attributes", F.lit("font")).alias("font"))


# ------------------------------------------------------------------ presentations


def _decks(spark, sf, media=False):
    return OL.open_presentations(X.pptx_parts(table(spark, sf, "part")), media)


_DECK = "d AS (SELECT *, 'p' || p_partkey || '.pptx' AS path FROM part WHERE p_partkey % 10 <> 7)"


@query(
    "slides",
    f"""
    WITH {_DECK} SELECT path, v.* FROM d, (VALUES (1, '256', '3', 'ppt/slides/slide2.xml'), (2, '257', '2', 'ppt/slides/slide1.xml'), (3, '258', '9', 'ppt/slides/slide9.xml'))
      v(slide_no, id, rel_no, part)
    """,
)
def slides(spark, sf):
    return OL.slides(_decks(spark, sf))


@query(
    "first_n_slides",
    f"""
    WITH {_DECK} SELECT path, v.*, 3 AS total_slides, 2 AS loaded_slides, 'two' AS asked FROM d, (VALUES (1, '256', 5), (2, '257', 1)) v(slide_no, id, element_count)
    UNION ALL SELECT path, v.*, 3, 3, 'all' FROM d, (VALUES (1, '256', 5), (2, '257', 1), (3, '3', 0)) v(slide_no, id, element_count)
    """,
)
def first_n_slides(spark, sf):
    decks = _decks(spark, sf).repartition("path")  # both calls read one exchange, so the packages are opened once
    return OL.first_n_slides(decks, 2).withColumn("asked", F.lit("two")).unionByName(OL.first_n_slides(decks, 9).withColumn("asked", F.lit("all")))


@query(
    "slide_text_runs",
    f"""
    WITH {_DECK} SELECT path, 1 AS slide_no, 0 AS shape_no, 0 AS run_no, p_name AS text, true AS bold, false AS italic, 24 AS font_size, 'FF0000' AS color,
        p_size AS x, 2 AS y, 100 AS width, p_partkey AS height FROM d
    UNION ALL SELECT path, 1, 0, 1, p_brand, false, true, 18, '000000', p_size, 2, 100, p_partkey FROM d
    UNION ALL SELECT path, 2, 0, 0, 'solo', false, false, 18, '000000', 0, 0, 9144000, 6858000 FROM d
    """,
)
def slide_text_runs(spark, sf):
    return OL.slide_text_runs(_decks(spark, sf))


@query("slide_images", f"WITH {_DECK} SELECT path, 1 AS slide_no, 'rId7' AS rel, 'ppt/media/a.png' AS part, p_type AS content, p_size AS x, 100 AS width FROM d")
def slide_images(spark, sf):
    return OL.slide_images(_decks(spark, sf, media=True)).select("path", "slide_no", "rel", "part", F.col("data").cast("string").alias("content"), "x", "width")


@query(
    "slide_shapes",
    f"""
    WITH {_DECK} SELECT path, 1 AS slide_no, 1 AS shape_no, '00FF00' AS fill, 'ellipse' AS geometry, p_size AS x, 2 AS y, 100 AS width, p_partkey AS height FROM d
    UNION ALL SELECT path, 1, 2, 'FFFFFF', 'rect', 0, 0, 100000, 100000 FROM d
    """,
)
def slide_shapes(spark, sf):
    return OL.slide_shapes(_decks(spark, sf))


@query(
    "slide_transition",
    f"""
    WITH {_DECK} SELECT path, 1 AS slide_no, 'fade' AS transition, 500 AS duration_ms FROM d
    UNION ALL SELECT path, 2, CASE WHEN p_partkey % 2 = 0 THEN 'none' END, CASE WHEN p_partkey % 2 = 0 THEN 500 END FROM d UNION ALL SELECT path, 3, NULL, NULL FROM d
    """,
)
def slide_transition(spark, sf):
    return OL.slide_transition(_decks(spark, sf))


@query("emu_to_px", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN 100000 ELSE CAST(floor(l_partkey * 1000 / 9525 + 0.5) AS BIGINT) END AS px FROM lineitem")
def emu_to_px(spark, sf):
    from ..functions.scalars import emu_to_px as px

    value = F.when(F.col("l_linenumber") != 7, F.col("l_partkey") * 1000)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", px(value, 100000).alias("px"))


@query(
    "doc_props",
    f"""
    WITH {_DECK} SELECT path, p_name || ' & co' AS title, p_brand AS author, '' AS created, 'Deck' AS application FROM d
    UNION ALL SELECT 'p' || p_partkey || '.pptx', '', '', '', '' FROM part WHERE p_partkey % 10 = 7
    """,
)
def doc_props(spark, sf):
    return OL.doc_props(_decks(spark, sf))


@query("slide_profile", f"WITH {_DECK} SELECT path, 3 AS slide_count, true AS has_media FROM d")
def slide_profile(spark, sf):
    return OL.slide_profile(_decks(spark, sf, media=True))


def _dps(spark, sf):
    return OL.open_dps(X.dps_parts(table(spark, sf, "part")))


_DPS = "d AS (SELECT *, 'p' || p_partkey || '.dps' AS path FROM part)"


@query("dps_slides", f"WITH {_DPS} SELECT path, v.* FROM d, (VALUES (1, 1, '幻灯片1', '2.xml'), (2, 7, 'Two', 's.xml')) v(slide_no, id, name, part)")
def dps_slides(spark, sf):
    return OL.dps_slides(_dps(spark, sf))


@query(
    "dps_texts",
    f"""
    WITH {_DPS} SELECT path, 1 AS slide_no, 0 AS text_no, p_brand AS content FROM d UNION ALL SELECT path, 1, 1, '#9' FROM d
    UNION ALL SELECT path, 1, 2, p_name FROM d UNION ALL SELECT path, 2, 0, 'plain' FROM d
    """,
)
def dps_texts(spark, sf):
    return OL.dps_texts(_dps(spark, sf))


@query(
    "dps_shapes",
    f"""
    WITH {_DPS} SELECT path, 1 AS slide_no, 0 AS shape_no, 's1' AS id, 'circle' AS type, p_size AS x, 200 AS y, 300 AS width, 100 AS height FROM d
    UNION ALL SELECT path, 1, 1, 's2', 'rectangle', 0, 0, 100, 100 FROM d
    """,
)
def dps_shapes(spark, sf):
    return OL.dps_shapes(_dps(spark, sf))


@query("dps_images", f"WITH {_DPS} SELECT path, 1 AS slide_no, 0 AS image_no, 'img1' AS ref, 5 AS x, 0 AS y FROM d")
def dps_images(spark, sf):
    return OL.dps_images(_dps(spark, sf))


@query("dps_profile", f"WITH {_DPS} SELECT path, 2 AS slide_count, true AS has_shared_strings, true AS has_media FROM d")
def dps_profile(spark, sf):
    return OL.dps_profile(_dps(spark, sf))


@query(
    "package_media",
    f"""
    WITH {_DPS} SELECT path, 'media/one.PNG' AS name, 'image/png' AS type, strlen(p_type) AS size FROM d UNION ALL SELECT path, 'media/two.bin', 'image', 2 FROM d
    """,
)
def package_media(spark, sf):
    parts = archive_parts(X.dps_parts(table(spark, sf, "part")), "^media/")
    return OA.package_media(parts).select("path", "name", "type", "size")
