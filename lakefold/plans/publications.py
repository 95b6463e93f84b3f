"""Queries: EPUB, OFD and PDF files packed from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import epub as OE
from ..operators import ofd as OO
from ..operators import pdf as OF
from ..sources.pdf import pdf_document_rows, pdf_objects, pdf_page_rows, pdf_streams
from ..sources.pdfcontent import pdf_operations
from . import fixtures as X
from .tables import query, table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _books(spark, sf):
    return OE.open_books(X.epub_documents(_docs(spark, sf)))


def _base(ext, good=True):
    where = "WHERE doc_id % 10 <> 7" if good else ""
    return f"""g AS (SELECT *, 'd' || doc_id || '.{ext}' AS path, string_split(text, chr(10)) AS ls FROM documents {where}),
    l AS (SELECT path, unnest(generate_series(0, len(ls) - 1)) AS i, unnest(ls) AS line, len(ls) AS n, lang, source FROM g)"""


_EPUB, _OFD, _PDF = _base("epub"), _base("ofd"), _base("pdf", False)


@query("epub_container", "SELECT 'd' || doc_id || '.epub' AS path, CASE WHEN doc_id % 10 <> 7 THEN 'OEBPS/content.opf' END AS opf_path, doc_id % 10 = 7 AS failed FROM documents")
def epub_container(spark, sf):
    return OE.epub_container(_books(spark, sf)).select("path", "opf_path", F.col("error").isNotNull().alias("failed"))


@query(
    "epub_manifest",
    f"""
    WITH {_EPUB} SELECT path, 'c' || i AS id, 'text/c' || i || '.xhtml' AS href, 'OEBPS/text/c' || i || '.xhtml' AS item_path, 'application/xhtml+xml' AS media_type FROM l
    UNION ALL SELECT path, v.id, v.href, 'OEBPS/' || v.href, v.mt FROM g, (VALUES ('ncx', 'toc.ncx', 'application/x-dtbncx+xml'), ('cover', 'img/cover.jpg', 'image/jpeg'),
      ('lost', 'img/lost.png', 'image/png'), ('gone', 'gone.xhtml', 'x')) v(id, href, mt)
    """,
)
def epub_manifest(spark, sf):
    return OE.epub_manifest(_books(spark, sf))


@query("epub_chapters", f"WITH {_EPUB} SELECT path, i AS chapter_no, 'Chapter ' || i || ' &' AS title, 'Chapter ' || i || ' &s' || line AS content, 'OEBPS/text/c' || i || '.xhtml' AS item_path FROM l")
def epub_chapters(spark, sf):
    return OE.epub_chapters(_books(spark, sf)).drop("html")


@query(
    "epub_toc",
    f"WITH {_EPUB} SELECT path, i AS toc_no, 1 + i % 2 AS depth, CASE WHEN i % 2 = 1 THEN i - 1 END AS parent, 'Chapter ' || i || ' &' AS title, 'text/c' || i || '.xhtml' AS src FROM l",
)
def epub_toc(spark, sf):
    return OE.epub_toc(_books(spark, sf))


@query("epub_toc_flat", f"WITH {_EPUB} SELECT path, i AS toc_no, 'Chapter ' || i || ' &' AS title, 'text/c' || i || '.xhtml' AS src FROM l")
def epub_toc_flat(spark, sf):
    return OE.epub_toc(_books(spark, sf), flat=True)


@query("epub_images", f"WITH {_EPUB} SELECT path, 'cover' AS id, 'cover.jpg' AS file_name, 'OEBPS/img/cover.jpg' AS item_path, 'image/jpeg' AS media_type, strlen(source) AS size FROM g")
def epub_images(spark, sf):
    return OE.epub_images(_books(spark, sf)).drop("data")


@query(
    "epub_meta",
    f"WITH {_EPUB} SELECT path, ls[1][1:20] AS title, source AS author, lang AS language, '' AS publisher, '' AS publish_date, '' AS identifier, '' AS description, 'EPUB' AS format FROM g",
)
def epub_meta(spark, sf):
    return OE.epub_meta(_books(spark, sf))


# ------------------------------------------------------------------ OFD


def _ofd(spark, sf):
    return OO.open_ofd(X.ofd_documents(_docs(spark, sf)))


@query(
    "ofd_pages",
    f"""
    WITH {_OFD} SELECT path, i AS page_no, CASE i WHEN 0 THEN 'first' ELSE 'Page_' || i END AS id, CASE WHEN i % 2 = 0 THEN 100 ELSE 210 END AS width, 297 AS height, 3 AS element_count FROM l
    UNION ALL SELECT path, len(ls), 'Page_' || len(ls), 210, 297, 0 FROM g
    """,
)
def ofd_pages(spark, sf):
    return OO.ofd_pages(_ofd(spark, sf))


@query(
    "ofd_elements",
    f"""
    WITH {_OFD} SELECT path, i AS page_no, 0 AS element_no, 'text' AS type, '1' AS id, i AS x, 5 AS y, 6.5 AS width, 7 AS height,
        lang || line AS content, NULL AS resource_id, NULL AS stroke, NULL AS fill, NULL AS line_width FROM l
    UNION ALL SELECT path, i, 1, 'image', '2', 0, 0, 100, 100, NULL, 'res' || (i % 2), NULL, NULL, NULL FROM l
    UNION ALL SELECT path, i, 2, 'path', '3', 1, 2, 3, 4, NULL, NULL, '#FF0000', '#FFFFFF', 0.5 FROM l
    """,
)
def ofd_elements(spark, sf):
    return OO.ofd_elements(_ofd(spark, sf))


@query(
    "ofd_text_decode",
    "SELECT c_custkey, c_name AS decoded, c_mktsegment || '!' AS plain FROM customer",
)
def ofd_text_decode(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", OO.text_decode(F.hex(F.encode("c_name", "UTF-8"))).alias("decoded"), OO.text_decode(F.concat("c_mktsegment", F.lit("!"))).alias("plain")
    )


@query("ofd_resources", f"WITH {_OFD} SELECT path, i AS page_no, 1 AS element_no, 'res1' AS resource_id, 'Doc_0/Res/a_res1.png' AS name, strlen(source) AS size FROM l WHERE i % 2 = 1")
def ofd_resources(spark, sf):
    return OO.ofd_resources(OO.open_ofd(X.ofd_documents(_docs(spark, sf)), resources=True))


@query(
    "ofd_meta",
    f"""
    WITH {_OFD} SELECT path, '1.1' AS version, 'OFD' AS doc_type, source AS title, lang AS author, '' AS subject, '' AS keywords, '' AS creation_date, '' AS modification_date, len(ls) AS page_count FROM g
    """,
)
def ofd_meta(spark, sf):
    return OO.ofd_meta(_ofd(spark, sf))


# ------------------------------------------------------------------ PDF


def _pdfs(spark, sf):
    return X.pdf_documents(_docs(spark, sf))


@query("pdf_profile", f"WITH {_PDF} SELECT path, true AS valid, '1.7' AS version, contains(path, '9') AS encrypted, true AS sized FROM g")
def pdf_profile(spark, sf):
    return _pdfs(spark, sf).select("path", OF.pdf_profile(F.col("content")).alias("p")).select(
        "path", "p.valid", "p.version", "p.encrypted", (F.col("p.size") > 400).alias("sized")
    )


@query("pdf_pages", f"WITH {_PDF} SELECT DISTINCT path, i // 10 + 1 AS page_no, CASE WHEN i // 10 % 2 = 1 THEN 100 + i // 10 ELSE 612 END AS width, CASE WHEN i // 10 % 2 = 1 THEN 400 ELSE 792 END AS height FROM l")
def pdf_pages(spark, sf):
    return OF.pdf_pages(pdf_page_rows(_pdfs(spark, sf)))


# characters outside Latin-1 were replaced when the files were written
_LATIN = "regexp_replace(line, '[^\\x00-\\xff]', '?', 'g')"


@query("pdf_text_ops", f"WITH {_PDF} SELECT path, i // 10 + 1 AS page_no, i % 10 + 2 AS line_no, {_LATIN} AS text FROM l")
def pdf_text_ops(spark, sf):
    return OF.pdf_text_ops(OF.pdf_page_contents(pdf_page_rows(_pdfs(spark, sf))))


@query(
    "pdf_text_arrays",
    f"""
    WITH {_PDF} SELECT path, page_no, lines + 4 AS line_no, 'ab' AS text FROM (SELECT path, i // 10 + 1 AS page_no, count(*) AS lines FROM l GROUP BY ALL) WHERE page_no % 2 = 0
    """,
)
def pdf_text_arrays(spark, sf):
    """Text lists, which only the ``arrays`` option reads."""
    contents = OF.pdf_page_contents(pdf_page_rows(_pdfs(spark, sf)))
    return OF.pdf_text_ops(contents, arrays=True).join(OF.pdf_text_ops(contents), ["path", "page_no", "line_no"], "left_anti")


@query("pdf_image_ops", f"WITH {_PDF} SELECT path, page_no, lines + 3 AS line_no, '/Im1' AS name FROM (SELECT path, i // 10 + 1 AS page_no, count(*) AS lines FROM l GROUP BY ALL) WHERE page_no % 2 = 0")
def pdf_image_ops(spark, sf):
    return OF.pdf_image_ops(OF.pdf_page_contents(pdf_page_rows(_pdfs(spark, sf))))


@query(
    "pdf_string_unescape",
    """
    SELECT p_partkey, p_name || chr(10) || '(' || p_brand || ')' || chr(92) || 'A' || chr(9) || 'q' AS text FROM part
    """,
)
def pdf_string_unescape(spark, sf):
    raw = F.concat(F.lit("("), "p_name", F.lit("\\n\\("), "p_brand", F.lit("\\)\\\\\\101\\t\\q)"))
    return table(spark, sf, "part").select("p_partkey", OF.pdf_string(raw).alias("text"))


@query(
    "pdf_streams",
    f"""
    WITH {_PDF} SELECT path, sum(CASE WHEN page_no % 2 = 0 THEN 2 ELSE 1 END) AS streams, 0 AS errors FROM (SELECT DISTINCT path, i // 10 + 1 AS page_no FROM l) GROUP BY path
    """,
)
def pdf_streams_query(spark, sf):
    return pdf_streams(_pdfs(spark, sf)).groupBy("path").agg(F.count("text").alias("streams"), F.count("error").alias("errors"))


@query(
    "pdf_page_contents",
    f"""
    WITH {_PDF}, p AS (SELECT path, i // 10 + 1 AS page_no, string_agg('(' || replace(replace(replace({_LATIN}, chr(92), chr(92) || chr(92)), '(', chr(92) || '('), ')', chr(92) || ')') || ') Tj', chr(10) ORDER BY i) AS body FROM l GROUP BY ALL)
    SELECT path, page_no, 'BT' || chr(10) || '/F1 12 Tf' || chr(10) || body || chr(10) || 'ET' ||
      CASE WHEN page_no % 2 = 0 THEN chr(10) || '/Im1 Do' || chr(10) || '[(a) -20 (' || chr(92) || '142)] TJ' || chr(10) ELSE '' END AS contents FROM p
    """,
)
def pdf_page_contents(spark, sf):
    return OF.pdf_page_contents(pdf_page_rows(_pdfs(spark, sf)))


@query(
    "pdf_info",
    f"""
    WITH {_PDF} SELECT path, (len(ls) + 9) // 10 AS page_count, source || ' (x)' AS title, '' AS author, '' AS subject, '' AS keywords, '' AS creator, 'lake' AS producer, '' AS creation_date, '' AS mod_date FROM g
    """,
)
def pdf_info(spark, sf):
    return OF.pdf_info(pdf_document_rows(_pdfs(spark, sf)))


@query(
    "pdf_fonts",
    f"""
    WITH {_PDF} SELECT path, 'Helvetica' AS base_font, 'Type1' AS subtype, 'WinAnsiEncoding' AS encoding, true AS is_standard FROM g
    UNION ALL SELECT path, 'Odd+Sans', 'TrueType', 'MacRomanEncoding', false FROM g
    """,
)
def pdf_fonts(spark, sf):
    return OF.pdf_fonts(pdf_objects(_pdfs(spark, sf), "/Type\\s*/Font\\b", streams=False)).drop("obj_no")


# ------------------------------------------------------------------ PDF programs on one line


def _dense(spark, sf):
    return X.dense_pdfs(_docs(spark, sf))


_CUT = "SELECT path, len(ls) AS i FROM g WHERE doc_id % 10 = 7"


@query(
    "pdf_shown_text",
    f"""
    WITH {_PDF} SELECT path, i + 1 AS page_no, v.o AS op_no, v.op, CASE WHEN v.o = 3 THEN {_LATIN} ELSE v.t END AS text, 'F1' AS font, 12 AS font_size, 10 AS x, v.y
    FROM l, (VALUES (3, 'Tj', '', 20), (5, '''', 'b(2)', 6), (6, '"', 'c', -8), (7, 'TJ', 'def', -8)) v(o, op, t, y)
    UNION ALL SELECT path, i + 1, 0, 'Tj', 'kept', NULL, NULL, 0, 0 FROM ({_CUT})
    """,
)
def pdf_shown_text(spark, sf):
    """All four text operators of programs that stand on one line, with their text state."""
    return OF.pdf_shown_text(pdf_operations(_dense(spark, sf)))


@query("pdf_drawn_objects", f"WITH {_PDF} SELECT path, i + 1 AS page_no, v.o AS op_no, v.n AS name FROM l, (VALUES (10, 'Im1'), (12, NULL)) v(o, n)")
def pdf_drawn_objects(spark, sf):
    return OF.pdf_drawn_objects(pdf_operations(_dense(spark, sf)))


_HALF = "i >= (n + 1) // 2"


@query(
    "pdf_inherited_pages",
    f"""
    WITH {_PDF}, p AS (SELECT path, i, n FROM l UNION ALL SELECT c.path, c.i, c.i FROM ({_CUT}) c)
    SELECT path, i + 1 AS page_no, CASE WHEN i < n AND i % 3 = 2 THEN 50 + i WHEN {_HALF} THEN 200 ELSE 300 END AS width,
      CASE WHEN i < n AND i % 3 = 2 THEN 70 WHEN {_HALF} THEN 400 ELSE 500 END AS height, CASE WHEN {_HALF} THEN 0 ELSE 90 END AS rotate, NOT ({_HALF}) AS has_font FROM p
    """,
)
def pdf_inherited_pages(spark, sf):
    """Boxes, rotation and resources stated by nodes above the pages, by reference, and by newer object versions."""
    pages = OF.pdf_pages(pdf_page_rows(_dense(spark, sf)), ("rotate", "resources"))
    return pages.withColumn("has_font", F.coalesce(F.contains("resources", F.lit("/F1 7 0 R")), F.lit(False))).drop("resources")


@query("pdf_errors", f"WITH {_PDF} SELECT path, i + 1 AS page_no, 'zlib: stream ends early' AS error FROM ({_CUT}) UNION ALL SELECT 'x' || doc_id, NULL, 'not a PDF file' FROM documents WHERE doc_id % 4 = 0")
def pdf_errors(spark, sf):
    """Content streams that end early, and files that are no PDF."""
    other = _docs(spark, sf).where("doc_id % 4 = 0").select(X.cat("x", F.col("doc_id")).alias("path"), F.lit("plain").cast("binary").alias("content"))
    errors = OF.pdf_errors(pdf_page_rows(_dense(spark, sf).unionByName(other)))
    return errors.withColumn("error", F.regexp_replace("error", ",.*$", ""))
