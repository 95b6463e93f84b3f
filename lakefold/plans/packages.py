"""Queries: archives and spreadsheets, as round trips over packed documents.

Every seventh file (number ending in 7) is cut in half; the twins leave those out or expect an
error row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive as OA
from ..operators import sheets as OW
from ..sources.archive import archive_entries, archive_parts
from . import fixtures as X
from .tables import ORACLES, query, table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _zips(spark, sf):
    return X.zip_documents(_docs(spark, sf))


def _books(spark, sf):
    return OW.open_workbooks(X.xlsx_documents(_docs(spark, sf)))


_GOOD = "good AS (SELECT *, 'd' || doc_id || '.zip' AS path FROM documents WHERE doc_id % 10 <> 7)"
_ENTRIES = f"""{_GOOD}, e AS (
    SELECT path, v.n AS entry_no, v.name, CASE v.n WHEN 1 THEN strlen(text) WHEN 3 THEN strlen(lang) WHEN 4 THEN strlen(source) ELSE v.size END AS size,
           v.method, v.dir AS is_dir FROM good, (VALUES (0, 'text/', 0, 'store', true), (1, 'text/body.txt', 0, 'deflate', false), (2, 'meta/', 0, 'store', true),
           (3, 'meta/lang.json', 0, 'deflate', false), (4, 'img.PNG', 0, 'deflate', false), (5, '说明.md', 3, 'deflate', false), (6, '说明.txt', 3, 'deflate', false),
           (7, 'x/word/document.xml', 4, 'deflate', false)) v(n, name, size, method, dir))"""


@query(
    "archive_entries",
    f"""
    WITH {_ENTRIES} SELECT path, entry_no, name, size, method, is_dir, '2021-03-04 05:06:08' AS modified, false AS failed FROM e
    UNION ALL SELECT 'd' || doc_id || '.zip', NULL, NULL, NULL, NULL, NULL, NULL, true FROM documents WHERE doc_id % 10 = 7
    """,
)
def q_archive_entries(spark, sf):
    return archive_entries(_zips(spark, sf)).select(
        "path", "entry_no", "name", "size", "method", "is_dir", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"),
        F.col("error").isNotNull().alias("failed"),
    )


@query(
    "archive_parts",
    """
    SELECT 'd' || doc_id || '.zip' AS path, v.name, CASE v.name WHEN 'text/body.txt' THEN text ELSE lang END AS content
    FROM documents, (VALUES ('text/body.txt'), ('meta/lang.json')) v(name) WHERE doc_id % 10 <> 7
    """,
)
def q_archive_parts(spark, sf):
    parts = archive_parts(_zips(spark, sf), r"^(text|meta)/.")
    return parts.filter("error IS NULL").select("path", "name", F.col("data").cast("string").alias("content"))


@query("archive_stats", f"WITH {_ENTRIES} SELECT path, count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (is_dir) AS folders, sum(size) AS total_size FROM e GROUP BY path")
def archive_stats(spark, sf):
    return OA.archive_stats(archive_entries(_zips(spark, sf)))


@query(
    "archive_listing",
    f"""
    WITH {_ENTRIES} SELECT path, entry_no, name, CASE WHEN is_dir THEN '-' WHEN size < 1024 THEN size || ' B'
      ELSE regexp_replace(format('{{:.2f}}', round(size / 1024, 2)), '\\.?0+$', '') || ' KB' END AS size,
      CASE WHEN is_dir THEN 'Folder' WHEN name LIKE '%.txt' THEN 'Plain Text' WHEN name LIKE '%.json' THEN 'JSON File' WHEN name LIKE '%.md' THEN 'Markdown'
           WHEN name LIKE '%.xml' THEN 'XML File' ELSE 'File' END AS type, '2021-03-04 05:06' AS date FROM e
    """,
)
def archive_listing(spark, sf):
    return OA.archive_listing(archive_entries(_zips(spark, sf)))


@query(
    "entry_lookup",
    f"""
    WITH {_ENTRIES} SELECT 'd' || doc_id || '.zip' AS path, r.name, entry_no, size, CASE WHEN entry_no IS NULL THEN 'no such entry: ' || r.name END AS error
    FROM documents CROSS JOIN (VALUES ('text/body.txt'), ('Text/body.txt')) r(name) LEFT JOIN e ON e.path = 'd' || doc_id || '.zip' AND e.name = r.name
    """,
)
def entry_lookup(spark, sf):
    requests = _docs(spark, sf).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"),
        F.explode(F.array(F.lit("text/body.txt"), F.lit("Text/body.txt"))).alias("name"),
    )
    return OA.entry_lookup(archive_entries(_zips(spark, sf)), requests)


@query("entry_name_decode", f"WITH {_ENTRIES} SELECT path, entry_no, name FROM e WHERE entry_no IS NOT NULL")
def entry_name_decode(spark, sf):
    """Declared UTF-8 and undeclared GBK entry names."""
    return archive_entries(_zips(spark, sf)).filter("entry_no IS NOT NULL").select("path", "entry_no", "name")


@query("archive_profile", f"WITH {_GOOD} SELECT path, 8 AS file_count, 'ZIP' AS format, 'deflate,store' AS methods FROM good")
def archive_profile(spark, sf):
    return OA.archive_profile(archive_entries(_zips(spark, sf)))


@query("container_valid", "SELECT 'd' || doc_id || '.zip' AS path, doc_id % 10 <> 7 AS valid FROM documents")
def container_valid(spark, sf):
    return OA.is_valid_container(archive_entries(_zips(spark, sf)))


@query("part_locate", f"WITH {_GOOD} SELECT path, 'x/word/document.xml' AS name FROM good")
def part_locate(spark, sf):
    return OA.part_locate(archive_entries(_zips(spark, sf)))


@query("package_images", f"WITH {_GOOD} SELECT path, 'img.PNG' AS name, 'image/png' AS mime_type, strlen(source) AS size, source AS content FROM good")
def package_images(spark, sf):
    parts = archive_parts(_zips(spark, sf), r"(?i)\.(png|jpe?g|gif|bmp|tiff|webp)$")
    return OA.package_images(parts).select("path", "name", "mime_type", "size", F.col("data").cast("string").alias("content"))


# ------------------------------------------------------------------ spreadsheets

_BOOK_LINES = """l AS (SELECT 'd' || doc_id || '.xlsx' AS path, unnest(generate_series(0, len(ls) - 1)) AS i, unnest(ls) AS line, len(ls) AS n
                FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id % 10 <> 7))"""
_CELLS = f"""{_BOOK_LINES}, meta AS (SELECT 'd' || doc_id || '.xlsx' AS path, lang, source FROM documents WHERE doc_id % 10 <> 7), c AS (
    SELECT path, 0 AS sheet_no, i + 1 AS row_num, 'A' || (i + 1) AS ref, 0 AS col, i AS row, 's' AS cell_type, CAST(i AS VARCHAR) AS raw_value,
           CASE WHEN i % 5 = 4 THEN '' ELSE line END AS v_string, CAST(NULL AS DOUBLE) AS v_double, CAST(NULL AS BOOLEAN) AS v_bool, CAST(NULL AS VARCHAR) AS formula, 1 AS style_idx FROM l
    UNION ALL SELECT path, 0, i + 1, 'B' || (i + 1), 1, i, 'n', length(line) || '.5', NULL, length(line) + 0.5, NULL, NULL, 0 FROM l
    UNION ALL SELECT path, 0, i + 1, 'C' || (i + 1), 2, i, 'b', CASE WHEN length(line) > 100 THEN '1' ELSE '0' END, NULL, NULL, length(line) > 100, NULL, 0 FROM l
    UNION ALL SELECT path, 0, i + 1, 'D' || (i + 1), 3, i, 'str', CAST(length(line) AS VARCHAR), CAST(length(line) AS VARCHAR), NULL, NULL, 'LEN(A' || (i + 1) || ')', 0 FROM l
    UNION ALL SELECT path, 0, i + 1, 'E' || (i + 1), 4, i, NULL, 'raw' || (i + 1), 'raw' || (i + 1), NULL, NULL, NULL, 7 FROM l
    UNION ALL SELECT path, 0, i + 1, 'AA' || (i + 1), 26, i, 'e', '#N/A', '#N/A', NULL, NULL, NULL, 0 FROM l WHERE i % 3 = 0
    UNION ALL SELECT path, 1, 1, 'A1', 0, 0, 'str', lang, lang, NULL, NULL, NULL, 0 FROM meta
    UNION ALL SELECT path, 1, 1, 'B1', 1, 0, 'str', source, source, NULL, NULL, NULL, 0 FROM meta
    UNION ALL SELECT path, 1, 1, '?1', 0, 0, NULL, '0', '0', NULL, NULL, NULL, 0 FROM meta)"""
_BOOKS = "b AS (SELECT 'd' || doc_id || '.xlsx' AS path, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 10 <> 7)"


@query(
    "sheets",
    f"""
    WITH {_BOOKS} SELECT path, v.* FROM b, (VALUES (0, 'Lines', 1, 'rId2', 'xl/worksheets/sheet1.xml'), (1, 'Meta', 4, 'rId1', 'xl/worksheets/sheet2.xml'),
      (2, 'Lost', 9, 'rId9', 'xl/worksheets/sheet9.xml')) v(sheet_no, name, sheet_id, rel_id, part)
    """,
)
def sheets(spark, sf):
    return OW.sheets(_books(spark, sf))


@query("shared_strings", f"WITH {_BOOK_LINES} SELECT path, i AS idx, CASE WHEN i % 5 = 4 THEN '' ELSE line END AS text FROM l")
def shared_strings(spark, sf):
    return OW.shared_strings(_books(spark, sf))


@query(
    "cell_styles",
    f"""
    WITH {_BOOKS} SELECT path, v.* FROM b, (VALUES (0, 0, 0, 0, 0, false, false, false), (1, 1, 1, 1, 14, true, true, false))
      v(style_idx, font_id, fill_id, border_id, num_fmt_id, apply_font, apply_fill, apply_border)
    """,
)
def cell_styles(spark, sf):
    return OW.cell_styles(_books(spark, sf))


@query("cells", f"WITH {_CELLS} SELECT path, sheet_no, row_num, ref, col, row, cell_type, raw_value, formula, style_idx FROM c")
def cells(spark, sf):
    return OW.cells(_books(spark, sf)).select("path", "sheet_no", "row_num", "ref", "col", "row", "cell_type", "raw_value", "formula", "style_idx")


@query("cell_typed_value", f"WITH {_CELLS} SELECT path, sheet_no, ref, v_string, v_double, v_bool FROM c")
def cell_typed_value(spark, sf):
    return OW.cells(_books(spark, sf)).select("path", "sheet_no", "ref", "v_string", "v_double", "v_bool")


@query("resolve_shared_strings", f"WITH {_CELLS} SELECT path, ref, v_string FROM c WHERE cell_type = 's'")
def resolve_shared_strings(spark, sf):
    return OW.cells(_books(spark, sf)).filter("cell_type = 's'").select("path", "ref", "v_string")


@query(
    "cell_ref",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 10 = 9 THEN 0 ELSE p_partkey END AS col, CASE WHEN p_partkey % 10 = 9 THEN 0 ELSE p_size END AS row FROM part
    """,
)
def cell_ref(spark, sf):
    """References built from numbers with base-26 letters, and some that are not references."""
    k = F.col("p_partkey")
    three = F.when(k >= 702, F.chr(65 + F.floor((k - 702) / 676) % 26)).otherwise("")
    two = F.when(k >= 26, F.chr(65 + F.floor((k - 26) / 26) % 26)).otherwise("")
    ref = F.concat(three, two, F.chr(65 + k % 26), (F.col("p_size") + 1).cast("string"))
    ref = F.when(k % 10 == 9, F.lower(ref)).otherwise(ref)
    in_range = k < 702 + 26 * 676
    place = OW.cell_ref(F.when(in_range, ref))
    return table(spark, sf, "part").select("p_partkey", F.when(in_range, place["col"]).otherwise(F.when(k % 10 == 9, 0).otherwise(k)).alias("col"),
                                           F.when(in_range, place["row"]).otherwise(F.when(k % 10 == 9, 0).otherwise(F.col("p_size"))).alias("row"))


@query("resolve_styles", f"WITH {_CELLS} SELECT path, sheet_no, ref, CASE style_idx WHEN 0 THEN 0 WHEN 1 THEN 14 END AS num_fmt_id FROM c")
def resolve_styles(spark, sf):
    return OW.resolve_styles(_books(spark, sf)).select("path", "sheet_no", "ref", "style.num_fmt_id")


@query(
    "cell_rich_style",
    f"""
    WITH {_CELLS} SELECT path, sheet_no, ref, CASE style_idx WHEN 0 THEN 'Calibri' WHEN 1 THEN 'Arial' END AS font_name,
      CASE style_idx WHEN 0 THEN 11 WHEN 1 THEN 14.5 END AS font_size, CASE WHEN style_idx < 2 THEN style_idx = 1 END AS bold, CASE WHEN style_idx < 2 THEN false END AS italic,
      CASE style_idx WHEN 1 THEN 'FFFF0000' END AS font_color, CASE style_idx WHEN 1 THEN 'FFFFFF00' END AS fill_color, CASE style_idx WHEN 1 THEN 'center' END AS horizontal,
      CAST(NULL AS VARCHAR) AS vertical, CASE WHEN style_idx < 2 THEN style_idx = 1 END AS wrap_text, CASE style_idx WHEN 1 THEN 'thick' END AS border_top,
      CAST(NULL AS VARCHAR) AS border_right, CAST(NULL AS VARCHAR) AS border_bottom, CASE style_idx WHEN 1 THEN 'thin' END AS border_left FROM c
    """,
)
def cell_rich_style(spark, sf):
    return OW.cell_rich_style(_books(spark, sf))


@query(
    "merged_ranges",
    f"""
    WITH {_BOOKS} SELECT path, 0 AS sheet_no, 0 AS range_no, 'A1:B2' AS ref, 0 AS start_row, 0 AS start_col, 1 AS end_row, 1 AS end_col FROM b
    UNION ALL SELECT path, 0, 1, 'B2:D' || (n + 70), 1, 1, n + 69, 3 FROM b
    """,
)
def merged_ranges(spark, sf):
    return OW.merged_ranges(_books(spark, sf))


@query(
    "merge_membership",
    f"""
    WITH {_CELLS}, f AS (SELECT path, sheet_no, ref, sheet_no = 0 AND row <= 1 AND col <= 1 AS first, sheet_no = 0 AND row >= 1 AND col BETWEEN 1 AND 3 AS second FROM c)
    SELECT path, sheet_no, ref, first OR second AS merged, (first AND ref <> 'A1') OR (second AND NOT first) AS hidden,
      CASE WHEN first AND ref = 'A1' THEN 2 END AS row_span, CASE WHEN first AND ref = 'A1' THEN 2 END AS col_span FROM f
    """,
)
def merge_membership(spark, sf):
    return OW.cells_with_merges(_books(spark, sf)).select("path", "sheet_no", "ref", "merged", "hidden", "row_span", "col_span")


@query("merge_membership_join", ORACLES["merge_membership"])
def merge_membership_join(spark, sf):
    """The same by a range join, for cells and ranges that are tables of their own."""
    books = _books(spark, sf)
    return OW.merge_membership(OW.cells(books), OW.merged_ranges(books)).select("path", "sheet_no", "ref", "merged", "hidden", "row_span", "col_span")


@query(
    "dense_grid",
    f"""
    WITH {_CELLS}, {_BOOKS}, g AS (SELECT path, 0 AS sheet_no, row, unnest(generate_series(0, 26)) AS col FROM (SELECT path, unnest(generate_series(0, n - 1)) AS row FROM b)
      UNION ALL SELECT path, 1, 0, 0 FROM b),
    v AS (SELECT path, sheet_no, row, col, coalesce(cell_type, 'n') AS type, coalesce(v_string, CAST(v_double AS VARCHAR), CAST(v_bool AS VARCHAR)) AS value FROM c)
    SELECT g.path, g.sheet_no, g.row, g.col, coalesce(value, '') AS value, coalesce(type, 's') AS type
    FROM g LEFT JOIN v ON v.path = g.path AND v.sheet_no = g.sheet_no AND v.row = g.row AND v.col = g.col
    """,
)
def dense_grid(spark, sf):
    books = _books(spark, sf)
    return OW.dense_grid(OW.cells(books), OW.sheet_ranges(books))


@query("sheet_ranges", f"WITH {_BOOKS} SELECT path, 0 AS sheet_no, n AS row_count, 27 AS col_count FROM b UNION ALL SELECT path, 1, 1, 1 FROM b")
def sheet_ranges(spark, sf):
    return OW.sheet_ranges(_books(spark, sf)).select("path", "sheet_no", "row_count", "col_count")


@query("sheet_profile", f"WITH {_BOOKS} SELECT path, 2 AS sheet_count, true AS has_shared_strings, true AS has_styles FROM b")
def sheet_profile(spark, sf):
    return OW.sheet_profile(_books(spark, sf))


@query("formulas", f"WITH {_CELLS} SELECT path, ref, formula, v_string AS cached FROM c WHERE formula IS NOT NULL")
def formulas(spark, sf):
    return OW.formulas(OW.cells(_books(spark, sf))).select("path", "ref", "formula", F.col("v_string").alias("cached"))


@query("sheet_pages", f"WITH {_CELLS} SELECT path, ref, v_string, true AS is_header FROM c WHERE sheet_no = 1")
def sheet_pages(spark, sf):
    return OW.sheet_pages(OW.cells(_books(spark, sf)), 1).select("path", "ref", "v_string", "is_header")


@query(
    "sheet_to_table",
    f"""
    WITH {_BOOK_LINES} SELECT path, 0 AS sheet_no, i AS row, CASE WHEN i % 5 = 4 THEN '' ELSE line END AS c0, CAST(length(line) + 0.5 AS VARCHAR) AS c1, CAST(length(line) > 100 AS VARCHAR) AS c2,
      CASE WHEN i % 3 = 0 THEN '#N/A' END AS c26 FROM l
    UNION ALL SELECT 'd' || doc_id || '.xlsx', 1, 0, lang, source, NULL, NULL FROM documents WHERE doc_id % 10 <> 7
    """,
)
def sheet_to_table(spark, sf):
    return OW.sheet_to_table(OW.cells(_books(spark, sf)), [0, 1, 2, 26])


@query(
    "et_sheets_cells",
    """
    SELECT 'p' || p_partkey || '.et' AS path, v.sheet_no, v.sheet_name, v.ref, CASE v.ref WHEN 'A3' THEN p_name WHEN 'D3' THEN '#REF' WHEN 'B1' THEN p_brand END AS v_string,
      CASE v.ref WHEN 'C3' THEN p_size END AS v_double, CASE v.ref WHEN 'A1' THEN true END AS v_bool, CASE v.ref WHEN 'B1' THEN 'A1' END AS formula
    FROM part, (VALUES (0, 'Sheet1', 'A3'), (0, 'Sheet1', 'C3'), (0, 'Sheet1', 'D3'), (1, 'Two', 'A1'), (1, 'Two', 'B1')) v(sheet_no, sheet_name, ref)
    """,
)
def et_sheets_cells(spark, sf):
    books = OW.open_et(X.et_parts(table(spark, sf, "part")))
    return OW.cells(books, et=True).select("path", "sheet_no", "sheet_name", "ref", "v_string", "v_double", "v_bool", "formula")
