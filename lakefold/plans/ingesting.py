"""Queries: dispatch to parsers in batch and stream, and the error rows of damaged documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import parsing
from ..functions.arrays import whole
from ..functions.text import lines_of
from ..operators import docs as OD
from ..operators import epub as OE
from ..operators import ofd as OO
from ..operators import sheets as OS
from ..operators import slides as OL
from ..session import ensure_checkpoint_dir
from ..streaming import events as SE
from ..streaming.ingest import ingest_tables
from . import fixtures as X
from .tables import ALL_FILES, query, table


def _lake_lines(files):
    """A caller's own format: lines, the first of them behind four marking bytes."""
    marked = lines_of(F.col("content").cast("string"))
    lines = F.transform(marked, lambda line, i: F.when(i == 0, F.substring(line, 5, 2147483647)).otherwise(line))
    return files.select("path", F.posexplode(whole(lines)).alias("line_no", "line"))


def _registry():
    known = parsing.default_registry()
    known.register_format("lake", "document", _lake_lines, magic="4C414B45")
    return known


_ROWS = """
    WITH g AS (SELECT *, doc_id % 9 AS k, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    t AS (SELECT *, 'd' || doc_id || CASE k WHEN 0 THEN '.xlsx' WHEN 1 THEN '.epub' WHEN 2 THEN '.json' WHEN 3 THEN '.csv' WHEN 4 THEN '.txt' WHEN 5 THEN '' WHEN 6 THEN '.json' WHEN 7 THEN '.lake' ELSE '.xyz' END AS path FROM g)
    SELECT path, CASE WHEN k = 0 THEN 'xlsx' WHEN k = 1 THEN 'epub' WHEN k IN (2, 6) THEN 'json' WHEN k = 3 THEN 'csv' WHEN k = 4 THEN 'txt' WHEN k IN (5, 7) THEN 'lake' ELSE 'unknown' END AS type,
      CASE WHEN k IN (6, 8) OR (k < 2 AND doc_id % 10 = 7) THEN 'errors' WHEN k IN (0, 3) THEN 'office' ELSE 'document' END AS family,
      CASE WHEN k IN (6, 8) OR (k < 2 AND doc_id % 10 = 7) THEN 1 WHEN k = 0 THEN 5 * len(ls) + (len(ls) + 2) // 3 + 3 WHEN k IN (1, 7) THEN len(ls)
           WHEN k = 5 THEN len(ls) ELSE 1 END AS n_rows,
      CASE WHEN k = 6 THEN 'malformed JSON' WHEN k = 8 THEN 'unsupported type: unknown' WHEN k < 2 AND doc_id % 10 = 7 THEN 'BadZipFile' END AS error,
      CASE WHEN k = 2 THEN lang WHEN k = 3 THEN lang WHEN k = 4 THEN text WHEN k = 5 THEN ls[1] WHEN k = 7 THEN substring(ls[1], 5) END AS first_value
    FROM t
    UNION ALL SELECT path, CASE k WHEN 0 THEN 'xlsx' ELSE 'epub' END, 'errors', CASE k WHEN 0 THEN 1 ELSE 2 END, CASE k WHEN 0 THEN 'missing part' ELSE 'missing part,no manifest item' END, NULL
    FROM t WHERE k < 2 AND doc_id % 10 <> 7
    """


def _summary(parsed):
    """Rows, errors and one value read back from the packed records, per file and table."""
    value = F.coalesce(*[F.try_variant_get("record", p, "string") for p in ("$.doc.lang", "$.columns[0]", "$.text")],
                       F.when(F.try_variant_get("record", "$.line_no", "int") == 0, F.try_variant_get("record", "$.line", "string")))
    own = F.col("type").isin("json", "csv", "txt", "lake")
    error = F.regexp_replace("error", "^BadZipFile.*", "BadZipFile")
    return parsed.groupBy("path", "type", "family").agg(
        F.count("*").alias("n_rows"), F.nullif(F.array_join(F.array_sort(F.collect_set(error)), ","), F.lit("")).alias("error"), F.max(F.when(own, value)).alias("first_value")
    )


@query("parse_files", _ROWS)
def parse_files(spark, sf):
    """A mixed lake dispatched to the parser of each type, one of them registered here."""
    known = _registry()
    lake = X.as_files(X.mixed_lake(table(spark, sf, "documents").where("text IS NOT NULL")))
    staged = parsing.stage_files(lake, f"{ensure_checkpoint_dir(spark)}/lake-{uuid.uuid4().hex}", known)
    return _summary(parsing.parse_files(staged, known))


@query("ingest_tables", _ROWS)
def ingest_tables_query(spark, sf):
    """The same files arriving as a stream, parsed into one table per family and one of errors."""
    folder = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    arriving = X.mixed_lake(SE.read_table_stream(spark, sf, "documents", ALL_FILES).where("text IS NOT NULL"))
    ingest_tables(arriving, f"{folder}/tables", f"{folder}/state", _registry()).awaitTermination()
    written = spark.read.schema("path STRING, record VARIANT, error STRING, family STRING, batch BIGINT, type STRING").parquet(f"{folder}/tables")
    return _summary(written)


# ------------------------------------------------------------------ error rows


def _plain(errors):
    return errors.select("path", "part", F.regexp_replace("error", "^BadZipFile.*", "BadZipFile").alias("error"))


def _cut(ext, table_name="documents", key="doc_id", letter="d"):
    return f"SELECT '{letter}' || {key} || '.{ext}' AS path, NULL AS part, 'BadZipFile' AS error FROM {table_name} WHERE {key} % 10 = 7"


@query("cells_errors", f"{_cut('xlsx')} UNION ALL SELECT 'd' || doc_id || '.xlsx', 'xl/worksheets/sheet9.xml', 'missing part' FROM documents WHERE doc_id % 10 <> 7")
def cells_errors(spark, sf):
    return _plain(OS.cells_errors(OS.open_workbooks(X.xlsx_documents(table(spark, sf, "documents")))))


@query("paragraphs_errors", f"{_cut('docx')} UNION ALL SELECT 'b' || doc_id || '.docx', 'word/document.xml', CASE doc_id % 2 WHEN 0 THEN 'malformed part' ELSE 'missing part' END FROM documents")
def paragraphs_errors(spark, sf):
    """The damaged documents, and packages whose main document is cut or left out."""
    docs = table(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 2 == 0, "word/document.xml").otherwise("word/other.xml")
    bad = X.pack(docs.select(X.cat("b", F.col("doc_id"), ".docx").alias("path"), F.array(X.entry(name, F.lit("<w:document><w:body>")), X.entry("word/styles.xml", F.lit("<a/>"))).alias("parts")))
    return _plain(OD.paragraphs_errors(OD.open_documents(X.docx_documents(docs).unionByName(bad))))


@query("slides_errors", f"{_cut('pptx', 'part', 'p_partkey', 'p')} UNION ALL SELECT 'p' || p_partkey || '.pptx', 'ppt/slides/slide9.xml', 'missing part' FROM part WHERE p_partkey % 10 <> 7")
def slides_errors(spark, sf):
    return _plain(OL.slides_errors(OL.open_presentations(X.pptx_parts(table(spark, sf, "part")))))


@query(
    "chapters_errors",
    f"{_cut('epub')} UNION ALL SELECT 'd' || doc_id || '.epub', v.p, v.e FROM documents, (VALUES ('nowhere', 'no manifest item'), ('OEBPS/gone.xhtml', 'missing part')) v(p, e) WHERE doc_id % 10 <> 7",
)
def chapters_errors(spark, sf):
    return _plain(OE.chapters_errors(OE.open_books(X.epub_documents(table(spark, sf, "documents")))))


@query("pages_errors", f"{_cut('ofd')} UNION ALL SELECT 'd' || doc_id || '.ofd', 'Doc_0/Pages/Page_' || len(string_split(text, chr(10))) || '/Content.xml', 'missing part' FROM documents WHERE doc_id % 10 <> 7")
def pages_errors(spark, sf):
    return _plain(OO.pages_errors(OO.open_ofd(X.ofd_documents(table(spark, sf, "documents")))))
