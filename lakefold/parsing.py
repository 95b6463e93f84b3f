"""Dispatch: detected type, registered parser, one table per family, one table of errors.

``parse_files`` fans a batch of files out to the parser of each type.  A parser's rows keep their own columns, packed
into ``record`` (VARIANT), so parsers of any shape share the table of their family; ``records`` gives the columns back.

The batch is written once, by type (``stage_files``), and every parser reads its own type's folder only: the contents
of a file are read twice in all, however many types a batch has.  Files beyond the size limit are told by name and
length, and their contents are not opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry as R
from .functions import image as image_fn
from .functions.formats import file_header, first_match, known_ext
from .functions.scalars import basename
from .operators import docs, epub, media, ofd, sheets, slides, text
from .operators.detect import decode_text, detect_encoding
from .registry import FormatRegistry, Parser
from .sources import files as SF
from .sources.archive import archive_entries
from .sources.pdfcontent import pdf_operations

ERRORS = "errors"


# ------------------------------------------------------------------ parsers of the registered formats


def _with_errors(rows: DataFrame, errors: DataFrame) -> DataFrame:
    return rows.unionByName(errors, allowMissingColumns=True)


def _packaged(opener, operator, errors) -> Parser:
    def parse(files: DataFrame) -> DataFrame:
        opened = opener(files)
        return _with_errors(operator(opened), errors(opened))

    return parse


def _text(files: DataFrame) -> DataFrame:
    coded = files.select("path", "content", detect_encoding(F.col("content")).alias("charset"))
    return coded.select("path", "charset", decode_text(F.col("content"), F.col("charset")).alias("text"))


def _json(files: DataFrame) -> DataFrame:
    return SF.json_files(files).select("path", "doc", F.when(~F.col("valid"), "malformed JSON").alias("error"))


def _xml(files: DataFrame) -> DataFrame:
    return SF.xml_files(files).select("path", F.when(F.col("valid"), F.col("text")).alias("text"), F.when(~F.col("valid"), "malformed XML").alias("error"))


def _rtf(files: DataFrame) -> DataFrame:
    read = files.select("path", F.decode(F.col("content"), "ISO-8859-1").alias("text"))
    bad = read.where(~F.col("text").startswith("{\\rtf")).select("path", F.lit("not an RTF file").alias("error"))
    return _with_errors(text.rtf_runs(read, "path", "text"), bad)


def _pdf(files: DataFrame) -> DataFrame:
    return pdf_operations(files)


def _image(files: DataFrame) -> DataFrame:
    return media.image_info(files).withColumn("error", F.when(F.col("width").isNull(), "no image header"))


def _svg(files: DataFrame) -> DataFrame:
    return SF.text_files(files).select("path", image_fn.svg_size(F.col("text")).alias("size")).select("path", "size.*")


def _media(files: DataFrame) -> DataFrame:
    return media.media_profile(files).withColumn("error", F.when(F.col("format") == "unknown", "no media header"))


def default_parsers() -> dict[str, Parser]:
    """The parser of each format that this package reads; legacy binary formats have none."""
    return {
        "docx": _packaged(docs.open_documents, docs.paragraphs, docs.paragraphs_errors),
        "wps": _packaged(docs.open_wps, docs.wps_content, docs.wps_errors),
        "xlsx": _packaged(sheets.open_workbooks, sheets.cells, sheets.cells_errors),
        "et": _packaged(sheets.open_et, lambda books: sheets.cells(books, et=True), lambda books: sheets.cells_errors(books, et=True)),
        "pptx": _packaged(slides.open_presentations, slides.slide_text_runs, slides.slides_errors),
        "dps": _packaged(slides.open_dps, slides.dps_texts, slides.dps_errors),
        "epub": _packaged(epub.open_books, epub.epub_chapters, epub.chapters_errors),
        "ofd": _packaged(ofd.open_ofd, ofd.ofd_elements, ofd.pages_errors),
        "pdf": _pdf,
        "rtf": _rtf,
        "csv": SF.csv_files,
        "json": _json,
        "xml": _xml,
        "svg": _svg,
        **dict.fromkeys(("txt", "md"), _text),
        **dict.fromkeys(("jpg", "jpeg", "png", "gif", "bmp", "webp", "psd"), _image),
        **dict.fromkeys(("mp3", "wav", "mp4", "flv", "avi", "mkv", "webm"), _media),
        **dict.fromkeys(("zip", "jar"), archive_entries),
    }


def default_registry() -> FormatRegistry:
    return FormatRegistry(default_parsers())


# ------------------------------------------------------------------ detection and routing


def detected_type(name: Column, header: Column, registry: FormatRegistry) -> Column:
    """A registered extension wins, otherwise the leading bytes decide; else ``unknown``."""
    return F.coalesce(known_ext(name, registry.extensions()), first_match(header, registry.magic), F.lit("unknown"))


def route(files: DataFrame, registry: FormatRegistry, header: Column, max_size: int = R.SIZE_LIMIT) -> DataFrame:
    """Add ``type``, ``family`` and ``reason``, which says why a file is not parsed (null for those that are)."""
    kind = F.col("type")
    supported = [e for e in {*registry.extensions(), *(n for n, _ in registry.magic)}]
    reason = (
        F.when(F.col("length") > max_size, "file too large")
        .when(~kind.isin(*supported), F.concat(F.lit("unsupported type: "), kind))
        .when(~kind.isin(*registry.registered_types()) if registry.parsers else F.lit(True), F.concat(F.lit("no parser for type: "), kind))
    )
    typed = files.withColumn("type", detected_type(basename(F.col("path")), header, registry))
    return typed.withColumn("family", R.lookup(kind, registry.families(), "unrouted")).withColumn("reason", reason)


def stage_files(files: DataFrame, folder: str, registry: FormatRegistry, max_size: int = R.SIZE_LIMIT) -> DataFrame:
    """The batch written by type below ``folder``, in one pass; contents of files that no parser takes are left out.

    Repeating the call with the same folder replaces what was there.
    """
    if "length" not in files.columns:
        files = files.withColumn("length", F.octet_length("content").cast("bigint"))
    small = files.where((F.col("length") <= max_size) | F.col("length").isNull())  # reaches the scan, so larger files are not opened
    large = files.where(F.col("length") > max_size).withColumn("content", F.lit(None).cast("binary"))
    routed = route(small, registry, file_header(F.col("content")), max_size).unionByName(route(large, registry, F.lit(None).cast("binary"), max_size))
    staged = routed.withColumn("content", F.when(F.col("reason").isNull(), F.col("content")))
    staged.write.mode("overwrite").partitionBy("type").parquet(folder)
    return files.sparkSession.read.schema(staged.schema).parquet(folder)


# ------------------------------------------------------------------ parsing


def _packed(rows: DataFrame, kind: str, family: str) -> DataFrame:
    """``(path, family, type, record, error)``; an error row has no record."""
    error = F.col("error").cast("string") if "error" in rows.columns else F.lit(None).cast("string")
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in ("path", "error")]
    record = F.to_variant_object(F.struct(*rest)) if rest else F.lit(None).cast("variant")
    shaped = rows.select("path", record.alias("record"), error.alias("error"))
    return shaped.select(
        "path", F.when(F.col("error").isNotNull(), F.lit(ERRORS)).otherwise(F.lit(family)).alias("family"), F.lit(kind).alias("type"),
        F.when(F.col("error").isNull(), F.col("record")).alias("record"), "error",
    )


def _refused(staged: DataFrame) -> DataFrame:
    return staged.where("reason IS NOT NULL").select(
        "path", F.lit(ERRORS).alias("family"), "type", F.lit(None).cast("variant").alias("record"), F.col("reason").alias("error")
    )


def types_to_parse(staged: DataFrame) -> list[str]:
    """The types of a staged batch that have a parser: at most one row per registered format."""
    return sorted(r.type for r in staged.where("reason IS NULL").select("type").distinct().collect())


def parse_type(staged: DataFrame, kind: str, registry: FormatRegistry) -> DataFrame:
    files = staged.where((F.col("type") == kind) & F.col("reason").isNull()).drop("type", "family", "reason")
    return _packed(registry.parsers[kind](files), kind, registry.families().get(kind, "unrouted"))


def parse_files(staged: DataFrame, registry: FormatRegistry) -> DataFrame:
    """``(path, family, type, record, error)`` of a staged batch; rows of the family ``errors`` say what failed."""
    out = _refused(staged)
    for kind in types_to_parse(staged):
        out = out.unionByName(parse_type(staged, kind, registry))
    return out


def records(table: DataFrame, kind: str, schema: str) -> DataFrame:
    """Rows of one type with their own columns, read out of ``record`` by ``schema``."""
    return table.where((F.col("type") == kind) & F.col("error").isNull()).select("path", F.try_variant_get("record", "$", f"struct<{schema}>").alias("r")).select("path", "r.*")


# ------------------------------------------------------------------ tables


def write_batch(spark: SparkSession, staged: DataFrame, folder: str, batch: int, registry: FormatRegistry) -> None:
    """Write a staged batch below ``folder`` as ``family=F/batch=N/type=T``; a repeated batch replaces its own files.

    Types are written one after the other: a parser that fails costs its own type's files of the batch, which become
    error rows, and not the batch.
    """

    def write(rows: DataFrame) -> None:
        placed = rows.withColumn("batch", F.lit(batch).cast("bigint"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("family", "batch", "type").parquet(folder)

    write(_refused(staged))
    for kind in types_to_parse(staged):
        try:
            write(parse_type(staged, kind, registry))
        except Exception as failure:  # noqa: BLE001 - a caller's parser may raise anything
            message = f"parser failed: {str(failure).strip().splitlines()[0][:500] if str(failure).strip() else type(failure).__name__}"
            bad = staged.where((F.col("type") == kind) & F.col("reason").isNull()).select(
                "path", F.lit(ERRORS).alias("family"), "type", F.lit(None).cast("variant").alias("record"), F.lit(message).alias("error"))
            write(bad)


def read_family(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """The table of a family (or ``errors``): ``(path, record, error, batch, type)``."""
    return spark.read.schema("path STRING, record VARIANT, error STRING, batch BIGINT, type STRING").option("basePath", f"{folder}/family={family}").parquet(f"{folder}/family={family}")
