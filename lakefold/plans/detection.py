"""Queries: file admission, file sources and format detection.

File names and leading bytes are derived from table rows; the sample signatures below are spread
over whole tables by key, and each lists what every detector must say about it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as R
from ..functions import formats as D
from ..functions import scalars as S
from ..operators import detect as OD
from ..sources import files as SF
from .tables import of_tables, query, table

REG = R.FormatRegistry()

# ------------------------------------------------------------------ name and byte fixtures

_SUFFIXES = [f".{e}" for exts in R.CATEGORIES.values() for e in exts] + [
    ".PDF", ".tar.Docx", "", ".", ".py", ".unknown", ".ogg", ".flac", ".html", ".x.csv",
]
NAME = "replace(p_name, ' ', '_') || CASE p_partkey % {} {} END".format(
    len(_SUFFIXES), " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SUFFIXES))
)
# name, extension (or NULL) for every part row
_NAMED = f"""named AS (SELECT p_partkey, {NAME} AS name FROM part),
    n AS (SELECT p_partkey, name, nullif(lower(regexp_extract(name, '\\.([^.]+)$', 1)), '') AS ext,
                 lower(string_split(name, '.')[-1]) AS loose FROM named)"""


def _values(rows):
    def lit(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


_REGISTRY = f"reg(ext, category) AS (VALUES {_values(sorted(REG._category.items()))})"
_SUPPORTED = f"reg(ext, category) AS (VALUES {_values([(e, c) for c, es in R.CATEGORIES.items() for e in es])})"

# hex, padded?, magic, image, media, ebml, zip, zip_loose, word, embedded image
_PAD = "00" * 520
_SAMPLES = [
    ("255044462D312E37", True, "pdf", None, "unknown", "unknown", False, False, "Unknown", "image/png"),
    ("504B0304140000", True, "zip", None, "unknown", "unknown", True, True, "DOCX", "image/png"),
    ("504B0506", True, "unknown", None, "unknown", "unknown", False, True, "Unknown", "image/png"),
    ("526172211A07", True, "rar", None, "unknown", "unknown", False, False, "Unknown", "image/png"),
    ("89504E470D0A1A0A", True, "png", "png", "unknown", "unknown", False, False, "Unknown", "image/png"),
    ("FFD8FFE000104A46", True, "jpeg", "jpg", "unknown", "unknown", False, False, "Unknown", "image/jpeg"),
    ("474946383961", True, "gif", "gif", "unknown", "unknown", False, False, "Unknown", "image/gif"),
    ("47494631", True, "unknown", "gif", "unknown", "unknown", False, False, "Unknown", "image/gif"),
    ("424D36000000", True, "bmp", "bmp", "unknown", "unknown", False, False, "Unknown", "image/png"),
    ("42413600", True, "unknown", None, "unknown", "unknown", False, False, "Unknown", "image/png"),
    ("49492A00", True, "unknown", "tif", "unknown", "unknown", False, False, "Unknown", "image/png"),
    ("4D4D002A", True, "unknown", None, "unknown", "unknown", False, False, "Unknown", "image/png"),
    ("38425053", True, "unknown", "psd", "unknown", "unknown", False, False, "Unknown", "image/png"),
    ("524946460000000057454250", True, "unknown", "webp", "unknown", "unknown", False, False, "Unknown", "image/png"),
    ("524946460000000057415645", True, "unknown", None, "wav", "unknown", False, False, "Unknown", "image/png"),
    ("524946460000000041564920", True, "unknown", None, "avi", "unknown", False, False, "Unknown", "image/png"),
    ("000000186674797069736F6D", True, "unknown", None, "mp4", "unknown", False, False, "Unknown", "image/png"),
    ("464C560105", True, "unknown", None, "flv", "unknown", False, False, "Unknown", "image/png"),
    ("1A45DFA39F4286810142F7810142F2810442F381084282847765626D", True, "unknown", None, "webm", "webm", False, False, "Unknown", "image/png"),
    ("1A45DFA3A34286810142F7810142F2810442F381084282886D6174726F736B61", True, "unknown", None, "mkv", "mkv", False, False, "Unknown", "image/png"),
    ("FFFB9044", True, "unknown", None, "mp3", "unknown", False, False, "Unknown", "image/png"),
    ("FFE31800", True, "unknown", None, "mp3", "unknown", False, False, "Unknown", "image/png"),
    ("D0CF11E0A1B11AE1", True, "unknown", None, "unknown", "unknown", False, False, "DOC", "image/png"),
    ("D0CF11E0A1B11AE1", False, "unknown", None, "unknown", "unknown", False, False, "DOC", "image/png"),
    ("00000000", True, "unknown", None, "unknown", "unknown", False, False, "Unknown", "image/png"),
    ("504B", False, "unknown", None, "unknown", "unknown", False, True, "Unknown", "image/png"),
    ("FFD8", False, "unknown", None, "unknown", "unknown", False, False, "Unknown", "image/png"),
    ("", False, "unknown", None, "unknown", "unknown", False, False, "Unknown", "image/png"),
]
_N = len(_SAMPLES)
_SAMPLE_SQL = f"""s(k, hx, padded, magic, image, media, ebml, zip, zip_loose, word, embedded) AS (VALUES {_values([(i, *row) for i, row in enumerate(_SAMPLES)])}),
    b AS (SELECT o_orderkey, s.* FROM orders JOIN s ON o_orderkey % {_N} = s.k)"""


def _content(key="o_orderkey"):
    cases = " ".join(f"WHEN {i} THEN '{h}{_PAD if padded else ''}'" for i, (h, padded, *_) in enumerate(_SAMPLES))
    return F.unhex(F.expr(f"CASE {key} % {_N} {cases} END"))


def _blobs(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", _content().alias("content"))


def _names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(NAME).alias("name"))


def _registry(spark):
    return REG.frame(spark)


# ------------------------------------------------------------------ sources

_TABLE_FILES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem",
                "nation", "orders", "pages", "part", "region", "supplier"]
_FILES_SQL = f"SELECT name || '.parquet' AS name, 'parquet' AS ext, '50415231' AS magic FROM (VALUES {_values([(t,) for t in _TABLE_FILES])}) v(name)"


@query("scan_files", f"{_FILES_SQL}")
def scan_files(spark, sf):
    """The table files themselves, scanned as bytes, in pieces that any executor holds."""
    files = SF.scan_files(spark, sf, glob="*.parquet", piece_bytes=SF.PIECE_BYTES)
    return of_tables(files.where("offset = 0"), S.file_ext(F.col("path")).alias("ext"), F.hex(D.file_header(F.col("content"), 4)).alias("magic"))


@query("file_headers", f"{_FILES_SQL}")
def file_headers(spark, sf):
    """Only the first bytes of each table file, whatever its size."""
    files = SF.scan_files(spark, sf, glob="*.parquet").select("path", "length")
    return of_tables(SF.file_headers(files, 4), S.file_ext(F.col("path")).alias("ext"), F.hex("header").alias("magic"))


_ADMIT = f"""{_NAMED}, j AS (SELECT p_partkey, name, CASE WHEN coalesce(ext, '') NOT IN ('pdf', 'docx', 'csv', 'zip') THEN 'unsupported type: ' || coalesce(ext, '')
      WHEN p_partkey * 1000003 % 209715200 > 104857600 THEN 'file too large' END AS reason FROM n)"""


@query("admit_files", f"WITH {_ADMIT} SELECT p_partkey, name, reason IS NULL AS admitted, reason FROM j")
def admit_files(spark, sf):
    files = _names(spark, sf).withColumn("size", F.col("p_partkey") * 1000003 % 209715200)
    ok, bad = SF.admit_files(files, F.col("name"), F.col("size"), [".pdf", "DOCX", "csv", "zip"])
    return ok.select("p_partkey", "name", F.lit(True).alias("admitted"), F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("p_partkey", "name", F.lit(False).alias("admitted"), "reason")
    )


@query(
    "size_verdict",
    """
    WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey * 1000003 % 209715200 END AS size FROM orders)
    SELECT o_orderkey, coalesce(size <= 104857600, false) AS valid, coalesce(size > 10485760 AND size <= 104857600, false) AS warning,
           CASE WHEN size IS NULL THEN 'invalid file' WHEN size > 104857600 THEN 'file too large' END AS error FROM s
    """,
)
def size_verdict(spark, sf):
    size = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey") * 1000003 % 209715200)
    return table(spark, sf, "orders").select("o_orderkey", D.size_verdict(size).alias("v")).select("o_orderkey", "v.*")


@query(
    "accumulate_selection",
    """
    SELECT 'append' AS mode, source, count(*) AS files FROM documents GROUP BY source
    UNION ALL SELECT 'replace', source, count(*) FROM documents WHERE doc_id % 3 = 1 GROUP BY source
    """,
)
def accumulate_selection(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    first, second = docs.filter("doc_id % 3 <> 1"), docs.filter("doc_id % 3 = 1")
    both = SF.accumulate_selection(first, second).withColumn("mode", F.lit("append")).unionByName(
        SF.accumulate_selection(first, second, multiple=False).withColumn("mode", F.lit("replace"))
    )
    return both.groupBy("mode", "source").agg(F.count(F.lit(1)).alias("files"))


def _document_files(spark, sf):
    """Documents as files: a third with a byte-order mark."""
    mark = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("/lake/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(mark, F.encode("text", "UTF-8")).alias("content"),
    )


@query("read_text_files", "SELECT '/lake/' || doc_id || '.txt' AS path, text FROM documents")
def read_text_files(spark, sf):
    return SF.text_files(_document_files(spark, sf))


@query(
    "read_csv_files",
    """
    SELECT '/lake/' || c_custkey || '.csv' AS path, 'k,name,bal' AS header, 2 AS row_num, CAST(c_custkey AS VARCHAR) AS k, c_name || ', x' AS name, c_mktsegment AS bal FROM customer
    """,
)
def read_csv_files(spark, sf):
    text = F.concat(F.lit("k,name,bal\n"), F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(', x", '), "c_mktsegment", F.lit("\n"))
    files = table(spark, sf, "customer").select(
        F.concat(F.lit("/lake/"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"), F.encode(text, "UTF-8").alias("content")
    )
    return SF.csv_files(files).select("path", F.array_join("header", ",").alias("header"), "row_num",
                                      *[F.get("columns", F.lit(i)).alias(n) for i, n in enumerate(("k", "name", "bal"))])


@query("read_json_docs", "SELECT '/lake/' || event_id || '.json' AS path, event_id % 5 <> 0 AS valid, CASE WHEN event_id % 5 <> 0 THEN CAST(props->>'k' AS BIGINT) END AS k FROM events")
def read_json_docs(spark, sf):
    broken = F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    files = table(spark, sf, "events").select(
        F.concat(F.lit("/lake/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.encode(broken, "UTF-8").alias("content")
    )
    return SF.json_files(files).select("path", "valid", F.try_variant_get("doc", "$.k", "bigint").alias("k"))


@query("read_xml_docs", "SELECT '/lake/' || p_partkey || '.xml' AS path, p_partkey % 5 <> 0 AS valid FROM part")
def read_xml_docs(spark, sf):
    text = F.concat(F.lit("<part><name>"), "p_name", F.when(F.col("p_partkey") % 5 == 0, F.lit("</part>")).otherwise(F.lit("</name></part>")))
    files = table(spark, sf, "part").select(
        F.concat(F.lit("/lake/"), F.col("p_partkey").cast("string"), F.lit(".xml")).alias("path"), F.encode(text, "UTF-8").alias("content")
    )
    return SF.xml_files(files).select("path", "valid")


# ------------------------------------------------------------------ detection by name


@query("file_ext", f"WITH {_NAMED} SELECT p_partkey, name, ext FROM n")
def file_ext(spark, sf):
    return _names(spark, sf).withColumn("ext", S.file_ext(F.col("name")))


@query("file_ext_loose", f"WITH {_NAMED} SELECT p_partkey, name, loose FROM n")
def file_ext_loose(spark, sf):
    return _names(spark, sf).withColumn("loose", S.file_ext_loose(F.col("name")))


@query("category_of", f"WITH {_NAMED}, {_REGISTRY} SELECT p_partkey, name, n.ext, category FROM n LEFT JOIN reg ON n.ext = reg.ext")
def category_of(spark, sf):
    return OD.category_of(_names(spark, sf), "name", _registry(spark)).select("p_partkey", "name", "ext", "category")


@query("supported_files", f"WITH {_NAMED}, {_REGISTRY} SELECT p_partkey, name FROM n WHERE ext IN (SELECT ext FROM reg)")
def supported_files(spark, sf):
    return OD.supported_files(_names(spark, sf), "name", _registry(spark)).select("p_partkey", "name")


@query("unsupported_files", f"WITH {_NAMED}, {_REGISTRY} SELECT p_partkey, name FROM n WHERE ext IS NULL OR ext NOT IN (SELECT ext FROM reg)")
def unsupported_files(spark, sf):
    return OD.unsupported_files(_names(spark, sf), "name", _registry(spark)).select("p_partkey", "name")


@query("supported_types", f"WITH {_NAMED}, {_REGISTRY} SELECT DISTINCT ext FROM n WHERE ext IN (SELECT ext FROM reg)")
def supported_types(spark, sf):
    return OD.supported_types(_names(spark, sf), "name", _registry(spark))


@query("code_language", f"WITH {_NAMED}, lang(ext, language) AS (VALUES {_values(sorted(R.CODE_LANGUAGES.items()))}) SELECT p_partkey, name, coalesce(language, 'plaintext') AS language FROM n LEFT JOIN lang ON loose = lang.ext")
def code_language(spark, sf):
    return _names(spark, sf).withColumn("language", D.code_language(F.col("name")))


@query(
    "display_names",
    f"""
    WITH {_NAMED}, a(ext, v) AS (VALUES {_values(sorted(R.AUDIO_NAMES.items()))}), w(ext, v) AS (VALUES {_values(sorted(R.VIDEO_NAMES.items()))}),
    t(ext, v) AS (VALUES {_values(sorted(R.TYPE_LABELS.items()))}), o(ext, v) AS (VALUES {_values(sorted(R.OFFICE_NAMES.items()))})
    SELECT p_partkey, coalesce(a.v, 'Unknown') AS audio, coalesce(w.v, 'Unknown') AS video,
           CASE WHEN p_partkey % 2 = 1 THEN 'Folder' ELSE coalesce(t.v, 'File') END AS label, coalesce(o.v, 'Office 文件') AS office
    FROM n LEFT JOIN a ON loose = a.ext LEFT JOIN w ON loose = w.ext LEFT JOIN t ON string_split(name, '.')[-1] = t.ext LEFT JOIN o ON loose = o.ext
    """,
)
def display_names(spark, sf):
    ext = S.file_ext_loose(F.col("name"))
    return _names(spark, sf).select(
        "p_partkey", D.media_format_name(ext).alias("audio"), D.media_format_name(ext, "video").alias("video"),
        D.type_label(F.col("name"), F.col("p_partkey") % 2 == 1).alias("label"), D.office_type_name(ext).alias("office"),
    )


@query(
    "adapter_route",
    f"""
    WITH {_NAMED}, r(ext, family, priority) AS (VALUES {_values([(e, f, i) for i, (f, es) in enumerate(R.ROUTES) for e in es])}),
    best AS (SELECT ext, arg_min(family, priority) AS family FROM r GROUP BY ext)
    SELECT p_partkey, name, n.ext, family FROM n LEFT JOIN best ON n.ext = best.ext
    """,
)
def adapter_route(spark, sf):
    return OD.adapter_route(_names(spark, sf), "name", R.routes(spark)).select("p_partkey", "name", "ext", "family")


_HANDLED = ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "pdf", "txt", "md", "js", "ts", "py", "java", "c", "cpp", "css", "html", "json", "xml", "ogg"]


@query(
    "coverage_gap",
    f"""
    WITH {_NAMED}, {_REGISTRY}, h(ext) AS (VALUES {_values([(e,) for e in _HANDLED])}), seen AS (SELECT DISTINCT ext FROM n WHERE ext IS NOT NULL)
    SELECT ext, 'no handler' AS gap FROM (SELECT ext FROM seen INTERSECT SELECT ext FROM reg EXCEPT SELECT ext FROM h)
    UNION ALL SELECT ext, 'not registered' FROM (SELECT ext FROM seen INTERSECT SELECT ext FROM h EXCEPT SELECT ext FROM reg)
    """,
)
def coverage_gap(spark, sf):
    handled = spark.createDataFrame([(e,) for e in _HANDLED], "ext STRING")
    return OD.coverage_gap(_names(spark, sf), "name", _registry(spark), handled)


@query(
    "mime_of",
    f"""
    WITH {_NAMED}, w(ext, v) AS (VALUES {_values(sorted(R.WORD_PART_MIME.items()))}), k(ext, v) AS (VALUES {_values(sorted(R.PACKAGE_PART_MIME.items()))}),
    s(ext, v) AS (VALUES {_values(sorted(R.SLIDE_PART_MIME.items()))}), i(ext, v) AS (VALUES {_values(sorted(R.IMAGE_MIME.items()))})
    SELECT p_partkey, coalesce(w.v, 'image/png') AS word, coalesce(k.v, 'image/png') AS package, coalesce(s.v, 'image') AS slide, i.v AS image
    FROM n LEFT JOIN w ON loose = w.ext LEFT JOIN k ON loose = k.ext LEFT JOIN s ON loose = s.ext LEFT JOIN i ON loose = i.ext
    """,
)
def mime_of(spark, sf):
    return _names(spark, sf).select("p_partkey", *[D.mime_of(F.col("name"), t).alias(t) for t in ("word", "package", "slide", "image")])


@query(
    "mime_allowed",
    f"""
    WITH {_NAMED}, i(ext, mime) AS (VALUES {_values(sorted(R.IMAGE_MIME.items()))}), a(mime, type) AS (VALUES {_values(sorted(R.ALLOWED_IMAGE_MIME.items()))})
    SELECT p_partkey, coalesce(type NOT IN ('tif'), false) AS valid, CASE WHEN type <> 'tif' THEN type END AS type,
           CASE WHEN i.mime IS NULL THEN 'invalid file' WHEN type = 'tif' THEN 'unsupported format' END AS error
    FROM n LEFT JOIN i ON loose = i.ext LEFT JOIN a ON i.mime = a.mime
    """,
)
def mime_allowed(spark, sf):
    verdict = D.mime_allowed(D.mime_of(F.col("name")), ["jpg", "png", "gif", "bmp", "svg", "webp", "psd"])
    return _names(spark, sf).select("p_partkey", verdict.alias("v")).select("p_partkey", "v.*")


@query(
    "office_ext",
    f"""
    WITH {_NAMED} SELECT p_partkey, coalesce(ext IN ('doc', 'docx', 'xls', 'xlsx', 'csv', 'ppt', 'pptx'), false) AS office,
      coalesce(ext IN ('doc', 'docx', 'xls', 'xlsx', 'csv', 'ppt', 'pptx'), false) AS dotted FROM n
    """,
)
def office_ext(spark, sf):
    ext = S.file_ext(F.col("name"))
    return _names(spark, sf).select("p_partkey", D.is_office_ext(ext).alias("office"),
                                    D.is_office_ext(F.concat(F.lit("."), F.upper(ext))).alias("dotted"))


@query(
    "file_profile",
    f"""
    WITH {_NAMED}, p(ext, format, mime_type) AS (VALUES {_values([(k, *v) for k, v in sorted(R.PROFILE_MIME.items())])})
    SELECT p_partkey, format, mime_type, p_partkey * 17 AS size FROM n LEFT JOIN p ON n.ext = p.ext
    """,
)
def file_profile(spark, sf):
    p = D.file_profile(S.file_ext(F.col("name")), F.col("p_partkey") * 17)
    return _names(spark, sf).select("p_partkey", p.alias("p")).select("p_partkey", "p.*")


# ------------------------------------------------------------------ detection by content


@query("detect_magic", f"WITH {_SAMPLE_SQL} SELECT o_orderkey, magic FROM b")
def detect_magic(spark, sf):
    return _blobs(spark, sf).select("o_orderkey", D.detect_magic(D.file_header(F.col("content"))).alias("magic"))


@query(
    "detect_type",
    f"""
    WITH {_NAMED}, {_SUPPORTED}, s(k, magic) AS (VALUES {_values([(i, r[2]) for i, r in enumerate(_SAMPLES)])})
    SELECT p_partkey, coalesce(reg.ext, magic) AS type FROM n LEFT JOIN reg ON n.ext = reg.ext JOIN s ON p_partkey % {_N} = s.k
    """,
)
def detect_type(spark, sf):
    return _names(spark, sf).select("p_partkey", D.detect_type(F.col("name"), _content("p_partkey")).alias("type"))


@query(
    "type_mismatch_audit",
    f"""
    WITH {_NAMED}, s(k, magic) AS (VALUES {_values([(i, r[2]) for i, r in enumerate(_SAMPLES)])}),
    e AS (SELECT *, CASE WHEN ext IN ('docx', 'xlsx', 'pptx', 'jar', 'epub') THEN 'zip' WHEN ext = 'jpg' THEN 'jpeg'
      WHEN ext IN ('pdf', 'zip', 'rar', 'png', 'jpeg', 'gif', 'bmp') THEN ext END AS expected FROM n JOIN s ON p_partkey % {_N} = s.k)
    SELECT p_partkey, ext, magic, expected = magic AS agrees FROM e
    """,
)
def type_mismatch_audit(spark, sf):
    files = _names(spark, sf).withColumn("content", _content("p_partkey"))
    return OD.type_mismatch_audit(files, "name", "content").select("p_partkey", "ext", "magic", "agrees")


@query("detect_image", f"WITH {_SAMPLE_SQL} SELECT o_orderkey, image FROM b")
def detect_image(spark, sf):
    return _blobs(spark, sf).select("o_orderkey", D.detect_image(F.col("content")).alias("image"))


@query("detect_bmp_tiff", f"WITH {_SAMPLE_SQL} SELECT o_orderkey, hx LIKE '424_36%' AS bmp, hx IN ('49492A00', '4D4D002A') AS tiff FROM b")
def detect_bmp_tiff(spark, sf):
    return _blobs(spark, sf).select("o_orderkey", D.is_bmp_any(F.col("content")).alias("bmp"), D.is_tiff_any(F.col("content")).alias("tiff"))


@query("detect_media", f"WITH {_SAMPLE_SQL} SELECT o_orderkey, media FROM b")
def detect_media(spark, sf):
    return _blobs(spark, sf).select("o_orderkey", D.detect_media(F.col("content")).alias("media"))


@query("ebml_doctype", f"WITH {_SAMPLE_SQL} SELECT o_orderkey, ebml FROM b")
def ebml_doctype(spark, sf):
    return _blobs(spark, sf).select("o_orderkey", D.ebml_doctype(F.col("content")).alias("ebml"))


@query("is_zip", f"WITH {_SAMPLE_SQL} SELECT o_orderkey, zip, zip_loose FROM b")
def is_zip(spark, sf):
    return _blobs(spark, sf).select("o_orderkey", D.is_zip(F.col("content")).alias("zip"), D.is_zip(F.col("content"), strict=False).alias("zip_loose"))


@query("is_ole2", f"WITH {_SAMPLE_SQL} SELECT o_orderkey, hx LIKE 'D0CF%' AND padded AS full_size, hx LIKE 'D0CF%' AS any_size FROM b")
def is_ole2(spark, sf):
    return _blobs(spark, sf).select("o_orderkey", D.is_ole2(F.col("content")).alias("full_size"), D.is_ole2(F.col("content"), 8).alias("any_size"))


@query(
    "word_kind",
    f"""
    WITH {_SAMPLE_SQL} SELECT o_orderkey, word AS format, CASE word WHEN 'DOC' THEN 'application/msword'
      WHEN 'DOCX' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS mime_type FROM b
    """,
)
def word_kind(spark, sf):
    return _blobs(spark, sf).select("o_orderkey", D.word_kind(F.col("content")).alias("w")).select("o_orderkey", "w.*")


@query(
    "is_pdf",
    f"""
    WITH {_NAMED}, s(k, magic) AS (VALUES {_values([(i, r[2]) for i, r in enumerate(_SAMPLES)])})
    SELECT p_partkey, magic = 'pdf' AS bytes, magic = 'pdf' AND (coalesce(ext, '') = 'pdf' OR p_partkey % 3 = 0) AS strict
    FROM n JOIN s ON p_partkey % {_N} = s.k
    """,
)
def is_pdf(spark, sf):
    mime = F.when(F.col("p_partkey") % 3 == 0, "Application/PDF; v=1").when(F.col("p_partkey") % 3 == 1, "text/plain")
    return _names(spark, sf).select(
        "p_partkey", D.is_pdf_bytes(_content("p_partkey")).alias("bytes"), D.is_pdf(F.col("name"), mime, _content("p_partkey")).alias("strict")
    )


@query("is_gif", f"WITH {_SAMPLE_SQL} SELECT o_orderkey, coalesce(image = 'gif', false) AND o_orderkey % 2 = 0 AS gif FROM b")
def is_gif(spark, sf):
    mime = F.when(F.col("o_orderkey") % 2 == 0, "image/gif").when(F.col("o_orderkey") % 3 == 0, "image/png")
    return _blobs(spark, sf).select("o_orderkey", D.is_gif(mime, F.col("content")).alias("gif"))


@query("sniff_embedded_image", f"WITH {_SAMPLE_SQL} SELECT o_orderkey, embedded FROM b")
def sniff_embedded_image(spark, sf):
    return _blobs(spark, sf).select("o_orderkey", D.sniff_embedded_image(F.col("content")).alias("embedded"))


@query(
    "mime_matches",
    """
    SELECT doc_id, lang IN ('en', 'es') AS mime, starts_with(text, 'Es') AS signature FROM documents
    """,
)
def mime_matches(spark, sf):
    mime = F.concat(F.lit("Text/E"), F.substring("lang", 2, 1), F.lit("; x"))
    mime = F.when(F.col("lang").startswith("e"), mime).otherwise(F.lit("image/png"))
    return table(spark, sf, "documents").select(
        "doc_id", D.mime_matches(mime, F.lit("text/e")).alias("mime"), D.content_starts_with(F.encode("text", "UTF-8"), "Es").alias("signature")
    )


def _encoded(spark, sf):
    """Customer names in several charsets: plain, marked, GBK and UTF-16 bytes."""
    k = F.col("c_custkey") % 4
    name = F.col("c_name")
    content = (
        F.when(k == 0, F.encode(F.concat(name, F.lit("é")), "UTF-8"))
        .when(k == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(name, "UTF-16BE")))
        .when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(name, "UTF-16LE")))
        .otherwise(F.concat(F.encode(name, "UTF-8"), F.unhex(F.lit("C4E3BAC3"))))
    )
    return table(spark, sf, "customer").select("c_custkey", content.alias("content"))


@query(
    "detect_encoding",
    """
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16be' WHEN 2 THEN 'utf-16le' ELSE 'gbk' END AS charset FROM customer
    """,
)
def detect_encoding(spark, sf):
    return _encoded(spark, sf).select("c_custkey", OD.detect_encoding(F.col("content")).alias("charset"))


@query("decode_text", "SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN 'é' WHEN 3 THEN '你好' ELSE '' END AS text FROM customer")
def decode_text(spark, sf):
    found = _encoded(spark, sf).withColumn("charset", OD.detect_encoding(F.col("content")))
    return found.select("c_custkey", OD.decode_text(F.col("content"), F.col("charset")).alias("text"))
