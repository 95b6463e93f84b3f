"""Format detection on names, MIME types and leading bytes, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import registry as R
from .arrays import let
from .scalars import file_ext, file_ext_loose, hex_magic
from .text import latin1


def begins(content: Column, hex_prefix: str) -> Column:
    return F.startswith(content, F.unhex(F.lit(hex_prefix)))


def first_match(content: Column, table: list[tuple[str, str]]) -> Column:
    """Name of the first signature that matches, null when none does."""
    out = F.lit(None).cast("string")
    for name, prefix in reversed(table):
        out = F.when(begins(content, prefix), F.lit(name)).otherwise(out)
    return out


def file_header(content: Column, n: int = 16) -> Column:
    return F.substring(content, 1, n)


def detect_magic(content: Column) -> Column:
    return F.coalesce(first_match(content, R.MAGIC), F.lit("unknown"))


def known_ext(name: Column, extensions: list[str] | None = None) -> Column:
    """The extension if it is a registered format."""
    known = extensions or [e for exts in R.CATEGORIES.values() for e in exts]
    ext = file_ext(name)
    return F.when(ext.isin(*known), ext)


def detect_type(name: Column, content: Column, extensions: list[str] | None = None) -> Column:
    """A registered extension wins, otherwise the leading bytes decide."""
    return F.coalesce(known_ext(name, extensions), detect_magic(content))


def detect_image(content: Column) -> Column:
    """Image format of the leading bytes; a RIFF file is WebP only with its form type."""
    others = [(n, p) for n, p in R.IMAGE_MAGIC if n != "webp"]
    webp = begins(content, "52494646") & (hex_magic(content, 8, 4) == "57454250")
    return F.when(webp, "webp").otherwise(first_match(content, others))


def is_bmp_any(content: Column) -> Column:
    return hex_magic(content, 0, 2).isin(*R.BMP_ANY)


def is_tiff_any(content: Column) -> Column:
    return hex_magic(content, 0, 4).isin(*R.TIFF_ANY)


def ebml_doctype(content: Column) -> Column:
    """webm or matroska named in the EBML header, else unknown.

    The header's length follows its mark, in one to eight bytes, the first of which tells how many by its
    leading zero bits; without a mark, or where the length is left open, the first 100 bytes are taken.
    """

    def measured(first: Column) -> Column:
        width = F.lit(9) - F.length(F.bin(first))
        return let(width, lambda n: let(
            F.conv(F.hex(F.substring(content, F.lit(5), n)), 16, 10).try_cast("bigint") - F.pow(F.lit(2.0), 7 * n).cast("bigint"),
            lambda size: F.when(size < F.pow(F.lit(2.0), 7 * n).cast("bigint") - 1, F.least(4 + n + size, F.octet_length(content)).cast("int"))))

    first = F.nullif(F.conv(hex_magic(content, 4, 1), 16, 10).cast("int"), F.lit(0))
    end = F.when(begins(content, "1A45DFA3"), let(first, lambda f: F.when(f.isNotNull(), measured(f))))
    head = latin1(F.substring(content, F.lit(1), F.coalesce(end, F.lit(100))))
    return let(head, lambda h: F.when(F.contains(h, F.lit("webm")), "webm").when(F.contains(h, F.lit("matroska")), "mkv").otherwise("unknown"))


def detect_media(content: Column) -> Column:
    second = F.conv(hex_magic(content, 1, 1), 16, 10).cast("int")
    sync = begins(content, "FF") & (second.bitwiseAND(F.lit(0xE0)) == 0xE0)
    form = hex_magic(content, 8, 4)
    riff = begins(content, "52494646")
    ebml = begins(content, "1A45DFA3")
    return (
        F.when(sync, "mp3")
        .when(riff & (form == "57415645"), "wav")
        .when(riff & (form == "41564920"), "avi")
        .when(hex_magic(content, 4, 4) == "66747970", "mp4")
        .when(begins(content, "464C5601"), "flv")
        .when(ebml & (ebml_doctype(content) == "webm"), "webm")
        .when(ebml, "mkv")
        .otherwise("unknown")
    )


def is_zip(content: Column, strict: bool = True) -> Column:
    return begins(content, "504B0304" if strict else "504B")


def is_ole2(content: Column, min_size: int = 512) -> Column:
    return (F.octet_length(content) >= min_size) & begins(content, R.OLE2_MAGIC)


def word_kind(content: Column) -> Column:
    """format and mime_type of a word-processor file."""
    def rec(ext: str | None) -> Column:
        fmt, mime = R.PROFILE_MIME[ext] if ext else ("Unknown", None)
        return F.struct(F.lit(fmt).alias("format"), F.lit(mime).cast("string").alias("mime_type"))

    return F.when(is_zip(content), rec("docx")).when(begins(content, R.OLE2_MAGIC), rec("doc")).otherwise(rec(None))


def is_pdf_bytes(content: Column) -> Column:
    return begins(content, "25504446")


def is_pdf(name: Column, mime: Column, content: Column) -> Column:
    """Claimed by extension or MIME type, and the bytes start ``%PDF-``."""
    claimed = (file_ext_loose(name) == "pdf") | mime_matches(mime, F.lit("application/pdf"))
    return F.coalesce(claimed, F.lit(False)) & begins(content, "255044462D")


def is_gif(mime: Column, content: Column) -> Column:
    return F.coalesce(mime == "image/gif", F.lit(False)) & begins(content, "474946")


def sniff_embedded_image(content: Column) -> Column:
    """MIME type of an embedded picture: PNG, JPEG and GIF marks, PNG when none matches."""
    n = F.octet_length(content)
    return (
        F.when((n > 8) & begins(content, "89504E47"), "image/png")
        .when((n > 2) & begins(content, "FFD8"), "image/jpeg")
        .when((n > 6) & begins(content, "474946"), "image/gif")
        .otherwise("image/png")
    )


def mime_of(name: Column, table: str = "image") -> Column:
    """MIME type of an image name; ``word`` and ``package`` default to PNG, ``slide`` to ``image``, ``image`` to null."""
    mapping, default = {
        "word": (R.WORD_PART_MIME, "image/png"),
        "package": (R.PACKAGE_PART_MIME, "image/png"),
        "slide": (R.SLIDE_PART_MIME, "image"),
        "image": (R.IMAGE_MIME, None),
    }[table]
    return R.lookup(file_ext_loose(name), mapping, default)


def mime_allowed(mime: Column, allowed: list[str] | None = None) -> Column:
    """valid, type, error for a declared MIME type."""
    allowed = allowed or ["jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "psd", "tif"]
    kind = R.lookup(mime, R.ALLOWED_IMAGE_MIME)
    ok = F.coalesce(kind.isin(*allowed), F.lit(False))
    missing = mime.isNull() | (mime == "")
    return F.struct(
        ok.alias("valid"),
        F.when(ok, kind).alias("type"),
        F.when(missing, "invalid file").when(~ok, "unsupported format").alias("error"),
    )


def mime_matches(mime: Column, expected: Column) -> Column:
    return F.startswith(F.lower(mime), F.lower(expected))


def content_starts_with(content: Column, signature: str) -> Column:
    return F.startswith(content, F.encode(F.lit(signature), "ISO-8859-1"))


def code_language(name: Column) -> Column:
    return R.lookup(file_ext_loose(name), R.CODE_LANGUAGES, "plaintext")


def media_format_name(ext: Column, kind: str = "audio") -> Column:
    return R.lookup(ext, R.AUDIO_NAMES if kind == "audio" else R.VIDEO_NAMES, "Unknown")


def type_label(name: Column, is_dir: Column) -> Column:
    """Listing label of an archive entry; the extension is matched as written."""
    return F.when(is_dir, "Folder").otherwise(R.lookup(F.element_at(F.split(name, "\\."), -1), R.TYPE_LABELS, "File"))


def office_type_name(ext: Column) -> Column:
    return R.lookup(F.lower(ext), R.OFFICE_NAMES, "Office 文件")


def is_office_ext(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(value), "^\\.", "").isin(*R.OFFICE_EXTENSIONS), F.lit(False))


def size_verdict(size: Column, limit: int = R.SIZE_LIMIT, warn: int = R.SIZE_WARNING) -> Column:
    """valid, warning, error for a file size."""
    return F.struct(
        F.coalesce(size <= limit, F.lit(False)).alias("valid"),
        F.coalesce((size > warn) & (size <= limit), F.lit(False)).alias("warning"),
        F.when(size.isNull(), "invalid file").when(size > limit, "file too large").alias("error"),
    )


def file_profile(ext: Column, size: Column) -> Column:
    """format, mime_type, size of the office formats."""
    return F.struct(
        R.lookup(ext, {k: v[0] for k, v in R.PROFILE_MIME.items()}).alias("format"),
        R.lookup(ext, {k: v[1] for k, v in R.PROFILE_MIME.items()}).alias("mime_type"),
        size.alias("size"),
    )
