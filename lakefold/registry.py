"""Format tables: what each extension is, which family opens it, its MIME type and label.

The literals below are fixed values (registered formats, signatures, MIME types, labels).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category of every registered extension.
CATEGORIES: dict[str, list[str]] = {
    "office": ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "wps", "et", "dps"],
    "document": ["pdf", "ofd", "rtf", "txt", "md", "xml", "json", "epub"],
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "svg", "tif", "tiff", "webp", "psd"],
    "media": ["mp3", "wav", "mp4", "flv", "avi", "mkv", "webm"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "gzip", "jar"],
    "other": ["xmind", "bpmn", "drawio", "eml", "dcm"],
}

# Leading bytes, tested in this order.
MAGIC = [
    ("pdf", "25504446"), ("zip", "504B0304"), ("rar", "52617221"), ("png", "89504E47"), ("jpeg", "FFD8FF"),
    ("gif", "47494638"), ("bmp", "424D"),
]
IMAGE_MAGIC = [
    ("jpg", "FFD8FF"), ("png", "89504E47"), ("gif", "474946"), ("bmp", "424D"), ("webp", "52494646"),
    ("psd", "38425053"), ("tif", "49492A00"),
]
BMP_ANY = ["424D", "4241", "4349", "4350", "4943", "5054"]
TIFF_ANY = ["49492A00", "4D4D002A"]
OLE2_MAGIC = "D0CF11E0A1B11AE1"

# Extensions whose content has another registered signature.
CONTAINER_OF = {"docx": "zip", "xlsx": "zip", "pptx": "zip", "jar": "zip", "epub": "zip", "jpg": "jpeg"}

# Families that open an extension, in order of precedence (audio before video).
ROUTES: list[tuple[str, list[str]]] = [
    ("office", ["doc", "docx", "xls", "xlsx", "csv", "ppt", "pptx", "wps", "et", "dps"]),
    ("document", ["pdf", "ofd", "rtf", "txt", "md", "xml", "json", "epub"]),
    ("image", ["jpg", "jpeg", "png", "gif", "bmp", "svg", "tif", "tiff", "webp", "psd"]),
    ("audio", ["mp3", "wav", "ogg", "flac", "aac", "m4a", "wma", "mid"]),
    ("video", ["mp4", "webm", "ogg", "flv", "avi", "mkv", "mov", "wmv", "m4v", "3gp"]),
    ("archive", ["zip", "rar", "7z", "tar", "gz", "gzip", "jar"]),
]
OFFICE_EXTENSIONS = ["doc", "docx", "xls", "xlsx", "csv", "ppt", "pptx"]

# MIME types; three tables differ in coverage and in what they answer for unknown names.
IMAGE_MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp",
    "svg": "image/svg+xml", "webp": "image/webp", "psd": "image/vnd.adobe.photoshop", "tif": "image/tiff", "tiff": "image/tiff",
}
WORD_PART_MIME = {k: IMAGE_MIME[k] for k in ("png", "jpg", "jpeg", "gif", "bmp", "tiff")}
PACKAGE_PART_MIME = {**WORD_PART_MIME, "webp": "image/webp"}
SLIDE_PART_MIME = {k: IMAGE_MIME[k] for k in ("png", "jpg", "jpeg", "gif", "bmp")}
ALLOWED_IMAGE_MIME = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif", "image/bmp": "bmp",
    "image/svg+xml": "svg", "image/webp": "webp", "image/vnd.adobe.photoshop": "psd", "image/tiff": "tif", "image/tif": "tif",
}
PROFILE_MIME = {
    "xlsx": ("XLSX", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    "xls": ("XLS", "application/vnd.ms-excel"),
    "et": ("ET", "application/vnd.ms-excel"),
    "dps": ("DPS", "application/vnd.ms-powerpoint"),
    "docx": ("DOCX", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "doc": ("DOC", "application/msword"),
    "csv": ("CSV", "text/csv"),
}

# Code languages by extension.
CODE_LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java",
    "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "css": "css", "scss": "scss", "less": "less",
    "html": "html", "htm": "html", "xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml", "sql": "sql",
    "php": "php", "rb": "ruby", "go": "go", "rs": "rust", "sh": "bash", "bat": "batch", "ps1": "powershell", "vue": "vue",
}

# Display names.
AUDIO_NAMES = {
    "mp3": "MPEG-3 Audio", "wav": "WAV Audio", "ogg": "Ogg Audio", "flac": "FLAC Audio", "aac": "AAC Audio",
    "m4a": "M4A Audio", "wma": "WMA Audio", "mid": "MIDI",
}
VIDEO_NAMES = {
    "mp4": "MP4 Video", "webm": "WebM Video", "ogg": "Ogg Video", "flv": "Flash Video", "avi": "AVI Video",
    "mkv": "Matroska Video", "mov": "QuickTime Video", "wmv": "Windows Media Video", "m4v": "M4V Video", "3gp": "3GP Video",
}
TYPE_LABELS = {
    "docx": "Word Document", "doc": "Word Document", "xlsx": "Excel Spreadsheet", "xls": "Excel Spreadsheet",
    "pptx": "PowerPoint Presentation", "ppt": "PowerPoint Presentation", "pdf": "PDF Document", "jpg": "JPEG Image",
    "jpeg": "JPEG Image", "png": "PNG Image", "gif": "GIF Image", "txt": "Plain Text", "md": "Markdown",
    "json": "JSON File", "xml": "XML File", "zip": "ZIP Archive", "rar": "RAR Archive",
}
OFFICE_NAMES = {
    "doc": "Microsoft Word 97-2003 文档", "docx": "Microsoft Word 文档", "xls": "Microsoft Excel 97-2003 工作簿",
    "xlsx": "Microsoft Excel 工作簿", "csv": "逗号分隔值文件", "ppt": "Microsoft PowerPoint 97-2003 演示文稿",
    "pptx": "Microsoft PowerPoint 演示文稿",
}
PLAYABLE = ["mp4", "webm", "flv", "mp3", "wav"]

# Encodings tried in order after the byte-order marks.
ENCODINGS = ["utf-8", "gbk", "gb18030", "gb2312", "big5", "shift_jis", "euc-jp", "euc-kr", "utf-16le", "utf-16be"]

# The standard PDF fonts.
STANDARD_FONTS = [
    "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Times-Roman", "Times-Bold",
    "Times-Italic", "Times-BoldItalic", "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique",
    "Symbol", "ZapfDingbats",
]

SIZE_LIMIT = 100 * 1024 * 1024
SIZE_WARNING = 10 * 1024 * 1024


def lookup(key: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """Constant-time literal map lookup (the mapping is a fixed table, so no join is needed)."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


#: A parser takes ``files(path, length, content, ...)`` of one type and gives rows with ``path``; rows whose ``error``
#: column is not null become error rows.
Parser = Callable[[DataFrame], DataFrame]


class FormatRegistry:
    """Extension rows, signatures, families, and the parser of each type; extend it without touching the operators."""

    def __init__(self, parsers: dict[str, Parser] | None = None) -> None:
        self._category = {ext: cat for cat, exts in CATEGORIES.items() for ext in exts}
        self._category.update({ext: "code" for ext in CODE_LANGUAGES if ext not in self._category})
        self._family: dict[str, str] = {}
        for family, extensions in ROUTES:
            for ext in extensions:
                self._family.setdefault(ext, family)
        self.magic = list(MAGIC)
        self.parsers: dict[str, Parser] = {}
        for ext, parser in (parsers or {}).items():
            self.register_parser(ext, parser)

    def register_format(self, ext: str, category: str, parser: Parser | None = None, magic: str | None = None) -> None:
        """Add a type; ``magic`` (leading bytes in hex) tells files without a known extension."""
        ext = ext.lower()
        self._category[ext] = category
        self._family.setdefault(ext, category)
        if magic is not None:
            self.magic.insert(0, (ext, magic.upper()))
        if parser is not None:
            self.parsers[ext] = parser

    def register_parser(self, ext: str, parser: Parser) -> None:
        """Attach a parser to a supported type; unsupported types are refused."""
        if not self.is_supported(ext):
            raise ValueError(f"unsupported type: {ext}")
        self.parsers[ext] = parser

    def register_parsers(self, parsers: dict[str, Parser]) -> None:
        for ext, parser in parsers.items():
            self.register_parser(ext, parser)

    def unregister(self, ext: str) -> None:
        self.parsers.pop(ext, None)

    def is_registered(self, ext: str) -> bool:
        return ext in self.parsers

    def is_supported(self, ext: str) -> bool:
        return ext in self._category or ext in {name for name, _ in self.magic}

    def registered_types(self) -> list[str]:
        return sorted(self.parsers)

    def extensions(self) -> list[str]:
        """Extensions that detection by name knows; code languages are opened as text, not detected."""
        return [ext for ext, category in self._category.items() if category != "code"]

    def families(self) -> dict[str, str]:
        return dict(self._family)

    def frame(self, spark: SparkSession) -> DataFrame:
        """``format_registry(ext, category)``: a few dozen rows, bounded by this object's own literals."""
        return spark.createDataFrame(sorted(self._category.items()), "ext STRING, category STRING")


def routes(spark: SparkSession) -> DataFrame:
    """``(ext, family)``, one row per extension: the first family that accepts it."""
    rows: dict[str, str] = {}
    for family, exts in ROUTES:
        for ext in exts:
            rows.setdefault(ext, family)
    return spark.createDataFrame(sorted(rows.items()), "ext STRING, family STRING")


def accepted_routes(spark: SparkSession) -> DataFrame:
    """``(ext, family, priority)`` with every family that accepts an extension."""
    rows = [(ext, family, i) for i, (family, exts) in enumerate(ROUTES) for ext in exts]
    return spark.createDataFrame(rows, "ext STRING, family STRING, priority INT")
