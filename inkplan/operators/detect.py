"""Format detection by content, then by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Detection needs no more of a file than this.
HEADER_BYTES = 65_536
SUPPORTED = ("pdf", "text", "markdown", "csv", "json", "xml", "html")
#: Extensions that a scan of files takes.
PICKED = ("pdf", "txt", "md", "markdown", "csv", "json", "xml", "html", "htm")
#: Formats by extension.
_EXTENSIONS = [
    ("pdf", ["pdf"]), ("text", ["txt"]), ("markdown", ["md", "markdown"]), ("csv", ["csv"]), ("json", ["json"]),
    ("xml", ["xml"]), ("html", ["html", "htm"]), ("docx", ["docx"]), ("xlsx", ["xlsx"]), ("pptx", ["pptx"]),
    ("epub", ["epub"]), ("zip", ["zip"]), ("image", ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff"]),
    ("audio", ["mp3", "flac", "ogg", "wav", "m4a", "aac"]),
]
_IMAGES = ("FFD8", "89504E47", "47494638", "52494646")
_SOUNDS = ("494433", "4F676753", "664C6143")
#: Inside a zip archive: format, extension, and what an entry's name has.
_PACKED = [("docx", ".docx", "word/"), ("xlsx", ".xlsx", "xl/"), ("pptx", ".pptx", "ppt/"), ("epub", ".epub", "mimetype")]
_WEB = ("http://", "https://", "www.")
LABELS = {
    "pdf": "PDF", "text": "TXT", "markdown": "MD", "csv": "CSV", "json": "JSON", "xml": "XML", "html": "HTML", "docx": "DOCX", "xlsx": "XLSX",
    "pptx": "PPTX", "epub": "EPUB", "zip": "ZIP", "image": "Image", "audio": "Audio", "unknown": "Unknown",
}


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def is_url_name(name: Column) -> Column:
    return _any([F.lower(name).startswith(p) for p in _WEB])


def is_supported(fmt: Column) -> Column:
    return fmt.isin(*SUPPORTED)


def label(fmt: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[fmt], F.lit("Unknown"))


def detect_format(name: Column, content: Column) -> Column:
    """The format of a file by its name and its content (or the content's first 65,536 bytes).

    A null name is an empty one, null content empty content.
    """
    name, content = F.coalesce(name, F.lit("")), F.coalesce(content, F.lit(b"").cast("binary"))
    lower = F.lower(name)
    magic = F.hex(F.substring(content, 1, 4))
    head = F.decode(F.substring(content, 1, HEADER_BYTES), "ISO-8859-1")
    first = F.substring(F.ltrim(head, F.lit(" \t\n\r")), 1, 1)
    start = F.lower(F.ltrim(F.substring(head, 1, 1024), F.lit("\t\n\x0b\x0c\r \x85\xa0")))
    by_extension = F.lit("unknown")
    for fmt, extensions in reversed(_EXTENSIONS):
        by_extension = F.when(_any([lower.endswith(f".{e}") for e in extensions]), fmt).otherwise(by_extension)
    packed = F.lit("zip")
    for fmt, extension, entry in reversed(_PACKED):
        packed = F.when(lower.endswith(extension) | head.contains(entry), fmt).otherwise(packed)
    markup = (
        F.when(start.startswith("<?xml"), "xml")
        .when(start.startswith("<!doctype html") | start.startswith("<html"), "html")
        .when(lower.endswith(".xml"), "xml")
        .when(lower.endswith(".html") | lower.endswith(".htm"), "html")
        .otherwise("xml")
    )
    return (
        F.when(is_url_name(name), "unknown")
        .when(magic == "25504446", "pdf")
        .when(_any([magic.startswith(m) for m in _IMAGES]), "image")
        .when(_any([magic.startswith(m) for m in _SOUNDS]), "audio")
        .when(magic == "504B0304", packed)
        .when(first.isin("{", "["), "json")
        .when(first == "<", markup)
        .otherwise(by_extension)
    )
