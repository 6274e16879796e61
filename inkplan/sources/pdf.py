"""PDF files as tables of text spans, and a writer of PDF files for tests and generators.

The reader is one of its own (see functions/pdf_objects.py and pdf_text.py); another function from a file's bytes to the
spans of its pages can take its place.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import Unconvertible
from ..functions.pdf_objects import Document
from ..functions.pdf_text import Span, page_spans

SPANS = "doc_id long, page int, seq int, text string, x_left double, x_right double, y_bottom double, y_top double, font_size double"
#: What a damaged file makes of a parser.
_DAMAGE = (zlib.error, ValueError, KeyError, IndexError, TypeError, AttributeError, OverflowError)
#: Files that one Arrow batch holds at most: a Python worker has a batch of them in its memory.
FILES_IN_BATCH = 64
#: Rows of a batch of spans that is sent on.
ROWS_OUT = 4_096


def page_count(data: bytes) -> int:
    """The number of pages, without reading any."""
    try:
        doc = Document(data)
        tree = doc.resolve(doc.resolve(doc.trailer.get("Root")).get("Pages"))
        count = doc.resolve(tree.get("Count"))
        return count if isinstance(count, int) and count > 0 else len(doc.pages())
    except _DAMAGE as e:
        raise Unconvertible("corrupt", "The PDF is damaged.") from e


def read_pages(data: bytes) -> list[list[Span] | None]:
    """The spans of each page, in the order in which they are drawn; None for a page that can't be read."""
    try:
        doc = Document(data)
        found = doc.pages()
    except _DAMAGE as e:
        raise Unconvertible("corrupt", "The PDF is damaged.") from e
    pages: list[list[Span] | None] = []
    for page in found:
        try:
            pages.append(page_spans(doc, page))
        except _DAMAGE:
            pages.append(None)
    if not pages:
        raise Unconvertible("corrupt", "The PDF has no pages.")
    return pages


Reader = Callable[[bytes], list[list[Span] | None]]


def few_files(df: DataFrame) -> DataFrame:
    """The same rows; from now on Arrow batches of its session hold FILES_IN_BATCH rows at most."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= FILES_IN_BATCH:
        conf.set(key, FILES_IN_BATCH)
    return df


def probe(inputs: DataFrame) -> DataFrame:
    """Of ``inputs(doc_id, content)``: doc_id, page_count, error_type, error_message; no page is read. Null content is corrupt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int | None, str | None, str | None]] = []
            for content in batch.column(1):
                try:
                    out.append((page_count(content.as_py() or b""), None, None))
                except Unconvertible as e:
                    out.append((None, e.kind, str(e)))
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "page_count", "error_type", "error_message"])

    return few_files(inputs).select(F.col("doc_id").cast("long"), "content").mapInArrow(run, "doc_id long, page_count int, error_type string, error_message string")


def line_heights(spans: list[Span]) -> list[float]:
    """The heights of the boxes of lines: spans that are drawn one after the other on one base line."""
    out: list[float] = []
    at: Span | None = None
    low = high = 0.0
    for s in spans:
        _, _, bottom, top = s.box()
        if at is not None and abs(s.y - at.y) < 0.3 * max(s.size, at.size):
            low, high = min(low, bottom), max(high, top)
        else:
            if at is not None:
                out.append(high - low)
            low, high = bottom, top
        at = s
    return [h for h in ([*out, high - low] if at is not None else []) if h > 0]


def scan_spans(inputs: DataFrame, reader: Reader = read_pages, keep: StorageLevel | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``inputs(doc_id, content[, name, format])``: spans, light_pages, and outcomes (doc_id, name, format, page_count,
    failed_pages, error_type, error_message), one for each row of inputs. Failed pages count from 1 and have neither spans nor text.

    With ``keep`` the rows that all three come from are cached.
    """
    schema = f"{SPANS}, char_count int, line_heights array<double>, name string, format string, page_count int, failed_pages array<int>, error_type string, error_message string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5, pa.int32(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string()]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (None,) * 6
        for batch in batches:
            out: list[tuple] = []
            for doc_id, content, name, fmt in zip(*batch.columns, strict=True):
                doc_id, name, fmt = doc_id.as_py(), name.as_py(), fmt.as_py()
                try:
                    pages = reader(content.as_py() or b"")
                    failed = [p + 1 for p, spans in enumerate(pages) if spans is None]
                    out.append((doc_id, None, None, *nothing, None, None, name, fmt, len(pages), failed, None, None))
                    for p, spans in enumerate(pages):
                        own = [(s, *s.box()) for s in spans or [] if s.text not in ("\n", "\r\n")]
                        heights = line_heights([s for s, *_ in own])
                        out.append((doc_id, p, None, *nothing, sum(len(s.text) for s in spans or []), heights, *nothing))
                        out += [(doc_id, p, k, s.text, left, right, bottom, top, top - bottom, *nothing, None, None) for k, (s, left, right, bottom, top) in enumerate(own)]
                        if len(out) >= ROWS_OUT:
                            yield made(out)
                            out = []
                except Unconvertible as e:
                    out.append((doc_id, None, None, *nothing, None, None, name, fmt, 0, [], e.kind, str(e)))
            if out:
                yield made(out)

    given = [F.col(c) if c in inputs.columns else F.lit(None).cast("string").alias(c) for c in ("name", "format")]
    rows = few_files(inputs).select(F.col("doc_id").cast("long"), "content", *given).mapInArrow(run, schema)
    if keep is not None:
        rows = rows.persist(keep)
    spans = rows.where("seq is not null").select(*[c.split()[0] for c in SPANS.split(", ")])
    pages = rows.where("page is not null and seq is null").select("doc_id", "page", "char_count", "line_heights")
    return spans, pages, rows.where("page_count is not null").select("doc_id", "name", "format", "page_count", "failed_pages", "error_type", "error_message")


def _number(v: float) -> bytes:
    return f"{v:.6f}".rstrip("0").rstrip(".").encode()


def write_pdf(
    pages: list[list[tuple[str, float, float, float]]], compress: bool = False, unicode: bool = False, object_streams: bool = False,
    metrics: tuple[int, int] | None = None, broken: Collection[int] = (),
) -> bytes:
    """A PDF of pages of (text, font size, x, y).

    With unicode, texts are codes of a font that has a map to Unicode, else Latin-1; with object_streams, objects and
    cross references are in compressed streams; metrics: the font's ascent and descent; broken: pages (from 0) whose
    content cannot be unpacked.
    """
    n = len(pages)
    font, contents = 3 + n, 6 + n
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (3 + k) for k in range(n)), n)}
    streams: dict[int, bytes] = {}

    def stream(number: int, data: bytes, entries: bytes = b"", pack: bool = compress) -> None:
        data, how = (zlib.compress(data, 1), b" /Filter /FlateDecode") if pack else (data, b"")
        streams[number] = b"<< /Length %d%s%s >>\nstream\n%s\nendstream" % (len(data), how, entries, data)

    used: set[int] = set()
    for k, page in enumerate(pages):
        objects[3 + k] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R /Resources << /Font << /F1 %d 0 R >> >> >>" % (contents + k, font)
        ops = []
        for text, size, x, y in page:
            if unicode:
                raw = text.encode("utf-16-be", "surrogatepass")
                used.update(struct.unpack(f">{len(raw) // 2}H", raw))
                shown = b"<%s>" % raw.hex().encode()
            else:
                shown = b"(%s)" % re.sub(r"([\\()])", r"\\\1", text).replace("\r", "\\r").encode("cp1252", "replace")
            ops.append(b"BT /F1 %s Tf 1 0 0 1 %s %s Tm %s Tj ET" % (_number(size), _number(x), _number(y), shown))
        if k in broken:
            streams[contents + k] = b"<< /Length 4 /Filter /FlateDecode >>\nstream\nxxxx\nendstream"
        else:
            stream(contents + k, b"\n".join(ops))
    described = b" /FontDescriptor %d 0 R" % (font + 1) if metrics else b""
    if metrics:
        objects[font + 1] = b"<< /Type /FontDescriptor /FontName /Helvetica /Flags 32 /Ascent %d /Descent %d >>" % metrics
    if unicode:
        lines = [b"<%04x> <%04x>" % (u, u) for u in sorted(used)]
        blocks = [b"%d beginbfchar\n%s\nendbfchar" % (len(b), b"\n".join(b)) for b in (lines[k : k + 100] for k in range(0, len(lines), 100))]
        stream(font + 2, b"/CMapName /Own def\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n%s\nendcmap" % b"\n".join(blocks))
        own = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /DW 500%s >>" % described
        objects[font] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [%s] /ToUnicode %d 0 R >>" % (own, font + 2)
    else:
        objects[font] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding%s >>" % described
    out, places = b"%PDF-1.5\n", {}
    if object_streams:
        holder, table = contents + n, contents + n + 1
        heads, bodies, at = [], [], 0
        for number, body in objects.items():
            heads.append(b"%d %d" % (number, at))
            bodies.append(body + b"\n")
            at += len(body) + 1
        head = b" ".join(heads) + b"\n"
        stream(holder, head + b"".join(bodies), b" /Type /ObjStm /N %d /First %d" % (len(objects), len(head)), True)
        for number, body in streams.items():
            places[number] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
        places[table] = len(out)
        inner = {number: i for i, number in enumerate(objects)}
        rows = []
        for k in range(table + 1):
            kind, x, y = (2, holder, inner[k]) if k in inner else (1, places[k], 0) if k in places else (0, 0, 0)
            rows.append(bytes([kind]) + x.to_bytes(4) + y.to_bytes(2))
        stream(table, b"".join(rows), b" /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R" % (table + 1), True)
        return out + b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (table, streams[table], places[table])
    for number, body in (objects | streams).items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    size = contents + n
    entries = b"".join(b"%010d 00000 n \n" % places[k] if k in places else b"0000000000 00000 f \n" for k in range(1, size))
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (size, entries, size, len(out))
