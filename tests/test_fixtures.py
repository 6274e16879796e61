"""Operators on small inputs with known results."""

import base64
import io
import json
import re
import time
import zipfile
import zlib
from hashlib import md5

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkplan.config import LayoutConfig
from inkplan.functions import parse, parse_html, pdf_crypt, pdf_objects, pdf_text
from inkplan.functions import text as tx
from inkplan.functions.html_tree import parse as parse_tree
from inkplan.operators import detect, evaluate, extract, extract_text, jobs, layout, preview, render, sinks
from inkplan.plans.convert import convert, convert_again
from inkplan.plans.run import Run
from inkplan.sources import files, pdf, synth

SPAN = "doc_id long, page int, seq int, text string, x_left double, x_right double, y_bottom double, y_top double, font_size double"
BLOCK = "doc_id long, page int, block_no int, type string, level int, lines array<string>, raw string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- formats


@pytest.mark.parametrize(
    ("name", "content", "want"),
    [
        ("scan", b"%PDF-2.0 more", "pdf"), ("m.docx", b"PK\x03\x04", "docx"), ("m.zip", b"PK\x03\x04..word/styles", "docx"), ("m", b"PK\x03\x04xl/sheet", "xlsx"), ("m", b"PK\x03\x04..ppt/slide", "pptx"),
        ("m", b"PK\x03\x04mimetype", "epub"), ("m.zip", b"PK\x03\x04zz", "zip"), ("m", b"\xff\xd8\x00", "image"), ("m", b"\x89PNGx", "image"), ("m", b"ID3\x04", "audio"),
        ("m.wav", b"RIFF....", "image"), ("m", b"\t\r\n {}", "json"), ("m.txt", b" [1]", "json"), ("m", b"<?XML ", "xml"), ("m", b"<!doctype HTML >", "html"), ("m", b" <html lang=x>", "html"), ("m.htm", b"<div>", "html"),
        ("m", b"<div>", "xml"), ("m.txt", b"u", "text"), ("m.md", b"u", "markdown"), ("m.Markdown", b"u", "markdown"), ("m.csv", b"1;2", "csv"), ("m.json", b"u", "json"), ("m.xml", b"u", "xml"),
        ("m.html", b"u", "html"), ("m.htm", b" ", "html"), ("m.dat", b"u", "unknown"), ("https://a.example/clip", b"%PDF", "unknown"), ("WWW.b.example", b"{", "unknown"), (None, None, "unknown"), (" .json", b" " * 70_000 + b"<", "json"),
    ],
)
def test_formats(spark, name, content, want):
    df = spark.createDataFrame([(name, bytearray(content) if content is not None else None)], "n string, c binary")
    assert df.select(detect.detect_format(F.col("n"), F.col("c"))).first()[0] == want


def test_names_and_urls(spark):
    assert one(spark, detect.is_url_name(F.lit("HTTP://c.example"))) and not one(spark, detect.is_url_name(F.lit("http.pdf")))
    assert [one(spark, tx.output_name(F.lit(n))) for n in ("r 1.pdf", "noext", "x.y.z")] == ["r 1.md", "noext", "x.y.md"]
    assert one(spark, detect.label(F.lit("csv"))) == "CSV" and one(spark, detect.is_supported(F.lit("zip"))) is False
    dropped = spark.createDataFrame([("file:///a/b%20c.pdf",), ("https://x/y.pdf",), ("/d/www.e.pdf",)], "uri string")
    assert [tuple(r) for r in files.accept_dropped(dropped).collect()] == [("/a/b c.pdf", "b c.pdf")]


def test_scan_decode_dedupe(spark, tmp_path):
    for name, data in (("a.txt", b"\xef\xbb\xbfmarked"), ("b.csv", b"\xe9,1"), ("c.bin", b"x"), ("d.html", b"<p>\xe9")):
        (tmp_path / name).write_bytes(data)
    inputs = files.scan(spark, str(tmp_path))
    got = {r["name"]: r["text"] for r in files.decoded(inputs).collect()}
    assert got == {"a.txt": "marked", "b.csv": "é,1", "d.html": "<p>é"}
    assert {r["name"]: r["text"] for r in files.decoded(inputs, strict=True).collect()}["d.html"] is None
    rows = spark.createDataFrame([(1, "/x/a", "a", 3), (2, "/x/a", "a", 4), (3, None, "a", 3), (4, None, "a", 3)], "seq int, path string, name string, size_bytes long")
    assert sorted(r["seq"] for r in files.dedupe(rows).collect()) == [1, 3]
    assert files.headers(inputs).count() == 3


# --- layout


def spans(spark, rows):
    return spark.createDataFrame([(0, 0, k, t, x, x + 6.0 * len(t), y - h, y, h) for k, (t, x, y, h) in enumerate(rows)], SPAN)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("sleep", 50.0, 300.0, 10.0), ("Big ", 0.0, 300.0, 10.0), ("dogs ", 25.0, 300.0, 10.0)], ["Big dogs sleep"]),
        ([("lower", 3.0, 210.0, 9.0), ("upper", 3.0, 230.0, 9.0)], ["upper", "lower"]),
        ([("p", 0.0, 80.0, 10.0), ("q", 30.0, 79.2, 10.0), ("r", 60.0, 78.6, 10.0)], ["pqr"]),
        ([("1", 0.0, 500.0, 20.0), ("2", 12.0, 500.0, 20.0), ("3", 0.0, 450.0, 9.0), ("4", 9.0, 450.0, 9.0), ("5", 4.0, 430.0, 9.0)], ["12", "34", "5"]),
    ],
)
def test_lines(spark, rows, want):
    got = layout.group_lines(spans(spark, rows)).orderBy("line_no").collect()
    assert [r["text"] for r in got] == want


def lines(spark, rows):
    return spark.createDataFrame([(0, 0, k, t, x, top, top - h, h) for k, (t, x, top, h) in enumerate(rows)], "doc_id long, page int, line_no int, text string, first_x double, y_top double, y_bottom double, font_size double")


def numbered(spark, rows, body=10.0):
    stats = spark.createDataFrame([(0, body)], "doc_id long, body_font_size double")
    return layout.paragraph_numbers(layout.mark_headings(lines(spark, rows), stats))


@pytest.mark.parametrize(
    ("tops", "want"),
    [
        ([(400, 10), (388, 10), (376, 10), (364, 10)], [0, 0, 0, 0]),
        ([(400, 10), (388, 10), (376, 10), (340, 10), (328, 10)], [0, 0, 0, 1, 1]),
        ([(400, 10), (385, 16), (365, 10)], [0, 1, 2]),
        ([(400, 10)], [0]),
    ],
)
def test_paragraphs(spark, tops, want):
    rows = [("t", 0.0, float(t), float(h)) for t, h in tops]
    assert [r["para_no"] for r in numbered(spark, rows).orderBy("line_no").collect()] == want


def test_indent_starts_a_paragraph(spark):
    rows = [("a", 5.0, 90.0, 10.0), ("b", 11.0, 78.0, 10.0), ("c", 11.0, 66.0, 10.0)]
    assert [r["para_no"] for r in numbered(spark, rows).orderBy("line_no").collect()] == [0, 1, 1]


def pages(spark, heights):
    return spark.createDataFrame([(0, k, len(h), [float(x) for x in h]) for k, h in enumerate(heights)], "doc_id long, page int, char_count int, line_heights array<double>")


@pytest.mark.parametrize(
    ("heights", "want"),
    [
        ([[10] * 30 + [20] * 4, [10] * 25 + [14] * 9], (10.0, 2, 0, False)),
        ([[]] * 39 + [[9, 9, 9]], (9.0, 40, 39, True)),
        ([[]] * 3 + [[9, 11, 11]] * 7, (11.0, 10, 3, False)),
        ([[]] * 3, (0.0, 3, 3, True)),
        ([[9.8] * 7 + [10.1] * 6 + [10.2] * 5 + [30] * 8], (10.0, 1, 0, False)),
    ],
)
def test_document_stats(spark, heights, want):
    assert tuple(layout.doc_stats(pages(spark, heights)).first())[1:] == want


@pytest.mark.parametrize(
    ("paragraphs", "body", "want"),
    [
        ([[("On Bees", 20)], [("They fly.", 10)]], 10, [("heading", 1, ["On Bees"]), ("paragraph", 0, ["They fly."])]),
        ([[("Part", 16), (" Two", 16)]], 10, [("heading", 1, ["Part Two"])]),
        ([[("• oats", 10)], [("- rye", 10)], [("* wheat", 10)], [("Grain", 10)]], 10, [("listItem", 0, ["oats"]), ("listItem", 0, ["rye"]), ("listItem", 0, ["wheat"]), ("paragraph", 0, ["Grain"])]),
        ([[("▪ red", 10), ("▪ blue", 10)]], 10, [("listItem", 0, ["red"]), ("listItem", 0, ["blue"])]),
        ([[("· wide", 10), ("and deep", 10)]], 10, [("listItem", 0, ["wide", "and deep"])]),
        ([[("Huge", 50)]], 0, [("paragraph", 0, ["Huge"])]),
        ([[("Slightly larger", 11)]], 10, [("paragraph", 0, ["Slightly larger"])]),
        ([[("over there", 10)]], 10, [("listItem", 0, ["ver there"])]),
    ],
)
def test_classification(spark, paragraphs, body, want):
    rows, k = [], 0
    for p, para in enumerate(paragraphs):
        for t, h in para:
            rows.append((0, 0, k, p, t, body > 0 and h >= body * 1.2))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, page int, line_no int, para_no int, text string, is_heading boolean")
    assert [(r["type"], r["level"], r["lines"]) for r in layout.classify(df).orderBy("block_no").collect()] == want


def test_strict_bullets(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, "over there", False)], "doc_id long, page int, line_no int, para_no int, text string, is_heading boolean")
    assert layout.classify(df, LayoutConfig(strict_bullets=True)).first()["type"] == "paragraph"


# --- rendering


@pytest.mark.parametrize(
    ("blocks", "want"),
    [
        ([("heading", 1, "Bees"), ("listItem", 0, "wax"), ("paragraph", 0, "They hum.")], "# Bees\n\n- wax\n\nThey hum.\n"),
        ([("heading", 4, "Deep")], "#### Deep\n"),
        ([("paragraph", 0, t) for t in ("#1 in sales", "+5 degrees", "10. May", "> so", "`x` = y")], "\\#1 in sales\n\n\\+5 degrees\n\n\\10. May\n\n\\> so\n\n\\`x\\` = y\n"),
        ([("paragraph", 0, t) for t in ("u", "v")], "u\n\nv\n"),
        ([("raw", 0, "| `q` |\n"), ("raw", 0, "# w")], "| `q` |\n\n# w\n"),
    ],
)
def test_rendering(spark, blocks, want):
    rows = [(0, 0, k, t, level, None if t == "raw" else [x], x if t == "raw" else None) for k, (t, level, x) in enumerate(blocks)]
    assert render.render_documents(spark.createDataFrame(rows[::-1], BLOCK)).first()["markdown"] == want


# --- extractors


def markdown(spark, fmt, text):
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    blocks = extract_text.text_blocks(docs) if fmt == "text" else extract.parsed_blocks(docs, fmt)
    row = render.render_documents(blocks).first()
    return row["markdown"] if row else None


def test_text(spark):
    text = "Rain fell.\n\nThen it stopped,\nall at once."
    assert markdown(spark, "text", text) == text + "\n"
    assert markdown(spark, "text", "## Log\n\nRun `make` twice.") == "## Log\n\nRun `make` twice.\n"
    assert markdown(spark, "text", "   \n  ") is None and markdown(spark, "text", None) is None
    assert markdown(spark, "text", "a\r\n \u00a0\r\n\u2003b") == "a\n\nb\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("city,pop\nOslo,7\nLima,10", "| city | pop |\n| --- | --- |\n| Oslo | 7 |\n| Lima | 10 |\n"),
        ('k,v\n"1,5",w', "| k | v |\n| --- | --- |\n| 1,5 | w |\n"),
        ("k,v\r\n7,8\r\n\r\n9,0", "| k | v |\n| --- | --- |\n| 7 | 8 |\n| 9 | 0 |\n"),
        ('a"b""c"d,"e\nf|"\n , \nx', "| ab\"cd | e f\\| |\n| --- | --- |\n| x |\n"),
    ],
)
def test_csv(spark, text, want):
    assert markdown(spark, "csv", text) == want


def outcome(spark, fmt, text):
    r = extract.parsed_outcomes(spark.createDataFrame([(0, text)], "doc_id long, text string"), fmt).first()
    return r["error_type"]


def test_errors(spark):
    assert outcome(spark, "csv", "") == "noText" and outcome(spark, "json", "{oops") == "corrupt" and outcome(spark, "json", " ") == "noText"
    assert outcome(spark, "json", "[NaN]") == "corrupt" and outcome(spark, "json", "[1e999]") == "corrupt" and outcome(spark, "json", "[" * 100_000) == "corrupt" and outcome(spark, "json", "[" * 2_000 + "]" * 2_000) is None
    assert outcome(spark, "xml", "<m><n></m>") == "corrupt" and outcome(spark, "xml", "") == "noText" and outcome(spark, "html", "<div> </div>") == "noText" and outcome(spark, "html", "<div>" * 20_000 + "deep") is None
    assert outcome(spark, "xml", '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>') == "corrupt" and outcome(spark, "html", None) == "corrupt" and outcome(spark, "json", "[1]") is None


def test_json():
    raw = parse.json_blocks('{"z":5,"y":[true,{"x":null}],"z":[],"w":{}}')[0][0][3]
    assert raw == '```json\n{\n  "z": [],\n  "y": [\n    true,\n    {\n      "x": null\n    }\n  ],\n  "w": {}\n}\n```'
    numbers = {"1e16": "10000000000000000.0", "1.5": "1.5", "-0.0": "-0.0", "1e21": "1e+21", "1.25e-7": "1.25e-7", "0.000001": "0.000001", "12345678901234567890": "12345678901234567000.0", "1e300": "1e+300", "0.1": "0.1"}
    for given, want in numbers.items():
        assert parse.json_blocks(given)[0][0][3] == f"```json\n{want}\n```"
    assert parse.json_blocks('"\\ud800é\\u0001"')[0][0][3] == '```json\n"\\ud800é\\u0001"\n```'


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4)), st.integers(0, 2))
def test_deep_json_is_as_other_json(value, indent):
    text = json.dumps(value, indent=indent or None)
    loaded = json.loads(text, parse_int=parse._integer)
    assert parse._loads_deep(text) == loaded and parse._pretty_deep(loaded) == parse._pretty(loaded, "")
    for bad in (text[:-1] + "]", text + ",", "{" + text, text[:-1]):
        try:
            json.loads(bad)
        except ValueError:
            with pytest.raises(ValueError):
                parse._loads_deep(bad)


def test_deep_html():
    began = time.perf_counter()
    blocks, _ = parse_html.html_blocks("<div>" * 20_000 + "<p>" + "<i>" * 3 + "x" + "</div>" * 20_000 + "<table>" + "<tr><td>" * 2 + "</table>")
    assert blocks[0] == ("paragraph", 0, ["___x___"], None) and time.perf_counter() - began < 10


def test_xml():
    raw = parse.xml_blocks("<m><n>7</n><o><p>8</p></o></m>")[0][0][3]
    assert raw == '```xml\n<?xml version="1.0" encoding="UTF-8"?>\n<m>\n  <n>7</n>\n  <o>\n    <p>8</p>\n  </o>\n</m>\n```'
    raw = parse.xml_blocks('<x:a xmlns:x="u" x:k="1"><b/><c d="2"/><e> t <f>lost</f> u </e><g><![CDATA[h]]></g><i><!-- j --></i></x:a>')[0][0][3]
    assert raw.split("\n")[2:-1] == ['<a x="u" k="1">', "  <b/>", '  <c d="2">', "  </c>", "  <e>t u</e>", "  <g>", "  </g>", "  <i>", "  </i>", "</a>"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<h2>Tea</h2><p>Pour <b>hot</b> water.</p><ol><li>wait</li><li>drink</li></ol>", "## Tea\n\nPour **hot** water.\n\n- wait\n\n- drink\n"),
        ("<table><tr><th>no</th><th>of</th></tr><tr><td>5</td><td>6|7</td></tr></table>", "| no | of |\n| --- | --- |\n| 5 | 6\\|7 |\n"),
        ('<p>Read <a href="/faq">this</a> first</p>', "Read this (/faq) first\n"),
        ("only words", "only words\n"),
        ("<div>lost<p><code>x</code></p></div><pre>a\n b</pre><blockquote>q <i>r</i></blockquote>", "\\`x\\`\n\n```\na\n b\n```\n\n> q _r_\n"),
        ("<p><b>T.<br><p>u</p><footer>&copy; v</footer>", "\\**T.**\n\n**u**\n\n© v\n".replace("**u**", "\\**u**")),
        ("<h3></h3><p></p><span>own<p>lost</p></span><script>s</script>", "### \n\n\n\nown\n\ns\n"),
    ],
)
def test_html(spark, text, want):
    assert markdown(spark, "html", text) == want


def outline(node):
    return "".join(c if isinstance(c, str) else f"<{c.tag}>{outline(c)}</{c.tag}>" for c in node.children)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
        ("<b>1<i>2</b>3</i>", "<b>1<i>2</i></b><i>3</i>"), ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"), ("<a>1<a>2", "<a>1</a><a>2</a>"),
        ("<table><td>1<tr><td>2</table>3", "<table><tbody><tr><td>1</td></tr><tr><td>2</td></tr></tbody></table>3"), ("<table>x<tr><td>1</table>", "x<table><tbody><tr><td>1</td></tr></tbody></table>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"), ("a</p>b", "a<p></p>b"), ("x</br>y", "x<br></br>y"), ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
        ("<title>t</title><p>x", "<p>x</p>"), ("<html><head><script>if(a<b)</script></head><body>y", "y"),
    ],
)
def test_html_trees(text, want):
    assert outline(parse_tree(text)) == want


# --- preview


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# H\ntext\n```json\n{\n# no\n```\ntrailing\n", (1, 2, 0, 0)), ("| a |\n| --- |\n| 1 |\n| 2 |", (0, 0, 0, 4)), ("```\nx\n```\n# H\n```\ny\n```", (1, 0, 0, 0)),
        ("a\nb\n\nc\n- d\n* e\nf", (0, 3, 2, 0)), ("", (0, 0, 0, 0)), (None, (0, 0, 0, 0)),
    ],
)
def test_stats(spark, text, want):
    assert tuple(preview.md_stats(spark.createDataFrame([(0, text)], "doc_id long, markdown string")).first())[1:] == want


def test_preview(spark):
    cut = lambda s, n: one(spark, tx.preview(F.lit(s), n))
    assert cut("## A\n\nb c\n", 40) == "## A\n\nb c\n"
    long = cut("a line of text\n" * 900, 5000)
    assert long.endswith("\n") and len(long) % 15 == 0 and 4980 < len(long) <= 5001
    assert cut("z" * 90, 30) == "z" * 30 and cut("\n" + "x" * 20, 10) == "\n" + "x" * 9


# --- jobs, evaluation, generated documents


def test_convert(spark):
    data = [
        (1, "a.txt", b"Ebb.\n\nFlow."), (2, "b.csv", b"k,v\n7,8"), (3, "c.json", b"{oops"), (4, "d.docx", b"PK\x03\x04"), (5, "e.html", b"<h2>T</h2>"),
        (6, "f.pdf", synth.pdf_of_items(synth.book_items(spark, 3, 2))), (7, "g.pdf", b"junk" * 99), (8, "h.pdf", pdf.write_pdf([[]]).replace(b"<< /Size", b"<< /Encrypt 9 0 R /Size")), (9, "i.pdf", pdf.write_pdf([[], []])), (10, "j.xml", b"<a/>"), (11, "k.txt", b""), (12, "l.md", b"# x"), (13, "m.txt", None), (14, "n.pdf", None),
    ]
    inputs = spark.createDataFrame([(i, n, bytearray(c) if c is not None else None) for i, n, c in data], "doc_id long, name string, content binary")
    inputs = inputs.withColumn("format", detect.detect_format(F.col("name"), F.col("content")))
    got = {r["doc_id"]: r for r in convert(inputs).collect()}
    assert {i: r["error_type"] for i, r in got.items() if r["status"] == "failed"} == {3: "corrupt", 4: "unsupported", 7: "corrupt", 8: "encrypted", 9: "noText", 13: "unsupported", 14: "unsupported"}
    assert got[2]["page_count"] == 2 and got[1]["content"] == "Ebb.\n\nFlow.\n" and got[5]["content"] == "## T\n" and got[11]["content"] == "" and got[12]["content"] == "# x\n"
    assert got[6]["page_count"] == 3 and got[6]["content"].startswith("# Chapter 1\n\nPage 0 paragraph one") and got[6]["output_name"] == "f.md"
    assert got[3]["error_message"].startswith("Invalid JSON") and got[7]["output_name"] == "g.md"
    assert got[6]["body_font_size"] == 11.5 and got[6]["failed_pages"] == []
    assert (got[13]["format"], got[14]["format"]) == ("text", "pdf")
    assert convert(inputs.limit(0)).count() == 0
    mended = inputs.withColumn("content", F.when(F.col("doc_id") == 3, F.lit(b"{}")).otherwise(F.col("content")))
    again = {r["doc_id"]: r for r in convert_again(convert(inputs), mended).collect()}
    assert len(again) == len(got) and again[3]["status"] == "done" and again[4]["status"] == "failed" and again[1] == got[1]


def test_convert_with_failed_pages_and_other_parsers(spark):
    def reader(data):
        return [[pdf.Span("First", 72.0, 700.0, 12.0)], None, [pdf.Span("three", 72.0, 700.0, 12.0)]]

    parsers = extract.PARSERS | {"docx": lambda text: ([("heading", 2, [text], None)], 1)}
    inputs = spark.createDataFrame([(1, "a.pdf", bytearray(b"%PDF"), "pdf"), (2, "b.docx", bytearray(b"x"), "docx")], "doc_id long, name string, content binary, format string")
    got = {r["doc_id"]: r for r in convert(inputs, pdf_reader=reader, parsers=parsers).collect()}
    assert (got[1]["status"], got[1]["page_count"], got[1]["failed_pages"], got[1]["content"]) == ("done", 3, [2], "First\n\nthree\n") and got[2]["content"] == "## x\n"


def test_pdf_reader(spark):
    page = [("The (odd) \\ end", 24.0, 72.0, 700.0), ("body", 12.0, 72.0, 660.0)]
    for compress in (False, True):
        got = pdf.read_pages(pdf.write_pdf([page, []], compress))
        assert [[(s.text, s.size, s.x, s.y) for s in p] for p in got] == [page, []]
    shown = list(pdf_text.shown(b"BT /F1 10 Tf 14 TL 1 0 0 1 5 50 Tm [(A) -500 (B\\051) 90 (C)] TJ T* <4344> Tj 3 -4 Td (E\\n) ' ET"))
    assert [(s.text, s.x, s.y) for s in shown] == [("A B)C", 5.0, 50.0), ("CD", 5.0, 36.0), ("E\n", 8.0, 18.0)]


def test_pdf_matrices_and_words():
    content = b"q 2 0 0 2 10 20 cm BT /F 10 Tf 1 0 0 1 5 50 Tm (left) Tj 40 0 Td (right) Tj ET Q BI /W 1 ID abc) EI BT 0 1 -1 0 100 100 Tm /F 10 Tf (up) Tj ET"
    a, b, up = pdf_text.shown(content)
    assert (a.text, a.x, a.y, a.size) == ("left ", 20.0, 120.0, 20.0) and (b.text, b.x) == ("right", 100.0)
    left, right, bottom, top = up.box()
    assert (left, right, bottom, top) == pytest.approx((100 - 7.33, 100 + 2.12, 100.0, 110.0))


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("packed", [False, True])
def test_pdf_files_of_all_kinds(compress, packed):
    page = [("Grüße (1)", 18.0, 72.0, 700.0), ("漢字 😀", 12.25, 72.0, 660.0625)]
    data = pdf.write_pdf([page, [], page], compress, True, packed, (750, -250), {2})
    assert pdf.page_count(data) == 3
    for file in (data, data[: data.rindex(b"startxref")], b"\n\n" + data):  # with cross references, without, and with wrong ones
        first, second, broken = pdf.read_pages(file)
        assert [(s.text, s.box()[2:]) for s in first] == [("Grüße (1)", (695.5, 713.5)), ("漢字 😀", (657.0, 669.25))] and second == [] and broken is None
    latin = pdf.write_pdf([[("Grüße – “ja”", 12.0, 0.0, 0.0)]], compress, False, packed)
    assert pdf.read_pages(latin)[0][0].text == "Grüße – “ja”"


def test_pdf_fonts_and_forms():
    """A font with differences and widths, a form, and contents behind several filters, written by hand."""
    form = b"BT /F 10 Tf 1 0 0 1 0 0 Tm (ab) Tj ET"
    content = base64.a85encode(zlib.compress(b"BT /F 10 Tf 1 0 0 1 50 60 Tm (a) Tj (b) Tj ET q 1 0 0 1 7 8 cm /X Do Q")) + b"~>"
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F 4 0 R>>/XObject<</X 6 0 R>>>>>>", b"<</Type/Page/Parent 2 0 R/Contents[5 0 R]>>",
        b"<</Type/Font/Subtype/Type1/Encoding<</Differences[97/eacute/uni6F22]>>/FirstChar 97/Widths[600 900]>>",
        b"<</Filter[/ASCII85Decode/FlateDecode]/Length %d>>stream\n%s\nendstream" % (len(content), content), b"<</Type/XObject/Subtype/Form/Matrix[2 0 0 2 0 0]/Length %d>>stream\n%s\nendstream" % (len(form), form),
    ]
    data = b"%PDF-1.3\n" + b"".join(b"%d 0 obj%s endobj\n" % (k, x) for k, x in enumerate(objects, 1))
    (spans,) = pdf.read_pages(data)
    assert [(s.text, s.x, s.y, s.size) for s in spans] == [("é", 50.0, 60.0, 10.0), ("漢", 56.0, 60.0, 10.0), ("é漢", 7.0, 8.0, 20.0)]
    assert spans[1].box()[1] == pytest.approx(65.0)


def test_pdf_predictors_and_lzw():
    rows = bytes([2, 1, 2, 3, 2, 1, 1, 1, 1, 5, 0, 0, 3, 2, 2, 2, 4, 1, 1, 1])
    got = pdf_objects._predicted(rows, {"Predictor": 12, "Columns": 3})
    assert got == bytes([1, 2, 3, 2, 3, 4, 5, 5, 5, 4, 6, 7, 5, 7, 8])
    assert pdf_objects._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1) == b"-----A---B"


def test_ciphers():
    """Published test vectors."""
    assert pdf_crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        aes = pdf_crypt.Aes(bytes(range(size)))
        assert aes.encrypt(block).hex() == want and aes.decrypt(aes.encrypt(block)) == block


@pytest.mark.parametrize("method", ["RC4-40", "RC4-128", "AESV2", "AESV3-5", "AESV3-6"])
@pytest.mark.parametrize("password", [b"", b"secret"])
def test_encrypted_pdf_files(method, password):
    """A file that opens without a password is read; one that needs a password is protected."""
    plain = pdf.write_pdf([[("hidden words", 12.0, 72.0, 700.0)]])
    numbers = {"RC4-40": (1, 2), "RC4-128": (2, 3), "AESV2": (4, 4), "AESV3-5": (5, 5), "AESV3-6": (5, 6)}
    version, revision = numbers[method]
    entries = {"V": version, "R": revision, "O": bytes(range(32)), "P": -44, "Length": 128}
    cfm = {4: "AESV2", 5: "AESV3"}.get(version)
    if version == 5:
        own = bytes(range(100, 132))
        entries["U"] = pdf_crypt._hash(password, b"check..." , revision) + b"check..." + b"keysalt."
        entries["UE"] = pdf_crypt.cbc_encrypted(pdf_crypt._hash(password, b"keysalt.", revision), bytes(16), own)
        key = own
    else:
        n = {1: 5, 2: 16, 4: 16}[version]
        key = md5((password + pdf_crypt.PADDING)[:32] + entries["O"] + (-44 & 0xFFFFFFFF).to_bytes(4, "little") + b"id").digest()
        for _ in range(50 if revision > 2 else 0):
            key = md5(key[:n]).digest()
        key = key[:n]
        if revision == 2:
            entries["U"] = pdf_crypt.rc4(key, pdf_crypt.PADDING)
        else:
            proof = md5(pdf_crypt.PADDING + b"id").digest()
            for k in range(20):
                proof = pdf_crypt.rc4(bytes(x ^ k for x in key), proof)
            entries["U"] = proof + bytes(16)
    content = plain[plain.index(b"stream\n") + 7 : plain.index(b"\nendstream")]
    number = int(re.findall(rb"(\d+) 0 obj\n<< /Length", plain)[0])
    if version == 5:
        packed = bytes(16) + pdf_crypt.cbc_encrypted(key, bytes(16), content + bytes([16 - len(content) % 16]) * (16 - len(content) % 16))
    else:
        own_key = md5(key + number.to_bytes(3, "little") + bytes(2) + (b"sAlT" if version == 4 else b"")).digest()[: min(16, len(key) + 5)]
        filled = content + bytes([16 - len(content) % 16]) * (16 - len(content) % 16)
        packed = bytes(16) + pdf_crypt.cbc_encrypted(own_key, bytes(16), filled) if version == 4 else pdf_crypt.rc4(own_key, content)
    data = plain.replace(b"/Length %d>>" % len(content), b"/Length %d>>" % len(packed)).replace(b"/Length %d >>" % len(content), b"/Length %d >>" % len(packed)).replace(content, packed)
    written = b" ".join(b"/%s <%s>" % (k.encode(), v.hex().encode()) if isinstance(v, bytes) else b"/%s %d" % (k.encode(), v) for k, v in entries.items())
    filters = b" /CF << /StdCF << /CFM /%s >> >> /StmF /StdCF" % cfm.encode() if cfm else b""
    data = data.replace(b"<< /Size", b"<< /ID [<6964> <6964>] /Encrypt << /Filter /Standard %s%s >> /Size" % (written, filters))
    if password:
        with pytest.raises(parse.Unconvertible) as e:
            pdf.read_pages(data)
        assert e.value.kind == "encrypted"
    else:
        assert [s.text for s in pdf.read_pages(data)[0]] == ["hidden words"]


@pytest.mark.parametrize("data", [b"", b"%PDF-1.4", b"%PDF-1.4 1 0 obj << /Type /Catalog >> endobj", b"%PDF-1.4 1 0 obj " + b"[" * 5000, b"%PDF-1.7\nstartxref\n5\n%%EOF", b"PK"])
def test_damaged_pdf_files(data):
    for read in (pdf.read_pages, pdf.page_count):
        with pytest.raises(parse.Unconvertible) as e:
            read(data)
        assert e.value.kind == "corrupt"


def test_sinks(spark, tmp_path):
    rows = [(1, "a.md", "done", "x é"), (2, "a.md", "done", "y"), (3, "b.md", "failed", None), (4, "c.md", "done", "")]
    df = spark.createDataFrame(rows, "doc_id long, output_name string, status string, content string")
    got = {r["doc_id"]: r for r in sinks.write_files(df, f"file://{tmp_path}/out").collect()}
    assert sorted(got) == [1, 2, 4] and open(got[1]["path"], "rb").read() == "x é".encode()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1-a.md", "2-a.md", "4-c.md"]
    with zipfile.ZipFile(io.BytesIO(sinks.zip_bytes(df))) as z:
        assert {n: z.read(n).decode() for n in z.namelist()} == {"a.md": "y", "c.md": ""}


def test_job_states(spark):
    schema = "seq int, name string, status string, page int, total int, page_count int"
    state = lambda rows: jobs.status_summary(spark.createDataFrame(rows, schema)).first()
    assert state([])["state"] == "ready" and state([(1, "a", "queued", None, None, None)])["state"] == "loaded"
    running = state([(1, "a", "running", 5, 10, 3), (2, "b", "running", 1, 0, 3), (3, "c", "running", 20, 10, 3), (4, "d", "done", 1, 1, 1)])
    assert (running["state"], running["progress"], running["done"], running["completed"]) == ("processing", 0.75, 1, 4)
    assert state([(1, "a", "done", 1, 1, 1), (2, "b", "failed", 1, 1, 1)])["state"] == "done"
    warn = lambda rows: tuple(jobs.batch_warning(spark.createDataFrame(rows, schema)).first())[:2]
    assert warn([(k, "a", "done", 1, 1, 1) for k in range(11)]) == ("large_batch", None)
    assert warn([(2, "b", "done", 1, 1, 200), (1, "a", "done", 1, 1, 101), (0, "z", "done", 1, 1, 100)]) == ("large_file", "a") and warn([]) == (None, None)


def test_evaluation(spark):
    golden = "# Harvest\n\nPears   4\nPlums   9\nFigs    1\n\nAll sold."
    output = "# Harvest\n\nPears 4 Plums 9\n\nAll sold.\n"
    df = lambda t, n="with_tables.md": spark.createDataFrame([(n, t)], "name string, markdown string")
    r = evaluate.evaluate(df(output), df(golden)).first()
    assert r["paragraph_f1"] == pytest.approx(2 / 6) and r["heading_accuracy"] == 1 and r["list_recall"] == 1 and r["noise_blocks"] == 1 and not r["passed"]
    assert [x["text"] for x in evaluate.noise_blocks(df(output), df(golden)).collect()] == ["Pears 4 Plums 9"]
    r = evaluate.evaluate(df("\\# x\n- a", "b"), df("# x\n# y\n- a\n- a\np", "b")).first()
    assert (r["paragraph_f1"], r["heading_accuracy"], r["list_recall"]) == (0, 0.5, 1)
    assert evaluate.evaluate(df("", "b"), df("x", "b")).first()["paragraph_f1"] == 0 and evaluate.evaluate(df("a", "b"), df("a", "c")).count() == 0


def test_nearest_rank(spark):
    df = spark.range(120).select((F.col("id") % 6).alias("g"), F.floor(F.col("id") / 6).alias("v")).withColumn("v", F.when(F.col("g") < 5, F.col("v")))
    df = df.where("g > 0 or v < 1")
    assert {r["g"]: r["v"] for r in evaluate.nearest_rank(df, ["g"], "v").collect()} == {0: 0, 1: 19, 2: 19, 3: 19, 4: 19}
    assert [r["v"] for r in evaluate.nearest_rank(spark.createDataFrame([(1,)] * 18 + [(7,), (9,)], "v int"), [], "v", 0.9).collect()] == [7]


def test_runs(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a.txt").alias("name"), F.lit(b"x").alias("content"), F.lit("text").alias("format"))
    run = Run(spark, lambda: convert(rows).write.parquet(f"{tmp_path}/out"))
    assert run.status == "ready" and run.progress() == 0
    assert run.start().wait(120) == "done" and run.progress() == 1 and spark.read.parquet(f"{tmp_path}/out").count() == 100
    with pytest.raises(RuntimeError):
        run.start()
    run.cancel()
    assert run.status == "done"
    def asleep(batches):
        import time

        for batch in batches:
            time.sleep(0.5)
            yield batch

    slow = lambda: spark.range(64, numPartitions=64).mapInArrow(asleep, "id long").count()
    late = Run(spark, slow, timeout=2).start()
    assert late.wait(60) == "timedOut" and late.error is not None
    stopped = Run(spark, lambda: [slow(), slow()]).start()
    while stopped.progress() == 0 and stopped.status == "running":
        time.sleep(0.1)
    stopped.cancel()
    assert stopped.wait(60) == "cancelled" and 0 < stopped.progress() < 1
    failed = Run(spark, lambda: 1 / 0).start()
    assert failed.wait(60) == "failed" and isinstance(failed.error, ZeroDivisionError)
    assert spark.range(3).count() == 3


def test_streaming(spark, tmp_path):
    from inkplan.streaming.ingest import convert_arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n7,8")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    convert_arrivals(*args).awaitTermination(120)
    (tmp_path / "in" / "b.txt").write_text("hello")
    convert_arrivals(*args).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["name"], r["status"]) for r in got.collect()) == [("a.csv", "done"), ("b.txt", "done")]
