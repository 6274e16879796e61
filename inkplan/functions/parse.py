"""Parsers of whole files: each takes a text and gives blocks, or raises Unconvertible.

A block is (type, level, lines, raw): lines for headings, paragraphs and list items, raw for finished Markdown.
"""

from __future__ import annotations

import json
import math
import re
from xml.parsers import expat

from .text import TRIM

Block = tuple[str, int, list[str] | None, str | None]


#: What users read of files that can't be converted.
EMPTY = {"csv": "The CSV file is empty.", "json": "The JSON file is empty.", "xml": "The XML file is empty.", "html": "No text could be extracted from the HTML document."}
INVALID_JSON = "Invalid JSON"
INVALID_XML = "Invalid XML"


class Unconvertible(Exception):
    """kind: corrupt, encrypted, noText or unsupported."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def _raw(text: str) -> Block:
    return ("raw", 0, None, text)


# --- CSV

_PLAIN = re.compile(r'[^",\r\n]+')


def csv_rows(text: str) -> list[list[str]]:
    """Rows with a non-blank cell. Quotes may open anywhere; carriage returns count inside quotes only."""
    rows: list[list[str]] = []
    row: list[str] = []
    field: list[str] = []
    at, end = 0, len(text)

    def finish() -> None:
        nonlocal row, field
        row.append("".join(field))
        if any(c.strip(TRIM) for c in row):
            rows.append(row)
        row, field = [], []

    while at < end:
        c = text[at]
        if c == '"':
            close = at + 1
            while True:
                stop = text.find('"', close)
                if stop < 0:
                    field.append(text[close:])
                    at = end
                    break
                field.append(text[close:stop])
                if text[stop + 1 : stop + 2] != '"':
                    at = stop + 1
                    break
                field.append('"')
                close = stop + 2
            continue
        if c == ",":
            row.append("".join(field))
            field = []
        elif c == "\n":
            finish()
        elif c != "\r":
            m = _PLAIN.match(text, at)
            field.append(m[0])
            at = m.end()
            continue
        at += 1
    if row or any(field):
        finish()
    return rows


def csv_blocks(text: str) -> tuple[list[Block], int]:
    rows = csv_rows(text)
    if not rows:
        raise Unconvertible("noText", EMPTY["csv"])
    line = lambda cells: f"| {' | '.join(cells)} |"
    cells = [line([c.replace("|", "\\|").replace("\n", " ") for c in r]) for r in rows]
    cells.insert(1, line(["---"] * len(rows[0])))
    return [_raw("\n".join(cells).rstrip(TRIM))], len(rows)


# --- JSON

_LONE = re.compile("[\ud800-\udfff]")


def _number(x: float) -> str:
    """The shortest digits that give x, with a fraction or, from 1e21 and below 1e-6, an exponent."""
    if not math.isfinite(x):
        raise Unconvertible("corrupt", f"{INVALID_JSON}: a number is out of range")
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        s = repr(x)
        if "e" in s:
            digits, power = s.split("e")
            sign = "-" if digits[0] == "-" else ""
            whole, _, part = digits.lstrip("-").partition(".")
            all_, point = whole + part, len(whole) + int(power)
            s = sign + (f"0.{'0' * -point}{all_}" if point <= 0 else f"{all_.ljust(point, '0')[:point]}.{all_[point:] or '0'}")
        return s
    digits, _, power = repr(x).partition("e")
    if not power:  # below 1e-6 repr always has an exponent; from 1e21 on too
        digits, _, power = f"{x:e}".partition("e")
    return f"{digits.removesuffix('.0')}e{'-' if power[0] == '-' else '+'}{power.lstrip('+-').lstrip('0')}"


def _integer(s: str) -> int | float:
    n = int(s)
    return n if -(1 << 63) <= n < 1 << 63 else float(s)


_JSON_SPACE = re.compile(r"[ \t\n\r]*")
_JSON_WORD = re.compile("true|false|null")
_JSON_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")


def _refuse(name: str) -> None:
    raise ValueError(f"unexpected {name}")


def _pretty(v: object, pad: str) -> str:
    if isinstance(v, float):
        return _number(v)
    if isinstance(v, str):
        return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(v, ensure_ascii=False))
    deeper = f"{pad}  "
    if isinstance(v, list) and v:
        return "[\n" + ",\n".join(deeper + _pretty(x, deeper) for x in v) + f"\n{pad}]"
    if isinstance(v, dict) and v:
        return "{\n" + ",\n".join(f"{deeper}{_pretty(k, deeper)}: {_pretty(x, deeper)}" for k, x in v.items()) + f"\n{pad}}}"
    return json.dumps(v)


def _pretty_deep(v: object) -> str:
    """As _pretty, for values of any depth."""
    out: list[str] = []
    todo: list[tuple[object, str, str, str]] = [(v, "", "", "")]  # value, its pad, and what stands before and after it
    while todo:
        v, pad, before, after = todo.pop()
        if not isinstance(v, (list, dict)) or not v:
            out.append(f"{before}{_pretty(v, pad)}{after}")
            continue
        opening, closing = "[]" if isinstance(v, list) else "{}"
        deeper = f"{pad}  "
        heads = [deeper] * len(v) if isinstance(v, list) else [f"{deeper}{_pretty(k, deeper)}: " for k in v]
        ends = [",\n"] * (len(v) - 1) + [f"\n{pad}{closing}{after}"]
        out.append(f"{before}{opening}\n")
        todo += reversed([(x, deeper, head, end) for x, head, end in zip(v if isinstance(v, list) else v.values(), heads, ends, strict=True)])
    return "".join(out)


def _loads_deep(text: str) -> object:
    """json.loads with this module's rules, for values of any depth: containers are kept on a stack."""
    at = 0
    stack: list[tuple[list | dict, str]] = []

    def space(at: int) -> int:
        return _JSON_SPACE.match(text, at).end()

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"a name in quotes is missing at {at}")
        name, at = json.decoder.scanstring(text, at + 1, True)
        at = space(at)
        if text[at : at + 1] != ":":
            raise ValueError(f"a colon is missing at {at}")
        return name, space(at + 1)

    name = ""
    at = space(at)
    while True:
        c = text[at : at + 1]
        if c in ("[", "{") and c:
            inner: list | dict = [] if c == "[" else {}
            at = space(at + 1)
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                stack.append((inner, name))
                if c == "{":
                    name, at = key(at)
                continue
            value, at = inner, at + 1
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        elif m := _JSON_WORD.match(text, at):
            value, at = {"true": True, "false": False, "null": None}[m[0]], m.end()
        elif m := _JSON_NUMBER.match(text, at):
            value, at = float(m[0]) if m[1] or m[2] else _integer(m[0]), m.end()
        else:
            raise ValueError(f"a value is missing at {at}")
        while True:  # a value is there: into its container, which may end with it
            at = space(at)
            if not stack:
                if at < len(text):
                    raise ValueError(f"more than one value at {at}")
                return value
            holder, outer = stack[-1]
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[name] = value
            c = text[at : at + 1]
            if c == ",":
                at = space(at + 1)
                if isinstance(holder, dict):
                    name, at = key(at)
                break
            if c != ("]" if isinstance(holder, list) else "}"):
                raise ValueError(f"a comma or an end is missing at {at}")
            stack.pop()
            value, name, at = holder, outer, at + 1


def _pretty_json(text: str) -> str:
    try:
        return _pretty(json.loads(text, parse_int=_integer, parse_constant=_refuse), "")
    except RecursionError:  # nested too deep for functions that call themselves
        return _pretty_deep(_loads_deep(text))


def json_blocks(text: str) -> tuple[list[Block], int]:
    text = text.strip(TRIM)
    if not text:
        raise Unconvertible("noText", EMPTY["json"])
    try:
        pretty = _pretty_json(text)
    except ValueError as e:
        raise Unconvertible("corrupt", f"{INVALID_JSON}: {e}") from None
    return [_raw(f"```json\n{pretty}\n```")], 1


# --- XML


class _Element:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: list[str]):
        self.name, self.attrs = name.rpartition(":")[2], [(k.rpartition(":")[2], v) for k, v in zip(attrs[::2], attrs[1::2], strict=True)]
        self.children: list[_Element | str | None] = []  # None: a comment, instruction or CDATA section


def xml_root(text: str) -> _Element:
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes = parser.buffer_text = True
    top = _Element("", [])
    stack, cdata = [top], False

    def start(name: str, attrs: list[str]) -> None:
        stack.append(_Element(name, attrs))
        stack[-2].children.append(stack[-1])

    def data(s: str) -> None:
        if not cdata:
            stack[-1].children.append(s)

    def section(opens: bool) -> None:
        nonlocal cdata
        cdata = opens
        if opens:
            stack[-1].children.append(None)

    def entity(*_: object) -> None:
        raise Unconvertible("corrupt", f"{INVALID_XML}: entities are not expanded")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), data
    parser.CommentHandler = lambda _: stack[-1].children.append(None)
    parser.ProcessingInstructionHandler = lambda *_: stack[-1].children.append(None)
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: section(True), lambda: section(False)
    parser.EntityDeclHandler = entity
    try:
        parser.Parse(text.encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, UnicodeError) as e:
        raise Unconvertible("corrupt", f"{INVALID_XML}: {e}") from None
    return next(c for c in top.children if isinstance(c, _Element))


def xml_pretty(root: _Element) -> str:
    """One line for an element with text (its text only) or without anything; attributes and local names only."""
    out: list[str] = []
    todo: list[_Element | str] = [root]
    depth = [0]
    while todo:
        e, d = todo.pop(), depth.pop()
        pad = "  " * d
        if isinstance(e, str):
            out.append(pad + e)
            continue
        attrs = "".join(f' {k}="{v}"' for k, v in e.attrs)
        texts = [c.strip(TRIM) for c in e.children if isinstance(c, str)]
        if not e.children and not e.attrs:
            out.append(f"{pad}<{e.name}/>")
        elif any(texts):
            out.append(f"{pad}<{e.name}{attrs}>{' '.join(texts).strip(TRIM)}</{e.name}>")
        else:
            out.append(f"{pad}<{e.name}{attrs}>")
            inner = [c for c in e.children if isinstance(c, _Element)]
            todo += [f"</{e.name}>", *reversed(inner)]
            depth += [d, *[d + 1] * len(inner)]
    return "\n".join(out)


def xml_blocks(text: str) -> tuple[list[Block], int]:
    text = text.strip(TRIM)
    if not text:
        raise Unconvertible("noText", EMPTY["xml"])
    body = xml_pretty(xml_root(text)).rstrip(TRIM)
    return [_raw(f'```xml\n<?xml version="1.0" encoding="UTF-8"?>\n{body}\n```')], 1
