"""The text that a page of a PDF file shows, with its place on the page."""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html.entities import name2codepoint
from math import hypot

from .pdf_objects import Document, Lexer, Name, Stream, Word

#: Of fonts that don't tell: mean width of a glyph, and how far glyphs reach over and under the base line, as parts of the font size.
WIDTH = 0.5
ASCENT = 0.733
DESCENT = -0.212
#: A gap of more than this part of the font size parts words.
WORD_GAP = 0.2
#: Forms in forms, at most.
DEEPEST_FORM = 20

#: Names of glyphs that neither HTML's entities nor Unicode's names of digits have.
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
    "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|",
    "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„",
    "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›",
    "germandbls": "ß", "dotlessi": "ı", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "exclamdown": "¡", "questiondown": "¿", "Euro": "€", "section": "§", "minus": "−",
    "periodcentered": "·", "degree": "°", "trademark": "™", "nbspace": "\xa0",
}


def glyph_text(name: str) -> str:
    """What a glyph of that name stands for; nothing if that can't be told."""
    name = name.split(".")[0]
    if name in _GLYPHS or len(name) == 1:
        return _GLYPHS.get(name, name)
    if name in name2codepoint:
        return chr(name2codepoint[name])
    m = re.fullmatch(r"(?:uni([0-9A-F]{4})+|u([0-9A-F]{4,6}))", name)
    if m:
        digits = name[3:] if name.startswith("uni") else name[1:]
        codes = [digits] if m[2] else [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return "".join(chr(int(c, 16)) for c in codes if int(c, 16) < 0x110000)
    try:
        return unicodedata.lookup(f"DIGIT {name}")
    except KeyError:
        return ""


_HALVES = re.compile("[\ud800-\udfff]")


@dataclass
class Span:
    """A text, where its base line starts, and its font size; right, bottom and top of its box where they are known."""

    text: str
    x: float
    y: float
    size: float
    right: float | None = None
    bottom: float | None = None
    top: float | None = None

    def box(self) -> tuple[float, float, float, float]:
        """left, right, bottom, top."""
        right = self.x + WIDTH * self.size * len(self.text) if self.right is None else self.right
        return self.x, right, self.y + DESCENT * self.size if self.bottom is None else self.bottom, self.y + ASCENT * self.size if self.top is None else self.top


#: The rest of a block of single codes, if it is nothing but pairs of hexadecimal strings.
_CODES = re.compile(rb"(?:[\x00\t\n\x0c\r ]*<(?:[0-9A-Fa-f]{2})+>){2,}[\x00\t\n\x0c\r ]*endbfchar(?![^\x00\t\n\x0c\r ])")
_CODE = re.compile(rb"<([0-9A-Fa-f]+)>")


class CMap:
    """A mapping from codes to texts."""

    def __init__(self, data: bytes):
        self.texts: dict[int, str] = {}
        self.lengths: set[int] = set()
        lexer, items = Lexer(data), []
        while (x := lexer.next()) != b"" or not isinstance(x, Word):
            if not isinstance(x, Word):
                items.append(x)
                continue
            if x == b"beginbfchar" and (m := _CODES.match(data, lexer.at)):
                found = [bytes.fromhex(c.decode()) for c in _CODE.findall(m[0])]
                for code, text in zip(found[::2], found[1::2], strict=False):
                    self._put(code, text)
                lexer.at = m.end()
            elif x == b"endcodespacerange":
                self.lengths |= {len(i) for i in items if isinstance(i, bytes)}
            elif x == b"endbfchar":
                for code, text in zip(items[::2], items[1::2], strict=False):
                    self._put(code, text)
            elif x == b"endbfrange":
                for low, high, to in zip(items[::3], items[1::3], items[2::3], strict=False):
                    first, last = int.from_bytes(low), int.from_bytes(high)
                    if isinstance(to, list):
                        for k, t in enumerate(to[: last - first + 1]):
                            self._put((first + k).to_bytes(len(low)), t)
                    elif isinstance(to, bytes) and len(to) > 1:
                        for k in range(min(last - first, 0xFFFF) + 1):
                            self.texts[first + k] = (to[:-2] + (int.from_bytes(to[-2:]) + k & 0xFFFF).to_bytes(2)).decode("utf-16-be", "surrogatepass")
                    else:
                        for k in range(min(last - first, 0xFF) + 1):
                            self.texts[first + k] = chr(int.from_bytes(to) + k)
            items = []

    def _put(self, code: bytes, text) -> None:
        if isinstance(text, bytes):
            self.texts[int.from_bytes(code)] = text.decode("utf-16-be", "surrogatepass") if len(text) > 1 else text.decode("latin-1")
        elif isinstance(text, Name):
            self.texts[int.from_bytes(code)] = glyph_text(text)


@cache
def _characters(codec: str) -> tuple[str, ...]:
    return tuple(bytes([k]).decode(codec, "ignore") or chr(k) for k in range(256))


class Font:
    def __init__(self, doc: Document, entries: dict):
        get = lambda d, k: doc.resolve(d.get(k)) if isinstance(d, dict) else None
        mapping = get(entries, "ToUnicode")
        self.to_unicode = CMap(doc.decoded(mapping)) if isinstance(mapping, Stream) else None
        self.wide = entries.get("Subtype") == "Type0"
        self.scale = 0.001
        self._known: dict[int, tuple[str, float]] = {}
        own = entries
        self.widths: dict[int, float] = {}
        self.missing: float = WIDTH * 1000
        encoding = get(entries, "Encoding")
        if self.wide:
            own = doc.resolve((get(entries, "DescendantFonts") or [{}])[0]) or {}
            self.missing = get(own, "DW") or 1000
            self._wide_widths(doc, get(own, "W") or [])
            self.utf16 = isinstance(encoding, str) and encoding.startswith("Uni") and ("UCS2" in encoding or "UTF16" in encoding)
        else:
            first = get(entries, "FirstChar") or 0
            for k, w in enumerate(get(entries, "Widths") or []):
                w = doc.resolve(w)
                if isinstance(w, (int, float)):
                    self.widths[first + k] = w
            base = encoding if isinstance(encoding, str) else get(encoding, "BaseEncoding") if isinstance(encoding, dict) else None
            codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
            self.chars = list(_characters(codec))
            at = 0
            for x in (get(encoding, "Differences") or []) if isinstance(encoding, dict) else []:
                if isinstance(x, int):
                    at = x
                elif isinstance(x, Name) and 0 <= at < 256:
                    self.chars[at] = glyph_text(x)
                    at += 1
            if entries.get("Subtype") == "Type3":
                matrix = get(entries, "FontMatrix")
                self.scale = abs(doc.resolve(matrix[0])) if isinstance(matrix, list) and matrix else 0.001
        descriptor = get(own, "FontDescriptor") or {}
        if not self.wide and isinstance(get(descriptor, "MissingWidth"), (int, float)) and self.widths:
            self.missing = descriptor["MissingWidth"] if isinstance(descriptor["MissingWidth"], (int, float)) else self.missing
        ascent, descent = get(descriptor, "Ascent"), get(descriptor, "Descent")
        told = isinstance(ascent, (int, float)) and isinstance(descent, (int, float)) and ascent - descent > 0
        self.ascent, self.descent = (ascent / 1000, descent / 1000) if told else (ASCENT, DESCENT)

    def _wide_widths(self, doc: Document, w: list) -> None:
        at = 0
        w = [doc.resolve(x) for x in w]
        while at + 1 < len(w):
            if isinstance(w[at + 1], list):
                for k, x in enumerate(w[at + 1]):
                    self.widths[w[at] + k] = doc.resolve(x)
                at += 2
            else:
                for code in range(w[at], min(w[at + 1], w[at] + 0xFFFF) + 1) if at + 2 < len(w) else ():
                    self.widths[code] = w[at + 2]
                at += 3

    def _one(self, code: int) -> tuple[str, float]:
        text = self.to_unicode.texts.get(code) if self.to_unicode else None
        if text is None:
            text = self.chars[code] if not self.wide else chr(code) if self.utf16 else ""
        return text, self.widths.get(code, self.missing) * self.scale

    def decode(self, raw: bytes) -> tuple[str, float, int, int]:
        """The text, its width (a part of the font size), the number of its codes, and that of those that word spacing counts for."""
        wide = self.wide and not (self.to_unicode and self.to_unicode.lengths == {1})
        codes = struct.unpack(f">{len(raw) // 2}H", raw[: len(raw) // 2 * 2]) if wide else raw
        known = self._known
        for code in set(codes).difference(known):
            known[code] = self._one(code)
        found = [known[c] for c in codes]
        return "".join([t for t, _ in found]), sum([w for _, w in found]), len(codes), 0 if wide else raw.count(b" ")


Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: Matrix, n: Matrix) -> Matrix:
    a, b, c, d, e, f = m
    g, h, i, j, k, t = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + t)


class Shower:
    """Goes through the operators of a page."""

    def __init__(self, doc: Document):
        self.doc = doc
        self.fonts: dict[int, Font] = {}
        self.spans: list[Span] = []
        self._end: tuple[float, float, float] | None = None  # where the last span ended, and its size

    def _font(self, resources: dict, name: str) -> Font:
        fonts = self.doc.resolve(resources.get("Font")) or {}
        entries = self.doc.resolve(fonts.get(name)) if isinstance(fonts, dict) else None
        if not isinstance(entries, dict):
            return self.fonts[0]
        if id(entries) not in self.fonts:
            self.fonts[id(entries)] = Font(self.doc, entries)
        return self.fonts[id(entries)]

    def show(self, content: bytes, resources: dict, ctm: Matrix = IDENTITY, level: int = 0) -> None:
        doc = self.doc
        plain = self.fonts.setdefault(0, Font(doc, {}))
        state = {"ctm": ctm, "font": plain, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 1.0, "TL": 0.0, "Ts": 0.0}
        kept: list[dict] = []
        tm = line = IDENTITY
        args: list = []
        lexer = Lexer(content)
        while True:
            x = lexer.next()
            if not isinstance(x, Word):
                args.append(x)
                continue
            if x == b"":
                break
            n = [a for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
            if x == b"q":
                kept.append(dict(state))
            elif x == b"Q" and kept:
                state = kept.pop()
            elif x == b"cm" and len(n) >= 6:
                state["ctm"] = times(tuple(map(float, n[-6:])), state["ctm"])
            elif x == b"BT":
                tm = line = IDENTITY
            elif x == b"Tf" and n:
                names = [a for a in args if isinstance(a, Name)]
                state["font"] = self._font(resources, names[-1]) if names else plain
                state["size"] = float(n[-1])
            elif x in (b"Tc", b"Tw", b"TL", b"Ts") and n:
                state[x.decode()] = float(n[-1])
            elif x == b"Tz" and n:
                state["Tz"] = n[-1] / 100
            elif x == b"Tm" and len(n) >= 6:
                tm = line = tuple(map(float, n[-6:]))
            elif x in (b"Td", b"TD") and len(n) >= 2:
                if x == b"TD":
                    state["TL"] = -float(n[-1])
                tm = line = times((1.0, 0.0, 0.0, 1.0, float(n[-2]), float(n[-1])), line)
            elif x in (b"T*", b"'", b'"'):
                if x == b'"' and len(n) >= 2:
                    state["Tw"], state["Tc"] = float(n[0]), float(n[1])
                tm = line = times((1.0, 0.0, 0.0, 1.0, 0.0, -state["TL"]), line)
            elif x == b"Do" and args and level < DEEPEST_FORM:
                forms = doc.resolve(resources.get("XObject")) or {}
                form = doc.resolve(forms.get(args[-1])) if isinstance(forms, dict) and isinstance(args[-1], Name) else None
                if isinstance(form, Stream) and form.entries.get("Subtype") == "Form":
                    own = doc.resolve(form.entries.get("Matrix")) or list(IDENTITY)
                    inner = doc.resolve(form.entries.get("Resources")) or resources
                    self.show(doc.decoded(form), inner, times(tuple(float(doc.resolve(v)) for v in own), state["ctm"]), level + 1)
            elif x == b"BI":  # an inline image: up to EI between white space
                m = re.compile(rb"[\s\x00]EI(?=[\s\x00]|$)").search(content, lexer.at)
                lexer.at = m.end() if m else len(content)
            if x in (b"Tj", b"'", b'"', b"TJ") and args:
                tm = self._shown(args[-1] if isinstance(args[-1], list) else [args[-1]], state, tm)
            args = []

    def _shown(self, items: list, state: dict, tm: Matrix) -> Matrix:
        font, size, wide = state["font"], state["size"], state["Tz"]
        text: list[str] = []
        way = 0.0
        for item in items:
            if isinstance(item, bytes):
                t, w, codes, spaces = font.decode(item)
                text.append(t)
                way += (w * size + state["Tc"] * codes + state["Tw"] * spaces) * wide
            elif isinstance(item, (int, float)):
                if -item / 1000 > WORD_GAP and text and not text[-1][-1:].isspace():
                    text.append(" ")
                way -= item / 1000 * size * wide
        full = times(tm, state["ctm"])
        shown = "".join(text)
        if _HALVES.search(shown):  # halves of characters that two codes stand for
            shown = shown.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")
        if shown:
            a, b, c, d, e, f = full
            corners = [(a * x + c * y + e, b * x + d * y + f) for x in (0.0, way) for y in (state["Ts"] + font.descent * size, state["Ts"] + font.ascent * size)]
            xs, ys = [p[0] for p in corners], [p[1] for p in corners]
            x, y = c * state["Ts"] + e, d * state["Ts"] + f
            tall = hypot(c, d) * abs(size)
            if self._end and self.spans:
                end_x, end_y, last = self._end
                before = self.spans[-1]
                if abs(y - end_y) < 0.3 * last and x - end_x > WORD_GAP * last and not before.text[-1:].isspace() and not shown[:1].isspace():
                    before.text += " "
            self.spans.append(Span(shown, min(xs), y, tall, max(xs), min(ys), max(ys)))
            self._end = (a * way + x, b * way + y, tall)
        return times((1.0, 0.0, 0.0, 1.0, way, 0.0), tm)


def page_spans(doc: Document, page: dict) -> list[Span]:
    contents = doc.resolve(page.get("Contents"))
    parts = [doc.resolve(c) for c in contents] if isinstance(contents, list) else [contents]
    resources = doc.resolve(page.get("Resources"))
    shower = Shower(doc)
    shower.show(b"\n".join(doc.decoded(p) for p in parts if isinstance(p, Stream)), resources if isinstance(resources, dict) else {})
    return shower.spans


def shown(content: bytes) -> Iterator[Span]:
    """The spans of a content stream by itself."""
    doc = Document.__new__(Document)
    shower = Shower(doc)
    shower.show(content, {})
    yield from shower.spans
