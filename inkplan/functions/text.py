"""Text functions with one definition of white space, whichever engine runs them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What trim() takes away; \s in patterns is the same without U+0085.
TRIM = _SPACES + "\u0085"
#: For Java, Python and RE2 patterns.
SPACE_CLASS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
PY_SPACES = re.compile(f"[{_SPACES}]+")


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM))


def trim_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(TRIM))


def split_lines(c: Column) -> Column:
    """Lines ended by CR LF, CR or LF; no empty line after the last end."""
    return F.split(F.regexp_replace(c, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def decode_lenient(content: Column) -> Column:
    """UTF-8, or ISO-8859-1 where it isn't valid; without a leading byte-order mark."""
    utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"\A\x{feff}", "")


def decode_strict(content: Column) -> Column:
    """UTF-8, or null where it isn't valid."""
    utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, r"\A\x{feff}", ""))


def preview(c: Column, most: int) -> Column:
    """The text, or if it is longer its lines within the first ``most`` characters and one more, or those characters."""
    head = F.substring(c, 1, most + 1)
    cut = most + 1 - F.locate("\n", F.reverse(head))  # index of the last line feed; most + 1 if there is none
    at_line = (F.locate("\n", F.reverse(head)) > 0) & (cut > 0)
    first = F.when(at_line, F.substring(c, F.lit(1), cut + 1))
    rest = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.coalesce(first, rest))


def is_truncated(c: Column, most: int) -> Column:
    return F.length(c) > most


def elapsed(seconds: Column) -> Column:
    """m:ss"""
    s = F.floor(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def megabytes(size: Column) -> Column:
    """One decimal of a number of whole bytes, as in 1.5 MB; a half goes to the even tenth, as printf has it."""
    n = size.cast("long")
    part = F.abs(n % (1 << 20)) * 10
    tenths, rest = F.shiftright(part, 20), part % (1 << 20)
    tenths = tenths + ((rest > 1 << 19) | ((rest == 1 << 19) & (tenths % 2 == 1))).cast("int")
    whole = F.abs(n - n % (1 << 20)) / (1 << 20)
    return F.concat(F.when(n < 0, "-").otherwise(""), (whole + F.when(tenths == 10, 1).otherwise(0)).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))


def percent(fraction: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), fraction * 100))).cast("int")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+\z", 0)


def output_name(name: Column) -> Column:
    """The name with its extension replaced by .md; one without stays as it is."""
    return F.regexp_replace(name, r"\.\w+\z", ".md")
