"""Scalar functions on lines, tokens and values, all built from Spark's own expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five delimiters of log tokens.
DELIMITERS = " \t:=,"
TOKEN = r"[^ \t:=,]+|[ \t:=,]"
WORD = r"[^ \t:=,]+"
DELIMITER = r"^[ \t:=,]$"
#: The bits of a character-class mask.
CLASSES = (("[0-9]", 1), ("[A-F]", 2), ("[a-f]", 4), ("[G-Z]", 8), ("[g-z]", 16), ("[^0-9A-Za-z]", 32))


def tokens(line: Column) -> Column:
    """Words and single delimiters, in order; joining them gives the line again."""
    return F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))


def words(line: Column) -> Column:
    return F.filter(F.split(line, r"[ \t:=,]"), lambda w: w != "")


def join_tokens(parts: Column) -> Column:
    return F.array_join(parts, "")


def is_delimiter(token: Column) -> Column:
    return token.rlike(DELIMITER)


def skeleton(line: Column) -> Column:
    """The line with each word written W: what lines of one template have in common."""
    return F.regexp_replace(line, WORD, "W")


def class_mask(value: Column) -> Column:
    mask = F.lit(0)
    for pattern, bit in CLASSES:
        mask = mask.bitwiseOR(F.when(value.rlike(pattern), bit).otherwise(0))
    return mask


def python_mask(value: str) -> int:
    return sum(bit for pattern, bit in CLASSES if re.search(pattern, value))


def shape(value: Column) -> Column:
    """Runs of letters and digits written V, all else kept."""
    return F.regexp_replace(value, "[0-9A-Za-z]+", "V")


def shape_masks(value: Column) -> Column:
    """The shape with the class mask of each run: ``<V,17>-<V,1>``; a blank is written ``<-1>``."""
    runs = F.regexp_extract_all(value, F.lit("[0-9A-Za-z]+|[^0-9A-Za-z]"), F.lit(0))
    written = lambda r: F.when(r.rlike("^[0-9A-Za-z]"), F.concat(F.lit("<V,"), class_mask(r).cast("string"), F.lit(">"))).when(r == " ", "<-1>").otherwise(r)
    return F.array_join(F.transform(runs, written), "")


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def number(value: Column, kind: str) -> Column:
    """A whole text as ``int``, ``long`` or ``double``; null if it is none."""
    return F.when(value.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$" if kind == "double" else r"^[+-]?[0-9]+$"), value.try_cast(kind))


def piece(value: Column, start: int, length: int) -> Column:
    """``length`` characters from ``start``, counted from 0."""
    return F.substring(value, start + 1, length)


def hash31(value: Column) -> Column:
    """Polynomial hash of the UTF-8 bytes, base 131, 31 bits (fixed values)."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(value)), lambda i: F.conv(F.hex(F.substring(value.cast("binary"), i, F.lit(1))), 16, 10).cast("long"))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: (acc * 131 + c).bitwiseAND(F.lit(0x7FFFFFFF)))
    return F.when(value == "", F.lit(0).cast("long")).otherwise(folded)


def place(values: Column, wanted: Column) -> Column:
    """Where ``wanted`` first stands in an array, from 0; -1 if nowhere."""
    return F.array_position(values, wanted).cast("int") - 1


def segment_kind(token: Column) -> Column:
    return F.when(is_delimiter(token), "delimiter").when(token.rlike(r"^<V[0-9]+>$"), "variable").otherwise("constant")


def pad(value: Column, width: Column) -> Column:
    """Left-padded with blanks to the column's width."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(value))), value)


def unpad(value: Column) -> Column:
    return F.ltrim(value)


def lenient_int(value: Column) -> Column:
    return F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def is_ipv4(value: Column) -> Column:
    part = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return value.rlike(rf"^{part}(\.{part}){{3}}$")


def int_list(value: Column) -> Column:
    """``(1,2,3)`` as integers; what is no integer is null."""
    return F.transform(F.split(F.regexp_replace(value, r"[()\s]", ""), ","), lambda x: x.try_cast("int"))


def longest_common_substring(a: str, b: str) -> str:
    """First longest; for use inside tasks, there is no built-in."""
    best, at, row = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                if new[j] > best:
                    best, at = new[j], i
        row = new
    return a[at - best : at]


def lex_words(text: str) -> list[str]:
    return re.findall(WORD, text)
