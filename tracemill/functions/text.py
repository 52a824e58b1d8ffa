"""Text forms of a trace: escapes, identifier codes, enum tables, numbers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

# The bytes with an escape letter.
ESCAPES = {7: r"\a", 8: r"\b", 12: r"\f", 10: r"\n", 13: r"\r", 9: r"\t", 11: r"\v", 39: r"\'", 34: r"\"", 92: r"\\", 63: r"\?"}
_ESCAPED = [ESCAPES.get(b, chr(b) if 0x21 <= b <= 0x7E else f"\\{b:03o}") for b in range(256)]
_BACK = {e[1]: b for b, e in ESCAPES.items()}
_SEQUENCE = re.compile(rb"\\(x[0-9a-fA-F]{1,2}|[0-7]{1,3}|.)", re.DOTALL)


def escape(raw: bytes) -> str:
    """Graphic ASCII as it is, letters for the usual controls, octal for the rest, the space included."""
    return "".join([_ESCAPED[b] for b in raw])


def unescape(text: str) -> bytes:
    """The inverse; also hexadecimal escapes; an unknown escape is its character."""

    def one(m: re.Match) -> bytes:
        s = m[1]
        if s[:1] == b"x" and len(s) > 1:
            return bytes([int(s[1:], 16)])
        if s[:1] in b"01234567":
            return bytes([int(s, 8) & 255])
        return bytes([_BACK.get(chr(s[0]), s[0])])

    return _SEQUENCE.sub(one, text.encode("utf-8"))


@F.pandas_udf(StringType())
def escape_text(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else escape(bytes(b)))


@F.pandas_udf(BinaryType())
def unescape_text(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unescape(s))


@F.pandas_udf(ArrayType(StringType()))
def escape_texts(words: pd.Series) -> pd.Series:
    """escape_text of each of some strings."""
    return words.map(lambda ws: None if ws is None else [None if w is None else escape(w.encode("utf-8")) for w in ws])


@F.pandas_udf(ArrayType(StringType()))
def unescape_texts(words: pd.Series) -> pd.Series:
    """unescape_text of each of some strings; bytes that are no UTF-8 are replaced."""
    return words.map(lambda ws: None if ws is None else [None if w is None else unescape(w).decode("utf-8", "replace") for w in ws])


@F.pandas_udf(StringType())
def _real_text(value: pd.Series) -> pd.Series:
    return value.map(lambda x: f"{x:.16g}")


def real_text(value: Column) -> Column:
    """C's %.16g; null for null."""
    return F.when(value.isNotNull(), _real_text(value))


def vcd_id(handle: Column) -> Column:
    """The identifier code: bijective base 94 from !, the least digit first. Five digits cover all 32-bit handles."""
    rest, out = handle.cast("long"), []
    for _ in range(5):
        out.append(F.when(rest > 0, F.char(F.lit(33) + (rest - 1) % 94)).otherwise(""))
        rest = F.when(rest > 0, F.floor((rest - 1) / 94)).otherwise(0)
    return F.concat(*out)


def encode_enum(name: Column, literals: Column, values: Column, width: int = 0) -> Column:
    """name, count, literals, values with zeros on the left up to width, all separated by a space; literals and values escaped."""
    zeros = F.transform(values, lambda v: F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.octet_length(v))))
    padded = F.zip_with(zeros, escape_texts(values), lambda z, v: F.concat(z, v))
    return F.concat_ws(" ", name, F.size(literals).cast("string"), F.array_join(escape_texts(literals), " "), F.array_join(padded, " "))


def decode_enum(text: Column) -> Column:
    """A struct (name, elems: array<struct<literal, value>>), unescaped; null unless there are two words for each element counted."""
    words = F.split(text, " ")
    n = F.try_element_at(words, F.lit(2)).try_cast("int")
    whole = (n > 0) & (F.size(words) == 2 * n + 2)
    parts = lambda first: unescape_texts(F.when(whole, F.slice(words, first, n)))
    elems = F.zip_with(parts(F.lit(3)), parts(n + 3), lambda x, y: F.struct(x.alias("literal"), y.alias("value")))
    return F.when(whole, F.struct(F.element_at(words, 1).alias("name"), elems.alias("elems")))


def pack_supplement(var: Column, data: Column) -> Column:
    return F.shiftleft(var, 10).bitwiseOR(data.bitwiseAND(1023))


def unpack_supplement(arg: Column) -> tuple[Column, Column]:
    return F.shiftright(arg, 10), arg.bitwiseAND(1023)


def one_line(text: Column) -> Column:
    """Line breaks become spaces."""
    return F.translate(text, "\r\n", "  ")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")
