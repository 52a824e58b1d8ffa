"""Bit-pattern values as strings of symbols, most significant first: literals, comparison, hexadecimal views."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class LiteralError(ValueError):
    """A search value that is not of its notation."""


def bits_of_literal(text: str, hexadecimal: bool = False) -> str:
    """A literal as bits; letters of hexadecimal digits in either case."""
    if hexadecimal:
        if not re.fullmatch("[0-9a-fA-F]*", text):
            raise LiteralError(f"{text!r} is not hexadecimal")
        return "".join(f"{int(c, 16):04b}" for c in text)
    if not re.fullmatch("[01]*", text):
        raise LiteralError(f"{text!r} is not binary")
    return text


def checked_pattern(pattern: str) -> str:
    """A regular expression of the subset that regular-language engines share: no look-around, no back-references."""
    bare = re.sub(r"\\\\", "", pattern)
    if re.search(r"\(\?(?:[=!>]|<[=!])", bare) or re.search(r"\\[1-9]|\\k<", bare):
        raise LiteralError(f"{pattern!r} uses look-around or back-references")
    return pattern


def equals_bits(value: Column, bits: str) -> Column:
    """Right-aligned equality, the shorter side extended with zeros."""
    return F.ltrim(value, F.lit("0")) == bits.lstrip("0")


def to_hex(value: Column) -> Column:
    """Lower-case digits of four symbols each from the right; every symbol other than 0 counts as 1."""
    n = F.length(value)
    n4 = F.ceil(n / 4) * 4
    padded = F.lpad(F.regexp_replace(value, "[^0]", "1"), n4.cast("int"), "0")
    digits = F.transform(F.sequence(F.lit(1).cast("long"), n4, F.lit(4).cast("long")), lambda i: F.lower(F.conv(F.substring(padded, i.cast("int"), F.lit(4)), 2, 16)))
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(digits, ""))


def from_hex(digits: Column) -> Column:
    """Four bits for each hexadecimal digit."""
    return F.when(F.length(digits) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.split(digits, "(?!^)"), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), ""))


def from_int(value: Column, width: Column | int) -> Column:
    """The lowest `width` bits of a whole number."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.right(F.concat(F.repeat(F.lit("0"), w), F.bin(value)), w)


def canonical_symbols(value: Column) -> Column:
    """Upper case to lower; what is none of the nine symbols to -."""
    return F.regexp_replace(F.lower(value), "[^01xzhuwl-]", "-")


def from_words(words: Column, width: Column | int, word_bits: int = 32) -> Column:
    """The lowest `width` bits of an array of unsigned words, the least significant word first."""
    whole = F.array_join(F.transform(F.reverse(words), lambda w: from_int(w.cast("long"), word_bits)), "")
    w = F.lit(width) if isinstance(width, int) else width
    return F.right(F.concat(F.repeat(F.lit("0"), w), whole), w)
