"""Codes of the trace model and their labels; fixed values, in the order of their codes from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
VAR_TYPES = (
    "VcdEvent VcdInteger VcdParameter VcdReal VcdRealParameter VcdReg VcdSupply0 VcdSupply1 VcdTime VcdTri VcdTriand VcdTrior VcdTrireg VcdTri0 VcdTri1 "
    "VcdWand VcdWire VcdWor VcdPort VcdSparray VcdRealtime GenString SvBit SvLogic SvInt SvShortint SvLongint SvByte SvEnum SvShortreal"
).split()
VCD_VAR_TYPES = (
    "event integer parameter real real_parameter reg supply0 supply1 time tri triand trior trireg tri0 tri1 wand wire wor port sparray realtime "
    "string bit logic int shortint longint byte enum shortreal"
).split()
DIRECTIONS = "Implicit Input Output Inout Buffer Linkage".split()
SCOPE_TYPES = (
    "VcdModule VcdTask VcdFunction VcdBegin VcdFork VcdGenerate VcdStruct VcdUnion VcdClass VcdInterface VcdPackage VcdProgram "
    "VhdlArchitecture VhdlProcedure VhdlFunction VhdlRecord VhdlProcess VhdlBlock VhdlForGenerate VhdlIfGenerate VhdlGenerate VhdlPackage"
).split()
VCD_SCOPE_TYPES = (
    "module task function begin fork generate struct union class interface package program "
    "vhdl_architecture vhdl_procedure vhdl_function vhdl_record vhdl_process vhdl_block vhdl_for_generate vhdl_if_generate vhdl_generate vhdl_package"
).split()
ATTR_TYPES = "Misc Array Enum Pack".split()
MISC_SUBTYPES = "Comment EnvVar SupVar PathName SourceStem SourceIStem ValueList EnumTable Unknown".split()
ARRAY_SUBTYPES = "None Unpacked Packed Sparse".split()
ENUM_SUBTYPES = "SvInteger SvBit SvLogic SvInt SvShortint SvLongint SvByte SvUnsignedInteger SvUnsignedBit SvUnsignedLogic SvUnsignedInt SvUnsignedShortint SvUnsignedLongint SvUnsignedByte Reg Time".split()
PACK_SUBTYPES = "None Unpacked Packed TaggedPacked".split()
FILE_TYPES = ["Verilog", "VHDL", "Verilog/VHDL"]
SUBTYPES = [MISC_SUBTYPES, ARRAY_SUBTYPES, ENUM_SUBTYPES, PACK_SUBTYPES]
TIMESCALES = "1zs 10zs 100zs 1as 10as 100as 1fs 10fs 100fs 1ps 10ps 100ps 1ns 10ns 100ns 1us 10us 100us 1ms 10ms 100ms 1s 10s 100s".split()
REAL_TYPES = [3, 4, 20, 29]
STRING_TYPE, PORT_TYPE = 21, 18
UNIT_EXPONENTS = {"m": -3, "u": -6, "n": -9, "p": -12, "f": -15, "a": -18, "z": -21}


def label(code: Column, names: list[str], other: str = "Unknown") -> Column:
    """The label of a code; other beyond the list."""
    known = F.array(*map(F.lit, names))
    return F.when(code.between(0, len(names) - 1), F.get(known, code.cast("int"))).otherwise(other)


def subtype_label(kind: Column, code: Column) -> Column:
    """The label of an attribute's subtype, by its type."""
    out = F.when(kind == 0, label(code, SUBTYPES[0]))
    for i in (1, 2, 3):
        out = out.when(kind == i, label(code, SUBTYPES[i]))
    return out.otherwise("Unknown")


def timescale_text(exponent: Column) -> Column:
    """-21..2 as 1zs..100s."""
    return label(exponent + 21, TIMESCALES)


def timescale_exponent(text: Column) -> Column:
    """The exponent of ten of a timescale: the first unit letter, one or two more for 10 or 100; without a unit -9."""
    unit = F.regexp_extract(text, "[munpfazs]", 0)
    base = F.lit(-9)
    for letter, e in UNIT_EXPONENTS.items():
        base = F.when(unit == letter, e).otherwise(base)
    base = F.when(unit == "s", 0).otherwise(base)
    number = F.regexp_extract(text, r"^\s*\+?0*([0-9]+)", 1)
    return base + F.when(number == "10", 1).when(number == "100", 2).otherwise(0)
