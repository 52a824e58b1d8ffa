"""The catalogue of a new trace, record by record: scopes, variables, attributes, tables of literals, source stems.

This is the producer's side of a trace: a catalogue is written by one program, in order. `rows` are the records as
write_trace and file_bytes take them; `frame` is the same as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import labels, text
from .waveform import SCHEMAS

_MISC = {name: code for code, name in enumerate(labels.MISC_SUBTYPES)}


class Records:
    """Adds records in order. Variables get handles from 1 in the order of their creation; an alias has its target's."""

    def __init__(self):
        self.rows: list[dict] = []
        self.handles = 0
        self._paths: dict[str, int] = {}
        self._tables = 0
        self._scopes: list[str] = []

    def _add(self, kind: str, **fields) -> None:
        path = ".".join([*self._scopes, *([fields["name"]] if kind in ("var", "scope") else [])])
        self.rows.append({"ord": len(self.rows), "kind": kind, "depth": len(self._scopes), "path": path} | fields)

    def scope(self, name: str, kind: int = 0, component: str = "") -> None:
        """Opens a scope; a kind beyond the known ones is a module."""
        self._add("scope", type_code=kind if 0 <= kind < len(labels.SCOPE_TYPES) else 0, name=name, component=component)
        self._scopes.append(name)

    def upscope(self) -> None:
        self._add("upscope")
        del self._scopes[-1:]

    def attribute(self, kind: int, subtype: int, name: str | None, arg: int = 0) -> None:
        """Any attribute; an unknown kind is Misc Unknown, an unknown subtype the first; line breaks in the name become spaces."""
        if not 0 <= kind < len(labels.ATTR_TYPES):
            kind, subtype = 0, _MISC["Unknown"]
        subtype = subtype if 0 <= subtype < len(labels.SUBTYPES[kind]) else 0
        self._add("attr", type_code=kind, subtype_code=subtype, name=(name or "").translate({10: " ", 13: " "}), arg=arg)

    def attribute_end(self) -> None:
        self._add("attr_end")

    def comment(self, words: str) -> None:
        self.attribute(0, _MISC["Comment"], words)

    def environment(self, words: str) -> None:
        self.attribute(0, _MISC["EnvVar"], words)

    def value_list(self, words: str) -> None:
        self.attribute(0, _MISC["ValueList"], words)

    def source(self, path: str, line: int, instantiation: bool = False) -> None:
        """Where the next record stands in the source, or is instantiated: a path is declared with a number at its first use, by that afterwards."""
        if path and path not in self._paths:
            self._paths[path] = len(self._paths) + 1
            self.attribute(0, _MISC["PathName"], path, self._paths[path])
        if path:
            self._add("attr", type_code=0, subtype_code=_MISC["SourceIStem" if instantiation else "SourceStem"], name="", arg=line, arg_from_name=self._paths[path])

    def variable(self, kind: int, name: str, length: int, direction: int = 0, alias: int = 0, supplement: tuple[str, int, int] | None = None) -> int:
        """A variable's handle. Reals have 8 bytes, strings none; an alias beyond the handles so far is a variable of its own.

        supplement: a type's name, and the numbers of its supplemental variable and data type.
        """
        if supplement is not None:
            self.attribute(0, _MISC["SupVar"], supplement[0], supplement[1] << 10 | supplement[2] & 1023)
        known = 0 < alias <= self.handles
        self.handles += not known
        length = 8 if kind in labels.REAL_TYPES else 0 if kind == labels.STRING_TYPE else length
        self._add("var", type_code=kind, direction_code=direction, name=name, length=length, handle=alias if known else self.handles, is_alias=known)
        return alias if known else self.handles

    def enum_table(self, name: str, elements: list[tuple[str, str]], width: int = 0) -> int:
        """A table of literals and values, with zeros on the left up to width; its number, or 0 for an empty one."""
        if not elements:
            return 0
        self._tables += 1
        literals = [text.escape(x.encode("utf-8")) for x, _ in elements]
        values = ["0" * max(0, width - len(v)) + text.escape(v.encode("utf-8")) for _, v in elements]
        self.attribute(0, _MISC["EnumTable"], " ".join([name, str(len(elements)), *literals, *values]), self._tables)
        return self._tables

    def enum_reference(self, table: int) -> None:
        """The next variable is of a table's kind."""
        if table:
            self.attribute(0, _MISC["EnumTable"], "", table)

    def frame(self, spark: SparkSession) -> DataFrame:
        names = [x.split()[0] for x in SCHEMAS["hier"].split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.rows], SCHEMAS["hier"])
