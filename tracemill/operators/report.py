"""Reports of a trace: sections chosen by name, each a DataFrame, printed as titled tables; matchers and printers by name; SQL functions.

A section, matcher or printer of one's own is added to its table here and can then be asked for by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text
from . import trace as T

#: Sections by name: title, whether it is one record, and its DataFrame.
SECTIONS: dict[str, tuple[str, bool, Callable[[T.Trace], DataFrame]]] = {
    "metadata": ("Metadata", True, lambda t: T.metadata(t.metadata)),
    "vars": ("Variables", False, lambda t: T.variables(t.vars)),
    "vars_no_alias": ("Variables", False, lambda t: T.variables(t.vars, aliases=False)),
    "var_names": ("Variables", False, lambda t: T.variables(t.vars).select("name")),
    "var_names_no_alias": ("Variables", False, lambda t: T.variables(t.vars, aliases=False).select("name")),
    "scopes": ("Scopes", False, lambda t: T.scopes(t.hier.where("kind = 'scope'"))),
    "attributes": ("Attributes", False, lambda t: T.attributes(t.hier.where("kind = 'attr'"))),
}
#: The order in which sections are printed.
ORDER = ["metadata", "vars", "vars_no_alias", "var_names", "var_names_no_alias", "scopes", "attributes"]

#: Matchers by name: from a value and what is wanted to a condition.
MATCHERS: dict[str, Callable[[Column, str], Column]] = {
    "bits": lambda value, wanted: T.predicate(value, wanted),
    "hex": lambda value, wanted: T.predicate(value, wanted, hexadecimal=True),
    "regex": lambda value, wanted: T.predicate(value, wanted, regex=True),
    "hex_regex": lambda value, wanted: T.predicate(value, wanted, hexadecimal=True, regex=True),
}
#: Printers by name: from hits (time, name, value) to lines.
PRINTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "changes": lambda hits: T.hit_lines(hits).withColumnRenamed("line", "text"),
    "names": lambda hits: T.hit_lines(hits, names_only=True).withColumnRenamed("name", "text"),
}


def sections(trace: T.Trace, metadata: bool = False, vars: bool = False, scopes: bool = False, attributes: bool = False, all_sections: bool = False, aliases: bool = True, names_only: bool = False) -> dict[str, DataFrame]:
    """The chosen sections by name, in the order of printing; all_sections means each of the four. None chosen is an error."""
    kind = ("var_names" if names_only else "vars") + ("" if aliases else "_no_alias")
    asked = {"metadata": metadata, kind: vars, "scopes": scopes, "attributes": attributes}
    chosen = [n for n in ORDER if all_sections and n in asked or asked.get(n)]
    if not chosen:
        raise T.TraceError("no section is chosen")
    return {n: SECTIONS[n][2](trace) for n in chosen}


def printed(chosen: dict[str, DataFrame]) -> str:
    """Titled tables, an empty line between: a section of one record as a row for each field, an empty one as None. For a reader's screen: all rows reach the driver."""
    return "\n\n".join(titled(SECTIONS[n][0] if n in SECTIONS else n, df, n in SECTIONS and SECTIONS[n][1]) for n, df in chosen.items())


def titled(title: str, df: DataFrame, one: bool = False) -> str:
    rows = [["" if x is None else str(x) for x in r] for r in df.collect()]
    lines = [[c, *(r[i] for r in rows)] for i, c in enumerate(df.columns)] if one else [df.columns, *rows] if rows else [["None"]]
    widths = [max(len(r[i]) for r in lines) for i in range(len(lines[0]))]
    widths[-1] += max(0, len(title) - sum(widths) - 3 * (len(widths) - 1))
    inside = sum(widths) + 3 * (len(widths) - 1)
    table = ["   ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)) for r in lines]
    return "\n".join([f"╭{'─' * (inside + 2)}╮", f"│ {title.center(inside)} │", f"├{'─' * (inside + 2)}┤", *(f"│ {x} │" for x in table), f"╰{'─' * (inside + 2)}╯"])


def matches(trace: T.Trace, matcher: str, wanted: str, printer: str = "changes", all_matches: bool = False, signals: str | None = None) -> DataFrame:
    """Lines (time, text) of the changes that a matcher finds, by a printer, both by name."""
    found = trace.changes.where(MATCHERS[matcher](F.col("value"), wanted))
    hits = T.named(found, trace.vars, all_matches, signals)
    return PRINTERS[printer](hits)


def per_signal(changes: DataFrame, step: Callable[[int, Iterable[tuple]], Iterable[tuple]], schema: str, handles_at_once: int | None = None) -> DataFrame:
    """A closure over each signal's changes in order: step(handle, changes) gets (time, value, var_len) one by one and yields rows of `schema`.

    A signal is one task's work and has to be read from its first change on; its changes come sorted, in batches, so that
    memory does not grow with them. State is kept in the closure, by signal.
    """
    own = changes.select("handle", "time", "seq", "value", F.col("var_len") if "var_len" in changes.columns else F.lit(False).alias("var_len"))
    dealt = own.repartition("handle") if handles_at_once is None else own.repartition(handles_at_once, "handle")

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterable[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("handle", "time", "value", "var_len")), strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[tuple] = []
        for handle, changes_ in groupby(rows(batches), key=lambda r: r[0]):
            for row in step(handle, (r[1:] for r in changes_)):
                held.append(row)
                if len(held) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], names=kinds.names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], names=kinds.names)

    return dealt.sortWithinPartitions("handle", "time", "seq").mapInArrow(run, schema)


def register(spark: SparkSession, trace: T.Trace, prefix: str = "trace") -> None:
    """The tables of a trace as views <prefix>_metadata, _hier, _vars, _changes, _blackouts, and functions for SQL.

    value_hex(value) is the hexadecimal view, value_is(value, bits) the right-aligned comparison, <prefix>_at(time) the table
    of handle and value at a time.
    """
    for name in ("metadata", "hier", "vars", "changes", "blackouts"):
        getattr(trace, name).createOrReplaceTempView(f"{prefix}_{name}")
    hexadecimal = "array_join(transform(sequence(1L, CAST(ceil(length(v) / 4.0) * 4 AS BIGINT), 4L), i -> lower(conv(substring(lpad(regexp_replace(v, '[^0]', '1'), CAST(ceil(length(v) / 4.0) * 4 AS INT), '0'), CAST(i AS INT), 4), 2, 16))), '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION value_hex(v STRING) RETURNS STRING RETURN CASE WHEN v = '' THEN '' ELSE {hexadecimal} END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION value_is(v STRING, b STRING) RETURNS BOOLEAN RETURN ltrim('0', v) = ltrim('0', b)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_at(at BIGINT) RETURNS TABLE(handle INT, value STRING) RETURN SELECT handle, max_by(value, struct(time, seq)) FROM {prefix}_changes WHERE time <= {prefix}_at.at GROUP BY handle")


def enum_values(hier: DataFrame) -> DataFrame:
    """ord, handle, path, table, literal, value: each variable behind a reference to a table of literals, with that table's elements.

    A reference stands right before its variable, but for other attributes. A catalogue's size; one task puts it in order.
    """
    misc = hier.where("kind = 'attr' and type_code = 0 and subtype_code = 7")
    tables = misc.where("name <> ''").select(F.col("arg").alias("number"), text.decode_enum(F.col("name")).alias("e")).where("e is not null")
    order = T.Window.orderBy("ord").rowsBetween(T.Window.unboundedPreceding, -1)
    # the last record before that is a variable, a scope or a reference
    marks = hier.where("kind in ('var', 'scope', 'upscope') or kind = 'attr' and type_code = 0 and subtype_code = 7 and name = ''")
    before = F.last(F.struct("kind", "arg")).over(order)
    found = marks.withColumn("before", before).where("kind = 'var' and before.kind = 'attr'").select("ord", "handle", "path", F.col("before.arg").alias("number"))
    return found.join(T.small(tables), "number").select("ord", "handle", "path", F.col("e.name").alias("table"), F.explode("e.elems").alias("x")).select("ord", "handle", "path", "table", "x.literal", "x.value")


def during_blackouts(changes: DataFrame, blackouts: DataFrame) -> DataFrame:
    """The changes at times of no recording: from an off toggle on, to the next on toggle, its time not included.

    Toggles go to every task as two arrays; a file has them in one block.
    """
    toggles = blackouts.orderBy("idx").select("time", "active").collect()
    at, off = np.array([r.time for r in toggles], np.int64), np.array([False, *(not r.active for r in toggles)])

    @F.pandas_udf("boolean")
    def inside(time: pd.Series) -> pd.Series:
        return pd.Series(off[np.searchsorted(at, time.to_numpy(), "right")])

    return changes.where(inside("time"))
