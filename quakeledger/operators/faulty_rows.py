"""Delimited text lines split into typed rows and faulty lines with their reasons.

Every field is first taken as nullable text; cast and range rules then give an array of reasons for each line, all as
built-in expressions, and lines with an empty array are the valid ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that stand for a quoted comma, and for themselves, while a line is divided.
_MARK, _MARKED_COMMA, _MARKED_SELF = "\u0001", "\u0001c", "\u0001m"
_TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,9})?Z?\z"
_NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


@dataclass(frozen=True)
class Field:
    """A column of the file. kind: text, number or time. checked: whether a bad value makes the line faulty."""

    name: str
    kind: str = "text"
    checked: bool = False
    low: float | None = None
    high: float | None = None


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def well_quoted(pieces: Column, n: Column) -> Column:
    """Whether each field is free of quotes or is quoted as a whole, with inner quotes doubled.

    The line's n pieces, cut at its quotes, stand outside and inside quotes by turns. n must be odd, and a piece
    outside must meet the neighbouring quotes with a comma, or be empty (a doubled quote, or the line's end).
    """

    def good(s: Column, i: Column) -> Column:
        starts = (i == 0) | (s == "") | s.startswith(",")
        ends = (i == n - 1) | (s == "") | s.endswith(",")
        return (i % 2 == 1) | (starts & ends)

    return F.when(n == 1, F.lit(True)).otherwise((n % 2 == 1) & F.forall(F.transform(pieces, good), lambda x: x))


def fields_of(line: Column, pieces: Column, n: Column) -> Column:
    """The fields of a well-quoted line as an array of text, quotes taken off. A null line has none."""

    def hide(s: Column, i: Column) -> Column:
        inner = F.replace(F.replace(s, F.lit(_MARK), F.lit(_MARKED_SELF)), F.lit(","), F.lit(_MARKED_COMMA))
        return F.when(i % 2 == 1, inner).otherwise(F.replace(s, F.lit(_MARK), F.lit(_MARKED_SELF)))

    def plain(s: Column) -> Column:
        inner = F.when(s.startswith('"'), F.replace(s.substr(F.lit(2), F.length(s) - 2), F.lit('""'), F.lit('"'))).otherwise(s)
        shown = F.replace(F.replace(inner, F.lit(_MARKED_COMMA), F.lit(",")), F.lit(_MARKED_SELF), F.lit(_MARK))
        return F.when(s.contains(_MARK) | s.startswith('"'), shown).otherwise(s)

    quoted = F.transform(F.split(F.array_join(F.transform(pieces, hide), '"'), ",", -1), plain)
    return F.when(n == 1, F.split(line, ",", -1)).otherwise(quoted)


def typed(field: Field, text: Column) -> tuple[Column, Column]:
    """(typed value, whether the text is faulty). Blank text is a missing value, not a fault."""
    t = stripped(text)
    blank = text.isNull() | (t == "")
    if field.kind == "number":
        value = F.when(t.rlike(_NUMBER), t.try_cast("double"))
        ok = value.isNotNull()
        if field.low is not None:
            ok = ok & (value >= field.low)
        if field.high is not None:
            ok = ok & (value <= field.high)
        return F.when(~blank & ok, value), ~blank & ~F.coalesce(ok, F.lit(False))
    if field.kind == "time":
        day = F.substring(t, 1, 10).try_cast("date")
        ok = t.rlike(_TIME) & day.isNotNull()
        cut = F.regexp_replace(F.regexp_replace(t, "Z", ""), r"(\.[0-9]{6})[0-9]+", "$1")
        return F.when(~blank & ok, F.replace(cut, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")), ~blank & ~F.coalesce(ok, F.lit(False))
    return F.when(~blank, text), F.lit(False)


def _computed_once(df: DataFrame, keep: tuple[str, ...], *columns: Column) -> DataFrame:
    """keep and new columns, held in place by a generator: later filters and projections can't copy their expressions."""
    return df.select(*keep, F.explode(F.array(F.struct(*columns))).alias("__once")).select(*keep, "__once.*")


def check_lines(lines: DataFrame, text: str, layout: tuple[Field, ...], keep: tuple[str, ...]) -> DataFrame:
    """Each line with ``reasons`` (array of text, empty for a valid line) and its typed fields.

    Reasons: ``quoting`` alone; else ``columns`` alone (not as many fields as the layout, or null text); else the names
    of all checked fields whose value is faulty, in layout order. The typed fields of faulty lines hold what could be
    read, and nulls. Clashing names: the columns named in ``keep`` come first and layout fields of the same name are
    refused by an error, since a result with two equal names could not be written. One narrow pass, no shuffle.
    """
    if clash := {f.name for f in layout} & {*keep, "reasons"}:
        raise ValueError(f"columns {sorted(clash)} are named twice")
    line = F.col("__line")
    cut = lines.select(*keep, F.col(text).alias("__line"))
    cut = _computed_once(cut, (*keep, "__line"), F.split("__line", '"', -1).alias("__pieces"))
    pieces, n = F.col("__pieces"), F.size("__pieces")
    got = _computed_once(cut, (*keep, "__line"), well_quoted(pieces, n).alias("__quoted"), fields_of(line, pieces, n).alias("__fields"))
    whole = F.coalesce(F.col("__quoted"), F.lit(False)) & (F.size("__fields") == len(layout))
    values, faults = [], []
    for i, f in enumerate(layout):
        value, fault = typed(f, F.when(whole, F.get(F.col("__fields"), F.lit(i))))
        values.append(value.alias(f.name))
        if f.checked:
            faults.append(F.when(fault, F.lit(f.name)))
    reasons = (
        F.when(F.col("__line").isNull(), F.array(F.lit("columns")))
        .when(~F.col("__quoted"), F.array(F.lit("quoting")))
        .when(F.size("__fields") != len(layout), F.array(F.lit("columns")))
        .otherwise(F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>"))
    )
    return _computed_once(got, keep, reasons.alias("reasons"), *values)


def faulty(checked: DataFrame, key: str) -> DataFrame:
    """(key, reason), a row for each reason of each faulty line; lines delivered twice count once."""
    return checked.where(F.size("reasons") > 0).select(key, F.explode("reasons").alias("reason")).dropDuplicates()


def loaded(checked: DataFrame) -> DataFrame:
    """The typed rows of the valid lines."""
    return checked.where(F.size("reasons") == 0).drop("reasons")
