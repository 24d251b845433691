"""Values as text: escapes, dates, times, hexadecimal, tab-separated lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, DayTimeIntervalType, DoubleType, FloatType, StringType, StructType, TimestampNTZType, TimestampType

#: In place of NULL in a line.
NULL = "\\N"
# Characters that lines escape, the escape character first.
_ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"))


def escaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ESCAPES, text)


def unescaped(text: Column) -> Column:
    """The inverse of escaped, one pass from left to right."""
    held = ""  # stands for an escaped backslash meanwhile
    out = F.replace(text, F.lit("\\\\"), F.lit(held))
    for plain, code in _ESCAPES[1:]:
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.replace(out, F.lit(held), F.lit("\\"))


def to_hex(value: Column) -> Column:
    return F.hex(value)


def from_hex(text: Column) -> Column:
    return F.unhex(text)


def date_text(value: Column) -> Column:
    """A date alone where the time is midnight, else with seconds, and micros if there are any."""
    day, time, micros = (F.date_format(value, f) for f in ("yyyy-MM-dd", "HH:mm:ss", "SSSSSS"))
    full = F.concat_ws(" ", day, time)
    return F.when((time == "00:00:00") & (micros == "000000"), day).when(micros == "000000", full).otherwise(F.concat(full, F.lit("."), micros))


def time_text(value: Column) -> Column:
    """A signed time whose hours may go beyond 24."""
    seconds = F.abs(value.cast("decimal(38,6)"))
    whole = F.floor(seconds).cast("long")
    micros = ((seconds - F.floor(seconds)) * 1_000_000).cast("long")
    text = F.format_string("%02d:%02d:%02d", F.expr("0").cast("long") + F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60)
    text = F.when(micros > 0, F.concat(text, F.format_string(".%06d", micros))).otherwise(text)
    return F.when(value.cast("decimal(38,6)") < 0, F.concat(F.lit("-"), text)).otherwise(text)


def cell(df: DataFrame, name: str) -> Column:
    """The column as a line's text: NULL as \\N, binary as hexadecimal, text escaped."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, StringType):
        out = escaped(value)
    elif isinstance(kind, BinaryType):
        out = F.hex(value)
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        out = date_text(value)
    elif isinstance(kind, DateType):
        out = F.date_format(value, "yyyy-MM-dd")
    elif isinstance(kind, DayTimeIntervalType):
        out = time_text(value)
    elif isinstance(kind, (FloatType, DoubleType)):
        text = value.cast("string")
        out = F.when(F.endswith(text, F.lit(".0")), F.expr(f"substring(cast(`{name}` as string), 1, length(cast(`{name}` as string)) - 2)")).otherwise(text)
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit(NULL))


def lines(df: DataFrame) -> DataFrame:
    """One text column, value: each row as a tab-separated line, for write.text."""
    return df.select(F.concat_ws("\t", *[cell(df, c) for c in df.columns]).alias("value"))


def parsed(rows: DataFrame, schema: StructType) -> DataFrame:
    """The inverse of lines: value as rows of schema. A line without a cell for each column is an error."""
    cells, n = F.split("value", "\t", -1), len(schema.fields)
    whole = F.when(F.size(cells) == n, cells).otherwise(F.raise_error(F.concat(F.lit(f"not {n} cells: "), F.col("value"))))
    out = []
    for i, f in enumerate(schema.fields):
        text = F.col("__cells")[i]
        text = F.when(text != NULL, text)
        if isinstance(f.dataType, StringType):
            value = unescaped(text)
        else:
            value = F.unhex(text) if isinstance(f.dataType, BinaryType) else text.cast(f.dataType)
        out.append(value.alias(f.name))
    return rows.select(whole.alias("__cells")).select(*out)
