"""Column functions for spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_number(ref: Column) -> Column:
    """1 for A, 27 for AA; 0 if the reference does not begin with capital letters."""
    letters = F.regexp_extract(ref, "^([A-Z]+)", 1)
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def row_number(ref: Column) -> Column:
    """The row of a reference such as AB12; 0 if it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(ref, "^[A-Z]+([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))


def column_letters(n: Column) -> Column:
    """A for 1, AA for 27, up to three letters; '' for 0 and less."""
    digit = lambda x: F.chr(F.lit(65) + x.cast("int"))
    one = F.floor((n - 1) % 26)
    two = F.floor((n - 27) / 26)
    three = F.floor((n - 703) / 676)
    return F.concat(F.when(n > 702, digit(three % 26)).otherwise(""), F.when(n > 26, digit(two % 26)).otherwise(""), F.when(n > 0, digit(one)).otherwise(""))


def number_text(x: Column) -> Column:
    """The shortest text of a number: whole ones without a point."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def limit(value: Column, default: int) -> Column:
    """Null is the default, 0 is unlimited (null comes out), a negative value is an error."""
    return F.when(value < 0, F.raise_error(F.lit("a limit must not be negative"))).when(value == 0, F.lit(None)).otherwise(F.coalesce(value, F.lit(default)))
