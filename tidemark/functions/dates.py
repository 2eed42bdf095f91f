"""Dates as text: unparseable is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import stripped


def parsed(c: Column, *formats: str) -> Column:
    """The first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(stripped(c.cast("string")), F.lit(f)).cast("date") for f in formats])


def iso_date(c: Column) -> Column:
    return parsed(c, "yyyy-MM-dd")


def day_month_name(c: Column) -> Column:
    """01-Feb-2020; a month's name is read in any case."""
    return parsed(F.initcap(c.cast("string")), "dd-MMM-yyyy", "d-MMM-yyyy")


def mixed_day_first(c: Column) -> Column:
    """Day-first dates in the spellings that registers mix."""
    return F.coalesce(parsed(c, "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd"), parsed(F.initcap(c.cast("string")), "dd-MMM-yyyy", "dd MMM yyyy"))


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def has_offset(c: Column) -> Column:
    """An ISO timestamp that names its offset."""
    return c.rlike(r"\A\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)\z") & F.try_to_timestamp(c).isNotNull()
