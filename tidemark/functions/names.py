"""Name and address normalisation as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of legal form that the legal name drops.
LEGAL_WORDS = ("PRIVATE", "PVT", "LIMITED", "LTD", "LLP", "COMPANY", "CO")


def stripped(c: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strict_name(c: Column) -> Column:
    """Upper case, everything but A-Z and 0-9 as single spaces, trimmed; null as the empty string."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(c.cast("string"), F.lit(""))), "[^A-Z0-9]+", " "))


def legal_name(c: Column) -> Column:
    """The strict name without words of legal form."""
    dropped = F.regexp_replace(strict_name(c), rf"\b({'|'.join(LEGAL_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(dropped, " +", " "))


def name_head(c: Column) -> Column:
    """First run of letters and digits of the lower-cased name, or the empty string."""
    return F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), "([a-z0-9]+)", 1)


def strict_text(value: str | None) -> str:
    """Scalar twin of strict_name, for lookups on the driver."""
    return re.sub("[^A-Z0-9]+", " ", (value or "").upper()).strip()


def legal_text(value: str | None) -> str:
    """Scalar twin of legal_name."""
    return " ".join(w for w in strict_text(value).split(" ") if w and w not in LEGAL_WORDS)
