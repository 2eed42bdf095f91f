"""Buckets and orders from SHA-256, equal on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_number(c: Column) -> Column:
    """First eight bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def bucket(c: Column, n: int) -> Column:
    return F.pmod(sha_number(c), F.lit(n).cast("decimal(20,0)")).cast("long")


def seeded(c: Column, seed: int) -> Column:
    """The order key of a hash-ordered sample."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)
