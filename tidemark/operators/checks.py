"""Contracts on frames, fused into one aggregation where they need data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A frame broke a contract."""


def require_columns(df: DataFrame, needed) -> None:
    """No job: reads the analysed schema."""
    if missing := sorted(set(needed) - set(df.columns)):
        raise ContractError(f"missing columns: {', '.join(missing)}")


def require(df: DataFrame, unique: tuple[str, ...] = (), constant: dict | None = None) -> None:
    """Unique keys (null counts as a value) and constant columns, all in one job."""
    n = F.count("*").alias("n")
    keys = [(F.count_distinct(k) + F.coalesce(F.max(F.col(k).isNull().cast("int")), F.lit(0))).alias(f"u_{k}") for k in unique]
    same = [x for c in (constant or {}) for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count_if(F.col(c).isNull()).alias(f"na_{c}"))]
    got = df.agg(n, *keys, *same).first()
    for k in unique:
        if got[f"u_{k}"] != got["n"]:
            raise ContractError(f"{k} must be unique")
    for c, value in (constant or {}).items():
        if got["n"] and (got[f"lo_{c}"] != value or got[f"hi_{c}"] != value or got[f"na_{c}"]):
            raise ContractError(f"{c} must be {value} in every row")


def one_snapshot(left: DataFrame, right: DataFrame, column: str = "source_snapshot_id") -> DataFrame:
    """One row with the snapshot that both sides have in every row; several, different ones or none raise when it is read."""
    seen = left.select(F.col(column).alias("x"), F.lit(1).alias("side")).union(right.select(column, F.lit(2)))
    got = seen.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count_if(F.col("x").isNull()).alias("none"), F.count_distinct("side").alias("sides"))
    same = F.coalesce((F.col("low") == F.col("high")) & (F.col("none") == 0) & (F.col("sides") == 2), F.lit(False))
    return got.select(F.when(same, F.col("low")).otherwise(F.raise_error(F.lit(f"both sides must have one {column}")).cast("string")).alias(column))


def contract_counters(df: DataFrame, key: str, constant: str, number: str) -> DataFrame:
    """What the contracts look at, as one row: rows, distinct keys (null is one), least and largest constant, numbers that aren't finite, and numbers outside [0, 1]."""
    n = F.col(number).cast("double")
    odd = n.isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    return df.agg(
        F.count("*").alias("rows"), (F.count_distinct(key) + F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))).alias("distinct_keys"), F.min(constant).alias("least"), F.max(constant).alias("largest"),
        F.count_if(odd).alias("not_finite"), F.count_if(~odd & ~in_range(n, 0.0, 1.0)).alias("outside"),
    )


def joined_one(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join to a side whose key is checked while it runs: a repeated key raises instead of multiplying rows."""
    n = F.count("*").alias("_n")
    others = [c for c in right.columns if c != on]
    one = right.groupBy(on).agg(n, *[F.first(c).alias(c) for c in others])
    one = one.withColumn(on, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{on} is repeated: "), F.col(on).cast("string"))).cast(right.schema[on].dataType)).otherwise(F.col(on)))
    return left.join(one.drop("_n"), on, how)


def require_finite(df: DataFrame, columns: list[str]) -> None:
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    got = df.agg(*[F.coalesce(F.max(bad(c).cast("int")), F.lit(0)).alias(c) for c in columns]).first()
    if wrong := [c for c in columns if got[c]]:
        raise ContractError(f"not finite: {', '.join(wrong)}")


def require_probability(df: DataFrame, column: str) -> None:
    require_finite(df, [column])
    got = df.agg(F.min(column), F.max(column)).first()
    if got[0] is not None and (got[0] < 0 or got[1] > 1):
        raise ContractError(f"{column} must lie in [0, 1]")


def in_range(c: Column, low, high) -> Column:
    """Closed at both ends; null is outside."""
    return F.coalesce(c.between(low, high), F.lit(False))


def duplicates(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows, and how many of them repeat a key."""
    return df.agg(F.count("*").alias("valid_rows"), (F.count("*") - F.count_distinct(F.struct(*key))).alias("duplicate_rows"))


def quality_audit(df: DataFrame, key: str = "legal_entity_identifier") -> DataFrame:
    """One row of counters; a distinct count ignores null, so null keys count as repeats."""
    text = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return df.agg(
        F.count("*").alias("row_count"), (F.count("*") - F.count_distinct(key)).alias("duplicate_identifier_rows"),
        F.count_if(text(key)).alias("blank_identifier_rows"), F.count_if(text("company_name")).alias("blank_name_rows"),
        F.count_if(F.col("registration_date").isNull()).alias("missing_date_rows"), F.count_if(text("address_group_key")).alias("blank_address_rows"),
        F.count_if(F.col("authorised_capital_inr").isNull()).alias("missing_capital_rows"),
    )
