"""Point-in-time group features.

Blank address keys are never grouped: counts are taken over real keys and joined
back, so the blank group, often the largest, costs nothing.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions.dates import month_key
from ..functions.names import name_head

NO_PEER = -1
DIGITS = 6
KEY = "address_group_key"


def _on_key(df: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(counts, keys, "left")


def shared_address(df: DataFrame) -> DataFrame:
    """df with shared_address_company_count: rows at the same address, 0 where it is blank."""
    df = df.withColumn(KEY, F.coalesce(KEY, F.lit("")))
    counts = df.filter(F.col(KEY) != "").groupBy(KEY).agg(F.count("*").cast("int").alias("n_"))
    return _on_key(df, counts, [KEY]).withColumn("shared_address_company_count", F.coalesce("n_", F.lit(0))).drop("n_")


def month_cohort(df: DataFrame) -> DataFrame:
    """df with the size of its address and registration month, 0 where either is missing."""
    df = df.withColumns({KEY: F.coalesce(KEY, F.lit("")), "month_": month_key(F.col("registration_date"))})
    counts = df.filter((F.col(KEY) != "") & F.col("month_").isNotNull()).groupBy(KEY, "month_").agg(F.count("*").cast("int").alias("n_"))
    return _on_key(df, counts, [KEY, "month_"]).withColumn("address_registration_month_company_count", F.coalesce("n_", F.lit(0))).drop("n_", "month_")


def month_cohort_literal(df: DataFrame) -> DataFrame:
    """As month_cohort, but rows without a date at a real address get the number of all rows without a date: the key is null for them all."""
    dated = month_cohort(df)
    lone = df.agg(F.count_if(F.col("registration_date").isNull()).cast("int").alias("undated_"))
    undated = (F.col(KEY) != "") & F.col("registration_date").isNull()
    return dated.join(F.broadcast(lone)).withColumn("address_registration_month_company_count", F.when(undated, F.col("undated_")).otherwise(F.col("address_registration_month_company_count"))).drop("undated_")


def month_shape(df: DataFrame) -> DataFrame:
    """Per address: dated companies, largest month share and entropy in nats as ln N - sum(n ln n) / N, with no window."""
    months = df.filter((F.coalesce(KEY, F.lit("")) != "") & F.col("registration_date").isNotNull()).groupBy(KEY, month_key(F.col("registration_date")).alias("m")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return months.groupBy(KEY).agg(
        total.alias("dated_companies"), (F.max("n") / total).alias("max_month_share"), F.greatest(F.log(total) - F.sum(F.col("n") * F.log("n")) / total, F.lit(0.0)).alias("entropy_nats"),
    )


def cluster_shape(df: DataFrame) -> DataFrame:
    """Per address: the statistics of its companies, each over the rows that have its input."""
    own = df.filter(F.coalesce(KEY, F.lit("")) != "").withColumns({"head_": name_head(F.col("company_name")), "division_": F.substring(F.coalesce("nic_code", F.lit("")), 1, 2), "capital_": F.col("authorised_capital_inr").cast("double")})
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    g = own.groupBy(KEY).agg(
        F.datediff(F.max("registration_date"), F.min("registration_date")).alias("span_days"), F.count_distinct(filled("division_")).alias("divisions"), F.avg("capital_").alias("capital_mean"),
        F.stddev_pop("capital_").alias("capital_std"), F.count_distinct(filled("head_")).alias("name_heads"), F.count_if(F.col("head_") != "").alias("named"),
    )
    return g.join(month_shape(df), KEY, "left")


def _rounded(c: Column) -> Column:
    return F.bround(c, DIGITS)


def with_cluster_shape(df: DataFrame) -> DataFrame:
    """df with the six shape features; a row without a cluster gets the values of a cluster of one."""
    df = df.withColumn(KEY, F.coalesce(KEY, F.lit("")))
    j = df.join(cluster_shape(df), KEY, "left")
    real = F.col(KEY) != ""
    entropy = F.when(F.col("dated_companies") > 1, F.abs(F.col("entropy_nats") / F.log("dated_companies"))).otherwise(0.0)
    own_division = (F.substring(F.coalesce("nic_code", F.lit("")), 1, 2) != "").cast("int")
    return j.withColumns({
        "address_cluster_registration_span_days": F.coalesce("span_days", F.lit(0)).cast("int"),
        "address_cluster_registration_month_entropy": _rounded(F.coalesce(entropy, F.lit(0.0))),
        "address_cluster_max_month_share": _rounded(F.coalesce("max_month_share", F.lit(1.0))),
        "address_cluster_nic_division_distinct": F.when(real, F.coalesce("divisions", F.lit(0))).otherwise(own_division).cast("int"),
        "address_cluster_authorised_capital_cv": _rounded(F.coalesce(F.when(F.col("capital_mean") > 0, F.col("capital_std") / F.col("capital_mean")), F.lit(0.0))),
        "address_cluster_distinct_name_head_ratio": _rounded(F.coalesce(F.when(F.col("named") > 0, F.col("name_heads") / F.col("named")), F.lit(1.0))),
    }).drop("span_days", "divisions", "capital_mean", "capital_std", "name_heads", "named", "dated_companies", "max_month_share", "entropy_nats")


def serial_adjacency(df: DataFrame) -> DataFrame:
    """df with cohort size, peers at the address and the smallest serial gap to one; neighbours in serial order, never pairs."""
    cohort = "cin_registrar_year_cohort_key"
    sizes = df.filter(F.col(cohort).isNotNull()).groupBy(cohort).agg(F.count("*").cast("int").alias("size_"))
    comparable = df.filter((F.coalesce(KEY, F.lit("")) != "") & F.col(cohort).isNotNull() & F.col("cin_roc_serial").isNotNull())
    group = Window.partitionBy(KEY, cohort)
    order = group.orderBy("cin_roc_serial", "company_snapshot_id")
    serial = F.col("cin_roc_serial")
    gaps = comparable.select("company_snapshot_id", (F.count("*").over(group) - 1).cast("int").alias("peers_"), F.least(serial - F.lag(serial).over(order), F.lead(serial).over(order) - serial).alias("gap_"))
    j = df.join(sizes, cohort, "left").join(gaps, "company_snapshot_id", "left")
    return j.withColumns({
        "registrar_year_cohort_company_count": F.coalesce("size_", F.lit(0)), "address_cluster_cohort_peer_count": F.coalesce("peers_", F.lit(0)),
        "address_cluster_roc_serial_min_gap": F.coalesce("gap_", F.lit(NO_PEER)).cast("int"),
    }).drop("size_", "peers_", "gap_")


def company_features(df: DataFrame, cutoff: date) -> DataFrame:
    """Age, logs and ratio of capital, industry division, identifier segments and disagreements."""
    capital = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.select(
        "*", F.datediff(F.lit(cutoff), "registration_date").alias("company_age_days"), F.substring(F.coalesce("nic_code", F.lit("")), 1, 2).alias("nic_division"),
        F.log1p(capital("authorised_capital_inr")).alias("log_authorised_capital_inr"), F.log1p(capital("paid_up_capital_inr")).alias("log_paid_up_capital_inr"),
        F.coalesce(F.try_divide(capital("paid_up_capital_inr"), F.col("authorised_capital_inr").cast("double")), F.lit(0.0)).alias("paid_to_authorised_capital_ratio"),
        *identifiers.decoded(F.col("cin")), *identifiers.disagreements(F.col("cin"), F.col("registration_date"), F.col("nic_code"), F.col("listing_status"), F.col("state_code")),
    )


def velocity(events: DataFrame, key: str = "user_id", at: str = "ts", value: str = "value", epsilon: float = 1e-3) -> DataFrame:
    """Counts and means over trailing 1, 7 and 30 days, and the ratios between them; range windows with the row itself included.

    Windows go by the nearest second, halves to the even one.
    """
    day = 86_400
    seconds = F.rint(F.col(at).cast("timestamp").cast("double")).cast("long")
    over = lambda days: Window.partitionBy(key).orderBy("at_").rangeBetween(-days * day, 0)
    e = events.withColumn("at_", seconds)
    e = e.withColumns({f"n_{d}d": F.count("*").over(over(d)) for d in (1, 7, 30)} | {f"mean_{d}d": F.avg(value).over(over(d)) for d in (1, 7, 30)})
    ratio = lambda a, b: F.col(a) / (F.col(b) + epsilon)
    return e.withColumns({
        "amount_to_mean_1d": ratio(value, "mean_1d"), "amount_to_mean_7d": ratio(value, "mean_7d"), "amount_to_mean_30d": ratio(value, "mean_30d"), "count_1d_to_7d": ratio("n_1d", "n_7d"), "count_7d_to_30d": ratio("n_7d", "n_30d"),
        "log_amount": F.log1p(F.greatest(F.col(value), F.lit(0.0))), "max_mean": F.greatest("mean_1d", "mean_7d", "mean_30d"),
    }).drop("at_")
