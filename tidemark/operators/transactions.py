"""Engineered velocity features of a transaction table that already has its window columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import require_columns, require_finite

EPSILON = 1e-3
# The columns that a transaction table brings.
RAW = (
    "TX_AMOUNT", "TX_DURING_WEEKEND", "TX_DURING_NIGHT", "CUSTOMER_ID_NB_TX_1DAY_WINDOW", "CUSTOMER_ID_AVG_AMOUNT_1DAY_WINDOW", "CUSTOMER_ID_NB_TX_7DAY_WINDOW", "CUSTOMER_ID_AVG_AMOUNT_7DAY_WINDOW",
    "CUSTOMER_ID_NB_TX_30DAY_WINDOW", "CUSTOMER_ID_AVG_AMOUNT_30DAY_WINDOW", "TERMINAL_ID_NB_TX_1DAY_WINDOW", "TERMINAL_ID_RISK_1DAY_WINDOW", "TERMINAL_ID_NB_TX_7DAY_WINDOW", "TERMINAL_ID_RISK_7DAY_WINDOW",
    "TERMINAL_ID_NB_TX_30DAY_WINDOW", "TERMINAL_ID_RISK_30DAY_WINDOW",
)


def engineered(df: DataFrame, check: bool = True) -> DataFrame:
    """df's raw columns as float with the eleven ratios and interactions; null and infinite inputs raise."""
    require_columns(df, RAW)
    if check:
        require_finite(df, list(RAW))
    c = {k: F.col(k).cast("float") for k in RAW}
    amount, mean = c["TX_AMOUNT"], lambda d: c[f"CUSTOMER_ID_AVG_AMOUNT_{d}DAY_WINDOW"]
    n, risk = lambda who, d: c[f"{who}_ID_NB_TX_{d}DAY_WINDOW"], lambda d: c[f"TERMINAL_ID_RISK_{d}DAY_WINDOW"]
    out = {f"CUSTOMER_AMOUNT_TO_AVG_{d}D": amount / (mean(d) + EPSILON) for d in (1, 7, 30)}
    for who in ("CUSTOMER", "TERMINAL"):
        out[f"{who}_TX_ACCEL_1D_TO_7D"] = n(who, 1) / (n(who, 7) / 7.0 + EPSILON)
        out[f"{who}_TX_ACCEL_7D_TO_30D"] = n(who, 7) / (n(who, 30) * 7.0 / 30.0 + EPSILON)
    out |= {"TERMINAL_RISK_MAX": F.greatest(risk(1), risk(7), risk(30)), "TERMINAL_RISK_SLOPE_1D_30D": risk(1) - risk(30), "AMOUNT_X_TERMINAL_RISK_7D": amount * risk(7), "AMOUNT_X_NIGHT": amount * c["TX_DURING_NIGHT"]}
    rest = [x for x in df.columns if x not in RAW]
    return df.select(*rest, *[v.alias(k) for k, v in c.items()], *[v.cast("float").alias(k) for k, v in out.items()])
