"""Held-out evaluation: frozen splits, metrics of each from one histogram, review queues, and the bands that they set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import ContractError
from .decide import Bands
from .evaluate import histogram, strict_top

# The capacities that are measured, the split that sets bands, and its bands from the top.
CAPACITIES = (0.001, 0.005, 0.02)
BAND_SPLIT, BAND_NAMES = "temporal_test", ("ELEVATED_REVIEW", "WATCH", "STANDARD")
#: Days of each part in order; what follows is the test.
DAYS = (("train", 90), ("train_embargo", 7), ("validation", 30), ("validation_embargo", 7))


def day_parts(rows: DataFrame, day: Column, parts: tuple[tuple[str, int], ...] = DAYS, rest: str = "test") -> DataFrame:
    """rows with day_part: the distinct days in order are dealt to the parts, days of embargo between them, and what is left is the test.

    Only distinct days are put in order; rows find their part by a join on the day.
    """
    days = rows.select(day.alias("day_")).filter("day_ is not null").distinct()
    at = days.select("day_", (F.row_number().over(Window.orderBy("day_")) - 1).alias("at_"))
    part, edge = None, 0
    for name, n in parts:
        edge += n
        part = (F.when if part is None else part.when)(F.col("at_") < edge, name)
    return rows.withColumn("day_", day).join(F.broadcast(at.select("day_", part.otherwise(rest).alias("day_part"))), "day_", "left").drop("day_")


def split_metrics(scored: DataFrame, splits: tuple[str, ...] = ("geography_test", "temporal_test")) -> DataFrame:
    """One row a split of scored (dataset_split, target, score): counts, curves, Brier score and the range of scores, all from one histogram.

    A split without positives or without negatives, and one that was not asked for, raise when they are read.
    """
    hist = histogram(scored.withColumn("hit_", F.col("target") == 1), "score", "hit_", ("dataset_split",))
    down = Window.partitionBy("dataset_split").orderBy(F.desc("score"))
    h = hist.withColumns({"tp": F.sum("pos").over(down.rowsBetween(Window.unboundedPreceding, 0)), "seen": F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)), "neg": F.col("n") - F.col("pos")})
    s, n, pos = F.col("score"), F.sum("n"), F.sum("pos")
    got = h.groupBy("dataset_split").agg(
        n.alias("rows"), pos.alias("positive_rows"), (pos / n).alias("base_rate"), (F.sum(F.when(s >= 0.5, F.col("pos")).otherwise(F.col("neg"))) / n).alias("accuracy_at_0_5"),
        (F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), pos)).alias("pr_auc"), F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), pos * F.sum("neg")).alias("roc_auc"),
        (F.sum(F.col("neg") * s * s + F.col("pos") * (1 - s) * (1 - s)) / n).alias("brier_score"), F.min("score").alias("score_minimum"), F.max("score").alias("score_maximum"), (F.sum(F.col("n") * s) / n).alias("score_mean"),
    )
    wrong = F.when(~F.col("dataset_split").isin(*splits), "rows of another split: ").when((F.col("positive_rows") == 0) | (F.col("positive_rows") == F.col("rows")), "needs both outcomes: ")
    return got.withColumn("dataset_split", F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, "dataset_split")).cast("string")).otherwise(F.col("dataset_split")))


def queues(scored: DataFrame, split: str = BAND_SPLIT, key: str = "company_snapshot_id", capacities: tuple[float, ...] = CAPACITIES) -> DataFrame:
    """Threshold, precision, recall and lift of the queues of one split, one row a capacity."""
    rows = scored.filter(F.col("dataset_split") == split).withColumn("hit_", F.col("target") == 1)
    return strict_top(rows, "score", "hit_", key, capacities)


def measured_bands(measured: list, capacities: tuple[float, ...] = CAPACITIES, names: tuple[str, ...] = BAND_NAMES) -> Bands:
    """Bands whose least scores are the thresholds of the measured queues, rows of queues(); a capacity that was not measured raises, as do thresholds that don't fall."""
    found = {r["capacity_fraction"]: r["score_threshold"] for r in measured}
    if missing := [c for c in capacities if found.get(c) is None]:
        raise ContractError(f"no queue was measured at {missing}")
    return Bands(tuple((name, found[c]) for name, c in zip(names, capacities, strict=True)))
