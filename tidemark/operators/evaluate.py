"""Ranking metrics from score histograms, review capacities, slices and concentration.

Every curve metric starts from one aggregation by distinct score; only that
histogram is sorted, and ties are one step of the curve.
"""

from __future__ import annotations

import math
from datetime import date
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket
from .checks import ContractError

def _everything():
    return Window.partitionBy()


def wilson_interval(successes: int, trials: int, confidence: float = 0.95) -> tuple[float, float] | None:
    """Score interval of a proportion; None without trials."""
    if not trials:
        return None
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    p, z2 = successes / trials, z * z
    mid, half = (p + z2 / (2 * trials)) / (1 + z2 / trials), z * math.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials)) / (1 + z2 / trials)
    low, high = max(0.0, mid - half), min(1.0, mid + half)
    return (0.0 if low < 1e-15 else low, 1.0 if high > 1 - 1e-15 else high)


def wilson(successes: Column, trials: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """wilson_interval as Columns; null without trials."""
    z = F.lit(NormalDist().inv_cdf(0.5 + confidence / 2))
    n, z2 = trials.cast("double"), z * z
    p = F.try_divide(successes.cast("double"), n)
    scale = F.lit(1.0) + F.try_divide(z2, n)
    mid = (p + F.try_divide(z2, n * 2)) / scale
    half = z * F.sqrt(F.try_divide(p * (F.lit(1.0) - p), n) + F.try_divide(z2, n * n * 4)) / scale
    low, high = F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))
    known = p.isNotNull()
    return F.when(known, F.when(low < 1e-15, 0.0).otherwise(low)), F.when(known, F.when(high > 1 - 1e-15, 1.0).otherwise(high))


def confusion(df: DataFrame, signal: str, target: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts, base rate, precision, recall and lift; ratios over nothing are null."""
    s, t = F.col(signal), F.col(target)
    g = df.groupBy(*keys).agg(
        F.count("*").alias("population_rows"), F.count_if(t).alias("positive_rows"), F.count_if(s).alias("flagged_rows"), F.count_if(s & t).alias("true_positive_rows"),
        F.count_if(s & ~t).alias("false_positive_rows"), F.count_if(~s & t).alias("false_negative_rows"), F.count_if(~s & ~t).alias("true_negative_rows"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    g = g.withColumns({"base_rate": ratio("positive_rows", "population_rows"), "precision": ratio("true_positive_rows", "flagged_rows"), "recall": ratio("true_positive_rows", "positive_rows")})
    return g.withColumn("lift", F.try_divide(F.col("precision"), F.col("base_rate")))


def histogram(df: DataFrame, score: str, target: str, keys: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Rows and positives (or their weight) by distinct score; the only shuffle of rows that the curves need."""
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.when(F.col(target), 1).otherwise(0)).alias("pos"), F.sum(w).alias("mass"), F.sum(F.when(F.col(target), w).otherwise(0.0)).alias("pos_mass"))


def _down(keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy(F.desc("score"))


def average_precision(hist: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Step-wise average precision, null without a positive."""
    to_here = _down(keys).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumns({"tp": F.sum("pos_mass").over(to_here), "seen": F.sum("mass").over(to_here)})
    return h.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos_mass") * F.col("tp") / F.col("seen")), F.sum("pos_mass")).alias("average_precision"))


def roc_auc(hist: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Trapezoid over distinct scores; null with one class only."""
    before = _down(keys).rowsBetween(Window.unboundedPreceding, -1)
    neg = F.col("mass") - F.col("pos_mass")
    h = hist.withColumn("above", F.coalesce(F.sum("pos_mass").over(before), F.lit(0.0)))
    return h.groupBy(*keys).agg(F.try_divide(F.sum(neg * (F.col("above") + F.col("pos_mass") / 2)), F.sum("pos_mass") * F.sum(neg)).alias("roc_auc"))


def brier(df: DataFrame, score: str, target: str, weight: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    e = F.pow(F.col(score).cast("double") - F.col(target).cast("int"), 2)
    return df.groupBy(*keys).agg((F.sum(w * e) / F.sum(w)).alias("brier_score"))


def brier_pair(df: DataFrame, score: str, target: str, weight: Column) -> DataFrame:
    """Plain and weighted Brier score from one pass."""
    e = F.pow(F.col(score).cast("double") - F.col(target).cast("int"), 2)
    return df.agg(F.avg(e).alias("brier_score"), (F.sum(weight * e) / F.sum(weight)).alias("weighted_brier_score"))


def capacity_with_ties(hist: DataFrame, capacity: float) -> DataFrame:
    """The queue at the k-th score, k = max(1, ceil(n * capacity)); everything tied with it is reviewed."""
    h = hist.withColumns({"seen": F.sum("n").over(_down(()).rowsBetween(Window.unboundedPreceding, 0)), "tp": F.sum("pos").over(_down(()).rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(_everything()), "positives": F.sum("pos").over(_everything())})
    k = F.greatest(F.lit(1), F.ceil(F.col("total") * capacity))
    row = h.filter(F.col("seen") >= k).groupBy().agg(*[F.min_by(c, "seen").alias(c) for c in ("score", "tp", "total", "positives")], F.min("seen").alias("reviewed_rows")).filter("score is not null")
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    c = F.col
    return row.select(
        c("score").alias("review_score_threshold"), "reviewed_rows", c("tp").alias("reviewed_true_positive_rows"), ratio(c("reviewed_rows"), c("total")).alias("realized_review_capacity"),
        ratio(c("tp"), c("reviewed_rows")).alias("review_precision"), ratio(c("tp"), c("positives")).alias("review_recall"),
    )


def strict_top(df: DataFrame, score: str, target: str, key: str, fractions: tuple[float, ...]) -> DataFrame:
    """Precision, recall and lift of exactly max(1, ceil(n * fraction)) rows; ties go by key.

    Only scores at the cut need the key: rows above it are counted from the histogram,
    and of the tied rows as many as still fit are taken in key order.  All fractions share
    one histogram and one pass over the tied rows.
    """
    down = _down(()).rowsBetween(Window.unboundedPreceding, 0)
    h = histogram(df, score, target).withColumns({"seen": F.sum("n").over(down), "tp": F.sum("pos").over(down), "total": F.sum("n").over(_everything()), "positives": F.sum("pos").over(_everything())})
    c = F.col

    def at_cut(f: float) -> Column:
        k = F.greatest(F.lit(1), F.ceil(c("total") * f)).cast("long")
        facts = F.struct(F.lit(f).alias("capacity_fraction"), "total", "positives", k.alias("k"), c("score").alias("cut_"), (k - c("seen") + c("n")).alias("room_"), (c("tp") - c("pos")).alias("above_"))
        return F.min_by(facts, F.when(c("seen") >= k, c("seen")))

    cuts = h.agg(F.array(*[at_cut(f) for f in fractions]).alias("x")).select(F.explode("x").alias("x")).filter("x is not null").select("x.*")
    tied = df.join(F.broadcast(cuts), c(score).cast("double") == c("cut_"))
    tied = tied.withColumn("r_", F.row_number().over(Window.partitionBy("capacity_fraction").orderBy(key))).filter("r_ <= room_")
    got = tied.groupBy("capacity_fraction", "total", "positives", "k", "cut_", "above_").agg(F.count_if(c(target)).alias("tied_tp"))
    tp = (c("above_") + c("tied_tp")).cast("double")
    return got.select(
        "capacity_fraction", c("k").alias("review_rows"), c("cut_").alias("score_threshold"), (tp / c("k")).alias("precision"),
        F.try_divide(tp, c("positives").cast("double")).alias("recall"), F.try_divide(tp / c("k"), c("positives") / c("total")).alias("lift"),
    )


def weighted_top(df: DataFrame, score: str, target: str, weight: str, key: str, fraction: float) -> DataFrame:
    """Rows in score order (ties by key) until their weight reaches fraction of all: a row stays if the weight before it is below that.

    The histogram places each score; only rows of the score at the cut are ordered.
    """
    h = histogram(df, score, target, weight=F.col(weight))
    before = _down(()).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumns({"mass_before": F.coalesce(F.sum("mass").over(before), F.lit(0.0)), "all_mass": F.sum("mass").over(_everything()), "all_pos": F.sum("pos_mass").over(_everything())})
    h = h.withColumn("limit_", F.col("all_mass") * fraction)
    whole = h.filter(F.col("mass_before") + F.col("mass") < F.col("limit_")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n0"), F.coalesce(F.sum("mass"), F.lit(0.0)).alias("m0"), F.coalesce(F.sum("pos_mass"), F.lit(0.0)).alias("p0"))
    edge = h.filter((F.col("mass_before") < F.col("limit_")) & (F.col("mass_before") + F.col("mass") >= F.col("limit_"))).select(F.col("score").alias("cut_"), "mass_before", "limit_", "all_mass", "all_pos")
    tied = df.join(F.broadcast(edge), F.col(score).cast("double") == F.col("cut_"))
    run = Window.partitionBy("cut_").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("b_", F.col("mass_before") + F.coalesce(F.sum(weight).over(run), F.lit(0.0))).filter(F.col("b_") < F.col("limit_"))
    got = tied.groupBy("all_mass", "all_pos").agg(F.count("*").alias("n1"), F.sum(weight).alias("m1"), F.sum(F.when(F.col(target), F.col(weight)).otherwise(0.0)).alias("p1"))
    mass, pos = F.col("m0") + F.col("m1"), F.col("p0") + F.col("p1")
    return got.join(F.broadcast(whole)).select(
        F.lit(fraction).alias("capacity_fraction"), (F.col("n0") + F.col("n1")).alias("selected_sample_rows"), mass.alias("selected_population_mass"), (pos / mass).alias("precision"),
        F.try_divide(pos, F.col("all_pos")).alias("recall"), F.try_divide(pos / mass, F.col("all_pos") / F.col("all_mass")).alias("lift"),
    )


SLICES = ("overall", "geography_development", "geography_holdout", "temporal_development", "temporal_holdout")


def slices(df: DataFrame, start: date, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """df once for each slice that a row is part of, with slice_name, slice_eligible and slice_target.

    The temporal holdout drops earlier positives from its risk set; the temporal
    development slice keeps later positives as negatives.
    """
    if remainder >= modulus:
        raise ContractError("the remainder must be below the modulus")
    state = F.coalesce("state_code", F.lit(""))
    held = bucket(state, modulus) == remainder
    hit, first = F.coalesce("observed_outcome", F.lit(False)), F.col("first_outcome_date")
    ok, later = F.col("evaluation_eligible"), F.coalesce(first >= F.lit(start), F.lit(False))
    one = lambda name, on, eligible, target: F.when(on, F.struct(F.lit(name).alias("slice_name"), eligible.alias("slice_eligible"), target.alias("slice_target")))
    parts = F.array(
        one("overall", F.lit(True), ok, hit), one("geography_development", (state != "") & ~held, ok, hit), one("geography_holdout", (state != "") & held, ok, hit),
        one("temporal_development", F.lit(True), ok, hit & F.coalesce(first < F.lit(start), F.lit(False))), one("temporal_holdout", F.lit(True), ok & (first.isNull() | later), hit & later),
    )
    return df.select("*", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("s_")).select("*", "s_.*").drop("s_")


def concentration(df: DataFrame, group: str, target: str) -> DataFrame:
    """Positive pairs within groups, what chance expects, and their ratio."""
    g = df.filter(F.coalesce(group, F.lit("")) != "").groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(target)).alias("k"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    t = g.agg(F.sum("n").alias("grouped_population_rows"), F.count("*").alias("group_rows"), F.sum("k").alias("positive_rows"), pairs("k").alias("observed_positive_pairs"), pairs("n").alias("_possible"))
    n, k = F.col("grouped_population_rows").cast("double"), F.col("positive_rows").cast("double")
    expected = F.coalesce(F.try_divide(F.col("_possible") * (k * (k - 1) / 2), n * (n - 1) / 2), F.lit(0.0))
    t = t.withColumn("expected_positive_pairs", expected).withColumn("concentration_ratio", F.when(F.col("expected_positive_pairs") > 0, F.col("observed_positive_pairs") / F.col("expected_positive_pairs")))
    status = F.when(F.coalesce("grouped_population_rows", F.lit(0)) == 0, "empty_grouped_population").when((k < 2) | (F.col("_possible") == 0), "insufficient_positive_pairs").otherwise("passed")
    return t.withColumn("test_status", status).drop("_possible")


def concentration_p_value(df: DataFrame, group: str, target: str, simulations: int = 500, seed: int = 106) -> DataFrame:
    """Monte-Carlo p-value of the positive pairs: 1 + how many simulations reach them, over 1 + simulations.

    A simulation needs group sizes only, as their histogram: groups of one size are
    alike.  Each has a random stream of its own, so results don't depend on layout.
    """
    if simulations < 100:
        raise ContractError("at least 100 simulations are needed")
    spark = df.sparkSession
    sizes = df.filter(F.coalesce(group, F.lit("")) != "").groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(target)).alias("k"))
    seen = sizes.agg(F.sum("k"), F.sum(F.col("k") * (F.col("k") - 1) / 2), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    positives, observed = int(seen[0] or 0), int(seen[1] or 0)
    kinds = [(int(r.n), int(r["count"])) for r in sizes.groupBy("n").count().orderBy("n").collect()]
    if positives < 2 or not seen[2]:
        return spark.createDataFrame([(observed, 0, None)], "observed_positive_pairs long, null_simulations long, p_value double")

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            hits = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                per_kind = rng.multivariate_hypergeometric([n * c for n, c in kinds], positives, method="marginals")
                pairs = 0
                for (n, c), k in zip(kinds, per_kind.tolist(), strict=True):
                    at = rng.choice(n * c, size=k, replace=False, shuffle=False) // n
                    counts = np.bincount(at, minlength=1)
                    pairs += int((counts * (counts - 1) // 2).sum())
                hits.append(pairs >= observed)
            yield pd.DataFrame({"hit": hits})

    got = spark.range(simulations).mapInPandas(run, "hit boolean")
    return got.agg(F.lit(observed).cast("long").alias("observed_positive_pairs"), F.count("*").alias("null_simulations"), ((F.count_if("hit") + 1) / (F.count("*") + 1)).alias("p_value"))


def slice_metrics(df: DataFrame, column: str, score: str, target: str, refuse_flat: bool = False) -> DataFrame:
    """Rows, positives, base rate and average precision by a column, null as "None"; a flat group is an error if asked."""
    named = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("None")))
    g = named.groupBy(column).agg(F.count("*").alias("rows"), F.count_if(F.col(target)).alias("positive_rows"))
    if refuse_flat and (bad := g.filter("positive_rows = 0 or positive_rows = rows").limit(1).collect()):
        raise ContractError(f"not evaluable: {bad[0][0]}")
    ap = average_precision(histogram(named, score, target, (column,)), (column,))
    return g.join(ap, column).select(column, "rows", "positive_rows", (F.col("positive_rows") / F.col("rows")).alias("base_rate"), "average_precision")


def signal_report(df: DataFrame, signal: str, score: str, target: str, eligible: str, capacity: float = 0.1, cost: float = 500.0, slice_name: str = "overall") -> dict:
    """Everything known of a signal on a slice: counts, rates with intervals, average precision, the review queue and its cost.

    Two jobs: the counts, and the score histogram that the curve and the queue share.
    """
    e = df.filter(F.col(eligible)).select(F.col(score).cast("double").alias("score"), F.col(signal).cast("boolean").alias("signal"), F.col(target).cast("boolean").alias("target"))
    counts = confusion(e, "signal", "target")
    c = counts.crossJoin(e.agg(F.count_if(F.col("score").isNull()).alias("null_scores"))).first().asDict()
    out = {"slice_name": slice_name, "signal_name": signal, "requested_review_capacity": capacity, "review_cost_per_false_positive": cost}
    if not c["population_rows"]:
        return out | {k: 0 for k in c if k.endswith("_rows")} | {"false_positive_review_cost": 0.0, "metric_status": "empty_evaluation_slice"}
    if c.pop("null_scores"):
        raise ContractError("scores cannot be null")
    hist = histogram(e, "score", "target")
    queue = capacity_with_ties(hist, capacity).crossJoin(average_precision(hist)).first().asDict()
    intervals = {"base_rate_interval": (c["positive_rows"], c["population_rows"]), "precision_interval": (c["true_positive_rows"], c["flagged_rows"]), "recall_interval": (c["true_positive_rows"], c["positive_rows"])}
    lift = queue["review_precision"] / c["base_rate"] if c["base_rate"] else None
    return out | c | queue | {k: wilson_interval(*v) for k, v in intervals.items()} | {
        "review_lift": lift, "false_positive_review_cost": c["false_positive_rows"] * cost,
        "metric_status": "passed" if c["positive_rows"] and c["flagged_rows"] else "insufficient_positive_or_flagged_rows",
    }


def evaluation_report(observations: DataFrame, units: dict[str, dict], start: date, modulus: int = 5, remainder: int = 0, simulations: int = 500, **how) -> dict:
    """Metrics and concentration of each unit {name: {signal, score, group}} on all five slices, and the held-out states."""
    sliced = slices(observations, start, modulus, remainder)
    states = [r[0] for r in observations.select("state_code").distinct().filter(F.coalesce("state_code", F.lit("")) != "").filter(bucket(F.col("state_code"), modulus) == remainder).orderBy("state_code").collect()]
    out: dict = {"holdout_states": states, "units": {}}
    for name, u in units.items():
        out["units"][name] = {}
        for s in SLICES:
            part = sliced.filter(F.col("slice_name") == s)
            m = signal_report(part, u["signal"], u["score"], "slice_target", "slice_eligible", slice_name=s, **how)
            p = concentration_p_value(part.filter("slice_eligible"), u["group"], "slice_target", simulations).first()
            out["units"][name][s] = m | {"p_value": p.p_value, "null_simulations": p.null_simulations}
    return out
