"""Splits, samples, features, preprocessing and a boosted-tree scorer."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket, seeded
from .checks import ContractError

# Held-out states, and the names of features and feature sets.
HELD_STATES = ("karnataka", "kerala", "tamil nadu", "telangana")
UNKNOWN = "UNKNOWN"
#: Share of the validation population whose precision decides between candidates of equal average precision.
SELECTION_CAPACITY = 0.001

NUMERIC = ("company_age_years", "paid_to_authorised_capital_ratio", "log_shared_address_company_count", "log_address_registration_month_company_count", "log_authorised_capital_inr", "log_paid_up_capital_inr")
CATEGORICAL = ("state_code", "roc_code", "company_category", "company_subcategory", "company_class", "listing_status", "company_origin", "nic_division")
STATUS = ("company_status",)
EXPANDED_NUMERIC = (
    "address_cluster_registration_span_days", "address_cluster_registration_month_entropy", "address_cluster_max_month_share", "address_cluster_nic_division_distinct", "address_cluster_authorised_capital_cv",
    "address_cluster_distinct_name_head_ratio", "log_registrar_year_cohort_company_count", "log_address_cluster_cohort_peer_count", "address_cluster_roc_serial_min_gap", "cin_record_disagreement_count",
)
EXPANDED_FLAGS = ("cin_year_disagrees_with_record", "cin_nic_division_disagrees_with_record", "cin_listing_disagrees_with_record", "cin_state_disagrees_with_record")
FEATURE_SETS = {
    "baseline_with_status": (NUMERIC, (*STATUS, *CATEGORICAL)),
    "baseline_no_status": (NUMERIC, CATEGORICAL),
    "expanded_no_status": ((*NUMERIC, *EXPANDED_NUMERIC), (*CATEGORICAL, *EXPANDED_FLAGS)),
}


def feature_set(name: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    if name not in FEATURE_SETS:
        raise ContractError(f"unknown feature set {name}; there are {', '.join(sorted(FEATURE_SETS))}")
    return FEATURE_SETS[name]


def _log1p(name: str) -> Column:
    return F.log1p(F.col(name).cast("double")).cast("float").alias(f"log_{name}")


def baseline_features() -> list[Column]:
    """Used alike for training and for serving; logs are taken in double, then narrowed."""
    return [
        (F.col("company_age_days") / 365.25).cast("float").alias("company_age_years"),
        F.greatest(F.least("paid_to_authorised_capital_ratio", F.lit(10.0)), F.lit(0.0)).cast("float").alias("paid_to_authorised_capital_ratio"),
        _log1p("shared_address_company_count"), _log1p("address_registration_month_company_count"),
        *[F.col(c).cast("float").alias(c) for c in ("log_authorised_capital_inr", "log_paid_up_capital_inr")],
        *[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in (*STATUS, *CATEGORICAL)],
    ]


def expanded_features() -> list[Column]:
    plain = [F.col(c).cast("float").alias(c) for c in EXPANDED_NUMERIC if not c.startswith("log_")]
    return [*plain, _log1p("registrar_year_cohort_company_count"), _log1p("address_cluster_cohort_peer_count"), *[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in EXPANDED_FLAGS]]


def split(validation_start: date, temporal_start: date, seed: int = 106, temporal_percent: int = 15, validation_percent: int = 15) -> Column:
    """Geography first, then the event's time for positives, then a hash bucket for the rest."""
    hit, when = F.col("observed_outcome"), F.col("first_outcome_date")
    b = bucket(F.concat(F.lit(f"{seed}:"), "company_snapshot_id"), 100)
    return (
        F.when(F.col("state_code").isin(*HELD_STATES), "geography_test").when(hit & (when >= F.lit(temporal_start)), "temporal_test").when(hit & (when >= F.lit(validation_start)), "validation")
        .when(hit, "training").when(b < temporal_percent, "temporal_test").when(b < temporal_percent + validation_percent, "validation").otherwise("training")
    )


def model_data(observations: DataFrame, validation_start: date, temporal_start: date, expanded: bool = False, **how) -> DataFrame:
    return observations.filter("evaluation_eligible").select(
        "company_snapshot_id", "cin", split(validation_start, temporal_start, **how).alias("dataset_split"), F.col("observed_outcome").cast("tinyint").alias("target"), "first_outcome_date",
        *baseline_features(), *(expanded_features() if expanded else []),
    )


def split_evidence(data: DataFrame) -> DataFrame:
    return data.groupBy("dataset_split").agg(F.count("*").alias("rows"), F.sum("target").cast("long").alias("positive_rows"), (F.sum("target") / F.count("*")).alias("positive_rate"))


def negatives_to_take(data: DataFrame, most: dict[str, int], share: int) -> dict[str, int]:
    """Negatives of each split to sample: one in `share`, and at most as many as a fit is meant to have."""
    found = {r.dataset_split: r.n for r in data.filter(F.col("dataset_split").isin(*most) & (F.col("target") == 0)).groupBy("dataset_split").agg(F.count("*").alias("n")).collect()}
    return {s: min(n, -(-found.get(s, 0) // share)) for s, n in most.items()}


def fit_sample(data: DataFrame, negatives: dict[str, int], seed: int = 106) -> DataFrame:
    """All positives and the first negatives in hash order of the sampled splits, with the weight that restores the population."""
    rows = data.filter(F.col("dataset_split").isin(*negatives))
    pos = rows.filter("target = 1").withColumn("sample_weight", F.lit(1.0))
    neg = rows.filter("target = 0")
    limits = F.create_map(*[F.lit(x) for kv in negatives.items() for x in kv])
    want = F.element_at(limits, F.col("dataset_split"))
    full = neg.groupBy("dataset_split").agg(F.count("*").alias("full_"))
    found = {r.dataset_split: r.full_ for r in full.collect()}
    if short := sorted(s for s, n in negatives.items() if found.get(s, 0) < n):
        raise ContractError(f"too few negatives: {', '.join(short)}")
    rank = F.row_number().over(Window.partitionBy("dataset_split").orderBy(seeded(F.col("company_snapshot_id"), seed), "company_snapshot_id"))
    top = neg.withColumn("r_", rank).filter(F.col("r_") <= want).drop("r_").join(F.broadcast(full), "dataset_split")
    return pos.unionByName(top.withColumn("sample_weight", F.col("full_") / want).drop("full_"))


@dataclass(frozen=True)
class Preprocessor:
    """Median and most-frequent imputation, and one-hot with a column for infrequent categories; plain data, kept as JSON."""

    medians: dict[str, float]
    modes: dict[str, str]
    categories: dict[str, list[str]]
    infrequent: dict[str, list[str]]

    @staticmethod
    def fit(df: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...], least: int = 10) -> Preprocessor:
        med = df.agg(*[F.median(F.col(c).cast("double")).alias(c) for c in numeric]).first().asDict() if numeric else {}
        if gone := [c for c, v in med.items() if v is None]:
            raise ContractError(f"no value to impute: {', '.join(gone)}")
        modes, cats, rare = {}, {}, {}
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical])).alias("x")).select("x.*")
        counts: dict[str, list[tuple[str, int]]] = {c: [] for c in categorical}
        missing = dict.fromkeys(categorical, 0)
        for r in long.groupBy("c", "v").count().collect():
            if r.v is None:
                missing[r.c] = r["count"]
            else:
                counts[r.c].append((r.v, r["count"]))
        for c, found in counts.items():
            modes[c] = min(found, key=lambda x: (-x[1], x[0]))[0] if found else UNKNOWN
            n = dict(found) or {UNKNOWN: 0}
            n[modes[c]] += missing[c]
            cats[c], rare[c] = sorted(v for v, k in n.items() if k >= least), sorted(v for v, k in n.items() if k < least)
        return Preprocessor(med, modes, cats, rare)

    def names(self) -> list[str]:
        return [*self.medians, *[f"{c}={v}" for c in self.categories for v in self.categories[c]], *[f"{c}=<infrequent>" for c in self.categories if self.infrequent[c]]]

    def columns(self) -> list[Column]:
        """names() as Columns; unseen categories are zero everywhere, infinities raise."""
        wrong = F.raise_error(F.lit("features must be finite")).cast("double")
        num = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.medians.items()}
        out = [F.when(F.isnan(v) | (F.abs(v) == float("inf")), wrong).otherwise(v) for v in num.values()]
        filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(m)) for c, m in self.modes.items()}
        out += [(filled[c] == v).cast("double") for c in self.categories for v in self.categories[c]]
        out += [filled[c].isin(*self.infrequent[c]).cast("double") for c in self.categories if self.infrequent[c]]
        return [x.alias(n) for x, n in zip(out, self.names(), strict=True)]

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return df.select(*keep, *self.columns())

    def to_json(self) -> str:
        """The order of features is that of the matrix, so it is kept."""
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> Preprocessor:
        return Preprocessor(**json.loads(text))


def train_boosted(df: DataFrame, pre: Preprocessor, candidates: tuple[dict, ...] = ({"maxDepth": 3, "stepSize": 0.1}, {"maxDepth": 4, "stepSize": 0.1}), rounds: int = 20, seed: int = 106):
    """The candidate with the best (average precision, precision) on the validation split; early stop inside Spark's booster.

    The booster keeps only the trees up to the best validation round, so scoring never uses later ones.
    """
    from pyspark.ml.classification import GBTClassifier

    from .evaluate import average_precision, histogram, weighted_top

    matrix = assembled(df.filter(F.col("dataset_split").isin("training", "validation")), pre, ("company_snapshot_id", "target", "dataset_split", "sample_weight"))
    matrix = matrix.withColumns({"label": F.col("target").cast("double"), "held": F.col("dataset_split") == "validation"})
    best = None
    for params in candidates:
        model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="sample_weight", validationIndicatorCol="held", maxIter=rounds, seed=seed, **params).fit(matrix)
        held = scored(model, matrix.filter("held")).withColumn("hit", F.col("target") == 1)
        ap = average_precision(histogram(held, "score", "hit", weight=F.col("sample_weight"))).first()[0] or 0.0
        top = weighted_top(held, "score", "hit", "sample_weight", "company_snapshot_id", SELECTION_CAPACITY).first()
        rank = (ap, (top["precision"] if top else None) or 0.0)
        if best is None or rank > best[0]:
            best = (rank, model, params)
    return best[1], {"average_precision": best[0][0], "precision": best[0][1], "parameters": best[2]}


def assembled(df: DataFrame, pre: Preprocessor, keep: tuple[str, ...]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    plain = pre.transform(df, keep)
    names = {n: f"f{i}_" for i, n in enumerate(pre.names())}
    return VectorAssembler(inputCols=list(names.values()), outputCol="features").transform(plain.withColumnsRenamed(names)).drop(*names.values())


def scored(model, matrix: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(matrix).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def contributions(trees: list[dict], x, n_features: int):
    """Exact Shapley contributions of a sum of small trees, and the bias, by enumeration of each tree's own features.

    A tree node is {"f", "t", "l", "r"} or {"v", "n"}; n is the leaf's training weight,
    and an absent feature averages both branches by weight.
    """
    from itertools import combinations
    from math import factorial

    def weight(t: dict) -> float:
        return t["n"] if "v" in t else weight(t["l"]) + weight(t["r"])

    def value(t: dict, known: frozenset) -> float:
        if "v" in t:
            return t["v"]
        if t["f"] in known:
            return value(t["l"] if x[t["f"]] <= t["t"] else t["r"], known)
        a, b = weight(t["l"]), weight(t["r"])
        return (a * value(t["l"], known) + b * value(t["r"], known)) / (a + b)

    def used(t: dict) -> set:
        return set() if "v" in t else {t["f"]} | used(t["l"]) | used(t["r"])

    out, bias = [0.0] * n_features, 0.0
    for t in trees:
        own = sorted(used(t))
        bias += value(t, frozenset())
        for f in own:
            rest = [g for g in own if g != f]
            for k in range(len(rest) + 1):
                share = factorial(k) * factorial(len(own) - k - 1) / factorial(len(own))
                for s in combinations(rest, k):
                    out[f] += share * (value(t, frozenset((*s, f))) - value(t, frozenset(s)))
    return out, bias
