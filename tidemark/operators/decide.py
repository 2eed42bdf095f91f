"""Deterministic decisions from reports: verdicts, readiness, bands, confidence.  Pure functions on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import ContractError

REQUIRED_SLICES = ("geography_holdout", "overall", "temporal_holdout")
MIN_POSITIVES = 20


@dataclass(frozen=True)
class SliceEvidence:
    """What a verdict needs of a signal on a slice; intervals are (low, high)."""

    precision_interval: tuple[float, float] | None
    base_rate_interval: tuple[float, float] | None
    requested_capacity: float
    realized_capacity: float | None
    false_positive_cost: float
    p_value: float | None
    tested: bool = True


@dataclass(frozen=True)
class Thresholds:
    least_conservative_lift: float = 1.25
    most_capacity_expansion: float = 2.0
    cost_budget: float = 1_000_000.0
    most_p_value: float = 0.05


@dataclass(frozen=True)
class UnitEvidence:
    passed: bool
    failed: tuple[str, ...]
    lifts: dict[str, float | None] = field(default_factory=dict)


def conservative_lift(e: SliceEvidence) -> float | None:
    """Lower bound of precision over upper bound of the base rate."""
    if e.precision_interval is None or e.base_rate_interval is None or not e.base_rate_interval[1]:
        return None
    return e.precision_interval[0] / e.base_rate_interval[1]


def judge_unit(evidence: dict[str, SliceEvidence], t: Thresholds) -> UnitEvidence:
    failed, lifts = [], {}
    for name in REQUIRED_SLICES:
        e = evidence.get(name)
        lift = lifts[name] = None if e is None else conservative_lift(e)
        if e is None:
            failed.append(f"{name}:missing_metric")
            continue
        checks = (
            ("missing_confidence_interval", lift is None),
            ("conservative_lift_below_threshold", lift is not None and lift < t.least_conservative_lift),
            ("missing_review_capacity", e.realized_capacity is None),
            ("review_capacity_tie_expansion", e.realized_capacity is not None and e.realized_capacity > e.requested_capacity * t.most_capacity_expansion),
            ("false_positive_cost_over_budget", e.false_positive_cost > t.cost_budget),
            ("missing_concentration_test", not e.tested),
            ("insufficient_concentration_evidence", e.tested and e.p_value is None),
            ("concentration_not_significant", e.tested and e.p_value is not None and e.p_value > t.most_p_value),
        )
        failed += [f"{name}:{code}" for code, wrong in checks if wrong]
    return UnitEvidence(not failed, tuple(failed), lifts)


def verdict(address: dict[str, SliceEvidence], cohort: dict[str, SliceEvidence], ready: bool, t: Thresholds = Thresholds()) -> tuple[str, str | None, tuple[str, ...]]:  # noqa: B008
    """(SHIP, RE_UNIT or DO_NOT_SHIP, chosen signal, reasons); the address unit wins over the cohort."""
    if not ready:
        return "DO_NOT_SHIP", None, ("insufficient_held_out_positive_outcomes",)
    if judge_unit(address, t).passed:
        return "SHIP", "shared_address", ("shared_address_passed_all_required_slices",)
    if judge_unit(cohort, t).passed:
        return "RE_UNIT", "address_registration_month_cohort", ("entity_signal_failed", "cohort_signal_passed_all_required_slices")
    return "DO_NOT_SHIP", None, ("no_signal_unit_passed_all_required_slices",)


def evidence_ready(positives: dict[str, int], holdout_states: int, least: int = MIN_POSITIVES) -> bool:
    """Enough positives in each required slice, and at least one held-out state."""
    return holdout_states > 0 and all(positives.get(s, 0) >= least for s in REQUIRED_SLICES)


def training_decision(positives: int, least: int = MIN_POSITIVES) -> dict:
    ready = positives >= least
    reasons = ("held_out_evaluation_required",) if ready else ("insufficient_overall_positive_outcomes", "human_linkage_review_incomplete", "held_out_slices_not_evaluable")
    return {"decision": "TRAIN" if ready else "DO_NOT_TRAIN", "shortfall": max(least - positives, 0), "reason_codes": reasons}


def ready_to_train(overall: int, geography: int, temporal: int, least: int = MIN_POSITIVES) -> bool:
    return min(overall, geography, temporal) >= least


def coverage(accepted_exact: int, pending: int, ambiguous: int, unmatched: int) -> dict:
    total = accepted_exact + pending + ambiguous + unmatched
    return {"exact_cin_coverage_rate": accepted_exact / total if total else 0.0, "human_review_required": pending > 0 or ambiguous > 0}


@dataclass(frozen=True)
class Bands:
    """Band names in falling order with the least score of each; the last catches the rest."""

    thresholds: tuple[tuple[str, float], ...]
    rest: str = "LOW_SIGNAL"

    def __post_init__(self):
        values = [v for _, v in self.thresholds]
        if any(a <= b for a, b in zip(values, values[1:], strict=False)):
            raise ContractError("band thresholds must fall strictly")

    def of(self, score: float) -> str:
        if not 0 <= score <= 1 or math.isnan(score):
            raise ContractError("scores must lie in [0, 1]")
        return next((name for name, least in self.thresholds if score >= least), self.rest)

    def column(self, score: Column) -> Column:
        """The band as a Column; a score outside [0, 1] or null raises."""
        out = F.when(score.isNull() | F.isnan(score) | ~score.between(0.0, 1.0), F.raise_error(F.lit("scores must lie in [0, 1]")).cast("string"))
        for name, least in self.thresholds:
            out = out.when(score >= least, name)
        return out.otherwise(self.rest)


def confidence(method: str, cutoff: date, today: date, band_precision: float | None, most_days: int = 400) -> tuple[str, tuple[str, ...]]:
    """moderate for an exact identifier on a fresh snapshot in a measured band, else low with the reasons."""
    reasons = [r for r, wrong in (("name_match", method != "exact_cin"), ("old_snapshot", max(0, (today - cutoff).days) > most_days), ("unmeasured_band", band_precision is None)) if wrong]
    return ("low" if reasons else "moderate"), tuple(reasons)


def confidence_column(method: Column, stale: Column, measured: Column) -> Column:
    """confidence() as a Column: the level alone."""
    return F.when((method == "exact_cin") & ~stale & measured, "moderate").otherwise("low")


def factors(contributions: dict[str, float], most: int = 6) -> list[tuple[str, float, str]]:
    """The largest contributions by size; zeros go after the cut."""
    top = sorted(((k, v) for k, v in contributions.items() if k != "model_bias"), key=lambda x: -abs(x[1]))[:most]
    return [(k, v, "increases_risk" if v > 0 else "decreases_risk") for k, v in top if v]


def inr(value: float | None) -> str:
    return "not recorded" if value is None else f"INR {value:,.0f}"


def inr_column(value: Column) -> Column:
    """inr() as a Column."""
    return F.when(value.isNull(), "not recorded").otherwise(F.concat(F.lit("INR "), F.format_number(value, 0)))


def percent_column(value: Column) -> Column:
    """percent() as a Column."""
    return F.format_string("%.2f%%", value * 100)


def percent(value: float) -> str:
    return f"{value * 100:.2f}%"
