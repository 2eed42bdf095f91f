"""Outcome labels as of a cutoff: what happened before excludes, what happens in the closed window counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import joined_one


def prior(events: DataFrame, key: str, cutoff: date) -> DataFrame:
    return events.filter(F.col("event_date") <= F.lit(cutoff)).select(key).distinct().withColumn("has_prior_outcome", F.lit(True))


def window(events: DataFrame, key: str, start: date, end: date) -> DataFrame:
    """Count and first date of the outcomes from start to end, both included."""
    return events.filter(F.col("event_date").between(F.lit(start), F.lit(end))).groupBy(key).agg(F.count("*").cast("int").alias("outcome_count"), F.min("event_date").alias("first_outcome_date"))


def labelled(population: DataFrame, events: DataFrame, key: str, cutoff: date, start: date, end: date, only_cin: bool = False) -> DataFrame:
    """population with outcome columns and evaluation_eligible, which is never null."""
    j = population.join(prior(events, key, cutoff), key, "left").join(window(events, key, start, end), key, "left")
    j = j.withColumns({"has_prior_outcome": F.coalesce("has_prior_outcome", F.lit(False)), "outcome_count": F.coalesce("outcome_count", F.lit(0))})
    ok = F.col("legal_entity_identifier_is_valid_format") & F.col("registration_date").isNotNull() & (F.col("registration_date") <= F.lit(cutoff)) & ~F.col("has_prior_outcome")
    if only_cin:
        ok = (F.col("legal_entity_identifier_type") == "CIN") & ok
    return j.withColumns({"observed_outcome": F.col("outcome_count") > 0, "evaluation_eligible": F.coalesce(ok, F.lit(False))})


# Statuses that may count as outcomes, and what the labels then stand for.
REVIEWED, ELIGIBLE = "accepted_reviewed", ("accepted", "accepted_reviewed")
EXACT_ONLY, EXACT_OR_REVIEWED = "accepted_unique_exact_cin_only", "accepted_unique_exact_cin_or_completed_human_review"


def label_policy(decided: DataFrame) -> DataFrame:
    """One row: the policy that the eligible decisions stand for; a status that may not count raises when it is read."""
    status = F.when(F.col("outcome_eligible"), F.coalesce("review_status", F.lit("no status")))
    wrong = F.max(F.when(~status.isin(*ELIGIBLE), status))
    policy = F.when(F.bool_or(status == REVIEWED), EXACT_OR_REVIEWED).otherwise(EXACT_ONLY)
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("not an eligible status: "), wrong)).cast("string")).otherwise(policy)
    return decided.agg(checked.alias("label_match_policy"))


def accepted_events(decided: DataFrame, events: DataFrame) -> DataFrame:
    """(adverse_event_id, company_snapshot_id, event_date) of the eligible decisions; an event that stands twice on the right raises."""
    ok = decided.filter(F.col("outcome_eligible") & F.col("accepted_company_snapshot_id").isNotNull()).select("adverse_event_id", F.col("accepted_company_snapshot_id").alias("company_snapshot_id"))
    return joined_one(ok, events.select("adverse_event_id", "event_date"), "adverse_event_id", "inner")
