"""Conservative entity linkage: exact identifier, then strict name, then legal name; and the review loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded
from ..functions.names import legal_name, strict_name
from .checks import joined_one

METHODS = (("exact_cin", 1.0), ("strict_name", 0.9), ("legal_name", 0.8))
MAX_CANDIDATES = 25
REVIEW_SHOWN = 5


def prepared(companies: DataFrame) -> DataFrame:
    return companies.withColumns({"strict": strict_name(F.col("company_name")), "legal": legal_name(F.col("company_name"))})


def _tagged(cin: str, strict: str, legal: str) -> Column:
    """The three keys with their kind, so a name never meets an identifier."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate((cin, strict, legal))])).alias("x")


def _company_keys(companies: DataFrame) -> DataFrame:
    """(company, k, v) of prepared companies; blank keys go before any join, so they never multiply."""
    return companies.select("company_snapshot_id", "cin", "company_name", _tagged("cin", "strict", "legal")).select("company_snapshot_id", "cin", "company_name", "x.*").filter("v <> ''")


def _event_keys(events: DataFrame) -> DataFrame:
    return events.select("adverse_event_id", _tagged("cin_candidate", "entity_name_normalized_strict", "entity_name_normalized_legal")).select("adverse_event_id", "x.*").filter("v <> ''")


def prefilter(companies: DataFrame, events: DataFrame) -> DataFrame:
    """Prepared companies that any event could match by any key: one semi-join on distinct keys."""
    keys = _event_keys(events).select("k", "v").distinct()
    hits = _company_keys(companies).join(keys, ["k", "v"], "left_semi").select("company_snapshot_id").distinct()
    return companies.join(hits, "company_snapshot_id", "left_semi")


def candidates(companies: DataFrame, events: DataFrame) -> DataFrame:
    """The cascade: an event that an identifier matches skips names, one that a strict name matches skips legal names.

    A semi-join on the companies' distinct keys tells each event's first kind of key
    that matches anything; only that key is then joined.  Companies are counted and ranked
    within their key first, so an event meets at most MAX_CANDIDATES of them however many
    share its name; Spark limits each group as it sorts.
    """
    own = _company_keys(prepared(companies))
    first = _event_keys(events).join(own.select("k", "v").distinct(), ["k", "v"], "left_semi").groupBy("adverse_event_id").agg(F.min(F.struct("k", "v")).alias("x")).select("adverse_event_id", "x.*")
    counts = own.groupBy("k", "v").agg(F.count("*").cast("int").alias("candidate_count"))
    rank = F.row_number().over(Window.partitionBy("k", "v").orderBy("company_snapshot_id"))
    shown = own.withColumn("candidate_rank", rank).filter(F.col("candidate_rank") <= MAX_CANDIDATES).join(counts, ["k", "v"])
    top = first.join(shown, ["k", "v"])
    method, score = (F.element_at(F.array(*[F.lit(m[i]) for m in METHODS]), F.col("k") + 1) for i in range(2))
    return top.select(
        F.concat("adverse_event_id", F.lit(":"), method, F.lit(":"), "company_snapshot_id").alias("entity_match_candidate_id"), "adverse_event_id", "company_snapshot_id", F.col("cin").alias("company_cin"), "company_name",
        method.alias("match_method"), score.alias("match_score"), "candidate_rank", "candidate_count", (F.col("candidate_count") > MAX_CANDIDATES).alias("candidate_set_truncated"),
    )


def decisions(events: DataFrame, found: DataFrame) -> DataFrame:
    """One row an event; several candidates are ambiguous whatever the method, and only a single exact identifier is eligible."""
    summary = found.groupBy("adverse_event_id").agg(
        F.first("match_method").alias("match_method"), F.max("candidate_count").alias("candidate_count"), F.min_by("company_snapshot_id", "candidate_rank").alias("first_company"),
    )
    j = events.select("adverse_event_id").join(summary, "adverse_event_id", "left")
    n = F.coalesce("candidate_count", F.lit(0))
    status = F.when(n == 0, "unmatched").when(n > 1, "ambiguous").when(F.col("match_method") == "exact_cin", "accepted").otherwise("pending_review")
    return j.select(
        "adverse_event_id", status.alias("review_status"), "match_method", n.cast("int").alias("candidate_count"),
        F.when(n == 1, F.col("first_company")).alias("proposed_company_snapshot_id"), F.when(status == "accepted", F.col("first_company")).alias("accepted_company_snapshot_id"),
        (status == "accepted").alias("outcome_eligible"),
    )


def review_sample(found: DataFrame, decided: DataFrame, sizes: dict[str, int], seed: int = 106) -> DataFrame:
    """Events per stratum in hash order, with the first REVIEW_SHOWN candidates of each."""
    stratum = F.when(F.col("review_status") == "accepted", "identifier_audit").when(F.col("review_status") == "ambiguous", "ambiguous").when(F.col("review_status") == "pending_review", F.concat(F.lit("pending_"), "match_method"))
    of = decided.select("adverse_event_id", stratum.alias("review_stratum")).filter("review_stratum is not null")
    limits = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy("review_stratum").orderBy(seeded(F.col("adverse_event_id"), seed), "adverse_event_id"))
    chosen = of.withColumn("r", rank).filter(F.col("r") <= F.coalesce(F.element_at(limits, F.col("review_stratum")), F.lit(0))).drop("r")
    shown = found.filter(F.col("candidate_rank") <= REVIEW_SHOWN)
    return shown.join(chosen, "adverse_event_id").select(
        F.concat("review_stratum", F.lit(":"), "entity_match_candidate_id").alias("linkage_review_row_id"), "adverse_event_id", "review_stratum", "company_snapshot_id", "match_method", "candidate_rank", "candidate_set_truncated",
    )


def strata(reviews: DataFrame) -> DataFrame:
    """Events and rows of each stratum of a review sample."""
    return reviews.groupBy("review_stratum").agg(F.count_distinct("adverse_event_id").alias("events"), F.count("*").alias("rows"))


def with_payload(reviews: DataFrame, events: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Review rows with what reviewers need of their event; an event that stands twice raises."""
    return joined_one(reviews, events.select("adverse_event_id", *columns), "adverse_event_id")


def report(decided: DataFrame) -> DataFrame:
    """Counters of decisions, their coverage, and whether people must look; one row from one pass."""
    n = lambda s: F.count_if(F.col("review_status") == s)
    got = decided.agg(F.count("*").alias("event_rows"), *[n(s).alias(f"{k}_rows") for k, s in (("accepted", "accepted"), ("pending", "pending_review"), ("ambiguous", "ambiguous"), ("unmatched", "unmatched"))])
    rate = F.coalesce(F.try_divide(F.col("accepted_rows").cast("double"), F.col("event_rows").cast("double")), F.lit(0.0))
    return got.withColumns({"exact_cin_coverage_rate": rate, "human_review_required": F.col("pending_rows") + F.col("ambiguous_rows") > 0})


def apply_reviews(reviews: DataFrame) -> DataFrame:
    """One MATCH, all others NO_MATCH and nothing cut off: accepted; all NO_MATCH: rejected; else unresolved."""
    said = lambda v: F.count_if(F.upper(F.trim(F.coalesce("review_decision", F.lit("")))) == v)
    g = reviews.groupBy("adverse_event_id").agg(
        F.count("*").alias("shown"), said("MATCH").alias("yes"), said("NO_MATCH").alias("no"), F.bool_or("candidate_set_truncated").alias("cut"), F.first("review_stratum").alias("review_stratum"),
        F.max(F.when(F.upper(F.trim("review_decision")) == "MATCH", F.col("company_snapshot_id"))).alias("matched"), F.first("match_method").alias("match_method"),
    )
    accepted = (F.col("yes") == 1) & (F.col("no") == F.col("shown") - 1) & ~F.col("cut")
    rejected = F.col("no") == F.col("shown")
    return g.select(
        "adverse_event_id", F.when(accepted, "accepted_reviewed").when(rejected, "rejected_reviewed").otherwise("unresolved").alias("review_status"),
        F.when(accepted, F.col("matched")).alias("accepted_company_snapshot_id"), F.when(accepted, F.concat(F.lit("reviewed_"), "match_method")).alias("match_method"),
        F.col("shown").alias("candidate_count"), accepted.alias("outcome_eligible"), (rejected & (F.col("review_stratum") == "identifier_audit")).alias("audit_discrepancy"),
    )


def tampered(original: DataFrame, submitted: DataFrame, key: str, protected: list[str]) -> DataFrame:
    """Rows whose protected columns differ, and rows on one side only."""
    j = original.alias("o").join(submitted.alias("s"), F.col(f"o.{key}") == F.col(f"s.{key}"), "full")
    differ = F.filter(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")), F.lit(c)) for c in protected]), lambda x: x.isNotNull())
    lone = F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"s.{key}").isNull(), "removed").otherwise("edited")
    return j.select(F.coalesce(f"o.{key}", f"s.{key}").alias(key), lone.alias("change"), differ.alias("columns")).filter((F.col("change") != "edited") | (F.size("columns") > 0))
