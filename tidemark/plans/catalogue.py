"""One query for each capability on the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identifiers
from ..functions.hashing import bucket
from ..functions.names import legal_name, strict_name
from ..operators import checks, evaluate, features, labels, linkage, model, serving
from ..operators.decide import Bands
from ..sources.artifacts import no_formula
from ..sources.readers import exploded_pages, tsv_events
from . import registry as reg
from .registry import CUTOFF, END, START, TEMPORAL_START, VALIDATION_START, adverse, outcomes, registry, tables, with_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def bigint(*names: str) -> dict:
    return {n: F.col(n).cast("bigint") for n in names}


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.bround(n, 6) for n in names})


# ---------------------------------------------------------------- contracts, identifiers, names

@query(f"""{with_sql()} SELECT count(*)::BIGINT AS row_count, (count(*) - count(DISTINCT legal_entity_identifier))::BIGINT AS duplicate_identifier_rows,
  (count(*) FILTER (coalesce(legal_entity_identifier, '') = ''))::BIGINT AS blank_identifier_rows, (count(*) FILTER (coalesce(company_name, '') = ''))::BIGINT AS blank_name_rows,
  (count(*) FILTER (registration_date IS NULL))::BIGINT AS missing_date_rows, (count(*) FILTER (coalesce(address_group_key, '') = ''))::BIGINT AS blank_address_rows,
  (count(*) FILTER (authorised_capital_inr IS NULL))::BIGINT AS missing_capital_rows FROM registry""")
def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.quality_audit(registry(spark, sf_dir))


@query(f"{with_sql()} SELECT company_snapshot_id, kind AS identifier_type, kind <> 'UNKNOWN' AS is_valid_format FROM registry")
def identifier_type_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select("company_snapshot_id", F.col("legal_entity_identifier_type").alias("identifier_type"), F.col("legal_entity_identifier_is_valid_format").alias("is_valid_format"))


STATE_SQL = "CASE substr(cin, 7, 2) WHEN 'MH' THEN 'maharashtra' WHEN 'DL' THEN 'delhi' WHEN 'KA' THEN 'karnataka' WHEN 'TN' THEN 'tamil nadu' ELSE CASE WHEN cin IS NOT NULL THEN 'UNKNOWN' END END"
DECODE_SQL = f"""substr(cin, 1, 1) AS cin_listing_letter, substr(cin, 1, 1) = 'L' AS cin_is_listed, substr(cin, 2, 5) AS cin_nic_code, substr(cin, 2, 2) AS cin_nic_division, substr(cin, 7, 2) AS cin_state_letters, {STATE_SQL} AS cin_state_name,
  substr(cin, 9, 4)::INT AS cin_incorporation_year, substr(cin, 13, 3) AS cin_ownership_class, substr(cin, 16, 6)::INT AS cin_roc_serial, substr(cin, 7, 2) || ':' || substr(cin, 9, 4) || ':' || substr(cin, 13, 3) AS cin_registrar_year_cohort_key"""


@query(f"{with_sql()} SELECT company_snapshot_id, {DECODE_SQL} FROM registry")
def identifier_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select("company_snapshot_id", *identifiers.decoded(F.col("legal_entity_identifier")))


DISAGREE_SQL = f"""CASE WHEN registration_date IS NOT NULL THEN substr(cin, 9, 4)::INT <> year(registration_date) END AS cin_year_disagrees_with_record,
  CASE WHEN regexp_full_match(substr(nic_code, 1, 2), '[0-9]{{2}}') THEN substr(cin, 2, 2) <> substr(nic_code, 1, 2) END AS cin_nic_division_disagrees_with_record,
  CASE lower(trim(listing_status)) WHEN 'listed' THEN substr(cin, 1, 1) <> 'L' WHEN 'unlisted' THEN substr(cin, 1, 1) = 'L' END AS cin_listing_disagrees_with_record,
  CASE WHEN {STATE_SQL} <> 'UNKNOWN' AND state_code <> '' THEN {STATE_SQL} <> state_code END AS cin_state_disagrees_with_record"""
DISAGREE_COUNT = "(coalesce(cin_year_disagrees_with_record, false)::INT + coalesce(cin_nic_division_disagrees_with_record, false)::INT + coalesce(cin_listing_disagrees_with_record, false)::INT + coalesce(cin_state_disagrees_with_record, false)::INT)::INT AS cin_record_disagreement_count"


@query(f"{with_sql()} SELECT *, {DISAGREE_COUNT} FROM (SELECT company_snapshot_id, {DISAGREE_SQL} FROM registry)")
def identifier_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return registry(spark, sf_dir).select("company_snapshot_id", *identifiers.disagreements(c("cin"), c("registration_date"), c("nic_code"), c("listing_status"), c("state_code")))


@query(f"SELECT p_partkey, {reg.strict_sql('p_name')} AS strict_name FROM part UNION ALL SELECT s_suppkey + 10000000, {reg.strict_sql('s_name')} FROM supplier")
def name_normalise_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "part", "supplier")
    return t["part"].select("p_partkey", strict_name(F.col("p_name")).alias("strict_name")).union(t["supplier"].select(F.col("s_suppkey") + 10_000_000, strict_name(F.col("s_name"))))


@query(f"{with_sql()} SELECT company_snapshot_id, {reg.legal_sql('company_name')} AS legal_name FROM registry")
def name_normalise_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select("company_snapshot_id", legal_name(F.col("company_name")).alias("legal_name"))


# ---------------------------------------------------------------- linkage

NAMED_SQL = f"named AS (SELECT *, {reg.strict_sql('company_name')} AS strict, {reg.legal_sql('company_name')} AS legal FROM registry)"


def _pair_sql(method: str, score: float, own: str, theirs: str, skip: str) -> str:
    return f"""SELECT a.adverse_event_id, n.company_snapshot_id, n.cin AS company_cin, n.company_name, '{method}' AS match_method, {score}::DOUBLE AS match_score,
      (row_number() OVER (PARTITION BY a.adverse_event_id ORDER BY n.company_snapshot_id))::INT AS candidate_rank, (count(*) OVER (PARTITION BY a.adverse_event_id))::INT AS candidate_count
      FROM adverse a JOIN named n ON a.{theirs} = n.{own} WHERE a.{theirs} <> '' {skip}"""


CANDIDATES_SQL = f"""{with_sql('adverse')}, {NAMED_SQL},
c1 AS ({_pair_sql('exact_cin', 1.0, 'cin', 'cin_candidate', '')}),
c2 AS ({_pair_sql('strict_name', 0.9, 'strict', 'strict', 'AND a.adverse_event_id NOT IN (SELECT adverse_event_id FROM c1)')}),
c3 AS ({_pair_sql('legal_name', 0.8, 'legal', 'legal', 'AND a.adverse_event_id NOT IN (SELECT adverse_event_id FROM c1) AND a.adverse_event_id NOT IN (SELECT adverse_event_id FROM c2)')}),
candidates AS (SELECT adverse_event_id || ':' || match_method || ':' || company_snapshot_id AS entity_match_candidate_id, *, candidate_count > 25 AS candidate_set_truncated
  FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) WHERE candidate_rank <= 25),
decisions AS (SELECT a.adverse_event_id, CASE WHEN s.n IS NULL THEN 'unmatched' WHEN s.n > 1 THEN 'ambiguous' WHEN s.m = 'exact_cin' THEN 'accepted' ELSE 'pending_review' END AS review_status, s.m AS match_method, coalesce(s.n, 0)::INT AS candidate_count,
  CASE WHEN s.n = 1 THEN s.f END AS proposed_company_snapshot_id, CASE WHEN s.n = 1 AND s.m = 'exact_cin' THEN s.f END AS accepted_company_snapshot_id, coalesce(s.n = 1 AND s.m = 'exact_cin', false) AS outcome_eligible
  FROM adverse a LEFT JOIN (SELECT adverse_event_id, max(candidate_count) AS n, min(match_method) AS m, min(company_snapshot_id) AS f FROM candidates GROUP BY 1) s USING (adverse_event_id))"""


@query(f"""{with_sql('adverse')}, {NAMED_SQL} SELECT company_snapshot_id FROM named n WHERE cin IN (SELECT cin_candidate FROM adverse WHERE cin_candidate <> '')
  OR (strict <> '' AND strict IN (SELECT strict FROM adverse)) OR (legal <> '' AND legal IN (SELECT legal FROM adverse))""")
def link_prefilter_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.prefilter(linkage.prepared(registry(spark, sf_dir)), adverse(spark, sf_dir)).select("company_snapshot_id")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.candidates(registry(spark, sf_dir), adverse(spark, sf_dir))


@query(f"{CANDIDATES_SQL} SELECT * FROM candidates")
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


@query(f"{CANDIDATES_SQL} SELECT * FROM decisions")
def link_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.decisions(adverse(spark, sf_dir), _candidates(spark, sf_dir))


SAMPLES = {"identifier_audit": 20, "ambiguous": 30, "pending_strict_name": 20, "pending_legal_name": 20}
REVIEW_SQL = f"""{CANDIDATES_SQL}, strata AS (SELECT adverse_event_id, CASE review_status WHEN 'accepted' THEN 'identifier_audit' WHEN 'ambiguous' THEN 'ambiguous' WHEN 'pending_review' THEN 'pending_' || match_method END AS review_stratum FROM decisions),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_stratum ORDER BY sha256('106:' || adverse_event_id), adverse_event_id) AS r FROM strata WHERE review_stratum IS NOT NULL)
  WHERE r <= CASE review_stratum WHEN 'ambiguous' THEN 30 ELSE 20 END),
review AS (SELECT review_stratum || ':' || entity_match_candidate_id AS linkage_review_row_id, adverse_event_id, review_stratum, company_snapshot_id, match_method, candidate_rank, candidate_set_truncated FROM candidates JOIN chosen USING (adverse_event_id) WHERE candidate_rank <= 5)"""


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _candidates(spark, sf_dir)
    return linkage.review_sample(found, linkage.decisions(adverse(spark, sf_dir), found), SAMPLES)


@query(f"{REVIEW_SQL} SELECT * FROM review")
def review_sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir)


#: Reviewers' answers for the catalogue: the first candidate of events ending in an even digit matches, and so on.
ANSWER = "CASE WHEN CAST(substr(adverse_event_id, -1) AS INT) % 5 = 4 THEN 'UNSURE' WHEN CAST(substr(adverse_event_id, -1) AS INT) % 2 = 0 AND candidate_rank = 1 THEN 'MATCH' ELSE 'NO_MATCH' END"


@query(f"""{REVIEW_SQL}, said AS (SELECT *, {ANSWER} AS d FROM review),
g AS (SELECT adverse_event_id, count(*) AS shown, count(*) FILTER (d = 'MATCH') AS yes, count(*) FILTER (d = 'NO_MATCH') AS no, bool_or(candidate_set_truncated) AS cut, max(company_snapshot_id) FILTER (d = 'MATCH') AS m, min(match_method) AS mm, min(review_stratum) AS rs FROM said GROUP BY 1)
SELECT adverse_event_id, CASE WHEN yes = 1 AND no = shown - 1 AND NOT cut THEN 'accepted_reviewed' WHEN no = shown THEN 'rejected_reviewed' ELSE 'unresolved' END AS review_status, CASE WHEN yes = 1 AND no = shown - 1 AND NOT cut THEN m END AS accepted_company_snapshot_id,
  CASE WHEN yes = 1 AND no = shown - 1 AND NOT cut THEN 'reviewed_' || mm END AS match_method, shown::BIGINT AS candidate_count, yes = 1 AND no = shown - 1 AND NOT cut AS outcome_eligible, no = shown AND rs = 'identifier_audit' AS audit_discrepancy FROM g""")
def review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.apply_reviews(_review(spark, sf_dir).withColumn("review_decision", F.expr(ANSWER)))


@query(f"{REVIEW_SQL} SELECT linkage_review_row_id, 'edited' AS change, 'company_snapshot_id' AS changed FROM review WHERE candidate_rank = 2")
def review_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _review(spark, sf_dir)
    back = sent.withColumn("company_snapshot_id", F.when(F.col("candidate_rank") == 2, F.lit("snap:0")).otherwise(F.col("company_snapshot_id")))
    wrong = linkage.tampered(sent, back, "linkage_review_row_id", ["adverse_event_id", "company_snapshot_id", "match_method"])
    return wrong.select("linkage_review_row_id", "change", F.array_join("columns", ",").alias("changed"))


# ---------------------------------------------------------------- features and labels

SHARED_SQL = "shared AS (SELECT *, CASE WHEN address_group_key <> '' THEN (count(*) OVER (PARTITION BY address_group_key))::INT ELSE 0 END AS shared_address_company_count FROM registry)"
COHORT_SQL = "cohort AS (SELECT *, CASE WHEN address_group_key <> '' AND registration_date IS NOT NULL THEN (count(*) OVER (PARTITION BY address_group_key, strftime(registration_date, '%Y-%m')))::INT ELSE 0 END AS address_registration_month_company_count FROM shared)"
CUT, ST, EN = f"DATE '{CUTOFF}'", f"DATE '{START}'", f"DATE '{END}'"
LABEL_SQL = f"""prior AS (SELECT DISTINCT company_snapshot_id FROM outcomes WHERE event_date <= {CUT}),
win AS (SELECT company_snapshot_id, count(*)::INT AS outcome_count, min(event_date) AS first_outcome_date FROM outcomes WHERE event_date BETWEEN {ST} AND {EN} GROUP BY 1),
obs AS (SELECT c.*, p.company_snapshot_id IS NOT NULL AS has_prior_outcome, coalesce(w.outcome_count, 0) AS outcome_count, w.first_outcome_date, coalesce(w.outcome_count, 0) > 0 AS observed_outcome,
  coalesce(kind <> 'UNKNOWN' AND registration_date IS NOT NULL AND registration_date <= {CUT} AND p.company_snapshot_id IS NULL, false) AS evaluation_eligible FROM cohort c LEFT JOIN prior p USING (company_snapshot_id) LEFT JOIN win w USING (company_snapshot_id))"""
OBS_SQL = f"{with_sql('outcomes')}, {SHARED_SQL}, {COHORT_SQL}, {LABEL_SQL}"


@query(f"{with_sql()}, {SHARED_SQL} SELECT company_snapshot_id, shared_address_company_count, shared_address_company_count > 1 AS shared_address_signal FROM shared")
def shared_address_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.shared_address(registry(spark, sf_dir)).select("company_snapshot_id", "shared_address_company_count", (F.col("shared_address_company_count") > 1).alias("shared_address_signal"))


@query(f"{with_sql()}, {SHARED_SQL}, {COHORT_SQL} SELECT company_snapshot_id, address_registration_month_company_count FROM cohort")
def cohort_month_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.month_cohort(registry(spark, sf_dir)).select("company_snapshot_id", "address_registration_month_company_count")


def observations(spark: SparkSession, sf_dir: str, literal: bool = False, only_cin: bool = False) -> DataFrame:
    months = features.month_cohort_literal if literal else features.month_cohort
    counted = months(features.shared_address(registry(spark, sf_dir)))
    return labels.labelled(counted, outcomes(spark, sf_dir), "company_snapshot_id", CUTOFF, START, END, only_cin)


@query(f"{OBS_SQL} SELECT company_snapshot_id, shared_address_company_count, address_registration_month_company_count, has_prior_outcome, outcome_count, first_outcome_date, observed_outcome, evaluation_eligible FROM obs")
def signal_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("company_snapshot_id", "shared_address_company_count", "address_registration_month_company_count", "has_prior_outcome", "outcome_count", "first_outcome_date", "observed_outcome", "evaluation_eligible")


MONTHS_SQL = "months AS (SELECT address_group_key, strftime(registration_date, '%Y-%m') AS m, count(*) AS n FROM registry WHERE address_group_key <> '' AND registration_date IS NOT NULL GROUP BY 1, 2), shares AS (SELECT *, n / sum(n) OVER (PARTITION BY address_group_key) AS p FROM months), ent AS (SELECT address_group_key, sum(n)::BIGINT AS dated, max(p) AS max_share, -sum(p * ln(p)) AS h FROM shares GROUP BY 1)"


@query(f"{with_sql()}, {MONTHS_SQL} SELECT address_group_key, dated AS dated_companies, round_even(max_share, 6) AS max_month_share, round_even(abs(h), 6) AS entropy_nats FROM ent")
def cluster_month_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(features.month_shape(registry(spark, sf_dir)), "max_month_share", "entropy_nats")


SHAPE_SQL = f"""{MONTHS_SQL}, heads AS (SELECT *, regexp_extract(lower(coalesce(company_name, '')), '([a-z0-9]+)', 1) AS head, substr(coalesce(nic_code, ''), 1, 2) AS division, authorised_capital_inr::DOUBLE AS cap FROM registry WHERE address_group_key <> ''),
shape AS (SELECT address_group_key, date_diff('day', min(registration_date), max(registration_date)) AS span, count(DISTINCT nullif(division, '')) AS divisions, avg(cap) AS cm, stddev_pop(cap) AS cs, count(DISTINCT nullif(head, '')) AS heads, count(*) FILTER (head <> '') AS named FROM heads GROUP BY 1),
shaped AS (SELECT r.company_snapshot_id, coalesce(s.span, 0)::INT AS address_cluster_registration_span_days, round_even(coalesce(CASE WHEN e.dated > 1 THEN abs(e.h / ln(e.dated)) ELSE 0.0 END, 0.0), 6) AS address_cluster_registration_month_entropy,
  round_even(coalesce(e.max_share, 1.0), 6) AS address_cluster_max_month_share, (CASE WHEN r.address_group_key <> '' THEN coalesce(s.divisions, 0) ELSE (substr(coalesce(nic_code, ''), 1, 2) <> '')::INT END)::INT AS address_cluster_nic_division_distinct,
  round_even(coalesce(CASE WHEN s.cm > 0 THEN s.cs / s.cm END, 0.0), 6) AS address_cluster_authorised_capital_cv, round_even(coalesce(CASE WHEN s.named > 0 THEN s.heads / s.named END, 1.0), 6) AS address_cluster_distinct_name_head_ratio
  FROM registry r LEFT JOIN shape s USING (address_group_key) LEFT JOIN ent e USING (address_group_key))"""
SHAPE = ["address_cluster_registration_span_days", "address_cluster_registration_month_entropy", "address_cluster_max_month_share", "address_cluster_nic_division_distinct", "address_cluster_authorised_capital_cv", "address_cluster_distinct_name_head_ratio"]


@query(f"{with_sql()}, {SHAPE_SQL} SELECT * FROM shaped")
def cluster_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_cluster_shape(registry(spark, sf_dir)).select("company_snapshot_id", *SHAPE)


ADJACENT_SQL = f"""decoded AS (SELECT company_snapshot_id AS id, address_group_key AS a, {DECODE_SQL} FROM registry),
sizes AS (SELECT cin_registrar_year_cohort_key AS k, count(*)::INT AS n FROM decoded WHERE cin_registrar_year_cohort_key IS NOT NULL GROUP BY 1),
gaps AS (SELECT id, (count(*) OVER w - 1)::INT AS peers, least(cin_roc_serial - lag(cin_roc_serial) OVER o, lead(cin_roc_serial) OVER o - cin_roc_serial) AS gap FROM decoded WHERE a <> '' AND cin_registrar_year_cohort_key IS NOT NULL
  WINDOW w AS (PARTITION BY a, cin_registrar_year_cohort_key), o AS (PARTITION BY a, cin_registrar_year_cohort_key ORDER BY cin_roc_serial, id)),
adjacent AS (SELECT d.id AS company_snapshot_id, coalesce(s.n, 0) AS registrar_year_cohort_company_count, coalesce(g.peers, 0) AS address_cluster_cohort_peer_count, coalesce(g.gap, -1)::INT AS address_cluster_roc_serial_min_gap FROM decoded d LEFT JOIN sizes s ON s.k = d.cin_registrar_year_cohort_key LEFT JOIN gaps g USING (id))"""
ADJACENT = ["registrar_year_cohort_company_count", "address_cluster_cohort_peer_count", "address_cluster_roc_serial_min_gap"]


@query(f"{with_sql()}, {ADJACENT_SQL} SELECT * FROM adjacent")
def serial_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registry(spark, sf_dir)
    return features.serial_adjacency(r.select("*", *identifiers.decoded(F.col("cin")))).select("company_snapshot_id", *ADJACENT)


def solvency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features and the label of every company."""
    f = features.company_features(observations(spark, sf_dir, literal=True, only_cin=True), CUTOFF)
    return features.serial_adjacency(features.with_cluster_shape(f))


SOLVENCY_SQL = f"""{with_sql('outcomes')}, {SHARED_SQL}, undated AS (SELECT count(*) FILTER (registration_date IS NULL)::INT AS n FROM registry),
cohort AS (SELECT s.*, CASE WHEN address_group_key = '' THEN 0 WHEN registration_date IS NULL THEN u.n ELSE (count(*) OVER (PARTITION BY address_group_key, strftime(registration_date, '%Y-%m')))::INT END AS address_registration_month_company_count FROM shared s CROSS JOIN undated u),
{LABEL_SQL.replace("kind <> 'UNKNOWN' AND", "kind = 'CIN' AND")}, {SHAPE_SQL}, {ADJACENT_SQL},
solv AS (SELECT o.*, date_diff('day', registration_date, {CUT})::INT AS company_age_days, substr(coalesce(nic_code, ''), 1, 2) AS nic_division, ln(1 + authorised_capital_inr::DOUBLE) AS log_authorised_capital_inr, ln(1 + paid_up_capital_inr::DOUBLE) AS log_paid_up_capital_inr,
  CASE WHEN authorised_capital_inr <> 0 THEN paid_up_capital_inr::DOUBLE / authorised_capital_inr::DOUBLE ELSE 0.0 END AS paid_to_authorised_capital_ratio, s.* EXCLUDE (company_snapshot_id), j.* EXCLUDE (company_snapshot_id), {DISAGREE_SQL}
  FROM obs o JOIN shaped s USING (company_snapshot_id) JOIN adjacent j USING (company_snapshot_id)),
solvency AS (SELECT *, {DISAGREE_COUNT} FROM solv)"""
SOLVENCY = ["company_snapshot_id", "company_age_days", "nic_division", "shared_address_company_count", "address_registration_month_company_count", *SHAPE, *ADJACENT, "cin_record_disagreement_count", "outcome_count", "observed_outcome", "has_prior_outcome", "evaluation_eligible"]


@query(f"""{SOLVENCY_SQL} SELECT {', '.join(SOLVENCY)}, round_even(log_authorised_capital_inr, 6) AS log_authorised_capital_inr, round_even(log_paid_up_capital_inr, 6) AS log_paid_up_capital_inr, round_even(paid_to_authorised_capital_ratio, 6) AS paid_to_authorised_capital_ratio FROM solvency""")
def solvency_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = ["log_authorised_capital_inr", "log_paid_up_capital_inr", "paid_to_authorised_capital_ratio"]
    return r6(solvency(spark, sf_dir).select(*SOLVENCY, *logs), *logs)


@query("""WITH e AS (SELECT event_id, user_id, value, epoch(ts)::BIGINT AS sec FROM events), w AS (SELECT *, count(*) OVER d1 AS n1, count(*) OVER d7 AS n7, count(*) OVER d30 AS n30, avg(value) OVER d1 AS m1, avg(value) OVER d7 AS m7, avg(value) OVER d30 AS m30 FROM e
  WINDOW d1 AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), d7 AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW), d30 AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW))
SELECT event_id, n1::BIGINT AS n_1d, n7::BIGINT AS n_7d, n30::BIGINT AS n_30d, round_even(value / (m1 + 0.001) + 1e-9, 6) AS amount_to_mean_1d, round_even(value / (m30 + 0.001) + 1e-9, 6) AS amount_to_mean_30d, round_even(n1 / (n7 + 0.001) + 1e-9, 6) AS count_1d_to_7d, round_even(greatest(m1, m7, m30) + 1e-9, 6) AS max_mean FROM w""")
def velocity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = features.velocity(tables(spark, sf_dir, "events")["events"])
    means = ["amount_to_mean_1d", "amount_to_mean_30d", "count_1d_to_7d", "max_mean"]
    # means of cents often end in exactly half a digit; the nudge takes that away from both sides' last bit
    return r6(v.select("event_id", "n_1d", "n_7d", "n_30d", *[(F.col(c) + 1e-9).alias(c) for c in means]), *means)


# ---------------------------------------------------------------- evaluation

def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).filter("evaluation_eligible")
    n = F.col("shared_address_company_count")
    return o.select("company_snapshot_id", "state_code", "company_status", "address_group_key", "observed_outcome", "first_outcome_date", "evaluation_eligible", n.alias("score"), (n > 14).alias("signal"), (n / 25.0).alias("probability"), F.when(F.col("observed_outcome"), 1.0).otherwise(2.5).alias("sample_weight"))


EVAL_SQL = f"{OBS_SQL}, ev AS (SELECT company_snapshot_id, state_code, company_status, address_group_key, observed_outcome AS y, first_outcome_date, evaluation_eligible, shared_address_company_count AS score, shared_address_company_count > 14 AS s, shared_address_company_count / 25.0::DOUBLE AS probability, CASE WHEN observed_outcome THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END AS wt FROM obs WHERE evaluation_eligible)"
CONF_SQL = "count(*)::BIGINT AS population_rows, (count(*) FILTER (y))::BIGINT AS positive_rows, (count(*) FILTER (s))::BIGINT AS flagged_rows, (count(*) FILTER (s AND y))::BIGINT AS true_positive_rows, (count(*) FILTER (s AND NOT y))::BIGINT AS false_positive_rows, (count(*) FILTER (NOT s AND y))::BIGINT AS false_negative_rows, (count(*) FILTER (NOT s AND NOT y))::BIGINT AS true_negative_rows"
RATIO_SQL = "round_even(positive_rows / population_rows, 6) AS base_rate, round_even(true_positive_rows / nullif(flagged_rows, 0), 6) AS precision, round_even(true_positive_rows / nullif(positive_rows, 0), 6) AS recall, round_even((true_positive_rows / nullif(flagged_rows, 0)) / nullif(positive_rows / population_rows, 0), 6) AS lift"


@query(f"{EVAL_SQL} SELECT *, {RATIO_SQL} FROM (SELECT {CONF_SQL} FROM ev)")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluate.confusion(_evaluated(spark, sf_dir), "signal", "observed_outcome"), "base_rate", "precision", "recall", "lift")


Z = "1.959963984540054::DOUBLE"


def _wilson_sql(k: str, n: str, sign: str) -> str:
    return f"({k} / {n}::DOUBLE + {Z} * {Z} / (2 * {n}) {sign} {Z} * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + {Z} * {Z} / (4.0 * {n} * {n}))) / (1 + {Z} * {Z} / {n})"


@query(f"{EVAL_SQL}, g AS (SELECT state_code, count(*) FILTER (y) AS k, count(*) AS n FROM ev GROUP BY 1) SELECT state_code, k::BIGINT AS positive_rows, n::BIGINT AS rows, round_even(greatest({_wilson_sql('k', 'n', '-')}, 0.0), 6) AS low, round_even(least({_wilson_sql('k', 'n', '+')}, 1.0), 6) AS high FROM g")
def eval_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _evaluated(spark, sf_dir).groupBy("state_code").agg(F.count_if("observed_outcome").alias("positive_rows"), F.count("*").alias("rows"))
    low, high = evaluate.wilson(F.col("positive_rows"), F.col("rows"))
    return r6(g.withColumns({"low": low, "high": high}), "low", "high")


@query(f"""{EVAL_SQL}, k AS (SELECT greatest(1, ceil(count(*) * 0.02)) AS k FROM ev), t AS (SELECT score AS t FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS r FROM ev) JOIN k ON r = k.k)
SELECT t::DOUBLE AS review_score_threshold, (count(*) FILTER (score >= t))::BIGINT AS reviewed_rows, (count(*) FILTER (score >= t AND y))::BIGINT AS reviewed_true_positive_rows, round_even(count(*) FILTER (score >= t) / count(*), 6) AS realized_review_capacity,
  round_even(count(*) FILTER (score >= t AND y) / count(*) FILTER (score >= t), 6) AS review_precision, round_even(count(*) FILTER (score >= t AND y) / count(*) FILTER (y), 6) AS review_recall FROM ev CROSS JOIN t GROUP BY t""")
def eval_review_capacity_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.capacity_with_ties(evaluate.histogram(_evaluated(spark, sf_dir), "score", "observed_outcome"), 0.02)
    return r6(got, "realized_review_capacity", "review_precision", "review_recall")


HIST_SQL = "h AS (SELECT score, count(*) AS n, count(*) FILTER (y) AS p FROM ev GROUP BY 1)"


@query(f"{EVAL_SQL}, {HIST_SQL}, c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM h) SELECT round_even(sum(p * tp / k) / sum(p), 6) AS average_precision FROM c")
def eval_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluate.average_precision(evaluate.histogram(_evaluated(spark, sf_dir), "score", "observed_outcome")), "average_precision")


@query(f"{EVAL_SQL} SELECT round_even(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 6) AS roc_auc FROM ev a JOIN ev b ON a.y AND NOT b.y")
def eval_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluate.roc_auc(evaluate.histogram(_evaluated(spark, sf_dir), "score", "observed_outcome")), "roc_auc")


@query(f"{EVAL_SQL} SELECT round_even(avg(power(probability - y::INT, 2)), 6) AS brier_score, round_even(sum(wt * power(probability - y::INT, 2)) / sum(wt), 6) AS weighted_brier_score FROM ev")
def eval_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evaluated(spark, sf_dir)
    return r6(evaluate.brier_pair(e, "probability", "observed_outcome", F.col("sample_weight")), "brier_score", "weighted_brier_score")


def _top_sql(f: float) -> str:
    return f"""SELECT {f}::DOUBLE AS capacity_fraction, k::BIGINT AS review_rows, min(score)::DOUBLE AS score_threshold, round_even(count(*) FILTER (y) / k, 6) AS precision, round_even(count(*) FILTER (y) / any_value(pos), 6) AS recall, round_even((count(*) FILTER (y) / k) / any_value(pos / n), 6) AS lift
    FROM (SELECT *, greatest(1, ceil(count(*) OVER () * {f})) AS k, row_number() OVER (ORDER BY score DESC, company_snapshot_id) AS r, count(*) FILTER (y) OVER () AS pos, count(*) OVER () AS n FROM ev) WHERE r <= k GROUP BY k"""


@query(f"{EVAL_SQL} " + " UNION ALL ".join(_top_sql(f) for f in (0.001, 0.005, 0.02)))
def eval_capacity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluate.strict_top(_evaluated(spark, sf_dir), "score", "observed_outcome", "company_snapshot_id", (0.001, 0.005, 0.02)), "precision", "recall", "lift")


@query(f"""{EVAL_SQL}, o AS (SELECT *, sum(wt) OVER (ORDER BY score DESC, company_snapshot_id ROWS UNBOUNDED PRECEDING) - wt AS b, sum(wt) OVER () AS m, sum(wt) FILTER (y) OVER () AS pm FROM ev), t AS (SELECT * FROM o WHERE b < m * 0.05)
SELECT 0.05::DOUBLE AS capacity_fraction, count(*)::BIGINT AS selected_sample_rows, sum(wt) AS selected_population_mass, round_even(coalesce(sum(wt) FILTER (y), 0) / sum(wt), 6) AS precision, round_even(coalesce(sum(wt) FILTER (y), 0) / any_value(pm), 6) AS recall, round_even((coalesce(sum(wt) FILTER (y), 0) / sum(wt)) / any_value(pm / m), 6) AS lift FROM t""")
def eval_weighted_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluate.weighted_top(_evaluated(spark, sf_dir), "score", "observed_outcome", "sample_weight", "company_snapshot_id", 0.05), "precision", "recall", "lift")


TS = f"DATE '{TEMPORAL_START}'"
HELD_SQL = "(('0x' || substr(sha256(state_code), 1, 16))::UBIGINT % 5 = 0)"


@query(f"""{OBS_SQL}, o AS (SELECT *, {HELD_SQL} AS held, coalesce(first_outcome_date >= {TS}, false) AS later, coalesce(first_outcome_date < {TS}, false) AS earlier FROM obs),
x AS (SELECT 'overall' AS slice_name, evaluation_eligible AS e, observed_outcome AS t FROM o UNION ALL SELECT 'geography_development', evaluation_eligible, observed_outcome FROM o WHERE state_code <> '' AND NOT held
  UNION ALL SELECT 'geography_holdout', evaluation_eligible, observed_outcome FROM o WHERE state_code <> '' AND held UNION ALL SELECT 'temporal_development', evaluation_eligible, observed_outcome AND earlier FROM o
  UNION ALL SELECT 'temporal_holdout', evaluation_eligible AND (first_outcome_date IS NULL OR later), observed_outcome AND later FROM o)
SELECT slice_name, count(*)::BIGINT AS rows, (count(*) FILTER (e))::BIGINT AS eligible_rows, (count(*) FILTER (e AND t))::BIGINT AS positive_rows FROM x GROUP BY 1""")
def eval_slices_geo_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.slices(observations(spark, sf_dir), TEMPORAL_START)
    return s.groupBy("slice_name").agg(F.count("*").alias("rows"), F.count_if("slice_eligible").alias("eligible_rows"), F.count_if(F.col("slice_eligible") & F.col("slice_target")).alias("positive_rows"))


def _slice_sql(c: str) -> str:
    return f"""{EVAL_SQL}, h AS (SELECT coalesce({c}, 'None') AS {c}, score, count(*) AS n, count(*) FILTER (y) AS p FROM ev GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM h WINDOW w AS (PARTITION BY {c} ORDER BY score DESC))
    SELECT {c}, sum(n)::BIGINT AS rows, sum(p)::BIGINT AS positive_rows, round_even(sum(p) / sum(n), 6) AS base_rate, round_even(sum(p * tp / k) / nullif(sum(p), 0), 6) AS average_precision FROM c GROUP BY 1"""


@query(_slice_sql("state_code"))
def state_slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluate.slice_metrics(_evaluated(spark, sf_dir), "state_code", "score", "observed_outcome"), "base_rate", "average_precision")


@query(_slice_sql("company_status"))
def status_slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluate.slice_metrics(_evaluated(spark, sf_dir), "company_status", "score", "observed_outcome"), "base_rate", "average_precision")


@query(f"""{EVAL_SQL}, g AS (SELECT address_group_key, count(*) AS n, count(*) FILTER (y) AS k FROM ev WHERE address_group_key <> '' GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS n, count(*) AS g, sum(k)::BIGINT AS k, sum(k * (k - 1) / 2)::DOUBLE AS o, sum(n * (n - 1) / 2)::DOUBLE AS q FROM g)
SELECT n AS grouped_population_rows, g::BIGINT AS group_rows, k AS positive_rows, o AS observed_positive_pairs, round_even(q * (k * (k - 1) / 2) / (n * (n - 1) / 2), 6) AS expected_positive_pairs, round_even(o / (q * (k * (k - 1) / 2) / (n * (n - 1) / 2)), 6) AS concentration_ratio, 'passed' AS test_status FROM t""")
def group_concentration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluate.concentration(_evaluated(spark, sf_dir), "address_group_key", "observed_outcome"), "expected_positive_pairs", "concentration_ratio")


@query()
def group_concentration_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.concentration_p_value(_evaluated(spark, sf_dir), "address_group_key", "observed_outcome")


# ---------------------------------------------------------------- modelling

SPLIT_SQL = f"""{SOLVENCY_SQL}, b AS (SELECT *, ('0x' || substr(sha256('106:' || company_snapshot_id), 1, 16))::UBIGINT % 100 AS bucket FROM solvency WHERE evaluation_eligible),
data AS (SELECT *, CASE WHEN state_code IN ('karnataka', 'kerala', 'tamil nadu', 'telangana') THEN 'geography_test' WHEN observed_outcome AND first_outcome_date >= {TS} THEN 'temporal_test' WHEN observed_outcome AND first_outcome_date >= DATE '{VALIDATION_START}' THEN 'validation'
  WHEN observed_outcome THEN 'training' WHEN bucket < 15 THEN 'temporal_test' WHEN bucket < 30 THEN 'validation' ELSE 'training' END AS dataset_split, observed_outcome::TINYINT AS target FROM b)"""


def _model_data(spark: SparkSession, sf_dir: str, expanded: bool = False) -> DataFrame:
    return model.model_data(solvency(spark, sf_dir), VALIDATION_START, TEMPORAL_START, expanded)


@query(f"{SPLIT_SQL} SELECT company_snapshot_id, dataset_split, target::INT AS target FROM data")
def model_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_data(spark, sf_dir).select("company_snapshot_id", "dataset_split", F.col("target").cast("int").alias("target"))


@query(f"{SPLIT_SQL} SELECT dataset_split, count(*)::BIGINT AS rows, sum(target)::BIGINT AS positive_rows, round_even(sum(target) / count(*), 6) AS positive_rate FROM data GROUP BY 1")
def split_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(model.split_evidence(_model_data(spark, sf_dir)), "positive_rate")


#: Negatives of the fit at most, and the share of them that is taken below that, so that a sample is drawn at every size.
FIT, FIT_SHARE = {"training": 48_200, "validation": 46_600}, 3
FIT_SQL = "least(CASE dataset_split WHEN 'training' THEN 48200 ELSE 46600 END, ceil(full_n / 3.0))"


@query(f"""{SPLIT_SQL}, neg AS (SELECT *, row_number() OVER (PARTITION BY dataset_split ORDER BY sha256('106:' || company_snapshot_id), company_snapshot_id) AS r, count(*) OVER (PARTITION BY dataset_split) AS full_n FROM data WHERE target = 0 AND dataset_split IN ('training', 'validation'))
SELECT company_snapshot_id, dataset_split, 1 AS target, 1.0::DOUBLE AS sample_weight FROM data WHERE target = 1 AND dataset_split IN ('training', 'validation')
UNION ALL SELECT company_snapshot_id, dataset_split, 0, round_even(full_n / {FIT_SQL}, 6) FROM neg WHERE r <= {FIT_SQL}""")
def fit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _model_data(spark, sf_dir)
    s = model.fit_sample(data, model.negatives_to_take(data, FIT, FIT_SHARE))
    return r6(s.select("company_snapshot_id", "dataset_split", F.col("target").cast("int").alias("target"), "sample_weight"), "sample_weight")


def _as_double(df: DataFrame, numeric: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.bround(F.col(c).cast("double"), 4) for c in numeric})


BASE_NUM_SQL = """round_even((company_age_days / 365.25)::FLOAT::DOUBLE, 4) AS company_age_years, round_even(greatest(least(paid_to_authorised_capital_ratio, 10.0), 0.0)::FLOAT::DOUBLE, 4) AS paid_to_authorised_capital_ratio, round_even(ln(1 + shared_address_company_count)::FLOAT::DOUBLE, 4) AS log_shared_address_company_count,
  round_even(ln(1 + address_registration_month_company_count)::FLOAT::DOUBLE, 4) AS log_address_registration_month_company_count, round_even(log_authorised_capital_inr::FLOAT::DOUBLE, 4) AS log_authorised_capital_inr, round_even(log_paid_up_capital_inr::FLOAT::DOUBLE, 4) AS log_paid_up_capital_inr"""
CATS = (*model.STATUS, *model.CATEGORICAL)
CAT_SQL = ", ".join(f"coalesce({c}, 'UNKNOWN') AS {c}" for c in CATS)


@query(f"{SPLIT_SQL} SELECT company_snapshot_id, {BASE_NUM_SQL}, {CAT_SQL} FROM data")
def feature_matrix_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_double(_model_data(spark, sf_dir), model.NUMERIC).select("company_snapshot_id", *model.NUMERIC, *CATS)


EXP_SQL = ", ".join(f"round_even({'ln(1 + ' + c[4:] + ')' if c.startswith('log_') else c}::FLOAT::DOUBLE, 4) AS {c}" for c in model.EXPANDED_NUMERIC) + ", " + ", ".join(f"coalesce({c}::VARCHAR, 'UNKNOWN') AS {c}" for c in model.EXPANDED_FLAGS)


@query(f"{SPLIT_SQL} SELECT company_snapshot_id, {EXP_SQL} FROM data")
def feature_matrix_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_double(_model_data(spark, sf_dir, True), model.EXPANDED_NUMERIC).select("company_snapshot_id", *model.EXPANDED_NUMERIC, *model.EXPANDED_FLAGS)


@query(f"""{SPLIT_SQL}, tr AS (SELECT *, coalesce(state_code, 'UNKNOWN') AS st FROM data WHERE dataset_split IN ('training', 'validation')), c AS (SELECT st, count(*) AS n FROM tr GROUP BY 1), med AS (SELECT median(company_age_days / 365.25) AS m FROM tr)
SELECT company_snapshot_id, round_even(coalesce((company_age_days / 365.25)::FLOAT::DOUBLE, m), 4) AS company_age_years, (d.st = 'maharashtra')::INT::DOUBLE AS is_maharashtra, coalesce(c.n < 10, false)::INT::DOUBLE AS is_infrequent FROM (SELECT *, coalesce(state_code, 'UNKNOWN') AS st FROM data) d CROSS JOIN med LEFT JOIN c USING (st)""")
def preprocess_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _model_data(spark, sf_dir)
    pre = model.Preprocessor.fit(data.filter(F.col("dataset_split").isin("training", "validation")), ("company_age_years",), ("state_code",))
    out = pre.transform(data, ("company_snapshot_id",))
    has = lambda n: F.col(f"`{n}`") if n in out.columns else F.lit(0.0)
    return out.select("company_snapshot_id", F.bround("company_age_years", 4).alias("company_age_years"), has("state_code=maharashtra").alias("is_maharashtra"), has("state_code=<infrequent>").alias("is_infrequent"))


CANDIDATES = ({"maxDepth": 3, "stepSize": 0.1}, {"maxDepth": 4, "stepSize": 0.1})


def trained(data: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...], candidates: tuple[dict, ...] = CANDIDATES, rounds: int = 20):
    """(booster, preprocessor, selection metrics): the better candidate, each stopped when the validation split gains no more."""
    sample = model.fit_sample(data, model.negatives_to_take(data, FIT, FIT_SHARE)).persist()  # its size is bounded; all passes of the fit read it
    pre = model.Preprocessor.fit(sample.filter("dataset_split = 'training'"), numeric, categorical)
    booster, metrics = model.train_boosted(sample, pre, candidates=candidates, rounds=rounds)
    return booster, pre, metrics


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _model_data(spark, sf_dir)
    booster, pre, _ = trained(data, *model.feature_set("baseline_no_status"))
    return model.scored(booster, model.assembled(data, pre, ("company_snapshot_id", "dataset_split", "target"))).drop("features")


@query()
def gbt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).withColumn("target", F.col("target").cast("int"))


# ---------------------------------------------------------------- serving

def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.index(observations(spark, sf_dir, only_cin=True), ("cin", "company_name", "registration_date", "state_code", "shared_address_company_count"))


INDEX_SQL = f"""{OBS_SQL.replace("kind <> 'UNKNOWN' AND", "kind = 'CIN' AND")}, idx AS (SELECT cin, company_name, registration_date, state_code, shared_address_company_count, {reg.strict_sql('company_name')} AS company_name_normalized_strict, {reg.legal_sql('company_name')} AS company_name_normalized_legal FROM obs WHERE evaluation_eligible)"""


@query(f"{INDEX_SQL} SELECT *, (count(*) OVER (PARTITION BY company_name_normalized_strict))::INT AS strict_name_collision_count FROM idx")
def merchant_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


#: Requests: identifiers of some companies, malformed ones, and names with and without legal form.
ASKED = """SELECT company_key AS query_id, CASE WHEN company_key % 4 = 0 THEN ' ' || lower(legal_entity_identifier) || ' ' WHEN company_key % 40 = 1 THEN 'U123' END AS cin,
  CASE WHEN company_key % 3 = 0 THEN company_name WHEN company_key % 40 = 2 THEN '!!! ---' ELSE 'unique  merchant ' || CAST(company_key % 100 * 50 AS STRING) END AS company_name FROM {registry}"""


@query(f"""{INDEX_SQL}, q AS (SELECT query_id, upper(trim(coalesce(cin, ''))) AS asked, {reg.strict_sql('company_name')} AS strict, {reg.legal_sql('company_name')} AS legal FROM ({ASKED.format(registry='registry')})),
s AS (SELECT company_name_normalized_strict AS k, count(*) AS n, list_sort(list(cin)) AS l FROM idx GROUP BY 1), g AS (SELECT company_name_normalized_legal AS k, count(*) AS n, list_sort(list(cin)) AS l FROM idx GROUP BY 1),
j AS (SELECT q.*, i.cin AS e, CASE WHEN asked = '' AND strict <> '' THEN coalesce(s.n, 0) ELSE 0 END AS sn, s.l AS sl, CASE WHEN asked = '' AND strict <> '' AND legal <> '' THEN coalesce(g.n, 0) ELSE 0 END AS gn, g.l AS gl FROM q LEFT JOIN idx i ON i.cin = q.asked LEFT JOIN s ON s.k = q.strict LEFT JOIN g ON g.k = q.legal)
SELECT query_id, CASE WHEN asked <> '' AND NOT regexp_full_match(asked, '{reg.CIN}') THEN 'invalid_identifier' WHEN asked <> '' THEN CASE WHEN e IS NULL THEN 'no_match' ELSE 'matched' END WHEN sn = 1 THEN 'matched' WHEN sn > 1 THEN 'ambiguous_name' WHEN gn = 1 THEN 'matched' WHEN gn > 1 THEN 'ambiguous_name' ELSE 'no_match' END AS outcome,
  CASE WHEN asked <> '' THEN CASE WHEN e IS NOT NULL THEN 'exact_cin' END WHEN sn = 1 THEN 'normalized_strict_name' WHEN sn = 0 AND gn = 1 THEN 'normalized_legal_name' END AS match_method, CASE WHEN asked <> '' THEN e WHEN sn = 1 THEN sl[1] WHEN sn = 0 AND gn = 1 THEN gl[1] END AS matched_cin,
  CASE WHEN asked = '' AND sn > 1 THEN array_to_string(sl[1:10], ',') WHEN asked = '' AND sn = 0 AND gn > 1 THEN array_to_string(gl[1:10], ',') END AS candidate_cins FROM j""")
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.lookup(spark.sql(ASKED, registry=registry(spark, sf_dir)), _index(spark, sf_dir))


BANDS = Bands((("ELEVATED_REVIEW", 0.8), ("WATCH", 0.56), ("STANDARD", 0.28)))


@query(f"{EVAL_SQL} SELECT company_snapshot_id, CASE WHEN probability >= 0.8 THEN 'ELEVATED_REVIEW' WHEN probability >= 0.56 THEN 'WATCH' WHEN probability >= 0.28 THEN 'STANDARD' ELSE 'LOW_SIGNAL' END AS risk_band FROM (SELECT * REPLACE (least(probability, 1.0) AS probability) FROM ev)")
def band_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("company_snapshot_id", BANDS.column(F.least("probability", F.lit(1.0))).alias("risk_band"))


@query(f"""{EVAL_SQL}, p AS (SELECT company_snapshot_id, least(probability, 1.0) AS probability FROM ev), b AS (SELECT *, CASE WHEN probability >= 0.8 THEN 'ELEVATED_REVIEW' WHEN probability >= 0.56 THEN 'WATCH' WHEN probability >= 0.28 THEN 'STANDARD' ELSE 'LOW_SIGNAL' END AS risk_band FROM p)
SELECT risk_band, company_snapshot_id AS cin FROM (SELECT *, row_number() OVER (PARTITION BY risk_band ORDER BY probability DESC, company_snapshot_id) AS r, count(*) OVER (PARTITION BY risk_band) AS n FROM b) WHERE r = n // 2 + 1""")
def demo_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _evaluated(spark, sf_dir).select(F.col("company_snapshot_id").alias("cin"), F.least("probability", F.lit(1.0)).alias("score"))
    return serving.demo_scenarios(p.withColumn("risk_band", BANDS.column(F.col("score")))).select("risk_band", "cin")


# ---------------------------------------------------------------- sources and sinks

#: Raw register lines: some short, some with a bad identifier or date, some quoted.
LINES = r"""SELECT company_key + 1 AS source_row_number, CASE WHEN company_key % 31 = 0 THEN 'Public Announcement' || chr(9) || '01-02-2020'
  ELSE concat_ws(chr(9), CASE WHEN company_key % 5 = 0 THEN 'Auction' ELSE 'Public Announcement' END, CASE WHEN company_key % 37 = 0 THEN '2020-02-30' ELSE '0' || CAST(1 + company_key % 9 AS STRING) || '-02-2020' END, '10-02-2020',
    CASE WHEN company_key % 2 = 0 THEN '"' || company_name || '"' ELSE company_name END, CASE WHEN company_key % 3 = 0 THEN lower(legal_entity_identifier) ELSE legal_entity_identifier END, 'applicant', 'professional', 'address', '') END AS value FROM {registry}"""


@query(rf"""{with_sql()}, l AS ({LINES.format(registry='registry')}), f AS (SELECT source_row_number, string_split(value, chr(9)) AS f FROM l),
t AS (SELECT source_row_number, trim(f[1]) AS announcement_type, try_strptime(f[2], '%d-%m-%Y')::DATE AS event_date, CASE WHEN regexp_full_match(upper(trim(f[5])), '{reg.CIN}') THEN upper(trim(f[5])) END AS cin, trim(CASE WHEN f[4] LIKE '"%"' THEN replace(substr(f[4], 2, length(f[4]) - 2), '""', '"') ELSE f[4] END) AS debtor_name, len(f) AS n FROM f)
SELECT source_row_number, announcement_type, event_date, cin, debtor_name, CASE WHEN n <> 9 THEN 'malformed_field_count' WHEN cin IS NULL THEN 'invalid_cin' WHEN event_date IS NULL THEN 'invalid_announcement_date' WHEN announcement_type <> 'Public Announcement' THEN 'unknown_announcement_type' END AS quarantine_reason, n::BIGINT AS raw_field_count FROM t""")
def tsv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(LINES, registry=registry(spark, sf_dir))
    return tsv_events(lines, types=("Public Announcement",)).drop("raw_row_json")


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^[=+@-]') THEN '''' || t ELSE t END AS cell FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '=' || text WHEN turn % 3 = 1 THEN '-' || role ELSE text END AS t FROM conversations)")
def csv_formula_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir, "conversations")["conversations"]
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("="), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("-"), "role")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", no_formula(raw).alias("cell"))


RECORD = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("role", T.StringType())])


@query("SELECT 'page-' || (conv_id // 50) AS page_file, (1000 * (conv_id // 50) + row_number() OVER (PARTITION BY conv_id // 50 ORDER BY conv_id, turn, role) - 1)::BIGINT AS source_row_number, conv_id, role FROM conversations")
def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations packed as pages of JSON text, parsed and exploded again."""
    c = tables(spark, sf_dir, "conversations")["conversations"].withColumn("p", F.floor(F.col("conv_id") / 50))
    packed = c.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "role"))).alias("records"))
    text = packed.select("p", F.to_json(F.struct(F.lit("ok").alias("status"), F.size("records").alias("count"), "records")).alias("page"))
    page = T.StructType([T.StructField("status", T.StringType()), T.StructField("count", T.LongType()), T.StructField("records", T.ArrayType(RECORD))])
    pages = text.select(F.concat(F.lit("page-"), F.col("p").cast("string")).alias("page_file"), (F.col("p") * 1000).alias("page_offset"), F.from_json("page", page).alias("j")).select("page_file", "page_offset", "j.*")
    return exploded_pages(pages)


@query("SELECT r_regionkey, r_name, (('0x' || substr(sha256(lower(r_name)), 1, 16))::UBIGINT % 5)::BIGINT AS holdout_bucket FROM region")
def holdout_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "region")["region"].select("r_regionkey", "r_name", bucket(F.lower("r_name"), 5).alias("holdout_bucket"))
