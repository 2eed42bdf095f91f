"""Queries of the chain of evidence: canonical rows, contracts, labels from decisions, held-out evaluation; registered with the rest of the catalogue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_month_name, has_offset, iso_date, mixed_day_first
from ..operators import canonical, checks, decide, holdout, labels, linkage, model, package, serving, transactions
from ..sources.artifacts import spreadsheet_cell
from ..sources.readers import snake_upper, tsv_events
from . import catalogue as cat
from . import registry as reg
from .catalogue import CANDIDATES_SQL, EVAL_SQL, LINES, REVIEW_SQL, SPLIT_SQL, bigint, query, r6
from .registry import adverse, registry, tables, with_sql

AS_OF = date(1998, 6, 30)

#: Register rows as a source brings them: text throughout, with stray blanks, dates and money that can't be read, and identifiers in lower case.
STAGED = """SELECT ' ' || lower(legal_entity_identifier) || ' ' AS cin_, company_name || ' ' AS name_, ' ' || company_status AS status_, CASE WHEN company_key % 9 = 0 THEN 'n/a' WHEN company_key % 8 = 0 THEN NULL ELSE CAST(registration_date AS STRING) END AS date_,
  state_code AS state_, roc_code || ' ' AS roc_, company_category AS category_, company_subcategory AS subcategory_, company_class AS class_, listing_status AS listing_, company_origin AS origin_,
  CASE WHEN company_key % 10 = 0 THEN 'unknown' ELSE CAST(authorised_capital_inr AS STRING) END AS authorised_, CAST(paid_up_capital_inr AS STRING) AS paid_, nic_code AS nic_, 'Industry ' || nic_code AS industry_,
  CASE WHEN address_group_key <> '' THEN ', ' || lower(address_group_key) || ';' END AS address_, 'digest' AS source_file_sha256, '2024-01-01T00:00:00Z' AS observed_at FROM {registry}"""
STAGED_NAMES = {
    "cin_": "CIN", "name_": "CompanyName", "status_": "CompanyStatus", "date_": "CompanyRegistrationdate_date", "state_": "CompanyStateCode", "roc_": "CompanyROCcode", "category_": "CompanyCategory", "subcategory_": "CompanySubCategory",
    "class_": "CompanyClass", "listing_": "Listingstatus", "origin_": "CompanyIndian/Foreign Company", "authorised_": "AuthorizedCapital", "paid_": "PaidupCapital", "nic_": "nic_code", "industry_": "CompanyIndustrialClassification",
    "address_": "Registered_Office_Address",
}
STAGED_SQL = f"{with_sql()}, staged AS (SELECT *, upper(trim(cin_)) AS id FROM ({STAGED.format(registry='registry').replace('STRING', 'VARCHAR')})), typed AS (SELECT *, CASE WHEN regexp_full_match(id, '{reg.CIN}') THEN 'CIN' WHEN regexp_full_match(id, '[A-Z]{{3}}-[0-9]{{4}}') THEN 'LLPIN' WHEN regexp_full_match(id, 'F[0-9]{{5}}') THEN 'FCRN' ELSE 'UNKNOWN' END AS k FROM staged)"


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STAGED, registry=registry(spark, sf_dir)).withColumnsRenamed(STAGED_NAMES)


COMPANY_SQL = """SELECT 'snap:' || id AS company_snapshot_id, 'mca_company_master' AS source_id, id AS source_record_id, source_file_sha256, 'snap' AS source_snapshot_id, DATE '1998-06-30' AS snapshot_as_of, observed_at, '1.2.0' AS schema_version, id AS legal_entity_identifier,
  k AS legal_entity_identifier_type, k <> 'UNKNOWN' AS legal_entity_identifier_is_valid_format, CASE WHEN k = 'CIN' THEN id END AS cin, CASE WHEN k = 'LLPIN' THEN id END AS llpin, CASE WHEN k = 'FCRN' THEN id END AS fcrn, trim(name_) AS company_name, trim(status_) AS company_status,
  state_ AS state_code, trim(roc_) AS roc_code, category_ AS company_category, subcategory_ AS company_subcategory, class_ AS company_class, trim(listing_) AS listing_status, origin_ AS company_origin, nic_ AS nic_code, industry_ AS industrial_classification,
  try_strptime(date_, '%Y-%m-%d')::DATE AS registration_date, TRY_CAST(authorised_ AS DECIMAL(38,2))::DOUBLE AS authorised_capital_inr, TRY_CAST(paid_ AS DECIMAL(38,2))::DOUBLE AS paid_up_capital_inr, NULL::DATE AS valid_from, NULL::DATE AS valid_to FROM typed"""


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.companies(staged(spark, sf_dir), "snap", AS_OF)


@query(f"{STAGED_SQL} {COMPANY_SQL}")
def canonical_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = {c: F.col(c).cast("double") for c in ("authorised_capital_inr", "paid_up_capital_inr")}
    return _companies(spark, sf_dir).withColumns(money)


@query(f"""{STAGED_SQL}, c AS ({COMPANY_SQL}) SELECT count(*)::BIGINT AS company_snapshot_rows, (count(*) - count(DISTINCT legal_entity_identifier))::BIGINT AS duplicate_legal_entity_identifier_rows, (count(*) FILTER (cin IS NULL AND llpin IS NULL AND fcrn IS NULL))::BIGINT AS invalid_legal_entity_identifier_rows,
  count(cin)::BIGINT AS cin_rows, count(llpin)::BIGINT AS llpin_rows, count(fcrn)::BIGINT AS fcrn_rows, (count(*) FILTER (registration_date IS NULL))::BIGINT AS missing_registration_date_rows, round_even(count(*) FILTER (cin IS NULL AND llpin IS NULL AND fcrn IS NULL) / count(*), 6) AS invalid_legal_entity_identifier_rate,
  count(*) = count(DISTINCT legal_entity_identifier) AND count(*) FILTER (cin IS NULL AND llpin IS NULL AND fcrn IS NULL) <= 0.0001 * count(*) AS quality_passed FROM c""")
def canonical_company_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(canonical.company_report(_companies(spark, sf_dir)), "invalid_legal_entity_identifier_rate")


@query(f"""{STAGED_SQL} SELECT 'snap:' || id AS company_address_snapshot_id, 'mca_company_master' AS source_id, id AS source_record_id, source_file_sha256, 'snap' AS source_snapshot_id, DATE '1998-06-30' AS snapshot_as_of, observed_at, '1.2.0' AS schema_version, id AS legal_entity_identifier,
  address_ AS registered_office_address_raw, {reg.strict_sql('address_')} AS address_normalized, {reg.strict_sql('address_')} AS address_group_key, 'india_address_v1' AS address_normalization_version, NULL::DATE AS valid_from, NULL::DATE AS valid_to FROM staged""")
def canonical_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.addresses(staged(spark, sf_dir), "snap", AS_OF)


#: A regulator's list: names, identifiers of three kinds or none, dates in the forms that such lists mix.
LISTED = """SELECT e.event_id AS row_, CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE p.p_name || ' Pvt. Ltd.' END AS name_, CASE e.event_id % 4 WHEN 0 THEN ' abcde' || lpad(CAST(e.event_id % 10000 AS STRING), 4, '0') || 'f ' WHEN 1 THEN 'none' END AS pan_,
  CASE e.event_id % 5 WHEN 0 THEN lpad(CAST(e.event_id AS STRING), 8, '0') WHEN 1 THEN ' ' || lower(r.cin) WHEN 2 THEN 'not given' END AS id_, lpad(CAST(1 + e.event_id % 28 AS STRING), 2, '0') AS day_, lpad(CAST(1 + e.event_id % 12 AS STRING), 2, '0') AS month_, CAST(2000 + e.event_id % 20 AS STRING) AS year_,
  substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(1 + 3 * (e.event_id % 12) AS INT), 3) AS mon_ FROM {events} e LEFT JOIN {part} p ON p.p_partkey = e.event_id % 2000 + 1 LEFT JOIN (SELECT company_key, legal_entity_identifier AS cin FROM {registry}) r ON r.company_key = e.user_id + 1 WHERE e.event_type = 'error'"""
FORMS = """SELECT row_, name_, pan_, id_, CASE WHEN row_ % 13 = 0 THEN 'soon' ELSE day_ || '-' || (CASE WHEN row_ % 2 = 0 THEN upper(mon_) ELSE mon_ END) || '-' || year_ END AS order_, CASE WHEN row_ % 3 = 0 THEN 'particulars' END AS particulars_, ' SYM' AS symbol_, CASE WHEN row_ % 2 = 0 THEN '1 year' END AS period_,
  CASE row_ % 6 WHEN 0 THEN day_ || '/' || month_ || '/' || year_ WHEN 1 THEN day_ || '-' || month_ || '-' || year_ WHEN 2 THEN year_ || '-' || month_ || '-' || day_ WHEN 3 THEN day_ || ' ' || mon_ || ' ' || year_ WHEN 4 THEN day_ || '-' || mon_ || '-' || year_ ELSE '31-02-2020' END AS mixed_ FROM ({listed})"""
LISTED_NAMES = {"name_": "Entity / Individual Name", "pan_": "PAN", "id_": "DIN / CIN", "order_": "Order Date", "particulars_": "Order Particulars", "symbol_": "Symbol ", "period_": "Period", "row_": "source_row_number"}
MIXED = "coalesce(try_strptime(mixed_, '%d-%m-%Y'), try_strptime(mixed_, '%d/%m/%Y'), try_strptime(mixed_, '%Y-%m-%d'), try_strptime(mixed_, '%d-%b-%Y'), try_strptime(mixed_, '%d %b %Y'))::DATE"
_LISTED_SQL = LISTED.format(events="events", part="part", registry="(SELECT company_key, cin AS legal_entity_identifier FROM registry)").replace("STRING", "VARCHAR")
ADVERSE_SQL = f"""{with_sql()}, raw AS ({FORMS.format(listed=_LISTED_SQL)}), ev AS (SELECT 'nse_sebi_debarred:sum:' || row_ AS adverse_event_id, 'nse_sebi_debarred' AS source_id, row_::VARCHAR AS source_record_id, 'sum' AS source_file_sha256, 'snap' AS source_snapshot_id, '2024-01-01T00:00:00Z' AS observed_at, '1.0.0' AS schema_version, 'SEBI' AS event_source_authority,
  'regulatory_debarment_or_action' AS event_type, true AS adverse_regulatory_outcome, try_strptime(order_, '%d-%b-%Y')::DATE AS event_date, coalesce(particulars_, '') AS order_particulars, coalesce(name_, '') AS entity_name_raw, {reg.strict_sql('name_')} AS entity_name_normalized_strict, {reg.legal_sql('name_')} AS entity_name_normalized_legal,
  coalesce(pan_, '') AS pan_raw, CASE WHEN regexp_full_match(upper(trim(pan_)), '[A-Z]{{5}}[0-9]{{4}}[A-Z]') THEN upper(trim(pan_)) END AS pan_candidate, coalesce(id_, '') AS din_cin_raw, CASE WHEN regexp_full_match(upper(trim(id_)), '{reg.CIN}') THEN upper(trim(id_)) END AS cin_candidate,
  CASE WHEN regexp_full_match(trim(id_), '[0-9]{{8}}') THEN trim(id_) END AS din_candidate, 'SYM' AS symbol, coalesce(period_, '') AS period_raw, 'c1' AS nse_debarment_circular, {MIXED} AS nse_debarment_circular_date, '' AS nse_revocation_circular, NULL::DATE AS nse_revocation_circular_date FROM raw)"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registry(spark, sf_dir).select("company_key", F.col("cin").alias("legal_entity_identifier"))
    rows = spark.sql(FORMS.format(listed=LISTED), registry=r, **tables(spark, sf_dir, "events", "part")).withColumnsRenamed(LISTED_NAMES)
    return rows.withColumns({"NSE Circular No. (For Debarment)": F.lit("c1"), "Date of NSE circular": F.col("mixed_"), "NSE Circular No. (For Revocation)": F.lit(None).cast("string"), "Date of NSE circular. (For Revocation)": F.lit(None).cast("string")})


def _canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.adverse_events(_listed(spark, sf_dir), "nse_sebi_debarred", "sum", "snap", "2024-01-01T00:00:00Z")


@query(f"{ADVERSE_SQL} SELECT * FROM ev")
def canonical_adverse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical_events(spark, sf_dir)


@query(f"""{ADVERSE_SQL} SELECT count(*)::BIGINT AS adverse_event_rows, count(*)::BIGINT AS sebi_event_rows, 0::BIGINT AS other_authority_event_rows, count(cin_candidate)::BIGINT AS cin_candidate_rows, count(din_candidate)::BIGINT AS din_candidate_rows, count(pan_candidate)::BIGINT AS pan_candidate_rows,
  (count(*) FILTER (entity_name_raw = ''))::BIGINT AS missing_entity_name_rows, (count(*) FILTER (event_date IS NULL))::BIGINT AS missing_event_date_rows FROM ev""")
def canonical_adverse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.adverse_report(_canonical_events(spark, sf_dir))


@query(f"""{ADVERSE_SQL} SELECT row_ AS source_row_number, try_strptime(order_, '%d-%b-%Y')::DATE AS named_month, {MIXED} AS mixed, try_strptime(mixed_, '%Y-%m-%d')::DATE AS iso,
  row_ % 4 < 2 AS zoned FROM raw""")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("source_row_number")
    stamp = F.concat(F.lit("2024-01-02T03:04:05"), F.when(n % 4 == 0, "Z").when(n % 4 == 1, "+05:30").otherwise(""))
    return _listed(spark, sf_dir).select("source_row_number", day_month_name(F.col("Order Date")).alias("named_month"), mixed_day_first(F.col("mixed_")).alias("mixed"), iso_date(F.col("mixed_")).alias("iso"), has_offset(stamp).alias("zoned"))


# ---------------------------------------------------------------- contracts

@query(f"{with_sql()} SELECT count(*)::BIGINT AS rows, (count(DISTINCT cin) + max((cin IS NULL)::INT))::BIGINT AS distinct_keys, 'snap' AS least, 'snap' AS largest, 0::BIGINT AS not_finite, (count(*) FILTER (company_key / 1000.0 > 1))::BIGINT AS outside FROM registry")
def contract_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = registry(spark, sf_dir).withColumn("share", F.col("company_key") / 1000.0)
    checks.require_columns(df, ("company_snapshot_id", "cin", "share"))
    return checks.contract_counters(df, "cin", "source_snapshot_id", "share").withColumns(bigint("rows", "distinct_keys", "not_finite", "outside"))


@query(f"{with_sql()} SELECT company_snapshot_id, source_snapshot_id, company_key / 1e9 AS probability FROM registry")
def contracts_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have passed the contracts: unique key, constant snapshot, finite numbers, probabilities."""
    df = registry(spark, sf_dir).select("company_snapshot_id", "source_snapshot_id", (F.col("company_key") / 1e9).alias("probability"))
    checks.require(df, unique=("company_snapshot_id",), constant={"source_snapshot_id": "snap"})
    checks.require_probability(df, "probability")
    return df


@query("SELECT 'snap' AS source_snapshot_id")
def snapshot_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.one_snapshot(_companies(spark, sf_dir), canonical.addresses(staged(spark, sf_dir), "snap", AS_OF))


@query(f"{with_sql('adverse')} SELECT adverse_event_id, r.company_snapshot_id, r.company_name FROM adverse JOIN registry r ON r.cin = cin_candidate")
def join_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join to companies by identifier that would raise if one stood twice."""
    one = registry(spark, sf_dir).filter("cin is not null").select(F.col("cin").alias("cin_candidate"), "company_snapshot_id", "company_name")
    return checks.joined_one(adverse(spark, sf_dir).select("adverse_event_id", "cin_candidate"), one, "cin_candidate", "inner").drop("cin_candidate")


# ---------------------------------------------------------------- labels from decisions, review

@query(f"{CANDIDATES_SQL} SELECT adverse_event_id, accepted_company_snapshot_id AS company_snapshot_id, event_date FROM decisions JOIN adverse USING (adverse_event_id) WHERE outcome_eligible")
def accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.accepted_events(cat.link_decisions(spark, sf_dir), adverse(spark, sf_dir))


@query("SELECT 'accepted_unique_exact_cin_only' AS label_match_policy")
def label_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_policy(cat.link_decisions(spark, sf_dir))


@query(f"{REVIEW_SQL} SELECT review_stratum, count(DISTINCT adverse_event_id)::BIGINT AS events, count(*)::BIGINT AS rows FROM review GROUP BY 1")
def review_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.strata(cat.review_sample_stratified(spark, sf_dir))


@query(f"""{REVIEW_SQL} SELECT linkage_review_row_id, adverse_event_id, review_stratum, review.company_snapshot_id, match_method, candidate_rank, candidate_set_truncated, event_date, entity_name_raw, cin_candidate
  FROM review JOIN adverse USING (adverse_event_id)""")
def review_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.with_payload(cat.review_sample_stratified(spark, sf_dir), adverse(spark, sf_dir), ("event_date", "entity_name_raw", "cin_candidate"))


@query(f"""{CANDIDATES_SQL} SELECT count(*)::BIGINT AS event_rows, (count(*) FILTER (review_status = 'accepted'))::BIGINT AS accepted_rows, (count(*) FILTER (review_status = 'pending_review'))::BIGINT AS pending_rows, (count(*) FILTER (review_status = 'ambiguous'))::BIGINT AS ambiguous_rows,
  (count(*) FILTER (review_status = 'unmatched'))::BIGINT AS unmatched_rows, round_even(count(*) FILTER (review_status = 'accepted') / count(*), 6) AS exact_cin_coverage_rate, count(*) FILTER (review_status IN ('pending_review', 'ambiguous')) > 0 AS human_review_required FROM decisions""")
def linkage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(linkage.report(cat.link_decisions(spark, sf_dir)), "exact_cin_coverage_rate")


@query(rf"""{with_sql()}, l AS ({LINES.format(registry='registry')}), f AS (SELECT string_split(value, chr(9)) AS f FROM l), t AS (SELECT try_strptime(f[2], '%d-%m-%Y')::DATE AS d, CASE WHEN regexp_full_match(upper(trim(f[5])), '{reg.CIN}') THEN upper(trim(f[5])) END AS cin FROM f WHERE len(f) = 9)
SELECT count(*)::BIGINT AS valid_rows, (count(*) - count(DISTINCT (cin, d)))::BIGINT AS duplicate_rows FROM t WHERE cin IS NOT NULL AND d IS NOT NULL""")
def announcement_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = tsv_events(spark.sql(LINES, registry=registry(spark, sf_dir))).filter("quarantine_reason is null")
    return checks.duplicates(good, ("cin", "event_date"))


@query(rf"""{with_sql()}, l AS ({LINES.format(registry='registry')}), f AS (SELECT source_row_number, string_split(value, chr(9)) AS f FROM l)
SELECT source_row_number, list_transform(f, lambda x: CASE WHEN x LIKE '"%"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END)::JSON::VARCHAR AS raw_row_json FROM f WHERE len(f) <> 9""")
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv_events(spark.sql(LINES, registry=registry(spark, sf_dir))).filter("quarantine_reason = 'malformed_field_count'").select("source_row_number", "raw_row_json")


@query("""SELECT conv_id, turn, role, (turn % 2 = 0)::VARCHAR AS flag_cell, CASE WHEN turn % 3 <> 0 THEN '2020-01-0' || (1 + turn % 9) ELSE '' END AS date_cell, CASE WHEN turn % 2 = 0 THEN '''-' || turn ELSE turn::VARCHAR END AS number_cell, CASE WHEN text IS NULL THEN '' WHEN regexp_matches(text, '^[=+@-]') THEN '''' || text ELSE text END AS text_cell FROM conversations""")
def spreadsheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, turn = tables(spark, sf_dir, "conversations")["conversations"], F.col("turn")
    day = F.when(turn % 3 != 0, F.concat(F.lit("2020-01-0"), (1 + turn % 9).cast("string")).cast("date"))
    number = F.when(turn % 2 == 0, -turn).otherwise(turn)
    return c.select("conv_id", "turn", "role", spreadsheet_cell(turn % 2 == 0, "boolean").alias("flag_cell"), spreadsheet_cell(day, "date").alias("date_cell"), spreadsheet_cell(F.when((turn % 2 == 0) & (turn == 0), F.lit("-0")).otherwise(number.cast("string")), "string").alias("number_cell"), spreadsheet_cell(F.col("text"), "string").alias("text_cell"))


#: A transaction table with its window columns, from the events.
TRANSACTIONS = "SELECT event_id AS tx_id, " + ", ".join(f"CAST(1 + (event_id * {k + 3} + user_id) % {17 + 5 * k} AS DOUBLE) AS {c}" for k, c in enumerate(transactions.RAW)) + " FROM {events}"
_E = "0.001::DOUBLE"
ENGINEERED = {
    **{f"CUSTOMER_AMOUNT_TO_AVG_{d}D": f"TX_AMOUNT / (CUSTOMER_ID_AVG_AMOUNT_{d}DAY_WINDOW + {_E})" for d in (1, 7, 30)},
    **{f"{w}_TX_ACCEL_1D_TO_7D": f"{w}_ID_NB_TX_1DAY_WINDOW / ({w}_ID_NB_TX_7DAY_WINDOW / 7.0 + {_E})" for w in ("CUSTOMER", "TERMINAL")},
    **{f"{w}_TX_ACCEL_7D_TO_30D": f"{w}_ID_NB_TX_7DAY_WINDOW / ({w}_ID_NB_TX_30DAY_WINDOW * 7.0 / 30.0 + {_E})" for w in ("CUSTOMER", "TERMINAL")},
    "TERMINAL_RISK_MAX": "greatest(TERMINAL_ID_RISK_1DAY_WINDOW, TERMINAL_ID_RISK_7DAY_WINDOW, TERMINAL_ID_RISK_30DAY_WINDOW)", "TERMINAL_RISK_SLOPE_1D_30D": "TERMINAL_ID_RISK_1DAY_WINDOW - TERMINAL_ID_RISK_30DAY_WINDOW",
    "AMOUNT_X_TERMINAL_RISK_7D": "TX_AMOUNT * TERMINAL_ID_RISK_7DAY_WINDOW", "AMOUNT_X_NIGHT": "TX_AMOUNT * TX_DURING_NIGHT",
}


@query(f"WITH t AS ({TRANSACTIONS.format(events='events')}) SELECT tx_id, " + ", ".join(f"round_even(({e})::FLOAT::DOUBLE, 4) AS {c.lower()}" for c, e in ENGINEERED.items()) + " FROM t")
def engineered_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = transactions.engineered(spark.sql(TRANSACTIONS, **tables(spark, sf_dir, "events")))
    return e.select("tx_id", *[F.bround(F.col(c).cast("double"), 4).alias(c.lower()) for c in ENGINEERED])


@query(f"{with_sql()} SELECT company_snapshot_id FROM registry WHERE ('0x' || substr(sha256('7:' || company_snapshot_id), 1, 16))::UBIGINT % 1000000 < 250000")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.hash_sample(registry(spark, sf_dir), "company_snapshot_id", 250_000, 7).select("company_snapshot_id")


#: Names as sources spell them, and as fields are called here.
FIELD_SQL = " UNION ALL ".join(f"SELECT '{n}' AS source_name, '{snake_upper(n)}' AS field_name" for n in ("CompanyROCcode", "Listing status", "paidUp Capital", "PAN"))


@query("SELECT * FROM (VALUES ('CompanyROCcode', 'COMPANY_ROCCODE'), ('Listing status', 'LISTING_STATUS'), ('paidUp Capital', 'PAID_UP_CAPITAL'), ('PAN', 'PAN')) AS t(source_name, field_name)")
def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FIELD_SQL)


# ---------------------------------------------------------------- held-out evaluation, bands, gates

#: A stand-in score, so that the metrics have a SQL twin: it depends on the label a little.
SCORED_SQL = f"{SPLIT_SQL}, scored AS (SELECT company_snapshot_id, dataset_split, target::INT AS target, (company_age_days * 37 % 101 + 20 * target) / 128.0::DOUBLE AS score FROM data)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.round(F.col("company_age_years").cast("double") * 365.25).cast("long")
    target = F.col("target").cast("int")
    return cat._model_data(spark, sf_dir).select("company_snapshot_id", "dataset_split", target.alias("target"), ((days * 37 % 101 + 20 * target) / 128.0).alias("score"))


@query(f"""{SCORED_SQL}, pairs AS (SELECT a.dataset_split, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auc FROM scored a JOIN scored b ON a.dataset_split = b.dataset_split AND a.target = 1 AND b.target = 0 GROUP BY 1),
h AS (SELECT dataset_split, score, count(*) AS n, sum(target) AS p FROM scored GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM h WINDOW w AS (PARTITION BY dataset_split ORDER BY score DESC)), ap AS (SELECT dataset_split, sum(p * tp / k) / sum(p) AS ap FROM c GROUP BY 1)
SELECT dataset_split, count(*)::BIGINT AS rows, sum(target)::BIGINT AS positive_rows, round_even(avg(target), 6) AS base_rate, round_even(avg(((score >= 0.5)::INT = target)::INT), 6) AS accuracy_at_0_5, round_even(any_value(ap), 6) AS pr_auc, round_even(any_value(auc), 6) AS roc_auc,
  round_even(avg(power(score - target, 2)), 6) AS brier_score, min(score) AS score_minimum, max(score) AS score_maximum, round_even(avg(score), 6) AS score_mean FROM scored JOIN pairs USING (dataset_split) JOIN ap USING (dataset_split) WHERE dataset_split IN ('temporal_test', 'validation', 'training') GROUP BY 1""")
def holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # at the smallest sizes no company of the held-out states has an outcome, so the splits by time stand for the holdouts
    splits = ("temporal_test", "validation", "training")
    got = holdout.split_metrics(_scored(spark, sf_dir).filter(F.col("dataset_split").isin(*splits)), splits)
    return r6(got, "base_rate", "accuracy_at_0_5", "pr_auc", "roc_auc", "brier_score", "score_mean").withColumns(bigint("rows", "positive_rows"))


def _queue_sql(f: float) -> str:
    return f"""SELECT {f}::DOUBLE AS capacity_fraction, k::BIGINT AS review_rows, min(score)::DOUBLE AS score_threshold, round_even(sum(target) / k, 6) AS precision, round_even(sum(target) / any_value(pos), 6) AS recall, round_even((sum(target) / k) / any_value(pos / n), 6) AS lift
    FROM (SELECT *, greatest(1, ceil(count(*) OVER () * {f})) AS k, row_number() OVER (ORDER BY score DESC, company_snapshot_id) AS r, sum(target) OVER () AS pos, count(*) OVER () AS n FROM scored WHERE dataset_split = 'temporal_test') WHERE r <= k GROUP BY k"""


WIDE = (0.05, 0.2, 0.6)


@query(f"{SCORED_SQL} " + " UNION ALL ".join(_queue_sql(f) for f in WIDE))
def holdout_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(holdout.queues(_scored(spark, sf_dir), capacities=WIDE), "precision", "recall", "lift")


@query(f"""{SCORED_SQL}, q AS ({' UNION ALL '.join(_queue_sql(f) for f in WIDE)}), t AS (SELECT max(score_threshold) FILTER (capacity_fraction = 0.05) AS a, max(score_threshold) FILTER (capacity_fraction = 0.2) AS b, max(score_threshold) FILTER (capacity_fraction = 0.6) AS c FROM q)
SELECT company_snapshot_id, CASE WHEN score >= a THEN 'ELEVATED_REVIEW' WHEN score >= b THEN 'WATCH' WHEN score >= c THEN 'STANDARD' ELSE 'LOW_SIGNAL' END AS risk_band FROM scored CROSS JOIN t""")
def measured_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    bands = holdout.measured_bands(holdout.queues(scored, capacities=WIDE).collect(), WIDE)
    return scored.select("company_snapshot_id", bands.column(F.col("score")).alias("risk_band"))


PARTS = (("train", 20), ("train_embargo", 2), ("validation", 5), ("validation_embargo", 2))


@query("""WITH d AS (SELECT ts::DATE AS d, row_number() OVER (ORDER BY ts::DATE) - 1 AS r FROM (SELECT DISTINCT ts::DATE AS ts FROM events)), e AS (SELECT event_id, CASE WHEN r < 20 THEN 'train' WHEN r < 22 THEN 'train_embargo' WHEN r < 27 THEN 'validation' WHEN r < 29 THEN 'validation_embargo' ELSE 'test' END AS day_part FROM events JOIN d ON d.d = ts::DATE)
SELECT event_id, day_part FROM e""")
def embargoed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.day_parts(tables(spark, sf_dir, "events")["events"], F.to_date("ts"), PARTS).select("event_id", "day_part")


@query(f"""{SPLIT_SQL} SELECT (count(*) FILTER (target = 1))::BIGINT AS positive_rows, (count(*) FILTER (target = 1 AND dataset_split = 'geography_test'))::BIGINT AS geography_rows, (count(*) FILTER (target = 1 AND dataset_split = 'temporal_test'))::BIGINT AS temporal_rows,
  least(count(*) FILTER (target = 1), count(*) FILTER (target = 1 AND dataset_split = 'geography_test'), count(*) FILTER (target = 1 AND dataset_split = 'temporal_test')) >= 20 AS ready_to_train,
  CASE WHEN count(*) FILTER (target = 1) >= 20 THEN 'TRAIN' ELSE 'DO_NOT_TRAIN' END AS decision, greatest(20 - count(*) FILTER (target = 1), 0)::BIGINT AS shortfall FROM data""")
def training_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, split = F.col("target") == 1, F.col("dataset_split")
    r = cat._model_data(spark, sf_dir).agg(F.count_if(hit).alias("n"), F.count_if(hit & (split == "geography_test")).alias("geo"), F.count_if(hit & (split == "temporal_test")).alias("later")).first()
    said = decide.training_decision(r.n)
    return spark.createDataFrame([(r.n, r.geo, r.later, decide.ready_to_train(r.n, r.geo, r.later), said["decision"], said["shortfall"])], "positive_rows long, geography_rows long, temporal_rows long, ready_to_train boolean, decision string, shortfall long")


@query(f"{EVAL_SQL} SELECT company_snapshot_id, CASE WHEN score > 20 THEN 'low' ELSE 'moderate' END AS confidence, 'INR ' || format('{{:,}}', (score * 1234)::BIGINT) AS amount, printf('%.2f%%', probability * 100) AS share FROM ev")
def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cat._evaluated(spark, sf_dir)
    n = F.col("score")
    return e.select("company_snapshot_id", decide.confidence_column(F.when(n > 20, "strict_name").otherwise("exact_cin"), F.lit(False), F.lit(True)).alias("confidence"), decide.inr_column(n * 1234).alias("amount"), decide.percent_column(F.col("probability")).alias("share"))


@query()
def package_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every company from exported trees alone, as a package scores them."""
    numeric, categorical = model.feature_set("baseline_no_status")
    data = cat._model_data(spark, sf_dir)
    booster, pre, _ = cat.trained(data, numeric, categorical, cat.CANDIDATES[:1], 10)
    return package.Package("baseline_no_status", package.exported(booster), pre, {}).score(data, ("company_snapshot_id", "dataset_split"))


#: All of the catalogue, these queries included.
QUERIES, ORACLES = cat.QUERIES, cat.ORACLES
