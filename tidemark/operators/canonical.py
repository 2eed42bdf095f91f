"""Raw register rows to canonical companies, addresses and adverse events, each row with its lineage."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_month_name, iso_date, mixed_day_first
from ..functions.identifiers import CIN_PATTERN, DIN_PATTERN, FCRN_PATTERN, LLPIN_PATTERN, PAN_PATTERN, candidate, identifier_type
from ..functions.names import legal_name, strict_name, stripped
from .checks import require_columns

# Source names, versions, and the fields that the sources bring.
COMPANY_SOURCE, COMPANY_VERSION, ADDRESS_VERSION = "mca_company_master", "1.2.0", "india_address_v1"
EVENT_VERSION, EVENT_TYPE = "1.0.0", "regulatory_debarment_or_action"
AUTHORITY = {"nse_sebi_debarred": "SEBI"}
LINEAGE = ("source_file_sha256", "observed_at")
COMPANY_TEXT = {
    "CompanyName": "company_name", "CompanyStatus": "company_status", "CompanyStateCode": "state_code", "CompanyROCcode": "roc_code", "CompanyCategory": "company_category", "CompanySubCategory": "company_subcategory",
    "CompanyClass": "company_class", "Listingstatus": "listing_status", "CompanyIndian/Foreign Company": "company_origin", "nic_code": "nic_code", "CompanyIndustrialClassification": "industrial_classification",
}
COMPANY_FIELDS = ("CIN", *COMPANY_TEXT, "CompanyRegistrationdate_date", "AuthorizedCapital", "PaidupCapital", *LINEAGE)
EVENT_FIELDS = (
    "Entity / Individual Name", "PAN", "DIN / CIN", "Order Date", "Order Particulars", "Symbol ", "Period", "NSE Circular No. (For Debarment)", "Date of NSE circular",
    "NSE Circular No. (For Revocation)", "Date of NSE circular. (For Revocation)", "source_row_number",
)


def _field(name: str) -> Column:
    return F.col(f"`{name}`")


def _common(identifier: Column, snapshot: str, as_of: date, key: str) -> list[Column]:
    """Identity and lineage that companies and addresses share; a row without an identifier has no key either."""
    return [
        F.concat(F.lit(f"{snapshot}:"), identifier).alias(key), F.lit(COMPANY_SOURCE).alias("source_id"), identifier.alias("source_record_id"), F.col("source_file_sha256"), F.lit(snapshot).alias("source_snapshot_id"),
        F.lit(as_of).alias("snapshot_as_of"), F.col("observed_at"), F.lit(COMPANY_VERSION).alias("schema_version"), identifier.alias("legal_entity_identifier"),
    ]


def _validity() -> list[Column]:
    """A register snapshot says nothing of when a row began or ceased to hold."""
    return [F.lit(None).cast("date").alias(c) for c in ("valid_from", "valid_to")]


def companies(staged: DataFrame, snapshot: str, as_of: date) -> DataFrame:
    """One row a register row; dates and capital that can't be read are null, and identifiers keep their row whatever their form."""
    require_columns(staged, COMPANY_FIELDS)
    identifier = F.upper(stripped(F.col("CIN")))
    kind = identifier_type(F.col("CIN"))
    money = lambda c: stripped(F.col(c)).try_cast("decimal(38,2)")
    return staged.select(
        *_common(identifier, snapshot, as_of, "company_snapshot_id"), kind.alias("legal_entity_identifier_type"), (kind != "UNKNOWN").alias("legal_entity_identifier_is_valid_format"),
        *[candidate(F.col("CIN"), p).alias(n) for n, p in (("cin", CIN_PATTERN), ("llpin", LLPIN_PATTERN), ("fcrn", FCRN_PATTERN))],
        *[stripped(_field(raw)).alias(name) for raw, name in COMPANY_TEXT.items()], iso_date(F.col("CompanyRegistrationdate_date")).alias("registration_date"),
        money("AuthorizedCapital").alias("authorised_capital_inr"), money("PaidupCapital").alias("paid_up_capital_inr"), *_validity(),
    )


def addresses(staged: DataFrame, snapshot: str, as_of: date) -> DataFrame:
    """The registered address of each register row, as it stands and normalised; the normalised text is the key of its group."""
    require_columns(staged, ("CIN", "Registered_Office_Address", *LINEAGE))
    normal = strict_name(F.col("Registered_Office_Address"))
    return staged.select(
        *_common(F.upper(stripped(F.col("CIN"))), snapshot, as_of, "company_address_snapshot_id"), F.col("Registered_Office_Address").alias("registered_office_address_raw"),
        normal.alias("address_normalized"), normal.alias("address_group_key"), F.lit(ADDRESS_VERSION).alias("address_normalization_version"), *_validity(),
    )


def adverse_events(rows: DataFrame, source: str, digest: str, snapshot: str, observed_at: str) -> DataFrame:
    """One adverse event a row of a regulator's list; all fields that are read must be there.

    The order's date stands with the month's name, circulars' dates in several day-first forms.
    """
    require_columns(rows, EVENT_FIELDS)
    whole = lambda c: F.coalesce(_field(c).cast("string"), F.lit(""))
    name = _field("Entity / Individual Name")
    return rows.select(
        F.concat_ws(":", F.lit(source), F.lit(digest), F.col("source_row_number").cast("string")).alias("adverse_event_id"), F.lit(source).alias("source_id"), F.col("source_row_number").cast("string").alias("source_record_id"),
        F.lit(digest).alias("source_file_sha256"), F.lit(snapshot).alias("source_snapshot_id"), F.lit(observed_at).alias("observed_at"), F.lit(EVENT_VERSION).alias("schema_version"),
        F.lit(AUTHORITY.get(source, "OTHER_AUTHORITY")).alias("event_source_authority"), F.lit(EVENT_TYPE).alias("event_type"), F.lit(True).alias("adverse_regulatory_outcome"),
        day_month_name(F.col("`Order Date`")).alias("event_date"), whole("Order Particulars").alias("order_particulars"), whole("Entity / Individual Name").alias("entity_name_raw"),
        strict_name(name).alias("entity_name_normalized_strict"), legal_name(name).alias("entity_name_normalized_legal"), whole("PAN").alias("pan_raw"), candidate(F.col("PAN"), PAN_PATTERN).alias("pan_candidate"),
        whole("DIN / CIN").alias("din_cin_raw"), candidate(_field("DIN / CIN"), CIN_PATTERN).alias("cin_candidate"), candidate(_field("DIN / CIN"), DIN_PATTERN).alias("din_candidate"),
        stripped(whole("Symbol ")).alias("symbol"), whole("Period").alias("period_raw"), whole("NSE Circular No. (For Debarment)").alias("nse_debarment_circular"),
        mixed_day_first(_field("Date of NSE circular")).alias("nse_debarment_circular_date"), whole("NSE Circular No. (For Revocation)").alias("nse_revocation_circular"),
        mixed_day_first(_field("Date of NSE circular. (For Revocation)")).alias("nse_revocation_circular_date"),
    )


def adverse_report(events: DataFrame) -> DataFrame:
    """Coverage of canonical adverse events, one row from one pass."""
    has = lambda c: F.count_if(F.col(c).isNotNull())
    return events.agg(
        F.count("*").alias("adverse_event_rows"), F.count_if(F.col("event_source_authority") == "SEBI").alias("sebi_event_rows"), F.count_if(F.col("event_source_authority") != "SEBI").alias("other_authority_event_rows"),
        has("cin_candidate").alias("cin_candidate_rows"), has("din_candidate").alias("din_candidate_rows"), has("pan_candidate").alias("pan_candidate_rows"),
        F.count_if(F.col("entity_name_raw") == "").alias("missing_entity_name_rows"), F.count_if(F.col("event_date").isNull()).alias("missing_event_date_rows"),
    )


def company_report(companies: DataFrame, most_invalid: float = 0.0001) -> DataFrame:
    """Quality counters of canonical companies and whether they pass, one row from one pass."""
    kind = F.col("legal_entity_identifier_type")
    got = companies.agg(
        F.count("*").alias("company_snapshot_rows"), (F.count("*") - F.count_distinct("legal_entity_identifier")).alias("duplicate_legal_entity_identifier_rows"), F.count_if(kind == "UNKNOWN").alias("invalid_legal_entity_identifier_rows"),
        F.count_if(kind == "CIN").alias("cin_rows"), F.count_if(kind == "LLPIN").alias("llpin_rows"), F.count_if(kind == "FCRN").alias("fcrn_rows"), F.count_if(F.col("registration_date").isNull()).alias("missing_registration_date_rows"),
    )
    rate = F.coalesce(F.try_divide(F.col("invalid_legal_entity_identifier_rows").cast("double"), F.col("company_snapshot_rows").cast("double")), F.lit(0.0))
    got = got.withColumn("invalid_legal_entity_identifier_rate", rate)
    return got.withColumn("quality_passed", (F.col("duplicate_legal_entity_identifier_rows") == 0) & (rate <= most_invalid))
