"""The driver tables projected onto companies, outcomes and regulatory events, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFF, START, END = date(1998, 6, 30), date(1998, 7, 1), date(2000, 12, 31)
VALIDATION_START, TEMPORAL_START = date(1999, 7, 1), date(2000, 1, 1)

#: One row a customer.  Every 17th has no address, every 13th, 19th and 23rd an identifier of another kind or none.
REGISTRY = """
SELECT 'snap:' || CAST(c.c_custkey AS STRING) AS company_snapshot_id, 'snap' AS source_snapshot_id, c.c_custkey AS company_key,
  CASE WHEN c.c_custkey % 13 = 0 THEN 'AAB-' || lpad(CAST(c.c_custkey % 10000 AS STRING), 4, '0') WHEN c.c_custkey % 19 = 0 THEN 'F' || lpad(CAST(c.c_custkey % 100000 AS STRING), 5, '0') WHEN c.c_custkey % 23 = 0 THEN 'TEST' || CAST(c.c_custkey AS STRING)
    ELSE (CASE WHEN c.c_custkey % 2 = 0 THEN 'L' ELSE 'U' END) || lpad(CAST(c.c_custkey % 89 * 1117 % 100000 AS STRING), 5, '0') || (CASE c.c_nationkey % 5 WHEN 0 THEN 'MH' WHEN 1 THEN 'DL' WHEN 2 THEN 'KA' WHEN 3 THEN 'TN' ELSE 'ZZ' END)
      || CAST(year(f.first_order) + (CASE WHEN c.c_custkey % 11 = 0 THEN 1 ELSE 0 END) AS STRING) || 'PTC' || lpad(CAST(c.c_custkey % 1000000 AS STRING), 6, '0') END AS legal_entity_identifier,
  CASE WHEN c.c_custkey % 50 = 0 THEN 'Unique Merchant ' || CAST(c.c_custkey AS STRING) || ' Pvt. Ltd.' ELSE p.p_name || (CASE c.c_custkey % 3 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' & Co' ELSE '' END) END AS company_name,
  CAST(f.first_order AS DATE) AS registration_date,
  CASE c.c_nationkey % 5 WHEN 0 THEN 'maharashtra' WHEN 1 THEN 'delhi' WHEN 2 THEN 'karnataka' WHEN 3 THEN 'tamil nadu' ELSE lower(n.n_name) END AS state_code,
  lpad(CAST(c.c_custkey % 97 * 1031 % 100000 AS STRING), 5, '0') AS nic_code,
  CASE c.c_custkey % 3 WHEN 0 THEN 'Listed' WHEN 1 THEN 'Unlisted' ELSE ' ' END AS listing_status,
  CAST(CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal ELSE 0 END AS DECIMAL(38, 2)) AS authorised_capital_inr,
  CAST(CASE WHEN c.c_acctbal > 0 THEN floor(c.c_acctbal / (1 + c.c_custkey % 4)) ELSE 0 END AS DECIMAL(38, 2)) AS paid_up_capital_inr,
  CASE WHEN c.c_custkey % 17 = 0 THEN '' ELSE upper(n.n_name || ' ' || c.c_mktsegment) END AS address_group_key,
  CASE WHEN c.c_custkey % 29 = 0 THEN 'Under CIRP' ELSE 'Active' END AS company_status, 'ROC ' || CAST(c.c_nationkey % 5 AS STRING) AS roc_code, 'Company limited by shares' AS company_category,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE 'Non-government company' END AS company_subcategory, CASE WHEN c.c_custkey % 5 = 0 THEN 'Public' ELSE 'Private' END AS company_class, 'Indian' AS company_origin
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM {orders} GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey
LEFT JOIN {part} p ON p.p_partkey = c.c_custkey
"""

#: A cast of a double to decimals rounds its shortest text in Spark and its hundredfold in DuckDB, which differ next to half a cent; Spark is told to round the hundredfold.
BALANCE = "CAST(CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal ELSE 0 END AS DECIMAL(38, 2))"
CENTS = "CAST(CASE WHEN c.c_acctbal > 0 THEN round(c.c_acctbal * 100) / 100 ELSE 0 END AS DECIMAL(38, 2))"

#: Insolvency-like outcomes: a fixed sample of late orders.
OUTCOMES = """
SELECT 'order:' || CAST(o.o_orderkey AS STRING) AS outcome_id, 'snap:' || CAST(o.o_custkey AS STRING) AS company_snapshot_id, CAST(o.o_orderdate AS DATE) AS event_date
FROM {orders} o WHERE o.o_orderkey % 37 = 0 AND o.o_orderdate >= CAST('1998-04-01' AS DATE)
"""

#: Regulatory events: identifiers for a third, names for the rest.
ADVERSE = """
SELECT 'event:' || CAST(e.event_id AS STRING) AS adverse_event_id, CAST(e.ts AS DATE) AS event_date,
  CASE WHEN e.event_id % 3 = 0 THEN r.cin END AS cin_candidate,
  CASE WHEN e.event_id % 7 = 0 THEN 'Unique Merchant ' || CAST(e.event_id % 30 * 50 AS STRING) || ' Private Limited' WHEN e.event_id % 3 = 1 THEN upper(p.p_name) || ' LTD' ELSE 'Nobody ' || CAST(e.event_id AS STRING) END AS entity_name_raw
FROM {events} e LEFT JOIN {part} p ON p.p_partkey = e.event_id % 2000 + 1
LEFT JOIN (SELECT company_key, legal_entity_identifier AS cin FROM {registry}) r ON r.company_key = e.user_id + 1
WHERE e.event_type = 'error'
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.identifiers import identifier_type, valid_cin

    r = spark.sql(REGISTRY.replace(BALANCE, CENTS), **tables(spark, sf_dir, "customer", "nation", "orders", "part"))
    kind = identifier_type(F.col("legal_entity_identifier"))
    return r.select("*", kind.alias("legal_entity_identifier_type"), (kind != "UNKNOWN").alias("legal_entity_identifier_is_valid_format"), valid_cin(F.col("legal_entity_identifier")).alias("cin"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OUTCOMES, **tables(spark, sf_dir, "orders"))


def adverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.names import legal_name, strict_name

    r = registry(spark, sf_dir).select("company_key", F.col("cin").alias("legal_entity_identifier"))
    a = spark.sql(ADVERSE, registry=r, **tables(spark, sf_dir, "events", "part"))
    return a.withColumns({"entity_name_normalized_strict": strict_name(F.col("entity_name_raw")), "entity_name_normalized_legal": legal_name(F.col("entity_name_raw"))})


CIN = "[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}"


def strict_sql(c: str) -> str:
    return f"trim(regexp_replace(upper(coalesce({c}, '')), '[^A-Z0-9]+', ' ', 'g'))"


def legal_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({strict_sql(c)}, '\\b(PRIVATE|PVT|LIMITED|LTD|LLP|COMPANY|CO)\\b', ' ', 'g'), ' +', ' ', 'g'))"


def with_sql(*parts: str) -> str:
    """WITH clause of the DuckDB twins: registry and whatever of outcomes and adverse is asked for."""
    names = dict(customer="customer", nation="nation", orders="orders", part="part", events="events", registry="registry")
    reg = REGISTRY.format(**names)
    out = [f"""registry AS (SELECT *, CASE WHEN regexp_full_match(legal_entity_identifier, '{CIN}') THEN 'CIN' WHEN regexp_full_match(legal_entity_identifier, '[A-Z]{{3}}-[0-9]{{4}}') THEN 'LLPIN' WHEN regexp_full_match(legal_entity_identifier, 'F[0-9]{{5}}') THEN 'FCRN' ELSE 'UNKNOWN' END AS kind,
      CASE WHEN regexp_full_match(legal_entity_identifier, '{CIN}') THEN legal_entity_identifier END AS cin FROM ({reg}))"""]
    if "outcomes" in parts:
        out.append(f"outcomes AS ({OUTCOMES.format(**names)})")
    if "adverse" in parts:
        cins = "(SELECT company_key, cin AS legal_entity_identifier FROM registry)"
        out.append(f"adverse AS (SELECT *, {strict_sql('entity_name_raw')} AS strict, {legal_sql('entity_name_raw')} AS legal FROM ({ADVERSE.format(**(names | {'registry': cins}))}))")
    return "WITH " + ",\n".join(out)
