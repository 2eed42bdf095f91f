"""Sources: JSON pages, delimited text with quarantine, all-string CSV, verified Parquet parts, spreadsheets, manifests."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parsed
from ..functions.identifiers import valid_cin
from ..operators.checks import ContractError
from .artifacts import verify


def snake_upper(name: str) -> str:
    """CompanyROCcode or `Listing status` -> upper case words joined by underscores."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub("[^A-Za-z0-9]+", "_", spaced).strip("_").upper()


def aliased(columns: Iterable[str], aliases: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Required name -> the source column that stands for it; a missing one is an error."""
    by_name = {snake_upper(c): c for c in columns}
    out = {want: next((by_name[a] for a in (want, *also) if a in by_name), None) for want, also in aliases.items()}
    if gone := sorted(k for k, v in out.items() if v is None):
        raise ContractError(f"missing fields: {', '.join(gone)}")
    return out


def json_pages(spark: SparkSession, path: str, record: T.StructType, offsets: DataFrame | None = None) -> DataFrame:
    """Rows of landed pages {status, total, count, records}, each with its place: offset of the page plus position in it.

    offsets: (page_file, page_offset), from the acquisition checkpoint.
    """
    page = T.StructType([T.StructField("status", T.StringType()), T.StructField("total", T.LongType()), T.StructField("count", T.LongType()), T.StructField("records", T.ArrayType(record))])
    pages = spark.read.schema(page).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("page_file"))
    return exploded_pages(pages if offsets is None else pages.join(F.broadcast(offsets), "page_file"))


def exploded_pages(pages: DataFrame) -> DataFrame:
    """One row a record; a page whose count is not the number of its records raises when it is read."""
    offset = F.col("page_offset") if "page_offset" in pages.columns else F.lit(0)
    ok = (F.col("status") == "ok") & (F.col("count") == F.size("records"))
    records = F.when(F.coalesce(ok, F.lit(False)), F.col("records")).otherwise(F.raise_error(F.concat(F.lit("page is not complete: "), F.col("page_file"))).cast(pages.schema["records"].dataType))
    return pages.select("page_file", offset.cast("long").alias("o_"), F.posexplode(records).alias("i_", "r_")).select("page_file", (F.col("o_") + F.col("i_")).alias("source_row_number"), "r_.*")


def fields(line: Column, delimiter: str = "\t") -> Column:
    """A line's fields; outer quotes go and doubled ones become one."""
    parts = F.split(line, re.escape(delimiter), -1)
    quoted = lambda x: x.rlike(r'(?s)\A".*"\z')
    return F.transform(parts, lambda x: F.when(quoted(x), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), '""', '"')).otherwise(x))


def tsv_events(lines: DataFrame, n_fields: int = 9, types: tuple[str, ...] = ()) -> DataFrame:
    """lines (source_row_number, value) as announcements with quarantine_reason: field count, then identifier, then date, then type; null where all is well."""
    f = lines.select("source_row_number", fields(F.col("value")).alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    when, cin, kind = parsed(at(1), "dd-MM-yyyy"), valid_cin(at(4)), F.trim(at(0))
    reason = F.when(F.size("f") != n_fields, "malformed_field_count").when(cin.isNull(), "invalid_cin").when(when.isNull(), "invalid_announcement_date")
    if types:
        reason = reason.when(~kind.isin(*types), "unknown_announcement_type")
    return f.select(
        "source_row_number", kind.alias("announcement_type"), when.alias("event_date"), cin.alias("cin"), F.trim(at(3)).alias("debtor_name"), reason.alias("quarantine_reason"),
        F.size("f").cast("long").alias("raw_field_count"), F.to_json("f").alias("raw_row_json"),
    )


def numbered_lines(spark: SparkSession, path: str, header: tuple[str, ...] | None = None) -> DataFrame:
    """Lines of one delimited file with their numbers (first data line 2); the header must be exact.

    Numbers need the file's order, so the file is one partition: registers of this kind are small.
    """
    whole = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n", -1).alias("l"))
    if header is not None and tuple(whole.select(F.split(F.col("l")[0], "\t", -1)).first()[0]) != tuple(header):
        raise ContractError("the header differs from the contract")
    rows = whole.select(F.posexplode("l").alias("i", "value")).filter("i > 0")
    return rows.filter(F.col("value") != "").select((F.col("i") + 1).cast("long").alias("source_row_number"), "value")


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, all strings; an empty field is the empty string, not null."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue="\0", emptyValue="")
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def parquet_parts(spark: SparkSession, artifacts: list[dict], root: str, columns: list[str]) -> DataFrame:
    """Parts that a report names, checked against their digests, read with these columns only."""
    for a in artifacts:
        verify(a, root)
    return spark.read.parquet(*[f"{root}/{a['path']}" for a in artifacts]).select(*columns)


def spreadsheet(spark: SparkSession, path: str, sheet: str, rows: int | None = None) -> DataFrame:
    """A workbook's sheet as strings; needs a spreadsheet library for pandas, which is loaded only here."""
    import pandas as pd

    pdf = pd.read_excel(path, sheet_name=sheet, dtype=str, keep_default_na=False)
    if rows is not None and len(pdf) != rows:
        raise ContractError(f"{sheet} has {len(pdf)} rows, not {rows}")
    pdf.insert(0, "source_row_number", range(2, len(pdf) + 2))
    return spark.createDataFrame(pdf)


def manifest(path: str) -> dict:
    """A YAML source manifest: unique ids, every asset's source declared, unknown provenance never complete."""
    import yaml

    with open(path, encoding="utf-8") as f:
        m = yaml.safe_load(f)
    return checked_manifest(m)


def checked_manifest(m: dict) -> dict:
    sources, assets = m.get("sources", []), m.get("assets", [])
    for kind, items, key in (("source", sources, "source_id"), ("asset", assets, "asset_id")):
        ids = [x[key] for x in items]
        if len(ids) != len(set(ids)):
            raise ContractError(f"{kind} ids repeat")
    known = {x["source_id"] for x in sources}
    for a in assets:
        if a["source_id"] not in known:
            raise ContractError(f"{a['asset_id']} names an undeclared source")
        if a.get("provenance_status") == "complete" and "unknown" in {str(v).lower() for v in a.get("provenance", {}).values()}:
            raise ContractError(f"{a['asset_id']} can't be complete with unknown provenance")
    return m


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))
