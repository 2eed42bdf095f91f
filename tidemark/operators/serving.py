"""The merchant index, lookups in batch and one at a time, and batch assessment."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket
from ..functions.identifiers import CIN_PATTERN, valid_cin
from ..functions.names import legal_name, legal_text, strict_name, strict_text, stripped
from .checks import require

MAX_LISTED = 10


def index(features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Eligible rows with their normalised names and how many share the strict one; written sorted by identifier."""
    named = features.filter("evaluation_eligible").select(*columns, strict_name(F.col("company_name")).alias("company_name_normalized_strict"), legal_name(F.col("company_name")).alias("company_name_normalized_legal"))
    same = named.groupBy("company_name_normalized_strict").agg(F.count("*").cast("int").alias("strict_name_collision_count"))
    return named.join(same, "company_name_normalized_strict")


def write_index(rows: DataFrame, path: str, files: int = 16) -> None:
    """Range-partitioned and sorted by identifier, so a lookup reads one row group."""
    require(rows, unique=("cin",))
    rows.repartitionByRange(files, "cin").sortWithinPartitions("cin").write.option("compression", "zstd").parquet(path)


def lookup(queries: DataFrame, idx: DataFrame) -> DataFrame:
    """Every query (query_id, cin, company_name) resolved: exact identifier, else strict name, else legal name.

    A malformed identifier never falls back to the name, and an ambiguous name stops
    the cascade.  Names are looked up in name totals, one row a name, so a common name
    never multiplies the queries.
    """
    given = F.upper(stripped(F.coalesce("cin", F.lit(""))))
    q = queries.select("query_id", given.alias("asked"), valid_cin(F.col("cin")).alias("valid"), strict_name(F.col("company_name")).alias("strict"), legal_name(F.col("company_name")).alias("legal"))
    listed = idx.select(F.col("cin"), F.col("company_name_normalized_strict").alias("s"), F.col("company_name_normalized_legal").alias("l"))

    def names(key: str, tag: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy("cin"))
        n = listed.filter(F.col(key) != "").groupBy(key).agg(F.count("*").alias(f"{tag}_n"))
        first = listed.filter(F.col(key) != "").withColumn("r", rank).filter(F.col("r") <= MAX_LISTED).groupBy(key).agg(F.sort_array(F.collect_list("cin")).alias(f"{tag}_cins"))
        return n.join(first, key).withColumnRenamed(key, f"{tag}_key")

    exact = listed.select(F.col("cin").alias("exact"))
    j = q.join(exact, q.valid == exact.exact, "left")
    s, l = names("s", "strict"), names("l", "legal")  # noqa: E741
    j = j.join(s, (j.strict == s.strict_key) & (j.asked == ""), "left").join(l, (j.legal == l.legal_key) & (j.asked == ""), "left")
    by_cin = F.col("asked") != ""
    n_s, n_l = F.coalesce("strict_n", F.lit(0)), F.coalesce("legal_n", F.lit(0))
    outcome = (
        F.when(by_cin & F.col("valid").isNull(), "invalid_identifier").when(by_cin, F.when(F.col("exact").isNotNull(), "matched").otherwise("no_match")).when(F.col("strict") == "", "no_match")
        .when(n_s == 1, "matched").when(n_s > 1, "ambiguous_name").when(n_l == 1, "matched").when(n_l > 1, "ambiguous_name").otherwise("no_match")
    )
    method = F.when(outcome == "matched", F.when(by_cin, "exact_cin").when(n_s == 1, "normalized_strict_name").otherwise("normalized_legal_name"))
    found = F.when(outcome == "matched", F.when(by_cin, F.col("exact")).when(n_s == 1, F.col("strict_cins")[0]).otherwise(F.col("legal_cins")[0]))
    several = F.when(outcome == "ambiguous_name", F.array_join(F.when(n_s > 1, F.col("strict_cins")).otherwise(F.col("legal_cins")), ","))
    return j.select("query_id", outcome.alias("outcome"), method.alias("match_method"), found.alias("matched_cin"), several.alias("candidate_cins"))


@dataclass(frozen=True)
class Found:
    outcome: str
    method: str | None = None
    row: dict | None = None
    candidates: tuple[str, ...] = ()


class IndexReader:
    """One lookup at a time without a Spark job: filters pushed into the sorted Parquet files by pyarrow."""

    def __init__(self, path: str):
        import pyarrow.dataset as ds

        self._data = ds.dataset(path, format="parquet")

    def _rows(self, column: str, value: str) -> list[dict]:
        import pyarrow.dataset as ds

        return sorted(self._data.to_table(filter=ds.field(column) == value).to_pylist(), key=lambda r: r["cin"])

    def find(self, cin: str | None = None, company_name: str | None = None) -> Found:
        asked, name = (cin or "").strip().upper(), (company_name or "").strip()
        if not asked and not name:
            raise ValueError("a CIN or a company name is required")
        if asked:
            if not re.fullmatch(CIN_PATTERN, asked):
                return Found("invalid_identifier")
            rows = self._rows("cin", asked)
            return Found("matched", "exact_cin", rows[0]) if rows else Found("no_match")
        for column, value, method in (("company_name_normalized_strict", strict_text(name), "normalized_strict_name"), ("company_name_normalized_legal", legal_text(name), "normalized_legal_name")):
            if not strict_text(name):
                break
            rows = self._rows(column, value) if value else []
            if len(rows) == 1:
                return Found("matched", method, rows[0])
            if rows:
                return Found("ambiguous_name", None, None, tuple(r["cin"] for r in rows[:MAX_LISTED]))
        return Found("no_match")


HTTP_STATUS = {"matched": 200, "invalid_identifier": 422, "no_match": 404, "ambiguous_name": 409, "unconfigured": 503}


def assess(found: DataFrame, scores: DataFrame, band: Column, stale: bool, measured: tuple[str, ...]) -> DataFrame:
    """Lookups with score, band, confidence and the status that a service answers with."""
    j = found.join(scores.select(F.col("cin").alias("matched_cin"), "score"), "matched_cin", "left").withColumn("risk_band", F.when(F.col("score").isNotNull(), band))
    low = (F.col("match_method") != "exact_cin") | F.lit(stale) | ~F.col("risk_band").isin(*measured)
    status = F.create_map(*[F.lit(x) for kv in HTTP_STATUS.items() for x in kv])
    return j.withColumns({"confidence": F.when(F.col("risk_band").isNotNull(), F.when(low, "low").otherwise("moderate")), "http_status": F.element_at(status, F.col("outcome"))})


def demo_scenarios(scored: DataFrame) -> DataFrame:
    """One example of each band: the row in the middle of its falling scores."""
    w = Window.partitionBy("risk_band")
    r = scored.select("*", F.row_number().over(w.orderBy(F.desc("score"), "cin")).alias("r_"))
    n = scored.groupBy("risk_band").agg(F.count("*").alias("n_"))
    return r.join(F.broadcast(n), "risk_band").filter(F.col("r_") == F.floor(F.col("n_") / 2) + 1).drop("r_", "n_")


def hash_sample(df: DataFrame, key: str, per_million: int, seed: int = 0) -> DataFrame:
    """About per_million of each million keys; the same ones on every engine."""
    return df.filter(bucket(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 1_000_000) < per_million)
