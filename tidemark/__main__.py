"""Command line: each command reads named inputs, publishes an immutable artifact, and writes a report that refuses to be replaced.

    python -m tidemark query solvency_observation --data DIR --out DIR
    python -m tidemark link --companies P --events P --out DIR
    python -m tidemark evaluate --observations P --start 2026-01-01 --out report.json
    python -m tidemark verdict --report report.json --out verdict.json
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import decide, evaluate, linkage, serving
from .plans import evidence
from .sources import artifacts, pages, readers

UNITS = {
    "shared_address": {"signal": "shared_address_signal", "score": "shared_address_company_count", "group": "address_group_key"},
    "address_registration_month_cohort": {"signal": "cohort_signal", "score": "address_registration_month_company_count", "group": "cohort_key"},
}


def session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def published(df: DataFrame, out: str, parameters: dict) -> dict:
    """The artifact under its run id, and its report beside it."""
    run = artifacts.run_id(parameters)
    described = artifacts.publish(df, f"{out}/run-{run}")
    report = {"run_id": run, "parameters": parameters, **described}
    artifacts.write_report(f"{out}/report-{run}.json", report)
    return report


def query(a) -> dict:
    return published(evidence.QUERIES[a.name](session(), a.data), a.out, {"query": a.name, "data": a.data})


def acquire(a) -> dict:
    state = pages.acquire(pages.PageClient(a.url, os.environ[a.key_variable], a.limit), a.folder)
    return {k: v for k, v in state.items() if k != "pages"} | {"pages": len(state["pages"])}


def manifest(a) -> dict:
    m = readers.manifest(a.path)
    return {"sources": len(m.get("sources", [])), "assets": len(m.get("assets", []))}


def verify(a) -> dict:
    with open(a.report, encoding="utf-8") as f:
        parts = json.load(f)["parts"]
    for p in parts:
        artifacts.verify(p, a.root)
    return {"verified_parts": len(parts)}


def link(a) -> dict:
    spark = session()
    companies, events = spark.read.parquet(a.companies), spark.read.parquet(a.events)
    found = published(linkage.candidates(companies, events), f"{a.out}/candidates", {"companies": a.companies, "events": a.events})
    kept = spark.read.parquet(f"{a.out}/candidates/run-{found['run_id']}")
    decided = published(linkage.decisions(events, kept), f"{a.out}/decisions", {"candidates": found["run_id"]})
    counts = spark.read.parquet(f"{a.out}/decisions/run-{decided['run_id']}").groupBy("review_status").count()
    return {"candidates": found["rows"], "decisions": {r.review_status: r["count"] for r in counts.collect()}, "run_id": decided["run_id"]}


def evaluate_signals(a) -> dict:
    o = session().read.parquet(a.observations)
    o = o.withColumns({
        "shared_address_signal": F.col("shared_address_company_count") > 1, "cohort_signal": F.col("address_registration_month_company_count") > 1,
        "cohort_key": F.concat("address_group_key", F.lit(":"), F.date_format("registration_date", "yyyy-MM")),
    })
    report = evaluate.evaluation_report(o, UNITS, date.fromisoformat(a.start), simulations=a.simulations)
    artifacts.write_report(a.out, report)
    return {"units": list(report["units"]), "holdout_states": report["holdout_states"]}


def slice_evidence(metrics: dict) -> dict[str, decide.SliceEvidence]:
    pair = lambda v: tuple(v) if v else None
    return {s: decide.SliceEvidence(pair(m.get("precision_interval")), pair(m.get("base_rate_interval")), m["requested_review_capacity"], m.get("realized_review_capacity"), m["false_positive_review_cost"], m.get("p_value")) for s, m in metrics.items()}


def verdict(a) -> dict:
    with open(a.report, encoding="utf-8") as f:
        r = json.load(f)
    units = r["units"]
    positives = {s: m.get("positive_rows", 0) for s, m in units["shared_address"].items()}
    ready = decide.evidence_ready(positives, len(r["holdout_states"]))
    decision, signal, reasons = decide.verdict(slice_evidence(units["shared_address"]), slice_evidence(units["address_registration_month_cohort"]), ready)
    out = {"verdict": decision, "selected_signal": signal, "reason_codes": reasons, "evidence_ready": ready, "training": decide.training_decision(positives["overall"])}
    artifacts.write_report(a.out, out)
    return out


def index(a) -> dict:
    rows = serving.index(session().read.parquet(a.features), tuple(a.columns.split(",")))
    serving.write_index(rows, a.out)
    return {"index": a.out}


def lookup(a) -> dict:
    found = serving.IndexReader(a.index).find(a.cin, a.name)
    return {"outcome": found.outcome, "status": serving.HTTP_STATUS[found.outcome], "method": found.method, "row": found.row, "candidates": found.candidates}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(required=True)

    def command(title: str, run, /, *needed: str, **optional) -> argparse.ArgumentParser:
        c = sub.add_parser(title)
        c.set_defaults(run=run)
        for n in needed:
            c.add_argument(f"--{n}", required=True)
        for n, (kind, default) in optional.items():
            c.add_argument(f"--{n.replace('_', '-')}", type=kind, default=default)
        return c

    command("query", query, "data", "out").add_argument("name", choices=sorted(evidence.QUERIES))
    command("acquire", acquire, "url", "folder", key_variable=(str, "PAGE_API_KEY"), limit=(int, 10_000))
    command("manifest", manifest, "path")
    command("verify", verify, "report", "root")
    command("link", link, "companies", "events", "out")
    command("evaluate", evaluate_signals, "observations", "start", "out", simulations=(int, 500))
    command("verdict", verdict, "report", "out")
    command("index", index, "features", "columns", "out")
    command("lookup", lookup, "index", cin=(str, None), name=(str, None))
    return p


def main(args: list[str] | None = None) -> dict:
    a = parser().parse_args(args)
    out = a.run(a)
    print(json.dumps(out, sort_keys=True, default=str))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
