"""Immutable artifacts: written once, checksummed, named by content; reports and checkpoints on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.checks import ContractError


def run_id(parameters: dict) -> str:
    """SHA-256 of the canonical JSON; equal inputs give equal names, and so a refusal to overwrite."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _digest(path: Path) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def content_hash(df: DataFrame) -> dict:
    """Rows and an order-free hash of all columns: equal data, whatever the files."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return {"rows": r.n, "content": r.h}


def publish(df: DataFrame, target: str, codec: str = "zstd") -> dict:
    """Write to a folder beside the target, describe what was written, then rename; an existing target is an error."""
    to = Path(target)
    if to.exists():
        raise ContractError(f"{target} exists")
    draft = to.with_name(f".{to.name}-{uuid.uuid4().hex}")
    try:
        df.write.mode("errorifexists").option("compression", codec).parquet(str(draft))
        parts = [{"path": p.name, "bytes": p.stat().st_size, "sha256": _digest(p)} for p in sorted(draft.glob("part-*"))]
        described = {"parts": parts, **content_hash(df.sparkSession.read.schema(df.schema).parquet(str(draft)))}
        to.parent.mkdir(parents=True, exist_ok=True)
        os.rename(draft, to)  # atomic; fails on a target that is not an empty folder
    finally:
        shutil.rmtree(draft, ignore_errors=True)
    return described


def verify(artifact: dict, root: str) -> None:
    """Existence, then size, then digest."""
    path = Path(root, artifact["path"])
    if not path.is_file():
        raise ContractError(f"missing: {path}")
    if path.stat().st_size != artifact["bytes"]:
        raise ContractError(f"size differs: {path}")
    if _digest(path) != artifact["sha256"]:
        raise ContractError(f"digest differs: {path}")


def write_report(path: str, report: dict) -> None:
    """Sorted JSON, never over an existing file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "x", encoding="utf-8") as f:
        json.dump(report, f, sort_keys=True, indent=2, default=str)
        f.flush()
        os.fsync(f.fileno())


def replace_checkpoint(path: str, state: dict) -> None:
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "x", encoding="utf-8") as f:
        json.dump(state, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, path)


def publish_bytes(folder: str, name: str, data: bytes) -> dict:
    """Bytes under a name with their digest; a hard link refuses to replace."""
    digest = hashlib.sha256(data).hexdigest()
    to = Path(folder, f"{name}-{digest[:16]}.json")
    to.parent.mkdir(parents=True, exist_ok=True)
    draft = to.with_name(f".{uuid.uuid4().hex}")
    draft.write_bytes(data)
    try:
        os.link(draft, to)
    finally:
        draft.unlink()
    return {"raw_path": str(to), "sha256": digest, "byte_count": len(data)}


def no_formula(c: Column) -> Column:
    """Text that a spreadsheet would run gets a quote in front."""
    return F.when(c.rlike(r"\A[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def spreadsheet_cell(c: Column, kind: str) -> Column:
    """A cell as text: empty for null, true and false in lower case, dates in ISO form, and nothing that a spreadsheet would run."""
    text = F.when(c, "true").otherwise("false") if kind == "boolean" else F.date_format(c, "yyyy-MM-dd") if kind == "date" else c.cast("string")
    return no_formula(F.when(c.isNull(), "").otherwise(text))


def write_review_csv(df: DataFrame, path: str) -> None:
    """One CSV with safe cells, for people; df is a bounded sample."""
    df.select(*[spreadsheet_cell(F.col(f"`{f.name}`"), f.dataType.typeName()).alias(f.name) for f in df.schema.fields]).coalesce(1).write.csv(path, header=True, quoteAll=True)
