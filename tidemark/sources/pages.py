"""A resumable client for offset/limit pages; runs on the driver and lands raw pages for Spark to read."""

from __future__ import annotations

import functools
import http.client
import json
import math
import shutil
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from pathlib import Path

from ..operators.checks import ContractError
from .artifacts import _digest, publish_bytes, replace_checkpoint

RETRY = frozenset({408, 425, 429, 500, 502, 503, 504})


class PageClient:
    """fetch(offset) with retries; the key goes into the request and never into a message."""

    def __init__(self, url: str, key: str, limit: int, attempts: int = 5, first_delay: float = 1.0, longest_delay: float = 60.0, opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep, timeout: float = 60.0):
        self.url, self._key, self.limit, self.attempts = url, key, limit, attempts
        self.first_delay, self.longest_delay, self._open, self._sleep = first_delay, longest_delay, opener or functools.partial(urllib.request.urlopen, timeout=timeout), sleep

    def delay(self, attempt: int, retry_after: str | None) -> float:
        """Doubling from first_delay, never less than the server asks for in seconds (fractions too), never more than longest_delay."""
        try:
            wanted = float(retry_after or 0)
        except ValueError:  # a date
            wanted = 0.0
        wanted = wanted if math.isfinite(wanted) else 0.0
        return min(max(self.first_delay * 2**attempt, wanted), self.longest_delay)

    def fetch(self, offset: int) -> bytes:
        query = urllib.parse.urlencode({"api-key": self._key, "format": "json", "offset": offset, "limit": self.limit})
        for attempt in range(self.attempts):
            after, why = None, "connection error"
            try:
                with self._open(f"{self.url}?{query}") as r:
                    return r.read()
            except urllib.error.HTTPError as e:
                why, after = f"HTTP {e.code}", e.headers.get("Retry-After") if e.headers else None
                if e.code not in RETRY:
                    raise ContractError(f"offset {offset}: {why}") from None
            except (urllib.error.URLError, TimeoutError, ConnectionError, http.client.IncompleteRead):
                pass
            if attempt + 1 < self.attempts:
                self._sleep(self.delay(attempt, after))
        raise ContractError(f"offset {offset}: {why} after {self.attempts} attempts")


def check_page(data: bytes, offset: int, limit: int, total: int | None, required: Callable[[dict], None] | None = None) -> dict:
    """The page, if it is complete: ok, count right, total unchanged, neither short nor over, every record with its fields."""
    page = json.loads(data)
    records = page.get("records")
    if page.get("status") != "ok" or not isinstance(records, list) or page.get("count") != len(records):
        raise ContractError(f"offset {offset}: the page is not complete")
    if total is not None and page.get("total") != total:
        raise ContractError(f"offset {offset}: the total changed")
    if len(records) != min(limit, int(page["total"]) - offset) or not records:
        raise ContractError(f"offset {offset}: {len(records)} records")
    for i, r in enumerate(records):
        if required is not None:
            try:
                required(r)
            except ContractError as e:
                raise ContractError(f"record {i}: {e}") from None
    return page


def acquire(client: PageClient, folder: str, least_free: int = 25 * 10**9, required: Callable[[dict], None] | None = None) -> dict:
    """Fetch what is missing, page by page; the checkpoint names every page with its digest, and earlier pages are verified first."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    mark = root / "checkpoint.json"
    state = json.loads(mark.read_text()) if mark.exists() else {"page_size": client.limit, "next_offset": 0, "total_records": None, "pages": []}
    at, named = 0, set()
    for p in state["pages"]:
        if p["offset"] != at or _digest(Path(p["raw_path"])) != p["sha256"]:
            raise ContractError(f"the page at {p['offset']} is not what the checkpoint says")
        at, named = at + p["record_count"], named | {Path(p["raw_path"]).name}
    if at != state["next_offset"] or {p.name for p in root.glob("page-*")} - named:
        raise ContractError("pages and checkpoint disagree")
    while state["total_records"] is None or state["next_offset"] < state["total_records"]:
        if shutil.disk_usage(root).free < least_free:
            raise ContractError("too little disk")
        data = client.fetch(state["next_offset"])
        page = check_page(data, state["next_offset"], client.limit, state["total_records"], required)
        entry = publish_bytes(folder, f"page-{state['next_offset']:09d}", data) | {"offset": state["next_offset"], "requested_limit": client.limit, "record_count": len(page["records"]), "total_records": page["total"]}
        state = state | {"pages": [*state["pages"], entry], "next_offset": state["next_offset"] + len(page["records"]), "total_records": page["total"]}
        replace_checkpoint(str(mark), state)
    return state
