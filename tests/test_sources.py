import io
import json
import urllib.error
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from tidemark.operators.checks import ContractError
from tidemark.sources import artifacts, pages, readers
from tidemark.streaming import landing

RECORD = T.StructType([T.StructField("CIN", T.StringType()), T.StructField("n", T.LongType())])


def page(records, total, **k):
    return json.dumps({"status": "ok", "total": total, "count": len(records), "records": records} | k).encode()


class Server:
    def __init__(self, records, limit, fail=()):
        self.records, self.limit, self.fail, self.asked = records, limit, list(fail), []

    def __call__(self, url):
        self.asked.append(url)
        if self.fail:
            code, headers = self.fail.pop(0)
            raise urllib.error.HTTPError(url, code, "x", headers, None)
        at = int(url.split("offset=")[1].split("&")[0])
        return io.BytesIO(page(self.records[at : at + self.limit], len(self.records)))


def client(server, **k):
    return pages.PageClient("http://x", "SECRET", server.limit, opener=server, sleep=k.pop("sleep", lambda s: None), **k)


def test_acquire_resumes_and_explodes(spark, tmp_path):
    rows = [{"CIN": f"c{i}", "n": i} for i in range(3)]
    server = Server(rows, 2, fail=[(500, {})])
    folder = str(tmp_path / "raw")
    one = pages.acquire(client(server), folder, least_free=0)
    assert one["next_offset"] == 3 and [p["record_count"] for p in one["pages"]] == [2, 1]
    again = Server(rows, 2)
    assert pages.acquire(client(again), folder, least_free=0) == one and not again.asked
    offsets = spark.createDataFrame([(p["raw_path"].rsplit("/", 1)[1], p["offset"]) for p in one["pages"]], "page_file string, page_offset long")
    got = sorted((r.source_row_number, r.CIN) for r in readers.json_pages(spark, f"{folder}/page-*.json", RECORD, offsets).collect())
    assert got == [(0, "c0"), (1, "c1"), (2, "c2")]
    (tmp_path / "raw" / "page-orphan.json").write_text("{}")
    with pytest.raises(ContractError, match="disagree"):
        pages.acquire(client(again), folder, least_free=0)


def test_retries_follow_the_server_and_hide_the_key():
    waits = []
    c = client(Server([{"n": 1}], 1, fail=[(429, {"Retry-After": "3"})]), sleep=waits.append)
    assert json.loads(c.fetch(0))["count"] == 1 and waits == [3.0]
    with pytest.raises(ContractError) as e:
        client(Server([], 1, fail=[(503, {})] * 9), attempts=2).fetch(0)
    assert "SECRET" not in str(e.value)


@pytest.mark.parametrize("data", [page([], 3), page([{}], 3, count=2), page([{}], 3, status="no"), page([{}, {}, {}], 3)])
def test_bad_pages(data):
    with pytest.raises(ContractError):
        pages.check_page(data, 0, 2, None)


def test_total_must_not_change_and_fields_are_checked():
    with pytest.raises(ContractError, match="total"):
        pages.check_page(page([{}, {}], 3), 0, 2, 4)

    def required(r):
        readers.aliased(r, {"COMPANY_NAME": ("NAME",)})

    with pytest.raises(ContractError, match="record 1"):
        pages.check_page(page([{"CompanyName": "a"}, {"x": 1}], 2), 0, 2, None, required)


def test_incomplete_page_raises_when_read(spark, tmp_path):
    (tmp_path / "p.json").write_bytes(page([{"CIN": "a", "n": 1}], 1, count=5))
    with pytest.raises(PySparkException, match="not complete"):
        readers.json_pages(spark, str(tmp_path), RECORD).collect()


def test_tsv_quarantine(spark, tmp_path):
    head = "\t".join(f"h{i}" for i in range(9))
    cin = "U12345DL2020PTC123456"
    row = lambda c, d="01-02-2020": "\t".join(["Public Announcement", d, "", '"Debtor ""X"" Ltd"', c, "", "", "", ""])
    f = tmp_path / "x.tsv"
    f.write_text("\n".join([head, row(cin), row("BAD", "bad"), "only\ttwo", row(cin, "30-02-2020"), ""]))
    got = readers.tsv_events(readers.numbered_lines(spark, str(f), tuple(f"h{i}" for i in range(9)))).orderBy("source_row_number").collect()
    assert [(r.source_row_number, r.quarantine_reason) for r in got] == [(2, None), (3, "invalid_cin"), (4, "malformed_field_count"), (5, "invalid_announcement_date")]
    assert got[0].event_date == date(2020, 2, 1) and got[0].debtor_name == 'Debtor "X" Ltd' and json.loads(got[2].raw_row_json) == ["only", "two"]
    with pytest.raises(ContractError, match="header"):
        readers.numbered_lines(spark, str(f), ("other",))


def test_csv_keeps_empty_strings(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b\n"",x\nNA,\n')
    assert [tuple(r) for r in readers.text_csv(spark, str(tmp_path / "r.csv")).collect()] == [("", "x"), ("NA", "")]


def test_artifacts_are_immutable(spark, tmp_path):
    df = spark.range(10)
    got = artifacts.publish(df, str(tmp_path / "t"))
    assert got["rows"] == 10 and got["content"] == artifacts.content_hash(df.repartition(3))["content"]
    with pytest.raises(ContractError, match="exists"):
        artifacts.publish(df, str(tmp_path / "t"))
    assert readers.parquet_parts(spark, got["parts"], str(tmp_path / "t"), ["id"]).count() == 10
    with pytest.raises(ContractError, match="digest"):
        artifacts.verify(got["parts"][0] | {"sha256": "0"}, str(tmp_path / "t"))
    artifacts.write_report(str(tmp_path / "r.json"), {"b": 1, "a": 2})
    with pytest.raises(FileExistsError):
        artifacts.write_report(str(tmp_path / "r.json"), {})
    assert artifacts.run_id({"a": 1, "b": 2}) == artifacts.run_id({"b": 2, "a": 1})


def test_manifest_rules():
    good = {"sources": [{"source_id": "s"}], "assets": [{"asset_id": "a", "source_id": "s", "provenance_status": "partial", "provenance": {"licence": "unknown"}}]}
    assert readers.checked_manifest(good) == good
    for wrong in ({"sources": [], "assets": good["assets"]}, {"sources": good["sources"] * 2, "assets": []}, {"sources": good["sources"], "assets": [good["assets"][0] | {"provenance_status": "complete"}]}):
        with pytest.raises(ContractError):
            readers.checked_manifest(wrong)


def test_stream_lands_each_page_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_bytes(page([{"CIN": "a", "n": 1}, {"CIN": "b", "n": 2}], 3))
    landing.land(landing.page_stream(spark, src, RECORD), out, mark)
    (tmp_path / "in" / "b.json").write_bytes(page([{"CIN": "c", "n": 3}], 3))
    landing.land(landing.page_stream(spark, src, RECORD), out, mark)
    landing.land(landing.page_stream(spark, src, RECORD), out, mark)
    assert sorted(r.CIN for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_broken_bodies_and_fractions_of_a_second(tmp_path):
    import http.client
    import io

    waits, calls = [], []

    class Broken(io.BytesIO):
        def read(self, *a):
            raise http.client.IncompleteRead(b"{")

    def opener(url):
        calls.append(url)
        return Broken() if len(calls) < 3 else io.BytesIO(b"{}")

    c = pages.PageClient("http://x", "key", 1, sleep=waits.append, opener=opener, first_delay=0.5)
    assert c.fetch(0) == b"{}" and waits == [0.5, 1.0]
    assert c.delay(0, "1.5") == 1.5 and c.delay(0, "Wed, 21 Oct 2015 07:28:00 GMT") == 0.5 and c.delay(0, "nan") == 0.5
