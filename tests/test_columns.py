from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, hashing, identifiers, names
from tidemark.sources.artifacts import no_formula

RAW = ["U12345DL2020PTC123456", " l99999mh1999plc000001 ", "U99999ZZ9999ZZZ000000", "U99999MH9999PTC000001", "AAA-1111", "F01234", "TEST1", "", "   ", None, "U12345DL2020PTC12345", "U12345DL2020PTC1234567", "U12345DL2020PTC123456\n"]


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("value", "want"), [("Merchant Evidence Pvt. Ltd.", "MERCHANT EVIDENCE PVT LTD"), (" 12, Risk Road; New Delhi ", "12 RISK ROAD NEW DELHI"), (None, ""), ("!!! ---", ""), ("straße", "STRASSE")])
def test_strict_name(spark, value, want):
    assert one(spark, names.strict_name, value) == want == names.strict_text(value)


@pytest.mark.parametrize(("value", "want"), [("Merchant Evidence Pvt. Ltd.", "MERCHANT EVIDENCE"), ("Company & Co LLP", ""), ("Acme Company of Ltd Things", "ACME OF THINGS"), (None, "")])
def test_legal_name(spark, value, want):
    assert one(spark, names.legal_name, value) == want == names.legal_text(value)


def test_identifier_types(spark):
    got = [one(spark, identifiers.identifier_type, v) for v in ("U12345DL2020PTC123456", "AAA-1111", "F01234", "TEST1", None)]
    assert got == ["CIN", "LLPIN", "FCRN", "UNKNOWN", "UNKNOWN"]


def test_scalar_and_column_decode_agree(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(RAW)], "i int, cin string")
    for r in df.select("i", "cin", *identifiers.decoded(F.col("cin"))).collect():
        d = identifiers.decode(r.cin)
        if d is None:
            assert r.cin_listing_letter is None and r.cin_registrar_year_cohort_key is None
        else:
            assert (r.cin_listing_letter, r.cin_nic_code, r.cin_state_name, r.cin_incorporation_year, r.cin_roc_serial, r.cin_registrar_year_cohort_key) == (d.listing_letter, d.nic_code, d.state_name, d.incorporation_year, d.roc_serial, d.cohort_key)
    assert identifiers.decode("U99999ZZ9999ZZZ000000").state_name == "UNKNOWN"
    assert identifiers.decode("U99999MH9999PTC000001").incorporation_year == 9999


def test_disagreement_is_tri_state(spark):
    rows = [("U12345DL2020PTC123456", date(2019, 1, 1), "12", "Unlisted", "Delhi "), ("U12345ZZ2020PTC123456", None, "1x", "", "goa"), ("AAA-1111", date(2019, 1, 1), "12", "Listed", "goa"), ("L12345DL2020PTC123456", date(2020, 1, 1), "9900", "unlisted", "goa")]
    df = spark.createDataFrame(rows, "cin string, d date, nic string, listing string, state string")
    got = [tuple(r) for r in df.select(*identifiers.disagreements(*[F.col(c) for c in df.columns])).collect()]
    assert got == [(True, False, False, False, 1), (None, None, None, None, 0), (None, None, None, None, 0), (False, True, True, True, 3)]


def test_hash_bucket_equals_python(spark):
    import hashlib

    for v in ("karnataka", "goa", "x" * 50):
        n = int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "big")
        assert one(spark, lambda c: hashing.bucket(c, 7), v) == n % 7


def test_dates(spark):
    assert one(spark, dates.iso_date, "2020-02-30") is None
    assert one(spark, dates.mixed_day_first, " 03-Nov-2023 ") == date(2023, 11, 3)
    assert one(spark, dates.mixed_day_first, "03/04/2023") == date(2023, 4, 3)
    assert [one(spark, dates.has_offset, v) for v in ("2024-01-01T10:00:00+05:30", "2024-01-01T10:00:00", "2024-13-01T10:00:00Z")] == [True, False, False]


@pytest.mark.parametrize(("value", "want"), [("=1+1", "'=1+1"), ("+x", "'+x"), ("-x", "'-x"), ("@x", "'@x"), ("x=1", "x=1"), ("", ""), (None, None)])
def test_no_formula(spark, value, want):
    assert one(spark, no_formula, value) == want


def test_candidates_need_a_whole_match(spark):
    assert one(spark, lambda c: identifiers.candidate(c, identifiers.CIN_PATTERN), "1" * 21) is None
    assert one(spark, lambda c: identifiers.candidate(c, identifiers.PAN_PATTERN), "abcde1234f") == "ABCDE1234F"
