"""Canonical rows, labels from decisions, held-out evaluation, bands and model packages."""

import json
import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import canonical, checks, decide, evaluate, holdout, labels, linkage, model, package
from tidemark.sources.artifacts import spreadsheet_cell


def raw_company(spark, **given):
    row = dict.fromkeys((*canonical.COMPANY_FIELDS, "Registered_Office_Address")) | {"CIN": " u12345mh2001ptc123456 ", "CompanyRegistrationdate_date": "2001-02-30", "AuthorizedCapital": "10.505", "PaidupCapital": "ten"} | given
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"`{c}` string" for c in row))


def test_companies_keep_rows_that_are_malformed(spark):
    r = canonical.companies(raw_company(spark), "snap", date(2023, 11, 3)).first()
    assert (r.legal_entity_identifier, r.cin, r.llpin, r.registration_date, str(r.authorised_capital_inr), r.paid_up_capital_inr) == ("U12345MH2001PTC123456", "U12345MH2001PTC123456", None, None, "10.51", None)
    other = canonical.companies(raw_company(spark, CIN="x-1"), "snap", date(2023, 11, 3))
    assert other.first().legal_entity_identifier_type == "UNKNOWN" and other.first().cin is None
    report = canonical.company_report(other).first()
    assert (report.invalid_legal_entity_identifier_rows, report.quality_passed) == (1, False)
    with pytest.raises(checks.ContractError, match="CIN"):
        canonical.companies(raw_company(spark).drop("CIN"), "snap", date(2023, 11, 3))


def test_companies_without_an_identifier_have_no_key(spark):
    r = canonical.companies(raw_company(spark, CIN=None), "snap", date(2023, 11, 3)).first()
    assert (r.company_snapshot_id, r.source_record_id, r.legal_entity_identifier_type, r.legal_entity_identifier_is_valid_format) == (None, None, "UNKNOWN", False)


def test_addresses_are_grouped_by_their_normal_form(spark):
    one = lambda a: canonical.addresses(raw_company(spark, Registered_Office_Address=a), "snap", date(2023, 11, 3)).first().address_group_key
    assert one(" 12/a,  Main road ") == one("12 A MAIN ROAD") == "12 A MAIN ROAD" and one(None) == ""


def test_addresses_without_an_identifier_have_no_key(spark):
    one = lambda **given: canonical.addresses(raw_company(spark, **given), "snap", date(2023, 11, 3)).first()
    assert one(CIN=None).company_address_snapshot_id is None and one(CIN=" ").company_address_snapshot_id == "snap:" and one(CIN=" x-1").company_address_snapshot_id == "snap:X-1"


def test_events_need_all_their_fields(spark):
    row = {c: None for c in canonical.EVENT_FIELDS} | {"DIN / CIN": " 00012345 ", "PAN": "abcde1234f", "Order Date": "05-FEB-2020", "Date of NSE circular": "06/02/2020", "source_row_number": "7"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{c}` string" for c in row))
    r = canonical.adverse_events(df, "nse_other", "sum", "snap", "now").first()
    assert (r.adverse_event_id, r.din_candidate, r.cin_candidate, r.pan_candidate, r.event_date, r.nse_debarment_circular_date, r.event_source_authority) == ("nse_other:sum:7", "00012345", None, "ABCDE1234F", date(2020, 2, 5), date(2020, 2, 6), "OTHER_AUTHORITY")
    with pytest.raises(checks.ContractError, match="Revocation"):
        canonical.adverse_events(df.drop("NSE Circular No. (For Revocation)"), "nse_other", "sum", "snap", "now")


def decided(spark, *rows):
    return spark.createDataFrame(rows, "adverse_event_id string, review_status string, accepted_company_snapshot_id string, outcome_eligible boolean")


def test_labels_from_decisions(spark):
    d = decided(spark, ("a", "accepted", "c1", True), ("b", "ambiguous", None, False), ("c", "accepted", "c2", False))
    events = spark.createDataFrame([("a", date(2024, 1, 1)), ("b", date(2024, 1, 2)), ("c", None)], "adverse_event_id string, event_date date")
    assert [tuple(r) for r in labels.accepted_events(d, events).collect()] == [("a", "c1", date(2024, 1, 1))]
    assert labels.label_policy(d).first()[0] == labels.EXACT_ONLY
    assert labels.label_policy(d.union(decided(spark, ("e", "accepted_reviewed", "c3", True)))).first()[0] == labels.EXACT_OR_REVIEWED
    with pytest.raises(Exception, match="guessed"):
        labels.label_policy(d.union(decided(spark, ("e", "guessed", "c3", True)))).collect()
    with pytest.raises(Exception, match="repeated"):
        labels.accepted_events(d, events.union(events)).collect()


def test_both_sides_have_one_snapshot(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "source_snapshot_id string")
    assert checks.one_snapshot(df("s", "s"), df("s")).first()[0] == "s"
    for left, right in ((df("s"), df("t")), (df("s", None), df("s")), (df("s"), df()), (df("s", "t"), df("s"))):
        with pytest.raises(Exception, match="one source_snapshot_id"):
            checks.one_snapshot(left, right).collect()


def test_common_names_make_no_product(spark):
    n = 60
    companies = spark.createDataFrame([(f"c{i:03d}", None, "Same Name Ltd") for i in range(n)], "company_snapshot_id string, cin string, company_name string")
    events = spark.createDataFrame([(f"e{i}", None, "SAME NAME LTD", "SAME NAME") for i in range(4)], "adverse_event_id string, cin_candidate string, entity_name_normalized_strict string, entity_name_normalized_legal string")
    got = linkage.candidates(companies, events)
    assert got.groupBy("adverse_event_id").count().collect()[0]["count"] == linkage.MAX_CANDIDATES
    assert {(r.candidate_count, r.candidate_set_truncated) for r in got.collect()} == {(n, True)}
    assert sorted(r.company_snapshot_id for r in got.filter("adverse_event_id = 'e0'").collect()) == [f"c{i:03d}" for i in range(linkage.MAX_CANDIDATES)]


def scored(spark, rows):
    return spark.createDataFrame([(f"c{i:04d}", s, int(t), float(x)) for i, (s, t, x) in enumerate(rows)], "company_snapshot_id string, dataset_split string, target int, score double")


def test_split_metrics_equal_plain_counts(spark):
    rng = np.random.default_rng(4)
    y, x = rng.random(500) < 0.2, np.round(rng.random(500), 2)
    got = holdout.split_metrics(scored(spark, [("temporal_test", a, b) for a, b in zip(y, x, strict=True)])).first()
    pairs = (x[y][:, None] > x[~y]) + 0.5 * (x[y][:, None] == x[~y])
    assert math.isclose(got.roc_auc, pairs.mean()) and math.isclose(got.brier_score, ((x - y) ** 2).mean()) and math.isclose(got.accuracy_at_0_5, ((x >= 0.5) == y).mean())
    with pytest.raises(Exception, match="both outcomes"):
        holdout.split_metrics(scored(spark, [("temporal_test", 1, 0.5)])).collect()
    with pytest.raises(Exception, match="another split"):
        holdout.split_metrics(scored(spark, [("training", 1, 0.5), ("training", 0, 0.5)])).collect()


def test_queues_set_bands(spark):
    df = scored(spark, [("temporal_test", i % 7 == 0, 1 - i / 1000) for i in range(1000)] + [("training", 1, 1.0)])
    rows = holdout.queues(df).collect()
    assert {r.capacity_fraction: r.review_rows for r in rows} == {0.001: 1, 0.005: 5, 0.02: 20}
    bands = holdout.measured_bands(rows)
    assert [bands.of(s) for s in (1.0, 0.997, 0.985, 0.5)] == ["ELEVATED_REVIEW", "WATCH", "STANDARD", "LOW_SIGNAL"]
    with pytest.raises(checks.ContractError, match="no queue"):
        holdout.measured_bands(rows[:1])
    tied = scored(spark, [("temporal_test", i % 2, 0.5) for i in range(100)])
    with pytest.raises(checks.ContractError, match="fall"):
        holdout.measured_bands(holdout.queues(tied).collect())


def test_top_queues_of_several_sizes_agree_with_a_sort(spark):
    rng = np.random.default_rng(2)
    rows = [("temporal_test", rng.random() < 0.3, int(rng.integers(0, 5)) / 5) for _ in range(200)]
    df = scored(spark, rows).withColumn("hit", F.col("target") == 1)
    got = {r.capacity_fraction: r for r in evaluate.strict_top(df, "score", "hit", "company_snapshot_id", (0.01, 0.1, 0.5)).collect()}
    order = sorted(range(200), key=lambda i: (-rows[i][2], i))
    for f, r in got.items():
        k = max(1, math.ceil(200 * f))
        assert r.review_rows == k and math.isclose(r.precision, sum(rows[i][1] for i in order[:k]) / k)
    assert evaluate.strict_top(df.limit(0), "score", "hit", "company_snapshot_id", (0.1,)).collect() == []


def test_days_are_dealt_with_embargoes(spark):
    df = spark.createDataFrame([(date(2020, 1, 1 + i % 20), i) for i in range(60)] + [(None, 99)], "d date, n int")
    got = {r.d: r.day_part for r in holdout.day_parts(df, F.col("d"), (("train", 9), ("gap", 2), ("validation", 4))).collect()}
    assert [got[date(2020, 1, d)] for d in (1, 9, 10, 11, 12, 15, 16, 20)] == ["train", "train", "gap", "gap", "validation", "validation", "test", "test"] and got[None] is None


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(6)
    numeric, categorical = model.feature_set("baseline_no_status")
    rows = []
    for i in range(240):
        x = rng.random(len(numeric))
        rows.append((f"c{i}", ["training", "validation"][i % 3 == 0], int(x[0] + 0.3 * rng.random() > 0.7), 1.0, *map(float, x), *[rng.choice(["a", "b"]).item() for _ in categorical]))
    df = spark.createDataFrame(rows, "company_snapshot_id string, dataset_split string, target int, sample_weight double, " + ", ".join([f"{c} double" for c in numeric] + [f"{c} string" for c in categorical]))
    pre = model.Preprocessor.fit(df.filter("dataset_split = 'training'"), numeric, categorical)
    booster, metrics = model.train_boosted(df, pre, candidates=({"maxDepth": 2, "stepSize": 0.2},), rounds=4)
    return df, pre, booster, metrics


def test_packages_score_as_the_booster_does(spark, fitted, tmp_path):
    df, pre, booster, metrics = fitted
    assert 0 < metrics["precision"] <= 1
    saved = package.save(str(tmp_path / "p"), "baseline_no_status", booster, pre, metrics)
    loaded = package.load(str(tmp_path / "p"))
    want = {r.company_snapshot_id: r.score for r in model.scored(booster, model.assembled(df, pre, ("company_snapshot_id",))).collect()}
    got = {r.company_snapshot_id: r.score for r in loaded.score(df, ("company_snapshot_id",)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want) and saved.trees == loaded.trees
    x = np.array(pre.transform(df.orderBy("company_snapshot_id")).first(), np.float64)
    said, first = loaded.explain(x), min(want)
    assert math.isclose(sum(said.values()), package.log_odds(want[first]), abs_tol=1e-9) and set(said) <= {"model_bias", *pre.medians, *pre.categories}
    with pytest.raises(FileExistsError):
        package.save(str(tmp_path / "p"), "baseline_no_status", booster, pre, metrics)
    package.same_model(loaded, {"feature_set": "baseline_no_status", "snapshot": "s"}, {"snapshot": "s"})
    for evaluated in ({"feature_set": "baseline_with_status", "snapshot": "s"}, {"feature_set": "baseline_no_status", "snapshot": "t"}):
        with pytest.raises(checks.ContractError):
            package.same_model(loaded, evaluated, {"snapshot": "s"})


@pytest.mark.parametrize("file, change, said", [
    ("model.json", lambda v: v | {"width": 1}, "width"), ("metrics.json", lambda v: v | {"label_boundary": "insolvent"}, "claim"), ("metrics.json", lambda v: v | {"numeric": []}, "numeric"),
    ("preprocessor.json", lambda v: v | {"feature_set": "expanded_no_status"}, "different feature sets"), ("metrics.json", lambda v: v | {"categorical": ["x"]}, "categorical"),
])
def test_packages_are_refused(fitted, tmp_path, file, change, said):
    _, pre, booster, metrics = fitted
    package.save(str(tmp_path / "p"), "baseline_no_status", booster, pre, metrics)
    at = tmp_path / "p" / file
    before = at.read_bytes()
    at.write_bytes(before + b" ")
    with pytest.raises(checks.ContractError, match="size"):
        package.load(str(tmp_path / "p"))
    at.write_bytes(before[:-1] + b" ")
    with pytest.raises(checks.ContractError, match="digest"):
        package.load(str(tmp_path / "p"))
    import hashlib

    data = json.dumps(change(json.loads(before))).encode()
    at.write_bytes(data)
    manifest = json.loads((tmp_path / "p" / "manifest.json").read_text())
    manifest[file] = {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    (tmp_path / "p" / "manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(checks.ContractError, match=said):
        package.load(str(tmp_path / "p"))
    at.unlink()
    with pytest.raises(checks.ContractError, match="missing"):
        package.load(str(tmp_path / "p"))


def test_columns_agree_with_their_scalars(spark):
    values = [None, 0.0, 1234567.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(decide.inr_column(F.col("v"))).collect()] == [decide.inr(v) for v in values]
    assert [r[0] for r in df.filter("v is not null").orderBy("i").select(decide.percent_column(F.col("v"))).collect()] == [decide.percent(v) for v in values[1:]]
    cells = spark.createDataFrame([(True, date(2020, 1, 2), "=x"), (None, None, None)], "b boolean, d date, s string")
    assert [tuple(r) for r in cells.select(spreadsheet_cell(F.col("b"), "boolean"), spreadsheet_cell(F.col("d"), "date"), spreadsheet_cell(F.col("s"), "string")).collect()] == [("true", "2020-01-02", "'=x"), ("", "", "")]
