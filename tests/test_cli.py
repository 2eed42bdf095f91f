import json

import pytest

from tidemark.__main__ import main
from tidemark.operators import evaluate
from tidemark.operators.checks import ContractError
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_publish_verify_and_refuse(spark, tmp_path):
    r = main(["query", "holdout_bucket", "--data", SF, "--out", str(tmp_path)])
    assert r["rows"] == 5
    assert main(["verify", "--report", str(tmp_path / f"report-{r['run_id']}.json"), "--root", str(tmp_path / f"run-{r['run_id']}")])["verified_parts"] == len(r["parts"])
    with pytest.raises(ContractError, match="exists"):
        main(["query", "holdout_bucket", "--data", SF, "--out", str(tmp_path)])


def test_evaluate_and_verdict(spark, tmp_path):
    catalogue.observations(spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "o"))
    main(["evaluate", "--observations", str(tmp_path / "o"), "--start", "2000-01-01", "--out", str(tmp_path / "e.json"), "--simulations", "100"])
    got = json.loads((tmp_path / "e.json").read_text())["units"]["shared_address"]
    assert set(got) == set(evaluate.SLICES) and got["overall"]["metric_status"] == "passed" and 0 < got["overall"]["p_value"] <= 1
    v = main(["verdict", "--report", str(tmp_path / "e.json"), "--out", str(tmp_path / "v.json")])
    assert v["verdict"] in ("SHIP", "RE_UNIT", "DO_NOT_SHIP") and v["reason_codes"]


def test_signal_report(spark):
    rows = [(True, True, True, 4), (True, True, True, 3), (True, False, True, 3), (True, False, True, 3), *[(True, False, False, 1)] * 6, (False, True, True, 9)]
    df = spark.createDataFrame(rows, "e boolean, y boolean, s boolean, score int")
    r = evaluate.signal_report(df, "s", "score", "y", "e", 0.2, 250.0)
    assert (r["base_rate"], r["precision"], r["recall"], r["lift"], r["reviewed_rows"], r["realized_review_capacity"], r["false_positive_review_cost"]) == (0.2, 0.5, 1.0, 2.5, 4, 0.4, 500.0)
    assert evaluate.signal_report(df.filter("not e"), "s", "score", "y", "e")["metric_status"] == "empty_evaluation_slice"


def test_index_and_lookup(spark, tmp_path):
    spark.createDataFrame([(True, "U72900KA2019PTC000001", "Zephyr Ltd")], "evaluation_eligible boolean, cin string, company_name string").write.parquet(str(tmp_path / "f"))
    main(["index", "--features", str(tmp_path / "f"), "--columns", "cin,company_name", "--out", str(tmp_path / "i")])
    assert main(["lookup", "--index", str(tmp_path / "i"), "--name", "zephyr"])["status"] == 200
    assert main(["lookup", "--index", str(tmp_path / "i"), "--cin", "bad"])["status"] == 422
