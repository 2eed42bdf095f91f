"""Every catalogue query equals its SQL twin, rows and values, on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import catalogue, evidence

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(evidence.ORACLES))
def test_equals_sql(spark, duck, name):
    df = evidence.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    res = duck.execute(evidence.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr([dict(zip(names, r, strict=True))[c] for c in cols]) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["solvency_observation", "signal_observation"])
def test_layout_does_not_matter(spark, name, monkeypatch):
    want = sorted(map(str, catalogue.QUERIES[name](spark, SF).collect()))
    plain = catalogue.registry
    monkeypatch.setattr(catalogue, "registry", lambda s, d: plain(s, d).repartition(7))
    assert sorted(map(str, catalogue.QUERIES[name](spark, SF).collect())) == want


def test_companies_equal_sql_on_balances_of_half_cents(spark, tmp_path):
    """Balances whose third decimal is 5 or next to it, and customers without orders."""
    for t in ("nation", "orders", "part", "customer"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    con = duckdb.connect()
    (tmp_path / "customer.parquet").unlink()
    odd = "c_custkey + k * 150 AS c_custkey, c_acctbal + k * 0.0053 + c_custkey % 7 * 0.005 AS c_acctbal"
    con.execute(f"COPY (SELECT c.* REPLACE ({odd}) FROM '{SF}/customer.parquet' c, (SELECT range AS k FROM range(6))) TO '{tmp_path}/customer.parquet'")
    for t in ("nation", "orders", "part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = evidence.QUERIES["canonical_companies"](spark, str(tmp_path))
    res = con.execute(evidence.ORACLES["canonical_companies"])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    assert sorted(repr(list(r)) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in res.fetchall())
