"""Queries over yearly snapshots: all consecutive years of the data, none fixed."""

import datetime as dt
import random
import re

import duckdb
import pytest

from quadrille.plans import oracles, summaries

PAIRWISE = ["snapshot_diff", "neighbor_changes", "payload_diff", "stale_imprints", "deleted_summaries", "unknown_subject_edges", "known_subject_edges", "delta_scan", "delta_apply", "delta_touched", "incremental_equals_batch"]
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"


def save(spark, folder, years, seed=5):
    """Orders of the given years with customers, as Parquet."""
    rng = random.Random(seed)
    orders = [(i, rng.randint(1, 8), rng.choice("OF"), dt.datetime(rng.choice(years), rng.randint(1, 12), 1), rng.choice(["1-URGENT", "5-LOW"])) for i in range(12 * len(years))]
    customers = [(i, rng.choice(["MACHINERY", "BUILDING"]), i % 3) for i in range(1, 11)]
    spark.createDataFrame(orders, ORDERS).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey bigint, c_mktsegment string, c_nationkey bigint").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def four_years(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("four"), [1990, 1991, 1992, 1993])


def same_as_sql(folder, name, got):
    """Whether a query's rows equal those of its SQL, which takes the years from the data too."""
    db = duckdb.connect()
    for t in ("orders", "customer"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cols = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({oracles.ORACLES[name]})").fetchall()
    rows = got.select(*cols).collect()
    assert sorted(tuple(map(str, r)) for r in rows) == sorted(tuple(map(str, r)) for r in want)
    return {r.year for r in rows}


@pytest.mark.parametrize("name", PAIRWISE)
def test_each_pair_of_years(spark, four_years, name):
    years = same_as_sql(four_years, name, summaries.QUERIES[name](spark, four_years))
    assert years <= {1991, 1992, 1993} and len(years) > 1


@pytest.mark.parametrize("years", [[], [1990]])
def test_no_pair_of_years(spark, tmp_path, years):
    folder = save(spark, tmp_path, years)
    for name in ("snapshot_diff", "delta_scan", "incremental_equals_batch"):
        assert summaries.QUERIES[name](spark, folder).count() == 0


def test_too_many_years(spark, tmp_path):
    with pytest.raises(ValueError):
        summaries.order_years(spark, save(spark, tmp_path, [1, 1990]))


@pytest.mark.parametrize("name,years", [("change_counters", [1990, 1991, 1992, 1993]), ("orphans", [1991, 1992, 1993])])
def test_from_the_first_year_on(spark, four_years, name, years):
    assert same_as_sql(four_years, name, summaries.QUERIES[name](spark, four_years)) == set(years)


def test_counters_without_orders(spark, tmp_path):
    assert summaries.QUERIES["change_counters"](spark, save(spark, tmp_path, [])).count() == 0


def test_records_not_counts(spark, tmp_path, monkeypatch):
    data = [("a", "type", "x", "g"), ("a", "p", "b", "g"), ("b", "type", "y", "g"), ("b", "q", '"t"', "g")]
    monkeypatch.setattr(summaries, "all_quads", lambda *_: spark.createDataFrame(data, "s string, p string, o string, g string"))
    lines = [r.line for r in summaries.ntriples_export(spark, "").collect()]
    assert len(lines) == 6 and all(re.fullmatch(r"<http://example.org/summary#\w+> <(type|p|q)> <[^<>]+> \.", x) for x in lines)
    info = summaries.index_information(spark, "").select("sig", "types", "properties").collect()
    assert len({r.sig for r in info}) == 4 and sorted((r.types, r.properties) for r in info) == [(0, 0), (1, 0), (1, 1), (1, 1)]


def test_cumulative_snapshots_hold_quads(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    few = spark.read.parquet(f"{sf}/papers.parquet").filter("year is not null").limit(5)
    few.write.parquet(f"{tmp_path}/papers.parquet")
    got = summaries.cumulative_snapshots(spark, str(tmp_path))
    quads = {tuple(r) for r in summaries.citations.paper_quads(spark.read.parquet(f"{tmp_path}/papers.parquet"), True).select("year", "s", "p", "o", "g").collect()}
    want = [(n, *q) for n in {q[0] for q in quads} for q in quads if q[0] <= n]
    assert sorted(tuple(r) for r in got.select("snapshot", "year", "s", "p", "o", "g").collect()) == sorted(want)
