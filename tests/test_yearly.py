import datetime
import random

import pytest
from conftest import rows

from quadrille.operators import incremental, models
from quadrille.plans import summaries
from quadrille.runtime import release
from quadrille.sources import tables

SEGMENTS = ["MACHINERY", "AUTOMOBILE", None]


def write(spark, d, years, n=40, seed=1):
    """Orders of the given years, with odd rows: keys that come twice, no date, no customer, no status; customers without orders."""
    rng = random.Random(seed)
    day = lambda: datetime.datetime(rng.choice(years), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23))
    ends = [(1000, 1, "F", datetime.datetime(years[0], 1, 1), "LOW"), (1001, 2, "O", datetime.datetime(years[-1], 12, 31, 23, 59, 59), "HIGH")]
    odd = [(5, 1, "F", None, "LOW"), (6, None, "O", day(), "LOW"), (7, 3, None, day(), None), (8, 99, "P", day(), "LOW")]
    orders = ends + odd + [(rng.randint(10, 10 + n), rng.randint(0, 9), rng.choice("FOP"), day(), rng.choice(["LOW", "HIGH"])) for _ in range(n)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    customers = [(i, SEGMENTS[i % 3], i % 4) for i in range(15)] + [(3, "AUTOMOBILE", 9)]
    spark.createDataFrame(customers, "c_custkey bigint, c_mktsegment string, c_nationkey bigint").write.parquet(f"{d}/customer.parquet")
    return str(d)


def text(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_all_years_equal_each_window(spark, tmp_path):
    d = write(spark, tmp_path, [1995, 1996, 1999])
    years = summaries.order_years(spark, d)
    assert years == range(1995, 2000)
    got = summaries.yearly(spark, d, years).select("year", "s", "p", "o", "g")
    want = [f"({y}, {r[1:]}" for y in years for r in text(tables.window_quads(summaries.table(spark, d, "orders"), summaries.table(spark, d, "customer"), y).select("s", "p", "o", "g"))]
    assert text(got) == sorted(want)


def plan_size(spark, tmp_path, query, years):
    d = write(spark, tmp_path / str(len(years)), years, 5)
    return query(spark, d)._jdf.queryExecution().analyzed().toString().count("\n")


@pytest.mark.parametrize("name", ["incremental_equals_batch", "change_counters", "stale_imprints"])
def test_plan_does_not_grow_with_the_years(spark, tmp_path, name):
    query = summaries.QUERIES[name]
    assert plan_size(spark, tmp_path, query, [1995, 1996]) == plan_size(spark, tmp_path, query, list(range(1995, 2003)))
    release(spark)


def test_every_delta_equals_its_batch(spark, tmp_path):
    d = write(spark, tmp_path, [1995, 1996, 1999])
    assert rows(summaries.incremental_equals_batch(spark, d).select("year", "only_a", "only_b", "different")) == [(y, 0, 0, 0) for y in range(1996, 2000)]


def test_delta_and_its_application(spark):
    frame = lambda data: spark.createDataFrame(data, "year int, s string, p string, o string, g string")
    a = frame([(1, "a", "p", "x", None), (1, "b", "p", "x", "g"), (1, "b", "p", "x", "g"), (2, "a", "p", "x", "g")])
    b = frame([(1, "b", "p", "x", "g"), (1, "c", "p", "x", None), (2, "a", "p", "x", "h")])
    change = incremental.delta(a, b, ("year",))
    assert text(change) == sorted(map(str, [(1, "a", "p", "x", None, "remove"), (1, "c", "p", "x", None, "add"), (2, "a", "p", "x", "g", "remove"), (2, "a", "p", "x", "h", "add")]))
    after = incremental.apply_delta(a, change.filter("op = 'add'"), change.filter("op = 'remove'"), ("year",))
    assert text(after) == text(b)


def each_year(spark, d):
    return {y: models.summarize(summaries.year_quads(spark, d, y), summaries.CONFIG) for y in summaries.order_years(spark, d)}


def test_counters_equal_those_of_each_pair(spark, tmp_path):
    d = write(spark, tmp_path, [1995, 1996])
    made = each_year(spark, d)
    want = [(y, *incremental.change_counters(made.get(y - 1, made[y].limit(0)), made[y]).first()) for y in made]
    assert rows(summaries.change_counters(spark, d)) == want
    assert [r[:2] for r in want] == [(1995, want[0][1]), (1996, want[1][1])] and all(r[1] for r in want)


def test_stale_imprints_of_each_pair(spark, tmp_path):
    d = write(spark, tmp_path, [1995, 1996, 1999])
    of = {y: {r.v for r in m.select("v").collect()} for y, m in each_year(spark, d).items()}
    want = sorted((y, v) for y in of if y - 1 in of for v in of[y - 1] - of[y])
    assert want and rows(summaries.stale_imprints(spark, d).select("year", "v")) == want
