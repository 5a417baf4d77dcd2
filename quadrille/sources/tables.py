"""Relational tables as a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread

SIGNAL = "type"
LARGE = {"orders", "lineitem", "events"}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _key(prefix: str, *cols: str) -> Column:
    return F.concat(F.lit(prefix + "/"), F.concat_ws("-", *[F.col(c).cast("string") for c in cols]))


def _text(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.col(c) if isinstance(c, str) else c, F.lit('"'))


def _quads(df: DataFrame, s: Column, g: Column, pairs: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per pair with a value; the table is scanned once, its columns pruned. ``by``: further columns that are kept."""
    po = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in pairs.items()])
    return df.select(*by, s.alias("s"), g.alias("g"), F.explode(po).alias("e")).filter("e.o is not null and s is not null").select(*by, "s", "e.p", "e.o", "g")


def table_quads(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The quads of one table: subject is table and key, the source the table, or its year or month. ``by``: further columns that are kept."""
    year = lambda c: F.concat(F.lit(name + "/"), F.year(c).cast("string"))
    lit = F.lit(name)
    if name == "region":
        return _quads(df, _key("region", "r_regionkey"), lit, {SIGNAL: lit, "name": _text("r_name")})
    if name == "nation":
        return _quads(df, _key("nation", "n_nationkey"), lit, {SIGNAL: lit, "inregion": _key("region", "n_regionkey")})
    if name == "customer":
        return _quads(df, _key("customer", "c_custkey"), lit, {SIGNAL: F.col("c_mktsegment"), "innation": _key("nation", "c_nationkey")}, by)
    if name == "supplier":
        return _quads(df, _key("supplier", "s_suppkey"), lit, {SIGNAL: lit, "innation": _key("nation", "s_nationkey")})
    if name == "part":
        return _quads(df, _key("part", "p_partkey"), lit, {SIGNAL: F.col("p_brand"), "name": _text("p_name")})
    if name == "orders":
        return _quads(df, _key("orders", "o_orderkey"), year("o_orderdate"), {SIGNAL: F.col("o_orderstatus"), "placedby": _key("customer", "o_custkey"), "priority": _text("o_orderpriority")}, by)
    if name == "lineitem":
        return _quads(df, _key("lineitem", "l_orderkey", "l_linenumber"), year("l_shipdate"), {SIGNAL: F.col("l_returnflag"), "oforder": _key("orders", "l_orderkey"), "ofpart": _key("part", "l_partkey"), "suppliedby": _key("supplier", "l_suppkey")})
    if name == "events":
        month = F.date_format("ts", "yyyy-MM")
        return _quads(df, _key("events", "event_id"), F.concat(F.lit("events/"), month), {SIGNAL: F.col("event_type"), "byuser": _key("user", "user_id"), "k": _text(F.get_json_object("props", "$.k"))})
    raise ValueError(name)


def quads_from_tables(spark: SparkSession, sf_dir: str, names: list[str] = TABLES) -> DataFrame:
    scans = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return reduce(DataFrame.unionByName, [table_quads(spread(df) if n in LARGE else df, n) for n, df in scans.items()])


def window_quads(orders: DataFrame, customers: DataFrame, year: int) -> DataFrame:
    """The snapshot of one year: orders of it and the year before, and their customers.

    A customer's label is their market segment if they ordered in the year, else dormant; so an
    order's summary may change through its customer alone. The segment MACHINERY is renamed each
    year, so its summaries go. The year's feed is a source of its own.
    """
    def day(y: int) -> Column:
        return F.lit(f"{y:04d}-01-01").cast(orders.schema["o_orderdate"].dataType)

    at = F.col("o_orderdate")
    kept = orders.filter((at >= day(year - 1)) & (at < day(year + 1)))  # ranges reach the scan, year() would not
    base = table_quads(kept, "orders")
    feed = base.filter(F.col("p") == "priority").withColumn("g", F.lit(f"feed/{year}"))
    active = kept.filter(at >= day(year)).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("active", F.lit(True))
    labelled = customers.join(active, "c_custkey", "left").withColumn("c_mktsegment", F.when(F.col("active"), F.concat("c_mktsegment", F.when(F.col("c_mktsegment") == "MACHINERY", f"/{year}").otherwise(""))).otherwise(F.lit("dormant")))
    return base.filter(F.col("p") != "priority").unionByName(feed).unionByName(table_quads(labelled, "customer"))


def yearly_quads(orders: DataFrame, customers: DataFrame, years: range) -> DataFrame:
    """The snapshots that ``window_quads`` makes of each of the years as one frame with a column year: one plan, however many years."""
    every = F.explode(F.array(*[F.lit(y) for y in years]).cast("array<int>"))
    of = F.year("o_orderdate")
    kept = orders.withColumn("year", F.explode(F.array(of, of + 1))).filter(F.col("year").between(years.start, years.stop - 1))
    placed = table_quads(kept, "orders", ("year",))
    placed = placed.withColumn("g", F.when(F.col("p") == "priority", F.concat(F.lit("feed/"), F.col("year").cast("string"))).otherwise(F.col("g")))
    active = orders.select(of.alias("year"), F.col("o_custkey").alias("c_custkey")).distinct().withColumn("active", F.lit(True))
    renamed = F.concat("c_mktsegment", F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("/"), F.col("year").cast("string"))).otherwise(""))
    labelled = customers.withColumn("year", every).join(active, ["year", "c_custkey"], "left").withColumn("c_mktsegment", F.when(F.col("active"), renamed).otherwise(F.lit("dormant")))
    return placed.unionByName(table_quads(labelled, "customer", ("year",)))
