"""References to records that do not exist, tracked incrementally (problem 6)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import exists, materialise, names_in, remove_path, salted_join, work_path

SPACES = " \t\n\x0b\f\r"
ORPHANS = "period string, id string, ref_id string, kind string"
PENDING = "id string, ref_id string, period string, `limit` timestamp_ntz, kind string"


class OrphanTracker:
    """Pending-orphan state keyed by the missing record.

    ``advance(papers, deletions, until)`` takes what arrived before ``until`` and after the step
    before. New references probe the parent index (first delivery and first deletion per id),
    arriving parents resolve what waits for them, deletions reopen references whose period is
    not closed yet. A reference is settled when its period is closed and its parent known;
    the rest stays pending and is touched again only by its own parent. State is written to the
    shared folder, one version per step, with the counts of orphans at its end.

    With ``path`` the state lasts: another session that names the same path goes on after the last complete step.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.root = path or work_path(spark, "orphans")
        self.known: DataFrame | None = None
        self.pending: DataFrame | None = None
        self.settled: list[str] = []
        self.steps = 0
        done = [n for n in names_in(spark, self.root) if n.startswith("step=") and exists(spark, f"{self.root}/{n}/counts/_SUCCESS")] if path else []
        for n in [x for x in names_in(spark, self.root) if x.startswith("step=") and x not in done] if path else []:
            remove_path(spark, f"{self.root}/{n}")  # a step that did not end
        if done:
            self.steps = int(done[-1].split("=")[1])
            self.known = spark.read.schema("id string, fd timestamp_ntz, dd timestamp_ntz").parquet(*[f"{self.root}/{n}/parents" for n in done])
            self.pending = spark.read.schema(PENDING).parquet(f"{self.root}/{done[-1]}/pending")
            self.settled = [f"{self.root}/{n}/settled" for n in done]

    @staticmethod
    def classify(fd: str = "first_delivered", dd: str = "first_deleted", limit: str = "limit"):
        return (
            F.when(F.col(fd).isNull(), "missing")
            .when(F.col(fd) >= F.col(limit), "late")
            .when(F.col(dd) < F.col(limit), "deleted")
        )

    def advance(self, papers: DataFrame, deletions: DataFrame, until: dt.datetime) -> None:
        """papers: id, delivered_at, references; deletions: id, deleted_at."""
        self.steps += 1
        at = f"{self.root}/step={self.steps:04d}"
        arrived = papers.filter(F.col("id").isNotNull() & F.col("delivered_at").isNotNull())
        gone = deletions.filter(F.col("id").isNotNull() & F.col("deleted_at").isNotNull())
        nothing = F.lit(None).cast("timestamp_ntz")
        touched = (
            arrived.select("id", F.col("delivered_at").cast("timestamp_ntz").alias("fd"), nothing.alias("dd"))
            .unionByName(gone.select("id", nothing.alias("fd"), F.col("deleted_at").cast("timestamp_ntz").alias("dd")))
            .groupBy("id")
            .agg(F.min("fd").alias("fd"), F.min("dd").alias("dd"))
        )
        touched.write.parquet(f"{at}/parents")
        touched = self.spark.read.parquet(f"{at}/parents")
        log = touched if self.known is None else self.known.unionByName(touched)
        self.known = log
        index = log.groupBy("id").agg(F.min("fd").alias("first_delivered"), F.min("dd").alias("first_deleted"))

        limit = F.date_trunc("month", F.col("first_delivered")).cast("timestamp_ntz") + F.expr("interval 1 month")
        refs = (
            arrived.select("id", F.explode("references").alias("ref_id"))
            .filter(F.col("ref_id").isNotNull())
            .select("id", F.btrim("ref_id", F.lit(SPACES)).alias("ref_id"))
            .distinct()
        )
        new = refs.join(index.filter("first_delivered is not null").select("id", "first_delivered"), "id").select(
            "id", "ref_id", F.date_format("first_delivered", "yyyy-MM").alias("period"), limit.alias("limit"))
        probe = index.withColumnRenamed("id", "ref_id")
        new.write.parquet(f"{at}/new")
        new = self.spark.read.parquet(f"{at}/new")
        judged = salted_join(new, probe, ["ref_id"], "left")
        if self.pending is not None:
            keys = touched.select(F.col("id").alias("ref_id"))
            again = salted_join(salted_join(self.pending.drop("kind"), keys, ["ref_id"], "left_semi"), probe, ["ref_id"], "left")
            judged = judged.unionByName(again)
            untouched = salted_join(self.pending, keys, ["ref_id"], "left_anti")
        judged = judged.select("id", "ref_id", "period", "limit", self.classify().alias("kind"), F.col("first_delivered").isNotNull().alias("seen"))
        judged.write.parquet(f"{at}/judged")
        judged = self.spark.read.parquet(f"{at}/judged")
        closed = F.col("limit") <= F.lit(until).cast("timestamp_ntz")
        judged.filter(F.col("kind").isNotNull() & F.col("seen") & closed).select("period", "id", "ref_id", "kind").write.parquet(f"{at}/settled")
        self.settled.append(f"{at}/settled")
        waiting = judged.filter(~(F.col("seen") & closed)).select("id", "ref_id", "period", "limit", "kind")
        if self.pending is not None:
            waiting = waiting.unionByName(untouched)
        waiting.distinct().write.parquet(f"{at}/pending")
        self.pending = self.spark.read.parquet(f"{at}/pending")
        # the counts of the step: settled orphans, and what waits; its kind changes only when its own parent is touched
        waits = self.pending.filter("kind is not null").select("period", "kind")
        of_step = self.spark.read.schema(ORPHANS).parquet(f"{at}/settled").select("period", "kind").withColumn("open", F.lit(False)).unionByName(waits.withColumn("open", F.lit(True)))
        of_step.groupBy("period", "kind", "open").agg(F.count("*").alias("n")).write.parquet(f"{at}/counts")

    def counts(self) -> DataFrame:
        """step, period, kind, n: orphans known at the end of each step, settled so far or waiting then."""
        steps = [int(n.split("=")[1]) for n in names_in(self.spark, self.root) if n.startswith("step=")]
        if not steps:
            return self.spark.createDataFrame([], "step int, period string, kind string, n bigint")
        rows = self.spark.read.option("basePath", self.root).parquet(*[f"{self.root}/step={s:04d}/counts" for s in steps])
        later = F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s >= F.col("step"))
        spread = rows.withColumn("step", F.explode(F.when(F.col("open"), F.array(F.col("step").cast("int"))).otherwise(later)))
        return spread.groupBy("step", "period", "kind").agg(F.sum("n").alias("n"))

    def report(self) -> DataFrame:
        """period, id, ref_id, kind of all orphans as known now."""
        if self.pending is None:
            return self.spark.createDataFrame([], ORPHANS)
        open_now = self.pending.filter("kind is not null").select("period", "id", "ref_id", "kind")
        done = self.spark.read.schema(ORPHANS).parquet(*self.settled)
        return done.unionByName(open_now).distinct()

    def close(self) -> None:
        remove_path(self.spark, self.root)


def _months_after(d: dt.datetime, n: int) -> dt.datetime:
    m = d.year * 12 + d.month - 1 + n
    return dt.datetime(m // 12, m % 12 + 1, 1)


def orphan_references(papers: DataFrame, deletions: DataFrame, step_months: int = 12) -> DataFrame:
    """Orphans of papers.references at the end of the citing paper's month; kinds missing, late, deleted.

    Deliveries are taken in steps of ``step_months``, as they would arrive. Rows without id or
    delivery time, null reference arrays and null references are disregarded. Repeated
    deliveries and references count once; the references of all deliveries count. The result
    does not depend on the step. An empty table gives no rows.
    """
    spark = papers.sparkSession
    papers = papers.select("id", F.col("delivered_at").cast("timestamp_ntz").alias("delivered_at"), "references")
    deletions = deletions.select("id", F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))
    low, high = papers.agg(F.min("delivered_at"), F.max("delivered_at")).first()
    tracker = OrphanTracker(spark)
    if low is None:
        return tracker.report()
    begin = dt.datetime(low.year, low.month, 1)
    last = begin
    while last <= high:
        until = _months_after(last, step_months)
        first, final = last == begin, until > high

        def part(df: DataFrame, c: str) -> DataFrame:
            keep = F.col(c) < F.lit(until).cast("timestamp_ntz") if not final else F.col(c).isNotNull()
            return df.filter(keep if first else keep & (F.col(c) >= F.lit(last).cast("timestamp_ntz")))

        tracker.advance(part(papers, "delivered_at"), part(deletions, "deleted_at"), until)
        last = until
    result = materialise(tracker.report(), "orphan-report")
    tracker.close()
    return result


def orphan_counts(orphans: DataFrame, table: str) -> DataFrame:
    """tbl, period, kind, n: orphans per citing table, month and kind."""
    return orphans.groupBy("period", "kind").agg(F.count("*").alias("n")).select(F.lit(table).alias("tbl"), "period", "kind", "n")
