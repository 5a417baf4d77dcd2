"""Spark event logs: phases and intervals of a run's iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = ("`Event` string, `Spark Properties` map<string,string>, `Stage Info` struct<`Stage ID`:int,`Submission Time`:bigint,`Completion Time`:bigint>, "
         "`Submission Time` bigint, `Completion Time` bigint")
# The phase of each stage of a run, by stage id.
PHASES = ["Load Graph", "Parse Graph", "Partition Graph", "Partition Graph", "Schema Computation", "Schema Computation", "Updates"]


def read_eventlog(spark: SparkSession, path: str) -> DataFrame:
    """The log's events with the file they come from."""
    return spark.read.schema(EVENT).json(path).withColumn("file", F.input_file_name())


def _runs(events: DataFrame, app: str) -> DataFrame:
    """file, iteration, batch of each log whose application is ``app`` and a number, or app_batch_number."""
    name = F.col("Spark Properties")["spark.app.name"]
    tail = F.expr(f"substr(name, {len(app) + 1})")
    named = events.filter(F.col("Event") == "SparkListenerEnvironmentUpdate").select("file", name.alias("name")).filter(F.col("name").startswith(app)).withColumn("tail", tail)
    number = F.regexp_extract("tail", r"(\d+)$", 1)
    return named.filter(number != "").select("file", number.cast("int").alias("iteration"), F.col("tail").contains("_batch_").alias("batch")).dropDuplicates(["file"])


def phase_times(events: DataFrame, app: str) -> DataFrame:
    """iteration, one column per phase in ms, total, batch_ms."""
    stage = F.col("Stage Info")
    phase: Column = F.element_at(F.array(*[F.lit(p) for p in PHASES]), F.pmod(stage["Stage ID"], F.lit(len(PHASES))) + 1)
    stages = events.filter(F.col("Event") == "SparkListenerStageCompleted").select("file", phase.alias("phase"), (stage["Completion Time"] - stage["Submission Time"]).alias("ms"))
    timed = stages.join(_runs(events, app), "file")
    names = list(dict.fromkeys(PHASES))
    sums = [F.coalesce(F.sum(F.when(~F.col("batch") & (F.col("phase") == p), F.col("ms"))), F.lit(0)).alias(p.lower().replace(" ", "_")) for p in names]
    return timed.groupBy("iteration").agg(*sums, F.coalesce(F.sum(F.when(~F.col("batch"), F.col("ms"))), F.lit(0)).alias("total"), F.sum(F.when(F.col("batch"), F.col("ms"))).alias("batch_ms"))


def job_intervals(events: DataFrame, app: str) -> DataFrame:
    """iteration and the last job's start, end and duration, incremental and batch."""
    jobs = events.filter(F.col("Event").isin("SparkListenerJobStart", "SparkListenerJobEnd")).join(_runs(events, app), "file")
    out = []
    for batch, name in ((False, "incremental"), (True, "batch")):
        here = F.col("batch") == batch
        start = F.max(F.when(here & (F.col("Event") == "SparkListenerJobStart"), F.col("Submission Time")))
        end = F.max(F.when(here & (F.col("Event") == "SparkListenerJobEnd"), F.col("Completion Time")))
        out += [start.alias(f"{name}_start"), end.alias(f"{name}_end"), (end - start).alias(f"{name}_ms")]
    return jobs.groupBy("iteration").agg(*out)


def write_reports(events: DataFrame, app: str, folder: str) -> None:
    """The phases and the intervals of a run as CSV, a line an iteration, in its order."""
    for name, rows in (("performance", phase_times(events, app)), ("performance-parallel", job_intervals(events, app))):
        rows.orderBy("iteration").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{app}-{name}")
