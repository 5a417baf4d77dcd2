"""Snapshots as they arrive: a file stream that updates the summary with each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import SummaryConfig
from ..operators import incremental
from ..operators.models import summarize
from ..runtime import materialise
from ..sinks import read_store, write_csv, write_store
from ..sources.nquads import quads_from_lines


def follow(spark: SparkSession, folder: str, state: str, checkpoint: str, config: SummaryConfig = SummaryConfig(), reports: str | None = None) -> StreamingQuery:
    """Each file that appears in ``folder`` is one full snapshot. Absence means deletion, so there
    is no watermark: a snapshot replaces the state version before it. A batch that is run again
    after a failure writes the same version again. Ends when no more files wait."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(folder)

    def step(batch: DataFrame, number: int) -> None:
        now = materialise(summarize(quads_from_lines(batch, config), config), "stream")
        write_store(now, state, number)
        if number > 0:
            changes = incremental.change_counters(read_store(batch.sparkSession, state, number - 1), read_store(batch.sparkSession, state, number))
            if reports:
                write_csv(changes, f"{reports}/changes-{number}")

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
