"""What changed between full snapshots, over a bucketed key-to-hash index (problem 1)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import normalise
from ..runtime import names_in, read_note, remove_path, shuffle_partitions, work_path, write_note


def payload_set(payload: Column | str) -> Column:
    """The sorted set of normalised sources; null, empty and all-null arrays are the empty set."""
    c = F.col(payload) if isinstance(payload, str) else payload
    known = F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.transform(known, lambda x: normalise(x))))


def imprint_hash() -> Column:
    """128 bits of what counts as a vertex's content: payload set and schema element.

    Two differing contents of one key are taken for equal with a chance of 2^-128 only.
    """
    body = F.to_json(F.struct(payload_set("_payload").alias("p"), F.col("_schemaelementid").alias("e")))
    return F.unhex(F.md5(body))


class SnapshotIndex:
    """A key-to-hash index of the last snapshot, bucketed by key, with an atomic swap.

    ``advance(rows)`` takes one full delivery (columns key..., order column, further ones),
    keeps per key the row with the greatest order value (ties: the greatest hash), probes the
    index and returns the changes; then the new index takes the old one's place. Both sides
    are bucketed alike, so the probe needs no shuffle of the index. Rows with a null key are
    dropped. A hot key is reduced map-side before any shuffle.

    With ``path`` the index lasts: another session that names the same path goes on from the last delivery whose
    changes were stored (``drop_old`` ends a step). A note names the index in force and its buckets; a delivery that was
    not ended is done again.
    """

    def __init__(self, spark: SparkSession, key: str, order: str, content: Column, buckets: int | None = None, keep_values: list[str] | None = None, path: str | None = None):
        self.spark, self.key, self.order, self.content = spark, key, order, content
        self.buckets = buckets or shuffle_partitions(spark)
        self.keep_values = keep_values or []
        self.root = path or work_path(spark, "snapshot-index")
        self.current: str | None = None
        self.values: DataFrame | None = None
        self.old: str | None = None
        if path and (notes := [n for n in names_in(spark, path) if n.startswith("index-")]):
            note = json.loads(read_note(spark, f"{path}/{notes[-1]}"))
            self.buckets, self.current = note["buckets"], note["name"]
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.current} ({note['columns']}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{path}/{self.current}'")
        self.steps = int(notes[-1].split("-")[1]) if path and notes else 0

    def _write(self, df: DataFrame) -> str:
        name = f"quadrille_index_{uuid.uuid4().hex[:12]}"
        writer = df.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.root}/{name}")
        writer.saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, f"{self.root}/{name}")

    def advance(self, rows: DataFrame, values: DataFrame | None = None) -> DataFrame | None:
        """Changes against the snapshot before: key, change (added, removed, changed); None for the first.

        With ``keep_values``, old_<c> and new_<c> are fetched for changed keys alone. The rows of
        the old delivery are read again for that, never held in the index; where the index was opened by its path,
        ``values`` are these rows.
        """
        new = (
            rows.filter(F.col(self.key).isNotNull())
            .select(self.key, F.struct(F.col(self.order).alias("t"), self.content.alias("h")).alias("v"))
            .groupBy(self.key)
            .agg(F.max("v").alias("v"))
            .select(self.key, F.col("v.h").alias("h"))
            .repartition(self.buckets, self.key)
        )
        fresh = self._write(new)
        before, self.current = self.current, fresh
        old_rows, self.values = values if values is not None else self.values, rows
        if self.keep_values and before is not None and old_rows is None:
            raise ValueError("values: the rows of the delivery before are needed")
        if before is None:
            return None
        a = self.spark.table(before).withColumnRenamed("h", "h_old")
        b = self.spark.table(fresh).withColumnRenamed("h", "h_new")
        changes = (
            b.join(a, self.key, "full_outer")
            .withColumn("change", F.when(F.col("h_old").isNull(), "added").when(F.col("h_new").isNull(), "removed").when(F.col("h_old") != F.col("h_new"), "changed"))
            .filter(F.col("change").isNotNull())
            .select(self.key, "change")
        )
        for side, source in (("old", old_rows), ("new", rows)) if self.keep_values else ():
            wanted = changes.select(self.key)
            latest = source.join(wanted, self.key, "left_semi").groupBy(self.key).agg(
                F.max(F.struct(F.col(self.order).alias("t"), self.content.alias("h"), F.struct(*self.keep_values).alias("row"))).alias("m"))
            changes = changes.join(latest.select(self.key, *[F.col(f"m.row.{c}").alias(f"{side}_{c}") for c in self.keep_values]), self.key, "left")
        self.old = before
        return changes

    def drop_old(self) -> None:
        """Ends the swap: the new index is noted as the one in force and the one before given up, once its changes are stored."""
        self.steps += 1
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.table(self.current).schema)
        write_note(self.spark, f"{self.root}/index-{self.steps:09d}", json.dumps({"name": self.current, "buckets": self.buckets, "columns": columns}))
        remove_path(self.spark, f"{self.root}/index-{self.steps - 1:09d}")
        if self.old:
            self._drop(self.old)
            self.old = None

    def close(self) -> None:
        for name in (self.old, self.current):
            if name:
                self._drop(name)
        remove_path(self.spark, self.root)


def _deliveries(imprints: DataFrame, keep_values: list[str], schema: str) -> DataFrame:
    """snapshot, _id, change and the kept values of each delivery against the one before."""
    spark = imprints.sparkSession
    numbers = sorted(r[0] for r in imprints.select("snapshot").where("snapshot is not null").distinct().collect())
    if len(numbers) < 2:
        return spark.createDataFrame([], schema)
    out = work_path(spark, "snapshot-changes")
    index = SnapshotIndex(spark, "_id", "_timestamp", imprint_hash(), keep_values=keep_values)
    for n in numbers:
        changes = index.advance(imprints.filter(F.col("snapshot") == n))
        if changes is not None:
            changes.select(F.lit(n).cast("int").alias("snapshot"), F.col("_id").cast("int").alias("_id"), *[c for c in changes.columns if c != "_id"]).write.mode("append").parquet(out)
        index.drop_old()
    index.close()
    return spark.read.schema(schema).parquet(out)


def snapshot_changes(imprints: DataFrame) -> DataFrame:
    """snapshot, _id, change for each snapshot but the first, against the next lower one present.

    Rows with null ``snapshot`` or ``_id`` are disregarded; an empty table gives no rows. Per
    snapshot the index is probed and swapped, the changes go to the shared folder.
    """
    return _deliveries(imprints, [], "snapshot int, _id int, change string")


def snapshot_values(imprints: DataFrame) -> DataFrame:
    """The changes with their values before and after: snapshot, _id, change, old_ and new_ _payload and _schemaelementid.

    Values are fetched for changed vertices alone; added ones have no old, removed ones no new. The payload is as delivered.
    """
    kept = "_payload array<string>, {0}_schemaelementid int"
    return _deliveries(imprints, ["_payload", "_schemaelementid"], "snapshot int, _id int, change string, " + ", ".join(f"{x}{kept.format(x)}" for x in ("old_", "new_")))
