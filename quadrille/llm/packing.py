"""Texts laid into packs of fixed capacity, by bounded-space online packing (problem 8)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import hot_join, materialise
from .tokens import VOCABULARY, with_tokens

#: Open windows of a pack kind in a partition.
WINDOWS = 64
#: Texts of a partition, and partitions whose leftovers are merged by one task.
ROWS, MERGE = 200_000, 64
Capacities = dict[str, int]


class Windows:
    """A fixed number of open windows; an item goes where least room stays. When none fits, the
    fullest is emitted and a new one opened."""

    def __init__(self, capacity: int, limit: int, number: Iterator[int]):
        self.capacity, self.limit, self.number = capacity, limit, number
        self.rooms: list[tuple[int, int]] = []  # room left, window

    def place(self, size: int) -> int:
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.limit:
                self.rooms.pop(0)  # the fullest leaves for good
            room, window = self.capacity, next(self.number)
        if room > size:
            insort(self.rooms, (room - size, window))
        return window


def _numbers(step: int) -> Iterator[int]:
    """Numbers of windows, distinct over all steps and tasks (up to 2^5, 2^22 and 2^36 windows a task)."""
    n = step << 58 | TaskContext.get().partitionId() << 36
    while True:
        yield n
        n += 1


def _left_open(open_: dict[str, Windows]) -> Iterator[tuple[str, int, int]]:
    """(pack, window, fill) of the windows that still have room."""
    for p, w in open_.items():
        for room, window in w.rooms:
            yield p, window, w.capacity - room


NAMES = ["pack", "window", "unit", "doc_id", "part", "start_token", "n_tokens"]
TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
LAID = "pack string, window bigint, unit int, doc_id bigint, part int, start_token bigint, n_tokens bigint"
STEPS = ["pack", "window", "to", "unit", "fill"]
STEP_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def _laid(capacities: Capacities, windows: int):
    """Items to windows; at the end one row without a part for each window that is still open, its fill as n_tokens."""
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, unit = _numbers(0), TaskContext.get().partitionId()
        open_ = {p: Windows(c, windows, number) for p, c in capacities.items()}
        for b in batches:
            out: list[tuple] = []
            for doc, n in zip(b["doc_id"].to_pylist(), b["n_tokens"].to_pylist()):
                for p, c in capacities.items():
                    full = n // c if n > c else 0
                    for k in range(full):
                        out.append((p, next(number), None, doc, k, k * c, c))
                    if n > full * c or n == 0:
                        out.append((p, open_[p].place(n - full * c), None, doc, full, full * c, n - full * c))
            yield _batch(out, NAMES, TYPES)
        yield _batch([(p, w, unit, None, None, None, fill) for p, w, fill in _left_open(open_)], NAMES, TYPES)

    return lay


def _merged(capacities: Capacities, windows: int, step: int):
    """Leftover windows to larger ones, as whole units; at the end one row without a window for each that is still open."""
    def merge_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, unit = _numbers(step), TaskContext.get().partitionId()
        open_ = {p: Windows(c, windows, number) for p, c in capacities.items()}
        for b in batches:
            yield _batch([(p, w, open_[p].place(n), None, None) for p, w, n in zip(*(b[c].to_pylist() for c in ("pack", "window", "fill")))], STEPS, STEP_TYPES)
        yield _batch([(p, None, w, unit, fill) for p, w, fill in _left_open(open_)], STEPS, STEP_TYPES)

    return merge_up


def pack_texts(documents: DataFrame, pack_sizes: DataFrame, path: str = VOCABULARY, windows: int = WINDOWS, rows: int = ROWS, merge: int = MERGE) -> DataFrame:
    """pack, pack_id, doc_id, part, start_token, n_tokens of every text in packs of each capacity.

    A text stays whole unless it alone exceeds the capacity; then it is cut at multiples of the
    capacity, the full parts being packs of their own. Null texts are left out; empty ones take
    no room. Each row of a repeated doc_id is an item. Capacities below 1 and null ones are
    left out; pack_sizes is a parameter table and must have at most 1000 rows.

    A window that is full, or the fullest when nothing fits, leaves for good. Only those still open when a partition
    ends, at most ``windows`` for each capacity, are merged, ``merge`` partitions a task, again leaving at most
    ``windows`` open: so no task of a merge, the last one neither, gets more than windows * merge rows of a capacity.
    """
    spark = documents.sparkSession
    sizes = pack_sizes.filter("capacity >= 1 and pack is not null").select("pack", "capacity").distinct().limit(1001).collect()
    if len(sizes) > 1000:
        raise ValueError("pack_sizes has more than 1000 rows")
    capacities: Capacities = {r["pack"]: r["capacity"] for r in sizes}
    if not capacities:
        return spark.createDataFrame([], "pack string, pack_id bigint, doc_id bigint, part int, start_token bigint, n_tokens bigint")
    counted = materialise(with_tokens(documents.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), path=path), "tokens")
    tasks = max(1, -(-counted.count() // rows))
    # rows in a random but repeatable order, so that no partition gets one kind of text, or all rows of a repeated id
    dealt = counted.withColumn("at", F.xxhash64("doc_id", F.monotonically_increasing_id())).repartition(tasks, "at").sortWithinPartitions("at", "n_tokens")
    laid = materialise(dealt.mapInArrow(_laid(capacities, windows), LAID), "laid")
    left = laid.filter("part is null").select("pack", "window", "unit", F.col("n_tokens").alias("fill"))
    moved, number = None, 0
    while True:
        number += 1
        units = max(1, -(-tasks // merge))
        step = materialise(merge_step(left, capacities, number, units, windows, merge), "merged")
        pairs = step.filter("window is not null").select("pack", "window", "to")
        if moved is None:
            moved = pairs
        else:
            again = pairs.select("pack", F.col("window").alias("to"), F.col("to").alias("next"))
            moved = moved.join(again, ["pack", "to"], "left").select("pack", "window", F.coalesce("next", "to").alias("to"))
        if units == 1:
            break
        left, tasks = step.filter("window is null").select("pack", F.col("to").alias("window"), "unit", "fill"), units
    items = laid.filter("part is not null").drop("unit")
    return hot_join(items, moved, ["pack", "window"], "left").select("pack", F.coalesce("to", "window").alias("pack_id"), "doc_id", "part", "start_token", "n_tokens")


def merge_step(left: DataFrame, capacities: Capacities, number: int, units: int, windows: int = WINDOWS, merge: int = MERGE) -> DataFrame:
    """pack, window, to of leftover windows (pack, window, unit, fill) merged by units of ``merge`` partitions, and
    rows of null window for what is still open: pack, to, unit, fill."""
    placed = left.repartitionById(units, F.floor(F.col("unit") / merge).cast("int")).sortWithinPartitions("pack", F.desc("fill"), "window")
    return placed.select("pack", "window", "fill").mapInArrow(_merged(capacities, windows, number), "pack string, window bigint, to bigint, unit int, fill bigint")


def pack_fill(packed: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """pack, packs, tokens, fill: how full the packs of each capacity are."""
    sums = packed.groupBy("pack", "pack_id").agg(F.sum("n_tokens").alias("n")).groupBy("pack").agg(F.count("*").alias("packs"), F.sum("n").alias("tokens"))
    return sums.join(pack_sizes.select("pack", "capacity").distinct(), "pack").select("pack", "packs", "tokens", (F.col("tokens") / (F.col("packs") * F.col("capacity"))).alias("fill"))


def pack_checks(packed: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """pack, texts (first parts laid), over (packs beyond their capacity), torn (parts that do not begin where the one
    before ends, or that are cut short of a full pack): over and torn are 0."""
    sizes = pack_sizes.filter("capacity >= 1 and pack is not null").select("pack", "capacity").distinct()
    over = packed.groupBy("pack", "pack_id").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(sizes), "pack").filter("n > capacity").groupBy("pack").agg(F.count("*").alias("over"))
    parts = packed.join(F.broadcast(sizes), "pack").groupBy("pack").agg(F.count_if(F.expr("part = 0")).alias("texts"), F.count_if(F.expr("start_token <> part * cast(capacity as bigint) or n_tokens > capacity or part > 0 and n_tokens = 0")).alias("torn"))
    return parts.join(over, "pack", "left").select("pack", "texts", F.coalesce("over", F.lit(0)).alias("over"), "torn")
