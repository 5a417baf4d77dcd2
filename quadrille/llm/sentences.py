"""Sentences of documents in any script (problem 10)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialise, shuffle_partitions
from .boundaries import CONTEXT, IDENTITY, START, chunk_cuts, chunk_function, chunk_marks, composed

#: Characters of a chunk (a chunk ends inside the next word beyond them); chunks of a block, the unit of the prefix scan.
CHUNK, BLOCK = 2048, 64
MARGIN = 4 * CONTEXT
#: Results of a task are handed over in batches of so many rows.
BATCH = 4096

KEY = [("doc_id", pa.int64()), ("h", pa.int64())]
LEXED = pa.schema([*KEY, ("k", pa.int32()), ("n", pa.int32()), ("f", pa.binary()), ("codes", pa.binary()), ("ends", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("first", pa.int32()), ("final", pa.int32())])
FOLDED = pa.schema([*KEY, ("block", pa.int32()), ("g", pa.binary()), ("len", pa.int64())])
SCANNED = pa.schema([*KEY, ("block", pa.int32()), ("state", pa.int32()), ("base", pa.int64())])
PIECES = pa.schema([*KEY, ("block", pa.int32()), ("head_end", pa.int32()), ("ss", pa.list_(pa.int32())), ("es", pa.list_(pa.int32())), ("tail_begin", pa.int32()), ("first", pa.int32()), ("final", pa.int32())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for r in rows:
        out.append(r)
        if len(out) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)


def chunks(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, h, k, left, part, right: the chunks of each text with MARGIN characters of either neighbour.

    A chunk is cut inside a word, so no mark is cut. Chunks of rows, not documents, are dealt by hash, so all tasks
    share a long text, and also one that many rows repeat.
    """
    pattern = rf"(?s).{{1,{size}}}.*?(?:[\p{{L}}\p{{M}}]{{4}}(?=[\p{{L}}\p{{M}}]{{2}})|\z)"
    cut = documents.filter("text is not null and text != ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("parts"))
    before = F.concat(F.array(F.lit("")), F.transform("parts", lambda x: F.substring(x, -MARGIN, MARGIN)))
    after = F.concat(F.transform("parts", lambda x: F.substring(x, 1, MARGIN)), F.array(F.lit("")))
    some = F.arrays_zip(before.alias("left"), F.col("parts").alias("part"), F.slice(after, 2, F.size("parts")).alias("right"))
    found = cut.select("doc_id", "h", "row", F.posexplode(some).alias("k", "c")).filter("c.part is not null")
    spark = documents.sparkSession
    tasks = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    return found.repartition(tasks, "row", "k").select("doc_id", "h", "k", "c.left", "c.part", F.coalesce("c.right", F.lit("")).alias("right"))


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk as a function on the transducer's states, with its marks."""
    def rows() -> Iterator[tuple]:
        for doc, h, k, left, part, right in _rows(batches):
            a, z = len(left), len(left) + len(part)
            codes, ends, starts = chunk_marks(left + part + right, a, z)
            yield doc, h, k, len(part), chunk_function(codes), codes, ends, starts, len(part) - len(part.lstrip()), len(part.rstrip())

    yield from _batches(rows(), LEXED)


def _fold(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reduce: the functions of a block's chunks composed to one, and their characters summed."""
        def rows() -> Iterator[tuple]:
            for (doc, h, at), part in groupby(_rows(batches), lambda r: (r[0], r[1], r[2] // block)):
                g, n = IDENTITY, 0
                for r in part:
                    g, n = composed(g, r[4]), n + r[3]
                yield doc, h, at, g, n

        yield from _batches(rows(), FOLDED)

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan: the state and the offset in which each block of a document begins."""
    def rows() -> Iterator[tuple]:
        for (doc, h), part in groupby(_rows(batches), itemgetter(0, 1)):
            state, base = START, 0
            for _, _, at, g, n in part:
                yield doc, h, at, state, base
                state, base = g[state], base + n

    yield from _batches(rows(), SCANNED)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Down: from its block's state, the row before its chunks, every chunk gets its own and emits; units that span
    chunks of the block are joined."""
    def rows() -> Iterator[tuple]:
        for (doc, h, at), part in groupby(_rows(batches), itemgetter(0, 1, 2)):
            head = open_ = first = final = None
            ss: list[int] = []
            es: list[int] = []
            *_, state, base = next(part)
            for _, _, _, _, n, f, codes, ends, starts, left, right, _, _ in part:
                if first is None:
                    first = base + left
                for e, s in chunk_cuts(codes, ends, starts, state):
                    if open_ is None:
                        head = base + e
                    elif base + e > open_:
                        ss.append(open_)
                        es.append(base + e)
                    open_ = base + s
                final = base + right
                state, base = f[state], base + n
            yield doc, h, at, head, ss, es, open_, first, final

    yield from _batches(rows(), PIECES)


def sentence_units(documents: DataFrame, size: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, start_char, end_char of each sentence of each whole text.

    Offsets are code points. Null, empty and blank texts have no sentences. Rows equal in doc_id and text
    count once; their marks, not their texts, are brought together, reduced map-side.
    Every text takes the same way: its chunks become functions on states in parallel, a prefix scan over blocks of them
    (reduce, scan, down) gives each chunk's start state, and all emit in parallel. The result depends neither on ``size``
    nor on ``block``. A text holds at most 2^31 bytes, so one document has at most 2^31 / (size * block) blocks to scan.
    """
    key = ["doc_id", "h"]
    lexed = materialise(chunks(documents, size).mapInArrow(_lex, _ddl(LEXED)).distinct(), "chunks")
    at = F.floor(F.col("k") / block).cast("int").alias("block")
    dealt = lexed.select(*key, "k", "n", "f").repartition(*key, F.floor(F.col("k") / block)).sortWithinPartitions(*key, "k")
    folded = dealt.mapInArrow(_fold(block), _ddl(FOLDED))
    scanned = folded.repartition(*key).sortWithinPartitions(*key, "block").mapInArrow(_scan, _ddl(SCANNED))
    entered = lexed.select(*key, at, "k", "n", "f", "codes", "ends", "starts", "first", "final").unionByName(scanned.withColumn("k", F.lit(-1)), allowMissingColumns=True)
    pieces = entered.repartition(*key, "block").sortWithinPartitions(*key, "block", "k").mapInArrow(_emit, _ddl(PIECES))
    order = W.partitionBy(*key).orderBy("block")
    whole = W.partitionBy(*key)
    pieces = pieces.withColumn("carry", F.coalesce(F.last("tail_begin", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.min("first").over(whole))).withColumn("last_block", F.max("block").over(whole))
    none = F.array().cast("array<int>")
    last = F.col("block") == F.col("last_block")
    starts = F.concat(F.when(F.col("head_end").isNotNull(), F.array("carry")).otherwise(none), "ss", F.when(last, F.array(F.coalesce("tail_begin", "carry"))).otherwise(none))
    ends = F.concat(F.when(F.col("head_end").isNotNull(), F.array("head_end")).otherwise(none), "es", F.when(last, F.array("final")).otherwise(none))
    spans = pieces.select("doc_id", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("x"))
    return spans.select("doc_id", F.col("x.s").alias("start_char"), F.col("x.e").alias("end_char")).filter("end_char > start_char")
