"""Sources mixed to target weights over fixed-length token blocks (problem 9)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialise
from .tokens import VOCABULARY, with_tokens

#: Tokens of a block, blocks of an output shard, texts of a bucket of the running sum, most shards that one task draws.
BLOCK, SHARD, BUCKET, RANGE = 128, 4096, 20_000, 256
SEED = 20240517
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _scramble(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit mix of value and key (multiply and shift rounds)."""
    with np.errstate(over="ignore"):
        z = x + key * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a balanced Feistel network over the
    next power of four, walked on until the value falls inside."""
    index, size, key = (np.asarray(a).astype(np.uint64) for a in (index, size, key))
    bits = np.array([max(1, (int(s - 1).bit_length() + 1) // 2) if s > 0 else 1 for s in np.unique(size)], np.uint64)
    half = bits[np.searchsorted(np.unique(size), size)]
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], low[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (_scramble(right, k + np.uint64(r * 7919 + 1)) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= size[todo]
    return out.astype(np.int64)


def source_totals(blocks: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None) -> dict[str, int]:
    """Blocks of each source in the whole mixture: ``total`` shared by the weights (largest remainders), none beyond
    its blocks times its cap; what a source lacks goes to the others, by their weights.

    By default ``total`` is what the scarcest present source can bear under its cap.
    """
    supply = {n: blocks.get(n, 0) * max(0, r) for n, (_, r) in targets.items()}
    weight = {n: Fraction(w) for n, (w, _) in sorted(targets.items()) if supply[n] > 0 and w > 0}
    if not weight:
        return {}
    whole = sum(weight.values())
    most = min(supply[n] * whole // w for n, w in weight.items())
    total = most if total is None else min(total, sum(supply[n] for n in weight))
    given = dict.fromkeys(weight, 0)
    while (want := total - sum(given.values())) > 0:
        free = {n: w for n, w in weight.items() if given[n] < supply[n]}
        share = {n: want * w / sum(free.values()) for n, w in free.items()}
        add = {n: int(x) for n, x in share.items()}
        for n in sorted(free, key=lambda n: (add[n] - share[n], n))[: want - sum(add.values())]:
            add[n] += 1
        for n in free:
            given[n] = min(supply[n], given[n] + add[n])
    return given


def halved(counts: np.ndarray, slots: int, key: tuple[int, ...]) -> np.ndarray:
    """How many of each source fall into the first ``slots`` of all places, when all orders are equally likely.

    A multivariate hypergeometric draw seeded by ``key``; from 10^9 places on each marginal is the rounded normal one.
    """
    rng = np.random.default_rng(key)
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(map(int, counts)):
        rest -= n
        if not n or not slots:
            continue
        low, high, every = max(0, slots - rest), min(n, slots), n + rest
        if every < 10**9:
            x = int(rng.hypergeometric(n, rest, slots)) if rest else slots
        else:
            p = n / every
            x = round(rng.normal(slots * p, math.sqrt(slots * p * (1 - p) * ((every - slots) / max(1, every - 1)))))
        out[i] = min(high, max(low, x))
        slots -= int(out[i])
    return out


def shard_counts(totals: np.ndarray, shard: int, seed: int, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, counts, first) of the output shards begin..end-1: how many blocks each source has in the shard and in all before.

    The multinomial counts of the shards, given the totals, by halving the range of shards again and again; each node
    is seeded by its range, so any task can draw any shard and all agree.
    """
    every = int(totals.sum())

    def down(a: int, z: int, counts: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if z <= begin or a >= end:
            return
        if z - a == 1:
            yield a, counts, first
            return
        mid = (a + z) // 2
        left = halved(counts, (mid - a) * shard, (seed, a, z))
        yield from down(a, mid, left, first)
        yield from down(mid, z, counts - left, first + left)

    if every:
        yield from down(0, -(-every // shard), totals, np.zeros_like(totals))


def token_blocks(documents: DataFrame, block: int = BLOCK, path: str = VOCABULARY) -> DataFrame:
    """source, block, doc_id, start_token, n_tokens: each source's texts laid end to end and cut every ``block`` tokens.

    A running sum gives every text its place: sums per (source, bucket) first, then inside the
    bucket, so a source that holds most rows is no single task. Rows of a null source, and null
    or empty texts, have no place.
    """
    docs = documents.filter("text is not null and source is not null").select("source", F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counted = materialise(with_tokens(docs, path=path).withColumn("row", F.monotonically_increasing_id()), "mix-tokens")
    buckets = max(1, -(-counted.count() // BUCKET))
    placed = counted.filter("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("source", "bucket", (F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).alias("base")).fillna(0, ["base"])
    within = W.partitionBy("source", "bucket").orderBy("doc_id", "n_tokens", "row").rowsBetween(W.unboundedPreceding, -1)
    at = placed.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(base, ["source", "bucket"]).withColumn("at", F.col("base") + F.col("before"))
    b, n = F.lit(block), F.col("n_tokens")
    cut = at.select("source", "doc_id", "at", n.alias("n"), F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + n - 1) / b))).alias("block"))
    lo = F.greatest(F.col("block") * b, F.col("at"))
    hi = F.least((F.col("block") + 1) * b, F.col("at") + F.col("n"))
    return cut.select("source", "block", "doc_id", (lo - F.col("at")).alias("start_token"), (hi - lo).alias("n_tokens"))


SLOTS = pa.schema([("shard", pa.int32()), ("pos", pa.int64()), ("source", pa.string()), ("use", pa.int32()), ("block", pa.int64())])


def _slots(names: list[str], totals: list[int], blocks: list[int], shard: int, seed: int, step: int):
    """Slots of the shards whose ``step``-sized ranges arrive as ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        supply, numbers = np.array(blocks, np.int64), np.arange(len(names))
        for b in batches:
            for n in b.column(0).to_pylist():
                for k, counts, first in shard_counts(np.array(totals, np.int64), shard, seed, n * step, (n + 1) * step):
                    size = int(counts.sum())
                    which = np.repeat(numbers, counts)
                    slot = np.arange(size) - np.repeat(np.cumsum(counts) - counts, counts) + first[which]
                    use = slot // supply[which]
                    pos = permute(np.arange(size), np.full(size, size), np.full(size, k + seed))
                    block = permute(slot % supply[which], supply[which], seed + which * 1000 + use)
                    source = pa.array(names, pa.string()).take(pa.array(which, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k), pa.int32()), pa.array(pos, pa.int64()), source, pa.array(use, pa.int32()), pa.array(block, pa.int64())], schema=SLOTS)

    return run


def mix(documents: DataFrame, targets: DataFrame, total_blocks: int | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, path: str = VOCABULARY) -> DataFrame:
    """shard, pos, source, use, block, doc_id, start_token, n_tokens of the mixture.

    Counts per output shard are multinomial in the target shares, given the totals of the whole mixture; every task
    draws its own shards. Slot j of a source reads block perm(j mod blocks) in its use j div blocks, with a pseudorandom
    permutation for each use, so no block, and no token of a text, is used more than max_repeats times. By default the
    mixture is as large as the scarcest present source allows. Targets is a parameter table and
    must have at most 10000 rows; sources without a target are not mixed. Repeated targets of a
    source: the greatest share stands. Only one count per source reaches the driver.
    """
    spark = documents.sparkSession
    rows = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("targets has more than 10000 rows")
    want = {r["source"]: (r["w"], r["r"] or 0) for r in rows}
    pieces = materialise(token_blocks(documents.filter(F.col("source").isin(list(want))) if want else documents.limit(0), block, path), "blocks")
    have = {r[0]: r[1] for r in pieces.groupBy("source").agg(F.max("block") + 1).collect()}
    totals = source_totals(have, want, total_blocks)
    if not any(totals.values()):
        return spark.createDataFrame([], "shard int, pos bigint, source string, use int, block bigint, doc_id bigint, start_token bigint, n_tokens bigint")
    names = sorted(totals)
    shards = -(-sum(totals.values()) // shard)
    step = max(1, min(RANGE, shards // spark.sparkContext.defaultParallelism))
    ranges = -(-shards // step)
    drawn = spark.range(0, ranges, 1, ranges).mapInArrow(_slots(names, [totals[n] for n in names], [have[n] for n in names], shard, seed, step), "shard int, pos bigint, source string, use int, block bigint")
    # the size of what a task makes is not known to the planner, so a broadcast of it is ruled out
    return drawn.hint("merge").join(pieces, ["source", "block"]).select("shard", "pos", "source", "use", "block", "doc_id", "start_token", "n_tokens")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, tokens, actual_share, most_used of each target."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("use") + 1).alias("most_used"))
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    both = wanted.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = F.sum("tokens").over(W.partitionBy(F.lit(1)))  # over the sources, at most 10000 rows
    return both.select("source", "target_share", "tokens", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)).alias("actual_share"), F.coalesce("most_used", F.lit(0)).alias("most_used"))


def mix_checks(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, over (blocks used more often than max_repeats), full (slots beyond a block's tokens), off (whether the share
    reached is more than a point from the target among the present sources): all 0. One row for each present source."""
    wanted = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r"))
    uses = mixed.select("source", "block", "use").distinct().groupBy("source", "block").agg(F.count("*").alias("uses"))
    over = uses.join(F.broadcast(wanted), "source").groupBy("source").agg(F.count_if(F.col("uses") > F.col("r")).alias("over"))
    full = mixed.groupBy("source", "shard", "pos").agg(F.sum("n_tokens").alias("n")).groupBy("source").agg(F.count_if(F.col("n") > BLOCK).alias("full"), F.sum("n").alias("tokens"))
    both = full.join(over, "source").join(F.broadcast(wanted), "source")
    every = W.partitionBy(F.lit(1))  # over the sources, at most 10000 rows
    gap = F.abs(F.col("tokens") / F.sum("tokens").over(every) - F.col("w") / F.sum("w").over(every))
    return both.select("source", "over", "full", (gap > 0.01).cast("bigint").alias("off"))
