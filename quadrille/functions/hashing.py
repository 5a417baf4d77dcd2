"""Compatibility hashes: 32-bit Murmur3 over UTF-16 units, and the sums of it that name summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The string seed and the id of the empty summary.
STRING_SEED = 0xF7CA7FD2
EMPTY_ID = 48
M32 = 0xFFFFFFFF


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & M32


def murmur3_string(text: str, seed: int = STRING_SEED) -> int:
    """Signed 32-bit Murmur3 of a string: UTF-16 units two at a time, finalised with their number."""
    raw = text.encode("utf-16-be", "surrogatepass")
    units = [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]
    h = seed
    for i in range(0, len(units) - 1, 2):
        k = ((units[i] << 16) + units[i + 1]) & M32
        h ^= _rotl(k * 0xCC9E2D51 & M32, 15) * 0x1B873593 & M32
        h = (_rotl(h, 13) * 5 + 0xE6546B64) & M32
    if len(units) % 2:
        h ^= _rotl(units[-1] * 0xCC9E2D51 & M32, 15) * 0x1B873593 & M32
    h ^= len(units)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * factor & M32
    h ^= h >> 16
    return wrap32(h)


def wrap32(n: int) -> int:
    return (n + 2**31) % 2**32 - 2**31


@F.pandas_udf(T.IntegerType())
def ref_hash(texts: pd.Series) -> pd.Series:
    """Murmur3 of each distinct string of the batch; null for null."""
    known = {t: murmur3_string(t) for t in texts.dropna().unique()}
    return texts.map(known).astype("Int32")


def wrap(total: Column) -> Column:
    """A BIGINT sum brought to 32 bits with wrap-around."""
    return (F.pmod(total + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)).cast("int")


def summary_id(labels: list[str], neighbors: dict[str, list[str]]) -> int:
    """The id of a summary: 17, its labels' hashes, 31, and each property's hash with its target's id."""
    total = 17 + sum(murmur3_string(x) for x in set(labels)) + 31
    for p, target in neighbors.items():
        total += murmur3_string(p) + wrap32(EMPTY_ID + sum(murmur3_string(x) for x in set(target)))
    return wrap32(total)


def edge_id(summary: int, prop: str) -> int:
    """The id of a summary's edge: the hash of the summary's id in decimal and the property."""
    return murmur3_string(f"{summary}{prop}")


@F.pandas_udf(T.IntegerType())
def ref_summary_id(labels: pd.Series, properties: pd.Series, targets: pd.Series) -> pd.Series:
    """summary_id of (labels, property names, their targets' labels), over distinct summaries."""
    out = []
    for ls, ps, ts in zip(labels, properties, targets):
        total = 48 + sum(murmur3_string(x) for x in set(ls))
        for p, t in zip(ps, ts):
            total += murmur3_string(p) + wrap32(EMPTY_ID + sum(murmur3_string(x) for x in set(t)))
        out.append(wrap32(total))
    return pd.Series(out, dtype="int32")
