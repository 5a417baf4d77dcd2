"""Attribute-value rows into wide tables by positional stitching (problem 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.terms import normalise
from ..runtime import materialise

# The single-valued labels and their types; labels that hold several values.
INT_LABELS = ["year", "volume", "issue", "page_start", "page_end"]
TEXT_LABELS = ["title", "doc_type", "lang", "publisher", "issn", "doi"]
LIST_LABELS = {"author": "authors", "field-of-study": "fields_of_study"}
SPACES = " \t\n\x0b\f\r"
#: Entities of an ordinal range; a range is stitched in one task's memory.
RANGE = 4096
INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def clean_value(c: Column) -> Column:
    """Outer white space, enclosing quotes and a language or datatype mark off; white space inside the quotes too."""
    bare = F.btrim(c, F.lit(SPACES))
    inner = F.regexp_replace(bare, r'(?s)^"(.*)"(@[A-Za-z0-9-]+|\^\^\S+)?$', "$1")  # as it is where nothing encloses it
    return F.when(bare.startswith('"'), F.btrim(inner, F.lit(SPACES))).otherwise(bare)


def whole_number(c: Column) -> Column:
    """The INT a text denotes (a sign, and a fraction of zeros, are allowed), else null."""
    digits = F.when(c.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_replace(c, r"\..*$|^\+", ""))
    n = digits.try_cast("bigint")
    return F.when(n.between(INT_MIN, INT_MAX), n)


def cells(rows: DataFrame) -> DataFrame:
    """id, label, seq, val: the standing value of each single-valued cell, all distinct values of the others.

    Of a single-valued label the last loaded value that is not empty and fits stands (ties: the
    greatest text). Others are numbered by first load, then text. Null ids and labels are disregarded.
    """
    base = rows.select("id", normalise("label").alias("label"), clean_value(F.col("attribute")).alias("val"), "loaded_at").filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.col("val") != ""))
    typed = base.withColumn("val", F.when(F.col("label").isin(INT_LABELS), whole_number(F.col("val")).cast("string")).otherwise(F.col("val"))).filter("val is not null")
    single = F.col("label").isin(INT_LABELS + TEXT_LABELS)
    # one pass: a cell of a single value is a group of its own, of the others each distinct value
    groups = typed.groupBy("id", "label", F.when(~single, F.col("val")).alias("own")).agg(F.max(F.struct("loaded_at", "val")).getField("val").alias("val"), F.min("loaded_at").cast("timestamp").alias("at"))
    return groups.select("id", "label", "val", F.when(F.col("own").isNotNull(), F.col("at")).alias("at"))


def _schema(texts: list[str]) -> str:
    return ("ordinal bigint, id string, " + ", ".join(f"{c} int" for c in INT_LABELS) + ", " + ", ".join(f"{c} string" for c in texts)
            + ", " + ", ".join(f"{c} array<string>" for c in LIST_LABELS.values()) + ", extra map<string,array<string>>")


def _bounds(groups: np.ndarray, n: int) -> np.ndarray:
    """Where each of n groups begins in sorted group numbers, and the end."""
    return np.searchsorted(groups, np.arange(n + 1)).astype(np.int32)


def _stitch(key: tuple, table: pa.Table) -> pa.Table:
    """One range: every label's values are scattered into a typed column aligned to the range's ordinals, and the
    columns are put side by side by position."""
    table = table.combine_chunks()
    coded = table["id"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    place = rank[coded.indices.to_numpy()]
    label, val, at = (table[c].combine_chunks() for c in ("label", "val", "at"))
    columns: dict[str, pa.Array] = {"ordinal": pa.array(key[1].as_py() + np.arange(n), pa.int64()), "id": coded.dictionary.take(pa.array(order))}
    rest = np.ones(len(place), bool)

    def of(name: str) -> np.ndarray:
        here = pc.equal(label, name).to_numpy(zero_copy_only=False)
        rest[here] = False
        return np.flatnonzero(here)

    for name in INT_LABELS + TEXT_LABELS:
        found = of(name)
        source = np.full(n, -1, np.int64)
        source[place[found]] = found
        column = val.take(pa.array(source, pa.int64(), mask=source < 0))
        columns[name] = column.cast(pa.int32()) if name in INT_LABELS else column
    # values of lists by entity, then first load (unknown before all), then text
    loaded = np.where(at.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, at.cast(pa.int64()).fill_null(0).to_numpy())

    def ordered(rows: np.ndarray, **more) -> np.ndarray:
        t = pa.table({"place": place[rows], **more, "loaded": loaded[rows], "val": val.take(pa.array(rows))})
        return rows[pc.sort_indices(t, sort_keys=[(c, "ascending") for c in t.column_names]).to_numpy()]

    for name, out in LIST_LABELS.items():
        found = ordered(of(name))
        bounds = _bounds(place[found], n)
        columns[out] = pa.ListArray.from_arrays(pa.array(bounds), val.take(pa.array(found)), mask=pa.array(bounds[1:] == bounds[:-1]))
    found = np.flatnonzero(rest)
    found = ordered(found, label=label.take(pa.array(found)))
    names = label.take(pa.array(found))
    numbers = names.dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.r_[True, (np.diff(place[found]) != 0) | (np.diff(numbers) != 0)][: len(found)])
    items = pa.ListArray.from_arrays(pa.array(np.r_[first, len(found)].astype(np.int32)), val.take(pa.array(found)))
    columns["extra"] = pa.MapArray.from_arrays(pa.array(_bounds(place[found][first], n)), names.take(pa.array(first)), items)
    return pa.table(columns)


def wide_table(rows: DataFrame) -> DataFrame:
    """One row per entity with typed columns, arrays for labels of several values, rare labels in ``extra``.

    Entities fall by hash into ranges of about RANGE entities; the ranges' numbers of entities, summed up, give each
    range its first ordinal, so that ordinals count all entities from 0 without a gap. Each label's values become a typed
    column aligned to the ordinals of the range, and the columns are put side by side by position. Repeated
    and outdated values are reduced before anything is shuffled by range.
    """
    kept = materialise(cells(rows), "cells")
    entities = kept.agg(F.approx_count_distinct("id")).first()[0]
    at = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-entities // RANGE)))).alias("range")
    sizes = kept.select(at, "id").distinct().groupBy("range").agg(F.count("*").alias("n"))
    # one task: as many rows as there are ranges, entities / RANGE
    bases = sizes.select("range", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranged = kept.select(at, "id", "label", "val", "at").join(bases, "range")
    return ranged.groupBy("range", "base").applyInArrow(_stitch, _schema(TEXT_LABELS))


def filled_cells(wide: DataFrame) -> DataFrame:
    """id, label, val of the filled single-valued cells of the wide table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("val")) for c in INT_LABELS + TEXT_LABELS])
    return wide.select("id", F.explode(pairs).alias("c")).filter("c.val is not null").select("id", "c.label", "c.val")
