"""Duplicates hidden by formatting differences, through dictionary-encoded fields (problem 4)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise, salted_join


def canonical(text: str | None) -> str:
    """Letters and digits of a text in composed, case-folded form; accents count."""
    if not text:
        return ""
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return "".join(c for c in folded if c.isalnum() or unicodedata.category(c)[0] in "MN")


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


def encoded_records(lines: DataFrame, key: str = "line_id", record: str = "venue") -> DataFrame:
    """key, codes: every record as its sorted tuple of integers, one for each (field, canonical value).

    Every distinct value is canonicalised once and numbered; records are rewritten through that
    dictionary. Null and empty fields are absent. A text that is no JSON object is one nameless
    field. Null records and null keys are left out; if one key has several records, each stands.
    """
    parsed = lines.filter(F.col(key).isNotNull() & F.col(record).isNotNull()).select(key, F.xxhash64(record).alias("rec"), F.from_json(record, "map<string,string>").alias("m"), record)
    parsed = parsed.withColumn("m", F.when(F.col("m").isNull(), F.create_map(F.lit(""), F.col(record))).otherwise(F.col("m")))
    # each record's fields, and one nameless row for the record itself, which may have none
    fields = F.filter(F.map_entries("m"), lambda e: e["value"].isNotNull())
    itself = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    stored = materialise(parsed.select(key, "rec", F.explode(F.concat(fields, itself)).alias("e")).select(key, "rec", F.col("e.key").alias("field"), F.col("e.value").alias("value")), "entries")
    entries = stored.filter("field is not null")
    distinct = entries.select("field", "value").distinct().select("field", "value", _canonical("field").alias("f"), _canonical("value").alias("v")).filter("v != ''")
    distinct = materialise(distinct, "canonical")
    numbers = materialise(distinct.select("f", "v").distinct().withColumn("code", F.monotonically_increasing_id()), "numbers")
    codes = distinct.join(numbers, ["f", "v"]).select("field", "value", "code")
    coded = salted_join(entries, codes, ["field", "value"]).select(key, "rec", "code").unionByName(stored.filter("field is null").select(key, "rec", F.lit(None).cast("bigint").alias("code")))
    return coded.groupBy(key, "rec").agg(F.array_sort(F.collect_set("code")).alias("codes")).select(key, "codes").distinct()


def copy_groups(records: DataFrame, key: str = "line_id") -> DataFrame:
    """codes, keep_id (smallest key), copies: one row for each distinct record. Counted map-side first."""
    return records.groupBy("codes").agg(F.min(key).alias("keep_id"), F.count_distinct(key).alias("copies"))


def further_copies(lines: DataFrame, key: str = "line_id", record: str = "venue") -> DataFrame:
    """keep_id and each other key of its group."""
    records = materialise(encoded_records(lines, key, record), "records")
    groups = records.groupBy("codes").agg(F.min(key).alias("keep_id"), F.max(key).alias("last")).filter("last > keep_id").drop("last")
    return salted_join(records, groups, ["codes"]).filter(F.col(key) > F.col("keep_id")).select("keep_id", key).distinct()


def collapsed(lines: DataFrame, key: str = "line_id", record: str = "venue") -> DataFrame:
    """keep_id, copies of each record."""
    return copy_groups(encoded_records(lines, key, record), key).select("keep_id", "copies")
