"""Queries of the problems on training text and typed names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, spread
from .formats import collapsed, further_copies
from .mixing import mix, mix_checks, mix_shares
from .names import name_clusters, variants
from .packing import pack_checks, pack_fill, pack_texts
from .sentences import sentence_units
from .sql import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "author_records"), table(spark, sf_dir, "affiliations"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record and spelling: its class and how many links it has there."""
    people, places = name_clusters(table(spark, sf_dir, "author_records"), table(spark, sf_dir, "affiliations"))
    both = people.withColumn("kind", F.lit("person")).unionByName(places.withColumn("kind", F.lit("org")))
    sizes = both.groupBy("kind", "cluster").agg(F.min("key").alias("class_id"), (F.count("*") - 1).alias("links"))
    return both.join(sizes, ["kind", "cluster"]).select("kind", "key", "class_id", "links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return further_copies(table(spark, sf_dir, "venue_lines"))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(table(spark, sf_dir, "venue_lines"))


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_fill(p8_packs(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_checks(materialise(p8_packs(spark, sf_dir), "packs"), table(spark, sf_dir, "pack_sizes"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_checks(materialise(p9_mix(spark, sf_dir), "mixed"), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_clusters, p4_found, p4_copies, p8_packs, p8_fill, p8_checks, p9_mix, p9_shares, p9_checks, p10_found)}
