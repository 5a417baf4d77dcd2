"""A property graph as two frames: labels of vertices, and edges. ``by``: columns that tell several graphs of one frame apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import is_literal
from ..runtime import hot_join, materialise

EVERY = "*"


def class_edge(signal: str | None) -> Column:
    """Whether an edge gives its subject a label."""
    return F.lit(True) if signal == EVERY else F.lit(False) if signal is None else F.col("p") == signal


def plain_edge(signal: str | None) -> Column:
    """Whether an edge is a property; under "*" every edge is."""
    return F.lit(True) if signal in (EVERY, None) else F.col("p") != signal


def labels(quads: DataFrame, signal: str | None, by: tuple[str, ...] = ()) -> DataFrame:
    """v, labels (sorted set) of vertices with a label; partial sets are built map-side."""
    return quads.filter(class_edge(signal) & F.col("s").isNotNull() & F.col("o").isNotNull()).groupBy(*by, F.col("s").alias("v")).agg(F.array_sort(F.collect_set("o")).alias("labels"))


def edges(quads: DataFrame, signal: str | None, undirected: bool = False, literal_subjects: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """s, p, o, g of the property edges. Undirected adds each edge turned round, unless its object is a literal. One scan."""
    out = quads.filter(plain_edge(signal) & F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()).select(*by, "s", "p", "o", "g")
    if not undirected:
        return out
    there = F.struct(*by, "s", "p", "o", "g")
    back = F.struct(*by, F.col("o").alias("s"), "p", F.col("s").alias("o"), "g")
    turns = F.array(there, back) if literal_subjects else F.when(is_literal("o"), F.array(there)).otherwise(F.array(there, back))
    return out.select(F.explode(turns).alias("e")).select("e.*")


def vertices(quads: DataFrame, signal: str | None, undirected: bool = False) -> DataFrame:
    """v, labels of every endpoint; labels are null where there are none."""
    ends = edges(quads, signal, undirected).select(F.explode(F.array("s", "o")).alias("v")).distinct()
    return ends.join(labels(quads, signal), "v", "full_outer")


def triplets(edge: DataFrame, label: DataFrame) -> DataFrame:
    """s, p, o, g, src_labels, dst_labels. Hot objects are split; a vertex is one row of ``label``."""
    src = label.select(F.col("v").alias("s"), F.col("labels").alias("src_labels"))
    dst = label.select(F.col("v").alias("o"), F.col("labels").alias("dst_labels"))
    return hot_join(hot_join(edge, dst, ["o"], "left"), src, ["s"], "left").select("s", "p", "o", "g", "src_labels", "dst_labels")


def subject_bundles(edge: DataFrame) -> DataFrame:
    """s, p, o, g, n: the set of distinct edges of each subject as rows, so that no bundle is a huge array, and their number."""
    bundles = materialise(edge.select("s", "p", "o", "g").distinct(), "bundles")
    return hot_join(bundles, bundles.groupBy("s").agg(F.count("*").alias("n")), ["s"])


def bundle_sizes(edge: DataFrame) -> DataFrame:
    """s, n: the number of distinct edges of each subject, one row a subject; ``subject_bundles`` has the edges themselves."""
    return edge.select("s", "p", "o", "g").distinct().groupBy("s").agg(F.count("*").alias("n"))
