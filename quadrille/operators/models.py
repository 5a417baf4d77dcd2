"""The equivalence relations: one summary per subject.

Every model gives v, labels, neighbors (property -> its target's labels, sorted), payload and
sig. sig is a canonical JSON text of labels and neighbors; equal summaries have equal sig.
``by``: columns that tell several graphs of one frame apart; they stay and come first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SummaryConfig
from ..runtime import hot_join, materialise
from .graph import edges, labels

NO_LABELS = "array<string>"
NEIGHBOR = "array<struct<p:string,t:array<string>>>"


def empty_labels() -> Column:
    return F.array().cast(NO_LABELS)


def signature(label: Column, neighbor: Column) -> Column:
    return F.to_json(F.struct(label.alias("l"), neighbor.alias("n")))


def _payloads(edge: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return edge.groupBy(*by, "s").agg(F.array_sort(F.collect_set("g")).alias("payload"))


def _finish(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return df.select(*by, F.col("s").alias("v"), "labels", "neighbors", "payload").withColumn("sig", signature(F.col("labels"), F.col("neighbors")))


def _with_labels(subjects: DataFrame, label: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return subjects.join(label.withColumnRenamed("v", "s"), [*by, "s"], "left").withColumn("labels", F.coalesce("labels", empty_labels()))


def class_collection(edge: DataFrame, label: DataFrame, neighbor_mode: str = "min", by: tuple[str, ...] = ()) -> DataFrame:
    """Subjects of equal label sets. No edge is joined to its target."""
    return _finish(_with_labels(_payloads(edge, by), label, by).withColumn("neighbors", F.array().cast(NEIGHBOR)), by)


def attribute_collection(edge: DataFrame, label: DataFrame, neighbor_mode: str = "min", by: tuple[str, ...] = ()) -> DataFrame:
    """Subjects of equal property sets. One aggregation, no join."""
    both = edge.groupBy(*by, "s").agg(F.array_sort(F.collect_set("p")).alias("ps"), F.array_sort(F.collect_set("g")).alias("payload"))
    neighbors = F.transform("ps", lambda p: F.struct(p.alias("p"), empty_labels().alias("t")))
    return _finish(both.select(*by, "s", "payload", empty_labels().alias("labels"), neighbors.alias("neighbors")), by)


def complex_collection(edge: DataFrame, label: DataFrame, neighbor_mode: str = "min", by: tuple[str, ...] = ()) -> DataFrame:
    """Subjects of equal labels and, for each property, equal labels of the target.

    ``min``: of several targets of one property the least label set stands (one edge per
    property, whatever the order of rows). ``all``: each distinct target counts. Distinct
    (s, p, target labels) are formed before anything is collected per subject.
    """
    dst = label.select(*by, F.col("v").alias("o"), F.col("labels").alias("t"))
    known = hot_join(edge, dst, [*by, "o"], "left").withColumn("t", F.coalesce("t", empty_labels()))
    if neighbor_mode == "min":
        per = known.groupBy(*by, "s", "p").agg(F.min("t").alias("t"), F.collect_set("g").alias("gs"))
    elif neighbor_mode == "all":
        per = known.groupBy(*by, "s", "p", "t").agg(F.collect_set("g").alias("gs"))
    else:
        raise ValueError(neighbor_mode)
    subjects = per.groupBy(*by, "s").agg(
        F.array_sort(F.collect_list(F.struct("p", "t"))).alias("neighbors"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("gs")))).alias("payload"))
    return _finish(_with_labels(subjects, label, by), by)


Model = Callable[[DataFrame, DataFrame, str, tuple[str, ...]], DataFrame]
MODELS: dict[str, Model] = {
    "class-collection": class_collection,
    "attribute-collection": attribute_collection,
    "complex-attribute_class-collection": complex_collection,
}


def summarize(quads: DataFrame, config: SummaryConfig, by: tuple[str, ...] = (), label_quads: DataFrame | None = None) -> DataFrame:
    """One summary per subject with at least one property edge; others have none. Empty quads give no rows.

    ``label_quads``: where the labels come from, if not from ``quads``."""
    label = labels(quads if label_quads is None else label_quads, config.class_signal, by)
    out = MODELS[config.model](edges(quads, config.class_signal, config.undirected, config.literal_subjects, by), label, config.neighbor_mode, by)
    return out if config.payload else out.withColumn("payload", empty_labels())


def k_collection(edge: DataFrame, label: DataFrame, k: int) -> DataFrame:
    """v, block: subjects equal in their neighbourhood up to ``k`` steps (k-bounded bisimulation).

    Step i hashes a vertex's labels with the distinct (property, block of the target at i-1).
    Each step is one join and one aggregation, written to the shared folder.
    """
    steps = materialise(edge.select("s", "p", "o").distinct(), "k-edges")
    ends = steps.select(F.explode(F.array("s", "o")).alias("v")).distinct()
    base = ends.join(label, "v", "left").select("v", F.sha2(F.to_json(F.struct(F.coalesce("labels", empty_labels()).alias("l"))), 256).alias("base"))
    base = materialise(base, "k-base")
    block = base.select("v", F.col("base").alias("block"))
    for _ in range(k):
        seen = hot_join(steps, block.select(F.col("v").alias("o"), F.col("block").alias("t")), ["o"]).groupBy("s").agg(F.array_sort(F.collect_set(F.struct("p", "t"))).alias("n"))
        block = materialise(base.join(seen.withColumnRenamed("s", "v"), "v", "left").select("v", F.sha2(F.concat("base", F.coalesce(F.to_json("n"), F.lit(""))), 256).alias("block")), "k-step")
    return block.join(steps.select(F.col("s").alias("v")).distinct(), "v", "left_semi")
