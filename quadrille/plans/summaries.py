"""Queries of the summary engine over the relational tables, snapshots of orders, raw lines and papers."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SummaryConfig
from ..functions.terms import is_literal, normalise
from ..operators import graph, incremental, models, stats, summary
from ..runtime import discard, hot_join, materialise, salted_join, spread, work_path
from ..sinks import edge_ids, mapping, vertex_hashes
from ..sources import citations, eventlog, nquads, tables

Query = Callable[[SparkSession, str], DataFrame]
#: Every year between the first and the last order is a snapshot with jobs of its own; more than this many raise.
MOST_YEARS = 100
SIGNAL = tables.SIGNAL
CONFIG = SummaryConfig(class_signal=SIGNAL)
BY = ("year",)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def joined(c: Column | str) -> Column:
    return F.array_join(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")), "|")


def neighbor_text(c: Column | str) -> Column:
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda n: F.concat(n["p"], F.lit(">"), F.array_join(n["t"], "|"))), ",")


def as_text(df: DataFrame) -> DataFrame:
    return df.select("v", joined("labels").alias("labels"), neighbor_text("neighbors").alias("neighbors"), joined("payload").alias("payload"))


def all_quads(spark: SparkSession, d: str) -> DataFrame:
    return tables.quads_from_tables(spark, d)


def edges(spark: SparkSession, d: str, undirected: bool = False) -> DataFrame:
    return graph.edges(all_quads(spark, d), SIGNAL, undirected)


def model(name: str, undirected: bool = False, mode: str = "min") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: models.summarize(all_quads(spark, d), SummaryConfig(model=name, class_signal=SIGNAL, undirected=undirected, neighbor_mode=mode))


COMPLEX = model("complex-attribute_class-collection")


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The complex summaries, computed once for queries that use them several times."""
    return materialise(COMPLEX(spark, d), "summaries")


def snapshot(spark: SparkSession, d: str, year: int) -> DataFrame:
    quads = tables.window_quads(table(spark, d, "orders"), table(spark, d, "customer"), year)
    return models.summarize(quads, CONFIG)


def order_years(spark: SparkSession, d: str) -> range:
    """All years from the first to the last order."""
    low, high = table(spark, d, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    if low is None:
        return range(0)
    if high - low >= MOST_YEARS:
        raise ValueError(f"orders span {low} to {high}, more than {MOST_YEARS} years")
    return range(low, high + 1)


def year_quads(spark: SparkSession, d: str, year: int) -> DataFrame:
    return tables.window_quads(table(spark, d, "orders"), table(spark, d, "customer"), year)


def each_step(spark: SparkSession, d: str, make: Callable[[SparkSession, str, int], DataFrame], compare: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What ``compare`` tells of each year against the one before, with the year. ``make`` gives a year's frame; each is stored once."""
    made = {y: materialise(make(spark, d, y), "year") for y in order_years(spark, d)}
    parts = [compare(made[y - 1], made[y]).select(F.lit(y).alias("year"), "*") for y in made if y - 1 in made]
    if not parts:
        none = make(spark, d, 0).limit(0)
        parts = [compare(none, none).select(F.lit(0).alias("year"), "*").limit(0)]
    return reduce(DataFrame.unionByName, parts)


def yearly(spark: SparkSession, d: str, years: range) -> DataFrame:
    """The quads of all years' snapshots in one frame, for queries that would need too many plans year by year."""
    return tables.yearly_quads(table(spark, d, "orders"), table(spark, d, "customer"), years)


def steps(df: DataFrame, years: range, first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two frames of one with a column year, for a comparison by year: the year before, under the later year's number, and
    the year itself. ``first``: the first year stays, with nothing before it."""
    before = df.withColumn("year", F.col("year") + 1).filter(F.col("year") < years.stop)
    return before, df if first else df.filter(F.col("year") > years.start)


# sources and terms


def quads_from_tables(spark: SparkSession, d: str) -> DataFrame:
    return all_quads(spark, d)


def nquad_format_parse(spark: SparkSession, d: str) -> DataFrame:
    return nquads.quads_from_lines(spread(table(spark, d, "raw_quads")), keep=["line_no"])


def malformed_filter(spark: SparkSession, d: str) -> DataFrame:
    return nquads.corrupt_lines(spread(table(spark, d, "raw_quads")))


def term_normalize(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "imprint").select(F.explode("_payload").alias("term")).filter("term is not null")
    return sources.groupBy(normalise("term").alias("term")).agg(F.countDistinct("term").alias("spellings"))


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_quads").groupBy("file_name").agg(F.count("*").alias("lines"), F.count_if(F.trim("value") == "").alias("blank"))


def delta_scan(spark: SparkSession, d: str) -> DataFrame:
    """Additions and removals of each yearly step as one frame with an operation."""
    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        return b.exceptAll(a).withColumn("op", F.lit("add")).unionByName(a.exceptAll(b).withColumn("op", F.lit("remove")))

    return each_step(spark, d, year_quads, step)


# graph


def vertex_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.labels(all_quads(spark, d), SIGNAL).select("v", joined("labels").alias("labels"))


def vertex_labels_all_signal(spark: SparkSession, d: str) -> DataFrame:
    return graph.labels(all_quads(spark, d), graph.EVERY).select("v", joined("labels").alias("labels"))


def edges_directed(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


def edges_undirected(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d, True)


def literal_filter(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("p").agg(F.count_if(is_literal("o")).alias("literals"), F.count_if(~is_literal("o")).alias("links"))


def triplets(spark: SparkSession, d: str) -> DataFrame:
    quads = all_quads(spark, d)
    return graph.triplets(graph.edges(quads, SIGNAL), graph.labels(quads, SIGNAL)).select("s", "p", "o", "g", joined("src_labels").alias("src_labels"), joined("dst_labels").alias("dst_labels"))


def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.vertices(all_quads(spark, d), SIGNAL).select("v", joined("labels").alias("labels"))


def subject_bundles(spark: SparkSession, d: str) -> DataFrame:
    return graph.bundle_sizes(edges(spark, d))


def subject_bundle_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the bundles themselves, each with its bundle's size."""
    return graph.subject_bundles(edges(spark, d))


# models


def class_collection(spark: SparkSession, d: str) -> DataFrame:
    return as_text(model("class-collection")(spark, d))


def attribute_collection(spark: SparkSession, d: str) -> DataFrame:
    return as_text(model("attribute-collection")(spark, d))


def attribute_collection_undirected(spark: SparkSession, d: str) -> DataFrame:
    return as_text(model("attribute-collection", True)(spark, d))


def class_collection_undirected(spark: SparkSession, d: str) -> DataFrame:
    return as_text(model("class-collection", True)(spark, d))


def complex_collection(spark: SparkSession, d: str) -> DataFrame:
    return as_text(COMPLEX(spark, d))


def complex_collection_undirected(spark: SparkSession, d: str) -> DataFrame:
    return as_text(model("complex-attribute_class-collection", True)(spark, d))


def complex_collection_all_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return as_text(model("complex-attribute_class-collection", mode="all")(spark, d))


def k_bisimulation(spark: SparkSession, d: str) -> DataFrame:
    """v and its class of two steps, named by the least vertex in it."""
    quads = all_quads(spark, d)
    blocks = materialise(models.k_collection(graph.edges(quads, SIGNAL), graph.labels(quads, SIGNAL), 2), "classes")
    return hot_join(blocks, blocks.groupBy("block").agg(F.min("v").alias("class")), ["block"]).select("v", "class")


# summary graph


def summary_vertices(spark: SparkSession, d: str) -> DataFrame:
    s = stored(spark, d)
    primary = summary.primary(s).select(joined("labels").alias("labels"), neighbor_text("neighbors").alias("neighbors"), "instances", F.lit(True).alias("is_primary"))
    rest = summary.vertices_of(s).filter("not is_primary").select(joined("labels").alias("labels"), F.lit("").alias("neighbors"), F.lit(0).cast("bigint").alias("instances"), "is_primary")
    return primary.unionByName(rest)


def summary_edges(spark: SparkSession, d: str) -> DataFrame:
    s = summary.primary(COMPLEX(spark, d))
    return s.select(joined("labels").alias("src_labels"), neighbor_text("neighbors").alias("src_neighbors"), F.explode("neighbors").alias("n")).select("src_labels", "src_neighbors", F.col("n.p").alias("property"), joined("n.t").alias("dst_labels"))


def secondary_summaries(spark: SparkSession, d: str) -> DataFrame:
    return summary.secondary(COMPLEX(spark, d)).select(joined("labels").alias("labels"))


def summary_payload(spark: SparkSession, d: str) -> DataFrame:
    s = stored(spark, d)
    named = summary.primary(s).select("sig", joined("labels").alias("labels"), neighbor_text("neighbors").alias("neighbors"))
    return salted_join(summary.payload_of(s), named, ["sig"]).select("labels", "neighbors", "g")


def summary_instances(spark: SparkSession, d: str) -> DataFrame:
    return COMPLEX(spark, d).select(joined("labels").alias("labels"), neighbor_text("neighbors").alias("neighbors"), "v")


def imprints(spark: SparkSession, d: str) -> DataFrame:
    i = summary.imprints(COMPLEX(spark, d))
    return i.select("v", joined("labels").alias("labels"), joined("props").alias("props"), joined("payload").alias("payload"))


def completeness_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.primary(COMPLEX(spark, d)).select(joined("labels").alias("labels"), neighbor_text("neighbors").alias("neighbors"), "instances")


def index_information(spark: SparkSession, d: str) -> DataFrame:
    return summary.index_information(stored(spark, d))


def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.counts(stored(spark, d))


def ntriples_export(spark: SparkSession, d: str) -> DataFrame:
    return summary.ntriples(stored(spark, d), "http://example.org/summary", SIGNAL)


def vertex_summary_mapping(spark: SparkSession, d: str) -> DataFrame:
    return mapping(stored(spark, d))


def summary_edge_hash(spark: SparkSession, d: str) -> DataFrame:
    return edge_ids(COMPLEX(spark, d))


def vertex_hash(spark: SparkSession, d: str) -> DataFrame:
    return vertex_hashes(edges(spark, d))


# statistics


def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.degrees(edges(spark, d)).groupBy("degree", "in_degree", "out_degree").agg(F.count("*").alias("vertices"))


def degree_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = stats.degree_statistics(edges(spark, d))
    return s.select(*[F.round(c, 6).alias(c) if c.startswith(("avg_", "std_")) and c != "avg_degree_new" else F.col(c).cast("bigint").alias(c) for c in s.columns])


# snapshots


def _known_before(spark: SparkSession, d: str, how: str) -> DataFrame:
    """Edges of each year joined by subject with the summaries of the year before."""
    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        return graph.edges(b, SIGNAL).join(models.summarize(a, CONFIG).select(F.col("v").alias("s")), "s", how)

    return each_step(spark, d, year_quads, step)


def unknown_subject_edges(spark: SparkSession, d: str) -> DataFrame:
    return _known_before(spark, d, "left_anti")


def known_subject_edges(spark: SparkSession, d: str) -> DataFrame:
    return _known_before(spark, d, "left_semi")


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return each_step(spark, d, snapshot, lambda a, b: incremental.diff(summary.imprints(a), summary.imprints(b)))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).select("year", "v", "status", F.coalesce("neighbor_only", F.lit(False)).alias("neighbor_only"))


def neighbor_changes(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).filter("neighbor_only").select("year", "v")


def payload_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).filter("status != 'deleted' and payload_added + payload_removed > 0").select("year", "v", "payload_added", "payload_removed")


def stale_imprints(spark: SparkSession, d: str) -> DataFrame:
    years = order_years(spark, d)
    imprints = summary.imprints(models.summarize(yearly(spark, d, years), CONFIG, BY), BY)
    before, now = steps(materialise(imprints.select("year", "v"), "imprints"), years)  # what nothing reads is not computed
    return incremental.stale(before, now, BY).select("year", "v")


def deleted_summaries(spark: SparkSession, d: str) -> DataFrame:
    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        named = summary.primary(a).select("sig", joined("labels").alias("labels"), neighbor_text("neighbors").alias("neighbors"))
        return incremental.deleted_summaries(summary.imprints(a), summary.imprints(b)).join(named, "sig").select("labels", "neighbors")

    return each_step(spark, d, snapshot, step)


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Secondary summaries that went between any two years in turn."""
    return each_step(spark, d, snapshot, lambda a, b: incremental.orphaned_targets(a, b).select(joined("labels").alias("labels")))


def change_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters of each year against the one before; the first against nothing."""
    years = order_years(spark, d)
    made = materialise(models.summarize(yearly(spark, d, years), CONFIG, BY), "summaries")
    kinds = materialise(summary.kinds(made, BY), "kinds")
    vertices = materialise(summary.vertices_of(kinds, BY), "vertices")
    result, kinds, vertices = (steps(x, years, first=True) for x in (made, kinds, vertices))
    return incremental.change_counters(*result, BY, kinds, vertices)


def delta_apply(spark: SparkSession, d: str) -> DataFrame:
    return each_step(spark, d, year_quads, lambda a, b: incremental.apply_delta(a, b.exceptAll(a), a.exceptAll(b)))


def delta_touched(spark: SparkSession, d: str) -> DataFrame:
    return each_step(spark, d, year_quads, lambda a, b: incremental.touched(b.exceptAll(a), a.exceptAll(b), a.unionByName(b), SIGNAL))


def incremental_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """Differences between the summary kept by each yearly delta and one computed afresh: none."""
    years = order_years(spark, d)
    quads = materialise(yearly(spark, d, years), "quads")
    batch = materialise(models.summarize(quads, CONFIG, BY), "summaries")
    (a, b), (past, now) = steps(quads, years), steps(batch, years)
    change = materialise(incremental.delta(a, b, BY), "delta")
    kept, _ = incremental.update(past, a, change.filter("op = 'add'"), change.filter("op = 'remove'"), CONFIG, BY, materialise)
    discard(quads, change)
    later = spark.range(years.start + 1, max(years.stop, years.start + 1)).select(F.col("id").cast("int").alias("year"))
    return later.join(summary.same_summaries(kept, now, BY), "year", "left").select("year", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("only_a", "only_b", "different")])


def index_by_element(spark: SparkSession, d: str) -> DataFrame:
    """The reverse index of the imprint table: instances of each schema element per snapshot, latest row of a vertex."""
    rows = table(spark, d, "imprint").filter("snapshot is not null and _id is not null")
    latest = rows.groupBy("snapshot", "_id").agg(F.max(F.struct("_timestamp", "_schemaelementid")).getField("_schemaelementid").alias("element"))
    return latest.groupBy("snapshot", "element").agg(F.count("*").alias("instances"))


# citations and logs


def citation_quads(spark: SparkSession, d: str) -> DataFrame:
    return citations.paper_quads(table(spark, d, "papers")).select("s", "p", "o")


def citation_lines(spark: SparkSession, d: str) -> DataFrame:
    return citations.paper_quads(table(spark, d, "papers")).select(citations.quad_line().alias("line"))


def entities_per_year(spark: SparkSession, d: str) -> DataFrame:
    return citations.papers_per_year(table(spark, d, "papers"))


def cumulative_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The quads of each year and all years before it; year is the one a quad comes from."""
    return citations.cumulative(citations.paper_quads(table(spark, d, "papers"), year_column=True), "year")


def citation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the papers' own graph under the complex model, with their sizes."""
    s = models.summarize(citations.paper_quads(table(spark, d, "papers")), CONFIG)
    return summary.primary(s).select(joined("labels").alias("labels"), neighbor_text("neighbors").alias("neighbors"), "instances")


def _log(spark: SparkSession) -> DataFrame:
    """A log of two iterations and a batch, written to the shared folder."""
    def event(kind: str, **more) -> str:
        return json.dumps({"Event": f"SparkListener{kind}"} | more)

    logs = []
    for name, base in (("demo0", 0), ("demo1", 1000), ("demo_batch_0", 2000)):
        lines = [event("EnvironmentUpdate", **{"Spark Properties": {"spark.app.name": name}})]
        for i in range(7):
            lines.append(event("StageCompleted", **{"Stage Info": {"Stage ID": i, "Submission Time": base + 10 * i, "Completion Time": base + 10 * i + i + 1}}))
        lines += [event("JobStart", **{"Submission Time": base + 5}), event("JobEnd", **{"Completion Time": base + 95})]
        logs.append((name, "\n".join(lines)))
    at = work_path(spark, "events")
    spark.createDataFrame(logs, "name string, value string").repartition(3, "name").write.partitionBy("name").text(at)
    return eventlog.read_eventlog(spark, os.path.join(at, "*"))


def eventlog_phases(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.phase_times(_log(spark), "demo")


def eventlog_intervals(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.job_intervals(_log(spark), "demo")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    quads_from_tables, nquad_format_parse, malformed_filter, term_normalize, file_lines, delta_scan, vertex_labels, vertex_labels_all_signal, edges_directed, edges_undirected, literal_filter, triplets, graph_vertices,
    subject_bundles, subject_bundle_edges, class_collection, class_collection_undirected, attribute_collection, attribute_collection_undirected, complex_collection, complex_collection_undirected, complex_collection_all_neighbors, k_bisimulation,
    summary_vertices, summary_edges, secondary_summaries, summary_payload, summary_instances, imprints, completeness_counts, index_information, summary_counts, ntriples_export, vertex_summary_mapping, summary_edge_hash, vertex_hash,
    degree_distribution, degree_statistics, unknown_subject_edges, known_subject_edges, snapshot_diff, neighbor_changes, payload_diff, stale_imprints, deleted_summaries, orphans, change_counters, delta_apply, delta_touched,
    incremental_equals_batch, index_by_element, citation_quads, citation_lines, entities_per_year, cumulative_snapshots, citation_summary, eventlog_phases, eventlog_intervals)}
