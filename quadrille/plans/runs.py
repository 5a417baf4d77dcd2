"""Whole runs over a sequence of snapshots or deltas, and statistics of a folder."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SummaryConfig
from ..operators import graph, incremental, stats, summary
from ..operators.models import summarize
from ..runtime import materialise, work_path
from ..sinks import completeness, drop_version, folder_bytes, read_graph, read_store, versions, write_csv, write_graph, write_index, write_ntriples
from ..sources.nquads import discover, quads_from_lines, read_delta, read_nquads


class Phases:
    """Wall-clock milliseconds of a snapshot's phases."""

    def __init__(self) -> None:
        self.ms: dict[str, int] = {}
        self.began = time.monotonic()

    def end(self, phase: str) -> None:
        now = time.monotonic()
        self.ms[phase] = self.ms.get(phase, 0) + int(1000 * (now - self.began))
        self.began = now


#: Reading and summarising, then the times of index and graph apart.
PHASES = ["read", "summarize", "verify"]
TIMED = [f"{part}_{what}" for part in ("index", "graph") for what in ("read", "write", "delete")]


def time_and_space(spark: SparkSession, iteration: int, phases: Phases, now: DataFrame | None, state: str) -> DataFrame:
    """One row: iteration, ms of reading, writing and deleting the index and the graph, links from summaries to vertices,
    vertices in the index, and summaries in it, bytes and memory of the index, vertices and edges of the summary graph, its
    bytes; then the ms of the other phases. The index is read from Parquet, so its bytes stand for its memory. A
    dry run stores nothing, so its counts and bytes are 0."""
    ms = {p: phases.ms.get(p, 0) for p in [*TIMED, *PHASES]}
    counts = summary.counts(now).first() if now is not None else None
    version = f"snapshot={iteration}"
    sizes = [folder_bytes(spark, f"{state}/imprint/{version}"), sum(folder_bytes(spark, f"{state}/{n}/{version}") for n in ("summary_vertex", "summary_edge"))] if now is not None else [0, 0]
    links, primaries, vertices, edges = (counts.links, counts.primaries, counts.vertices, counts.edges) if counts else (0, 0, 0, 0)
    row = {"iteration": iteration, **{f"{t}_ms": ms[t] for t in TIMED[:3]}, "index_total_ms": sum(ms[t] for t in TIMED[:3]), "schema_links": primaries, "imprint_links": links, "links": links, "index_bytes": sizes[0], "index_memory_bytes": sizes[0],
           "schema_elements": vertices, "schema_relations": edges, "store_bytes": sum(sizes), "graph_bytes": sizes[1], **{f"{t}_ms": ms[t] for t in TIMED[3:]}, **{f"{p}_ms": ms[p] for p in PHASES}, "total_ms": sum(ms.values())}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} bigint" for n in row))


def run_snapshots(spark: SparkSession, config: SummaryConfig) -> DataFrame | None:
    """Runs the configured snapshots in order; returns the counters of the last.

    Each snapshot's state is a new version in the state folder; the change counters compare it
    with the version before. With ``delta``, the first input is a snapshot and each further one
    names a pair additions_<name>, removals_<name> beside it; the quads are kept in the state too. With ``resume``
    snapshots whose version is complete are passed over, and the first to run is compared with the version before it;
    so does a run that skips snapshots whose versions are there. An index version is written last, so a run that
    ended within a snapshot does it again.
    """
    state = config.state_dir or work_path(spark, "state")
    todo = config.snapshots()
    have = versions(spark, state) if config.state_dir and not config.dry_run else []
    if config.resume:
        todo = [(i, p) for i, p in todo if i > max(have, default=-1)]
    before: DataFrame | None = None
    quads: DataFrame | None = None
    if todo and todo[0][0] - 1 in have:
        before = read_store(spark, state, todo[0][0] - 1)
        if config.delta:
            quads = spark.read.parquet(f"{state}/quads/snapshot={todo[0][0] - 1}")
    counters = schema = None
    for i, path in todo:
        phases = Phases()
        if config.delta and before is not None and quads is not None:
            folder, _, name = path.rpartition("/")
            additions, removals = read_delta(spark, folder, name, config)
            now, quads = incremental.update(before, quads, additions, removals, config)
        else:
            quads = read_nquads(spark, path, config)
            now = None
        if config.delta and not config.dry_run:
            at = f"{state}/quads/snapshot={i}"
            quads.write.mode("overwrite").parquet(at)
            quads = spark.read.parquet(at)
        else:
            quads = materialise(quads, "quads")
        phases.end("read")
        now = materialise(summarize(quads, config) if now is None else now, "now")
        phases.end("summarize")
        if config.dry_run:
            before = now
            if config.report_dir:
                write_csv(time_and_space(spark, i, phases, None, state), f"{config.report_dir}/update-time-and-space", append=i > 0)
            continue
        kept = read_graph(spark, state, i - 1)[0].filter("not is_primary") if config.allow_orphans and before is not None else None
        write_graph(now, state, i, kept)
        phases.end("graph_write")
        write_index(now, state, i)
        phases.end("index_write")
        now = read_store(spark, state, i)
        if config.verify_against_batch:
            row = summary.same_summaries(now, summarize(quads, config)).first()
            if any(row):
                raise AssertionError(f"snapshot {i}: incremental and batch differ: {row.asDict()}")
        phases.end("verify")
        past = before if before is not None else now.limit(0)
        if config.track_changes:
            counters = materialise(incremental.change_counters(past, now), "counters")
        phases.end("index_read")
        if config.keep_versions:
            for old in versions(spark, state)[: -max(2, config.keep_versions)]:
                drop_version(spark, state, old)
            phases.end("index_delete")
        if config.report_dir:
            if counters is not None:
                write_csv(counters, f"{config.report_dir}/changes", append=i > 0)
            write_csv(time_and_space(spark, i, phases, now, state), f"{config.report_dir}/update-time-and-space", append=i > 0)
            if config.schema_stats:
                write_csv(completeness(now), f"{config.report_dir}/completeness-{i}")
                here = summary.index_information(now).withColumn("iteration", F.lit(i))
                schema = materialise(last_information(here if schema is None else schema.unionByName(here)), "schema")
        if config.export_dir:
            write_ntriples(now, f"{config.export_dir}/summary-{i}", config.base_uri, config.class_signal or "")
        before = now
    if schema is not None:
        write_csv(schema.drop("iteration"), f"{config.report_dir}/schema")
    return counters


def last_information(rows: DataFrame) -> DataFrame:
    """sig, types, properties, iteration: of each summary what the last iteration tells."""
    return rows.groupBy("sig").agg(F.max(F.struct("iteration", "types", "properties")).alias("m")).select("sig", "m.types", "m.properties", "m.iteration")


def folder_statistics(spark: SparkSession, folder: str, config: SummaryConfig = SummaryConfig(), report_dir: str | None = None) -> DataFrame:
    """file and degree statistics of the graph in each data file of a folder (as ``discover`` finds them), all files in
    one pass; ``report_dir`` gets them as one CSV."""
    lines = discover(spark, folder)
    quads = quads_from_lines(lines, config, keep=["file"])
    plain = quads.filter(graph.plain_edge(config.class_signal)).select("file", "s", "p", "o", "g")
    out = stats.degree_statistics(plain, "file")
    if report_dir:
        write_csv(out, f"{report_dir}/degree")
    return out
