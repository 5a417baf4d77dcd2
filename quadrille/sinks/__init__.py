"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import ref_hash, ref_summary_id
from ..operators import summary
from ..runtime import remove_path
from ..sources.citations import quad_line


#: Parts of the store.
STORE = ("summary_vertex", "summary_edge", "imprint")


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def mapping(summaries: DataFrame) -> DataFrame:
    """primary_vertex_hash, summarized_vertex_hash: the index from summaries to vertices as hashes.

    Ids are computed once per distinct summary and joined back.
    """
    t = F.transform("neighbors", lambda n: n["t"])
    p = F.transform("neighbors", lambda n: n["p"])
    ids = summary.primary(summaries).select("sig", ref_summary_id("labels", p, t).alias("primary_vertex_hash"))
    return summaries.select("v", "sig").join(ids, "sig").select("primary_vertex_hash", ref_hash("v").alias("summarized_vertex_hash"))


def edge_ids(summaries: DataFrame) -> DataFrame:
    """primary_vertex_hash, property, edge_hash: one row for each outgoing edge of a distinct summary."""
    t = F.transform("neighbors", lambda n: n["t"])
    p = F.transform("neighbors", lambda n: n["p"])
    ids = summary.primary(summaries).select(ref_summary_id("labels", p, t).alias("primary_vertex_hash"), F.explode(p).alias("property"))
    return ids.withColumn("edge_hash", ref_hash(F.concat(F.col("primary_vertex_hash").cast("string"), "property")))


def vertex_hashes(edge: DataFrame) -> DataFrame:
    """vertex, hash of the distinct subjects."""
    return edge.select(F.col("s").alias("vertex")).distinct().select("vertex", ref_hash("vertex").alias("hash"))


def write_ntriples(summaries: DataFrame, path: str, namespace: str, class_signal: str) -> int:
    """Writes the summary graph; returns the number of triples."""
    lines = summary.ntriples(summaries, namespace, class_signal)
    lines.write.mode("overwrite").text(path)
    return summaries.sparkSession.read.text(path).count()


def completeness(summaries: DataFrame) -> DataFrame:
    """schema, instances: how many vertices each summary has."""
    return summary.primary(summaries).select(F.md5("sig").alias("schema"), "instances")


def write_index(summaries: DataFrame, path: str, snapshot: int) -> None:
    """The imprints of one snapshot, as a new version."""
    summaries.write.mode("overwrite").parquet(f"{path}/imprint/snapshot={snapshot}")


def write_graph(summaries: DataFrame, path: str, snapshot: int, kept: DataFrame | None = None) -> None:
    """summary_vertex and summary_edge of one snapshot; ``kept``: vertices (sig, labels) that stay without an edge."""
    at = f"snapshot={snapshot}"
    v = summary.vertices_of(summaries)
    if kept is not None:
        v = v.unionByName(kept.select("sig", "labels", F.lit(False).alias("is_primary")).join(v, "sig", "left_anti"))
    v.write.mode("overwrite").parquet(f"{path}/summary_vertex/{at}")
    summary.edges_of(summaries).write.mode("overwrite").parquet(f"{path}/summary_edge/{at}")


def write_store(summaries: DataFrame, path: str, snapshot: int) -> None:
    """summary_vertex, summary_edge and imprint of one snapshot, as new versions beside the older ones."""
    write_graph(summaries, path, snapshot)
    write_index(summaries, path, snapshot)


def clear_store(spark: SparkSession, path: str) -> None:
    """Deletes all versions."""
    for name in (*STORE, "quads"):
        remove_path(spark, f"{path}/{name}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots whose state is complete in the store, in order; the index is written last."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/imprint")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(x.getPath()) for x in fs.listStatus(p)] if fs.exists(p) else []
    done = [x for x in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))]
    return sorted(int(x.rsplit("=", 1)[1]) for x in done if "snapshot=" in x)


def read_graph(spark: SparkSession, path: str, snapshot: int) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the summary graph of a snapshot: sig, labels, is_primary and src_sig, property, dst_sig, dst_labels."""
    return spark.read.parquet(f"{path}/summary_vertex/snapshot={snapshot}"), spark.read.parquet(f"{path}/summary_edge/snapshot={snapshot}")


def repeated_keys(vertices: DataFrame) -> DataFrame:
    """sig of summary vertices that are stored more than once: none in a sound store."""
    return vertices.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1").select("sig")


def summaries_by_hash(summaries: DataFrame, hashes: DataFrame) -> DataFrame:
    """primary_vertex_hash, sig, labels, neighbors, instances of the summaries with the hashes asked for
    (primary_vertex_hash). Several summaries may share a hash; all are given."""
    t, p = F.transform("neighbors", lambda n: n["t"]), F.transform("neighbors", lambda n: n["p"])
    known = summary.primary(summaries).withColumn("primary_vertex_hash", ref_summary_id("labels", p, t))
    return known.join(hashes.select("primary_vertex_hash").distinct(), "primary_vertex_hash", "left_semi").select("primary_vertex_hash", "sig", "labels", "neighbors", "instances")


def edges_by_hash(summaries: DataFrame, hashes: DataFrame) -> DataFrame:
    """edge_hash, primary_vertex_hash, property of the summary edges with the hashes asked for (edge_hash)."""
    return edge_ids(summaries).join(hashes.select("edge_hash").distinct(), "edge_hash", "left_semi").select("edge_hash", "primary_vertex_hash", "property").distinct()


def read_store(spark: SparkSession, path: str, snapshot: int) -> DataFrame:
    """The summaries of a snapshot (v, labels, neighbors, payload, sig)."""
    return spark.read.parquet(f"{path}/imprint/snapshot={snapshot}")


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path; 0 if it is missing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def drop_version(spark: SparkSession, path: str, snapshot: int) -> None:
    for name in STORE:
        remove_path(spark, f"{path}/{name}/snapshot={snapshot}")


def yearly_graphs(quads: DataFrame, path: str) -> None:
    """N-Quads text per year: quads has the columns year, s, p, o, g."""
    quads.filter("year is not null").select("year", quad_line().alias("value")).write.mode("overwrite").partitionBy("year").text(path)
