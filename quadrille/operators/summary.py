"""The summary graph: its vertices, edges and payload, and the index from vertices to it. ``by``: columns that tell several graphs of one frame apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import NEIGHBOR, signature


def secondary_signature(label: Column) -> Column:
    """The sig of a summary that has labels and no neighbours."""
    return signature(label, F.array().cast(NEIGHBOR))


def primary(summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """sig, labels, neighbors, instances: one row for each distinct summary of a vertex."""
    return summaries.groupBy(*by, "sig").agg(F.first("labels").alias("labels"), F.first("neighbors").alias("neighbors"), F.count("*").alias("instances"))


def edges_of(summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """src_sig, property, dst_sig, dst_labels of the summary graph."""
    return (
        primary(summaries, by).select(*by, "sig", F.explode("neighbors").alias("n"))
        .select(*by, F.col("sig").alias("src_sig"), F.col("n.p").alias("property"), secondary_signature(F.col("n.t")).alias("dst_sig"), F.col("n.t").alias("dst_labels"))
    )


def secondary(summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """sig, labels of summaries that are targets; some may be primary too."""
    return edges_of(summaries, by).select(*by, F.col("dst_sig").alias("sig"), F.col("dst_labels").alias("labels")).dropDuplicates([*by, "sig"])


def vertices_of(summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """sig, labels, is_primary: primary summaries and the targets that are not."""
    a = primary(summaries, by).select(*by, "sig", "labels", F.lit(True).alias("is_primary"))
    b = secondary(summaries, by).select(*by, "sig", "labels", F.lit(False).alias("is_primary"))
    return a.unionByName(b.join(a, [*by, "sig"], "left_anti"))


def kinds(summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """sig, labels, neighbors, payload: the distinct summaries with each payload that instances have. Vertices, edges and
    payload of the summary graph can be told from these rows as from the summaries, which are many more."""
    return summaries.select(*by, "sig", "labels", "neighbors", "payload").distinct()


def payload_of(summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """sig, g: the distinct sources of each summary, as rows, so that no summary is a huge array."""
    return summaries.select(*by, "sig", F.explode("payload").alias("g")).distinct()


def imprints(summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """v, sig, labels, props, payload: the index from vertices to their summary."""
    return summaries.select(*by, "v", "sig", "labels", F.transform("neighbors", lambda n: n["p"]).alias("props"), "payload")


def index_information(summaries: DataFrame) -> DataFrame:
    """sig, types, properties: numbers of labels and outgoing edges of every summary vertex."""
    out = edges_of(summaries).groupBy(F.col("src_sig").alias("sig")).agg(F.count("*").alias("properties"))
    return vertices_of(summaries).join(out, "sig", "left").select("sig", F.size("labels").cast("bigint").alias("types"), F.coalesce("properties", F.lit(0)).alias("properties"))


def counts(summaries: DataFrame) -> DataFrame:
    """vertices, edges, primaries, links: one row."""
    v = vertices_of(summaries).agg(F.count("*").alias("vertices"), F.count_if("is_primary").alias("primaries"))
    e = edges_of(summaries).agg(F.count("*").alias("edges"))
    n = summaries.agg(F.count("*").alias("links"))
    one = v.unionByName(e, allowMissingColumns=True).unionByName(n, allowMissingColumns=True)
    return one.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("vertices", "edges", "primaries", "links")])


def ntriples(summaries: DataFrame, namespace: str, class_signal: str) -> DataFrame:
    """line: one triple for each outgoing edge and each label of every summary vertex; UnTyped where there is none.

    The namespace gets a "#" if it ends with neither "/" nor "#". A summary's local name is the
    MD5 of its sig.
    """
    if namespace and namespace[-1] not in "/#":
        namespace += "#"

    def uri(sig: str) -> Column:
        return F.concat(F.lit("<" + namespace), F.md5(F.col(sig)), F.lit(">"))

    kinds = F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit(namespace + "UnTyped")))
    types = vertices_of(summaries).select(uri("sig").alias("subject"), F.explode(kinds).alias("kind"))
    types = types.select(F.concat("subject", F.lit(f" <{class_signal}> <"), "kind", F.lit("> .")).alias("line"))
    links = edges_of(summaries).select(F.concat(uri("src_sig"), F.lit(" <"), "property", F.lit("> "), uri("dst_sig"), F.lit(" .")).alias("line"))
    return types.unionByName(links)


def same_summaries(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """only_a, only_b, different: vertices of two results that lack a partner or differ in sig or payload; one row, with ``by`` one for each graph that has a vertex."""
    x = a.select(*by, "v", F.col("sig").alias("sa"), F.col("payload").alias("pa"))
    y = b.select(*by, "v", F.col("sig").alias("sb"), F.col("payload").alias("pb"))
    j = x.join(y, [*by, "v"], "full_outer")
    both = F.col("sa").isNotNull() & F.col("sb").isNotNull()
    return j.groupBy(*by).agg(F.count_if(F.col("sb").isNull()).alias("only_a"), F.count_if(F.col("sa").isNull()).alias("only_b"), F.count_if(both & ((F.col("sa") != F.col("sb")) | (F.col("pa") != F.col("pb")))).alias("different"))

