"""Degrees of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(edge: DataFrame, *groups: str) -> DataFrame:
    """(groups,) v, degree, in_degree, out_degree of every endpoint (never 0 in all)."""
    ends = edge.select(*groups, F.explode(F.array(F.struct(F.col("s").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("o").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(*groups, "e.v").agg(F.count("*").alias("degree"), F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def degree_statistics(edge: DataFrame, *groups: str) -> DataFrame:
    """Mean, population deviation and greatest of each degree over vertices that have it, numbers of edges and
    vertices, and edges per vertex as integer and real; one row, or one for each value of ``groups``, graphs of their own."""
    d = degrees(edge, *groups)
    out = []
    for c, short in (("degree", "degree"), ("in_degree", "indegree"), ("out_degree", "outdegree")):
        x = F.when(F.col(c) > 0, F.col(c))
        out += [F.avg(x).alias(f"avg_{short}"), F.stddev_pop(x).alias(f"std_{short}"), F.max(x).alias(f"max_{short}")]
    row = d.groupBy(*groups).agg(*out, F.sum("out_degree").alias("num_edges"), F.count("*").alias("num_vertices"))
    return row.withColumn("avg_degree_new", F.expr("num_edges div num_vertices")).withColumn("avg_degree_real", F.col("num_edges") / F.col("num_vertices"))
