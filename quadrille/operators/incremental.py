"""Snapshots against one another: what each vertex did, the change counters, and deltas. ``by``: columns that tell several graphs of one frame apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .graph import class_edge, plain_edge
from .models import summarize
from .summary import kinds, payload_of, vertices_of

EMPTY = "array<string>"


def diff(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """One row per vertex of two imprint tables: status new, deleted, changed or same, and both sides' columns.

    ``neighbor_only``: changed, though labels and properties are equal (a target's labels changed).
    """
    p = prev.select("v", F.col("sig").alias("sig_p"), F.col("labels").alias("labels_p"), F.col("props").alias("props_p"), F.col("payload").alias("payload_p"))
    c = curr.select("v", F.col("sig").alias("sig_c"), F.col("labels").alias("labels_c"), F.col("props").alias("props_c"), F.col("payload").alias("payload_c"))
    both = p.join(c, "v", "full_outer")
    status = F.when(F.col("sig_p").isNull(), "new").when(F.col("sig_c").isNull(), "deleted").when(F.col("sig_p") != F.col("sig_c"), "changed").otherwise("same")
    none = F.array().cast(EMPTY)
    return (
        both.withColumn("status", status)
        .withColumn("neighbor_only", (F.col("status") == "changed") & (F.col("labels_p") == F.col("labels_c")) & (F.col("props_p") == F.col("props_c")))
        .withColumn("payload_added", F.size(F.array_except(F.coalesce("payload_c", none), F.coalesce("payload_p", none))).cast("bigint"))
        .withColumn("payload_removed", F.when(F.col("status") == "deleted", 0).otherwise(F.size(F.array_except(F.coalesce("payload_p", none), F.coalesce("payload_c", none)))).cast("bigint"))
    )


def new_labels(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """v, added: labels that a vertex known before did not have then; vertices without any are left out."""
    was = prev.select("v", F.col("labels").alias("was"))
    added = F.array_except(F.coalesce("labels", F.array().cast(EMPTY)), F.coalesce("was", F.array().cast(EMPTY)))
    return curr.select("v", "labels").join(was, "v").select("v", added.alias("added")).filter(F.size("added") > 0)


def payload_update(state: DataFrame, change: DataFrame, mode: str) -> DataFrame:
    """v, payload, entries: the payload of each vertex of ``state`` after ``change`` (both v, payload), and by how many
    entries it changed. ``mode``: add and remove take the entries of the change for additions or removals alone, replace
    for the whole new set. Vertices that the change does not name stay as they are."""
    none = F.array().cast(EMPTY)
    both = state.select("v", F.coalesce("payload", none).alias("a")).join(change.select("v", F.coalesce("payload", none).alias("b")), "v", "left").withColumn("hit", F.col("b").isNotNull()).withColumn("b", F.coalesce("b", none))
    after = {"add": F.array_union("a", "b"), "remove": F.array_except("a", "b"), "replace": F.when(F.col("hit"), F.array_distinct("b")).otherwise(F.col("a"))}[mode]
    changed = F.size(F.array_except("a", "after")) + F.size(F.array_except("after", "a"))
    return both.withColumn("after", F.array_sort(after)).select("v", F.col("after").alias("payload"), changed.cast("bigint").alias("entries"))


def stale(prev: DataFrame, curr: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Imprints whose vertex is gone."""
    return prev.join(curr, [*by, "v"], "left_anti")


def deleted_summaries(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """sig of primary summaries without any instance left."""
    return prev.select("sig").distinct().join(curr.select("sig").distinct(), "sig", "left_anti")


def orphaned_targets(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """sig, labels of secondary summaries of prev (both: summaries of a model) that nothing points at any more and no vertex has."""
    return vertices_of(prev).filter("not is_primary").join(vertices_of(curr), "sig", "left_anti").select("sig", "labels")


def _summary_loss(prev: DataFrame, curr: DataFrame, hit: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """sig, lost: sources that a summary of ``hit`` (of which an instance was deleted, not moved) loses. prev, curr: sig, g."""
    before = prev.join(hit, [*by, "sig"], "left_semi")
    return before.join(curr, [*by, "sig", "g"], "left_anti").groupBy(*by, "sig").agg(F.count("*").alias("lost"))


def change_counters(prev: DataFrame, curr: DataFrame, by: tuple[str, ...] = (), kinds_of: tuple[DataFrame, DataFrame] | None = None, vertices: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row of counters between two results of a model (v, labels, neighbors, payload, sig); with ``by`` one for each
    graph that has a vertex. Vertices are joined once and summed up by the pair of their summaries; the rest is told from
    pairs and from ``kinds_of`` and ``vertices``, the kinds of both results and their summary vertices, where they are stored already.

    instancesNewWithKnownSchema is the real number; the compatible counter, always 0, has the
    suffix _compat. Payload losses of a summary are counted once per snapshot.
    """
    k, m = kinds_of or (kinds(prev, by), kinds(curr, by))
    none = F.array().cast(EMPTY)
    p = prev.select(*by, "v", F.col("sig").alias("sig_p"), F.col("payload").alias("a"))
    c = curr.select(*by, "v", F.col("sig").alias("sig_c"), F.col("payload").alias("b"))
    both = p.join(c, [*by, "v"], "full_outer").withColumn("a", F.coalesce("a", none)).withColumn("b", F.coalesce("b", none))
    gone = F.col("sig_c").isNull()
    both = both.select(*by, "sig_p", "sig_c", F.size(F.array_except("b", "a")).cast("bigint").alias("added"), F.when(gone, 0).otherwise(F.size(F.array_except("a", "b"))).cast("bigint").alias("removed"))
    pairs = both.groupBy(*by, "sig_p", "sig_c").agg(F.count("*").alias("n"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count_if(~gone & (F.col("added") + F.col("removed") > 0)).alias("elements"))
    pairs = materialise(pairs, "pairs")
    of = lambda kind, side: kind.select(*by, F.col("sig").alias(f"sig_{side}"), F.struct("labels", F.transform("neighbors", lambda x: x["p"]).alias("props")).alias(f"of_{side}")).distinct()
    a, b = vertices or (vertices_of(k, by), vertices_of(m, by))
    known = a.filter("is_primary").select(*by, F.col("sig").alias("sig_c"), F.lit(True).alias("known"))
    d = pairs.join(of(k, "p"), [*by, "sig_p"], "left").join(of(m, "c"), [*by, "sig_c"], "left").join(known, [*by, "sig_c"], "left")
    new, deleted, changed = F.col("sig_p").isNull(), F.col("sig_c").isNull(), F.col("sig_p").isNotNull() & F.col("sig_c").isNotNull() & (F.col("sig_p") != F.col("sig_c"))
    total = lambda which, x="n": F.coalesce(F.sum(F.when(which, F.col(x))), F.lit(0))
    every = F.lit(True)
    per_vertex = d.groupBy(*by).agg(
        total(changed).alias("instancesWithChangedSchema"),
        total(changed & (F.col("of_p") == F.col("of_c"))).alias("instancesChangedBecauseOfNeighbors"),
        total(F.col("sig_p") == F.col("sig_c")).alias("instancesNotChanged"),
        total(new).alias("instancesNew"),
        total(deleted).alias("instancesDeleted"),
        total(new & F.col("known")).alias("instancesNewWithKnownSchema"),
        F.lit(0).cast("bigint").alias("instancesNewWithKnownSchema_compat"),
        total(new | changed).alias("addedInstanceToSchemaLinks"),
        total(deleted | changed).alias("removedInstanceToSchemaLinks"),
        total(every, "elements").alias("elements"),
        total(every, "added").alias("payloadEntriesAdded"),
        total(every, "removed").alias("removed"),
    )
    hit = pairs.filter("sig_c is null").select(*by, F.col("sig_p").alias("sig")).distinct()
    loss = _summary_loss(payload_of(k, by), payload_of(m, by), hit, by).groupBy(*by).agg(F.count("*").alias("shrunk"), F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"))
    j = a.select(*by, "sig", F.col("is_primary").alias("pp")).join(b.select(*by, "sig", F.col("is_primary").alias("cp")), [*by, "sig"], "full_outer")
    per_summary = j.groupBy(*by).agg(
        F.count_if(F.col("cp") & F.coalesce(~F.col("pp"), F.lit(True))).alias("newSchemaStructureObserved"),
        F.count_if(F.col("pp") & F.coalesce(~F.col("cp"), F.lit(True))).alias("schemaStructureDeleted"),
        F.count_if(F.col("pp").isNull()).alias("schemaElementsAdded"),
        F.count_if(F.col("cp").isNull()).alias("schemaElementsDeleted"),
    )
    names = [*per_summary.columns[len(by):], *[x for x in per_vertex.columns[len(by):] if x not in ("elements", "removed")]]
    one = per_summary.unionByName(per_vertex, allowMissingColumns=True).unionByName(loss, allowMissingColumns=True)
    one = one.groupBy(*by).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in one.columns if x not in by])
    return one.select(*by, *names, (F.col("elements") + F.col("shrunk")).alias("payloadElementsChanged"), (F.col("removed") + F.col("lost")).alias("payloadEntriesRemoved"))


def delta(prev: DataFrame, curr: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """s, p, o, g, op: the quads that only one of two graphs has, each once; op is add or remove. One aggregation tells both."""
    cols = [*by, "s", "p", "o", "g"]
    both = prev.select(*cols, F.lit(1).alias("side")).unionByName(curr.select(*cols, F.lit(2).alias("side")))
    sides = both.groupBy(*cols).agg(F.min("side").alias("first"), F.max("side").alias("last")).filter("first = last")
    return sides.select(*cols, F.when(F.col("last") == 2, "add").otherwise("remove").alias("op"))


def apply_delta(state: DataFrame, additions: DataFrame, removals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The quads after a delta: (state and additions) without removals, each quad once. One aggregation does both."""
    cols = [*by, "s", "p", "o", "g"]
    held = state.select(*cols).unionByName(additions.select(*cols)).withColumn("gone", F.lit(0))
    every = held.unionByName(removals.select(*cols).withColumn("gone", F.lit(1)))
    return every.groupBy(*cols).agg(F.max("gone").alias("gone")).filter("gone = 0").select(*cols)


def touched(additions: DataFrame, removals: DataFrame, state: DataFrame, signal: str | None, by: tuple[str, ...] = ()) -> DataFrame:
    """v of the subjects a delta may change: its own subjects, and those that point at a vertex whose labels it changes."""
    delta = additions.select(*by, "s", "p", "o").unionByName(removals.select(*by, "s", "p", "o"))
    own = delta.select(*by, F.col("s").alias("v"))
    relabelled = delta.filter(class_edge(signal)).select(*by, F.col("s").alias("o")).distinct()
    pointing = state.join(relabelled, [*by, "o"], "left_semi").select(*by, F.col("s").alias("v"))
    return own.unionByName(pointing).distinct()


def update(prev: DataFrame, state: DataFrame, additions: DataFrame, removals: DataFrame, config, by: tuple[str, ...] = (), stored: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(summaries, quads) after a delta: only touched subjects are summarised again; the rest is kept.

    Equal to summarising the quads afresh. Both directions of edges count where undirected. ``stored`` may keep the
    quads and the touched subjects, which are used several times; then neither state nor delta is read again.
    """
    quads = stored(apply_delta(state, additions, removals, by), "after")
    hit = touched(additions, removals, state.filter(plain_edge(config.class_signal)), config.class_signal, by)
    if config.undirected:
        ends = additions.select(*by, F.col("o").alias("v")).unionByName(removals.select(*by, F.col("o").alias("v")))
        around = quads.join(hit.withColumnRenamed("v", "s"), [*by, "s"], "left_semi").select(*by, F.col("o").alias("v"))
        hit = stored(hit.unionByName(ends).unionByName(around).distinct(), "touched")
        part = quads.join(hit.withColumnRenamed("v", "s"), [*by, "s"], "left_semi").unionByName(quads.join(hit.withColumnRenamed("v", "o"), [*by, "o"], "left_semi"))
    else:
        hit = stored(hit, "touched")
        part = quads.join(hit.withColumnRenamed("v", "s"), [*by, "s"], "left_semi")
    targets = part.select(*by, F.explode(F.array("s", "o")).alias("s")).distinct()
    label_edges = quads.filter(class_edge(config.class_signal)).join(targets, [*by, "s"], "left_semi")
    again = summarize(part, config, by, label_edges)
    if config.undirected:  # else the part has no other subjects
        again = again.join(hit, [*by, "v"], "left_semi")
    kept = prev.join(hit, [*by, "v"], "left_anti")
    return kept.unionByName(again), quads
