import gzip
import random

import pytest
from conftest import rows

from quadrille.config import SummaryConfig
from quadrille.functions.hashing import edge_id, murmur3_string, summary_id
from quadrille.operators import graph, incremental, models, stats, summary
from quadrille.plans.runs import folder_statistics, run_snapshots
from quadrille.sinks import clear_store, edge_ids, edges_by_hash, mapping, read_graph, read_store, repeated_keys, summaries_by_hash, versions, vertex_hashes, yearly_graphs
from quadrille.sources.nquads import quads_from_lines, read_nquads
from quadrille.streaming.snapshots import follow

FIRST = """<tbl> <type> <Person> <http://one.example> .
<tbl> <name> "Nia Orr" <http://one.example> .
<tbl> <worksFor> <ZBW> <http://one.example> .
<tbl> <livesIn> "Quell" <http://one.example> .
<ZBW> <type> <Organisation> <http://one.example> .
<ZBW> <name> "Archive of Old Maps" <http://one.example> ."""
SECOND = """<tbl> <type> <Person> <http://two.example> .
<tbl> <name> "Nia Orr" <http://two.example> .
<tbl> <worksFor> <CAU> <http://two.example> .
<tbl> <livesIn> "Quell" <http://two.example> .
<CAU> <type> <Organisation> <http://two.example> .
<CAU> <name> "School of Tides" <http://two.example> ."""
SNAPSHOTS = [FIRST, FIRST + "\n" + SECOND, SECOND, SECOND.replace("<CAU> <type> <Organisation>", "<CAU> <type> <University>")]
CONFIG = SummaryConfig(class_signal="type")
# Counters of each snapshot against the one before.
GOLDEN = {
    0: {"schemaElementsAdded": 4, "schemaElementsDeleted": 0, "payloadElementsChanged": 2, "payloadEntriesAdded": 2, "payloadEntriesRemoved": 0, "instancesNew": 2, "instancesDeleted": 0, "addedInstanceToSchemaLinks": 2, "removedInstanceToSchemaLinks": 0},
    1: {"schemaElementsAdded": 0, "schemaElementsDeleted": 0, "payloadElementsChanged": 2, "payloadEntriesAdded": 2, "payloadEntriesRemoved": 0, "instancesNotChanged": 2, "instancesNew": 1, "instancesDeleted": 0, "addedInstanceToSchemaLinks": 1},
    2: {"schemaElementsAdded": 0, "schemaElementsDeleted": 0, "payloadElementsChanged": 2, "payloadEntriesAdded": 0, "payloadEntriesRemoved": 2, "instancesNotChanged": 2, "instancesNew": 0, "instancesDeleted": 1, "removedInstanceToSchemaLinks": 1},
    3: {"newSchemaStructureObserved": 2, "schemaStructureDeleted": 2, "schemaElementsAdded": 3, "schemaElementsDeleted": 3, "payloadElementsChanged": 0, "payloadEntriesAdded": 0, "payloadEntriesRemoved": 0, "instancesWithChangedSchema": 2,
        "instancesChangedBecauseOfNeighbors": 1, "instancesNotChanged": 0, "instancesNew": 0, "instancesDeleted": 0, "addedInstanceToSchemaLinks": 2, "removedInstanceToSchemaLinks": 2},
}


def quads(spark, text):
    return quads_from_lines(spark.createDataFrame([(x,) for x in text.split("\n")], "value string"), CONFIG)


def frame(spark, data):
    return spark.createDataFrame(data, "s string, p string, o string, g string")


@pytest.mark.parametrize("n", range(4))
def test_shape_and_counters(spark, n):
    now = models.summarize(quads(spark, SNAPSHOTS[n]), CONFIG)
    counts = summary.counts(now).first()
    assert (counts.vertices, counts.edges, counts.primaries) == (4, 4, 2)
    past = models.summarize(quads(spark, SNAPSHOTS[n - 1]), CONFIG) if n else now.limit(0)
    got = incremental.change_counters(past, now).first().asDict()
    assert {k: got[k] for k in GOLDEN[n]} == GOLDEN[n]


def test_models_on_the_first_snapshot(spark):
    q = quads(spark, FIRST)
    of = lambda **k: {r.v: r for r in models.summarize(q, SummaryConfig(class_signal="type", **k)).collect()}
    complex_ = of()
    assert complex_["tbl"].labels == ["person"] and [(n.p, n.t) for n in complex_["tbl"].neighbors] == [("livesin", []), ("name", []), ("worksfor", ["organisation"])]
    assert complex_["zbw"].payload == ["http://one.example"]
    assert [(r.labels, r.neighbors) for r in of(model="class-collection").values()] == [(["person"], []), (["organisation"], [])] or len(of(model="class-collection")) == 2
    attribute = of(model="attribute-collection")
    assert [n.p for n in attribute["zbw"].neighbors] == ["name"]
    both = of(model="attribute-collection", undirected=True)
    assert [n.p for n in both["zbw"].neighbors] == ["name", "worksfor"] and set(both) == {"tbl", "zbw"}
    assert {r.v for r in mapping(models.summarize(q, CONFIG)).selectExpr("summarized_vertex_hash as v").collect()} == {-1122452666, -2002205862}
    assert {r.primary_vertex_hash for r in mapping(models.summarize(q, CONFIG)).collect()} == {525623488, -906685405}
    assert vertex_hashes(graph.edges(q, "type")).count() == 2


def test_edge_ids(spark):
    got = {(r.primary_vertex_hash, r.property): r.edge_hash for r in edge_ids(models.summarize(quads(spark, FIRST), CONFIG)).collect()}
    person, organisation = summary_id(["person"], {"livesin": [], "name": [], "worksfor": ["organisation"]}), summary_id(["organisation"], {"name": []})
    assert set(got) == {(person, "livesin"), (person, "name"), (person, "worksfor"), (organisation, "name")}
    assert all(h == edge_id(s, p) == murmur3_string(str(s) + p) for (s, p), h in got.items()) and len(set(got.values())) == 4


def test_bundles_hold_their_edges(spark):
    e = frame(spark, [("a", "p", "b", "g"), ("a", "p", "b", "g"), ("a", "q", "c", None), ("b", "p", "c", "h")])
    got = graph.subject_bundles(e).select("s", "p", "o", "g", "n").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", "p", "b", "g", 2), ("a", "q", "c", None, 2), ("b", "p", "c", "h", 1)]))


def test_signals(spark):
    q = quads(spark, FIRST)
    assert graph.labels(q, None).count() == 0 and graph.edges(q, None).count() == 6
    assert graph.edges(q, "*").count() == 6 and {r.v: len(r.labels) for r in graph.labels(q, "*").collect()} == {"tbl": 4, "zbw": 2}
    assert graph.edges(q, "type").count() == 4 and graph.edges(q, "type", True).count() == 5


def test_only_type_edges_is_no_summary(spark):
    assert models.summarize(frame(spark, [("a", "type", "x", "g")]), CONFIG).count() == 0


@pytest.mark.parametrize("model", list(models.MODELS))
def test_empty_nulls_and_extra_columns(spark, model):
    c = SummaryConfig(class_signal="type", model=model)
    assert models.summarize(frame(spark, []), c).count() == 0
    data = [("a", "p", "b", None), ("a", "p", None, "g"), (None, "p", "b", "g"), ("a", "type", "x", "g"), ("b", "type", "y", "g")]
    df = frame(spark, data).selectExpr("*", "1 as v", "'q' as labels", "2 as sig", "3 as __salt")
    got = models.summarize(df, c).collect()
    assert [(r.v, r.payload) for r in got] == [("a", [])]


def test_multiple_targets_do_not_depend_on_order(spark):
    data = [("a", "p", "b", "g"), ("a", "p", "c", "g"), ("b", "type", "y", "g"), ("c", "type", "x", "g")]
    for d in (data, data[::-1]):
        assert [[(n.p, n.t) for n in r.neighbors] for r in models.summarize(frame(spark, d), CONFIG).collect()] == [[("p", ["x"])]]
    every = models.summarize(frame(spark, data), SummaryConfig(class_signal="type", neighbor_mode="all")).first()
    assert [(n.p, n.t) for n in every.neighbors] == [("p", ["x"]), ("p", ["y"])]


def test_hot_object_and_subject(spark):
    data = [(f"s{i}", "p", "hub", "g") for i in range(3000)] + [("hub", f"q{i % 7}", f"s{i}", "g") for i in range(3000)] + [("hub", "type", "h", "g")]
    got = models.summarize(frame(spark, data), CONFIG)
    assert got.count() == 3001
    assert rows(summary.primary(got).select("instances")) == [(1,), (3000,)]


def random_quads(rng, n):
    return list({(f"v{rng.randint(0, 12)}", rng.choice(["type", "type", "p", "q"]), rng.choice([f"v{rng.randint(0, 12)}", f"c{rng.randint(0, 3)}", '"x"']), f"g{rng.randint(0, 2)}") for _ in range(n)})


@pytest.mark.parametrize("seed,undirected,model", [(1, False, "complex-attribute_class-collection"), (2, True, "complex-attribute_class-collection"), (3, False, "class-collection"), (4, True, "attribute-collection")])
def test_delta_equals_batch(spark, seed, undirected, model):
    rng = random.Random(seed)
    c = SummaryConfig(class_signal="type", undirected=undirected, model=model)
    old = random_quads(rng, 60)
    gone = rng.sample(old, 8)
    new = [x for x in random_quads(rng, 8) if x not in old]
    prev = models.summarize(frame(spark, old), c)
    kept, state = incremental.update(prev, frame(spark, old), frame(spark, new), frame(spark, gone), c)
    batch = models.summarize(frame(spark, [x for x in old + new if x not in gone]), c)
    assert rows(summary.same_summaries(kept, batch)) == [(0, 0, 0)]
    assert sorted(tuple(r) for r in state.select("s", "p", "o", "g").collect()) == sorted(set(old + new) - set(gone))


def test_degrees(spark):
    e = frame(spark, [("a", "p", "b", "g"), ("a", "p", "c", "g"), ("b", "p", "c", "g")])
    assert rows(stats.degrees(e)) == [("a", 2, 0, 2), ("b", 2, 1, 1), ("c", 2, 2, 0)]
    s = stats.degree_statistics(e).first()
    assert (s.num_edges, s.num_vertices, s.avg_degree_new, s.max_indegree, s.avg_outdegree) == (3, 3, 1, 2, 1.5)


def test_k_steps_refine(spark):
    q = frame(spark, [("a", "p", "b", "g"), ("b", "p", "c", "g"), ("x", "p", "y", "g"), ("c", "type", "t", "g")])
    e, la = graph.edges(q, "type"), graph.labels(q, "type")
    sizes = [models.k_collection(e, la, k).select("block").distinct().count() for k in (0, 1, 2)]
    assert sizes == [1, 2, 3]


def test_ntriples(spark):
    lines = [r.line for r in summary.ntriples(models.summarize(quads(spark, FIRST), CONFIG), "http://n", "type").collect()]
    assert len(lines) == 4 + 4 and sum("http://n#UnTyped" in x for x in lines) == 1 and all(x.endswith(" .") for x in lines)


def write(folder, n, text):
    (folder / f"s{n}.nq").write_text(text + "\n")
    return str(folder / f"s{n}.nq")


def test_run_and_store(spark, tmp_path):
    paths = tuple(write(tmp_path, i, s) for i, s in enumerate(SNAPSHOTS))
    c = SummaryConfig(class_signal="type", inputs=paths, state_dir=str(tmp_path / "state"), report_dir=str(tmp_path / "reports"), export_dir=str(tmp_path / "export"), verify_against_batch=True, schema_stats=True)
    got = run_snapshots(spark, c).first().asDict()
    assert {k: got[k] for k in GOLDEN[3]} == GOLDEN[3]
    assert read_store(spark, c.state_dir, 1).count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "reports/changes")).count() == 4
    assert read_nquads(spark, paths[1], c).count() == 12
    spent = spark.read.option("header", True).csv(str(tmp_path / "reports/update-time-and-space")).filter("iteration = 3").first()
    assert (spent.links, spent.schema_elements, spent.schema_relations) == ("2", "4", "4") and int(spent.index_bytes) > 0


def test_delta_run_equals_snapshots(spark, tmp_path):
    paths = [write(tmp_path, 0, SNAPSHOTS[0])]
    for i in (1, 2, 3):
        a, b = SNAPSHOTS[i - 1].split("\n"), SNAPSHOTS[i].split("\n")
        for prefix, part in (("additions", [x for x in b if x not in a]), ("removals", [x for x in a if x not in b])):
            if part:
                (tmp_path / f"{prefix}_d{i}.nq").write_text("\n".join(part) + "\n")
        paths.append(str(tmp_path / f"d{i}.nq"))
    c = SummaryConfig(class_signal="type", inputs=tuple(paths), delta=True, state_dir=str(tmp_path / "state"), verify_against_batch=True)
    got = run_snapshots(spark, c).first().asDict()
    assert {k: got[k] for k in GOLDEN[3]} == GOLDEN[3]


def test_dry_run_stores_nothing(spark, tmp_path):
    c = SummaryConfig(class_signal="type", inputs=(write(tmp_path, 0, FIRST),), dry_run=True, state_dir=str(tmp_path / "state"), report_dir=str(tmp_path / "reports"))
    assert run_snapshots(spark, c) is None and not (tmp_path / "state").exists()
    assert spark.read.option("header", True).csv(str(tmp_path / "reports/update-time-and-space")).first().links == "0"


def test_stream_of_snapshots(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    import os
    import time

    for i, s in enumerate(SNAPSHOTS[:3]):
        p = write(source, i, s)
        os.utime(p, (time.time() - 100 + 10 * i,) * 2)
    follow(spark, str(source), str(tmp_path / "state"), str(tmp_path / "checkpoint"), CONFIG, str(tmp_path / "reports")).awaitTermination()
    assert {r.v for r in read_store(spark, str(tmp_path / "state"), 2).collect()} == {"tbl", "cau"}
    got = spark.read.option("header", True).csv(str(tmp_path / "reports/changes-2")).first()
    assert got.instancesDeleted == "1"


def test_yearly_graphs(spark, tmp_path):
    q = frame(spark, [("a", "p", '"x \\" y"', "g"), ("a", "q", "b", "g")]).selectExpr("2001 as year", "*")
    yearly_graphs(q, str(tmp_path / "y"))
    assert quads_from_lines(spark.read.text(str(tmp_path / "y/year=2001"))).count() == 2


def test_run_goes_on_after_its_end(spark, tmp_path):
    paths = tuple(write(tmp_path, i, s) for i, s in enumerate(SNAPSHOTS))
    state = str(tmp_path / "state")
    run_snapshots(spark, SummaryConfig(class_signal="type", inputs=paths, state_dir=state, end_early=2))
    got = run_snapshots(spark, SummaryConfig(class_signal="type", inputs=paths, state_dir=state, resume=True)).first().asDict()
    assert {k: got[k] for k in GOLDEN[3]} == GOLDEN[3] and versions(spark, state) == [0, 1, 2, 3]
    again = run_snapshots(spark, SummaryConfig(class_signal="type", inputs=paths, state_dir=state, skip_snapshots=2, end_early=2)).first().asDict()
    assert {k: again[k] for k in GOLDEN[2]} == GOLDEN[2]
    assert run_snapshots(spark, SummaryConfig(class_signal="type", inputs=paths, state_dir=state, resume=True)) is None


def test_delta_run_goes_on(spark, tmp_path):
    first = write(tmp_path, 0, SNAPSHOTS[0])
    a, b = SNAPSHOTS[0].split("\n"), SNAPSHOTS[1].split("\n")
    (tmp_path / "additions_d1.nq").write_text("\n".join(x for x in b if x not in a) + "\n")
    c = {"class_signal": "type", "inputs": (first, str(tmp_path / "d1.nq")), "delta": True, "state_dir": str(tmp_path / "state"), "verify_against_batch": True}
    run_snapshots(spark, SummaryConfig(**c, end_early=0))
    got = run_snapshots(spark, SummaryConfig(**c, resume=True)).first().asDict()
    assert {k: got[k] for k in GOLDEN[1]} == GOLDEN[1]


def test_versions_and_orphans_kept(spark, tmp_path):
    paths = tuple(write(tmp_path, i, s) for i, s in enumerate([FIRST, FIRST.replace("<ZBW> <type> <Organisation>", "<ZBW> <type> <Shop>"), FIRST]))
    for allowed, want in ((False, 4), (True, 5)):
        state = str(tmp_path / f"state{allowed}")
        run_snapshots(spark, SummaryConfig(class_signal="type", inputs=paths, state_dir=state, keep_versions=2, allow_orphans=allowed))
        assert versions(spark, state) == [1, 2]
        v, e = read_graph(spark, state, 1)
        assert v.count() == want and e.count() == 4 and repeated_keys(v).count() == 0
    clear_store(spark, state)
    assert versions(spark, state) == []


def test_last_information_stands(spark, tmp_path):
    paths = tuple(write(tmp_path, i, s) for i, s in enumerate([FIRST, SNAPSHOTS[3]]))
    run_snapshots(spark, SummaryConfig(class_signal="type", inputs=paths, report_dir=str(tmp_path / "r"), schema_stats=True))
    got = spark.read.option("header", True).csv(str(tmp_path / "r/schema"))
    assert got.count() == got.select("sig").distinct().count() == 7


def test_lookup_by_hash(spark):
    s = models.summarize(quads(spark, FIRST), CONFIG)
    every = edge_ids(s)
    one = every.filter("property = 'worksfor'")
    assert rows(edges_by_hash(s, one).select("property")) == [("worksfor",)]
    found = summaries_by_hash(s, one).collect()
    assert [(r.labels, r.instances) for r in found] == [(["person"], 1)] and summaries_by_hash(s, one.limit(0)).count() == 0


def test_new_labels_and_payload(spark):
    a = spark.createDataFrame([("x", ["p"]), ("y", ["p"]), ("z", None)], "v string, labels array<string>")
    b = spark.createDataFrame([("x", ["p", "q"]), ("y", []), ("z", ["r"]), ("n", ["p"])], "v string, labels array<string>")
    assert rows(incremental.new_labels(a, b)) == [("x", ["q"]), ("z", ["r"])]
    s = spark.createDataFrame([("x", ["a", "b"]), ("y", None), ("z", ["a"])], "v string, payload array<string>")
    d = spark.createDataFrame([("x", ["b", "c"]), ("y", ["a"])], "v string, payload array<string>")
    assert rows(incremental.payload_update(s, d, "add")) == [("x", ["a", "b", "c"], 1), ("y", ["a"], 1), ("z", ["a"], 0)]
    assert rows(incremental.payload_update(s, d, "remove")) == [("x", ["a"], 1), ("y", [], 0), ("z", ["a"], 0)]
    assert rows(incremental.payload_update(s, d, "replace")) == [("x", ["b", "c"], 2), ("y", ["a"], 1), ("z", ["a"], 0)]


def test_literal_subjects(spark):
    q = frame(spark, [("a", "p", '"t"', "g")])
    of = lambda x: {r.v for r in models.summarize(q, SummaryConfig(undirected=True, literal_subjects=x)).collect()}
    assert of(False) == {"a"} and of(True) == {"a", '"t"'}


def test_folder_statistics(spark, tmp_path):
    folder = tmp_path / "crawl"
    (folder / "week1").mkdir(parents=True)
    for name, text in (("a-data.nq.gz", FIRST), ("week1/data.nq.gz", SNAPSHOTS[1]), ("other.gz", FIRST)):
        with gzip.open(folder / name, "wt") as f:
            f.write(text + "\n")
    got = {r.file.rsplit("/", 1)[1]: r for r in folder_statistics(spark, str(folder), CONFIG, str(tmp_path / "r")).collect()}
    assert (got["a-data.nq.gz"].num_edges, got["data.nq.gz"].num_edges, len(got)) == (4, 8, 2)
    assert spark.read.option("header", True).csv(str(tmp_path / "r/degree")).count() == 2
