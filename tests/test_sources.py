import gzip
import json

from conftest import rows

from quadrille.config import SummaryConfig
from quadrille.sources import citations, eventlog, nquads
from quadrille.sources.tables import table_quads


def test_tagged_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#*First title\n#@A Bee, C Dee\n#t1999\n#cVenue\n#index1\n#%2\n#%3\n#!Text\n\n#*Second\n#index2\n")
    got = {r.id: r for r in citations.read_tagged(spark, str(tmp_path / "a.txt")).collect()}
    assert got["1"].title == "First title" and got["1"].references == ["2", "3"] and got["1"].year == "1999" and got["1"].abstract == "Text" and got["1"].venue == "Venue" and got["2"].authors is None
    (tmp_path / "b.txt").write_text("#*T\n#@A\n#year2001\n#confC\n#citation5\n#index7\n")
    r = citations.read_tagged(spark, str(tmp_path / "b.txt"), "v5").first()
    assert (r.year, r.venue, r.id) == ("2001", "C", "7")


def test_papers(spark, tmp_path):
    paper = {"id": "1", "title": "A <b>", "year": 2000, "authors": [{"id": "a1", "name": "N", "org": "O"}], "venue": {"raw": "V"}, "references": ["2"], "doc_type": "", "keywords": None}
    (tmp_path / "p.json").write_text(json.dumps(paper) + "\n" + json.dumps({"id": "2"}) + "\n")
    df = citations.read_papers(spark, str(tmp_path / "p.json"))
    got = {(s, p): o for s, p, o, _ in rows(citations.paper_quads(df))}
    assert got["1", "title"] == '"A b"' and got["1", "reference"] == "2" and got["a1", "affiliation"] == '"O"' and ("1", "type") not in got and got[got["1", "venue"], "type"] == "Venue"
    lines = citations.paper_quads(df).select(citations.quad_line().alias("value"))
    assert rows(nquads.corrupt_lines(lines)) == [(len(got), 0, 0)]


def test_cumulative(spark):
    df = spark.createDataFrame([("a", 2000), ("b", 2001), ("c", None)], "id string, year int")
    assert rows(citations.cumulative(df, "year").select("snapshot", "id")) == [(2000, "a"), (2001, "a"), (2001, "b")]


def test_discover(spark, tmp_path):
    sub = tmp_path / "w"
    sub.mkdir()
    for p in (tmp_path / "data-1.nq.gz", tmp_path / "x.nt.gz", tmp_path / "data.txt", tmp_path / "other.gz", sub / "data.nq.gz", sub / "y.nt.gz"):
        opener = gzip.open if p.suffix == ".gz" else open
        with opener(p, "wt") as f:
            f.write("<a> <b> <c> .\n")
    got = {r.file.rsplit("/", 1)[1] for r in nquads.discover(spark, str(tmp_path)).collect()}
    assert got == {"data-1.nq.gz", "x.nt.gz", "data.nq.gz"}


def test_delta_files(spark, tmp_path):
    (tmp_path / "additions_x.nq").write_text("<a> <b> <c> .\n")
    add, gone = nquads.read_delta(spark, str(tmp_path), "x.nq")
    assert add.count() == 1 and gone.count() == 0


def test_event_log(spark, tmp_path):
    for name, lines in {"a": [{"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": {"spark.app.name": "run3"}}, {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 6, "Submission Time": 10, "Completion Time": 15}},
                              {"Event": "SparkListenerJobStart", "Submission Time": 1}, {"Event": "SparkListenerJobEnd", "Completion Time": 21}],
                        "b": [{"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": {"spark.app.name": "run_batch_3"}}, {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 0, "Submission Time": 0, "Completion Time": 4}}]}.items():
        (tmp_path / name).write_text("\n".join(map(json.dumps, lines)))
    log = eventlog.read_eventlog(spark, str(tmp_path))
    r = eventlog.phase_times(log, "run").first()
    assert (r.iteration, r.updates, r.total, r.batch_ms) == (3, 5, 5, 4)
    assert eventlog.job_intervals(log, "run").first().incremental_ms == 20


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"class_signal": "type", "inputs": ["a", "b", "c"], "skip_snapshots": 1}))
    assert SummaryConfig.read(str(tmp_path / "c.json")).snapshots() == [(1, "b"), (2, "c")]


def test_table_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "x", 4)], "c_custkey long, c_mktsegment string, c_nationkey int")
    assert ("customer/1", "innation", "nation/3", "customer") in rows(table_quads(df, "customer"))
