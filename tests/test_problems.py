import datetime as dt
import os
import random
import subprocess
import sys
import time
from pathlib import Path

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.functions.nquads import diagnose, valid_text
from quadrille.functions.packed import split_packed
from quadrille.operators.orphans import OrphanTracker, orphan_references
from quadrille.operators.packed import author_positions, unpack
from quadrille.operators.rejects import loaded, parse_block, rejected
from quadrille.operators.snapshots import SnapshotIndex, imprint_hash, snapshot_changes
from quadrille.operators.wide import filled_cells, wide_table
from quadrille.plans.problems import p7_wide
from quadrille.runtime import salted_join

IMPRINT = "_id int, _timestamp long, _payload array<string>, _schemaelementid int, snapshot int"


def test_changes(spark):
    a, b = ["<http://A/>"], ["http://a"]
    data = [
        (1, 10, a, 5, 1), (2, 10, None, 5, 1), (3, 10, ["x"], None, 1), (4, 10, ["x"], 1, 1), (5, 9, ["old"], 1, 1), (5, 10, ["new"], 1, 1),
        (1, 20, b + b, 5, 3), (2, 20, [], 5, 3), (3, 20, ["x"], 7, 3), (5, 25, ["new"], 1, 3), (5, 25, ["new"], 1, 3), (6, 20, [None], None, 3),
        (4, 30, ["x"], 1, 7), (1, 30, b, 5, 7), (None, 1, b, 5, 7), (1, 1, b, 5, None),
    ]
    df = spark.createDataFrame(data, IMPRINT).selectExpr("*", "1 as h", "2 as v", "3 as change")
    assert rows(snapshot_changes(df)) == [(3, 3, "changed"), (3, 4, "removed"), (3, 6, "added"), (7, 2, "removed"), (7, 3, "removed"), (7, 4, "added"), (7, 5, "removed"), (7, 6, "removed")]
    assert snapshot_changes(df.limit(0)).count() == 0 and snapshot_changes(df.filter("snapshot = 1")).count() == 0


def test_changes_against_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.randint(0, 30) if rng.random() > 0.35 else 7, t, rng.choice([None, [], ["a"], ["b", "a"]]), rng.choice([1, 2, None]), s) for t, s in enumerate(sorted(rng.randint(1, 5) for _ in range(400)))]
    state = {}
    for i, t, p, e, s in data:
        state.setdefault(s, {})[i] = (frozenset(p or []), e)
    want = []
    for s in sorted(state)[1:]:
        x, y = state[max(k for k in state if k < s)], state[s]
        want += [(s, i, "added" if i not in x else "removed" if i not in y else "changed") for i in x.keys() | y.keys() if x.get(i) != y.get(i)]
    assert rows(snapshot_changes(spark.createDataFrame(data, IMPRINT))) == sorted(want)


def test_old_values_of_changes(spark):
    mk = lambda d: spark.createDataFrame(d, IMPRINT)
    index = SnapshotIndex(spark, "_id", "_timestamp", imprint_hash(), keep_values=["_schemaelementid"])
    assert index.advance(mk([(1, 1, ["a"], 5, 1), (2, 1, ["a"], 5, 1)])) is None
    got = index.advance(mk([(1, 2, ["a"], 6, 2), (2, 2, ["a"], 5, 2), (3, 2, None, 9, 2)]))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "changed", 5, 6), (3, "added", None, 9)]
    index.close()


LASTING = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {path!r} + "/warehouse").getOrCreate()
from quadrille.operators.snapshots import SnapshotIndex, imprint_hash
index = SnapshotIndex(spark, "_id", "_timestamp", imprint_hash(), path={path!r} + "/index")
rows = spark.createDataFrame([(1, 1, ["a"], 5), (2, 1, ["a"], 5), (3, 1, ["a"], 5)], "_id int, _timestamp long, _payload array<string>, _schemaelementid int")
assert index.advance(rows) is None
index.drop_old()
from quadrille.operators.orphans import OrphanTracker
import datetime as dt
tracker = OrphanTracker(spark, path={path!r} + "/orphans")
papers = spark.createDataFrame([("a", dt.datetime(2021, 1, 5), ["b", "c"])], "id string, delivered_at timestamp_ntz, references array<string>")
tracker.advance(papers, spark.createDataFrame([], "id string, deleted_at timestamp_ntz"), dt.datetime(2021, 2, 1))
"""


def test_state_outlives_its_process(spark, tmp_path):
    """The first delivery is taken by another process, which ends; this one goes on from the paths."""
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", LASTING.format(root=root, path=str(tmp_path))], check=True, timeout=300, env=os.environ | {"PYTHONPATH": root})
    index = SnapshotIndex(spark, "_id", "_timestamp", imprint_hash(), path=str(tmp_path / "index"))
    rows_now = spark.createDataFrame([(1, 2, ["a"], 5), (2, 2, ["b"], 5), (4, 2, None, 1)], "_id int, _timestamp long, _payload array<string>, _schemaelementid int")
    changes = index.advance(rows_now)
    assert index.buckets == 3 and rows(changes) == [(2, "changed"), (3, "removed"), (4, "added")]
    index.drop_old()
    assert sorted(map(tuple, SnapshotIndex(spark, "_id", "_timestamp", imprint_hash(), path=str(tmp_path / "index")).advance(rows_now.limit(0)).collect())) == [(1, "removed"), (2, "removed"), (4, "removed")]
    tracker = OrphanTracker(spark, path=str(tmp_path / "orphans"))
    papers = spark.createDataFrame([("b", when(2, 3), None)], PAPERS)
    tracker.advance(papers, spark.createDataFrame([], "id string, deleted_at timestamp_ntz"), when(3, 1))
    assert tracker.steps == 2 and rows(tracker.report()) == [("2021-01", "a", "b", "late"), ("2021-01", "a", "c", "missing")]
    assert rows(tracker.counts()) == [(1, "2021-01", "missing", 2), (2, "2021-01", "late", 1), (2, "2021-01", "missing", 1)]


GOOD = ['<http://a> <b> <c> <g> .', '_:x <b> "t"@en-GB .', '<a> <b> "1"^^<xsd:integer> .', '<a> <b> "say \\"x\\" \\u00E9" <g> .', '<a> <b> "2012-02-29"^^<xsd:date> .', '<a> <b> ""^^<xsd:string> .', '<a> <b> "NaN"^^<xsd:double> .']
BAD = {
    '<a> <b> "open': "quoting", 'rest of it" <g> .': "quoting", "<a> <b> 'x' <g> .": "quoting", "<a> <b> “x” <g> .": "quoting", '<a> <b> "a "b" c" .': "quoting", '<a> <b> ""x"" .': "quoting", '<a> <b> "\\q" .': "quoting", '<a> <b> "\\u12" .': "quoting",
    '<a> <b> "open\\" <g> .': "quoting", "<a> <b> bare <g> .": "quoting", '<a> <b> "x@en <g> .': "quoting", "<a> <b> .": "terms", "<a>": "terms", "<a> <b> <c> <g>": "terms", "<a> <b> <c> <g> <h> .": "terms", "<a> <b> <c> <g> . <d> <e> <f> .": "terms",
    "<a> <b> <c> <http://cut": "terms", "<a> _:b <c> .": "value", '<a> "b" <c> .': "value", "<a> <b c> <d> .": "value", "<a> <b> <c|d> .": "value", '<a> <b> "x"@en_US .': "value", '<a> <b> "x"@12 .': "value", '<a> <b> "1.0"^^<xsd:integer> .': "value",
    '<a> <b> "2011-02-29"^^<xsd:date> .': "value", '<a> <b> "yes"^^<xsd:boolean> .': "value", '<a> <b> "2010-03-04T25:10:00"^^<xsd:dateTime> .': "value",
}


def test_rejects(spark):
    lines = GOOD + list(BAD) + [None, "", "  ", "# note"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, value string").selectExpr("*", "1 as key", "2 as s")
    assert {lines[r.line_no]: r.reason for r in rejected(df).collect()} == BAD
    assert {lines[r.line_no] for r in loaded(df).collect()} == set(GOOD)
    assert rejected(df.limit(0)).count() == 0


def test_blocks_equal_single_lines():
    rng = random.Random(5)
    lines = [rng.choice(GOOD + list(BAD) * (rng.random() < 0.2)) for _ in range(500)] + ["<a> <b> <c> .\n<a> <b> <c> .", "x" * 100_000, '<a> <b> "' + "y" * 100_000 + '" .']
    assert parse_block(lines) == [diagnose(x) for x in lines]


def test_round_trip_of_statements():
    for x in GOOD:
        _, s = diagnose(x)
        assert " ".join(t for t in s if t) + " ." == x


def test_dates():
    assert valid_text("2000-02-29", "xsd:date") and not valid_text("1900-02-29", "xsd:date") and not valid_text("1999-06-31", "xsd:date") and valid_text("anything", "other")


def test_packed():
    cases = {
        "A Bee AND C. Dee": ["A Bee", "C. Dee"], "A Bee, C Dee et al": ["A Bee", "C Dee"], "Bee, A., Dee, C.": ["Bee, A.", "Dee, C."], '"Bee, W ""Bill""";"Fee, Q"': ['Bee, W "Bill"', "Fee, Q"], "[A Bee, C Dee]": ["A Bee", "C Dee"], "{A Bee; C Dee}": ["A Bee", "C Dee"],
        ",A Bee,,C Dee,": ["A Bee", "C Dee"], "A Bee\tC Dee\nE Fee": ["A Bee", "C Dee", "E Fee"], 'A Bee, "Lab for X and Partners", C Dee': ["A Bee", "Lab for X and Partners", "C Dee"], "Bee, A;Dee, C": ["Bee, A", "Dee, C"], "A  Bee；C Dee、E Fee·G Hee": ["A Bee", "C Dee", "E Fee", "G Hee"],
        "A Bee, Jr., C Dee": ["A Bee, Jr.", "C Dee"], "Andy Sand and Orla Bandy": ["Andy Sand", "Orla Bandy"], "": [], " ; ,": [], None: [], "A Bee, and others": ["A Bee"],
    }
    assert {k: split_packed(k)[0] for k in cases} == cases
    assert split_packed('"Bee, A; C Dee')[1] and not split_packed('"Bee, A"; C Dee')[1]


NAME = st.builds(lambda a, b: f"{a} {b}", st.sampled_from(["Ann", "Bo", "Cy"]), st.sampled_from(["Lund", "O'Hara", "Von-Berg"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(NAME, min_size=1, max_size=6), st.sampled_from([", ", ";", " | ", " / ", " & ", " and ", "\n", "；"]), st.booleans())
def test_packed_round_trip(names, sep, quote):
    text = sep.join('"' + n + '"' if quote else n for n in names)
    assert split_packed(text) == (names, False)


@pytest.mark.parametrize("text", ["[" * 100_000, "[" * 50_000 + "x" + "]" * 50_000, '"' * 100_001, '"a' * 50_000, '"a" ' * 30_000, "[a;" * 40_000, '""a' * 40_000, " " * 100_000 + "x" + " " * 100_000, "a " * 60_000 + "et", '("a" ' * 25_000, "a and " * 30_000, "[a];" * 30_000])
def test_packed_in_linear_time(text):
    began = time.process_time()
    split_packed(text)
    assert time.process_time() - began < 3


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(["[", "{", '"', "[a;", '("', "a, ", '"";', "and "]), st.sampled_from(["", "]", '"', " ", "; b"]), st.integers(1, 20_000))
def test_packed_at_any_depth(unit, end, n):
    began = time.process_time()
    split_packed(unit * n + end * n)
    assert time.process_time() - began < 3


def test_packed_keeps_inner_signs():
    assert split_packed('J Poe, AT&T Labs, A/B Corp & C Dee / "E"&"F"') == (["J Poe", "AT&T Labs", "A/B Corp", "C Dee", "E", "F"], False)
    assert split_packed("[[A Bee; [C Dee]]; {E Fee}]") == (["A Bee", "C Dee", "E Fee"], False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='ab,;"[]{}() \t\n&|.', max_size=30))
def test_packed_takes_anything(text):
    for v in split_packed(text)[0]:
        assert v.strip() == v and v


def test_author_positions(spark):
    data = [("1", "A Bee, C Dee"), ("1", "A Bee, C Dee"), ("2", None), ("3", " "), (None, "E Fee"), ("4", "X Yu; " * 5000)]
    df = spark.createDataFrame(data, "id string, authors string").selectExpr("*", "1 as pos", "'x' as author", "2 as val")
    got = author_positions(df)
    assert rows(got.filter("id = '1'")) == [("1", 1, "A Bee"), ("1", 2, "C Dee")] and got.filter("id = '4'").count() == 5000 and got.filter("id is null").count() == 1
    assert unpack(df.limit(0), "authors", "id").count() == 0


def when(month, day):
    return dt.datetime(2021, month, day)


PAPERS = "id string, delivered_at timestamp_ntz, references array<string>"


def test_orphans(spark):
    papers = [("a", when(1, 5), ["b", " b ", "c", "d", None, "e", "a"]), ("c", when(2, 1), None), ("d", when(1, 3), []), ("e", when(1, 1), None), ("a", when(7, 5), ["zz"]), ("b2", None, ["q"]), (None, when(1, 1), ["q"])]
    gone = [("d", when(1, 20)), ("d", when(1, 20)), ("e", when(2, 2)), ("never", when(1, 1)), (None, when(1, 1))]
    p = spark.createDataFrame(papers, PAPERS).selectExpr("*", "1 as fd", "2 as kind", "3 as period", "4 as `limit`")
    g = spark.createDataFrame(gone, "id string, deleted_at timestamp_ntz")
    want = [("2021-01", "a", "b", "missing"), ("2021-01", "a", "c", "late"), ("2021-01", "a", "d", "deleted"), ("2021-01", "a", "zz", "missing")]
    assert rows(orphan_references(p, g, 1)) == want and rows(orphan_references(p, g, 12)) == want
    assert orphan_references(p.limit(0), g).count() == 0 and rows(orphan_references(p, g.limit(0))) == [w for w in want if w[2] != "d"]


def test_orphans_against_brute_force(spark):
    rng = random.Random(9)
    papers = [(f"p{rng.randint(0, 40)}", when(rng.randint(1, 12), rng.randint(1, 28)), [rng.choice(["p1", f"p{rng.randint(0, 60)}"]) for _ in range(4)]) for _ in range(120)]
    gone = [(f"p{rng.randint(0, 60)}", when(rng.randint(1, 12), rng.randint(1, 28))) for _ in range(15)]
    first, out = {}, {}
    for i, t, _ in papers:
        first[i] = min(t, first.get(i, t))
    for i, t in gone:
        out[i] = min(t, out.get(i, t))
    want = set()
    for i, _, refs in papers:
        m = first[i].month
        limit = dt.datetime(2021 + m // 12, m % 12 + 1, 1)
        for r in refs:
            kind = "missing" if r not in first else "late" if first[r] >= limit else "deleted" if r in out and out[r] < limit else None
            if kind:
                want.add((f"2021-{m:02d}", i, r, kind))
    got = orphan_references(spark.createDataFrame(papers, PAPERS), spark.createDataFrame(gone, "id string, deleted_at timestamp_ntz"), 4)
    assert rows(got) == sorted(want)


CELLS = "id string, label string, attribute string, source string, loaded_at timestamp"


def test_wide(spark):
    data = [
        ("1", "Year/", '"1999"^^<xsd:integer>', "s", when(1, 1)), ("1", "YEAR", " 2001.0\t", "s", when(1, 2)), ("1", "year", "unknown", "s", when(1, 3)), ("1", "year", "", "s", when(1, 4)), ("1", "title", ' "A  title "@en', "s", when(1, 1)),
        ("1", "author", "B", "s", when(1, 2)), ("1", "author", "A", "s", when(1, 3)), ("1", "author", "B", "s", when(1, 4)), ("1", "x-note", "n", "s", when(1, 1)), ("2", "volume", "99999999999", "s", when(1, 1)), ("2", "volume", "+07", "s", None), ("2", "lang", None, "s", when(1, 1)),
        (None, "year", "1", "s", when(1, 1)), ("3", None, "1", "s", when(1, 1)), ("4", "author", "z" * 50_000, "s", when(1, 1)),
    ]
    df = spark.createDataFrame(data, CELLS).selectExpr("*", "1 as val", "2 as range", "3 as at")
    wide = wide_table(df)
    assert rows(filled_cells(wide)) == [("1", "title", "A  title"), ("1", "year", "2001"), ("2", "volume", "7")]
    one = wide.filter("id = '1'").first()
    assert one.authors == ["B", "A"] and one.extra == {"x-note": ["n"]} and one.year == 2001 and wide.count() == 3
    assert wide.select("ordinal").distinct().count() == 3 and wide_table(df.limit(0)).count() == 0


def test_salted_join_keeps_all(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, r int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(tuple, salted_join(left, right, ["k"], how, share=0.1, salts=4).collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)


def test_wide_query_gives_the_values(spark, tmp_path):
    data = [("1", "author", '"B"', 1), ("1", "author", '"A"', 2), ("1", "field-of-study", "f", 1), ("1", "isbn", "i", 1), ("1", "isbn", "j", 2), ("1", "year", "2001", 1), ("2", "title", "t", 1)]
    spark.createDataFrame(data, "id string, label string, attribute string, n int").selectExpr("id", "label", "attribute", "timestamp_seconds(n) as loaded_at").write.parquet(f"{tmp_path}/paper_attributes.parquet")
    one, two = p7_wide(spark, str(tmp_path)).orderBy("id").collect()
    assert (one.authors, one.fields_of_study, one.extra, one.year, one.n_authors, one.n_fields) == (["B", "A"], ["f"], {"isbn": ["i", "j"]}, 2001, 2, 1)
    assert (two.authors, two.fields_of_study, two.extra, two.title, two.n_authors) == (None, None, {}, "t", 0)


@pytest.mark.parametrize("datatype,good,bad", [
    ("duration", ["P1Y2M3DT4H5M6.7S", "-P1D", "PT0S"], ["", "P", "PT", "P1YT", "1Y", "P1S", "P1.5D"]), ("yearMonthDuration", ["P1Y", "P3M"], ["P1D", "P"]), ("dayTimeDuration", ["P1DT1H", "PT1M"], ["P1Y", "PT", "P"]),
    ("hexBinary", ["", "0aFF"], ["0", "0g"]), ("base64Binary", ["", "YWJj", "YWI=", "YQ==", "YW Jj", "YWJjYWJj"], ["Y", "YWJ", "YR==", "YWK=", "====", "YW*j"]),
    ("gYearMonth", ["2001-10", "-0044-03Z", "2001-10+02:00"], ["2001-13", "01-10", "2001"]), ("gMonthDay", ["--02-29", "--12-31Z"], ["--02-30", "--04-31", "-12-31", "--13-01"]), ("gMonth", ["--12"], ["--13", "--1"]), ("gDay", ["---31"], ["---32", "--31"]),
    ("nonPositiveInteger", ["0", "-0", "+0", "-12"], ["1", "+1", ""]), ("negativeInteger", ["-1", "-010"], ["0", "-0", "1"]), ("nonNegativeInteger", ["0", "-0"], ["-1"]),
    ("unsignedLong", ["18446744073709551615", "-0", "+" + "0" * 5000 + "1"], ["18446744073709551616", "-1", "9" * 5000]), ("unsignedInt", ["4294967295"], ["4294967296", "-1"]), ("unsignedShort", ["65535"], ["65536"]), ("unsignedByte", ["255"], ["256", "x"]),
    ("long", ["-9223372036854775808"], ["9223372036854775808", "-9223372036854775809"]), ("dateTimeStamp", ["2001-01-01T00:00:00Z"], ["2001-01-01T00:00:00", "2001-02-30T00:00:00Z"]), ("normalizedString", [" a  b "], ["a\tb"]),
    ("token", ["", "a b"], [" a", "a ", "a  b", "a\nb"]), ("language", ["en", "de-CH-1996"], ["", "e_n", "abcdefghi"]), ("Name", ["a:b", "_x", "\u00e9"], ["1a", "", "a b"]), ("NCName", ["a-1"], ["a:b", "-a"]), ("NMTOKEN", ["1a:"], ["", "a b"]), ("NMTOKENS", ["1 b"], ["a  b", ""]),
    ("QName", ["a:b", "b"], ["a:", ":b", "a:b:c"]), ("ID", ["x"], ["1"]), ("IDREFS", ["x y"], ["x 1"]),
])
def test_lexical_spaces(datatype, good, bad):
    for prefix in ("xsd:", "http://www.w3.org/2001/XMLSchema#"):
        assert [x for x in good if not valid_text(x, prefix + datatype)] == [] and [x for x in bad if valid_text(x, prefix + datatype)] == []


def test_rare_datatypes_are_read_unescaped():
    assert diagnose('<a> <b> "P"^^<xsd:duration> <g> .')[0] == "value" and diagnose('<a> <b> "P1D"^^<xsd:duration> <g> .')[0] is None
    assert diagnose(r'<a> <b> "\u00e9"^^<xsd:NCName> <g> .')[0] is None and diagnose(r'<a> <b> "a\tb"^^<xsd:token> <g> .')[0] == "value"
