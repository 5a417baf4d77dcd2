import random

import pytest
from conftest import rows

from quadrille.functions.hashing import murmur3_string, ref_hash, summary_id
from quadrille.functions.terms import normalise
from quadrille.sources.nquads import corrupt_lines, quads_from_lines

# Hashes and ids that the results must equal.
HASHES = {"": 377927480, "a": -1454233464, "ab": -1952917201, "tbl": -1122452666, "zbw": -2002205862, "cau": -325920145, "type": -83216024, "person": 990009295, "organisation": 1606008872,
          "university": -1321909698, "name": 1782272923, "worksfor": -1392701805, "livesin": 1835001307, "http://zbw.eu": 1391725738}


def test_hash_goldens(spark):
    assert {k: murmur3_string(k) for k in HASHES} == HASHES
    df = spark.createDataFrame([(k,) for k in HASHES] + [(None,)], "t string")
    assert {r[0]: r[1] for r in df.select("t", ref_hash("t")).collect()} == HASHES | {None: None}


def test_hash_equals_the_jvm(spark):
    jvm = getattr(getattr(spark._jvm.scala.util.hashing, "MurmurHash3$"), "MODULE$")
    for t in ["", "é", "日本語", "a\U0001F4C8b", "x" * 101]:
        assert murmur3_string(t) == jvm.stringHash(t)


def test_summary_ids():
    tbl = {"worksfor": ["organisation"], "name": [], "livesin": []}
    assert summary_id([], {}) == 48
    assert summary_id(["organisation"], {}) == 1606008920
    assert summary_id(["person"], tbl) == 525623488
    assert summary_id(["person"], tbl | {"worksfor": ["university"]}) == 1892672214
    assert summary_id(["organisation"], {"name": []}) == -906685405
    assert summary_id([], dict.fromkeys(tbl, [])) == -2070394679
    assert summary_id([], {"name": [], "worksfor": []}) == 389571262
    assert murmur3_string("525623488worksfor") == -408640687


def test_normalise(spark):
    cases = {"<http://A.b/C#>": "http://a.b/c", "_:X1": "http://informatik.uni-kiel.de/fluid#x1", "<http://x//#/>": "http://x", '"Lit<er>AL"': '"literal"', "": "", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", normalise("t")).collect()} == cases


@pytest.mark.parametrize("change", ["upper", "slash", "hash"])
def test_metamorphic_lines(spark, change):
    rng = random.Random(1)
    lines = [f"<http://e.org/{rng.randint(0, 99)}> <http://p.org/{rng.randint(0, 9)}> {rng.choice(['<http://o.org/1>', '\"text\"@en', '_:b1'])} <http://g.org> ." for _ in range(60)]
    other = {"upper": [x.upper() for x in lines], "slash": [x.replace("> <http://p", "/> <http://p", 1) for x in lines], "hash": [x.replace("> <http://p", "#> <http://p", 1) for x in lines]}[change]
    a, b = (rows(quads_from_lines(spark.createDataFrame([(x,) for x in y], "value string"))) for y in (lines, other))
    assert a == b and len(a) == 60
    broken = [x.replace("http://e", "http://z") for x in lines]
    assert rows(quads_from_lines(spark.createDataFrame([(x,) for x in broken], "value string"))) != a


def test_lines_of_every_kind(spark):
    lines = [(None,), ("",), ("   ",), ("<a> <b> <c> .",), ("<a> <b> <c>",), ("<a> <b> \"x\"^^<t> <g> .",)]
    df = spark.createDataFrame(lines, "value string")
    assert rows(quads_from_lines(df)) == [("a", "b", '"x"^^t', "g"), ("a", "b", "c", "http://informatik.uni-kiel.de")]
    assert rows(corrupt_lines(df)) == [(6, 3, 1)]
    assert rows(quads_from_lines(df.limit(0))) == []
