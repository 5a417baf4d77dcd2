from conftest import rows

from quadrille.plans import oracles, summaries
from quadrille.runtime import release

DATA = "/root/testdata/sf0.001"


def test_a_bundle_is_one_row_and_its_edges_are_kept(spark):
    sizes, edges = summaries.subject_bundles(spark, DATA), summaries.subject_bundle_edges(spark, DATA)
    assert sizes.columns == ["s", "n"] and "subject_bundles" in oracles.ORACLES
    assert sorted(edges.columns) == ["g", "n", "o", "p", "s"]
    of = {}
    for s, p, o, g in set(rows(summaries.edges_directed(spark, DATA).select("s", "p", "o", "g"))):
        of.setdefault(s, set()).add((p, o, g))
    assert rows(sizes) == sorted((s, len(e)) for s, e in of.items())
    assert rows(edges.select("s", "p", "o", "g", "n")) == sorted((s, *x, len(e)) for s, e in of.items() for x in e)
    release(spark)
