import functools
import itertools
import json
import random
import re

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import boundaries, formats, mixing, names, naming, packing, sentences, tokens

# problem 3


def test_org_words():
    same = [["University of X-town".replace("X-town", "Hulhipvel"), "Hulhipvel, University of", "Uni Hulhipvel", "Université de Hulhipvel", "Univ. of Hulhipvel"], ["TU Hulhipvel", "Technische Universität Hulhipvel", "Tech. Univ. of Hulhipvel", "Dept. of Computer Science, T.U. Hulhipvel"],
            ["Children's Hospital Hulhipvel", "Hosp. for Children, Hulhipvel", "Hulhipvel Childrens Hosp."], ["Inst. of Physics, Hulhipvel", "Physcis Institute Hulhipvel"], ["School of Law, Hulhipvel", "Hulhipvel Law School"]]
    keys = [{tuple(naming.org_tokens(o)) for o in group} for group in same]
    assert all(len(k) == 1 for k in keys) and len(set.union(*keys)) == len(same)
    assert naming.same_org(naming.org_tokens("Uni Fetlevfar"), naming.org_tokens("Uni Fetlefvar")) and not naming.same_org(["law", "x"], ["lab", "x"])


def test_similarity_basics():
    assert round(naming.jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(naming.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133 and naming.jaro_winkler("", "a") == 0
    words = ["kelmann", "kelman", "kemlann", "kelmenn", "elmann", "kelmannn", "norov"]

    def distance(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for a, b in itertools.product(words, words):
        assert naming.near(a, b) == (distance(a, b) <= 1)
        if naming.near(a, b):
            assert naming.deletions(a) & naming.deletions(b)


PEOPLE = [
    ("1", "Leonardo Ivvulu", "Uni A-town"), ("2", "Ivvulu Leonardo", "University of A-town"), ("3", "Ivvulu, L.", "Uni A-town"), ("4", "Leo Ivvulu", "Uni A-town"), ("5", "LEONARDO IVVULU", "Uni A-town"), ("6", "Prof. Leonardo  Ivvulu      2 ", "Uni A-town"),
    ("7", "LK Ivvlu", "Uni A-town"), ("8", "Leonardo K. Ivvulu", "Uni A-town"), ("9", "Leonardo Ivvulu", "Uni Elsewhere"), ("10", "Leonardo Ivvulu", None), ("11", "Björn Kelmann", "Uni A-town"), ("12", "Jörn Kelmann", "Uni A-town"), ("13", "B. Kelmann", "Uni A-town"),
    ("14", "A. M. Eldululu", "Uni A-town"), ("15", "AM Elduululu", "Uni A-town"), ("16", "Maria José Corskesti", "Uni A-town"), ("17", "M. J. Corskesti", "Uni A-town"), ("18", "A. Quist", "Uni A-town"), ("19", "Anna Quist", "Uni A-town"), ("20", "Amina Quist", "Uni A-town"),
    ("1", "Leonardo Ivvulu", "Uni A-town"), (None, "X Y", "Uni A-town"), ("21", None, "Uni A-town"), ("22", "", "Uni A-town"), ("23", "Ł" * 500 + " Long", "Uni A-town"),
]


def test_people_and_orgs(spark):
    authors = spark.createDataFrame(PEOPLE, "id string, name string, org string").selectExpr("*", "1 as node", "2 as key", "3 as cluster")
    affs = spark.createDataFrame([("a2", "Uni A-town"), ("a1", "University of A-town"), ("a3", "TU A-town"), ("a4", None), ("a5", "..."), ("a1", "University of A-town")], "aff_id string, org string")
    got = set(map(tuple, names.variants(authors, affs).collect()))
    group = [tuple(sorted(p)) for p in itertools.combinations("12345678", 2)]
    want = {("person", *p) for p in group} | {("person", "11", "13"), ("person", "14", "15"), ("person", "16", "17"), ("org", "a1", "a2")}
    assert got == want
    assert names.variants(authors.limit(0), affs.limit(0)).count() == 0


# names and organisations that no test table is known to hold
HELD_NAMES = [("Katherine Orr", "Kathy Orr"), ("Gregory Orr", "Greg Orr"), ("Timothy Orr", "Tim Orr"), ("Jonathan Orr", "Jon Orr"), ("Rebecca Orr", "Becky Orr"), ("Kenneth Orr", "Ken Orr"), ("Steven Orr", "Steve Orr"), ("Jennifer Orr", "Jen Orr"), ("Susan Orr", "Sue Orr"), ("Anna Maria Orr", "Anna Orr"),
              ("Anna Maria Orr", "Anna M. Orr"), ("Leopold Karl Orr", "Leopold K. Orr"), ("Bartholomew Orr", "Bart Orr"), ("Nathaniel Orr", "Nate Orr"), ("Obi Nneka", "Nneka Obi"), ("Annalena Orr", "Anna Lena Orr")]
HELD_APART = [("Daniel Orr", "Daniela Orr"), ("Ramon Orr", "Ramona Orr"), ("Anna Maria Orr", "Anna K. Orr"), ("Paul Orr", "Paula Orr"), ("Björn Orr", "Jörn Orr"), ("Maria José Allavenko", "Maria José Barlavenko")]


def test_held_out_names():
    same = lambda a, b: naming.same_person(naming.person_parts(a), naming.person_parts(b))
    assert [p for p in HELD_NAMES if not same(*p)] == [] and [p for p in HELD_APART if same(*p)] == []
    assert not naming.same_person(naming.person_parts("Tova Orr"), naming.person_parts("Nova Orr"), frozenset({"tova", "nova"}))


def test_held_out_organisations(spark):
    names_of = [["Ministry of Energy, Ostvik", "Min. of Energy, Ostvik"], ["Space Agency Ostvik", "Space Agcy. Ostvik"], ["Kel Stiftung Ostvik", "Kel Foundation Ostvik"], ["Nationalbibliothek Ostvik", "Ostvik National Library"], ["Massachusetts Institute of Technology", "MIT"],
                ["Bureau of Marine Surveys Ostvik", "BMS Ostvik", "Ostvik B.M.S."], ["Institute of Physics Ostvik"], ["Institute of Physiology Ostvik"], ["School of Law Ostvik"], ["Society of Law Ostvik"], ["Centre for Fair Trade Norham"], ["Council of Farm Traders Norham"], ["CFT Norham"]]
    df = spark.createDataFrame([(o,) for group in names_of for o in group] + [(None,), ("",)], "org string")
    got = {}
    for r in names.org_clusters(df).collect():
        got.setdefault(r.cluster, set()).add(r.org)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, names_of))  # CFT fits two and stays alone


def test_hot_blocks_are_divided(spark, monkeypatch):
    people = [(str(i), f"{n} Orr", "Uni A-town") for i, n in enumerate(["Robert", "Bob", "Roberto", "Rupert", "Rebert", "Ralf", "Rolf", "Rita", "R.", "Roland", "Rowland"])]
    authors = spark.createDataFrame(people, "id string, name string, org string")
    affs = spark.createDataFrame([("a1", "Uni A-town")], "aff_id string, org string")
    want = rows(names.variants(authors, affs))
    monkeypatch.setattr(names, "HOT", 2)
    assert rows(names.variants(authors, affs)) == want and ("person", "0", "1") in want


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 80)}", f"n{rng.randint(0, 80)}") for _ in range(60)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(200)]
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = names.components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string"))
    assert {r.node: r.label for r in got.collect()} == {n: find(n) for n in nodes}


# problem 4


def test_copies_against_brute_force(spark):
    rng = random.Random(6)
    base = [{"raw": "Int. Conf. on Théorie", "volume": 12}, {"raw": "Int Conf on Theorie", "volume": "12"}, {"raw": "Other", "issn": None}, {"raw": "Other", "publisher": ""}]
    lines = []
    for i in range(300):
        d = dict(base[0] if rng.random() < 0.4 else rng.choice(base))
        if rng.random() < 0.5:
            d["raw"] = d["raw"].upper().replace(" ", "_ ")
        if "volume" in d:
            d["volume"] = str(d["volume"])
        lines.append((i, json.dumps(dict(rng.sample(list(d.items()), len(d))), ensure_ascii=rng.random() < 0.5)))
    lines += [(1000, None), (None, "{}"), (1001, "{}"), (1002, '{"x": ""}'), (1003, "broken {"), (1004, "Broken"), (1005, '{"raw": "' + "z" * 50_000 + '"}'), (1006, "")]

    def key(text):
        try:
            d = json.loads(text)
        except ValueError:
            d = {"": text}
        return frozenset((formats.canonical(k), formats.canonical(str(v))) for k, v in d.items() if v is not None and formats.canonical(str(v)))

    groups = {}
    for i, t in sorted((x for x in lines if x[0] is not None and x[1] is not None)):
        groups.setdefault(key(t), []).append(i)
    df = spark.createDataFrame(lines, "line_id bigint, venue string").selectExpr("*", "1 as code", "2 as codes", "3 as keep_id")
    assert rows(formats.further_copies(df)) == sorted((g[0], x) for g in groups.values() for x in g[1:])
    assert rows(formats.collapsed(df)) == sorted((g[0], len(g)) for g in groups.values())
    assert formats.further_copies(df.limit(0)).count() == 0


# problems 8 and 9

DOCS = "doc_id bigint, text string, source string"


def documents(spark, n=400, seed=2):
    rng = random.Random(seed)
    data = [(i, " ".join(["word"] * min(3000, int(rng.paretovariate(1) * 12))), "big" if rng.random() < 0.5 else rng.choice(["mid", "small"])) for i in range(n)]
    return spark.createDataFrame(data + [(9001, None, "big"), (9002, "", "big"), (9003, "x " * 20_000, "big"), (9004, "no source", None), (5, "again", "mid")], DOCS).selectExpr("*", "1 as pack", "2 as n_tokens", "3 as window", "4 as bucket", "5 as at")


def test_packs_hold_every_text_once(spark):
    docs = documents(spark)
    sizes = spark.createDataFrame([("s", 64), ("l", 1000), ("s", 64), ("none", 0), (None, 5)], "pack string, capacity int")
    size = {}
    for r in tokens.with_tokens(docs.filter("text is not null").select("doc_id", "text")).collect():
        size.setdefault(r.doc_id, []).append(r.n_tokens)
    for parts, merge in ((200_000, 64), (40, 2)):
        got = packing.pack_texts(docs, sizes, rows=parts, windows=8, merge=merge).collect()
        for pack, capacity in (("s", 64), ("l", 1000)):
            mine = [r for r in got if r.pack == pack]
            fill = {}
            for r in mine:
                fill[r.pack_id] = fill.get(r.pack_id, 0) + r.n_tokens
            assert max(fill.values()) <= capacity
            for d, sizes_of in size.items():
                pieces = sorted((r.part, r.start_token, r.n_tokens) for r in mine if r.doc_id == d)
                assert sum(p[2] for p in pieces) == sum(sizes_of)
                assert len(pieces) == sum(max(1, -(-n // capacity)) for n in sizes_of)
            assert sum(fill.values()) / (len(fill) * capacity) > (0.93 if parts > 100 else 0.85)
    assert packing.pack_texts(docs.limit(0), sizes).count() == 0 and packing.pack_texts(docs, sizes.limit(0)).count() == 0
    fills = packing.pack_fill(packing.pack_texts(docs, sizes), sizes).collect()
    assert {r.pack for r in fills} == {"s", "l"}


def test_merges_get_open_windows_only(spark, monkeypatch):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "word " * rng.randint(1, 90)) for i in range(3000)], "doc_id bigint, text string")
    sizes = spark.createDataFrame([("s", 64), ("l", 200)], "pack string, capacity int")
    seen, plain = [], packing.merge_step

    def watched(left, capacities, number, units, windows, merge):
        seen.append((units, max(r["count"] for r in left.groupBy("pack", (left.unit / merge).cast("int").alias("u")).count().collect())))
        return plain(left, capacities, number, units, windows, merge)

    monkeypatch.setattr(packing, "merge_step", watched)
    got = packing.pack_texts(docs, sizes, rows=100, windows=8, merge=4)
    assert [u for u, _ in seen] == [8, 2, 1] and all(n <= 8 * 4 for _, n in seen)
    assert rows(packing.pack_checks(got, sizes)) == [("l", 3000, 0, 0), ("s", 3000, 0, 0)]
    assert all(r.fill > 0.9 for r in packing.pack_fill(got, sizes).collect())


def test_a_repeated_id_is_dealt_to_all(spark):
    docs = spark.createDataFrame([(7, "word " * 9)] * 2000, "doc_id bigint, text string")
    sizes = spark.createDataFrame([("s", 100)], "pack string, capacity int")
    got = packing.pack_texts(docs, sizes, rows=100, windows=4, merge=4).collect()
    assert len(got) == 2000 and sum(r.n_tokens for r in got) / (100 * len({r.pack_id for r in got})) > 0.9


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation(n, key):
    got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
    assert sorted(got) == list(range(n))


def test_mix(spark):
    docs = documents(spark, 600)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.25, 3), ("absent", 0.05, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, targets, block=32, shard=100).collect()
    size = {r.doc_id: r.n_tokens for r in tokens.with_tokens(docs.filter("text is not null and doc_id != 5").select("doc_id", "text")).collect()}
    cap = {"big": 1, "mid": 2, "small": 3}
    used, slots = {}, {}
    for r in got:
        for t in range(r.start_token, r.start_token + r.n_tokens):
            used[r.doc_id, t] = used.get((r.doc_id, t), 0) + 1
        slots.setdefault((r.shard, r.pos), []).append(r)
    assert all(sum(x.n_tokens for x in v) <= 32 and len({(x.source, x.block) for x in v}) == 1 for v in slots.values())
    source = {r.doc_id: r.source for r in docs.collect()}
    assert all(n <= cap[source[d]] for (d, t), n in used.items() if d != 5) and all(t < size[d] for d, t in used if d != 5)
    shares = {r.source: r for r in mixing.mix_shares(mixing.mix(docs, targets, block=32, shard=100), targets).collect()}
    assert abs(shares["big"].actual_share - 0.5 / 0.95) < 0.06 and shares["absent"].actual_share == 0 and all(shares[s].most_used <= cap[s] for s in cap)
    assert abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-9
    shards = sorted({r.shard for r in got})
    for k in shards[:-1]:
        assert {p for s, p in slots if s == k} == set(range(100))
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def test_totals_respect_supply_and_shares():
    got = mixing.source_totals({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3), "c": (0.2, 2)}, 500)
    assert got == {"a": 470, "b": 30} and mixing.source_totals({}, {"a": (1.0, 1)}, None) == {}
    assert mixing.source_totals({"a": 900, "b": 100}, {"a": (0.6, 1), "b": (0.3, 2)}, None) == {"a": 400, "b": 200}
    assert sum(mixing.source_totals({"a": 7, "b": 9, "c": 2}, {"a": (0.3, 1), "b": (0.3, 1), "c": (0.4, 1)}, 11).values()) == 11


def test_shards_agree_whoever_draws_them():
    totals = np.array([5000, 300, 0, 1717])
    whole = list(mixing.shard_counts(totals, 64, 9, 0, 1000))
    assert len(whole) == -(-7017 // 64) and [int(c.sum()) for _, c, _ in whole] == [64] * 109 + [41]
    assert np.array_equal(sum(c for _, c, _ in whole), totals) and all(np.array_equal(f, sum((c for _, c, _ in whole[:i]), np.zeros(4, int))) for i, (_, _, f) in enumerate(whole))
    parts = [x for a in range(0, 110, 7) for x in mixing.shard_counts(totals, 64, 9, a, a + 7)]
    assert all(a[0] == b[0] and np.array_equal(a[1], b[1]) and np.array_equal(a[2], b[2]) for a, b in zip(whole, parts, strict=True))
    share = np.array([c[0] for _, c, _ in whole[:-1]])
    p = 5000 / 7017
    assert abs(share.mean() - 64 * p) < 0.5 and 0.5 < share.var() / (64 * p * (1 - p)) < 1.6  # spread of a multinomial count


def test_halving_huge_counts():
    counts = np.array([3 * 10**11, 10**6, 5 * 10**10])
    left = mixing.halved(counts, 10**11, (1, 2, 3))
    assert left.sum() == 10**11 and (left <= counts).all() and abs(left[0] / 10**11 - 3 / 3.50001) < 1e-3
    assert mixing.halved(np.array([0, 5]), 3, (1,)).tolist() == [0, 3]


# problem 10

# Texts with a bar at each boundary.
TEXTS = """Dr. Foo asked, "Which key is lost? Is it ours?", but nobody knew.| See Fig. 3 (cf. Sect. 2.1) at 3.14 p.m. today.| It ended.
He saw edges, hashes, etc.| The rest was, e.g. in the U.K. mirror, lost?!| Wait… the step ended ... and then none.| (A whole one.)| Then 5 p.m. came.
The set ends.|The next has no space.| eGraph-style keys help: so.| 20 of 30 rows stay.| See http://a.example/v1.2/all.nq.gz today.
The log says: "All is lost. Nothing changed."| Version 3.2.1 runs.| Roe said no. 2, not no. 8, merges.| "We do. It is," wrote L. Kelkez at night.
Am 12. Juni kam z. B. Frau Dr. Meier.| Siehe Nr. 3 ff. im Anhang.| „Ist das so?“, rief Prof. Alt.| Er sagte: „Ja. Mehr nicht.“| Warum?
M. Roux dit : « Voilà. Rien de plus. »| Le robot, cf. chap. 1, p. 9.| « Faut-il ? » demande Mme Roux.| ¿Qué es?, preguntó ella.| ¡Ya!| El Sr. Lu, p. ej. aquí.
В 438 г. обходчик заменяет узлы и т. д.| «Всё так. Ничего», — писал А. В. Рой.| См. рис. 4.
Γιατί χάνει ακμές;| Ο κ. Ρω έγραψε: «Ναι. Τίποτε.»| Κρατά κ.λπ.| Τέλος.
هل يفقد الحواف؟| قال د. Roe: «نعم. لا شيء.»| يحفظ القائمة؛ ثم ينتهي.
क्या यह है?| "यह है। और नहीं।" ऐसा Roe ने लिखा।| डॉ. Roe के अनुसार है।
印记索引保存空节点！|Roe写道：“保存。没有别的。”|“忽略？”Roe问道，索引替换。|爬虫保存……然后忽略。|It ended at night.|爬虫保存（见第2.2节）边。
「比較する？」とRoe氏は尋ねた。|Roe氏は「失う。それだけだ。」と書いた。|終わり。
Roe 씨는 "비교한다. 그뿐이다."라고 썼다.| 왜 잃는다?
ภาพที่สองเก็บ 37 รายการต่อวัน| กราฟสรุปเก็บ| It ends.| ทำไมจึงเก็บใน 2.5 วินาที"""


@pytest.mark.parametrize("line", TEXTS.split("\n"))
def test_boundaries(line):
    text = line.replace("|", "")
    got = [text[a:b] for a, b in boundaries.sentences(text)]
    assert got == [x.strip() for x in line.split("|")]


# titles, months and abbreviations that no test table is known to hold
HELD = """Then Gov. Brown met Gen. Lee, Rev. Ames and Capt. Oz.| Lt. Col. Kay and Sen. Roe left.| It was Sgt. Poe.
On Jan. 5 and Sept. 12 it ran.| In Dec. it stood still.| She came in mar.| Ok then.
Das 3. Semester und der 2. Weltkrieg.| Bis zum 30. Geburtstag waren es 4 Mio. Euro inkl. Steuer.| Gut.
Voir Mgr. Oul et Mmes. Ira.| La pág. 4 y el núm. 7 del Gral. Paz.| Fin.
Рост на 3 млн. рублей, ул. Мира.| Конец."""


@pytest.mark.parametrize("line", HELD.split("\n"))
def test_held_out_abbreviations(line):
    text = line.replace("|", "")
    assert [text[a:b] for a, b in boundaries.sentences(text)] == [x.strip() for x in line.split("|")]


LAYOUT = [
    ("Heading\n\nFirst one. Second\none here.\n\n1. Item one\n2. Item two. More.\n- Point", ["Heading", "First one.", "Second\none here.", "1. Item one", "2. Item two.", "More.", "- Point"]),
    ("  \r\n\r\nA b.\r\n\r\n* x\r\n• y", ["A b.", "* x", "• y"]),
    ("seit dem\n3. Mai war es. Ende", ["seit dem\n3. Mai war es.", "Ende"]),
    ('An open "quote. Here\n\nNext one. Two.', ['An open "quote. Here', "Next one.", "Two."]),
    ("", []), (" \n\t ", []), ("x", ["x"]), ("3.2 Layout\n\nAppendix B. Counters", ["3.2 Layout", "Appendix B. Counters"]),
]


@pytest.mark.parametrize("text,want", LAYOUT)
def test_layout(text, want):
    assert [text[a:b] for a, b in boundaries.sentences(text)] == want


def test_chunk_functions_compose():
    text = " ".join(TEXTS.replace("|", "").split("\n"))
    places = [0, *(m.end() for m in re.finditer(r"[^\W\d_]{4}(?=[^\W\d_]{2})", text))][::2] + [len(text)]
    parts = [boundaries.chunk_function(boundaries.chunk_marks(text, a, b)[0]) for a, b in zip(places, places[1:])]
    whole = boundaries.chunk_function(boundaries.chunk_marks(text, 0, len(text))[0])
    assert len(places) > 10 and functools.reduce(boundaries.composed, parts) == whole
    left, right = functools.reduce(boundaries.composed, parts[:4]), functools.reduce(boundaries.composed, parts[4:])
    assert boundaries.composed(left, right) == whole  # composition is associative, so the scan may group as it likes


def test_tables_equal_the_transducer():
    for (kind, symbol), code in boundaries.CODES.items():
        for s in range(len(boundaries.STATES)):
            assert (boundaries.STEPS[code][s], boundaries.ACTIONS[code][s]) == boundaries.delta(s, kind, symbol)


@pytest.mark.parametrize("size,block", [(60, 3), (150, 2), (2048, 64)])
def test_long_documents_equal_short_ones(spark, size, block):
    paragraphs = TEXTS.replace("|", "").split("\n")
    data = [(1, "\n\n".join(paragraphs)), (2, " ".join(paragraphs)), (3, "\n".join(paragraphs)), (4, "a" * 1000), (5, "word " * 400), (6, "9 . " * 300), (7, None), (8, ""), (9, "1. One two three\n2. Two three four"), (1, "Other text of one. Two."), (10, "A b. " * 200)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 as h", "2 as k", "3 as f", "4 as start_char")
    assert rows(sentences.sentence_units(df, size, block)) == sorted({(i, a, b) for i, t in data if t for a, b in boundaries.sentences(t)})
    assert sentences.sentence_units(df.limit(0)).count() == 0


@pytest.mark.parametrize("size,block", [(300, 2), (2048, 64), (10_000, 1)])
def test_all_documents_whatever_the_chunks(spark, size, block):
    """Every text of the table through chunks, functions and scan equals one pass from the start state."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted({(r.doc_id, a, b) for r in docs.filter("text is not null").select("doc_id", "text").collect() for a, b in boundaries.sentences(r.text)})
    assert rows(sentences.sentence_units(docs, size, block)) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='aB. !?"“”()\n1-。', max_size=60))
def test_sentences_cover_all_text(text):
    spans = boundaries.sentences(text)
    covered = "".join(text[a:b] for a, b in spans)
    assert "".join(covered.split()) == "".join(text.split())
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
