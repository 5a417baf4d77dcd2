"""Variant spellings of persons and organisations, linked (problem 3)."""

from __future__ import annotations

import json
import math

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import discard, hot_join, materialise, salted_join
from .naming import Person, acronyms, deletions, given_forms, initial_runs, initials_fit, org_tokens, person_parts, phonetic, same_org, same_person, same_surname

LONGS = T.ArrayType(T.LongType())
#: A block of more names is divided by a second key; a word in at least this share of the names, and in so many, is common
#: (so at most a few times 1/COMMON words are).
HOT, COMMON, COMMON_LEAST = 200, 1 / 5000, 20


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, label: the smallest node of each connected component; nodes without edges are their own.

    Every round takes the least label among a node and its neighbours, then jumps once to that
    label's own; rounds end when nothing changes. Each round is written to the shared folder.
    """
    both = materialise(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
    if both.isEmpty():
        return nodes.select("node", F.col("node").alias("label"))
    stored = labels = materialise(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        low = labels.join(heard, "node").select("node", F.least("label", "heard").alias("low"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        new = materialise(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("label"), "was"), "labels")
        discard(stored)
        stored, labels = new, new.select("node", "label")
        if new.filter("label <> was").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _pairs(keyed: DataFrame) -> DataFrame:
    """Candidate pairs a < b of distinct names that share a block key. keyed: node, key, stored."""
    left = keyed.select("key", F.col("node").alias("a"))
    right = keyed.select("key", F.col("node").alias("b"))
    return left.join(right, "key").filter("a < b").select("a", "b").distinct()


def _divided(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """keyed, the names of blocks beyond HOT put into smaller blocks of a second key. Two names that are one person
    have given names that are equal, short for the same, or a slip apart, and so share a second key."""
    hot = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "hot-blocks")
    if hot.isEmpty():
        return keyed
    again = hot_join(keyed, hot, ["key"]).join(nodes.select("node", "name"), "node").select("node", F.explode(_second_keys("key", "name")).alias("key"))
    out = materialise(hot_join(keyed, hot, ["key"], "left_anti").select("node", "key").unionByName(again), "small-blocks")
    discard(keyed)
    return out


@F.pandas_udf(T.StringType())
def _org_node(orgs: pd.Series) -> pd.Series:
    return orgs.map(lambda o: " ".join(org_tokens(o)))


def _hash(*parts: str) -> int:
    """64 bits of a block key, signed."""
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


@F.pandas_udf(LONGS)
def _org_keys(nodes: pd.Series) -> pd.Series:
    """Block keys: for each word its phonetic code beside the first letters of the others (so that those may be cut
    short), and its one-letter deletions beside the others."""

    def keys(node: str) -> list[int]:
        words = node.split()
        out = set()
        for i, w in enumerate(words):
            others = words[:i] + words[i + 1 :]
            if len(w) >= 5:
                out.add(_hash("~", phonetic(w), "".join(sorted(x[0] for x in others))))
                rest = " ".join(others)
                out |= {_hash(rest, d) for d in deletions(w)}
        return sorted(out)

    return nodes.map(keys)


@F.pandas_udf(LONGS)
def _acronym_keys(orgs: pd.Series) -> pd.Series:
    return orgs.map(lambda o: sorted({_hash("acronym", *x) for x in acronyms(o)}))


@F.pandas_udf(LONGS)
def _run_keys(orgs: pd.Series) -> pd.Series:
    return orgs.map(lambda o: sorted({_hash("acronym", *x) for x in initial_runs(o)}))


@F.pandas_udf(T.BooleanType())
def _same_org(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_org(x.split(), y.split()) for x, y in zip(a, b)], dtype=bool)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """df with an integer ``node`` for each row, stored, so that blocks and pairs are narrow."""
    return materialise(df.withColumn("node", F.monotonically_increasing_id()), name)


def _named_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """a, b and the names of both."""
    x = left.select(F.col("node").alias("a"), F.col(column).alias("x"))
    y = right.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(x, "a").join(y, "b")


def org_clusters(orgs: DataFrame) -> DataFrame:
    """org, cluster of each distinct spelling. Null and wordless spellings are left out.

    A spelling with an acronym joins the one class in which the acronym is spelled out beside the same words; it stays
    apart where it fits several.
    """
    named = materialise(orgs.select("org").filter("org is not null").distinct().select("org", _org_node("org").alias("words")).filter("words != ''"), "org-names")
    nodes = _numbered(named.select("words").distinct(), "org-nodes")
    keyed = materialise(nodes.select("node", F.explode(_org_keys("words")).alias("key")), "org-blocks")
    edges = materialise(_named_pairs(_pairs(keyed), nodes, nodes, "words").filter(_same_org("x", "y")).select("a", "b"), "org-pairs")
    discard(keyed)
    placed = materialise(named.join(nodes.join(components(nodes, edges), "node"), "words").select("org", "label"), "org-classes")
    short = placed.select("label", F.explode(_acronym_keys("org")).alias("key")).distinct()
    spelled = placed.select(F.col("label").alias("b"), F.explode(_run_keys("org")).alias("key")).distinct()
    fits = short.join(spelled, "key").filter("label <> b").groupBy(F.col("label").alias("a"), "key").agg(F.min("b").alias("b"), F.count_distinct("b").alias("n"))
    joined = components(placed.select(F.col("label").alias("node")).distinct(), fits.filter("n = 1").select("a", "b"))
    return placed.join(joined.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label").select("org", "cluster")


def _dump(p: Person) -> str:
    return json.dumps([sorted(p.full) if p.surname is None and len(p.full) == 2 else p.full, p.initials, p.surname, p.double], ensure_ascii=False)


def _load(text: str) -> Person:
    full, initials, surname, double = json.loads(text)
    return Person(tuple(full), initials, surname, double)


@F.pandas_udf(T.StringType())
def _person_node(names: pd.Series) -> pd.Series:
    return names.map(lambda n: _dump(person_parts(n)))


@F.pandas_udf(T.IntegerType())
def _full_words(nodes: pd.Series) -> pd.Series:
    return nodes.map(lambda n: len(json.loads(n)[0]))


@F.pandas_udf(LONGS)
def _full_keys(orgs: pd.Series, nodes: pd.Series) -> pd.Series:
    """Block keys of full names: phonetic codes of the sorted words; the surname's one-letter deletions beside the
    given name's initial (or that of what a nickname stands for); the surname beside the given name's deletions."""

    def keys(org: str, node: str) -> list[int]:
        p = _load(node)
        out = {_hash(org, "~", *sorted(phonetic(w) for w in p.full))}
        for surname, given in p.readings():
            first = "".join(given)
            initials = {g[:1] for g in given_forms(first)} | {g[:1] for g in given_forms(given[0])} if given else {""}
            out |= {_hash(org, d, g) for d in deletions(surname) for g in initials}
            out |= {_hash(org, surname, "", d) for d in deletions(first)}
        return sorted(out)

    return pd.Series([keys(str(o), n) for o, n in zip(orgs, nodes)])


@F.pandas_udf(LONGS)
def _second_keys(blocks: pd.Series, nodes: pd.Series) -> pd.Series:
    """Within a block: beginnings, deletions and full forms of the given names, joined and of the first alone."""

    def keys(block: int, node: str) -> list[int]:
        firsts = {x for _, given in _load(node).readings() if given for x in ("".join(given), given[0])}
        return sorted({_hash(str(block), y) for x in firsts for g in given_forms(x) for y in deletions(g) | {g[:2]}})

    return pd.Series([keys(b, n) for b, n in zip(blocks, nodes)])


def _same_person(common: frozenset[str]):
    @F.pandas_udf(T.BooleanType())
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_person(_load(x), _load(y), common) for x, y in zip(a, b)], dtype=bool)

    return same


def _common_words(nodes: DataFrame) -> frozenset[str]:
    """Words of two letters or more in at least COMMON of all names, and in COMMON_LEAST: such are no typing errors of
    each other. At most a few times 1/COMMON words, whatever the table's size."""
    words = F.explode(F.from_json(F.get_json_object("name", "$[0]"), "array<string>")).alias("w")
    least = max(COMMON_LEAST, math.ceil(COMMON * nodes.count()))
    return frozenset(r[0] for r in nodes.select(words).groupBy("w").count().filter(F.col("count") >= least).select("w").collect())


def _short_readings(p: Person) -> set[tuple[str, str]]:
    """(surname, initials) in every reading, nicknames spelled out."""
    out = set()
    for surname, given in p.readings():
        for g in given_forms(given[0]) if given else ():
            out |= {(surname, seq) for seq in p.sequences((g, *given[1:]))}
        if not given:
            out.add((surname, p.initials))
    return out


@F.pandas_udf(LONGS)
def _short_keys(orgs: pd.Series, nodes: pd.Series) -> pd.Series:
    """One-letter deletions of the surname beside the first initial, in every reading."""
    return pd.Series([sorted({_hash(str(o), d, seq[:1]) for s, seq in _short_readings(_load(n)) for d in deletions(s)}) for o, n in zip(orgs, nodes)])


@F.pandas_udf(T.IntegerType())
def _short_fit(short: pd.Series, full: pd.Series) -> pd.Series:
    """0 no fit; else the better the greater: equal surnames before near ones, full fit of initials before the first alone."""

    def fit(a: str, b: str) -> int:
        best = 0
        for s, q in _short_readings(_load(a)):
            for t, g in _short_readings(_load(b)):
                n = initials_fit(q, g)
                if n and same_surname(s, t):
                    best = max(best, n + 2 * (s == t))
        return best

    return pd.Series([fit(a, b) for a, b in zip(short, full)], dtype="int32")


@F.pandas_udf(LONGS)
def _surname_keys(orgs: pd.Series, nodes: pd.Series) -> pd.Series:
    names = [_load(n) for n in nodes]
    return pd.Series([sorted({_hash(str(o), d, p.initials) for d in deletions(p.full[0])}) for o, p in zip(orgs, names)])


@F.pandas_udf(T.BooleanType())
def _near_short(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = [(_load(x), _load(y)) for x, y in zip(a, b)]
    return pd.Series([x.initials == y.initials and same_surname(x.full[0], y.full[0]) for x, y in pairs], dtype=bool)


def _attach(short: DataFrame, full: DataFrame) -> DataFrame:
    """node, label: abbreviated names whose best fitting full names are all of one component.

    short, full: node, org, name; full has label too. A short name that fits several people stays alone.
    """
    key = F.explode(_short_keys("org", "name")).alias("key")
    s = short.select(F.col("node").alias("a"), key)
    f = full.select(F.col("node").alias("b"), key)
    fits = _named_pairs(s.join(f, "key").select("a", "b").distinct(), short, full, "name").select("a", "b", _short_fit("x", "y").alias("fit")).filter("fit > 0")
    best = fits.join(full.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.max("fit").alias("fit"))
    # the best fit of each name, how many people share it, and one of them: kept in one partial aggregate per fit
    per_fit = best.groupBy("node", "fit").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    top = per_fit.groupBy("node").agg(F.max(F.struct("fit", "n", "label")).alias("m"))
    return top.filter("m.n = 1").select("node", F.col("m.label").alias("label"))


def person_clusters(records: DataFrame, orgs: DataFrame) -> DataFrame:
    """id, cluster of author records with an organisation.

    Distinct (organisation, name) nodes are blocked and compared, never records: full names first,
    linked into components; then names of initials and a surname join the one component they
    fit, or one another. People of different organisations are different.
    """
    known = records.filter("id is not null and name is not null and org is not null").select("id", "name", "org").distinct()
    placed = salted_join(known, orgs, ["org"]).select("id", F.col("cluster").alias("org"), "name")
    named = materialise(placed.select("id", "org", _person_node("name").alias("name")), "person-names")
    nodes = _numbered(named.select("org", "name").distinct().withColumn("n", _full_words("name")), "person-nodes")
    full, short = nodes.filter("n >= 2"), nodes.filter("n = 1")
    keyed = _divided(materialise(full.select("node", F.explode(_full_keys("org", "name")).alias("key")), "full-blocks"), full)
    edges = materialise(_named_pairs(_pairs(keyed), full, full, "name").filter(_same_person(_common_words(full))("x", "y")).select("a", "b"), "full-pairs")
    discard(keyed)
    labels = materialise(components(full, edges), "full-people")
    joined = materialise(_attach(short, full.join(labels, "node")), "short-people")
    alone = short.join(joined, "node", "left_anti")
    # names of initials only: those of the same two or more initials and surnames a typing error apart are one;
    # one with a single initial joins the one of these that it fits
    counted = materialise(alone.withColumn("m", F.length(F.get_json_object("name", "$[1]"))), "alone")
    several = counted.filter("m >= 2")
    near_keys = materialise(several.select("node", F.explode(_surname_keys("org", "name")).alias("key")), "initial-blocks")
    twins = materialise(_named_pairs(_pairs(near_keys), several, several, "name").filter(_near_short("x", "y")).select("a", "b"), "initial-pairs")
    discard(near_keys)
    joined_several = components(several, twins)
    joined_short = materialise(_attach(counted.filter("m <= 1"), several.join(joined_several, "node")).unionByName(joined_several), "initials")
    rest = alone.join(joined_short, "node", "left_anti").select("node", F.col("node").alias("label"))
    everyone = labels.unionByName(joined).unionByName(joined_short).unionByName(rest).unionByName(nodes.filter("n = 0").select("node", F.col("node").alias("label")))
    placed_nodes = nodes.join(everyone, "node").select("org", "name", "label")
    return salted_join(named, placed_nodes, ["org", "name"]).select("id", F.col("label").alias("cluster")).distinct()


def linked_pairs(members: DataFrame, kind: str) -> DataFrame:
    """kind, key_a, key_b of members (key, cluster): the pairs asked for inside each cluster, smaller key first."""
    a = members.select("cluster", F.col("key").alias("key_a"))
    b = members.select("cluster", F.col("key").alias("key_b"))
    return a.join(b, "cluster").filter("key_a < key_b").select(F.lit(kind).alias("kind"), "key_a", "key_b").distinct()


def name_clusters(authors: DataFrame, affiliations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(persons, organisations), each key, cluster. Empty tables give no rows; null names and organisations are no cases."""
    orgs = materialise(org_clusters(authors.select("org").unionByName(affiliations.select("org"))), "orgs")
    people = materialise(person_clusters(authors, orgs), "people").withColumnRenamed("id", "key")
    places = affiliations.filter("aff_id is not null and org is not null").select("aff_id", "org").distinct().join(orgs, "org").select(F.col("aff_id").alias("key"), "cluster").distinct()
    return people, places


def variants(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """kind, key_a, key_b for persons and organisations."""
    people, places = name_clusters(authors, affiliations)
    return linked_pairs(people, "person").unionByName(linked_pairs(places, "org"))
