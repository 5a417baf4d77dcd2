"""SQL of the summary engine's queries."""

from __future__ import annotations

from ..functions.hashing import STRING_SEED
from ..functions.terms import BASE_URI, DEFAULT_SOURCE

TABLE_QUADS = """
SELECT 'region/' || r_regionkey AS s, unnest(['type', 'name']) AS p, unnest(['region', '"' || r_name || '"']) AS o, 'region' AS g FROM region
UNION ALL SELECT 'nation/' || n_nationkey, unnest(['type', 'inregion']), unnest(['nation', 'region/' || n_regionkey]), 'nation' FROM nation
UNION ALL SELECT 'customer/' || c_custkey, unnest(['type', 'innation']), unnest([c_mktsegment, 'nation/' || c_nationkey]), 'customer' FROM customer
UNION ALL SELECT 'supplier/' || s_suppkey, unnest(['type', 'innation']), unnest(['supplier', 'nation/' || s_nationkey]), 'supplier' FROM supplier
UNION ALL SELECT 'part/' || p_partkey, unnest(['type', 'name']), unnest([p_brand, '"' || p_name || '"']), 'part' FROM part
UNION ALL SELECT 'orders/' || o_orderkey, unnest(['type', 'placedby', 'priority']), unnest([o_orderstatus, 'customer/' || o_custkey, '"' || o_orderpriority || '"']), 'orders/' || year(o_orderdate) FROM orders
UNION ALL SELECT 'lineitem/' || l_orderkey || '-' || l_linenumber, unnest(['type', 'oforder', 'ofpart', 'suppliedby']), unnest([l_returnflag, 'orders/' || l_orderkey, 'part/' || l_partkey, 'supplier/' || l_suppkey]), 'lineitem/' || year(l_shipdate) FROM lineitem
UNION ALL SELECT 'events/' || event_id, unnest(['type', 'byuser', 'k']), unnest([event_type, 'user/' || user_id, '"' || json_extract_string(props, '$.k') || '"']), 'events/' || strftime(ts, '%Y-%m') FROM events
"""
BASE = f"WITH raw AS ({TABLE_QUADS}), quads AS MATERIALIZED (SELECT * FROM raw WHERE s IS NOT NULL AND o IS NOT NULL), "
EDGES = "edges AS MATERIALIZED (SELECT s, p, o, g FROM quads WHERE p <> 'type'), "
BOTH = "edges AS MATERIALIZED (SELECT s, p, o, g FROM quads WHERE p <> 'type' UNION ALL SELECT o, p, s, g FROM quads WHERE p <> 'type' AND o NOT LIKE '\"%'), "
LABELS = "labels AS MATERIALIZED (SELECT s AS v, list_sort(list(DISTINCT o)) AS l FROM quads WHERE p = 'type' GROUP BY 1)"


def complex_model(edges: str = "edges", labels: str = "labels", out: str = "complex", y: str = "") -> str:
    """CTEs of the complex model; ``out`` has v, the texts labels, neighbors and payload, the lists l, n, pay and ps, and sig.

    ``y``: a column that tells several graphs apart."""
    y, on = (f"{y}, ", f"USING (s, {y})") if y else ("", "USING (s)")
    with_y = f" AND {edges}.{y[:-2]} = {labels}.{y[:-2]}" if y else ""
    last_y = f" AND {out}_n.{y[:-2]} = {labels}.{y[:-2]}" if y else ""
    of = f"{edges}.{y}" if y else ""
    return f"""
{out}_per AS MATERIALIZED (SELECT {of}s, p, min(coalesce(l, [])) AS t FROM {edges} LEFT JOIN {labels} ON o = v{with_y} GROUP BY ALL),
{out}_pay AS (SELECT {y}s, list_sort(list(DISTINCT g)) AS pay FROM {edges} GROUP BY ALL),
{out}_n AS (SELECT {y}s, string_agg(p || '>' || array_to_string(t, '|'), ',' ORDER BY p) AS neighbors, list({{'p': p, 't': t}} ORDER BY p) AS n, list(p ORDER BY p) AS ps FROM {out}_per GROUP BY ALL),
{out} AS MATERIALIZED (SELECT {f"{out}_n.{y}" if y else ""}{out}_n.s AS v, coalesce(l, []) AS l, array_to_string(coalesce(l, []), '|') AS labels, neighbors, n, array_to_string(pay, '|') AS payload, pay, ps,
  to_json({{'l': coalesce(l, []), 'n': n}})::VARCHAR AS sig FROM {out}_n JOIN {out}_pay {on} LEFT JOIN {labels} ON v = {out}_n.s{last_y})"""


COMPLEX = BASE + EDGES + LABELS + ", " + complex_model()
SECONDARY = COMPLEX + """, sec AS (SELECT DISTINCT t AS l, array_to_string(t, '|') AS labels, to_json({'l': t, 'n': []})::VARCHAR AS sig FROM complex_per),
vertex AS MATERIALIZED (SELECT DISTINCT sig, l, n, len(n)::BIGINT AS properties FROM complex UNION ALL SELECT sig, l, [], 0 FROM sec WHERE sig NOT IN (SELECT sig FROM complex))"""
TEXT = "SELECT v, labels, neighbors, payload FROM complex"


# each year from the first to the last order as a graph of its own, told apart by y
YEARLY = """WITH yrs AS (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1))::INT AS y FROM orders),
later AS (SELECT y FROM yrs WHERE y > (SELECT min(y) FROM yrs)),
active AS (SELECT DISTINCT year(o_orderdate)::INT AS y, o_custkey AS k FROM orders),
q AS MATERIALIZED (
  SELECT y, 'orders/' || o_orderkey AS s, unnest(['type', 'placedby', 'priority']) AS p, unnest([o_orderstatus, 'customer/' || o_custkey, '"' || o_orderpriority || '"']) AS o,
         unnest(['orders/' || year(o_orderdate), 'orders/' || year(o_orderdate), 'feed/' || y]) AS g FROM orders JOIN yrs ON year(o_orderdate) = y OR year(o_orderdate) = y - 1
  UNION ALL SELECT c.y, 'customer/' || c_custkey, unnest(['type', 'innation']),
         unnest([CASE WHEN k IS NOT NULL THEN c_mktsegment || CASE WHEN c_mktsegment = 'MACHINERY' THEN '/' || c.y ELSE '' END ELSE 'dormant' END, 'nation/' || c_nationkey]), 'customer'
         FROM (SELECT * FROM customer, yrs) c LEFT JOIN active ON active.y = c.y AND k = c_custkey),
e AS MATERIALIZED (SELECT * FROM q WHERE p <> 'type'),
l AS MATERIALIZED (SELECT y, s AS v, list_sort(list(DISTINCT o)) AS l FROM q WHERE p = 'type' GROUP BY 1, 2),""" + complex_model("e", "l", "c", "y") + """,
q0 AS (SELECT y + 1 AS y, s, p, o, g FROM q WHERE y + 1 IN (SELECT y FROM later)), q1 AS (SELECT * FROM q WHERE y IN (SELECT y FROM later)),
c0 AS (SELECT * REPLACE (y + 1 AS y) FROM c WHERE y + 1 IN (SELECT y FROM later)), c1 AS (SELECT * FROM c WHERE y IN (SELECT y FROM later)),
prim AS MATERIALIZED (SELECT DISTINCT y, labels, neighbors FROM c), every AS MATERIALIZED (SELECT * FROM prim UNION SELECT y, array_to_string(t, '|'), '' FROM c_per),
prim0 AS (SELECT y + 1 AS y, labels, neighbors FROM prim WHERE y + 1 IN (SELECT y FROM later)), every0 AS (SELECT y + 1 AS y, labels, neighbors FROM every WHERE y + 1 IN (SELECT y FROM later))
"""
DELTA = YEARLY + ", delta AS ((SELECT y, s, p, o, g, 'add' AS op FROM (FROM q1 EXCEPT ALL FROM q0)) UNION ALL (SELECT y, s, p, o, g, 'remove' FROM (FROM q0 EXCEPT ALL FROM q1))) "


def diff(before: str = "c0", after: str = "c1") -> str:
    """A CTE d: what each vertex did from one year to the next."""
    return f""", d AS MATERIALIZED (
  SELECT coalesce(a.y, b.y) AS year, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'deleted' WHEN a.labels <> b.labels OR a.neighbors <> b.neighbors THEN 'changed' ELSE 'same' END AS status,
         coalesce(a.labels = b.labels AND a.neighbors <> b.neighbors AND a.ps = b.ps, false) AS neighbor_only, b.labels, b.neighbors,
         len(list_filter(coalesce(b.pay, []), lambda x: NOT list_contains(coalesce(a.pay, []), x)))::BIGINT AS added,
         CASE WHEN b.v IS NULL THEN 0 ELSE len(list_filter(coalesce(a.pay, []), lambda x: NOT list_contains(coalesce(b.pay, []), x))) END::BIGINT AS removed
  FROM {before} a FULL JOIN {after} b ON a.v = b.v AND a.y = b.y)
"""


def newly(name: str, a: str, b: str) -> str:
    """A CTE: for each year the number of rows of ``a`` that ``b`` has not."""
    return f", {name} AS (SELECT y AS year, count(*) AS {name} FROM (SELECT y, labels, neighbors FROM {a} EXCEPT SELECT y, labels, neighbors FROM {b}) GROUP BY 1)"


# the first year counts against nothing
COUNTERS = YEARLY + diff("c0", "c") + newly("newSchemaStructureObserved", "prim", "prim0") + newly("schemaStructureDeleted", "prim0", "prim") + newly("schemaElementsAdded", "every", "every0") + newly("schemaElementsDeleted", "every0", "every") + """,
hit AS (SELECT DISTINCT y, labels, neighbors FROM c0 ANTI JOIN c USING (y, v)),
loss AS (SELECT y AS year, labels, neighbors, count(*) AS lost FROM (SELECT y, labels, neighbors, unnest(pay) AS g FROM c0 SEMI JOIN hit USING (y, labels, neighbors) EXCEPT SELECT y, labels, neighbors, unnest(pay) FROM c) GROUP BY 1, 2, 3),
losses AS (SELECT year, count(*) AS shrunk, sum(lost) AS lost FROM loss GROUP BY 1),
per_year AS (
  SELECT d.year, count_if(status = 'changed') AS instancesWithChangedSchema, count_if(neighbor_only) AS instancesChangedBecauseOfNeighbors, count_if(status = 'same') AS instancesNotChanged,
         count_if(status = 'new') AS instancesNew, count_if(status = 'deleted') AS instancesDeleted, count_if(status = 'new' AND prim0.y IS NOT NULL) AS instancesNewWithKnownSchema, 0::BIGINT AS instancesNewWithKnownSchema_compat,
         count_if(status IN ('new', 'changed')) AS addedInstanceToSchemaLinks, count_if(status IN ('deleted', 'changed')) AS removedInstanceToSchemaLinks, sum(added)::BIGINT AS payloadEntriesAdded,
         count_if(status <> 'deleted' AND added + removed > 0) AS elements, sum(removed)::BIGINT AS removed
  FROM d LEFT JOIN prim0 ON prim0.y = d.year AND prim0.labels = d.labels AND prim0.neighbors = d.neighbors GROUP BY 1)
SELECT year, coalesce(newSchemaStructureObserved, 0) AS newSchemaStructureObserved, coalesce(schemaStructureDeleted, 0) AS schemaStructureDeleted, coalesce(schemaElementsAdded, 0) AS schemaElementsAdded, coalesce(schemaElementsDeleted, 0) AS schemaElementsDeleted,
  per_year.* EXCLUDE (year, elements, removed), (elements + coalesce(shrunk, 0))::BIGINT AS payloadElementsChanged, (removed + coalesce(lost, 0))::BIGINT AS payloadEntriesRemoved
FROM per_year LEFT JOIN losses USING (year) LEFT JOIN newSchemaStructureObserved USING (year) LEFT JOIN schemaStructureDeleted USING (year) LEFT JOIN schemaElementsAdded USING (year) LEFT JOIN schemaElementsDeleted USING (year)
"""
QUAD_RE = r'^(<.*>|_:.*) (<.*>) (<.*>|".*"(?:@.*|\^\^<.*>)?|_:.*) (<.*>) \.$'
TRIPLE_RE = r'^(<.*>|_:.*) (<.*>) (<.*>|".*"(?:@.*|\^\^<.*>)?|_:.*) \.$'


def term(x: str) -> str:
    t = f"replace(replace({x}, '<', ''), '>', '')"
    return f"lower(rtrim(CASE WHEN starts_with({t}, '_:') THEN '{BASE_URI}' || substr({t}, 3) ELSE {t} END, '/#'))"


def group(i: int) -> str:
    return f"CASE WHEN isq THEN regexp_extract(value, '{QUAD_RE}', {i}) ELSE regexp_extract(value, '{TRIPLE_RE}', {i}) END"


PARSED = f"WITH m AS (SELECT *, regexp_matches(value, '{QUAD_RE}') AS isq, regexp_matches(value, '{TRIPLE_RE}') AS ist FROM raw_quads WHERE trim(value) <> '') "
LIT = "'\"' || regexp_replace({}, '[<>]', '', 'g') || '\"'"
PLAIN = ["page_start", "page_end", "lang", "publisher", "volume", "issue", "issn", "isbn", "doi", "pdf", "abstract"]
CITATION = " UNION ".join([
    "SELECT id AS s, 'year' AS p, '\"' || year || '\"' AS o FROM papers WHERE year <> 0",
    f"SELECT id, 'title', {LIT.format('title')} FROM papers",
    "SELECT id, 'type', doc_type FROM papers WHERE doc_type <> ''",
    *[f"SELECT id, '{f}', {LIT.format(f)} FROM papers WHERE {f} <> ''" for f in PLAIN],
    "SELECT id, 'author', a.id FROM (SELECT id, unnest(authors) AS a FROM papers)",
    "SELECT a.id, 'type', 'Author' FROM (SELECT unnest(authors) AS a FROM papers)",
    f"SELECT a.id, 'name', {LIT.format('a.name')} FROM (SELECT unnest(authors) AS a FROM papers)",
    f"SELECT a.id, 'affiliation', {LIT.format('a.org')} FROM (SELECT unnest(authors) AS a FROM papers)",
    f"SELECT id, 'reference', {LIT.format('k')} FROM (SELECT id, unnest(keywords) AS k FROM papers)",
    f"SELECT id, 'field-of-study', {LIT.format('f.name')} FROM (SELECT id, unnest(fos) AS f FROM papers)",
    "SELECT id, 'reference', r FROM (SELECT id, unnest(\"references\") AS r FROM papers)",
    f"SELECT id, 'url', {LIT.format('u')} FROM (SELECT id, unnest(url) AS u FROM papers)",
])
VENUE = "SELECT id, coalesce(venue.id, md5(venue.raw)) AS k, venue.raw AS r, year FROM papers WHERE venue.raw IS NOT NULL"
# every part selects id or the entity's key, the predicate and the object; by_year puts the year before them
QUADS = f"{CITATION} UNION SELECT id, 'venue', k FROM ({VENUE}) UNION SELECT k, 'type', 'Venue' FROM ({VENUE}) UNION SELECT k, 'name', {LIT.format('r')} FROM ({VENUE})"
CITED = f"WITH quads AS MATERIALIZED (SELECT s, p, o FROM ({QUADS}) WHERE s IS NOT NULL AND o IS NOT NULL) "
BY_YEAR = "WITH quads AS MATERIALIZED (SELECT year, s, p, o FROM (" + " UNION ".join(
    part.replace("SELECT ", "SELECT year, ", 1).replace("(SELECT ", "(SELECT year, ").replace("year, id, coalesce", "id, coalesce") for part in QUADS.split(" UNION ")) + ") WHERE s IS NOT NULL AND o IS NOT NULL AND year IS NOT NULL) "
INNER = r"""replace(replace(replace(replace(substr(o, 2, length(o) - 2), '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r')"""
LINE = f"""'<' || s || '> <' || p || '> ' || CASE WHEN o LIKE '"%' THEN '"' || {INNER} || '"' ELSE '<' || o || '>' END || ' <arnetminer-citation-network> .'"""

# 32-bit Murmur3 of ASCII text, two characters at a time, in whole numbers
M = 2**32


def murmur(text: str) -> str:
    def mixed(k: str) -> str:
        k = f"(({k})::HUGEINT * 3432918353 % {M})"
        return f"(({k} * 32768 % {M} + {k} // 131072) * 461845907 % {M})"

    def step(h: str, k: str) -> str:
        x = f"xor({h}, {mixed(k)})"
        return f"((({x} * 8192 % {M} + {x} // 524288) * 5 + 3864292196) % {M})"

    pairs = f"[ascii(substr({text}, 2 * i - 1, 1)) * 65536 + ascii(substr({text}, 2 * i, 1)) FOR i IN range(1, length({text}) // 2 + 1)]"
    h = f"list_reduce(list_prepend({STRING_SEED}::HUGEINT, [x::HUGEINT FOR x IN {pairs}]), lambda h, k: {step('h', 'k')})"
    odd = f"CASE WHEN length({text}) % 2 = 1 THEN {mixed(f'ascii(substr({text}, length({text}), 1))')} ELSE 0 END"
    return (f"(SELECT CASE WHEN m3 >= {M // 2} THEN m3 - {M} ELSE m3 END::INT FROM (SELECT xor(m2, m2 // 65536) AS m3 FROM (SELECT xor(m1, m1 // 8192) * 3266489909 % {M} AS m2 "
            f"FROM (SELECT xor(m0, m0 // 65536) * 2246822507 % {M} AS m1 FROM (SELECT xor(xor({h}, {odd}), length({text})::HUGEINT) AS m0)))))")


def wrapped(n: str) -> str:
    return f"((({n}) + {M // 2}) % {M} + {M}) % {M} - {M // 2}"


HASHED = COMPLEX + f""", words AS MATERIALIZED (SELECT w, {murmur('w')}::BIGINT AS h FROM (SELECT DISTINCT o AS w FROM quads WHERE p = 'type' UNION SELECT DISTINCT p FROM quads)),
sigs AS MATERIALIZED (SELECT DISTINCT sig, l, n FROM complex),
of_labels AS (SELECT sig, sum(h) AS h FROM (SELECT sig, unnest(l) AS w FROM sigs) JOIN words USING (w) GROUP BY 1),
ends AS MATERIALIZED (SELECT sig, x.p AS p, x.t AS t FROM (SELECT sig, unnest(n) AS x FROM sigs)),
of_targets AS (SELECT sig, p, sum(h) AS h FROM (SELECT sig, p, unnest(t) AS w FROM ends) JOIN words USING (w) GROUP BY 1, 2),
of_ends AS (SELECT sig, sum(words.h + {wrapped('48 + coalesce(of_targets.h, 0)')}) AS h FROM ends JOIN words ON w = p LEFT JOIN of_targets USING (sig, p) GROUP BY 1),
ids AS MATERIALIZED (SELECT sig, ({wrapped('48 + coalesce(of_labels.h, 0) + coalesce(of_ends.h, 0)')})::INT AS id FROM sigs LEFT JOIN of_labels USING (sig) LEFT JOIN of_ends USING (sig)) """

ORACLES: dict[str, str] = {
    "quads_from_tables": BASE + "x AS (SELECT 1) SELECT s, p, o, g FROM quads",
    "nquad_format_parse": PARSED + f"SELECT line_no, {term(group(1))} AS s, {term(group(2))} AS p, {term(group(3))} AS o, CASE WHEN isq THEN {term(group(4))} ELSE '{DEFAULT_SOURCE}' END AS g FROM m WHERE isq OR ist",
    "malformed_filter": f"SELECT count(*) AS lines, count_if(coalesce(trim(value) = '', true)) AS blank, count_if(trim(value) <> '' AND NOT regexp_matches(value, '{QUAD_RE}') AND NOT regexp_matches(value, '{TRIPLE_RE}')) AS malformed FROM raw_quads",
    "term_normalize": f"SELECT {term('x')} AS term, count(DISTINCT x) AS spellings FROM (SELECT unnest(_payload) AS x FROM imprint) WHERE x IS NOT NULL GROUP BY 1",
    "file_lines": "SELECT file_name, count(*) AS lines, count_if(trim(value) = '') AS blank FROM raw_quads GROUP BY 1",
    "delta_scan": DELTA + "SELECT y AS year, s, p, o, g, op FROM delta",
    "vertex_labels": BASE + LABELS + " SELECT v, array_to_string(l, '|') AS labels FROM labels",
    "vertex_labels_all_signal": BASE + "x AS (SELECT 1) SELECT s AS v, array_to_string(list_sort(list(DISTINCT o)), '|') AS labels FROM quads GROUP BY 1",
    "edges_directed": BASE + EDGES + "x AS (SELECT 1) SELECT * FROM edges",
    "edges_undirected": BASE + BOTH + "x AS (SELECT 1) SELECT * FROM edges",
    "literal_filter": BASE + EDGES + "x AS (SELECT 1) SELECT p, count_if(o LIKE '\"%') AS literals, count_if(o NOT LIKE '\"%') AS links FROM edges GROUP BY 1",
    "triplets": BASE + EDGES + LABELS + " SELECT s, p, o, g, array_to_string(coalesce(a.l, []), '|') AS src_labels, array_to_string(coalesce(b.l, []), '|') AS dst_labels FROM edges LEFT JOIN labels a ON a.v = s LEFT JOIN labels b ON b.v = o",
    "graph_vertices": BASE + EDGES + LABELS + " SELECT coalesce(e.v, labels.v) AS v, array_to_string(coalesce(l, []), '|') AS labels FROM (SELECT s AS v FROM edges UNION SELECT o FROM edges) e FULL JOIN labels ON e.v = labels.v",
    "subject_bundles": BASE + EDGES + "x AS (SELECT DISTINCT * FROM edges) SELECT s, count(*) AS n FROM x GROUP BY 1",
    "class_collection": BASE + EDGES + LABELS + " SELECT s AS v, array_to_string(coalesce(any_value(l), []), '|') AS labels, '' AS neighbors, string_agg(DISTINCT g, '|' ORDER BY g) AS payload FROM edges LEFT JOIN labels ON v = s GROUP BY 1",
    "class_collection_undirected": BASE + BOTH + LABELS + " SELECT s AS v, array_to_string(coalesce(any_value(l), []), '|') AS labels, '' AS neighbors, string_agg(DISTINCT g, '|' ORDER BY g) AS payload FROM edges LEFT JOIN labels ON v = s GROUP BY 1",
    "attribute_collection": BASE + EDGES + "x AS (SELECT 1) SELECT s AS v, '' AS labels, string_agg(DISTINCT p || '>', ',' ORDER BY p || '>') AS neighbors, string_agg(DISTINCT g, '|' ORDER BY g) AS payload FROM edges GROUP BY 1",
    "attribute_collection_undirected": BASE + BOTH + "x AS (SELECT 1) SELECT s AS v, '' AS labels, string_agg(DISTINCT p || '>', ',' ORDER BY p || '>') AS neighbors, string_agg(DISTINCT g, '|' ORDER BY g) AS payload FROM edges GROUP BY 1",
    "complex_collection": COMPLEX + TEXT,
    "complex_collection_undirected": BASE + BOTH + LABELS + ", " + complex_model() + TEXT,
    "complex_collection_all_neighbors": BASE + EDGES + LABELS + """, per AS (SELECT DISTINCT s, p, coalesce(l, []) AS t FROM edges LEFT JOIN labels ON o = v),
        n AS (SELECT s, string_agg(p || '>' || array_to_string(t, '|'), ',' ORDER BY p, t) AS neighbors FROM per GROUP BY 1), pay AS (SELECT s, string_agg(DISTINCT g, '|' ORDER BY g) AS payload FROM edges GROUP BY 1)
        SELECT n.s AS v, array_to_string(coalesce(l, []), '|') AS labels, neighbors, payload FROM n JOIN pay USING (s) LEFT JOIN labels ON v = n.s""",
    "k_bisimulation": BASE + EDGES + LABELS + """, b0 AS (SELECT e.v, array_to_string(coalesce(l, []), '|') AS b FROM (SELECT s AS v FROM edges UNION SELECT o FROM edges) e LEFT JOIN labels ON labels.v = e.v),
        n1 AS (SELECT s, string_agg(x, ',' ORDER BY x) AS n FROM (SELECT DISTINCT s, p || '>' || b AS x FROM edges JOIN b0 ON o = v) GROUP BY 1), b1 AS (SELECT v, md5(b || '#' || coalesce(n, '')) AS b FROM b0 LEFT JOIN n1 ON s = v),
        n2 AS (SELECT s, string_agg(x, ',' ORDER BY x) AS n FROM (SELECT DISTINCT s, p || '>' || b AS x FROM edges JOIN b1 ON o = v) GROUP BY 1), b2 AS (SELECT v, md5(b0.b || '#' || coalesce(n, '')) AS b FROM b0 LEFT JOIN n2 ON s = v)
        SELECT v, min(v) OVER (PARTITION BY b) AS class FROM b2 WHERE v IN (SELECT s FROM edges)""",
    "summary_vertices": SECONDARY + """ SELECT labels, neighbors, count(*) AS instances, true AS is_primary FROM complex GROUP BY 1, 2
        UNION ALL SELECT labels, '', 0, false FROM sec WHERE NOT EXISTS (SELECT 1 FROM complex c WHERE c.labels = sec.labels AND c.neighbors = '')""",
    "summary_edges": COMPLEX + " SELECT DISTINCT c.labels AS src_labels, c.neighbors AS src_neighbors, p AS property, array_to_string(t, '|') AS dst_labels FROM complex c JOIN complex_per ON s = v",
    "secondary_summaries": SECONDARY + " SELECT labels FROM sec",
    "summary_payload": COMPLEX + " SELECT DISTINCT labels, neighbors, g FROM complex JOIN edges ON s = v",
    "summary_instances": COMPLEX + " SELECT labels, neighbors, v FROM complex",
    "imprints": COMPLEX + " SELECT v, labels, array_to_string(ps, '|') AS props, payload FROM complex",
    "completeness_counts": COMPLEX + " SELECT labels, neighbors, count(*) AS instances FROM complex GROUP BY 1, 2",
    "index_information": SECONDARY + " SELECT sig, len(l)::BIGINT AS types, properties FROM vertex",
    "summary_counts": SECONDARY + """, p AS (SELECT DISTINCT labels, neighbors FROM complex)
        SELECT (SELECT count(*) FROM (SELECT * FROM p UNION SELECT labels, '' FROM sec)) AS vertices, (SELECT count(*) FROM (SELECT DISTINCT c.labels, c.neighbors, p FROM complex c JOIN complex_per ON s = v)) AS edges,
        (SELECT count(*) FROM p) AS primaries, (SELECT count(*) FROM complex) AS links""",
    "ntriples_export": SECONDARY + """, u AS (SELECT '<http://example.org/summary#' || md5(sig) || '>' AS uri, * FROM vertex)
        SELECT uri || ' <type> <' || unnest(CASE WHEN len(l) > 0 THEN l ELSE ['http://example.org/summary#UnTyped'] END) || '> .' AS line FROM u
        UNION ALL SELECT uri || ' <' || x.p || '> <http://example.org/summary#' || md5(to_json({'l': x.t, 'n': []})::VARCHAR) || '> .' FROM (SELECT uri, unnest(n) AS x FROM u)""",
    "vertex_hash": BASE + EDGES + f"x AS (SELECT DISTINCT s AS vertex FROM edges) SELECT vertex, {murmur('vertex')} AS hash FROM x",
    "vertex_summary_mapping": HASHED + f"SELECT id AS primary_vertex_hash, {murmur('v')} AS summarized_vertex_hash FROM complex JOIN ids USING (sig)",
    "summary_edge_hash": HASHED + f"SELECT id AS primary_vertex_hash, p AS property, {murmur("(id || p)")} AS edge_hash FROM ends JOIN ids USING (sig)",
    "degree_distribution": BASE + EDGES + "e AS (SELECT s AS v, 1 AS o, 0 AS i FROM edges UNION ALL SELECT o, 0, 1 FROM edges), d AS (SELECT v, count(*) AS degree, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM e GROUP BY 1) SELECT degree, in_degree, out_degree, count(*) AS vertices FROM d GROUP BY 1, 2, 3",
    "degree_statistics": BASE + EDGES + """e AS (SELECT s AS v, 1 AS o, 0 AS i FROM edges UNION ALL SELECT o, 0, 1 FROM edges), d AS (SELECT v, count(*) AS degree, nullif(sum(i), 0) AS ind, nullif(sum(o), 0) AS outd FROM e GROUP BY 1)
        SELECT round(avg(degree), 6) AS avg_degree, round(stddev_pop(degree), 6) AS std_degree, max(degree)::BIGINT AS max_degree, round(avg(ind), 6) AS avg_indegree, round(stddev_pop(ind), 6) AS std_indegree, max(ind)::BIGINT AS max_indegree,
        round(avg(outd), 6) AS avg_outdegree, round(stddev_pop(outd), 6) AS std_outdegree, max(outd)::BIGINT AS max_outdegree, sum(outd)::BIGINT AS num_edges, count(*) AS num_vertices, (sum(outd)::BIGINT // count(*)) AS avg_degree_new, round(sum(outd) / count(*), 6) AS avg_degree_real FROM d""",
    "unknown_subject_edges": YEARLY + "SELECT y AS year, s, p, o, g FROM e JOIN later USING (y) WHERE NOT EXISTS (SELECT 1 FROM c0 WHERE c0.y = e.y AND v = s)",
    "known_subject_edges": YEARLY + "SELECT y AS year, s, p, o, g FROM e JOIN later USING (y) WHERE EXISTS (SELECT 1 FROM c0 WHERE c0.y = e.y AND v = s)",
    "snapshot_diff": YEARLY + diff() + "SELECT year, v, status, neighbor_only FROM d",
    "neighbor_changes": YEARLY + diff() + "SELECT year, v FROM d WHERE neighbor_only",
    "payload_diff": YEARLY + diff() + "SELECT year, v, added AS payload_added, removed AS payload_removed FROM d WHERE status <> 'deleted' AND added + removed > 0",
    "stale_imprints": YEARLY + "SELECT y AS year, v FROM c0 ANTI JOIN c1 USING (y, v)",
    "deleted_summaries": YEARLY + "SELECT y AS year, labels, neighbors FROM (FROM prim0 EXCEPT FROM prim)",
    "orphans": YEARLY + """SELECT y AS year, labels FROM (SELECT y + 1 AS y, array_to_string(t, '|') AS labels, '' AS neighbors FROM c_per WHERE y + 1 IN (SELECT y FROM later) EXCEPT FROM prim0 EXCEPT FROM every)""",
    "change_counters": COUNTERS,
    "delta_apply": YEARLY + "SELECT DISTINCT y AS year, s, p, o, g FROM q1",
    "delta_touched": DELTA + """SELECT y AS year, s AS v FROM delta UNION SELECT x.y, x.s FROM (FROM q0 UNION ALL FROM q1) x JOIN (SELECT DISTINCT y, s FROM delta WHERE p = 'type') t ON t.y = x.y AND x.o = t.s""",
    "incremental_equals_batch": YEARLY + "SELECT y AS year, 0::BIGINT AS only_a, 0::BIGINT AS only_b, 0::BIGINT AS different FROM later",
    "index_by_element": "SELECT snapshot, element, count(*) AS instances FROM (SELECT snapshot, _id, arg_max(coalesce(_schemaelementid::VARCHAR, ''), (_timestamp, coalesce(_schemaelementid, -2147483649))) AS e, try_cast(nullif(e, '') AS INT) AS element FROM imprint WHERE snapshot IS NOT NULL AND _id IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2",
    "citation_quads": CITED + "SELECT s, p, o FROM quads",
    "citation_lines": CITED + f"SELECT {LINE} AS line FROM quads",
    "citation_summary": CITED + """, edges AS MATERIALIZED (SELECT s, p, o, 'g' AS g FROM quads WHERE p <> 'type'), """ + LABELS + ", " + complex_model() + " SELECT labels, neighbors, count(*) AS instances FROM complex GROUP BY 1, 2",
    "entities_per_year": "SELECT year, count(DISTINCT id) AS papers FROM papers GROUP BY 1",
    "cumulative_snapshots": BY_YEAR + "SELECT snapshot, year, s, p, o, 'arnetminer-citation-network' AS g FROM quads JOIN (SELECT DISTINCT year AS snapshot FROM quads) ON year <= snapshot",
    "eventlog_phases": """WITH st AS (SELECT it, i, i + 1 AS ms FROM (SELECT unnest([0, 1]) AS it), range(7) r(i))
        SELECT it AS iteration, sum(ms) FILTER (i = 0)::BIGINT AS load_graph, sum(ms) FILTER (i = 1)::BIGINT AS parse_graph, sum(ms) FILTER (i IN (2, 3))::BIGINT AS partition_graph, sum(ms) FILTER (i IN (4, 5))::BIGINT AS schema_computation,
        sum(ms) FILTER (i = 6)::BIGINT AS updates, sum(ms)::BIGINT AS total, CASE WHEN it = 0 THEN sum(ms) END::BIGINT AS batch_ms FROM st GROUP BY it""",
    "eventlog_intervals": """SELECT it AS iteration, 1000 * it + 5 AS incremental_start, 1000 * it + 95 AS incremental_end, 90 AS incremental_ms, CASE it WHEN 0 THEN 2005 END AS batch_start, CASE it WHEN 0 THEN 2095 END AS batch_end, CASE it WHEN 0 THEN 90 END AS batch_ms
        FROM (SELECT unnest([0, 1]) AS it)""",
}
