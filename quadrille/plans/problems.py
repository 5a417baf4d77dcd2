"""Queries and SQL of the general data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nquads import LANG, PLAIN_IRI, PLAIN_TEXT, XSD
from ..functions.terms import BASE_URI
from ..operators.orphans import orphan_counts, orphan_references
from ..operators.packed import author_positions, unpack
from ..operators.rejects import loaded, parse_lines, rejected
from ..operators.snapshots import payload_set, snapshot_changes, snapshot_values
from ..operators.wide import filled_cells, wide_table
from ..runtime import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "imprint"))


def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("snapshot", "change").agg(F.count("*").alias("n"))


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with the schema elements and the normalised payloads (as text) before and after."""
    rows = snapshot_values(table(spark, sf_dir, "imprint"))
    text = {f"{x}_payload": F.array_join(payload_set(f"{x}__payload"), "|") for x in ("old", "new")}
    return rows.select("snapshot", "_id", "change", F.col("old__schemaelementid").alias("old_element"), F.col("new__schemaelementid").alias("new_element"),
                       F.when(F.col("change") != "added", text["old_payload"]).alias("old_payload"), F.when(F.col("change") != "removed", text["new_payload"]).alias("new_payload"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(spread(table(spark, sf_dir, "raw_quads")))


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spread(table(spark, sf_dir, "raw_quads")))


def p2_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(spread(table(spark, sf_dir, "raw_quads")), keep=["file_name"]).groupBy("file_name", F.coalesce("reason", F.lit("loaded")).alias("reason")).agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_positions(table(spark, sf_dir, "papers_v5"))


def p5_flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(table(spark, sf_dir, "papers_v5"), "authors", "id").groupBy("flawed").agg(F.count("*").alias("n"), F.countDistinct("id").alias("papers"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(table(spark, sf_dir, "papers"), table(spark, sf_dir, "paper_deletions"))


def p6_orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(p6_found(spark, sf_dir), "papers")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_cells(wide_table(table(spark, sf_dir, "paper_attributes")))


def p7_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_table(table(spark, sf_dir, "paper_attributes"))
    return wide.select("*",
                       F.size(F.coalesce("authors", F.array().cast("array<string>"))).cast("bigint").alias("n_authors"),
                       F.size(F.coalesce("fields_of_study", F.array().cast("array<string>"))).cast("bigint").alias("n_fields"))


def p7_wide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table as text: lists joined by a bar, rare labels as JSON in order of label."""
    wide = wide_table(table(spark, sf_dir, "paper_attributes")).drop("ordinal")
    joined = {c: F.array_join(c, "|") for c in ("authors", "fields_of_study")}
    return wide.withColumns(joined | {"extra": F.to_json(F.map_from_entries(F.array_sort(F.map_entries("extra"))))})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_change_counts, p1_values, p2_found, p2_loaded, p2_reason_counts, p5_found, p5_flawed, p6_found, p6_orphan_counts, p7_found, p7_wide, p7_wide_text)
}

P1 = f"""
WITH content AS (
  SELECT snapshot, _id, _timestamp, _schemaelementid AS e,
         coalesce(list_sort(list_distinct(list_transform(list_filter(coalesce(_payload, []), lambda x: x IS NOT NULL),
           lambda x: lower(rtrim(CASE WHEN starts_with(replace(replace(x,'<',''),'>',''), '_:')
             THEN '{BASE_URI}' || substr(replace(replace(x,'<',''),'>',''), 3)
             ELSE replace(replace(x,'<',''),'>','') END, '/#'))))), []) AS p
  FROM imprint WHERE snapshot IS NOT NULL AND _id IS NOT NULL),
h AS (SELECT snapshot, _id, arg_max(md5(to_json({{'p': p, 'e': e}})::VARCHAR), _timestamp) AS h, arg_max({{'p': p, 'e': e}}, _timestamp) AS x FROM content GROUP BY 1, 2),
n AS (SELECT snapshot, lag(snapshot) OVER (ORDER BY snapshot) AS before, lead(snapshot) OVER (ORDER BY snapshot) AS after FROM (SELECT DISTINCT snapshot FROM h)),
c AS (SELECT n.snapshot, h._id, h.h, h.x FROM h JOIN n USING (snapshot) WHERE before IS NOT NULL),
b AS (SELECT n.after AS snapshot, h._id, h.h, h.x FROM h JOIN n USING (snapshot) WHERE after IS NOT NULL),
found AS (
  SELECT coalesce(c.snapshot, b.snapshot)::INT AS snapshot, coalesce(c._id, b._id)::INT AS _id,
         CASE WHEN b.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'removed' WHEN b.h <> c.h THEN 'changed' END AS change,
         b.x.e AS old_element, c.x.e AS new_element, array_to_string(b.x.p, '|') AS old_payload, array_to_string(c.x.p, '|') AS new_payload
  FROM c FULL OUTER JOIN b ON c.snapshot = b.snapshot AND c._id = b._id)
"""
P6 = r"""
WITH first AS (SELECT id, min(delivered_at) AS fd FROM papers WHERE id IS NOT NULL AND delivered_at IS NOT NULL GROUP BY 1),
gone AS (SELECT id, min(deleted_at) AS dd FROM paper_deletions WHERE id IS NOT NULL AND deleted_at IS NOT NULL GROUP BY 1),
refs AS (SELECT DISTINCT id, regexp_replace(r, '^\s+|\s+$', '', 'g') AS ref_id FROM (SELECT id, unnest("references") AS r FROM papers WHERE delivered_at IS NOT NULL) WHERE r IS NOT NULL AND id IS NOT NULL),
judged AS (
  SELECT strftime(f.fd, '%Y-%m') AS period, refs.id, ref_id,
         CASE WHEN p.fd IS NULL THEN 'missing' WHEN p.fd >= date_trunc('month', f.fd) + INTERVAL 1 MONTH THEN 'late'
              WHEN g.dd < date_trunc('month', f.fd) + INTERVAL 1 MONTH THEN 'deleted' END AS kind
  FROM refs JOIN first f ON f.id = refs.id LEFT JOIN first p ON p.id = ref_id LEFT JOIN gone g ON g.id = ref_id)
"""
P7 = r"""
WITH base AS (
  SELECT id, lower(rtrim(replace(replace(label,'<',''),'>',''), '/#')) AS label, regexp_replace(attribute, '^\s+|\s+$', '', 'g') AS a, loaded_at FROM paper_attributes WHERE id IS NOT NULL),
bare AS (
  SELECT id, label, loaded_at, CASE WHEN regexp_full_match(a, '"(.*)"(@[A-Za-z0-9-]+|\^\^\S+)?', 's')
    THEN regexp_replace(regexp_extract(a, '^"(.*)"(@[A-Za-z0-9-]+|\^\^\S+)?$', 1, 's'), '^\s+|\s+$', '', 'g') ELSE a END AS v FROM base),
typed AS (
  SELECT id, label, loaded_at, CASE WHEN label IN ('year','volume','issue','page_start','page_end')
    THEN CASE WHEN regexp_full_match(v, '[+-]?[0-9]+(\.0*)?') THEN TRY_CAST(TRY_CAST(regexp_replace(v, '\..*$', '') AS BIGINT) AS INT)::VARCHAR END ELSE v END AS val
  FROM bare WHERE v <> '' AND label IN ('year','volume','issue','page_start','page_end','title','doc_type','lang','publisher','issn','doi')),
cell AS (SELECT id, label, arg_max(val, (loaded_at, val)) AS val FROM typed WHERE val IS NOT NULL GROUP BY 1, 2)
"""

# statements by one pattern; typed texts are held against the lexical spaces that occur in the tables
OBJECT = rf'<{PLAIN_IRI}>|_:[^\s<>"]+|"{PLAIN_TEXT}"(?:@{LANG}|\^\^<{PLAIN_IRI}>)?'
STATEMENT = rf'(<{PLAIN_IRI}>|_:[^\s<>"]+) (<{PLAIN_IRI}>) ({OBJECT})(?: (<{PLAIN_IRI}>))? \.'.replace("'", "''")
KIND = "regexp_replace(regexp_extract(o, '\"\\^\\^<([^>]*)>$', 1), '^(xsd:|http://www.w3.org/2001/XMLSchema#)', '')"
TYPED = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_full_match(val, '{XSD[k]}')" + (" AND try_cast(val[:10] AS DATE) IS NOT NULL" if k.startswith("date") else "") for k in ("integer", "decimal", "double", "float", "boolean", "gYear", "date", "dateTime", "nonNegativeInteger", "positiveInteger", "int", "long")) + " ELSE true END"
P2_LOADED = rf"""
WITH found AS (SELECT line_no, unnest(regexp_extract(value, '^{STATEMENT}$', ['s', 'p', 'o', 'g'])) FROM raw_quads WHERE regexp_full_match(value, '{STATEMENT}')),
typed AS (SELECT *, {KIND} AS kind, regexp_extract(o, '^"(.*)"\^\^<', 1) AS val FROM found)
SELECT line_no, s, p, o, nullif(g, '') AS g FROM typed WHERE NOT starts_with(o, '"') OR {TYPED}
"""

SINGLE_TEXTS, SINGLE_INTS = ["title", "doc_type", "lang", "publisher", "issn", "doi"], ["year", "volume", "issue", "page_start", "page_end"]
P7_WIDE = P7 + f""", several AS (
  SELECT id, label, v, min(loaded_at) AS seen FROM bare WHERE v <> '' AND label IS NOT NULL AND label NOT IN ({", ".join(f"'{x}'" for x in SINGLE_TEXTS + SINGLE_INTS)}) GROUP BY 1, 2, 3),
lists AS (SELECT id, string_agg(v, '|' ORDER BY seen NULLS FIRST, v) FILTER (label = 'author') AS authors, string_agg(v, '|' ORDER BY seen NULLS FIRST, v) FILTER (label = 'field-of-study') AS fields_of_study FROM several GROUP BY 1),
rare AS (SELECT id, label, list(v ORDER BY seen NULLS FIRST, v) AS vs FROM several WHERE label NOT IN ('author', 'field-of-study') GROUP BY 1, 2),
extra AS (SELECT id, '{{' || string_agg(to_json(label)::VARCHAR || ':' || to_json(vs)::VARCHAR, ',' ORDER BY label) || '}}' AS extra FROM rare GROUP BY 1),
wide AS (SELECT id, {", ".join(f"max(val) FILTER (label = '{x}') AS {x}" for x in SINGLE_TEXTS)}, {", ".join(f"(max(val) FILTER (label = '{x}'))::INT AS {x}" for x in SINGLE_INTS)} FROM cell GROUP BY 1)
SELECT coalesce(wide.id, lists.id) AS id, wide.* EXCLUDE (id), authors, fields_of_study, coalesce(extra, '{{}}') AS extra FROM wide FULL JOIN lists USING (id) LEFT JOIN extra ON extra.id = coalesce(wide.id, lists.id)
"""

ORACLES: dict[str, str] = {
    "p2_loaded": P2_LOADED,
    "p7_wide_text": P7_WIDE,
    "p1_values": P1 + "SELECT * FROM found WHERE change IS NOT NULL",
    "p1_found": P1 + "SELECT snapshot, _id, change FROM found WHERE change IS NOT NULL",
    "p1_change_counts": P1 + "SELECT snapshot, change, count(*) AS n FROM found WHERE change IS NOT NULL GROUP BY 1, 2",
    "p6_found": P6 + "SELECT * FROM judged WHERE kind IS NOT NULL",
    "p6_orphan_counts": P6 + "SELECT 'papers' AS tbl, period, kind, count(*) AS n FROM judged WHERE kind IS NOT NULL GROUP BY 2, 3",
    "p7_found": P7 + "SELECT * FROM cell",
}
