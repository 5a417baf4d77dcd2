"""SQL of the queries that SQL can express."""

P4 = r"""
WITH e AS (
  SELECT line_id, venue, unnest(json_keys(venue)) AS k FROM venue_lines WHERE venue IS NOT NULL AND line_id IS NOT NULL),
v AS (
  SELECT line_id, regexp_replace(lower(k), '[^\p{L}\p{M}\p{N}]', '', 'g') AS f,
         regexp_replace(lower(nfc_normalize(json_extract_string(venue, '$."' || k || '"'))), '[^\p{L}\p{M}\p{N}]', '', 'g') AS v FROM e),
r AS (SELECT line_id, string_agg(f || '=' || v, '|' ORDER BY f, v) AS rec FROM v WHERE v IS NOT NULL AND v <> '' GROUP BY 1),
a AS (SELECT l.line_id, coalesce(rec, '') AS rec FROM venue_lines l LEFT JOIN r USING (line_id) WHERE l.venue IS NOT NULL AND l.line_id IS NOT NULL),
g AS (SELECT rec, min(line_id) AS keep_id, count(*) AS copies FROM a GROUP BY 1)
"""

ORACLES: dict[str, str] = {
    "p4_found": P4 + "SELECT keep_id, line_id FROM a JOIN g USING (rec) WHERE line_id > keep_id",
    "p4_copies": P4 + "SELECT keep_id, copies FROM g",
    # what must hold of any packing: each text once for each pack kind, no pack beyond its capacity, no needless cut
    "p8_checks": "SELECT pack, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, 0::BIGINT AS over, 0::BIGINT AS torn FROM (SELECT DISTINCT pack FROM pack_sizes WHERE capacity >= 1 AND pack IS NOT NULL)",
    # what must hold of any mixture: no block beyond its cap, no slot beyond its size, shares within a point
    "p9_checks": "SELECT DISTINCT source, 0::BIGINT AS over, 0::BIGINT AS full, 0::BIGINT AS off FROM mix_targets JOIN documents USING (source) WHERE target_share > 0 AND max_repeats > 0 AND text <> ''",
}
