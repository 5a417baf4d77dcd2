"""RDF terms: patterns, normalisation and the bulk parse of lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of a quad and a triple line, greedy, and the default URIs.
SUBJECT = r"(<.*>|_:.*)"
LABEL = r"(<.*>)"
OBJECT = r'(<.*>|".*"(@.*|\^\^<.*>)?|_:.*)'
QUAD = rf"^{SUBJECT} {LABEL} {OBJECT} (<.*>) \.$"
TRIPLE = rf"^{SUBJECT} {LABEL} {OBJECT} \.$"
BASE_URI = "http://informatik.uni-kiel.de/fluid#"
DEFAULT_SOURCE = "http://informatik.uni-kiel.de"


def normalise(term: Column | str, base_uri: str = BASE_URI) -> Column:
    """Angle brackets off, blank node prefix to the base URI, trailing / and # off, lower case. Null stays null."""
    c = F.col(term) if isinstance(term, str) else term
    c = F.translate(c, "<>", "")
    c = F.when(c.startswith("_:"), F.concat(F.lit(base_uri), F.substring(c, 3, 1 << 30))).otherwise(c)
    return F.lower(F.rtrim(c, F.lit("/#")))


def is_literal(term: str) -> Column:
    return F.col(term).startswith('"')


#: Stands between the groups of a match; a line that holds it is malformed.
MARK = "\x01"


def line_terms(line: str = "value") -> Column:
    """The terms of a line as written, [s, p, o, g] of a quad or [s, p, o] of a triple; null if it is neither.

    The quad pattern is tried first. Each pattern runs once: a match is rewritten to its groups with a mark between.
    """
    c = F.when(~F.contains(F.col(line), F.lit(MARK)), F.col(line))
    quad = F.regexp_replace(c, QUAD, MARK.join(["$1", "$2", "$3", "$5"]))
    triple = F.regexp_replace(c, TRIPLE, MARK.join(["$1", "$2", "$3"]))
    return F.split(F.coalesce(F.nullif(quad, c), F.nullif(triple, c)), MARK)


def parsed_terms(terms: Column, base_uri: str = BASE_URI, default_source: str = DEFAULT_SOURCE) -> list[Column]:
    """s, p, o, g, normalised. A triple gets the default source, which is not normalised."""
    out = [normalise(terms[i], base_uri).alias(n) for i, n in enumerate("spo")]
    return [*out, F.when(F.size(terms) > 3, normalise(F.get(terms, F.lit(3)), base_uri)).otherwise(F.lit(default_source)).alias("g")]
