"""Citation records as quads, and the graphs of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "arnetminer-citation-network"
PAPER = ("id string, title string, year int, authors array<struct<id:string,name:string,org:string>>, venue struct<id:string,raw:string>, keywords array<string>, fos array<struct<name:string>>, "
         "references array<string>, page_start string, page_end string, doc_type string, lang string, publisher string, volume string, issue string, issn string, isbn string, doi string, pdf string, url array<string>, abstract string")
PAPER_V10 = "id string, title string, authors array<string>, venue string, year int, references array<string>, abstract string"
# Plain fields in the order they are emitted after the lists, doc_type as the type.
FIELDS = ["page_start", "page_end", "lang", "publisher", "volume", "issue", "issn", "isbn", "doi", "pdf", "abstract"]
# Tags of the text format; year and venue differ between the versions.
TAGS = {"v1": {"year": "t", "venue": "c"}, "v5": {"year": "year", "venue": "conf"}}


def read_papers(spark: SparkSession, path: str, version: str = "v11") -> DataFrame:
    return spark.read.schema(PAPER_V10 if version == "v10" else PAPER).json(path)


def read_tagged(spark: SparkSession, path: str, version: str = "v1") -> DataFrame:
    """id, title, authors, year, venue, references, abstract of the tagged text format; a record starts with #*."""
    tags = TAGS[version]
    rec = F.col("value")

    def one(tag: str) -> Column:
        found = F.regexp_extract(rec, rf"(?m)^#{tag}(.*)$", 1)
        return F.when(found != "", F.rtrim(found))

    title = F.rtrim(F.regexp_extract(rec, r"^([^\n]*)", 1))
    index = F.regexp_extract(rec, r"(?m)^#index(.*)$", 1)
    refs = F.filter(F.regexp_extract_all(rec, F.lit(r"(?m)^#%(.*)$"), F.lit(1)), lambda x: F.trim(x) != "")
    raw = spark.read.option("lineSep", "#*").text(path).filter(F.trim("value") != "")
    return raw.select(F.when(index != "", F.rtrim(index)).alias("id"), F.when(title != "", title).alias("title"), one("@").alias("authors"), one(tags["year"]).alias("year"),
                      one(tags["venue"]).alias("venue"), refs.alias("references"), one("!").alias("abstract"))


def literal(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), "[<>]", ""), F.lit('"'))


def venue_key(venue: Column) -> Column:
    """A venue's id, or a hash of its name."""
    return F.coalesce(venue["id"], F.md5(venue["raw"]))


def paper_quads(papers: DataFrame, year_column: bool = False) -> DataFrame:
    """(year,) s, p, o, g of the papers: optional fields where they hold something, references as IRIs, the rest as
    literals. Authors and venues give quads of their own. Each quad once; keywords carry the label reference."""
    none = F.array().cast("array<struct<s:string,p:string,o:string>>")

    def q(s: Column, p: str, o: Column) -> Column:
        return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))

    def each(c: str, f) -> Column:
        return F.coalesce(F.transform(c, f), none)

    me = F.col("id")
    single = [q(me, "year", literal(F.when(F.col("year") != 0, F.col("year")))), q(me, "title", literal(F.col("title"))), q(me, "type", F.when(F.col("doc_type") != "", F.col("doc_type")))]
    single += [q(me, f, literal(F.when(F.col(f) != "", F.col(f)))) for f in FIELDS]
    venue = F.col("venue")
    key = venue_key(venue)
    held = venue["raw"].isNotNull()
    venues = [q(me, "venue", F.when(held, key)), q(key, "type", F.when(held, F.lit("Venue"))), q(key, "name", F.when(held, literal(venue["raw"])))]
    lists = [
        each("authors", lambda a: q(me, "author", a["id"])),
        each("authors", lambda a: q(a["id"], "type", F.lit("Author"))),
        each("authors", lambda a: q(a["id"], "name", literal(a["name"]))),
        each("authors", lambda a: q(a["id"], "affiliation", literal(a["org"]))),
        each("keywords", lambda k: q(me, "reference", literal(k))),
        each("fos", lambda f: q(me, "field-of-study", literal(f["name"]))),
        each("references", lambda r: q(me, "reference", r)),
        each("url", lambda u: q(me, "url", literal(u))),
    ]
    everything = F.concat(F.array(*single, *venues), *lists)
    keep = ["year"] if year_column else []
    return papers.select(*keep, F.explode(everything).alias("q")).filter("q.s is not null and q.o is not null").select(*keep, "q.*", F.lit(SOURCE).alias("g")).distinct()


def quad_line() -> Column:
    """A valid N-Quads line of s, p, o, g; objects that are no literals become IRIs."""
    inner = F.regexp_replace(F.regexp_replace(F.expr("substr(o, 2, length(o) - 2)"), r"([\\\"])", r"\\$1"), "\n", r"\\n")
    inner = F.regexp_replace(inner, "\r", r"\\r")
    o = F.when(F.col("o").startswith('"'), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    return F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" <"), "g", F.lit("> ."))


def papers_per_year(papers: DataFrame) -> DataFrame:
    return papers.groupBy("year").agg(F.countDistinct("id").alias("papers"))


def cumulative(rows: DataFrame, order: str) -> DataFrame:
    """snapshot and the rows of all values of ``order`` up to it. The values are few (years); more than 10000 raise."""
    steps = [r[0] for r in rows.select(order).filter(F.col(order).isNotNull()).distinct().limit(10_001).collect()]
    if len(steps) > 10_000:
        raise ValueError("more than 10000 snapshots")
    if not steps:
        return rows.filter(F.lit(False)).select(F.col(order).alias("snapshot"), "*")
    later = F.filter(F.array(*[F.lit(x) for x in sorted(steps)]), lambda x: x >= F.col(order))
    return rows.filter(F.col(order).isNotNull()).select(F.explode(later).alias("snapshot"), *rows.columns)
