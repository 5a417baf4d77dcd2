"""N-Quads and N-Triples as quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SummaryConfig
from ..functions.terms import line_terms, parsed_terms


def quads_from_lines(lines: DataFrame, config: SummaryConfig = SummaryConfig(), line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """keep..., s, p, o, g of the lines that parse. Null, blank and malformed lines are dropped."""
    full = lines.filter(F.trim(F.col(line)) != "")
    once = F.explode(F.filter(F.array(line_terms(line)), lambda t: t.isNotNull()))  # so that no pattern is run again for the filter
    return full.select(*(keep or []), once.alias("t")).select(*(keep or []), *parsed_terms(F.col("t"), config.base_uri, config.default_source))


def corrupt_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines, blank, malformed: one row of counts."""
    q = line_terms(line)
    blank = F.coalesce(F.trim(F.col(line)) == "", F.lit(True))
    return lines.agg(F.count("*").alias("lines"), F.count_if(blank).alias("blank"), F.count_if(~blank & q.isNull()).alias("malformed"))


def read_nquads(spark: SparkSession, paths: str | list[str], config: SummaryConfig = SummaryConfig()) -> DataFrame:
    """Quads of text files; gzip is read as it is (one task a file, so deliver many)."""
    return quads_from_lines(spark.read.text(paths), config)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """value, file of the .gz files named *data* or *nt.gz* in a folder, and *data* one level below."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    below = [x.getPath().toString() for x in found if x.isDirectory()]
    both = spark.read.option("pathGlobFilter", "*{data,nt.gz}*").text(folder)
    if below:
        both = both.unionByName(spark.read.option("pathGlobFilter", "*data*").text(below))
    return both.select("value", F.input_file_name().alias("file")).filter(F.col("file").endswith(".gz"))


def read_delta(spark: SparkSession, folder: str, name: str, config: SummaryConfig = SummaryConfig()) -> tuple[DataFrame, DataFrame]:
    """(additions, removals) of the files additions_<name> and removals_<name>; a missing one is empty."""

    def part(prefix: str) -> DataFrame:
        try:
            return read_nquads(spark, f"{folder}/{prefix}_{name}", config)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], "s string, p string, o string, g string")

    return part("additions"), part("removals")
