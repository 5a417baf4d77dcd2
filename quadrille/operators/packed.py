"""Several values packed in one field, one row each with its position (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.packed import split_packed


@F.pandas_udf(T.StructType([T.StructField("vals", T.ArrayType(T.StringType())), T.StructField("flawed", T.BooleanType())]))
def _split(texts: pd.Series) -> pd.DataFrame:
    done = [split_packed(x) for x in texts]
    return pd.DataFrame({"vals": [v for v, _ in done], "flawed": [f for _, f in done]})


def unpack(df: DataFrame, field: str, *keys: str, value: str = "val") -> DataFrame:
    """keys..., pos (from 1), value, flawed for each value packed in ``field``; no rows for a null or blank field.

    Equal rows of (keys, field) are taken once, before the text is parsed. Long fields are
    parsed whole; a malformed quote flags all values of its field.
    """
    packed = df.select(*keys, field).filter(F.col(field).isNotNull()).distinct()
    parsed = packed.select(*keys, _split(field).alias("x"))
    return parsed.select(*keys, F.posexplode("x.vals").alias("pos", value), F.col("x.flawed").alias("flawed")).withColumn("pos", F.col("pos") + 1)


def author_positions(papers: DataFrame) -> DataFrame:
    """id, pos, author of papers_v5; rows with a null id keep it."""
    return unpack(papers, "authors", "id", value="author").select("id", F.col("pos").cast("int").alias("pos"), "author").distinct()
