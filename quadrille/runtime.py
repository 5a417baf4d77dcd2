"""Session helpers: the shared folder, lineage cuts and joins that stand skewed keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is split when it may hold at least this share of the rows; so at most 1/share keys are.
HEAVY_SHARE = 0.005
#: How many ways a heavy key is split.
SALTS = 32
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (local tests) a temporary folder is made and used; on a cluster
    without the setting this raises, as a machine's own folder would be lost with it.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf is None and have.isDefined():
        conf = have.get()
    if conf is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if have.isEmpty():
        sc.setCheckpointDir(conf)
    return conf.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/quadrille/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes what this process stored in the shared folder; returns how many paths. Results that
    were not written elsewhere can't be read any more."""
    n = len(_made)
    while _made:
        remove_path(spark, _made.pop())
    return n


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes what ``materialise`` stored, once nothing that is still to be computed reads it."""
    for df in stored:
        remove_path(df.sparkSession, df._stored_at)
        _made.remove(df._stored_at)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, in order; none if it is missing."""
    p, fs = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears whole or not at all: written aside, then renamed."""
    p, fs = _fs(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(aside, p):
        raise OSError(f"could not write {path}")


def read_note(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy_hashes(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> list[int]:
    """Hashes of all keys that hold at least ``share`` of the rows; at most 1/share of them.

    Frequent items are counted in one pass with a bounded table (no shuffle); none that
    reaches the share is missed, some below it may be listed, which does no harm.
    """
    row = df.select(F.xxhash64(*keys).alias("h")).freqItems(["h"], share).first()
    return [x for x in (row[0] or []) if x is not None] if row else []


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """Equi join in which heavy keys of ``left`` are spread over ``salts`` tasks.

    ``right`` should be unique (or small) per key: only its rows of heavy keys, at most
    1/share keys, are repeated. ``how``: inner, left, left_semi, left_anti.
    """
    heavy = heavy_hashes(left, keys, share)
    if not heavy:
        return left.join(right, keys, how)
    hot: Column = F.xxhash64(*keys).isin(heavy)
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    left = left.withColumn("__salt", F.when(hot, spread).otherwise(F.lit(0)))
    right = right.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join of a side with hot keys and one unique per key. Adaptive execution splits the hot partitions
    at run time where it is on; else they are salted, at the cost of a pass that finds them."""
    conf = left.sparkSession.conf
    if all(conf.get(f"spark.sql.adaptive.{x}", "true") == "true" for x in ("enabled", "skewJoin.enabled")):
        return left.join(right, keys, how)
    return salted_join(left, right, keys, how)


def spread(df: DataFrame) -> DataFrame:
    """A scan that comes in fewer partitions than there are cores (few row groups) is dealt to all cores before
    costly work on its rows; a scan of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per session, for those that cannot import it from a shared path."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_quadrille_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quadrille-zip-"), "quadrille.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("quadrille", os.path.relpath(p, root)))
    sc.addPyFile(out)
    sc._quadrille_shipped = True
