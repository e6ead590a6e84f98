"""What the operators share: tables, cut lineage and the word rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one where none is set, as in tests on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cohortry-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again; for what is used more than once."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.saved_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what `saved` wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text, [] for null or none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def meet(rows: DataFrame, few: DataFrame, key: str, by: Column, most: int, parts: int) -> DataFrame:
    """rows with the columns of few (one row a key, null being one), null where few lacks the key.

    few is broadcast up to `most` bytes, which are measured; beyond, each key's rows meet it in `parts` parts (told by the hash `by`), so
    a key with a third of all rows isn't one task.
    """
    few = few.withColumnRenamed(key, "_key")
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) * F.greatest(F.size(c), F.lit(0)) if kind.startswith("array<bigint") else F.lit(8) for c, kind in few.dtypes]
    weight = few.agg(F.sum(sum(sizes, F.lit(64)))).first()[0] or 0
    if weight <= most:
        return rows.join(F.broadcast(few), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    few = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.withColumn("_own", F.pmod(by, F.lit(parts)).cast("int"))
    return rows.join(few, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_part")), "left").drop("_key", "_part", "_own")
