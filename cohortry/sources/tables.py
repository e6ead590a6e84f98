"""Reading and writing relations: files, tables, partitions, upserts, materialisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import upsert

KINDS = {"object": T.StringType(), "int64": T.LongType(), "int32": T.IntegerType(), "float64": T.DoubleType(), "float32": T.FloatType(), "bool": T.BooleanType(), "datetime64[ns]": T.TimestampType()}


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return read(spark, path, "csv", schema, header="true", **({} if schema is not None else {"inferSchema": "true"}))


def schema_of(pdf: pd.DataFrame) -> T.StructType:
    """A schema from column types, so a column without values isn't guessed; unknown types are text, all may be null."""
    return T.StructType([T.StructField(str(c), KINDS.get(str(t), T.StringType()), True) for c, t in pdf.dtypes.items()])


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, schema: T.StructType | None = None) -> DataFrame:
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), schema or schema_of(pdf))


def write_table(df: DataFrame, name: str, mode: str = "append", form: str = "parquet", partition: tuple[str, object] | None = None) -> None:
    """Saves df as a table, with a constant partition column if given."""
    if partition:
        df = df.withColumn(partition[0], F.lit(partition[1]))
    writer = df.write.mode(mode).format(form)
    (writer.partitionBy(partition[0]) if partition else writer).saveAsTable(name)


def overwrite_partition(df: DataFrame, name: str, column: str, value: object, form: str = "parquet") -> None:
    """Puts df in place of one partition of a table, which is created if it isn't there; other partitions stay."""
    spark = df.sparkSession
    df = df.drop(column).withColumn(column, F.lit(value))
    if not spark.catalog.tableExists(name):
        df.write.format(form).partitionBy(column).saveAsTable(name)
        return
    columns = spark.table(name).columns
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        df.select(*columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(key, before)


def upsert_table(new: DataFrame, name: str, keys: Sequence[str], partition: str | None = None) -> None:
    """Rows of new in place of the table's rows with their keys.

    With a partition column (one of the keys) only the partitions that new touches are written. Else the table is made anew beside the
    old one and takes its name; a crash leaves one of both complete, the old one as <name>_before at worst.
    """
    spark = new.sparkSession
    old = spark.table(name)
    if partition is not None:
        if partition not in keys:
            raise ValueError(f"{partition} has to be one of the keys")
        touched = [r[0] for r in new.select(partition).distinct().collect()]
        merged = upsert(old.where(F.col(partition).isin(touched)), new, keys).select(*old.columns)
        merged = merged.checkpoint() if spark.sparkContext.getCheckpointDir() else merged.persist()
        merged.count()
        key = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(key)
        spark.conf.set(key, "dynamic")
        try:
            merged.write.mode("overwrite").insertInto(name)
        finally:
            spark.conf.set(key, before)
        return
    upsert(old, new, keys).select(*old.columns).write.mode("overwrite").saveAsTable(f"{name}_next")
    spark.sql(f"DROP TABLE IF EXISTS {name}_before")
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}_before")
    spark.sql(f"ALTER TABLE {name}_next RENAME TO {name}")
    spark.sql(f"DROP TABLE {name}_before")


@dataclass(frozen=True)
class Materialization:
    """How a relation is kept: overwrite, incremental (one partition), or temp_view."""

    kind: str = "overwrite"
    partition_col: str | None = None
    partition_value: object = None

    def __post_init__(self) -> None:
        if self.kind not in ("overwrite", "incremental", "temp_view", "if_absent"):
            raise ValueError(f"unknown materialization {self.kind}")
        if self.kind == "incremental" and (self.partition_col is None or self.partition_value is None):
            raise ValueError("incremental needs a partition column and value")

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        if self.kind == "temp_view":
            df.createOrReplaceTempView(name)
        elif self.kind == "incremental":
            overwrite_partition(df, name, self.partition_col, self.partition_value)
        else:
            df.write.mode("ignore" if self.kind == "if_absent" else "overwrite").saveAsTable(name)
        return df.sparkSession.table(name)
