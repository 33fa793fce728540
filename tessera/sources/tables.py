"""Table sources and sinks: Parquet, CSV and JSON readers/writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table. Projection and filters applied later are pushed
    into this Parquet scan by Catalyst."""
    return dealt(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def dealt(df: DataFrame) -> DataFrame:
    """With ``tessera.scan.partitions`` set in the session, every scan is dealt
    to that many partitions; unset (as on a cluster), the scan stays as it is.
    For files of one row group, which no split size can cut; the plan depends on
    this setting alone, not on the input."""
    n = df.sparkSession.conf.get("tessera.scan.partitions", None)
    return df.repartition(int(n)) if n else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, limit: int | None = None) -> DataFrame:
    """Header CSV scan. Pass a schema in production; inference costs a full
    extra pass over the files."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.limit(limit) if limit is not None else df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multiline: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)
