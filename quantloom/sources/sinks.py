"""Keyed upserts and exports on plain Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_wins(versions: list[DataFrame], keys: list[str], provenance: str | None = None) -> DataFrame:
    """Whole rows of the last version that holds a key. With ``provenance`` a row whose column is set
    is never replaced by one where it is null (a live capture by a backfill)."""
    out = None
    for i, v in enumerate(versions):
        v = v.withColumn("__seq", F.lit(i))
        out = v if out is None else out.unionByName(v, allowMissingColumns=True)
    order = ([F.col(provenance).isNotNull().desc()] if provenance else []) + [F.desc("__seq")]
    w = Window.partitionBy(*keys).orderBy(*order)
    return out.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__seq")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def create_table(spark: SparkSession, path: str, schema) -> None:
    """An empty table where there is none."""
    if not _exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)


def upsert(new: DataFrame, path: str, keys: list[str], partition: str = "dt", provenance: str | None = None) -> None:
    """Merges rows into a table partitioned by date; only the dates that ``new`` holds are read and written.

    The merged dates go to a folder beside the table first, so a failed write changes nothing.
    """
    spark = new.sparkSession
    if not _exists(spark, path):
        latest_wins([new], keys, provenance).write.partitionBy(partition).parquet(path)
        return
    touched = new.select(partition).distinct()
    old = spark.read.parquet(path).join(F.broadcast(touched), partition, "left_semi")  # one row a date
    stage = f"{path.rstrip('/')}__stage_{uuid.uuid4().hex}"
    latest_wins([old, new], keys, provenance).write.partitionBy(partition).parquet(stage)
    spark.read.parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def nested_as_text(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])


def nested_as_variant(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as VARIANT: kept with their types, read by path, whatever their fields are next time."""
    return df.select(*[F.to_variant_object(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])


def variant_fields(df: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` without the VARIANT column but with its ``fields`` {name: (path, type)}; what is absent or cannot be the type is NULL."""
    return df.select(*[c for c in df.columns if c != column], *[F.try_variant_get(column, path, kind).alias(name) for name, (path, kind) in fields.items()])


def wide_upsert(rows: DataFrame, path: str, keys: list[str], keep: DataFrame | None = None, variant: bool = False) -> None:
    """Upsert that adds unseen columns and never drops one; ``keep`` limits the tickers.

    Nested columns are stored as JSON text, or as VARIANT; one table takes one of them.
    """
    if keep is not None:
        rows = rows.join(F.broadcast(keep.select("ticker").distinct()), "ticker", "left_semi")
    rows = nested_as_variant(rows) if variant else nested_as_text(rows)
    spark = rows.sparkSession
    if _exists(spark, path):
        have = spark.read.option("mergeSchema", "true").parquet(path)
        rows = rows.unionByName(have.limit(0), allowMissingColumns=True)
    upsert(rows, path, keys)


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file of a small report."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_by_ticker(df: DataFrame, table: str, buckets: int = 512) -> None:
    """A bucketed table, so that per-ticker windows and joins need no shuffle."""
    df.write.bucketBy(buckets, "ticker").sortBy("ticker", "dt").mode("overwrite").saveAsTable(table)
