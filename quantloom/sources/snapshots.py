"""Keyed tables as snapshots: an upsert that a crash at any point leaves either done or undone.

Data files are never changed. A version writes the partitions it touches into a folder of
its own; a manifest then names, for every partition, the folder that holds it now. The
manifest becomes the table's by one rename to a name that must not exist yet, so of two
writers of one version the second fails and may try again, and a reader sees the last
version that was committed, whole. Folders that no manifest names are what a writer left
that did not come so far; :func:`vacuum` removes them with versions that are old.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import latest_wins

#: Stands for the partition of rows without a partition value.
NO_VALUE = "__none__"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first; none where there is no table."""
    fs, at = _fs(spark, path)
    folder = at(f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{"schema": DDL, "parts": {partition: folder}} of a version, the last one unless it is named."""
    known = versions(spark, path)
    if not known:
        return {"schema": None, "parts": {}}
    fs, at = _fs(spark, path)
    stream = fs.open(at(f"{path}/manifests/{known[-1] if version is None else version}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_snapshot(spark: SparkSession, path: str, partitions: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The rows of a version; only the named partitions are opened. Columns that old files lack are NULL."""
    m = manifest(spark, path, version)
    if m["schema"] is None:
        raise FileNotFoundError(f"no version of {path} is committed")
    folders = [f"{path}/{f}" for k, f in sorted(m["parts"].items()) if partitions is None or k in partitions]
    return spark.read.schema(m["schema"]).parquet(*folders) if folders else spark.createDataFrame([], m["schema"])


def _commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Makes a manifest the table's by renaming it to its version, which must not exist."""
    fs, at = _fs(spark, path)
    fs.mkdirs(at(f"{path}/manifests"))
    draft = at(f"{path}/manifests/.{version}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), sc._jsc.hadoopConfiguration()) if draft.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(sc._jsc.hadoopConfiguration())
    never = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context.rename(draft, at(f"{path}/manifests/{version}.json"), never)


def _part(partition: str):
    return F.coalesce(F.col(partition).cast("string"), F.lit(NO_VALUE))


def stage(new: DataFrame, path: str, keys: list[str], partition: str = "dt", provenance: str | None = None) -> tuple[int, dict]:
    """Writes the merged partitions that ``new`` touches into a new folder: the version and manifest to commit.

    Columns that the table does not have yet are added, those that ``new`` lacks stay.
    """
    spark = new.sparkSession
    known, m = versions(spark, path), manifest(spark, path)
    folder = f"data/{uuid.uuid4().hex}"
    if m["schema"] is None:
        merged = latest_wins([new], keys, provenance)
    else:
        touched = [r[0] for r in new.select(_part(partition).alias("p")).distinct().collect()]  # one row a partition
        old = read_snapshot(spark, path, touched)
        merged = latest_wins([old, new], keys, provenance)
    merged.withColumn("__part", _part(partition)).write.partitionBy("__part").parquet(f"{path}/{folder}")
    fs, at = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at(f"{path}/{folder}")) if s.isDirectory()]
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    parts = m["parts"] | {unescape(n.removeprefix("__part=")): f"{folder}/{n}" for n in names if n.startswith("__part=")}
    ddl = ", ".join(f"`{c}` {t}" for c, t in merged.dtypes)
    return (known[-1] if known else 0) + 1, {"schema": ddl, "parts": parts}


def upsert_snapshot(new: DataFrame, path: str, keys: list[str], partition: str = "dt", provenance: str | None = None) -> int:
    """Merges rows by key, whole rows of the last writer, and returns the version. Only touched partitions are read and written."""
    version, content = stage(new, path, keys, partition, provenance)
    _commit(new.sparkSession, path, version, content)
    return version


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes versions but the last ``keep`` and the folders that none of these names; returns how many folders went.

    Not to be run beside a writer, whose folder no manifest names yet.
    """
    known = versions(spark, path)
    fs, at = _fs(spark, path)
    used = {f.split("/")[1] for v in known[-keep:] for f in manifest(spark, path, v)["parts"].values()}
    for v in known[:-keep]:
        fs.delete(at(f"{path}/manifests/{v}.json"), False)
    gone = [s.getPath() for s in fs.listStatus(at(f"{path}/data")) if s.getPath().getName() not in used]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
