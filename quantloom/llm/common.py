"""Shared helpers of the corpus operators: Arrow access, ids, scratch tables.

Scratch tables live in the folder that the session names in
``spark.checkpoint.dir``: it is shared by the driver and all executors, so a lost
executor only costs the tasks it was running. A private folder is used only where
the session names none (tests, notebooks).
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Maps A-Z to a-z in UTF-8 bytes and leaves every other byte alone.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, or a private one where it names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("quantloom.scratch.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quantloom-')}"
        spark.conf.set("quantloom.scratch.dir", named)
    return named.rstrip("/")


#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of an Arrow batch to ``BATCH_BYTES``; a smaller one stays.

    Both sides of a Python stage hold whole batches, which at Spark's own bound (64 MB)
    costs each running task several times that.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Tables of one operator run, written to the shared folder and read back.

    Writing cuts the lineage and gives the reader file statistics. ``drop`` removes a
    table that no later plan reads; what the returned DataFrame still reads is left.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        p = self.path(name)
        df.write.parquet(p)
        out = self.spark.read.schema(df.schema).parquet(p)
        out._scratch_path = p
        return out

    def drop(self, df: DataFrame) -> None:
        p = getattr(df, "_scratch_path", None)
        if p:
            self.delete(p)

    def delete(self, p: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan (file sizes for a plain scan); 0 where it has none."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 56 else 0


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions so that each holds about ``bytes_each``; at least the session's shuffle count."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size_in_bytes(df) / bytes_each))


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if v is None else v for v in col.cast(pa.binary()).to_pylist()]


def rows_within(batches, max_bytes: int, col: int):
    """Slices of record batches so that column ``col`` holds at most ``max_bytes`` unless one row is larger."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            done = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, done + max_bytes, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi
    tidy()


def tidy() -> None:
    """Gives freed memory back: a worker process lives through many tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


class HashFilter:
    """A bounded number of bits, set at the hashes of a table of any size.

    Its size ends at 2^27 bits: on a larger table more foreign hashes pass, which costs
    later joins rows but never a result. ``of`` makes smaller ones for smaller tables.
    """

    LOG2_BITS = 27
    #: A filter has at least so many bits for each row of its table, up to the bound.
    BITS_A_ROW = 256

    def __init__(self, slices: dict[int, bytes], log2_bits: int = LOG2_BITS):
        self.log2_bits = log2_bits
        self.bits = np.zeros(1 << (log2_bits - 3), np.uint8)
        width = len(self.bits) >> 8
        for k, raw in slices.items():
            self.bits[k * width : (k + 1) * width] = np.frombuffer(raw, np.uint8)

    def place(self, h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - self.log2_bits)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.place(h)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def add(self, h: np.ndarray) -> None:
        at = self.place(h)
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    @classmethod
    def of(cls, df: DataFrame, col: str) -> HashFilter:
        """The filter of a long column; each of 256 slices is made by one group of hashes."""
        from pyspark.sql import functions as F

        log2_bits = min(cls.LOG2_BITS, max(12, (df.count() * cls.BITS_A_ROW).bit_length()))
        inner = log2_bits - 8

        def run(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                at = (b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - log2_bits)).astype(np.int64)
                for k in np.unique(at >> inner).tolist():
                    bits = held.get(k)
                    if bits is None:
                        bits = held[k] = np.zeros(1 << (inner - 3), np.uint8)
                    own = at[at >> inner == k] & ((1 << inner) - 1)
                    np.bitwise_or.at(bits, own >> 3, (1 << (own & 7)).astype(np.uint8))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()])], ["k", "bits"])
            tidy()

        sliced = df.select(col).repartition(F.shiftrightunsigned(F.col(col), 56)).mapInArrow(run, "k int, bits binary")
        return cls({r["k"]: r["bits"] for r in sliced.collect()}, log2_bits)  # 16 MB in all at most, whatever the table
