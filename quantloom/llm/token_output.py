"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on ids.

``write_token_orc`` range-partitions the documents by id, encodes each once and writes
one ORC file per range, so file order is id order. ORC stores the id arrays with
run-length encoded integers, keeps min/max per stripe and row group, and a Bloom filter
on ``doc_id``. ``read_tokens`` prunes files, stripes and row groups by those; every
stripe can be read by a task of its own.

Defined cases: null text is empty (only the end id); rows without an id come first;
rows that share an id are all written, in the order of their texts (null first); an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions_for, rows_within
from .word_cache import ByteBpe

END_ID = 2
SCHEMA = "doc_id long, file_start long, n_tokens long, ids array<int>"
_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder a worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start = encoder(path), 0
        for b in rows_within(batches, 4 << 20, 1):
            ids = [enc.encode(t or "") + tail for t in b.column(1).to_pylist()]
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ends = np.cumsum(n)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(start + ends - n), pa.array(n), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "file_start", "n_tokens", "ids"])
            start += int(ends[-1])

    return run


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", bytes_per_file: int = 64 << 20) -> None:
    """Writes ids of every text, in ascending id order over the files, to ``path``."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = plain.repartitionByRange(partitions_for(plain, bytes_per_file), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ranged.mapInArrow(_encode(tokenizer_path, end_id), SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(8 << 20))
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, file_start, n_tokens, ids); with ``doc_ids``, only those, pruned by ORC metadata."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def part_number(name: str = "_metadata.file_name"):
    """The number of the task that wrote a file; as text, part-100000 would sort before part-99999."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids in the files before each file. One row a file; files are bounded by bytes."""
    totals = spark.read.schema(SCHEMA).orc(path).groupBy(part_number().alias("part")).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            at, raw = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64()), b.column(4)], ["doc_id", "file_start", "n_tokens", "ids_crc32", "part"])

    rows = spark.read.schema(SCHEMA).orc(path).select("doc_id", "file_start", "n_tokens", "ids", part_number().alias("part"))
    rows = rows.mapInArrow(run, "doc_id long, file_start long, n_tokens long, ids_crc32 long, part long")
    # only counts and checksums meet the starts, no ids
    return rows.join(file_starts(spark, path), "part").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def token_orc_query(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("orc")
    write_token_orc(docs, path, tokenizer_path)
    return token_digest(spark, path)
