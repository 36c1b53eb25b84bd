"""A data source of numbered result pages: one partition a page.

A page is JSON: {"success": true, "meta": {"last_page": n}, "data": [...]} (or data.data).
Pages lie at ``path`` with the page number for ``{page}``; a capture writes them there.

    spark.dataSource.register(PagedSource)
    spark.read.format("pages").schema("symbol string, close double").option("path", "/landed/{page}.json").load()

Reading stops at the last page that the first one names, at ``max_pages``, and before the
first page that failed: absent, unreadable or without success. Whether a page failed is
known only where it is read, so every page tells it, and :func:`read_paged` cuts there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Pages that are read at most, unless the reader is told otherwise.
MAX_PAGES = 25


def fetch(path: str, page: int) -> dict | None:
    """A page, or None if it failed. Any file system that Arrow knows by its URI."""
    from pyarrow import fs

    at = path.replace("{page}", str(page))
    try:
        system, name = fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at)
        with system.open_input_stream(name) as f:
            got = json.loads(f.read())
    except (OSError, ValueError):
        return None
    return got if isinstance(got, dict) and got.get("success") else None


class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = schema.fieldNames()
        self.types = {f.name: f.dataType.typeName() for f in schema.fields}
        self.path = options["path"]
        self.max_pages = int(options.get("maxpages", options.get("maxPages", MAX_PAGES)))

    def partitions(self) -> list[InputPartition]:
        first = fetch(self.path, 1)
        last = ((first or {}).get("meta") or {}).get("last_page", 1)
        return [_Page(k) for k in range(1, max(1, min(int(last), self.max_pages)) + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        got = fetch(self.path, partition.page)
        if got is None:
            yield (partition.page, False, *(None for _ in self.fields[2:]))
            return
        rows = got.get("data")
        rows = (rows.get("data") if isinstance(rows, dict) else rows) or []
        for r in rows:
            yield (partition.page, True, *(self._value(c, r.get(c)) for c in self.fields[2:]))

    def _value(self, name: str, v):
        """A JSON number or text as the declared type; what it cannot be is NULL."""
        if v is None:
            return None
        kind = self.types[name]
        try:
            if kind in ("double", "float"):
                return float(v)
            if kind in ("long", "integer", "short", "byte"):
                return int(v)
            if kind == "boolean":
                return v if isinstance(v, bool) else None
            if kind == "string":
                return v if isinstance(v, str) else json.dumps(v)
        except (TypeError, ValueError):
            return None
        return v


class PagedSource(DataSource):
    """``pages``: the columns asked for, after page and success."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_paged(spark: SparkSession, path: str, schema: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """Rows with their page of all pages before the first that failed."""
    spark.dataSource.register(PagedSource)
    d = spark.read.format("pages").schema(f"page int, success boolean, {schema}").option("path", path).option("maxPages", str(max_pages)).load()
    failed = d.agg(F.min(F.when(~F.col("success"), F.col("page"))).alias("__failed"))
    return d.join(F.broadcast(failed)).where(F.col("success") & (F.col("__failed").isNull() | (F.col("page") < F.col("__failed")))).drop("__failed", "success")  # one row
