"""A paged source: a page for each offset, read side by side; the first short page is the end."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .feeds import MAX_PAGES, PAGE

FETCHERS: dict[str, Callable[[dict], Callable[[int, int], list]]] = {}
#: How many rows a source has, of those sources that can tell.
SIZES: dict[str, Callable[[dict], int]] = {}


def _dataset(where: str):
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(where if "://" in where else f"file://{where}")
    return ds.dataset(path, filesystem=fs, format="parquet")


def parquet_pages(options: dict) -> Callable[[int, int], list]:
    """Rows of a Parquet file or folder, in their order, as the pages of a source. Columns: options['columns'], joined by commas.

    A page reads only the row groups that it lies in."""

    def fetch(skip: int, limit: int) -> list:
        out, at = [], 0
        for part in (group for file in _dataset(options["path"]).get_fragments() for group in file.split_by_row_group()):
            n = part.row_groups[0].num_rows
            if at + n > skip and at < skip + limit:
                first = max(0, skip - at)
                out += part.scanner(columns=options["columns"].split(",")).take(range(first, min(n, skip + limit - at))).to_pylist()
            at += n
        return out

    return fetch


FETCHERS["parquet"] = parquet_pages
SIZES["parquet"] = lambda options: _dataset(options["path"]).count_rows()


#: As the option pages: no cap; the source tells its size.
ALL = "all"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.limit, self.most = int(options.get("limit", PAGE)), options.get("pages", MAX_PAGES)

    def partitions(self) -> list[InputPartition]:
        most = SIZES[self.options["fetch"]](self.options) // self.limit + 1 if self.most == ALL else int(self.most)
        return [InputPartition(i * self.limit) for i in range(most)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = FETCHERS[self.options["fetch"]](self.options)(partition.value, self.limit)
        if not isinstance(rows, list):
            raise ValueError("a page has to be a list")
        for pos, row in enumerate(rows):
            yield partition.value, len(rows), pos, json.dumps(row, ensure_ascii=False, default=str)
        if not rows:
            yield partition.value, 0, None, None


class PagedSource(DataSource):
    """Options: fetch (a name in FETCHERS), limit (rows a page), pages (the cap, or all), and what the fetcher needs."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "skip bigint, size bigint, pos bigint, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_pages(spark: SparkSession, fetch: str, limit: int = PAGE, pages: int | None = MAX_PAGES, **options: str) -> DataFrame:
    """(skip, pos, payload) of all rows up to the first short page; what stands behind it isn't the source's any more.

    No row is told if every page is full: then there is more than the cap allows, and reading fails. pages=None: no cap, for a source
    that tells its size."""
    if pages is None and fetch not in SIZES:
        raise ValueError(f"{fetch} doesn't tell its size; give a cap")
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").options(fetch=fetch, limit=str(limit), pages=ALL if pages is None else str(pages), **options).load()
    last = rows.agg(F.min(F.when(F.col("size") < limit, F.col("skip"))).alias("end"))  # one row
    more = "the source has grown while it was read" if pages is None else f"the source has more than {limit * pages} rows"
    end = F.coalesce("end", F.raise_error(F.lit(more)).cast("bigint"))
    return rows.join(F.broadcast(last.select(end.alias("end"))), F.col("skip") <= F.col("end")).where("payload IS NOT NULL").select("skip", "pos", "payload")
