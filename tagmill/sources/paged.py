"""A paged source: pages of JSON rows until a short one, as a Spark data source.

fetch(resource, page, size) returns a list of dicts; it runs on executors, so it must be
picklable. Pages are dealt to tasks in strides: task i takes pages i, i + n, ... until it
meets a short page, so no task waits for another.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a page; more are never asked for.
PAGE = 320


class Stride(InputPartition):
    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable, resource: str, size: int, tasks: int, limit: int | None):
        self.fetch, self.resource, self.size, self.tasks, self.limit = fetch, resource, size, tasks, limit

    def partitions(self) -> list[InputPartition]:
        return [Stride(k + 1, self.tasks) for k in range(self.tasks)]

    def read(self, part: Stride) -> Iterator[tuple]:
        page = part.first
        while self.limit is None or (page - 1) * self.size < self.limit:
            rows = self.fetch(self.resource, page, self.size)
            for k, row in enumerate(rows):
                if self.limit is None or (page - 1) * self.size + k < self.limit:
                    yield page, k, json.dumps(row, sort_keys=True)
            if len(rows) < self.size:
                return
            page += part.step


def paged(spark: SparkSession, fetch: Callable, resource: str, size: int = PAGE, tasks: int = 4, limit: int | None = None) -> DataFrame:
    """page, place, value (JSON) of all rows of a resource, at most limit of them."""
    size = min(size, PAGE)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tagmill_paged"

        def schema(self) -> str:
            return "page int, place int, value string"

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(fetch, resource, size, tasks, limit)

    spark.dataSource.register(Paged)
    return spark.read.format("tagmill_paged").load()
