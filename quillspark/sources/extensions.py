"""Storage of a user's own: a name for ``spark.read.format`` from plain functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Part(InputPartition):
    def __init__(self, value):
        self.value = value


def register(spark: SparkSession, name: str, schema: str, parts: Callable[[dict], list], read: Callable[[object, dict], Iterator[tuple]]) -> None:
    """Make ``spark.read.format(name)`` read rows of ``schema``.

    ``parts(options)`` lists what is to be read, one item for each task, and
    ``read(item, options)`` gives the rows of one, on an executor.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return [_Part(p) for p in parts(self.options)]

        def read(self, partition):
            yield from read(partition.value, self.options)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

    spark.dataSource.register(Source)
