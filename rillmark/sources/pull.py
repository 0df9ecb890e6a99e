"""Pull connectors: a stream from any function that reads the next items after an offset."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, read: Callable[[int], list[tuple]], setup: Callable[[], None] | None) -> None:
        self.pull = read
        if setup:
            setup()

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self.pull(start["at"])
        return iter(rows), {"at": start["at"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.pull(start["at"])[: end["at"] - start["at"]])

    def commit(self, end: dict) -> None:
        pass


def custom_stream(spark: SparkSession, name: str, schema: StructType, read: Callable[[int], list[tuple]], setup: Callable[[], None] | None = None) -> DataFrame:
    """read(n): the items after the first n, the same again when asked again; setup runs before the first read."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return schema

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: ARG002  its name is given
            return _Reader(read, setup)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


class _Slice(InputPartition):
    def __init__(self, part: int, start: int, end: int) -> None:
        super().__init__(part)
        self.part, self.start, self.end = part, start, end


class _PartsReader(DataSourceStreamReader):
    def __init__(self, latest: Callable[[], list[int]], read: Callable[[int, int, int], Iterator[tuple]], setup: Callable[[], None] | None, teardown: Callable[[], None] | None) -> None:
        self.latest, self.pull, self.teardown = latest, read, teardown
        if setup:
            setup()

    def initialOffset(self) -> dict:
        return {"at": [0] * len(self.latest())}

    def latestOffset(self) -> dict:
        return {"at": self.latest()}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        return [_Slice(k, a, b) for k, (a, b) in enumerate(zip(start["at"], end["at"], strict=True)) if b > a]

    def read(self, own: _Slice) -> Iterator[tuple]:
        return iter(self.pull(own.part, own.start, own.end))

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        if self.teardown:
            self.teardown()


def custom_stream_parts(spark: SparkSession, name: str, schema: StructType, latest: Callable[[], list[int]], read: Callable[[int, int, int], Iterator[tuple]], setup: Callable[[], None] | None = None, teardown: Callable[[], None] | None = None) -> DataFrame:
    """A source in parts that executors read in parallel: latest() is how many items each part has; read(part, start, end) gives these, the same when asked again.

    setup runs before the first look and teardown when the query stops, both beside the driver.  A watermark is given with Job.source.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return schema

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: ARG002  its name is given
            return _PartsReader(latest, read, setup, teardown)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()
