"""Streams and grouped streams over DataFrames, bounded or not."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.monoids import Monoid


@dataclass(frozen=True)
class Key:
    """A single key of each row, so nothing is exploded; a null key is a key."""

    column: Column


@dataclass(frozen=True)
class Stream:
    """Rows with a name.  `persisted`: written as a topic, so it can be indexed; `watermark`: its event time."""

    df: DataFrame
    name: str = "stream"
    persisted: bool = False
    watermark: Column | None = None

    def map(self, *cols: Column | str) -> Stream:
        """A lazy projection; Catalyst folds it into what reads it."""
        return replace(self, df=self.df.select(*cols), persisted=False)

    def map_maybe(self, **cols: Column) -> Stream:
        """A lazy projection that drops rows in which any of the new columns is null."""
        out = self.df.select(*(c.alias(n) for n, c in cols.items()))
        return replace(self, df=out.dropna(how="any", subset=list(cols)), persisted=False)

    def filter(self, condition: Column | str) -> Stream:
        return replace(self, df=self.df.where(condition), persisted=False)

    def benign_io(self, name: str, udf: Callable[[Column], Column], value: Column) -> Stream:
        """Adds what a function with harmless side effects returns; rows for which it is null are dropped.  It may run more than once."""
        return replace(self, df=self.df.withColumn(name, udf(value)).where(F.col(name).isNotNull()), persisted=False)

    def group_by(self, keys: Column | Key) -> Grouped:
        """keys: a Key, or an array; a row counts once for each element, repeats too, and not at all for an empty or null array."""
        return Grouped(self, keys)


@dataclass(frozen=True)
class Grouped:
    stream: Stream
    keys: Column | Key

    def exploded(self) -> DataFrame:
        return self.stream.df.withColumn("key", self.keys.column if isinstance(self.keys, Key) else F.explode(self.keys))

    def partials(self, monoid: Monoid, value: Column) -> DataFrame:
        """(key, partial columns) of these rows."""
        return self.exploded().groupBy("key").agg(*monoid.lifted(value))

    def aggregate(self, monoid: Monoid, value: Column) -> DataFrame:
        """(key, value): one pass over bounded rows."""
        return self.partials(monoid, value).select("key", monoid.result().alias("value"))


def merge(partials: DataFrame, monoid: Monoid) -> DataFrame:
    """(key, value) of partial rows, which may repeat keys."""
    return partials.groupBy("key").agg(*monoid.merged()).select("key", monoid.result().alias("value"))
