"""Secondary indexes: key to the coordinates of topic rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A row's address: partition, commit, place within both.
COORDINATES = ("_pid", "_ver", "_idx")
_ORDER = ("_ver", "_pid", "_idx")


def entries(topic: DataFrame, keys: Column) -> DataFrame:
    """(key, coordinates): an entry for each key of each row; none for an empty or null array."""
    return topic.select(F.explode(keys).alias("key"), *COORDINATES)


@dataclass(frozen=True)
class Index:
    """Lookups in entries; range bounds are inclusive."""

    df: DataFrame

    def lookup(self, key) -> DataFrame:
        """Coordinates of a key's rows in the order of commit."""
        return self.df.where(F.col("key") == F.lit(key)).select(*COORDINATES).orderBy(*_ORDER)

    def range(self, low, high, limit: int | None = None, reverse: bool = False) -> DataFrame:
        """(key, coordinates) in the order of key, then commit."""
        cols = [F.desc(c) if reverse else F.asc(c) for c in ("key", *_ORDER)]
        out = self.df.where(F.col("key").between(F.lit(low), F.lit(high))).orderBy(*cols)
        return out if limit is None else out.limit(limit)

    def count(self, key) -> DataFrame:
        """One row (n); 0 for a key without rows."""
        return self.df.where(F.col("key") == F.lit(key)).agg(F.count(F.lit(1)).alias("n"))

    def counts(self, low, high) -> DataFrame:
        """(key, n) by key; keys without rows are left out."""
        return self.df.where(F.col("key").between(F.lit(low), F.lit(high))).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy("key")

    def fetch(self, topic: DataFrame, key) -> DataFrame:
        """The topic's rows that have the key, once for each time they have it."""
        return topic.join(self.lookup(key), list(COORDINATES))
