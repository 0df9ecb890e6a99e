"""Aggregation tables: committed partial results, merged when read."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillmark.functions.monoids import Monoid
from rillmark.operators.streams import merge
from rillmark.streaming.storage import Batches, WatermarkLog


class AggrTable:
    """A map from key to the combination of all values of that key; late rows count like others."""

    def __init__(self, spark: SparkSession, path: str, monoid: Monoid, schema: StructType | str | None = None) -> None:
        self.batches, self.monoid, self.schema = Batches(spark, f"{path}/agg"), monoid, schema
        self.watermarks = WatermarkLog(spark, f"{path}/watermark")

    def add(self, partials: DataFrame, batch_id: int) -> bool:
        """Adds a batch's partial results, sorted by key for range reads; a replayed batch adds nothing."""
        return self.batches.commit(partials.sortWithinPartitions("key"), batch_id)

    def set(self, partials: DataFrame) -> None:
        """Makes these the whole table, as one snapshot."""
        self.batches.compact(partials, max(self.batches.batch_ids(), default=self.batches.covered() + 1))

    def partials(self) -> DataFrame:
        return self.batches.read(self.schema)

    def rows(self) -> DataFrame:
        return merge(self.partials(), self.monoid)

    def get_row(self, key) -> DataFrame:
        """(key, value); no row for a key that has none.  The filter reaches the files."""
        return merge(self.partials().where(F.col("key") == F.lit(key)), self.monoid)

    def get_row_range(self, low, high) -> DataFrame:
        """(key, value) by key, both bounds included."""
        return merge(self.partials().where(F.col("key").between(F.lit(low), F.lit(high))), self.monoid).orderBy("key")

    def get_blocking(self, key, timeout: float, every: float = 0.5):
        """The value once the key exists, or None after `timeout` seconds."""
        end = time.monotonic() + timeout
        while True:
            if self.batches.batch_ids() or self.batches.covered() >= 0:
                found = self.get_row(key).first()
                if found is not None:
                    return found["value"]
            if time.monotonic() >= end:
                return None
            time.sleep(every)

    def compact(self) -> None:
        """One snapshot of merged partials in place of all batches so far; replays of these still add nothing."""
        ids = self.batches.batch_ids()
        if ids:
            self.batches.compact(self.partials().groupBy("key").agg(*self.monoid.merged()).sortWithinPartitions("key"), max(ids))
