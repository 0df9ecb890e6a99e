"""One-to-one and one-to-many equi-joins.

Both are inner joins on a key; a row without a partner waits (streams) or is left
out (batch).  Spark picks the physical join and splits skewed keys when it runs.
A null key matches nothing unless `optional`: then null equals null.

`consuming=True` gives one-to-one joins over unbounded input that forget a pair once it has met, and
one-to-many joins in which the last left row of a key wins: the rows of a key are taken in the order
of their time within each micro-batch.  `Meetings` computes this with windows over what is new and what waits, and keeps
what waits in a folder; `consuming` is the same as one plan, for bounded rows by the same windows, for streams (lazy steps)
by keyed state in Python, which costs about a millisecond a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, Row, StructField, StructType

from rillmark.streaming.storage import Batches


def _met(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, optional: bool) -> DataFrame:
    l = left.select(F.struct("*").alias("l"), left_key.alias("lk"))  # noqa: E741
    r = right.select(F.struct("*").alias("r"), right_key.alias("rk"))
    on = F.col("lk").eqNullSafe(F.col("rk")) if optional else F.col("lk") == F.col("rk")
    return l.join(r, on).select("l", "r")


def one_to_one(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, project: list[Column], optional: bool = False) -> DataFrame:
    """`project` of each pair: columns of struct l and struct r.  Keys are unique on each side."""
    return _met(left, right, left_key, right_key, optional).select(*project)


def one_to_many(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, project: list[Column], optional: bool = False, validate: bool = False) -> DataFrame:
    """As one_to_one; keys are unique on the left only.  `validate` raises, when rows are read, if they are not."""
    if validate:
        once = left.select(F.struct("*").alias("row"), left_key.alias("k")).groupBy("k").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"))
        left = once.where(F.when(F.col("n") > 1, F.raise_error(F.lit("left key repeats"))).otherwise(F.lit(True)).cast("boolean")).select("row.*")
    return _met(left, right, left_key, right_key, optional).select(*project)


class _Meeting(StatefulProcessor):
    """Rows of one key: (side, order, payload).  One-to-one drops a pair that met; one-to-many keeps the last left row."""

    def __init__(self, many: bool) -> None:
        self.many = many

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("payload", BinaryType())])
        self.left = handle.getValueState("left", schema)
        self.right = handle.getValueState("right", schema)
        self.backlog = handle.getListState("backlog", schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r["order"], r["side"])):
            own, other = (self.left, self.right) if row["side"] == 0 else (self.right, self.left)
            if self.many:
                if row["side"] == 0:
                    self.left.update((row["payload"],))
                    for (waiting,) in list(self.backlog.get()):
                        yield Row(l=row["payload"], r=waiting)
                    self.backlog.clear()
                elif self.left.exists():
                    yield Row(l=self.left.get()[0], r=row["payload"])
                else:
                    self.backlog.appendValue((row["payload"],))
            elif other.exists():
                partner = other.get()[0]
                other.clear()
                yield Row(l=row["payload"], r=partner) if row["side"] == 0 else Row(l=partner, r=row["payload"])
            else:
                own.update((row["payload"],))

    def close(self) -> None:
        pass


_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, which keyed state of several kinds needs; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def consuming(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, left_order: Column, right_order: Column, many: bool = False) -> DataFrame:
    """(l, r) structs of pairs that met; start a streaming query of it within `state_store`.  Orders: 64-bit numbers.

    Rows of streams rest in the state as JSON, with times to the microsecond.
    """
    if not left.isStreaming and not right.isStreaming:
        return _meet(sides(left, right, left_key, right_key, left_order, right_order).withColumn("ver", F.lit(0).cast("long")), 0, many).where("met").select("l", "r")

    def side(df: DataFrame, key: Column, order: Column, n: int) -> DataFrame:
        return df.select(key.alias("key"), F.lit(n).alias("side"), order.cast("long").alias("order"), F.to_json(F.struct("*"), {**_EXACT, "ignoreNullFields": "false"}).cast("binary").alias("payload"))

    both = side(left, left_key, left_order, 0).union(side(right, right_key, right_order, 1)).where("key is not null")
    met = both.groupBy("key").transformWithState(_Meeting(many), StructType([StructField("l", BinaryType()), StructField("r", BinaryType())]), "Append", "None")
    return met.select(F.from_json(F.col("l").cast("string"), left.schema, _EXACT).alias("l"), F.from_json(F.col("r").cast("string"), right.schema, _EXACT).alias("r"))


def sides(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, left_order: Column, right_order: Column) -> DataFrame:
    """Rows of both sides as one table: (key, side, order, l, r), of which the other side's struct is null; rows with a null key are left out."""
    l = left.select(left_key.alias("key"), F.lit(0).alias("side"), left_order.cast("long").alias("order"), F.struct("*").alias("l"), F.lit(None).cast(right.schema).alias("r"))  # noqa: E741
    r = right.select(right_key.alias("key"), F.lit(1).alias("side"), right_order.cast("long").alias("order"), F.lit(None).cast(left.schema).alias("l"), F.struct("*").alias("r"))
    return l.union(r).where("key is not null")


def _meet(rows: DataFrame, batch_id: int, many: bool) -> DataFrame:
    """(key, side, order, l, r, ver, met, stays, gone) of the keys that have rows of this batch; rows of lower `ver` waited and come first.

    met: l and r are a pair; stays: a row that waits from now on; gone: nothing of a key that had waiting rows does.
    """
    own = Window.partitionBy("key").orderBy("late", "order", "side")
    whole, upto = (own.rowsBetween(Window.unboundedPreceding, end) for end in (Window.unboundedFollowing, Window.currentRow))
    at = rows.withColumn("late", (F.col("ver") == batch_id).cast("int")).withColumn("n", F.row_number().over(own))
    if many:
        # A right row meets the last left row before it or, if it waited, the first after it.
        first, last = F.first("l", ignorenulls=True).over(whole), F.last("l", ignorenulls=True).over(upto)
        at = at.withColumns({"partner": F.coalesce(last, first), "final": F.max(F.when(F.col("side") == 0, F.col("n"))).over(whole), "fresh": F.max("late").over(whole)})
        met, gone = (F.col("side") == 1) & F.col("partner").isNotNull(), F.lit(False)
        stays = F.when(F.col("side") == 0, F.col("n") == F.col("final")).otherwise(F.col("partner").isNull())
        l, r = F.col("partner"), F.col("r")  # noqa: E741
    else:
        # A row is kept if it is its key's first or like the one before it; else if that one is not kept, for then nothing waits.
        before = F.lag("side").over(own)
        at = at.withColumns({"kept": F.when(before.isNull() | (before == F.col("side")), F.col("n")), "l0": F.lag("l").over(own), "r0": F.lag("r").over(own), "last": F.lead("side").over(own).isNull(), "fresh": F.max("late").over(whole), "old": F.min("late").over(whole)})
        at = at.withColumn("kept", F.max("kept").over(upto))
        met = (F.col("n") - F.col("kept")) % 2 == 1
        stays, gone = F.col("last") & ~met, F.col("last") & met & (F.col("old") == 0)
        l, r = F.when(F.col("side") == 0, F.col("l")).otherwise(F.col("l0")), F.when(F.col("side") == 1, F.col("r")).otherwise(F.col("r0"))  # noqa: E741
    at = at.where("fresh = 1").withColumns({"met": met, "stays": stays, "gone": gone}).where("met or stays or gone")
    return at.select("key", "side", "order", *(F.when(F.col("met"), pair).otherwise(F.col(c)).alias(c) for c, pair in (("l", l), ("r", r))), F.lit(batch_id).cast("long").alias("ver"), "met", "stays", "gone")


class Meetings:
    """A consuming join by micro-batches.  A batch's pairs and what waits of its keys are one commit, so both count or none does.

    What waits of a key is in the last commit that has the key; MERGED commits become a snapshot of what waits.  A batch
    reads all that waits and writes what it changes.
    """

    MERGED = 8

    def __init__(self, path: str, many: bool) -> None:
        self.path, self.many = path, many

    def _waiting(self, state: Batches, ids: list[int]) -> DataFrame:
        rows = state.read().where("stays or gone")
        if len(ids) + (state.covered() >= 0) > 1:
            rows = rows.withColumn("newest", F.max("ver").over(Window.partitionBy("key"))).where("ver = newest").drop("newest")
        return rows.where("stays")

    def met(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """(l, r) of the pairs that meet by this batch of `sides`; for a batch that was there, what met then."""
        state = Batches(rows.sparkSession, self.path)
        ids = state.batch_ids()
        if batch_id not in ids:
            if len(ids) >= self.MERGED:  # a batch begins when those before it have been read
                state.compact(self._waiting(state, ids), max(ids))
                ids = []
            rows = rows.withColumn("ver", F.lit(batch_id).cast("long"))
            if ids or state.covered() >= 0:
                rows = self._waiting(state, ids).select(*rows.columns).union(rows)
            state.commit(_meet(rows, batch_id, self.many), batch_id)
        return rows.sparkSession.read.parquet(f"{self.path}/batch={batch_id}").where("met").select("l", "r")
